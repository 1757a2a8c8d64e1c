"""Id mapping, label indexing, vectors and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.catalogue.common import RETAIL, shown
from rankweave.operators.encode import IdIndex, fit_labels, vectorize
from rankweave.operators.profiles import user_profiles
from rankweave.schema import ITEM_ID, ITEM_IDX, USER_ID, USER_IDX, Applies
from rankweave.sources import tables


def _index(spark: SparkSession, folder: str) -> IdIndex:
    return IdIndex.fit(tables.retail_interactions(spark, folder))


def string_index_users(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).users


def string_index_items(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).items


def ids_to_integers(spark: SparkSession, folder: str) -> DataFrame:
    """Known ids get their integer, customers without orders the number of known ids."""
    users = tables.retail(spark, folder).users.select(USER_ID)
    return _index(spark, folder).transform(users)


def integers_to_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every interaction to integers and back."""
    rows = tables.retail_interactions(spark, folder)
    index = IdIndex.fit(rows)
    ints = index.transform(rows, unknown="drop").select(USER_IDX, ITEM_IDX)
    return index.inverse(ints).select(USER_ID, ITEM_ID)


def label_index(spark: SparkSession, folder: str) -> DataFrame:
    items = tables.retail(spark, folder).items
    return fit_labels(items, ["brand", "type"]).table


def _components(vectors, id_column: str) -> DataFrame:
    return vectors.table.select(
        id_column, *[shown(F.get("features", j)).alias(f"f_{n}") for j, n in enumerate(vectors.names)]
    )


def vectorize_items(spark: SparkSession, folder: str) -> DataFrame:
    data = tables.retail(spark, folder)
    return _components(vectorize(data.items, ITEM_ID, data.specs_for(Applies.ITEM)), ITEM_ID)


def vectorize_users(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in debt have no balance: they are left out.  One segment is null: it gets its own index."""
    data = tables.retail(spark, folder)
    users = data.users.withColumn(
        "balance", F.when(F.col("balance") >= 0, F.col("balance"))
    ).withColumn("segment", F.when(F.col("segment") != "BUILDING", F.col("segment")))
    return _components(vectorize(users, USER_ID, data.specs_for(Applies.USER)), USER_ID)


def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    data = tables.retail(spark, folder)
    return _components(
        vectorize(data.items, ITEM_ID, data.specs_for(Applies.ITEM), normalize=True), ITEM_ID
    )


def weighted_unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Feature weights: price counts a hundredth, brand does not count."""
    data = tables.retail(spark, folder)
    weights = {"price": 0.01, "brand": 0.0}
    return _components(
        vectorize(data.items, ITEM_ID, data.specs_for(Applies.ITEM), weights=weights, normalize=True),
        ITEM_ID,
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    data = tables.retail(spark, folder)
    vectors = vectorize(data.items, ITEM_ID, data.specs_for(Applies.ITEM), normalize=True)
    return _components(user_profiles(data.interactions, vectors), USER_ID)


QUERIES = {
    "string_index_users": string_index_users,
    "string_index_items": string_index_items,
    "ids_to_integers": ids_to_integers,
    "integers_to_ids": integers_to_ids,
    "label_index": label_index,
    "vectorize_items": vectorize_items,
    "vectorize_users": vectorize_users,
    "unit_vectors": unit_vectors,
    "weighted_unit_vectors": weighted_unit_vectors,
    "user_profiles": profiles,
}

# Raw, unit and profile vectors of the retail items.
VECTORS = """
bi AS (SELECT brand, row_number() OVER (ORDER BY count(*) DESC, brand) - 1 x FROM rp GROUP BY brand),
ti AS (SELECT type, row_number() OVER (ORDER BY count(*) DESC, type) - 1 x FROM rp GROUP BY type),
rv AS (SELECT item_id, CAST(bi.x AS DOUBLE) b, CAST(ti.x AS DOUBLE) t, size s, price p
       FROM rp JOIN bi USING (brand) JOIN ti USING (type)),
nv AS (SELECT item_id, b / l b, t / l t, s / l s, p / l p
       FROM (SELECT *, sqrt(b * b + t * t + s * s + p * p) l FROM rv)),
wm AS (SELECT user_id, sum(value * b) / sum(value) b, sum(value * t) / sum(value) t,
              sum(value * s) / sum(value) s, sum(value * p) / sum(value) p
       FROM ri JOIN nv USING (item_id) GROUP BY user_id),
up AS (SELECT user_id, b / l b, t / l t, s / l s, p / l p
       FROM (SELECT *, sqrt(b * b + t * t + s * s + p * p) l FROM wm))"""

_SHOWN = "round(b, 6) f_brand, round(t, 6) f_type, round(s, 6) f_size, round(p, 6) f_price"

_IDS = """
iu AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 user_id_int
       FROM ri GROUP BY user_id),
ii AS (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) - 1 item_id_int
       FROM ri GROUP BY item_id)"""

ORACLES = {
    "string_index_users": f"WITH {RETAIL}, {_IDS} SELECT * FROM iu",
    "string_index_items": f"WITH {RETAIL}, {_IDS} SELECT * FROM ii",
    "ids_to_integers": f"""WITH {RETAIL}, {_IDS}
        SELECT user_id, coalesce(user_id_int, (SELECT count(*) FROM iu)) user_id_int
        FROM ru LEFT JOIN iu USING (user_id)""",
    "integers_to_ids": f"WITH {RETAIL} SELECT user_id, item_id FROM ri",
    "label_index": f"""WITH {RETAIL}, {VECTORS}
        SELECT 'brand' AS column, brand AS label, x AS idx FROM bi
        UNION ALL SELECT 'type', type, x FROM ti""",
    "vectorize_items": f"WITH {RETAIL}, {VECTORS} SELECT item_id, {_SHOWN} FROM rv",
    "vectorize_users": f"""WITH {RETAIL},
        u AS (SELECT user_id, nullif(segment, 'BUILDING') segment, nation, balance FROM ru),
        si AS (SELECT segment, row_number() OVER (ORDER BY count(*) DESC, segment) - 1 x
               FROM u WHERE segment IS NOT NULL GROUP BY segment),
        ni AS (SELECT nation, row_number() OVER (ORDER BY count(*) DESC, nation) - 1 x
               FROM u GROUP BY nation)
        SELECT user_id, CAST(coalesce(si.x, (SELECT count(*) FROM si)) AS DOUBLE) f_segment,
               CAST(ni.x AS DOUBLE) f_nation, round(balance, 6) f_balance
        FROM u LEFT JOIN si USING (segment) JOIN ni USING (nation) WHERE balance >= 0""",
    "unit_vectors": f"WITH {RETAIL}, {VECTORS} SELECT item_id, {_SHOWN} FROM nv",
    "weighted_unit_vectors": f"""WITH {RETAIL}, {VECTORS}
        SELECT item_id, 0.0::DOUBLE f_brand, round(t / l, 6) f_type, round(s / l, 6) f_size,
               round(p * 0.01 / l, 6) f_price
        FROM (SELECT *, sqrt(t * t + s * s + p * 0.01 * p * 0.01) l FROM rv)""",
    "user_profiles": f"WITH {RETAIL}, {VECTORS} SELECT user_id, {_SHOWN} FROM up",
}
