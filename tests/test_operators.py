from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankweave.operators import aggregates, baskets, filters, splits
from rankweave.operators.encode import IdIndex, vectorize
from rankweave.operators.filters import Filters
from rankweave.operators.numbering import drop, durable, number_rows, scoped
from rankweave.operators.profiles import user_profiles
from rankweave.schema import ITEM_ID, USER_ID, Applies, FeatureKind, FeatureSpec

SCHEMA = "user_id string, item_id string, value double, ts timestamp"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def interactions(spark, rows):
    start = datetime(2025, 1, 1)
    return spark.createDataFrame([(*r, start) if len(r) == 3 else r for r in rows], SCHEMA)


def test_number_rows_restarts_per_group_and_balances_one_big_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") < 4000, F.lit("big")).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") * 7919 % 5000).alias("x"),
    ).unionByName(spark.createDataFrame([(None, 3), (None, 1)], "g string, x long"))
    got = number_rows(df, [F.desc("x")], ["g"]).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["g"], []).append((r["pos"], r["x"]))
    assert len(got) == 5002 and len(by_group) == 9
    for found in by_group.values():
        found.sort()
        assert [p for p, _ in found] == list(range(len(found)))
        assert [x for _, x in found] == sorted((x for _, x in found), reverse=True)


def test_popularity_counts_every_row(spark):
    df = interactions(spark, [("u1", "i1", 1.0), ("u1", "i1", None), ("u2", "i1", 2.0), ("u2", "i2", 1.0)])
    assert rows_of(aggregates.popularity(df), ITEM_ID, "count") == [("i1", 3), ("i2", 1)]


def test_recency_literal(spark):
    df = interactions(
        spark,
        [
            ("u", "i1", 1.0, datetime(2025, 3, 9, 23, 59)),
            ("u", "i2", 1.0, datetime(2024, 11, 30)),
            ("u", "i3", 1.0, datetime(2025, 4, 9)),
        ],
    )
    got = dict(rows_of(aggregates.recency(df, date(2025, 3, 10), 30.0), ITEM_ID, "recency_score"))
    assert got["i1"] == pytest.approx(math.exp(-0.693147 / 30))
    assert got["i1"] > got["i2"] and got["i3"] > 1.0


def test_incremental_equals_full(spark):
    base = datetime(2025, 1, 1).timestamp()
    all_rows = spark.range(3000).select(
        F.concat(F.lit("u"), F.col("id") % 50).alias("user_id"),
        F.concat(F.lit("i"), F.col("id") % 37).alias("item_id"),
        F.lit(1.0).alias("value"),
        F.timestamp_seconds(F.lit(int(base)) + F.col("id") * 3600).alias("ts"),
    )
    cut, end = date(2025, 2, 10), date(2025, 5, 20)
    old, new = all_rows.filter(F.col("ts") < F.lit(cut)), all_rows.filter(F.col("ts") >= F.lit(cut))
    merged = aggregates.merge_recency(aggregates.recency(old, cut), cut, new, end)
    full = dict(rows_of(aggregates.recency(all_rows, end), ITEM_ID, "recency_score"))
    assert dict(rows_of(merged, ITEM_ID, "recency_score")) == pytest.approx(full, abs=1e-9)
    counts = aggregates.merge_popularity(aggregates.popularity(old), new)
    assert rows_of(counts, ITEM_ID, "count") == rows_of(aggregates.popularity(all_rows), ITEM_ID, "count")


def test_cluster_preferences_null_values(spark):
    df = interactions(
        spark,
        [("u1", "i1", 1.0), ("u2", "i1", None), ("u1", "i2", None), ("u3", "i1", 5.0), ("u9", "i1", 9.0)],
    )
    given = spark.createDataFrame([("u1", 0), ("u2", 0), ("u3", 1)], "user_id string, cluster int")
    got = rows_of(aggregates.cluster_preferences(df, given), "cluster", ITEM_ID, "cluster_score")
    # One value and one null: average 1 times two rows.  Only nulls: null.
    assert got[0] == (0, "i1", 2.0) and got[1] == (0, "i2", None) and got[2] == (1, "i1", 5.0)


def test_id_index(spark):
    # ann and bob are equally frequent, cy comes first.
    df = interactions(spark, [("bob", "pen", 1.0), ("cy", "cup", 2.0), ("ann", "cup", 3.0), ("cy", "pen", 4.0), ("cy", "cup", 5.0)])
    index = IdIndex.fit(df)
    assert rows_of(index.users, USER_ID, "user_id_int") == [("ann", 1), ("bob", 2), ("cy", 0)]
    assert rows_of(index.items, ITEM_ID, "item_id_int") == [("cup", 0), ("pen", 1)]
    asked = spark.createDataFrame([("bob",), ("nobody",)], "user_id string")
    assert rows_of(index.transform(asked), USER_ID, "user_id_int") == [("bob", 2), ("nobody", 3)]
    assert rows_of(index.transform(asked, "drop"), USER_ID, "user_id_int") == [("bob", 2)]
    back = index.inverse(index.transform(df).select("user_id_int", "item_id_int"))
    assert rows_of(back, USER_ID, ITEM_ID) == rows_of(df, USER_ID, ITEM_ID)
    assert index.user_idx("bob").first()[0] == 2 and index.user_idx("x").first() is None
    assert index.item_idx("pen").first()[0] == 1
    assert index.user_of(0).first()[0] == "cy" and index.item_of(7).first() is None


def test_vectorize_all_columns_and_specs(spark):
    df = spark.createDataFrame(
        [
            ("a", "x", 1.0, True, "t1"),
            ("b", "x", 2.0, False, "t2"),
            ("c", None, 3.0, True, "t2"),
            ("d", "y", None, True, "t2"),
            ("e", "y", float("nan"), True, "t2"),
        ],
        "item_id string, label string, n double, flag boolean, title string",
    )
    got = dict(rows_of(vectorize(df, ITEM_ID).table, ITEM_ID, "features"))
    # Labels are indexed over all rows, null gets the label count; rows without a number are left out.
    assert got == {"a": [0.0, 1.0, 1.0, 1.0], "b": [0.0, 2.0, 0.0, 0.0], "c": [2.0, 3.0, 1.0, 0.0]}
    specs = [
        FeatureSpec("n", FeatureKind.ORDINAL, Applies.ITEM),
        FeatureSpec("title", FeatureKind.TEXT, Applies.ITEM),
    ]
    assert vectorize(df, ITEM_ID, specs).names == ("n",)
    assert vectorize(df, ITEM_ID, specs, include_text=True).names == ("n", "title")
    empty = vectorize(df.select(ITEM_ID), ITEM_ID)
    assert empty.dim == 0 and empty.table.count() == 5


def test_profiles(spark):
    items = spark.createDataFrame([("x", 1.0, 0.0), ("y", 0.0, 1.0)], "item_id string, a double, b double")
    vectors = vectorize(items, ITEM_ID, normalize=True)
    df = interactions(
        spark,
        [
            ("plain", "x", 3.0), ("plain", "y", 4.0),
            ("twice", "x", 1.0), ("twice", "x", 1.0), ("twice", "y", 1.0),
            ("zero", "x", 1.0), ("zero", "y", -1.0),
            ("null", "x", None), ("null", "y", float("nan")),
            ("none", "gone", 1.0),
        ],
    )
    got = dict(rows_of(user_profiles(df, vectors).table, USER_ID, "features"))
    half = 1 / math.sqrt(2)
    assert got["plain"] == pytest.approx([0.6, 0.8])
    assert got["twice"] == pytest.approx([2 / math.sqrt(5), 1 / math.sqrt(5)])
    assert got["zero"] == pytest.approx([half, half]) and got["null"] == pytest.approx([half, half])
    assert "none" not in got


def test_rules_and_matches_against_brute_force(spark):
    held = {
        f"u{n}": [i for i, c in zip("abcdef", f"{n * 37 % 64:06b}") if c == "1"] for n in range(60)
    }
    pairs = [(u, i) for u, items in held.items() for i in items]
    owned = spark.createDataFrame(pairs, "user_id string, item_id string")
    rules = baskets.mine_rules(owned, 0.1, 0.3)
    mined = rules.collect()
    assert any(len(r["antecedent"]) > 1 for r in mined)
    users = [set(i) for i in held.values() if i]
    for r in mined:
        ante, both = set(r["antecedent"]), set(r["antecedent"]) | set(r["consequent"])
        support = sum(both <= u for u in users)
        assert r["support"] == pytest.approx(support / len(users))
        assert r["confidence"] == pytest.approx(support / sum(ante <= u for u in users))
    expected = {}
    for u, items in held.items():
        for r in mined:
            if items and set(r["antecedent"]) <= set(items):
                key = (u, r["consequent"][0])
                expected[key] = max(expected.get(key, 0.0), r["confidence"])
    got = {(u, i): c for u, i, c in rows_of(baskets.matched_confidence(rules, owned), USER_ID, ITEM_ID, "confidence")}
    assert got == pytest.approx(expected)


def test_baskets_of_one_item_give_no_rules(spark):
    owned = spark.createDataFrame([("a", "x"), ("b", "y")], "user_id string, item_id string")
    rules = baskets.mine_rules(owned, 0.01, 0.2)
    assert rules.count() == 0 and baskets.matched_confidence(rules, owned).count() == 0


def test_filters(spark):
    items = spark.createDataFrame(
        [("i1", True), ("i2", False), ("i3", True), ("i3", True)], "item_id string, available boolean"
    )
    assert rows_of(filters.candidates(items), ITEM_ID) == [("i1",), ("i2",), ("i3",)]
    assert rows_of(filters.candidates(items, ["i3"]), ITEM_ID) == [("i1",), ("i2",)]
    df = spark.createDataFrame(
        [("u", "i1"), ("u", "i2"), ("u", "i3"), ("v", "i1")], "user_id string, item_id string"
    )
    seen = spark.createDataFrame([("u", "i1")], "user_id string, item_id string")
    chosen = Filters(True, ["i9"], {"available": True})
    assert rows_of(filters.apply_filters(df, chosen, seen, items), USER_ID, ITEM_ID) == [("u", "i3"), ("v", "i1")]
    assert filters.apply_filters(df, Filters(False), seen).count() == 4
    with pytest.raises(ValueError):
        filters.apply_filters(df, chosen, seen)
    assert rows_of(filters.for_user(df, "v"), ITEM_ID) == [("i1",)]


def test_leave_some_out_keeps_duplicates_and_cap(spark):
    t = [datetime(2025, 1, d) for d in range(1, 8)]
    df = interactions(
        spark,
        [("a", "x", 1.0, t[0]), ("a", "x", 1.0, t[0]), ("a", "x", 1.0, t[0]), ("a", "y", 1.0, t[1])]
        + [("b", "x", 1.0, t[2]), ("b", "y", None, t[3]), ("b", "z", 1.0, t[4])],
    )
    base, test = splits.leave_some_out(df, 2, 3)
    assert rows_of(test, USER_ID, ITEM_ID) == [("a", "x"), ("a", "x"), ("b", "y"), ("b", "z")]
    assert rows_of(base, USER_ID, ITEM_ID) == [("a", "x"), ("a", "y"), ("b", "x")]
    base, test = splits.leave_some_out(df, 2, 3, max_test=3)
    assert rows_of(test, USER_ID, ITEM_ID) == [("a", "x"), ("a", "x"), ("b", "y")] and base.count() == 4


def test_folds(spark):
    df = interactions(spark, [(f"u{n % 7}", f"i{n}", float(n), datetime(2025, 1, 1 + n % 28)) for n in range(53)])
    folded = splits.block_folds(df, 10)
    assert sorted(r["count"] for r in folded.groupBy("fold").count().collect()) == [3, 10, 10, 10, 10, 10]
    base, test = splits.fold_split(splits.hash_folds(df, 5), 2)
    assert base.count() + test.count() == 53 and base.intersect(test).count() == 0
    numbers = [(int(r[0]), int(r[1])) for r in [("3", "20"), ("20", "3"), ("3", "4")]]
    messy = spark.createDataFrame([("3", "20"), ("20", "3"), ("3", "4")], "user_id string, item_id string")
    got = [(int(r[0]), int(r[1])) for r in splits.by_user_item(messy).collect()]
    assert got == sorted(numbers)


def test_a_run_owns_its_folders(spark):
    kept = durable(spark.range(3), "kept")
    with scoped(spark) as folder:
        inner = durable(spark.range(4), "inner")
        assert inner.scratch_path.startswith(folder) and inner.count() == 4
        drop(inner)
        drop(spark.range(1))
        with pytest.raises(ZeroDivisionError), scoped(spark, "second") as second:
            assert durable(spark.range(2), "x").scratch_path.startswith(second)
            1 / 0
        left = durable(spark.range(5), "left")
        assert left.scratch_path.startswith(folder) and left.count() == 5
    path = Path(folder.removeprefix("file:"))
    assert path.parent.is_dir() and not path.exists() and kept.count() == 3
    assert not durable(spark.range(1)).scratch_path.startswith(folder)


def test_written_ids_are_not_broadcast_by_the_size_of_their_files(spark):
    ids = durable(spark.range(400_000).select(F.col("id").cast("string").alias(USER_ID)), "ids")
    plan = ids.join(ids.select(USER_ID, F.length(USER_ID).alias("n")), USER_ID, "left")._jdf.queryExecution().toString()
    # Two to eight MB of files, some 20 MB of rows.
    assert "BroadcastHashJoin" not in plan
    few = durable(spark.range(10).select(F.col("id").cast("string").alias(USER_ID)), "few")
    assert "BroadcastHashJoin" in ids.join(few, USER_ID)._jdf.queryExecution().toString()


def test_frequent_sets_of_every_size(spark):
    from itertools import combinations

    owners = {f"u{n}": [i for i in "abcdefg" if (n * 7 + ord(i) * (n % 5 + 1)) % 4] for n in range(40)}
    owned = spark.createDataFrame([(u, i) for u, items in owners.items() for i in items], "user_id string, item_id string")
    expected = {}
    for size in range(1, 8):
        for chosen in combinations("abcdefg", size):
            n = sum(set(chosen) <= set(items) for items in owners.values())
            if n >= 12:
                expected[chosen] = n
    found = baskets.frequent_sets(owned, 12).collect()
    assert {tuple(r["items"]): r["freq"] for r in found} == expected and len(found) == len(expected)
    assert max(map(len, expected)) > 3
