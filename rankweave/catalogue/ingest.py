"""Stored feature tables and streaming ingest, driven by the event log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.catalogue.common import CLICKS, shown
from rankweave.operators.numbering import scratch
from rankweave.schema import ITEM_ID
from rankweave.sources import events, tables
from rankweave.sources.store import FeatureStore
from rankweave.streaming.ingest import ingest_stream


def _store(spark: SparkSession, folder: str, name: str) -> FeatureStore:
    store = FeatureStore(spark, scratch(spark, name))
    store.build(tables.clicks(spark, folder), tables.CLICKS_REFERENCE)
    return store


def _shown(store: FeatureStore) -> DataFrame:
    return store.popularity().join(store.recency(), ITEM_ID).select(
        ITEM_ID, "count", shown("recency_score").alias("recency_score")
    )


def stored_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Build the feature tables from clicks and read the aggregates back."""
    return _shown(_store(spark, folder, "store"))


def stored_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder, "store").interactions()


def refresh_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue first, interactions appended in two batches, aggregates recomputed."""
    data = tables.clicks(spark, folder)
    store = FeatureStore(spark, scratch(spark, "refresh"))
    store.bootstrap(data, date(2024, 1, 1))
    early = F.col("ts") < F.lit("2024-01-10").cast("timestamp")
    store.append(data.interactions.filter(early))
    store.append(data.interactions.filter(~early))
    store.refresh(tables.CLICKS_REFERENCE)
    return _shown(store)


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Replay the clicks as JSON messages and ingest them as a stream into a store that already holds
    them: every count doubles."""
    data = tables.clicks(spark, folder)
    store = _store(spark, folder, "ingest")
    messages = f"{store.root}/messages"
    events.replay(data.interactions, "text", path=messages)
    query = ingest_stream(
        store,
        events.file_stream(spark, messages),
        f"{store.root}/checkpoint",
        reference=lambda: tables.CLICKS_REFERENCE,
    )
    query.awaitTermination()
    return _shown(store)


QUERIES = {
    "stored_tables": stored_tables,
    "stored_interactions": stored_interactions,
    "refresh_aggregates": refresh_aggregates,
    "stream_ingest": stream_ingest,
}

_AGGREGATES = f"""WITH {CLICKS}
    SELECT item_id, CAST({{0}} * count(*) AS BIGINT) AS count,
           round({{0}} * sum(exp(-(0.693147 / 30.0) * date_diff('day', ts, DATE '2024-02-01'))), 6)
             AS recency_score
    FROM ci GROUP BY item_id"""

ORACLES = {
    "stored_tables": _AGGREGATES.format(1),
    "stored_interactions": f"WITH {CLICKS} SELECT * FROM ci",
    "refresh_aggregates": _AGGREGATES.format(1),
    "stream_ingest": _AGGREGATES.format(2),
}
