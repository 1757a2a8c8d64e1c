"""Live ingest: messages to validated interactions, fresh aggregates, optionally refitted signals."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rankweave.plans.artifacts import fit_saved
from rankweave.plans.heuristics import Heuristics
from rankweave.plans.recommend import Fitted
from rankweave.schema import FeatureSpec
from rankweave.sources.events import from_messages, validated
from rankweave.sources.store import FeatureStore

Reference = Callable[[], date]
After = Callable[[FeatureStore], object]


def ingest_events(
    store: FeatureStore,
    events: DataFrame,
    number: int,
    stream: str = "events",
    reference: Reference = date.today,
    after: After | None = None,
    default_time: bool = False,
) -> int:
    """One batch of decoded events: validate, append, merge aggregates, then ``after(store)``.

    Bad events go to ``rejects/`` with the reason.  Running the same number again changes nothing.  With
    ``default_time`` an event without ``ts`` happened now, as in request bodies.
    """
    if store.has_batch(stream, number):
        # A crash may have come between the batch and what follows it.
        if after is not None and not store.followed(stream, number):
            after(store)
            store.mark_followed(stream, number)
        return 0
    events = events.persist()
    try:
        good, bad = validated(events, default_time)
        path = f"{store.root}/rejects/stream={stream}/batch={number}"
        bad.write.mode("overwrite").json(path)
        rows = store.ingest(good, stream, number, reference())
    finally:
        events.unpersist()
    if after is not None:
        after(store)
        store.mark_followed(stream, number)
    return rows


def ingest_step(
    store: FeatureStore,
    messages: DataFrame,
    number: int,
    stream: str = "events",
    reference: Reference = date.today,
    after: After | None = None,
) -> int:
    """``ingest_events`` for one micro-batch of JSON messages."""
    return ingest_events(store, from_messages(messages), number, stream, reference, after)


def refit(
    heuristics: Heuristics,
    models: str,
    specs: tuple[FeatureSpec, ...] = (),
    report: Callable[[Fitted], object] | None = None,
) -> After:
    """An ``after`` step that learns every active signal from the fresh tables and saves new versions.

    ``report`` gets the result: what was learned, and what was skipped and why.
    """

    def step(store: FeatureStore) -> Fitted:
        fitted = fit_saved(store.features(specs), heuristics, models, force=True)
        if report is not None:
            report(fitted)
        return fitted

    return step


def ingest_stream(
    store: FeatureStore,
    messages: DataFrame,
    checkpoint: str,
    stream: str = "events",
    reference: Reference = date.today,
    after: After | None = None,
    continuous: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Run ``ingest_step`` on every micro-batch of a message stream.

    By default the query ends when it has read what is there; ``continuous`` keeps it running with the
    given trigger interval.  The checkpoint makes Spark redeliver an unfinished batch under its old
    number, and the store skips numbers it has, so each message counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        ingest_step(store, batch, number, stream, reference, after)

    writer = messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if continuous:
        return writer.trigger(processingTime=interval).start()
    return writer.trigger(availableNow=True).start()
