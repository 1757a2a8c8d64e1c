"""Feature tables at rest: Parquet folders that are only ever added to, and a log of what is current.

``interactions/gen=G/stream=S/batch=B/attempt=N``  events, a folder per attempt to write a batch.
``popularity|recency/version=A``                   item aggregates, the base.
``deltas/version=D``                               what one batch adds to both aggregates, a row per item it has.
``user_features|item_features/version=V``
``manifest/version=M``                             the batches committed before the last compaction.
``log/<version>.json``                             one entry per committed change, published last.

A reader takes the newest entry and reads the folders it names, so it never sees half a change and is not disturbed by
the next one.  Every attempt of a writer uses folders of its own; only the entry of the next version, which can be
published once, decides between two writers.  The one that comes second starts again from the winner's
state, with the batch it has already written.

A batch adds a delta and leaves the base alone.  Readers sum base and deltas; a score decays by a common factor, so
each delta is aged from its own day.  Every ``COMPACT`` changes a compaction, a change like any other, sums them
into a new base and lists all batches in a manifest: a reader needs the manifest and at most the entries since.
Folders and entries that only states more than ``RETAINED`` versions old name are removed then, and a frame
handed out before that may fail.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace
from datetime import date
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.operators import aggregates
from rankweave.operators.numbering import remove
from rankweave.plans.signals import Features
from rankweave.schema import (
    INTERACTIONS,
    ITEM_ID,
    POPULARITY,
    RECENCY,
    Dataset,
    FeatureSpec,
    InteractionType,
)
from rankweave.sources.commits import Entries, unique

# Changes between two compactions, and versions whose folders are kept.
COMPACT, RETAINED = 16, 64

_BATCHES = "gen long, stream string, batch long, attempt long"
_DELTA = T.StructType([*POPULARITY.fields, T.StructField("recency_score", T.DoubleType())])
_STORED = T.StructType(
    [
        *INTERACTIONS.fields,
        T.StructField("stream", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("attempt", T.LongType()),
    ]
)


T_ = TypeVar("T_")


class Overtaken(Exception):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class State:
    """One log entry: the change, and which folders make up the tables after it."""

    version: int
    gen: int
    stream: str
    batch: int
    # The folder of the batch, None for a change without rows.
    attempt: int | None
    aggregates: int
    # The day of the base, and the deltas since with theirs: (folder, day).
    base_day: str
    deltas: Sequence[tuple[int, str]]
    catalog: int
    reference: str
    halflife: float
    # The manifest and the last version it covers.
    manifest: int | None = None
    covered: int = -1

    @property
    def reference_date(self) -> date:
        return date.fromisoformat(self.reference)

    def folders(self) -> set[str]:
        """All versioned folders the state names but those of interactions."""
        named = {f"{t}/version={self.aggregates}" for t in ("popularity", "recency")}
        named |= {f"deltas/version={n}" for n, _ in self.deltas}
        named |= {f"{t}/version={self.catalog}" for t in ("user_features", "item_features")}
        return named | ({f"manifest/version={self.manifest}"} if self.manifest is not None else set())


def _entry(version: int) -> str:
    return f"{version:012d}"


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # -- log ---------------------------------------------------------------------------------------

    @property
    def _entries(self) -> Entries:
        return Entries(self.spark, f"{self.root}/log")

    def _read(self, version: int) -> State | None:
        entry = self._entries.read(_entry(version))
        return State(**entry) if entry else None

    def state(self) -> State | None:
        """The newest state; one listing and one small file."""
        while True:
            names = self._entries.names()
            if not names:
                return None
            # The newest entry can only be missing if many more have been published since.
            state = self._read(int(names[-1]))
            if state is not None:
                return state

    def current(self) -> State:
        state = self.state()
        if state is None:
            raise FileNotFoundError(f"no feature tables at {self.root}")
        return state

    def _since(self, state: State) -> list[State]:
        """The changes after the manifest, at most a few more than ``COMPACT``."""
        found = (self._read(v) for v in range(state.covered + 1, state.version + 1))
        return [s for s in found if s is not None]

    def batches(self, state: State | None = None) -> DataFrame:
        """``(gen, stream, batch, attempt)`` of every committed batch of the current generation that has rows or
        had none to add (attempt null)."""
        state = state or self.current()
        rows = [(s.gen, s.stream, s.batch, s.attempt) for s in self._since(state) if s.gen == state.gen]
        recent = self.spark.createDataFrame(rows, _BATCHES).coalesce(1)
        if state.manifest is None:
            return recent
        return self.spark.read.schema(_BATCHES).parquet(f"{self.root}/manifest/version={state.manifest}").unionByName(recent)

    def _commit(self, state: State) -> State:
        if not self._entries.publish(_entry(state.version), asdict(state)):
            raise Overtaken(state.version)
        return state

    def _retried(self, attempt: Callable[[], T_]) -> T_:
        """Run ``attempt`` until no other writer takes its version first."""
        while True:
            try:
                return attempt()
            except Overtaken:
                continue

    def look(self, stream: str, batch: int) -> tuple[State | None, bool]:
        """The current state and whether the batch is in it."""
        state = self.state()
        if state is None:
            return None, False
        if any((s.gen, s.stream, s.batch) == (state.gen, stream, batch) for s in self._since(state)):
            return state, True
        if state.manifest is None:
            return state, False
        listed = self.spark.read.schema(_BATCHES).parquet(f"{self.root}/manifest/version={state.manifest}")
        return state, not listed.filter((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty()

    def has_batch(self, stream: str, batch: int) -> bool:
        return self.look(stream, batch)[1]

    def compact(self, every: int = 1) -> bool:
        """Sum the deltas into a new base and list the batches anew, if ``every`` or more changes came since.

        False if there was nothing to do or another writer came first, who may compact as well.  A
        compaction that is lost half-way leaves folders that nothing names.
        """
        state = self.current()
        if state.version - state.covered < every:
            return False
        number = unique()
        self._write(self._summed_popularity(state), "popularity", number)
        self._write(self._summed_recency(state), "recency", number)
        self.batches(state).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={number}")
        change = {"version": state.version + 1, "stream": "compact", "batch": number, "attempt": None}
        tables = {"aggregates": number, "base_day": state.reference, "deltas": (), "manifest": number, "covered": state.version}
        try:
            done = self._commit(replace(state, **change, **tables))
        except Overtaken:
            for table in ("popularity", "recency", "manifest"):
                remove(self.spark, f"{self.root}/{table}/version={number}")
            return False
        self._retire(done)
        return True

    def _retire(self, state: State) -> None:
        """Remove entries older than the retained versions, and folders that no retained state names."""
        versions = [int(n) for n in self._entries.names()]
        old = [v for v in versions if v < state.version - RETAINED and v <= state.covered]
        if not old:
            return
        states = [s for v in versions if v not in set(old) and (s := self._read(v))]
        kept, gens = {f for s in states for f in s.folders()}, {s.gen for s in states}
        for version in old:
            past = self._read(version)
            for folder in past.folders() - kept if past else ():
                remove(self.spark, f"{self.root}/{folder}")
            if past and past.gen not in gens:
                remove(self.spark, f"{self.root}/interactions/gen={past.gen}")
            self._entries.remove(_entry(version))

    # -- follow-up steps ---------------------------------------------------------------------------

    def followed(self, stream: str, batch: int) -> bool:
        """Whether what follows a batch, such as a refit, has been done."""
        try:
            return not self.spark.read.text(f"{self.root}/followed/stream={stream}/batch={batch}").isEmpty()
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return False
            raise

    def mark_followed(self, stream: str, batch: int) -> None:
        row = self.spark.createDataFrame([("done",)], "value string").coalesce(1)
        row.write.mode("overwrite").text(f"{self.root}/followed/stream={stream}/batch={batch}")

    # -- reading -----------------------------------------------------------------------------------

    def interactions(self) -> DataFrame:
        """All committed batches of the current generation."""
        return self._interactions(self.current())

    def _interactions(self, state: State) -> DataFrame:
        stored = self.spark.read.schema(_STORED).parquet(f"{self.root}/interactions/gen={state.gen}")
        # Folders of attempts that were not committed are left out.  One row per folder, fewer than the reader
        # lists anyway; a shuffle would send all rows of a large batch to one task.
        done = F.broadcast(self.batches(state).filter("attempt is not null").select("stream", "batch", "attempt"))
        return stored.join(done, ["stream", "batch", "attempt"], "left_semi").select(
            *INTERACTIONS.fieldNames()
        )

    def popularity(self) -> DataFrame:
        return self._summed_popularity(self.current())

    def recency(self) -> DataFrame:
        return self._summed_recency(self.current())

    def _delta(self, number: int) -> DataFrame:
        return self.spark.read.schema(_DELTA).parquet(f"{self.root}/deltas/version={number}")

    def _summed_popularity(self, state: State) -> DataFrame:
        base = self._versioned("popularity", state.aggregates)
        if not state.deltas:
            return base
        return aggregates.sum_popularity([base, *[self._delta(n).select(ITEM_ID, "count") for n, _ in state.deltas]])

    def _summed_recency(self, state: State) -> DataFrame:
        base = self._versioned("recency", state.aggregates)
        if not state.deltas and state.base_day == state.reference:
            return base
        parts = [(base, state.base_day), *[(self._delta(n).select(ITEM_ID, "recency_score"), day) for n, day in state.deltas]]
        return aggregates.sum_recency([(p, date.fromisoformat(day)) for p, day in parts], state.reference_date, state.halflife)

    def user_features(self) -> DataFrame:
        return self._versioned("user_features", self.current().catalog)

    def item_features(self) -> DataFrame:
        return self._versioned("item_features", self.current().catalog)

    def _versioned(self, table: str, version: int) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.root}/{table}/version={version}")
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"{table} version {version} at {self.root}") from problem
            raise

    def features(
        self,
        specs: tuple[FeatureSpec, ...] = (),
        interaction_type: InteractionType = InteractionType.EXPLICIT,
    ) -> Features:
        """All tables of one state."""
        state = self.current()
        return Features(
            self._interactions(state),
            self._summed_popularity(state),
            self._summed_recency(state),
            self._versioned("user_features", state.catalog),
            self._versioned("item_features", state.catalog),
            state.reference_date,
            specs,
            interaction_type,
        )

    # -- writing -----------------------------------------------------------------------------------

    def _write(self, df: DataFrame, table: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/version={version}")

    def _batch_path(self, gen: int, stream: str, batch: int, attempt: int) -> str:
        return f"{self.root}/interactions/gen={gen}/stream={stream}/batch={batch}/attempt={attempt}"

    def build(self, dataset: Dataset, reference: date, halflife_days: float = 30.0) -> State:
        """All five tables from a dataset.  The source is scanned once; aggregates read what was
        written."""
        number = unique()
        path = self._batch_path(number, "build", 0, number)
        dataset.interactions.select(*INTERACTIONS.fieldNames()).write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(INTERACTIONS).parquet(path)
        self._write(aggregates.popularity(written), "popularity", number)
        self._write(aggregates.recency(written, reference, halflife_days), "recency", number)
        return self._catalog(dataset, number, reference, halflife_days)

    def bootstrap(self, dataset: Dataset, reference: date, halflife_days: float = 30.0) -> State:
        """User and item tables only; interactions and aggregates start empty but typed."""
        number = unique()
        empty = self.spark.createDataFrame([], INTERACTIONS)
        empty.write.mode("overwrite").parquet(self._batch_path(number, "build", 0, number))
        self._write(self.spark.createDataFrame([], POPULARITY), "popularity", number)
        self._write(self.spark.createDataFrame([], RECENCY), "recency", number)
        return self._catalog(dataset, number, reference, halflife_days)

    def _catalog(self, dataset: Dataset, number: int, reference: date, halflife: float) -> State:
        """The first change of a generation; the manifest starts anew."""
        self._write(dataset.users, "user_features", number)
        self._write(dataset.items, "item_features", number)
        day = reference.isoformat()

        def attempt() -> State:
            before = self.state()
            version = 0 if before is None else before.version + 1
            return self._commit(State(version, number, "build", 0, number, number, day, (), number, day, halflife, None, version - 1))

        return self._retried(attempt)

    def append(self, batch: DataFrame, stream: str = "append", number: int | None = None) -> int:
        """Add a batch of canonical interactions and return its number of rows.

        An empty batch changes nothing.  The aggregates stay as they are until ``refresh``.
        """
        number = unique() if number is None else number
        written: dict[int, tuple[int, int]] = {}

        def attempt() -> int:
            state = self.current()
            if state.gen not in written:
                written[state.gen] = self._write_batch(batch, state, stream, number)
            rows, folder = written[state.gen]
            if rows:
                self._commit(replace(state, version=state.version + 1, stream=stream, batch=number, attempt=folder))
            return rows

        rows = self._retried(attempt)
        self.compact(COMPACT)
        return rows

    def _write_batch(self, batch: DataFrame, state: State, stream: str, number: int) -> tuple[int, int]:
        """Number of rows, and the attempt whose folder holds them."""
        folder = unique()
        if batch.isEmpty():
            return 0, folder
        path = self._batch_path(state.gen, stream, number, folder)
        batch.select(*INTERACTIONS.fieldNames()).write.mode("overwrite").parquet(path)
        # Counted from the file footers.
        return self.spark.read.schema(INTERACTIONS).parquet(path).count(), folder

    def refresh(self, reference: date, halflife_days: float | None = None) -> State:
        """Recompute both aggregates from all interactions."""

        def attempt() -> State:
            state, number = self.current(), unique()
            halflife = state.halflife if halflife_days is None else halflife_days
            rows, day = self._interactions(state), reference.isoformat()
            self._write(aggregates.popularity(rows), "popularity", number)
            self._write(aggregates.recency(rows, reference, halflife), "recency", number)
            change = {"version": state.version + 1, "stream": "refresh", "batch": number, "attempt": None}
            tables = {"aggregates": number, "base_day": day, "deltas": (), "reference": day, "halflife": halflife}
            return self._commit(replace(state, **change, **tables))

        return self._retried(attempt)

    def ingest(self, batch: DataFrame, stream: str, number: int, reference: date) -> int:
        """Append a batch and its share of the aggregates as one change.

        A batch that is already in the log is skipped, so redelivery after a failure counts nothing
        twice.  Only the batch is read, and what is written has a row per event and one per item of the batch.
        """
        written: dict[tuple[int, float], tuple[int, int]] = {}

        def attempt() -> int:
            state, done = self.look(stream, number)
            if state is None:
                raise FileNotFoundError(f"no feature tables at {self.root}")
            if done:
                return 0
            key = state.gen, state.halflife
            if key not in written:
                rows, folder = self._write_batch(batch, state, stream, number)
                if rows:
                    fresh = self.spark.read.schema(INTERACTIONS).parquet(self._batch_path(state.gen, stream, number, folder))
                    delta = aggregates.popularity(fresh).join(aggregates.recency(fresh, reference, state.halflife), ITEM_ID)
                    self._write(delta, "deltas", folder)
                written[key] = rows, folder
            rows, folder = written[key]
            day = reference.isoformat()
            change = {"version": state.version + 1, "stream": stream, "batch": number, "attempt": folder if rows else None}
            deltas = (*state.deltas, *([(folder, day)] if rows else []))
            self._commit(replace(state, reference=day, deltas=deltas, **change))
            return rows

        rows = self._retried(attempt)
        self.compact(COMPACT)
        return rows
