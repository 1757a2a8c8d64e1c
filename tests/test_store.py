from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rankweave.operators import aggregates
from rankweave.operators.filters import Filters
from rankweave.plans import artifacts
from rankweave.plans.heuristics import Heuristics, SignalConfig
from rankweave.plans.recommend import fit_all, recommend
from rankweave.plans.signals import SIGNALS, Artifacts, Features, Signal, als_factors
from rankweave.plans.scores import item_scores
from rankweave.schema import INTERACTIONS
from rankweave.sources import events, synthetic
from rankweave.sources.commits import Entries
from rankweave.sources.store import COMPACT, FeatureStore
from rankweave.streaming.ingest import ingest_events, ingest_step, ingest_stream, refit

DAY = date(2026, 6, 2)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def pops(df):
    return rows_of(df.select("item_id", "count"))


@pytest.fixture(scope="module")
def data(spark):
    return synthetic.synthetic(spark, 60, 25, 900)


def close(a, b):
    a, b = dict(rows_of(a)), dict(rows_of(b))
    assert a == pytest.approx(b, abs=1e-9)


def test_build_and_read(spark, data, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.interactions()
    store.build(data, DAY)
    assert rows_of(store.interactions()) == rows_of(data.interactions)
    assert pops(store.popularity()) == pops(aggregates.popularity(data.interactions))
    close(store.recency(), aggregates.recency(data.interactions, DAY))
    assert store.user_features().count() == 60 and store.item_features().count() == 25


def test_rows_of_a_batch_are_not_shuffled_by_its_folder(spark, data, tmp_path):
    """All rows of a batch have one folder: a shuffle on it sends them to one task."""
    store = FeatureStore(spark, str(tmp_path / "s"))
    store.build(data, DAY)
    plan = store.interactions()._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_bootstrap_append_refresh(spark, data, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    store.bootstrap(data, DAY)
    assert store.interactions().count() == 0 and store.popularity().count() == 0
    assert store.recency().columns == ["item_id", "recency_score"]
    early = F.col("ts") < F.lit("2025-12-01").cast("timestamp")
    n = store.append(data.interactions.filter(early))
    held = store.popularity()
    assert n == store.interactions().count() > 0 and held.count() == 0
    assert store.append(data.interactions.limit(0)) == 0
    store.append(data.interactions.filter(~early))
    store.refresh(DAY)
    assert held.count() == 0  # a frame handed out earlier keeps reading its own version
    assert pops(store.popularity()) == pops(aggregates.popularity(data.interactions))
    close(store.recency(), aggregates.recency(data.interactions, DAY))


def test_rebuild_replaces_interactions(spark, data, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    store.build(data, DAY)
    store.append(data.interactions.limit(5))
    store.build(data, DAY)
    assert store.interactions().count() == 900


def test_uncommitted_batch_is_invisible(spark, data, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    store.build(data, DAY)
    store._write_batch(data.interactions, store.current(), "events", 7)
    assert store.interactions().count() == 900
    assert store.ingest(data.interactions.limit(3), "events", 7, DAY) == 3
    assert store.interactions().count() == 903


def test_ingest_is_idempotent_and_incremental_equals_full(spark, data, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    store.build(data, date(2026, 1, 1))
    batch = events.to_messages(data.interactions.limit(50))
    bad = spark.createDataFrame([("{broken",), ('{"user_id":"u"}',)], "value string")
    done = []
    for _ in range(2):
        rows = ingest_step(store, batch.union(bad), 0, reference=lambda: DAY, after=done.append)
    assert rows == 0 and len(done) == 1 and store.interactions().count() == 950
    assert pops(store.popularity()) == pops(aggregates.popularity(store.interactions()))
    close(store.recency(), aggregates.recency(store.interactions(), DAY))
    rejects = spark.read.json(f"{store.root}/rejects/stream=events/batch=0")
    assert sorted(r["reason"] for r in rejects.collect()) == ["item_id", "user_id"]


def test_two_writers_lose_nothing(spark, data, tmp_path):
    store, other = (FeatureStore(spark, str(tmp_path / "s")) for _ in range(2))
    store.build(data, DAY)
    before = store.interactions().count()
    a, b = data.interactions.limit(3), data.interactions.limit(4)
    commit = store._commit

    def late(state):
        # The other writer commits after this one has read the state and written its rows.
        store._commit = commit
        assert other.append(b) == 4
        other.ingest(b, "other", 1, DAY)
        return commit(state)

    store._commit = late
    assert store.ingest(a, "mine", 1, DAY) == 3
    assert store.interactions().count() == before + 3 + 4 + 4
    # The appended rows count from the next refresh on; both merged batches count at once.
    assert sum(r["count"] for r in store.popularity().collect()) == before + 3 + 4
    store.refresh(DAY)
    assert pops(store.popularity()) == pops(aggregates.popularity(store.interactions()))


def test_races_keep_every_row(spark, data, tmp_path):
    """Several writers at once, over and over: every batch counts once, nobody fails."""
    root = str(tmp_path / "s")
    FeatureStore(spark, root).bootstrap(data, DAY)
    two = spark.createDataFrame([("u", "i1", 1.0, datetime(2026, 6, 1)), ("u", "i2", None, datetime(2026, 5, 1))], INTERACTIONS).cache()
    rounds, writers = 8, 3

    def write(k):
        store = FeatureStore(spark, root)
        for n in range(rounds):
            assert store.ingest(two, f"w{k}", n, DAY) == 2

    with ThreadPoolExecutor(writers) as pool:
        for done in [pool.submit(write, k) for k in range(writers)]:
            done.result()
    store = FeatureStore(spark, root)
    assert store.interactions().count() == 2 * rounds * writers
    assert pops(store.popularity()) == [("i1", rounds * writers), ("i2", rounds * writers)]
    close(store.recency(), aggregates.recency(store.interactions(), DAY))
    # One manifest and few entries are read, whatever came before.
    state = store.current()
    assert state.covered > 0 and len(state.deltas) <= COMPACT + writers and len(store._since(state)) <= COMPACT + writers + 1
    assert store.has_batch("w0", 0) and not store.has_batch("w0", rounds)
    assert store.ingest(two, "w2", 0, DAY) == 0


def test_a_version_is_published_once(spark, tmp_path):
    entries, wins = Entries(spark, str(tmp_path / "log")), []
    assert entries.names() == [] and entries.read("x") is None

    def claim(k):
        for n in range(200):
            if entries.publish(f"{n:03d}", {"by": k}):
                wins.append((n, k))

    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(claim, k) for k in range(2)]:
            done.result()
    assert sorted(n for n, _ in wins) == list(range(200)) and entries.names() == [f"{n:03d}" for n in range(200)]
    assert all(entries.read(f"{n:03d}") == {"by": k} for n, k in wins)
    # The other way of publishing, one after the other.
    entries._name = entries._rename
    assert entries.publish("a", {"x": 1}) and not entries.publish("a", {"x": 2}) and entries.read("a") == {"x": 1}
    assert len(list((tmp_path / "log").glob(".draft-*"))) == 0


def test_a_batch_writes_its_own_items_only(spark, data, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    store.build(data, date(2026, 1, 1))
    base = store.current().aggregates
    for n in range(3):
        store.ingest(data.interactions.limit(2), "events", n, date(2026, 1, 2 + n))
    state = store.current()
    assert state.aggregates == base and len(state.deltas) == 3
    assert all(store._delta(n).count() <= 2 for n, _ in state.deltas)
    close(store.recency(), aggregates.recency(store.interactions(), date(2026, 1, 4)))
    held = pops(store.popularity())
    commit, store._commit = store._commit, None
    with pytest.raises(TypeError):
        store.compact()  # lost before its commit
    store._commit = commit
    assert store.current() == state and pops(store.popularity()) == held
    assert store.compact() and store.current().deltas == [] and pops(store.popularity()) == held
    close(store.recency(), aggregates.recency(store.interactions(), date(2026, 1, 4)))
    assert store.interactions().count() == 906 and store.has_batch("events", 1) and store.ingest(data.interactions, "events", 1, DAY) == 0


def test_old_versions_go(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr("rankweave.sources.store.RETAINED", 4)
    monkeypatch.setattr("rankweave.sources.store.COMPACT", 3)
    store = FeatureStore(spark, str(tmp_path / "s"))
    store.build(data, DAY)
    store.build(data, DAY)
    for n in range(12):
        store.ingest(data.interactions.limit(1), "events", n, DAY)
    names = store._entries.names()
    assert len(names) <= 4 + 2 * 3 and int(names[-1]) >= 13
    named = {f for n in names for f in store._read(int(n)).folders()}
    there = {f"{t.name}/{v.name}" for t in (tmp_path / "s").iterdir() if t.name not in ("log", "interactions") for v in t.iterdir()}
    assert there == named and len(list((tmp_path / "s" / "interactions").iterdir())) == 1
    assert store.interactions().count() == 912 and sum(r["count"] for r in store.popularity().collect()) == 912
    assert store.user_features().count() == 60


def test_two_savers_keep_their_tables_apart(spark, data, tmp_path):
    root = str(tmp_path / "m")

    def one(k):
        for n in range(3):
            table = spark.createDataFrame([(k, n)] * 5, "k int, n int")
            artifacts.save(spark, {"own": Artifacts({"a": table, "b": table}, {}, {"k": k, "n": n})}, root)

    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(one, k) for k in range(2)]:
            done.result()
    art = artifacts.load(spark, root)["own"]
    for name in "ab":
        assert {tuple(r) for r in art.tables[name].collect()} == {(art.settings["k"], art.settings["n"])}
    assert spark.read.json(f"{root}/log").count() == 6
    for n in range(9):
        artifacts.save(spark, {"own": Artifacts({"a": spark.range(1)}, {}, {})}, root)
    assert spark.read.json(f"{root}/log").count() == artifacts.RETAINED == len(list((tmp_path / "m" / "model=own").iterdir()))


def test_a_lost_follow_up_is_made_up(spark, data, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    store.bootstrap(data, DAY)
    batch = events.to_messages(data.interactions.limit(5))

    def crash(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ingest_step(store, batch, 0, reference=lambda: DAY, after=crash)
    done = []
    for _ in range(2):
        ingest_step(store, batch, 0, reference=lambda: DAY, after=done.append)
    assert len(done) == 1 and store.interactions().count() == 5


def test_a_late_failure_costs_one_signal(spark, data, tmp_path):
    def fit(features, params):
        return Artifacts({"bad": features.items.select("item_id", F.raise_error(F.lit("late")).alias("x"))})

    mine = {**SIGNALS, "bad": Signal("bad", fit, lambda *a: None)}
    heuristics = Heuristics("d", {"popularity": SignalConfig(0.5), "bad": SignalConfig(0.5)})
    fitted = artifacts.fit_saved(Features.of(data, DAY), heuristics, str(tmp_path / "m"), signals=mine)
    assert list(fitted.artifacts) == ["popularity"] and list(fitted.skipped) == ["bad"]
    with pytest.raises(ValueError, match="unknown"):
        fit_all(Features.of(data, DAY), heuristics)


def test_bodies_are_ingested_and_signals_refitted(spark, data, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    store.bootstrap(data, DAY)
    body = {"interactions": [{"user_id": f"u{n}", "item_id": "i3"} for n in range(4)]}
    bodies = spark.createDataFrame([(json.dumps(body),)], "value string")
    rows, _ = events.body_events(events.parse_bodies(bodies))
    heuristics = Heuristics("s", {"popularity": SignalConfig(0.5), "als_cf": SignalConfig(0.5)}, top_k=1)
    reports = []
    root = str(tmp_path / "models")
    n = ingest_events(
        store, rows, 1, "bodies", lambda: DAY, refit(heuristics, root, report=reports.append), default_time=True
    )
    # No values at all: there is nothing to factorise, popularity still serves.
    assert n == 4 and list(reports[0].artifacts) == ["popularity"] and list(reports[0].skipped) == ["als_cf"]
    users = spark.createDataFrame([("u9",)], "user_id string")
    row = recommend(store.features(), users, heuristics, reports[0]).first()
    assert (row["item_id"], row["final_score"]) == ("i3", 0.5)


def test_stream_reads_each_file_once(spark, data, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    store.bootstrap(data, DAY)
    topic = tmp_path / "topic"
    topic.mkdir()

    def run():
        query = ingest_stream(
            store, events.file_stream(spark, str(topic)), str(tmp_path / "check"), reference=lambda: DAY
        )
        query.awaitTermination()

    def event(u):
        return json.dumps({"user_id": u, "item_id": "i1", "value": None, "ts": "2026-06-01T00:00:00+00:00"})

    (topic / "a.json").write_text(event("u1") + "\n" + event("u2") + "\n")
    run()
    (topic / "b.json").write_text(event("u3") + "\nnot json\n")
    run()
    run()
    assert rows_of(store.interactions().select("user_id", "ts")) == [
        (u, datetime(2026, 6, 1)) for u in ("u1", "u2", "u3")
    ]
    assert rows_of(store.popularity()) == [("i1", 3)]


MIX = {
    "popularity": SignalConfig(0.1),
    "als_cf": SignalConfig(0.4, {"rank": 4, "max_iter": 3}),
    "content": SignalConfig(0.2),
    "segments": SignalConfig(0.1, {"k": 3}),
    "rules": SignalConfig(0.1, {"min_support": 0.1, "min_confidence": 0.2}),
    "trends": SignalConfig(0.1),
}


def test_recommend_all_signals_invariants(spark, data):
    features = Features.of(data, DAY, keep=True)
    users = spark.createDataFrame([("u1",), ("u2",), ("nobody",)], "user_id string")
    heuristics = Heuristics("synthetic", MIX, top_k=5)
    fitted = fit_all(features, heuristics)
    assert not fitted.skipped and set(fitted.artifacts) == set(MIX)
    rows = recommend(features, users, heuristics, fitted).collect()
    seen = {(r[0], r[1]) for r in data.interactions.select("user_id", "item_id").collect()}
    for user in ("u1", "u2", "nobody"):
        mine = sorted((r for r in rows if r["user_id"] == user), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        finals = [r["final_score"] for r in mine]
        assert finals == sorted(finals, reverse=True)
        for r in mine:
            assert (user, r["item_id"]) not in seen
            assert sum(r["breakdown"].values()) == pytest.approx(r["final_score"], abs=1e-8)
            cold = {"popularity", "trends"}
            assert set(r["breakdown"]) == (cold if user == "nobody" else set(MIX))
    again = recommend(features, users, heuristics, fitted).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_als_factors_give_model_predictions(spark, data):
    features = Features.of(data, DAY)
    for implicit in (False, True):
        art = SIGNALS["als_cf"].fit(features, {"rank": 4, "max_iter": 3, "implicit": implicit})
        users, items = als_factors(art)
        dot = F.aggregate(F.zip_with("p", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        ours = users.withColumnRenamed("features", "p").limit(4).join(items.withColumnRenamed("features", "v")).select("user_id", "item_id", dot.alias("x"))
        ids = ours.join(art.tables["user_ids"], "user_id").join(art.tables["item_ids"], "item_id")
        ids = ids.withColumn("user_id_int", F.col("user_id_int").cast("int")).withColumn("item_id_int", F.col("item_id_int").cast("int"))
        worst = art.models["als"].transform(ids).agg(F.max(F.abs(F.col("prediction") - F.col("x"))), F.count("*")).first()
        assert worst[0] < 1e-4 and worst[1] > 0


def test_segments_returns_at_most_k_clusters(spark, data):
    art = SIGNALS["segments"].fit(Features.of(data, DAY), {"k": 4})
    assert 1 <= art.tables["user_clusters"].select("cluster").distinct().count() <= 4
    assert art.tables["user_clusters"].count() == 60


def test_broken_signal_is_skipped(spark, data, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    store.bootstrap(data, DAY)
    features = store.features(tuple(data.specs))
    heuristics = Heuristics("d", {**MIX, "rules": SignalConfig(0.0)}, top_k=3)
    fitted = fit_all(features, heuristics)
    assert list(fitted.skipped) == ["als_cf"] and "popularity" in fitted.artifacts
    users = spark.createDataFrame([("u1",)], "user_id string")
    rows = recommend(features, users, heuristics, fitted).orderBy("rank").collect()
    # Empty store: popularity, trends and segments score every item 0.5.
    assert [r["item_id"] for r in rows] == ["i0", "i1", "i10"]
    assert rows[0]["breakdown"] == pytest.approx({"popularity": 0.05, "trends": 0.05, "segments": 0.05})


def test_own_signal(spark, data):
    def fit(features, params):
        return Artifacts({"quality": features.items.select("item_id", F.col("quality_score").alias("raw_score"))})

    def score(art, users, candidates, method):
        return item_scores("quality", art.tables["quality"], candidates, method)

    mine = {**SIGNALS, "quality": Signal("quality", fit, score)}
    heuristics = Heuristics("d", {"quality": SignalConfig(1.0)}, top_k=1, filters=Filters(exclude_seen=False))
    users = spark.createDataFrame([("u1",)], "user_id string")
    row = recommend(Features.of(data, DAY), users, heuristics, signals=mine).first()
    assert row["final_score"] == 1.0


def test_saved_signals_score_the_same(spark, data, tmp_path):
    root = str(tmp_path / "models")
    assert artifacts.load(spark, root) == {}
    features = Features.of(data, DAY, keep=True)
    heuristics = Heuristics("synthetic", MIX, top_k=5)
    users = data.users.select("user_id")
    first = artifacts.fit_saved(features, heuristics, root)
    loaded = artifacts.fit_saved(features, heuristics, root)
    assert set(first.artifacts) == set(loaded.artifacts) == set(MIX)
    a = recommend(features, users, heuristics, first).drop("breakdown")
    b = recommend(features, users, heuristics, loaded).drop("breakdown")
    assert rows_of(a) == rows_of(b)
    log = spark.read.json(f"{root}/log")
    assert log.count() == 6
    artifacts.fit_saved(features, Heuristics("s", {"popularity": MIX["popularity"]}), root, force=True)
    assert spark.read.json(f"{root}/log").filter("signal = 'popularity'").count() == 2
    # A version without a log row does not exist.
    spark.range(1).write.parquet(f"{root}/model=trends/version=9/tables/recency")
    assert artifacts.load(spark, root, ["trends"])["trends"].tables["recency"].columns == ["item_id", "recency_score"]
