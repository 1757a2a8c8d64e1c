"""What lets large tables through: blocks, checkpoints, broadcasts and joins, with the same results."""

from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankweave.operators import baskets
from rankweave.plans import blocks, dense, signals
from rankweave.plans.pairs import score_pairs
from rankweave.plans.scores import DenseScores
from rankweave.plans.signals import SIGNALS, Features

DAY = datetime(2020, 1, 1)


def _features(spark, seed=1):
    rng = random.Random(seed)
    pairs = [(f"u{u}", f"i{i}", float(rng.randint(1, 5)), DAY) for u in range(40) for i in rng.sample(range(30), 8)]
    rows = spark.createDataFrame(pairs, "user_id string, item_id string, value double, ts timestamp")
    items = rows.select("item_id").distinct()
    return Features(rows, items, items, rows.select("user_id").distinct(), items, DAY)


def _factors(art):
    return {r[0]: r[1] for r in signals.als_factors(art)[1].collect()}


def test_factors_do_not_depend_on_the_partitions_of_a_shuffle(spark):
    features, before = _features(spark), spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for partitions in ("4", "25"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            found.append(_factors(SIGNALS["als_cf"].fit(features, {"rank": 3, "max_iter": 2})))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(found[0]) == set(found[1])
    for item, vector in found[0].items():
        assert found[1][item] == pytest.approx(vector, abs=1e-3)


def test_factors_let_go_of_shuffles_and_blocks_follow_the_ratings(spark, monkeypatch):
    asked = []

    def als(**settings):
        asked.append(settings)
        return ALS(**settings)

    ALS = signals.ALS
    monkeypatch.setattr(signals, "ALS", als)
    monkeypatch.setattr(signals, "ALS_BLOCK_RATINGS", 20)
    SIGNALS["als_cf"].fit(_features(spark), {"rank": 3, "max_iter": 2})
    assert asked[0]["checkpointInterval"] == 1 and asked[0]["numUserBlocks"] == asked[0]["numItemBlocks"] == 16


@pytest.mark.parametrize("most, join", [(baskets.BROADCAST_BYTES, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_pairs_are_shuffled_once_while_the_frequent_ones_are_small(spark, monkeypatch, most, join):
    owned = _features(spark).interactions.select("user_id", "item_id")
    plans, durable = [], baskets.durable

    def spied(df, name="table"):
        if name == "siblings":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df, name)

    monkeypatch.setattr(baskets, "durable", spied)
    monkeypatch.setattr(baskets, "BROADCAST_BYTES", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {tuple(r["items"]): r["freq"] for r in baskets.frequent_sets(owned, 4).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    own: dict[str, set] = {}
    for u, i in owned.collect():
        own.setdefault(u, set()).add(i)
    ids = sorted({i for x in own.values() for i in x})
    pairs = {(a, b): sum({a, b} <= x for x in own.values()) for a in ids for b in ids if a < b}
    assert {s: n for s, n in found.items() if len(s) == 2} == {s: n for s, n in pairs.items() if n >= 4}
    assert len(plans) > 1 and all(join in p for p in plans[1:])


@pytest.mark.parametrize("missing", ["zero", "drop"])
def test_pairs_are_not_shuffled_with_both_vectors(spark, missing):
    pairs = _features(spark).interactions.select("user_id", "item_id").distinct()
    kind = "string, features array<double>"
    users = spark.createDataFrame([(f"u{u}", [1.0, float(u)]) for u in range(30)], f"user_id {kind}")
    items = spark.createDataFrame([(f"i{i}", [float(i), 1.0]) for i in range(20)], f"item_id {kind}")
    pool = spark.createDataFrame([(f"i{i}",) for i in range(25)], "item_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = score_pairs(pairs, pool, [DenseScores("content", users, items, 2, missing)])["content"]
        lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
        got = {(u, i): x for u, i, x in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [below for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning" in line]
    assert moved and not any("_p#" in m and "_v#" in m for m in moved)
    last = 25 if missing == "zero" else 20
    wanted = {}
    for u, i in pairs.collect():
        a, b = int(u[1:]), int(i[1:])
        if a < 30 and b < last:
            # Items without a vector count 0 where they count.
            raw = [x + a for x in range(20)] + [0] * (last - 20)
            wanted[u, i] = (raw[b] - min(raw)) / (max(raw) - min(raw))
    assert got == pytest.approx(wanted, abs=1e-9)


def _units(rng, n):
    x = np.abs(rng.normal(size=(n, 4)))
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _count_bounds(monkeypatch):
    cells, upper = [], blocks.Hull.upper

    def counted(self, *given):
        found = upper(self, *given)
        cells.append(found.size)
        return found

    monkeypatch.setattr(blocks.Hull, "upper", counted)
    return cells


def test_leaves_have_bounds_only_where_their_node_may_win(monkeypatch):
    rng = np.random.default_rng(2)
    v, p = _units(rng, 40000), _units(rng, 300)
    # Zero vectors have no best leaf, all products are alike.
    p[::3] = 0.0
    products, plain = [], blocks._products
    monkeypatch.setattr(blocks, "_products", lambda a, b: products.append(len(a) * len(b)) or plain(a, b))
    cells = _count_bounds(monkeypatch)
    spread, leaves = blocks.Spread(len(p)), blocks.Leaves(v)
    v = v[leaves.order]
    spread.add_extremes(p, v, leaves, blocks.Hull(v, leaves))
    whole = p @ v.T
    assert np.abs(spread.lo - whole.min(axis=1)).max() < 1e-14 and np.abs(spread.hi - whole.max(axis=1)).max() < 1e-14
    assert sum(cells) < len(p) * len(leaves) and sum(products) < whole.size / 4


def _ranges(folder):
    found = []
    for number in range(100):
        where, path = blocks.fs.FileSystem.from_uri(f"{folder}/ib={number}")
        if where.get_file_info(path).type == blocks.fs.FileType.Directory:
            files = [x.path for x in where.get_file_info(blocks.fs.FileSelector(path)) if x.path.endswith(".parquet")]
            rows = pa.concat_tables([pq.ParquetFile(where.open_input_file(x)).read() for x in files])
            x = np.array([v[0] for v in rows["v_content"].to_pylist() if v is not None])
            found.append((x.min(), x.max(), len(rows)))
    return sorted(found)


def test_blocks_hold_neighbours_and_copies_are_cut(spark):
    items = spark.range(2000).select(
        F.col("id").cast("string").alias("item_id"),
        F.array(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0, F.lit(0.5)).alias("v_content"),
    )
    found = _ranges(dense._written(items, 4, {"v_content": (2, 1.0)}))
    assert sum(n for *_, n in found) == 2000 and len(found) == 4
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    alike = items.withColumn("v_content", F.array(F.lit(0.1), F.lit(0.2)))
    assert max(n for *_, n in _ranges(dense._written(alike, 4, {"v_content": (2, 1.0)}))) < 1000


def test_ranking_of_a_block_without_all_bounds(monkeypatch, tmp_path):
    """Popularity, groups and content in two blocks: the ranking of all pairs, with few bounds."""
    rng, k = np.random.default_rng(4), 5
    n, users, groups = 16384, 60, ["a", "b"]
    ids = np.array([f"i{j:05d}" for j in range(n)])
    v, p = _units(rng, n), _units(rng, users)
    common, listed = rng.random(n) * 0.02, rng.random((2, n)) * 0.02
    for block, at in enumerate((slice(0, n // 2), slice(n // 2, n))):
        (tmp_path / f"ib={block}").mkdir()
        rows = {"item_id": ids[at], "ok": np.ones(n // 2, bool), "c_popularity": common[at]}
        rows |= {"lg_segments": [groups] * (n // 2), "lc_segments": listed[:, at].T.tolist(), "v_content": v[at].tolist()}
        pq.write_table(pa.table(rows), tmp_path / f"ib={block}" / "part.parquet")
    mine, seen = rng.integers(0, 2, users), [rng.choice(n, 200, replace=False) for _ in range(users)]
    names = [f"u{u}" for u in range(users)]
    who = pa.table({"user_id": names, "f_segments": np.zeros(users), "g_segments": [groups[g] for g in mine], "p_content": p.tolist()})
    pairs = [(names[u], ids[i]) for u in range(users) for i in seen[u]]
    brought = pa.table(
        {"user_id": [u for u, _ in pairs], "item_id": [i for _, i in pairs], "which": np.full(len(pairs), -1, np.int32), "c": np.zeros(len(pairs))}
    )
    cells = _count_bounds(monkeypatch)
    monkeypatch.setattr(blocks, "LEAF", 16)
    scorer = blocks.BlockScorer([("content", 4, "zero", "minmax", 0.5)], ["popularity"], ["segments"], [], str(tmp_path), 2, k)
    rows = scorer.top(who, brought).to_pylist()
    for u in range(users):
        x = v @ p[u]
        total = common + listed[mine[u]] + 0.5 * (x - x.min()) / (x.max() - x.min())
        total[seen[u]] = -1.0
        got = [(r["c_popularity"] + r["c_content"] + r["c_segments"], r["item_id"]) for r in rows if r["user_id"] == names[u]]
        assert [i for _, i in sorted(got, reverse=True)[:k]] == list(ids[np.argsort(-total)[:k]])
    assert sum(cells) < users * n / 16
