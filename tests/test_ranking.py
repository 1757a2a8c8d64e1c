"""Rankings against a plain Python computation that scores every candidate for every user."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from rankweave.operators.filters import Filters
from rankweave.plans import blocks, dense
from rankweave.plans.combine import combine, combine_full_outer, combine_union, top_k_per_user, top_k_single
from rankweave.plans.pairs import glued_pairs, score_pairs
from rankweave.plans.scores import (
    GROUP_GRAIN,
    USER_GRAIN,
    DenseScores,
    item_scores,
    keyed_scores,
)

ITEMS = [f"i{n}" for n in range(40)]
USERS = [f"u{n}" for n in range(12)] + ["cold"]
K = 6


class World:
    """Random raw scores of five signals, as Python dictionaries and as score frames."""

    def __init__(self, spark, seed: int, method: str = "minmax") -> None:
        rng = random.Random(seed)
        self.spark, self.method = spark, method
        # Few distinct values: many ties.
        self.popular = {i: float(rng.randint(0, 4)) for i in ITEMS if rng.random() < 0.8}
        self.cluster = {u: f"c{rng.randint(0, 2)}" for u in USERS[:-1] if rng.random() < 0.9}
        # One cluster has no preferences at all.
        self.preferred = {
            (c, i): float(rng.randint(-1, 3)) for c in ("c0", "c1") for i in ITEMS if rng.random() < 0.6
        }
        self.history = [u for u in USERS[:-1] if rng.random() < 0.8]
        self.ruled = {(u, i): rng.choice([0.2, 0.5]) for u in self.history[1:] for i in ITEMS if rng.random() < 0.2}
        self.taste = {u: [rng.random() for _ in range(3)] for u in USERS[:-1] if rng.random() < 0.8}
        self.content = {i: [rng.random() for _ in range(3)] for i in ITEMS if rng.random() < 0.9}
        self.factors = {u: [rng.gauss(0, 1) for _ in range(2)] for u in USERS[:-2]}
        self.known = {i: [rng.gauss(0, 1) for _ in range(2)] for i in ITEMS if rng.random() < 0.8}
        # One user has seen everything, one all but three items.
        self.seen = {(u, i) for u in USERS[:-1] for i in ITEMS if rng.random() < 0.3}
        self.seen |= {("u0", i) for i in ITEMS} | {("u1", i) for i in ITEMS[3:]}

    def frame(self, rows, schema):
        return self.spark.createDataFrame(list(rows), schema)

    def candidates(self):
        return self.frame([(i,) for i in ITEMS], "item_id string")

    def users(self):
        return self.frame([(u,) for u in USERS], "user_id string")

    def seen_frame(self):
        return self.frame(self.seen, "user_id string, item_id string")

    def scores(self, *names):
        cand, m = self.candidates(), self.method
        out = []
        for name in names:
            if name == "popularity":
                raw = self.frame(self.popular.items(), "item_id string, raw_score double")
                out.append(item_scores(name, raw, cand, m))
            elif name == "segments":
                members = self.frame(self.cluster.items(), "user_id string, grp string")
                raw = self.frame([(c, i, x) for (c, i), x in self.preferred.items()], "grp string, item_id string, raw_score double")
                keys = members.select("grp").distinct()
                out.append(keyed_scores(name, GROUP_GRAIN, raw, keys, cand, members=members, method=m))
            elif name == "rules":
                raw = self.frame([(u, i, x) for (u, i), x in self.ruled.items()], "user_id string, item_id string, raw_score double")
                keys = self.frame([(u,) for u in self.history], "user_id string")
                out.append(keyed_scores(name, USER_GRAIN, raw, keys, cand, method=m))
            elif name == "content":
                out.append(
                    DenseScores(
                        name,
                        self.frame(self.taste.items(), "user_id string, features array<double>"),
                        self.frame(self.content.items(), "item_id string, features array<double>"),
                        3, "zero", m,
                    )
                )
            elif name == "als_cf":
                out.append(
                    DenseScores(
                        name,
                        self.frame(self.factors.items(), "user_id string, features array<double>"),
                        self.frame(self.known.items(), "item_id string, features array<double>"),
                        2, "drop", m,
                    )
                )
        return out

    def raw(self, name, user):
        """Raw score per item, or None when the signal cannot score the user."""
        if name == "popularity":
            return {i: self.popular.get(i, 0.0) for i in ITEMS}
        if name == "segments":
            c = self.cluster.get(user)
            return None if c is None else {i: self.preferred.get((c, i), 0.0) for i in ITEMS}
        if name == "rules":
            return {i: self.ruled.get((user, i), 0.0) for i in ITEMS} if user in self.history else None
        p, v = (self.taste, self.content) if name == "content" else (self.factors, self.known)
        if user not in p:
            return None
        dot = {i: sum(a * b for a, b in zip(p[user], v[i])) for i in v}
        return {i: dot.get(i, 0.0) for i in ITEMS} if name == "content" else dot

    def scaled(self, name, user):
        raw = self.raw(name, user)
        if not raw:
            return None
        xs = list(raw.values())
        if self.method == "minmax":
            lo, hi = min(xs), max(xs)
            return {i: 0.5 if lo == hi else (x - lo) / (hi - lo) for i, x in raw.items()}
        mean = sum(xs) / len(xs)
        sd = math.sqrt(sum((x - mean) ** 2 for x in xs) / len(xs))
        return {i: 0.0 if sd < 1e-12 else (x - mean) / sd for i, x in raw.items()}

    def expected(self, weights, filters=Filters()):
        out = []
        for u in USERS:
            parts = {n: self.scaled(n, u) for n, w in weights.items() if w > 0}
            parts = {n: p for n, p in parts.items() if p is not None}
            final = {}
            for i in ITEMS:
                if not any(i in p for p in parts.values()):
                    continue
                final[i] = round(sum(round(weights[n] * p.get(i, 0.0), 14) for n, p in parts.items()), 14)
            if filters.exclude_seen:
                final = {i: s for i, s in final.items() if (u, i) not in self.seen}
            final = {i: s for i, s in final.items() if i not in filters.exclude_items}
            best = sorted(final, key=lambda i: (-final[i], i))[:K]
            for n, i in enumerate(best, 1):
                shown = {s: round(weights[s] * p.get(i, 0.0), 14) for s, p in parts.items()}
                out.append((u, n, i, final[i], shown))
        return out

    def check(self, weights, filters=Filters()):
        found = combine(
            self.users(), self.candidates(), self.scores(*weights), weights, filters, K, self.seen_frame()
        )
        rows = sorted(found.collect(), key=lambda r: (USERS.index(r["user_id"]), r["rank"]))
        expected = self.expected(weights, filters)
        assert [(r["user_id"], r["rank"], r["item_id"]) for r in rows] == [e[:3] for e in expected]
        for r, e in zip(rows, expected):
            assert r["final_score"] == pytest.approx(e[3], abs=2e-9)
            assert r["breakdown"] == pytest.approx(e[4], abs=2e-9)


MIXES = [
    {"popularity": 1.0},
    {"segments": 1.0},
    {"rules": 1.0},
    {"popularity": 0.3, "segments": 0.7},
    {"popularity": 0.2, "segments": 0.3, "rules": 0.5},
    {"content": 1.0},
    {"als_cf": 1.0},
    {"popularity": 0.1, "als_cf": 0.5, "content": 0.2, "segments": 0.1, "rules": 0.3},
]


@pytest.mark.parametrize("mix", MIXES, ids=lambda m: "+".join(m))
def test_combine_equals_brute_force(spark, mix):
    World(spark, 1).check(mix)


@pytest.mark.parametrize("seed", [2, 3])
def test_sparse_and_dense_with_filters(spark, seed):
    chosen = Filters(exclude_seen=False, exclude_items=ITEMS[5:25])
    World(spark, seed).check({"popularity": 0.2, "segments": 0.3, "rules": 0.5}, chosen)
    World(spark, seed).check({"popularity": 0.2, "rules": 0.4, "content": 0.5}, chosen)


def test_several_item_blocks(spark, monkeypatch):
    """Seven items to a block: extremes are merged over blocks before anything is scaled."""
    monkeypatch.setattr(dense, "ITEM_BLOCK", 7)
    monkeypatch.setattr(dense, "MIN_USER_BLOCK", 4)
    World(spark, 4).check(MIXES[-1])


def test_zscore(spark):
    world = World(spark, 5, "zscore")
    world.check({"popularity": 0.5, "segments": 0.5})
    world.check({"popularity": 0.5, "content": 0.5, "als_cf": 0.2})


def test_salted_list_heads(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        World(spark, 6).check(MIXES[4])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_required_features(spark):
    world = World(spark, 7)
    items = world.candidates().withColumn("even", F.substring("item_id", 2, 2).cast("int") % 2 == 0)
    found = combine(
        world.users(), world.candidates(), world.scores("popularity"), {"popularity": 1.0},
        Filters(require_features={"even": True}), K, world.seen_frame(), items,
    )
    odd = [i for i in ITEMS if int(i[1:]) % 2]
    expected = world.expected({"popularity": 1.0}, Filters(exclude_items=odd))
    assert sorted((r["user_id"], r["rank"], r["item_id"]) for r in found.collect()) == sorted(e[:3] for e in expected)


def test_combine_edges(spark):
    world = World(spark, 8)
    with pytest.raises(ValueError):
        combine(world.users(), world.candidates(), [], {})
    none = combine(world.users(), world.candidates(), world.scores("popularity"), {"popularity": 0.0})
    assert none.count() == 0 and "breakdown" in none.columns


def test_single_candidate_and_empty_table_score_half(spark):
    one = spark.createDataFrame([("i1",)], "item_id string")
    raw = spark.createDataFrame([], "item_id string, raw_score double")
    assert [tuple(r) for r in item_scores("popularity", raw, one).listed.collect()] == [("i1", 0.5)]


def test_pairs_equal_brute_force(spark):
    world = World(spark, 9)
    names = ["popularity", "segments", "rules", "content", "als_cf"]
    pairs = spark.createDataFrame(
        [(u, i) for u in USERS for i in ITEMS[::3]] + [("u1", "no candidate")], "user_id string, item_id string"
    )
    found = score_pairs(pairs, world.candidates(), world.scores(*names))
    for n in names:
        got = {(r[0], r[1]): r[2] for r in found[n].collect()}
        expected = {}
        for u in USERS:
            scaled = world.scaled(n, u) or {}
            expected.update({(u, i): scaled[i] for i in ITEMS[::3] if i in scaled})
        assert got == pytest.approx(expected, abs=1e-9), n


def test_full_outer_and_union_agree(spark):
    a = spark.createDataFrame([("u", "x", 1.0), ("u", "y", 0.5)], "user_id string, item_id string, score double")
    b = spark.createDataFrame([("u", "y", 1.0), ("v", "z", 0.2)], "user_id string, item_id string, score double")
    weights = {"a": 0.5, "b": 0.25, "off": 0.0}
    frames = {"a": a, "b": b, "off": a}
    left = sorted(map(tuple, combine_full_outer(frames, weights).collect()))
    assert left == sorted(map(tuple, combine_union(frames, weights).collect()))
    assert left == [("u", "x", 0.5, 0.0, 0.5), ("u", "y", 0.25, 0.25, 0.5), ("v", "z", 0.0, 0.05, 0.05)]


@pytest.mark.parametrize("glue", [combine_full_outer, combine_union])
@pytest.mark.parametrize("names", [["popularity"], ["popularity", "segments"], ["segments"], ["segments", "rules"]])
def test_pairs_are_glued_once_per_profile(spark, glue, names):
    """The table of the glued pairs themselves, users without a group and items that are no candidates included."""
    world = World(spark, 14)
    rows = [(u, i) for u in USERS for i in ITEMS[::3]] + [("u1", "no candidate"), ("nobody", "i3")]
    pairs = spark.createDataFrame(rows, "user_id string, item_id string")
    weights = {n: 0.3 + 0.1 * j for j, n in enumerate(names)} | {"off": 0.0}
    scores, sizes = world.scores(*names), []

    def counted(frames, weights, keys):
        sizes.extend(df.count() for df in frames.values())
        return glue(frames, weights, keys)

    found = glued_pairs(pairs, world.candidates(), scores, weights, counted)
    plain = glue(score_pairs(pairs, world.candidates(), scores), weights)
    assert found.columns == plain.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) != []
    # At most four profiles: three clusters and none.
    assert "rules" in names or max(sizes) <= 4 * len(ITEMS[::3])


@pytest.mark.parametrize("glue", [combine_full_outer, combine_union])
@pytest.mark.parametrize("nobody", [["nobody"], []])
def test_item_signals_are_glued_once_per_item(spark, glue, nobody):
    """Many users of few profiles: all items are scored for all profiles, by what scores items alone just once."""
    world = World(spark, 15)
    world.cluster = {f"{u}{n}": c for u, c in world.cluster.items() for n in range(20)}
    pairs = spark.createDataFrame(
        [(u, i) for u in [*world.cluster, *nobody] for i in [*ITEMS[::2], "no candidate"]], "user_id string, item_id string"
    )
    weights, scores, sizes = {"segments": 0.6, "popularity": 0.4}, world.scores("segments", "popularity"), {}

    def counted(frames, weights, keys):
        sizes.update({n: df.count() for n, df in frames.items()})
        return glue(frames, weights, keys)

    found = glued_pairs(pairs, world.candidates(), scores, weights, counted)
    plain = glue(score_pairs(pairs, world.candidates(), scores), weights)
    assert found.columns == plain.columns
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, plain.collect()))
    assert len(rows) == (len(world.cluster) + len(nobody)) * len(ITEMS[::2])
    assert sizes == {"popularity": len(ITEMS), "segments": 3 * len(ITEMS)}


def test_ties_at_the_last_place(spark):
    rows = [("u", i, 1.0) for i in ("d", "b", "c", "a")] + [("u", "z", 2.0)]
    df = spark.createDataFrame(rows, "user_id string, item_id string, final_score double")
    got = [(r["rank"], r["item_id"]) for r in top_k_per_user(df, 3).orderBy("rank").collect()]
    assert got == [(1, "z"), (2, "a"), (3, "b")]
    assert [r["item_id"] for r in top_k_single(df, 3).collect()] == ["z", "a", "b"]


def test_best_keeps_lowest_columns_among_equals():
    import numpy as np

    scores = np.array([[1.0, 2.0, 2.0, 0.5, 2.0], [-np.inf, 3.0, -np.inf, -np.inf, -np.inf], [1, 1, 1, 1, 1]])
    rows, columns = blocks._best(scores, 2)
    assert list(zip(rows, columns)) == [(0, 1), (0, 2), (1, 1), (2, 0), (2, 1)]


def test_fixed_rounds_half_away_from_zero():
    import numpy as np

    x = np.array([2 / 3, -2 / 3, 0.5, 0.0])
    assert list(blocks._fixed(x)) == [0.66666666666667, -0.66666666666667, 0.5, 0.0]


def test_far_apart_counts_keep_their_order(spark):
    candidates = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    raw = spark.createDataFrame([("a", 1.0), ("b", 100.0), ("c", 5e11)], "item_id string, raw_score double")
    users = spark.createDataFrame([("u",)], "user_id string")
    found = combine(users, candidates, [item_scores("popularity", raw, candidates)], {"popularity": 0.1}, top_k=3)
    assert [r["item_id"] for r in found.orderBy("rank").collect()] == ["c", "b", "a"]


@pytest.mark.parametrize("mix", MIXES[:5], ids=lambda m: "+".join(m))
def test_users_who_have_passed_the_head_of_their_list(spark, monkeypatch, mix):
    """The first 24 of 40 places are looked at first; some users have passed all of them, one has passed everything."""
    monkeypatch.setattr("rankweave.plans.combine.NEAR", 1)
    monkeypatch.setattr("rankweave.plans.combine.BROADCAST_ROWS", 30)
    World(spark, 11).check(mix)


def test_rows_of_a_common_list_come_in_order(spark):
    """No pairs are joined with what a user has seen, and nothing is sorted per user."""
    world = World(spark, 13)
    for mix in MIXES[0], MIXES[3]:
        found = combine(world.users(), world.candidates(), world.scores(*mix), mix, Filters(), K, world.seen_frame())
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan and "Window" not in plan


@pytest.mark.parametrize("block", [7, 100])
@pytest.mark.parametrize("method, flat", [("zscore", 0.0), ("minmax", 0.5)])
def test_flat_dense_scores(spark, monkeypatch, block, method, flat):
    monkeypatch.setattr(dense, "ITEM_BLOCK", block)
    world = World(spark, 1, method)
    items = spark.createDataFrame([(i, [0.1, 0.7]) for i in ITEMS], "item_id string, features array<double>")
    tastes = spark.createDataFrame([(u, [0.3, 1 / 3]) for u in USERS], "user_id string, features array<double>")
    scores = [DenseScores("content", tastes, items, 2, "zero", method)]
    found = combine(world.users(), world.candidates(), scores, {"content": 1.0}, top_k=2)
    assert {r["final_score"] for r in found.collect()} == {flat}


@pytest.mark.parametrize("block", [13, 100])
def test_leaves_that_cannot_win_are_left_out(spark, monkeypatch, block):
    """Three items to a leaf: bounds decide what is looked at, the ranking stays that of all pairs."""
    monkeypatch.setattr(blocks, "LEAF", 3)
    monkeypatch.setattr(blocks, "ROUNDS", 1)
    monkeypatch.setattr(dense, "ITEM_BLOCK", block)
    World(spark, 10).check(MIXES[-1])


def test_extremes_without_all_products(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v, p = (np.abs(rng.normal(size=(n, 4))) for n in (20000, 200))
    v, p = (x / np.sqrt((x * x).sum(axis=1))[:, None] for x in (v, p))
    cells, plain = [], blocks._products
    monkeypatch.setattr(blocks, "_products", lambda a, b: cells.append(len(a) * len(b)) or plain(a, b))
    spread, leaves = blocks.Spread(len(p)), blocks.Leaves(v)
    spread.add_moments(p, v)
    spread.add_extremes(p, v[leaves.order], leaves, blocks.Hull(v[leaves.order], leaves))
    whole = p @ v.T
    lo, hi, mean, sd = spread.stats(slice(None))
    for found, wanted in ((lo, whole.min(axis=1)), (hi, whole.max(axis=1)), (mean, whole.mean(axis=1)), (sd, whole.std(axis=1))):
        assert np.abs(found - wanted).max() < 1e-14
    assert sum(cells) < whole.size / 4
