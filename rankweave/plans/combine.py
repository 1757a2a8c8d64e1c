"""Weighted combination of signal scores into a top-k ranking per user.

``final_score = sum(weight * score)`` over the signals that can score the user.  Weights are not
renormalised when a signal is cold.  Seen and excluded items leave after scaling and summing.

``combine`` never writes users x items rows.  Items that no user-level score touches come in the same
order for everybody in a group, so a user's best ``k`` of them are among the first places of that group's
list, as many as hold ``k`` items that are neither seen nor individually scored.  The first ``NEAR`` places
of a list are few, so a user's passed places among them come from one pass over the seen pairs, and the user's
first ``k`` other places follow without comparing anything else.  Users who have passed nearly all of those
places read further down the list, as far as they need; the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.functions.scaling import fixed, total
from rankweave.operators.filters import Filters, exclude_items, exclude_seen, require_features
from rankweave.operators.numbering import durable, number_rows
from rankweave.plans.dense import dense_candidates
from rankweave.plans.scores import (
    GROUP,
    GROUP_GRAIN,
    ITEM_GRAIN,
    USER_GRAIN,
    DenseScores,
    Scores,
)
from rankweave.schema import BREAKDOWN, FINAL_SCORE, ITEM_ID, SCORE, USER_ID

# List places below HEAD are wanted by nearly every user; their rows are spread over several salts.
HEAD = 4096
MAX_SALTS = 64
# Places are unfolded in chunks, so that no array grows with a user's history.
CHUNK = 4096
# First places of a list that nearly every user can do with.
NEAR = 1024
# Lists are cut to their first places in so many parts before one task sees a list.
HEAD_SALTS = 64
# Heads of lists up to this many rows go to every task.
BROADCAST_ROWS = 1 << 17
# Sums of contributions differ by less than this from what rounding makes of them.
ROOM = 1e-9


def contribution(signal: str) -> str:
    return f"c_{signal}"


def top_k_per_user(df: DataFrame, k: int, score: str = FINAL_SCORE) -> DataFrame:
    """Best ``k`` rows per user with ``rank`` 1..k; ties go to the smaller item id."""
    window = W.partitionBy(USER_ID).orderBy(F.desc(score), F.asc(ITEM_ID))
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def top_k_single(df: DataFrame, k: int, score: str = FINAL_SCORE) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(ITEM_ID)).limit(k)


def breakdown_map(signals: Sequence[str]) -> Column:
    """Contribution per signal; signals that are cold for the row's user are left out."""
    entries = F.array(
        *[F.struct(F.lit(s).alias("signal"), F.col(contribution(s)).alias("part")) for s in signals]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e.getField("part").isNotNull()))


def item_base(pool: DataFrame, scores: Sequence[Scores], weights: Mapping[str, float]) -> DataFrame:
    """``pool`` with the contribution of every item-grain signal."""
    for s in scores:
        part = s.listed.select(
            ITEM_ID, fixed(F.col(SCORE) * F.lit(float(weights[s.signal]))).alias(contribution(s.signal))
        )
        pool = pool.join(part, ITEM_ID, "left").fillna(0.0, [contribution(s.signal)])
    return pool


def floors(s: Scores, key: str, weight: float) -> DataFrame:
    """Contribution of unlisted items per user or group; a row means the signal is not cold."""
    value = F.coalesce(fixed(F.col("floor") * F.lit(float(weight))), F.lit(0.0))
    return s.floor.select(key, value.alias(f"f_{s.signal}"))


def listed_contributions(
    scores: Sequence[Scores], key: str, weights: Mapping[str, float]
) -> DataFrame | None:
    """``(key, item_id, c_<signal>...)`` of several user-grain signals in one row per pair."""
    parts = [
        s.listed.select(
            key,
            ITEM_ID,
            *[
                (
                    fixed(F.col(SCORE) * F.lit(float(weights[s.signal])))
                    if o is s
                    else F.lit(None).cast("double")
                ).alias(contribution(o.signal))
                for o in scores
            ],
        )
        for s in scores
    ]
    if len(parts) <= 1:
        return parts[0] if parts else None
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy(key, ITEM_ID)
        .agg(*[F.max(contribution(s.signal)).alias(contribution(s.signal)) for s in scores])
    )


def needed_places(who: DataFrame, ordered: DataFrame, skip: DataFrame | None, k: int) -> DataFrame:
    """``who`` with ``limit``, a number of first places of the common list that hold ``k`` items the user may
    get, and ``most``, which does for any list of the same items.

    Passed items are counted per user in doubling ranges of places.  The first power of two that leaves
    ``k`` others is enough: it grows with what a user has passed near the top, not with the whole history.
    """
    if skip is None:
        return who.withColumn("limit", F.lit(k).cast("long")).withColumn("most", F.col("limit"))
    size = ordered.agg(F.count(F.lit(1))).scalar()
    at = skip.join(ordered.select(ITEM_ID, "pos"), ITEM_ID)
    level = F.ceil(F.log2(F.col("pos") + 1)).cast("int")
    counts = at.groupBy(USER_ID, level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    # At most 63 levels per user.
    passed = counts.groupBy(USER_ID).agg(
        F.collect_list(F.struct("level", "n")).alias("_levels"), F.sum("n").alias("_passed")
    )

    def free(j: Column) -> Column:
        below = F.filter("_levels", lambda x: x["level"] <= j)
        return F.pow(F.lit(2.0), j) - F.aggregate(below, F.lit(0).cast("long"), lambda s, x: s + x["n"])

    most = F.lit(k).cast("long") + F.coalesce(F.col("_passed"), F.lit(0))
    start = F.lit(max(0, (k - 1).bit_length()))
    levels = F.sequence(start, F.ceil(F.log2(F.col("most"))).cast("int") + 1)
    enough = F.pow(F.lit(2.0), F.filter(levels, lambda j: free(j) >= k)[0]).cast("long")
    limit = F.when(F.col("_levels").isNull(), F.col("most")).otherwise(F.least(enough, "most"))
    return (
        who.join(passed, USER_ID, "left")
        .withColumn("most", F.least(most, size))
        .withColumn("limit", F.least(limit, size))
        .drop("_levels", "_passed")
    )


def places(df: DataFrame, limit: str) -> DataFrame:
    """One row per place 0 .. ``limit`` - 1, column ``pos``."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(limit) - 1) / CHUNK)))
    last = F.least(F.col(limit), (F.col("_chunk") + 1) * CHUNK) - 1
    return (
        df.withColumn("_chunk", chunk)
        .withColumn("pos", F.explode(F.sequence(F.col("_chunk") * CHUNK, last)))
        .drop("_chunk")
    )


def read_places(wanted: DataFrame, lists: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Equi-join wanted places with list rows on ``keys + pos``, heads of lists salted by ``by``."""
    partitions = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = min(MAX_SALTS, max(1, partitions // 8))
    head = F.col("pos") < HEAD
    if salts > 1:
        wanted = wanted.withColumn(
            "_salt", F.when(head, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0))
        )
        one, last = F.lit(0).cast("long"), F.lit(salts - 1).cast("long")
        copies = F.when(head, F.sequence(one, last)).otherwise(F.array(one))
        lists = lists.withColumn("_salt", F.explode(copies))
        return wanted.join(lists, [*keys, "pos", "_salt"]).drop("_salt", "pos")
    return wanted.join(lists, [*keys, "pos"]).drop("pos")


def _with_floors(combos: DataFrame, group_scores: Sequence[Scores], weights: Mapping[str, float]) -> DataFrame:
    for s in group_scores:
        combos = combos.join(
            floors(s, GROUP, weights[s.signal]).withColumnRenamed(GROUP, f"g_{s.signal}"),
            f"g_{s.signal}",
            "left",
        )
    return combos


def _group_listed(
    combos: DataFrame, base: DataFrame, group_scores: Sequence[Scores], weights: Mapping[str, float]
) -> DataFrame:
    """``(lst, item_id, c_<signal>...)`` of the items that some group of a combination lists."""
    names = [s.signal for s in group_scores]
    parts = []
    for s in group_scores:
        value = fixed(F.col(SCORE) * F.lit(float(weights[s.signal])))
        mine = s.listed.select(F.col(GROUP).alias(f"g_{s.signal}"), ITEM_ID, value.alias("_c"))
        columns = [
            (F.col("_c") if n == s.signal else F.lit(None).cast("double")).alias(contribution(n))
            for n in names
        ]
        parts.append(
            combos.select("lst", f"g_{s.signal}").join(mine, f"g_{s.signal}").select("lst", ITEM_ID, *columns)
        )
    listed = parts[0]
    if len(parts) > 1:
        listed = (
            reduce(DataFrame.unionByName, parts)
            .groupBy("lst", ITEM_ID)
            .agg(*[F.max(contribution(n)).alias(contribution(n)) for n in names])
        )
    return listed.join(base.select(ITEM_ID), ITEM_ID, "left_semi")


def _filled(rows: DataFrame, combos: DataFrame, names: Sequence[str]) -> DataFrame:
    """``rows`` of lists with the floors of the signals that do not list the item."""
    filled = rows.join(combos.select("lst", *[f"f_{n}" for n in names]), "lst")
    for n in names:
        filled = filled.withColumn(contribution(n), F.coalesce(F.col(contribution(n)), F.col(f"f_{n}")))
    return filled.drop(*[f"f_{n}" for n in names])


def _unlisted(wanted: DataFrame, ordered: DataFrame, listed: DataFrame, names: Sequence[str]) -> DataFrame:
    """Items among the first ``_limit`` places of the common order that a list does not list."""
    wanted = places(wanted.filter(F.col("_limit") > 0), "_limit").select("lst", "pos")
    rest = read_places(wanted, ordered, [], "lst").join(
        listed.select("lst", ITEM_ID), ["lst", ITEM_ID], "left_anti"
    )
    for n in names:
        rest = rest.withColumn(contribution(n), F.lit(None).cast("double"))
    return rest


def _first(rows: DataFrame, order: Sequence[Column], near: int) -> DataFrame:
    """The first ``near`` rows of every list and their place ``pos``; a task sees parts of bounded size."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(ITEM_ID), F.lit(HEAD_SALTS)))
    part = F.row_number().over(W.partitionBy("lst", "_salt").orderBy(*order))
    few = salted.withColumn("_place", part).filter(F.col("_place") <= near).drop("_place", "_salt")
    place = F.row_number().over(W.partitionBy("lst").orderBy(*order))
    return few.withColumn("_place", place).filter(F.col("_place") <= near).select(
        *rows.columns, (F.col("_place") - 1).cast("long").alias("pos")
    )


def _group_heads(
    combos: DataFrame,
    base: DataFrame,
    ordered: DataFrame,
    listed: DataFrame,
    names: Sequence[str],
    columns: Sequence[str],
    near: int,
    scored_only: bool,
) -> DataFrame:
    """First ``near`` places of every combination's list, with ``_total`` over ``columns``.

    Unlisted items are looked at as far down the common order as they can beat the last of ``near`` listed ones.
    With ``scored_only`` items that nothing scores are no part of the list; of the unlisted ones it is all or none.
    """
    order = [F.desc("_total"), F.asc(ITEM_ID)]
    sums = total([F.col(c) for c in columns])
    kept = F.coalesce(*[F.col(c) for c in columns]).isNotNull() if scored_only else F.lit(True)
    # Read for the bound and for the lists.
    own = _filled(listed.join(base, ITEM_ID), combos, names).filter(kept).withColumn("_total", sums)
    top = durable(_first(own, order, near), "top")
    last = top.groupBy("lst").agg(F.count(F.lit(1)).alias("_n"), F.min("_total").alias("_last"))
    taken = listed.groupBy("lst").agg(F.count(F.lit(1)).alias("_taken"))
    # Totals at the places 0, 1, 3, 7, ...: at most 63.
    powers = F.array(*[F.lit((1 << j) - 1).cast("long") for j in range(63)])
    marks = (
        ordered.filter(F.array_contains(powers, F.col("pos")))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "_total"))).alias("marks"))
        .scalar()
    )
    floor = reduce(lambda x, y: x + y, [F.coalesce(F.col(f"f_{n}"), F.lit(0.0)) for n in names])
    below = F.filter("_marks", lambda m: m["_total"] + F.col("_floor") < F.col("_last") - F.lit(ROOM))
    most = F.lit(near).cast("long") + F.coalesce(F.col("_taken"), F.lit(0))
    bound = F.when((F.col("_n") == near) & (F.size(below) > 0), F.least(most, below[0]["pos"])).otherwise(most)
    wanted = (
        combos.join(last, "lst", "left")
        .join(taken, "lst", "left")
        .withColumn("_marks", marks)
        .withColumn("_floor", floor)
        .select("lst", bound.alias("_limit"))
    )
    rest = _filled(_unlisted(wanted, ordered.drop("_total"), listed, names), combos, names).filter(kept)
    return _first(top.drop("pos").unionByName(rest.withColumn("_total", sums)), order, near)


def _group_lists(
    combos: DataFrame, base: DataFrame, ordered: DataFrame, listed: DataFrame, names: Sequence[str]
) -> DataFrame:
    """The ordered list of every combination of groups, down to its ``depth`` of unlisted items.

    Unlisted items follow in the common order ``ordered``.
    """
    taken = listed.groupBy("lst").agg(F.count(F.lit(1)).alias("_taken"))
    wanted = combos.join(taken, "lst", "left").select(
        "lst", (F.col("depth") + F.coalesce(F.col("_taken"), F.lit(0))).alias("_limit")
    )
    rest = _unlisted(wanted, ordered, listed, names)
    return _filled(listed.join(base, ITEM_ID).unionByName(rest), combos, names)


def _near(
    who: DataFrame,
    heads: DataFrame,
    skip: DataFrame | None,
    k: int,
    near: int,
    small: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``who`` with ``_picks``, the first ``k`` places of the user's list that are not passed, and ``_deep`` where
    the first ``near`` places do not hold them."""
    sizes = heads.groupBy("lst").agg(F.count(F.lit(1)).alias("_size"))
    out = who.join(small(sizes), "lst", "left").withColumn("_size", F.coalesce(F.col("_size"), F.lit(0)))
    if skip is None:
        out = out.withColumn("_passed", F.lit(None).cast("array<bigint>"))
    else:
        # Few of the passed pairs are left after the first join.
        close = skip.join(small(heads.select(ITEM_ID).distinct()), ITEM_ID, "left_semi")
        at = close.join(who.select(USER_ID, "lst"), USER_ID).join(
            small(heads.select("lst", ITEM_ID, "pos")), ["lst", ITEM_ID]
        )
        # At most ``near`` places per user, whatever the history.
        out = out.join(at.groupBy(USER_ID).agg(F.collect_set("pos").alias("_passed")), USER_ID, "left")
    none = F.array().cast("array<bigint>")
    passed = F.coalesce(F.col("_passed"), none)
    end = F.least(F.size(passed) + F.lit(k), F.col("_size"))
    first = F.when(end > 0, F.sequence(F.lit(0).cast("long"), (end - 1).cast("long"))).otherwise(none)
    # A list that does not fill its head ends there.
    deep = (F.col("_size") >= near) & (F.col("_size") - F.size(passed) < k)
    return out.withColumn("_deep", deep).withColumn(
        "_picks", F.when(deep, none).otherwise(F.slice(F.array_except(first, passed), 1, k))
    ).drop("_passed", "_size")


def _deep(
    who: DataFrame,
    base: DataFrame,
    ordered: DataFrame,
    group_s: Sequence[Scores],
    listed: DataFrame | None,
    weights: Mapping[str, float],
    shared: Sequence[str],
    skip: DataFrame,
    k: int,
) -> DataFrame:
    """Places of a list for users who have passed nearly all of its head, as many as each of them needs."""
    groups = [f"g_{s.signal}" for s in group_s]
    skip = durable(skip.join(who.select(USER_ID), USER_ID, "left_semi").distinct(), "passed")
    limits = needed_places(who, ordered, skip, k)
    if group_s:
        # Read twice.
        limits = durable(limits, "limits")
        combos = _with_floors(limits.groupBy("lst", *groups).agg(F.max("limit").alias("depth")), group_s, weights)
        listed = listed.join(combos.select("lst"), "lst", "left_semi")
        whole = _group_lists(combos, base, ordered, listed, [s.signal for s in group_s])
        # Listed items may stand before the common ones.
        taken = listed.groupBy("lst").agg(F.count(F.lit(1)).alias("_taken"))
        deep = F.col("limit") + F.coalesce(F.col("_taken"), F.lit(0))
        limits = limits.join(taken, "lst", "left").withColumn("limit", F.least(deep, "most"))
        order = [F.desc("_total"), F.asc(ITEM_ID)]
        lists = number_rows(
            whole.withColumn("_total", total([F.col(c) for c in shared])), order, ["lst"]
        ).select("lst", "pos", ITEM_ID, *shared)
    else:
        lists = ordered.select(F.lit("all").alias("lst"), "pos", ITEM_ID, *shared)
    wanted = places(limits.filter(F.col("limit") > 0), "limit").select(USER_ID, "lst", "pos")
    walked = read_places(wanted, lists, ["lst"], USER_ID).select(USER_ID, ITEM_ID, *shared)
    return walked.join(skip, [USER_ID, ITEM_ID], "left_anti")


def _sparse(
    users: DataFrame,
    pool: DataFrame,
    scores: Sequence[Scores],
    weights: Mapping[str, float],
    seen: DataFrame | None,
    k: int,
) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of every user's top k with contribution columns: those that have ``rank`` and the total already, and
    candidates that still have to be ranked, of other users."""
    item_s = [s for s in scores if s.grain == ITEM_GRAIN]
    group_s = [s for s in scores if s.grain == GROUP_GRAIN]
    user_s = [s for s in scores if s.grain == USER_GRAIN]
    shared = [contribution(s.signal) for s in item_s + group_s]
    near = max(NEAR, 4 * k)

    base = item_base(pool, item_s, weights)
    who = users.select(USER_ID).distinct()
    for s in group_s:
        members = s.members.select(USER_ID, F.col(GROUP).alias(f"g_{s.signal}"))
        who = who.join(members, USER_ID, "left")
    groups = [f"g_{s.signal}" for s in group_s]
    # Cold users share the list without any group score.
    key = F.to_json(F.struct(*groups)) if groups else F.lit("all")
    who = who.withColumn("lst", key)

    own = listed_contributions(user_s, USER_ID, weights)
    if own is not None:
        own = own.join(who.select(USER_ID), USER_ID, "left_semi").join(
            pool.select(ITEM_ID), ITEM_ID, "left_semi"
        )
        # Read three times below.
        own = durable(own, "own")
    order = [F.desc("_total"), F.asc(ITEM_ID)]
    ordered = number_rows(
        base.withColumn("_total", total([F.col(contribution(s.signal)) for s in item_s])), order
    )
    passed = [d.select(USER_ID, ITEM_ID) for d in (seen, own) if d is not None]
    skip = reduce(DataFrame.unionByName, passed) if passed else None
    # The same rows, but read from the written table.
    base = ordered.drop("pos", "_total")
    # In the order in which the ranking adds them.
    columns = [contribution(s.signal) for s in scores if s.grain != USER_GRAIN]
    listed = None
    if group_s:
        names = [s.signal for s in group_s]
        combos = _with_floors(who.select("lst", *groups).distinct(), group_s, weights)
        # Few rows, read several times; so are the listed ones.
        combos = durable(combos, "combos")
        listed = durable(_group_listed(combos, base, group_s, weights), "listed")
        heads = _group_heads(combos, base, ordered, listed, names, columns, near, not user_s)
    else:
        heads = ordered.filter(F.col("pos") < near).withColumn("lst", F.lit("all"))
        heads = heads.withColumn("_total", total([F.col(c) for c in columns]))
    heads = durable(heads.select("lst", "pos", ITEM_ID, *shared, F.col("_total").alias(FINAL_SCORE)), "heads")

    small = F.broadcast if heads.count() <= BROADCAST_ROWS else lambda df: df

    # Read for the users who need more and for the others.
    state = durable(_near(who, heads, skip, k, near, small), "state")
    picks = F.posexplode("_picks").alias("_at", "pos")
    ready = state.select(USER_ID, "lst", picks).join(small(heads), ["lst", "pos"]).select(
        USER_ID, (F.col("_at") + 1).alias("rank"), ITEM_ID, FINAL_SCORE, *shared
    )
    more = state.filter("_deep").drop("_picks", "_deep")
    walked = None
    if skip is not None and not more.isEmpty():
        walked = _deep(more, base, ordered.drop("_total"), group_s, listed, weights, shared, skip, k)
    if own is None:
        return ready, walked

    near_rows = ready.select(USER_ID, ITEM_ID, *shared)
    walked = near_rows if walked is None else near_rows.unionByName(walked)
    mine = own.join(who.select(USER_ID, "lst", *groups), USER_ID).join(base, ITEM_ID)
    if group_s:
        mine = mine.join(listed, ["lst", ITEM_ID], "left")
        for s in group_s:
            fill = floors(s, GROUP, weights[s.signal]).withColumnRenamed(GROUP, f"g_{s.signal}")
            mine = mine.join(fill, f"g_{s.signal}", "left").withColumn(
                contribution(s.signal),
                F.coalesce(F.col(contribution(s.signal)), F.col(f"f_{s.signal}")),
            )
    if seen is not None:
        mine = exclude_seen(mine, seen)
    owned = [contribution(s.signal) for s in user_s]
    for c in owned:
        walked = walked.withColumn(c, F.lit(None).cast("double"))
    walked = walked.unionByName(mine.select(USER_ID, ITEM_ID, *shared, *owned))
    for s in user_s:
        c = contribution(s.signal)
        walked = (
            walked.join(floors(s, USER_ID, weights[s.signal]), USER_ID, "left")
            .withColumn(c, F.coalesce(F.col(c), F.col(f"f_{s.signal}")))
            .drop(f"f_{s.signal}")
        )
    return None, walked


def combine(
    users: DataFrame,
    candidates: DataFrame,
    scores: Sequence[Scores | DenseScores],
    weights: Mapping[str, float],
    filters: Filters = Filters(),
    top_k: int = 20,
    seen: DataFrame | None = None,
    items: DataFrame | None = None,
) -> DataFrame:
    """``(user_id, rank, item_id, final_score, c_<signal>..., breakdown)`` for every user.

    ``candidates`` are the items the scores were scaled over; ``seen`` holds ``(user_id, item_id)``
    pairs, for dense signals distinct ones of these users; ``items`` is needed for ``filters.require_features`` only.
    """
    if not scores:
        raise ValueError("combine needs the scores of at least one signal")
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    active = [s for s in scores if weights.get(s.signal, 0.0) > 0]
    names = [s.signal for s in active]
    if not active:
        return users.sparkSession.createDataFrame(
            [],
            f"{USER_ID} string, rank int, {ITEM_ID} string, {FINAL_SCORE} double, "
            f"{BREAKDOWN} map<string,double>",
        )
    pool = exclude_items(candidates, filters.exclude_items)
    if filters.require_features:
        if items is None:
            raise ValueError("require_features needs the item table")
        pool = require_features(pool, items, filters.require_features)
    if not filters.exclude_seen:
        seen = None
    if seen is not None:
        seen = seen.select(USER_ID, ITEM_ID)

    columns = [contribution(n) for n in names]
    ready = None
    if any(isinstance(s, DenseScores) for s in active):
        rows = dense_candidates(users, candidates, pool, active, weights, seen, top_k)
    else:
        ready, rows = _sparse(users, pool, active, weights, seen, top_k)
    found = [] if ready is None else [ready.select(USER_ID, "rank", ITEM_ID, FINAL_SCORE, *columns)]
    if rows is not None:
        summed = rows.withColumn(FINAL_SCORE, total([F.col(c) for c in columns]))
        # A user no signal can score has nothing but nulls: no rows rather than rows of zeros.
        scored = summed.filter(F.coalesce(*[F.col(c) for c in columns]).isNotNull())
        found.append(top_k_per_user(scored, top_k).select(USER_ID, "rank", ITEM_ID, FINAL_SCORE, *columns))
    return reduce(DataFrame.unionByName, found).withColumn(BREAKDOWN, breakdown_map(names))


def combine_full_outer(
    scores: Mapping[str, DataFrame], weights: Mapping[str, float], keys: Sequence[str] = (USER_ID, ITEM_ID)
) -> DataFrame:
    """Explicit score frames ``(keys, score)`` glued by full outer joins, missing ones counting 0.

    For frames that already exist as rows; ``combine_union`` gives the same with a single shuffle.
    """
    parts = [
        df.select(*keys, fixed(F.col(SCORE) * F.lit(float(weights[n]))).alias(contribution(n)))
        for n, df in scores.items()
        if weights.get(n, 0.0) > 0
    ]
    names = [n for n in scores if weights.get(n, 0.0) > 0]
    glued = reduce(lambda a, b: a.join(b, list(keys), "full_outer"), parts)
    glued = glued.fillna(0.0, [contribution(n) for n in names])
    return glued.withColumn(FINAL_SCORE, total([F.col(contribution(n)) for n in names]))


def combine_union(
    scores: Mapping[str, DataFrame], weights: Mapping[str, float], keys: Sequence[str] = (USER_ID, ITEM_ID)
) -> DataFrame:
    """The same table as ``combine_full_outer`` from a union and one aggregation."""
    names = [n for n in scores if weights.get(n, 0.0) > 0]
    parts = [
        scores[n].select(
            *keys, F.lit(n).alias("_signal"), fixed(F.col(SCORE) * F.lit(float(weights[n]))).alias("_c")
        )
        for n in names
    ]
    picked = [
        F.coalesce(F.max(F.when(F.col("_signal") == n, F.col("_c"))), F.lit(0.0)).alias(contribution(n))
        for n in names
    ]
    glued = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*picked)
    return glued.withColumn(FINAL_SCORE, total([F.col(contribution(n)) for n in names]))
