"""Task-side arithmetic of ``dense.py``: a task's users against all item blocks, one block after the other.

Only numpy, pandas and pyarrow are needed here.  The module is shipped to the executors by value, so they do not
need the package installed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle

from rankweave.functions.scaling import DIGITS, MINMAX, NOISE
from rankweave.schema import ITEM_ID, USER_ID

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Products computed at once inside a task; keeps the matrices in the processor cache.
CELLS_AT_ONCE = 1 << 18
# Bounds (rows x leaves) held at once inside a task.
BOUNDS_AT_ONCE = 1 << 21
# Items of a leaf, and how many leaves a user looks at in the order of their bounds before all others are tried.
LEAF = 256
ROUNDS = 4
# Neighbouring leaves of a node: a leaf has a bound only for users whom its node may concern.
NODE = 16
# Distances to boxes pay in few dimensions only.
FEW = 8
EPS = float(np.finfo(float).eps)


def _rows_at_once(n_items: int) -> int:
    return max(8, CELLS_AT_ONCE // max(1, n_items))


def _fixed(x: np.ndarray) -> np.ndarray:
    """Round half away from zero in place, as the column expression ``fixed`` does."""
    scale = 10.0**DIGITS
    negative = x < 0 if x.size and x.min() < 0 else None
    if negative is not None:
        np.abs(x, out=x)
    x *= scale
    x += 0.5
    np.floor(x, out=x)
    x /= scale
    if negative is not None:
        np.negative(x, out=x, where=negative)
    return x


def _vectors(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows plus a mask of the rows that have one; the others are zero."""
    lists = column.combine_chunks()
    has = lists.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim))
    if has.any() and dim:
        out[has] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out, has


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles, NaN for null."""
    return column.combine_chunks().to_numpy(zero_copy_only=False).astype(float)


def _scale(x: np.ndarray, stats: tuple[np.ndarray, ...], method: str) -> np.ndarray:
    """Scale the rows of ``x`` in place."""
    lo, hi, mean, sd = stats
    shift, width, flat = (lo, hi - lo, 0.5) if method == MINMAX else (mean, sd, 0.0)
    level = width == 0
    if method != MINMAX:
        level |= hi - lo <= NOISE * np.maximum(np.abs(lo), np.abs(hi))
    x -= shift[:, None]
    x /= np.where(level, 1.0, width)[:, None]
    if level.any():
        x[level] = flat
    return x


def _products(profiles: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All dot products; one that is no number counts 0."""
    x = profiles @ vectors.T
    return np.nan_to_num(x, copy=False, nan=0.0) if np.isnan(x).any() else x


def _dots(p: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products row by row, added up in the order of the components: the same wherever a pair stands."""
    x = np.zeros(len(p))
    for j in range(p.shape[1]):
        x += p[:, j] * v[:, j]
    return np.nan_to_num(x, copy=False, nan=0.0) if np.isnan(x).any() else x


class Leaves:
    """Rows cut at medians into leaves of at most ``LEAF``; a leaf's rows keep their order."""

    def __init__(self, x: np.ndarray):
        x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
        parts, todo = [], [np.arange(len(x))] if len(x) else []
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                parts.append(np.sort(rows))
                continue
            here, middle = x[rows], len(rows) // 2
            split = np.argpartition(here[:, here.std(axis=0).argmax()], middle) if x.shape[1] else np.arange(len(rows))
            todo += [rows[split[middle:]], rows[split[:middle]]]
        self.order = np.concatenate(parts) if parts else np.zeros(0, int)
        self.ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(int)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def at(self, leaf: int) -> slice:
        return slice(self.ends[leaf], self.ends[leaf + 1])


class Hull:
    """What the vectors of a leaf, given in the order of the leaves, can reach at most."""

    def __init__(self, v: np.ndarray, leaves: Leaves):
        starts, sizes = leaves.ends[:-1], np.diff(leaves.ends)
        self.lo, self.hi = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
        self.middle = (self.lo + self.hi) / 2
        gap = v - np.repeat(self.middle, sizes, axis=0)
        self.radius = np.sqrt(np.maximum.reduceat((gap * gap).sum(axis=1), starts))
        self.norm2 = np.maximum.reduceat((v * v).sum(axis=1), starts)

    def nodes(self) -> Hull:
        """The same of ``NODE`` leaves at a time."""
        out, starts = object.__new__(Hull), _nodes(len(self.lo))
        sizes = np.diff([*starts, len(self.lo)])
        out.lo, out.hi = np.minimum.reduceat(self.lo, starts), np.maximum.reduceat(self.hi, starts)
        out.middle = (out.lo + out.hi) / 2
        gap = self.middle - np.repeat(out.middle, sizes, axis=0)
        out.radius = np.maximum.reduceat(np.sqrt((gap * gap).sum(axis=1)) + self.radius, starts)
        out.norm2 = np.maximum.reduceat(self.norm2, starts)
        return out

    def upper(self, p: np.ndarray, at: slice = slice(None)) -> np.ndarray:
        """Rows x leaves: no product is larger, but for rounding.  By box, by ball, and by distance to the box."""
        lo, hi, norm2 = self.lo[at], self.hi[at], (p * p).sum(axis=1)
        most = np.maximum(p, 0.0) @ hi.T + np.minimum(p, 0.0) @ lo.T
        np.minimum(most, p @ self.middle[at].T + np.sqrt(norm2)[:, None] * self.radius[at], out=most)
        if p.shape[1] <= FEW:
            away = np.zeros_like(most)
            for j in range(p.shape[1]):
                x = p[:, j][:, None]
                beside = np.maximum(lo[:, j] - x, x - hi[:, j])
                np.maximum(beside, 0.0, out=beside)
                away += beside * beside
            np.minimum(most, (norm2[:, None] + self.norm2[at] - away) / 2, out=most)
        most[np.isnan(most)] = np.inf
        return most


def _nodes(leaves: int) -> np.ndarray:
    """The first leaves of the nodes."""
    return np.arange(0, leaves, NODE)


def _rows_to_bound(columns: int) -> int:
    """Rows whose bounds on the first level, and whose products with a leaf, are held at once."""
    return max(8, BOUNDS_AT_ONCE // max(LEAF, columns))


def _descent(levels, wanted, rows: np.ndarray, at: slice = slice(0, None)) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves with the rows that have to look at them.  A level, the leaves being the last, gives the bounds of some rows
    for some of its columns; ``wanted(rows)`` is what they have to reach by now."""
    for column, mine in _visits(levels[0](rows, at), lambda here: wanted(rows[here])):
        found = at.start + column
        if len(levels) == 1:
            yield found, rows[mine]
        else:
            yield from _descent(levels[1:], wanted, rows[mine], slice(found * NODE, found * NODE + NODE))


def _visits(bound: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray]]:
    """Columns with the rows that have to look at them; ``wanted(rows)`` is what a bound has to reach by now.

    Every row first tries its most promising columns.  ``bound`` is used up.
    """
    everyone = np.arange(len(bound))
    for _ in range(ROUNDS):
        leaf = bound.argmax(axis=1)
        most = bound[everyone, leaf]
        rows = np.nonzero((most >= wanted(everyone)) & (most > -np.inf))[0]
        if not len(rows):
            return
        rows = rows[np.argsort(leaf[rows], kind="stable")]
        for mine in np.split(rows, np.flatnonzero(np.diff(leaf[rows])) + 1):
            bound[mine, leaf[mine[0]]] = -np.inf
            yield int(leaf[mine[0]]), mine
    left = np.flatnonzero(((bound >= wanted(everyone)[:, None]) & (bound > -np.inf)).any(axis=0))
    for leaf in left[np.argsort(-bound[:, left].max(axis=0))]:
        mine = np.nonzero((bound[:, leaf] >= wanted(everyone)) & (bound[:, leaf] > -np.inf))[0]
        if len(mine):
            yield int(leaf), mine


def _less(best: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """``best`` minus the room for rounding; everything counts where that is no number."""
    return np.where(np.isfinite(slack), best - np.where(np.isfinite(slack), slack, 0.0), -np.inf)


class Spread:
    """Extremes, count, mean and squared deviations of users' products, block after block.

    There is one way of adding up, whether the items are one block or many.
    """

    def __init__(self, users: int):
        self.lo, self.hi = np.full(users, np.inf), np.full(users, -np.inf)
        self.n, self.mean, self.m2 = np.zeros(users), np.zeros(users), np.zeros(users)

    def add(self, at: slice, x: np.ndarray) -> None:
        if not x.shape[1]:
            return
        n, mean, m2 = x.shape[1], x.mean(axis=1), x.var(axis=1) * x.shape[1]
        both = self.n[at] + n
        away = mean - self.mean[at]
        self.m2[at] += m2 + away * away * self.n[at] * n / both
        self.mean[at] += away * n / both
        self.n[at] = both
        self.lo[at] = np.minimum(self.lo[at], x.min(axis=1))
        self.hi[at] = np.maximum(self.hi[at], x.max(axis=1))

    def add_moments(self, p: np.ndarray, v: np.ndarray) -> None:
        """Count, mean and deviations of all products with ``v``, without the products."""
        n, centre = len(v), v.mean(axis=0)
        apart = v - centre
        mean, m2 = p @ centre, np.maximum(((p @ (apart.T @ apart)) * p).sum(axis=1), 0.0)
        away, both = mean - self.mean, self.n + n
        self.m2 += m2 + away * away * self.n * n / both
        self.mean += away * n / both
        self.n = both

    def add_extremes(self, p: np.ndarray, v: np.ndarray, leaves: Leaves, hull: Hull) -> None:
        """Smallest and largest product of every row with ``v``, which is in the order of the leaves."""
        size = np.sqrt((p * p).sum(axis=1)) + np.sqrt(hull.norm2.max())
        slack = 16 * (p.shape[1] + 4) * EPS * size * size
        hulls = [hull]
        # In many dimensions nodes leave out nothing.
        for _ in range(2 if p.shape[1] <= FEW else 0):
            hulls.insert(0, hulls[0].nodes())
        step = _rows_to_bound(len(hulls[0].lo))
        # All products of a zero vector are 0.
        some, none = np.flatnonzero(p.any(axis=1)), ~p.any(axis=1)
        for sign, best in ((1.0, self.hi), (-1.0, -self.lo)):
            best[none] = np.maximum(best[none], 0.0)
            for i in range(0, len(some), step):
                who = some[i : i + step]
                q, room, top = sign * p[who], slack[who], best[who]
                levels = [lambda mine, at, q=q, h=h: h.upper(q[mine], at) for h in hulls]
                wanted = lambda mine, top=top, room=room: _less(top[mine], room[mine])
                for leaf, mine in _descent(levels, wanted, np.arange(len(q))):
                    here = v[leaves.at(leaf)]
                    x = _products(q[mine], here)
                    least = _less(np.maximum(top[mine], x.max(axis=1)), room[mine])
                    row, column = np.nonzero(x >= least[:, None])
                    np.maximum.at(top, mine[row], _dots(q[mine[row]], here[column]))
                best[who] = top
            if sign < 0:
                self.lo = -best

    def stats(self, at: slice) -> tuple[np.ndarray, ...]:
        """lo, hi, mean, sd; 0 where nothing was added."""
        n = self.n[at]
        some = n > 0
        sd = np.sqrt(self.m2[at] / np.maximum(n, 1))
        return np.where(some, self.lo[at], 0.0), np.where(some, self.hi[at], 0.0), self.mean[at], sd


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best finite entries per row; equal scores: lower column first."""
    width = scores.shape[1]
    if k >= width:
        return np.nonzero(np.isfinite(scores))
    cut = np.partition(scores, width - k, axis=1)[:, width - k]
    row, column = np.nonzero(scores >= cut[:, None])
    value = scores[row, column]
    finite = np.isfinite(value)
    row, column, value = row[finite], column[finite], value[finite]
    # Entries are in row and column order, so entries equal to the cut are numbered left to right.
    level = value == cut[row]
    above = np.bincount(row[~level], minlength=len(scores))
    running = np.cumsum(level)
    first = np.searchsorted(row, np.arange(len(scores)))
    before = np.concatenate([[0], running])[first]
    keep = ~level | (running - before[row] <= k - above[row])
    return row[keep], column[keep]


def _spread(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Row number and value of every element of a column of arrays."""
    whole = lists.combine_chunks()
    return pc.list_parent_indices(whole).to_numpy(zero_copy_only=False), whole.flatten()


class Block:
    """The items of one block in the order of their ids."""

    def __init__(self, rows: pa.Table, dense, item_names, group_names):
        rows = rows.sort_by(ITEM_ID)
        self.ids = rows[ITEM_ID].combine_chunks()
        self.usable = rows["ok"].to_numpy().astype(bool)
        self.base = {n: _numbers(rows[f"c_{n}"]) for n in item_names}
        self.common = sum(self.base.values(), np.zeros(len(rows)))
        self.vectors = {n: _vectors(rows[f"v_{n}"], dim) for n, dim, *_ in dense}
        self.listed = {}
        for n in group_names:
            slots, groups = _spread(rows[f"lg_{n}"])
            self.listed[n] = slots, groups, _spread(rows[f"lc_{n}"])[1].to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.ids)

    def group_values(self, name: str, group: str) -> np.ndarray:
        """Per item, NaN where the group does not list it."""
        slots, listed, values = self.listed[name]
        out = np.full(len(self), np.nan)
        mine = pc.equal(listed, group).to_numpy(zero_copy_only=False).astype(bool)
        out[slots[mine]] = values[mine]
        return out


class Pairs:
    """What users bring along to one block: row, place in the block, signal (-1: seen) and value."""

    def __init__(self, extras: pa.Table, block: Block):
        slot = pc.index_in(extras[ITEM_ID].combine_chunks(), value_set=block.ids)
        mine, slot = extras.filter(slot.is_valid()), slot.filter(slot.is_valid())
        self.row, self.which, self.value = (mine[c].to_numpy() for c in ("row", "which", "c"))
        self.slot, self.width = slot.to_numpy(zero_copy_only=False).astype(np.int64), len(block)
        key = self.row.astype(np.int64) * self.width + self.slot
        self.seen = np.unique(key[self.which < 0])
        self.listed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for j in np.unique(self.which[self.which >= 0]):
            here = key[self.which == j]
            order = np.argsort(here)
            self.listed[int(j)] = here[order], self.value[self.which == j][order]
        # Listed, not seen and allowed.
        asked = np.unique(key[self.which >= 0])
        asked = asked[~np.isin(asked, self.seen)]
        row, place = asked // self.width, asked % self.width
        self.own = tuple(x[block.usable[place]] for x in (row, place))

    def values(self, j: int, row: np.ndarray, slot: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Value of signal ``j``; the floor where it does not list the pair."""
        keys, values = self.listed.get(j, (np.zeros(0, np.int64), np.zeros(0)))
        out = floor[row].copy()
        if len(keys):
            key = row.astype(np.int64) * self.width + slot
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = keys[place] == key
            out[known] = values[place[known]]
        return out


class BlockScorer:
    """One task of ``dense.py``: its users, and the item blocks of a folder.

    A block is read once for the users' extremes and once for their best items.
    """

    def __init__(
        self,
        dense: Sequence[tuple[str, int, str, str, float]],
        item_names: Sequence[str],
        group_names: Sequence[str],
        user_names: Sequence[str],
        folder: str,
        blocks: int,
        k: int,
    ) -> None:
        self.dense = list(dense)
        self.item_names = list(item_names)
        self.group_names = list(group_names)
        self.user_names = list(user_names)
        self.folder, self.blocks, self.k = folder, blocks, k
        # Neighbouring blocks hold neighbouring items: in this order a user's best is soon known well enough.
        self.order = [int(number) for number in np.random.default_rng(blocks).permutation(blocks)]
        self.held: tuple[int, Block | None] | None = None

    def block(self, number: int) -> Block | None:
        """None for a block no item fell into."""
        if self.held is None or self.held[0] != number:
            where, path = fs.FileSystem.from_uri(f"{self.folder}/ib={number}")
            there = where.get_file_info(path).type == fs.FileType.Directory
            names = [f.path for f in where.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")] if there else []
            parts = [pq.ParquetFile(where.open_input_file(f)).read() for f in sorted(names)]
            rows = pa.concat_tables(parts) if parts else None
            self.held = number, (Block(rows, self.dense, self.item_names, self.group_names) if rows is not None and len(rows) else None)
        return self.held[1]

    def _profiles(self, users: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        return {n: _vectors(users[f"p_{n}"], dim) for n, dim, *_ in self.dense}

    def _scored(self, block: Block, name: str, missing: str) -> np.ndarray:
        return block.vectors[name][1] if missing == "drop" else np.ones(len(block), dtype=bool)

    def spreads(self, users: pa.Table, profiles) -> dict[str, Spread]:
        """A user's extremes are looked for in the leaves that may hold them; other scalings take every product."""
        found = {n: Spread(len(users)) for n, *_ in self.dense}
        for number in self.order:
            block = self.block(number)
            for name, _, missing, method, _ in self.dense if block else ():
                p, (vectors, _) = profiles[name][0], block.vectors[name]
                v = vectors[self._scored(block, name, missing)]
                if not len(v):
                    continue
                if method == MINMAX and np.isfinite(p).all() and np.isfinite(v).all():
                    leaves = Leaves(v)
                    found[name].add_moments(p, v)
                    v = v[leaves.order]
                    found[name].add_extremes(p, v, leaves, Hull(v, leaves))
                    continue
                step = _rows_at_once(len(v))
                for i in range(0, len(users), step):
                    found[name].add(slice(i, i + step), _products(p[i : i + step], v))
        return found

    def ranges(self, users: pa.Table) -> pa.Table:
        """Per user and dense signal that is not cold: lo, hi, n, mean, sd."""
        profiles, ids = self._profiles(users), users[USER_ID].combine_chunks()
        spreads, parts = self.spreads(users, profiles), []
        for name, *_ in self.dense:
            warm = profiles[name][1] & (spreads[name].n > 0)
            lo, hi, mean, sd = (x[warm] for x in spreads[name].stats(slice(None)))
            columns = {"lo": lo, "hi": hi, "n": spreads[name].n[warm].astype(np.int64), "mean": mean, "sd": sd}
            whose = {USER_ID: ids.filter(pa.array(warm)), "signal": pa.array([name] * int(warm.sum()), pa.string())}
            parts.append(pa.table(whose | columns))
        return pa.concat_tables(parts)

    def top(self, users: pa.Table, extras: pa.Table) -> pa.Table:
        """Per user the best k allowed items of all blocks; more only where scores are equal."""
        mine = _Users(self, users)
        extras = extras.append_column("row", pc.index_in(extras[USER_ID], value_set=users[USER_ID].combine_chunks()))
        extras = extras.sort_by("row")
        out = []
        for number in self.order:
            block = self.block(number)
            if block is None:
                continue
            pairs = Pairs(extras, block)
            for rows, groups in mine.kinds:
                out.append(_Search(self, mine, block, pairs, groups).table(rows))
        fields = [pa.field(USER_ID, pa.string()), pa.field(ITEM_ID, pa.string())]
        fields += [pa.field(f"c_{n}", pa.float64()) for n in (*self.item_names, *(n for n, *_ in self.dense), *self.group_names, *self.user_names)]
        schema = pa.schema(fields)
        if not out:
            return schema.empty_table()
        found = pa.concat_tables(out)
        # Blocks that came later may have better ones.
        late = found["_score"].to_numpy() >= mine.best[found["_row"].to_numpy(), 0]
        return found.filter(pa.array(late)).select(schema.names).cast(schema)


class _Users:
    """The users of a task: profiles, scales, floors, kinds of users by their groups, and their best k scores so far."""

    def __init__(self, scorer: BlockScorer, users: pa.Table):
        n = len(users)
        self.ids = users[USER_ID].combine_chunks()
        self.profiles = scorer._profiles(users)
        spreads = scorer.spreads(users, self.profiles)
        self.floors = {name: _numbers(users[f"f_{name}"]) for name in (*scorer.group_names, *scorer.user_names)}
        # Users that some signal lets rank every item.
        self.open = np.full(n, bool(scorer.item_names))
        for floor in self.floors.values():
            self.open |= ~np.isnan(floor)
        self.best = np.full((n, scorer.k), -np.inf)
        self.stats, self.warm, self.line = {}, {}, {}
        for name, _, _, method, weight in scorer.dense:
            self.stats[name] = lo, hi, mean, sd = spreads[name].stats(slice(None))
            self.warm[name] = warm = self.profiles[name][1] & (spreads[name].n > 0)
            # The contribution as a line: slope times product plus shift.
            ends = [_scale(np.full((n, 1), 0.0), self.stats[name], method)[:, 0] * weight]
            width = hi - lo if method == MINMAX else sd
            level = width == 0
            if method != MINMAX:
                level |= hi - lo <= NOISE * np.maximum(np.abs(lo), np.abs(hi))
            slope = np.where(warm & ~level, weight / np.where(level, 1.0, width), 0.0)
            self.line[name] = slope, np.where(warm, ends[0], 0.0)
        self.kinds = self._kinds(scorer.group_names, users)

    def _kinds(self, names: Sequence[str], users: pa.Table) -> list[tuple[np.ndarray, dict[str, str | None]]]:
        """Rows of the users in the same groups, with these groups; None where they have none."""
        if not names or not len(users):
            return [(np.arange(len(users)), {})] if len(users) else []
        codes = [users[f"g_{n}"].combine_chunks().dictionary_encode() for n in names]
        table = np.stack([c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in codes], axis=1).astype(int)
        kinds, of = np.unique(table, axis=0, return_inverse=True)
        of = of.reshape(-1)
        name = lambda j, code: None if code < 0 else codes[j].dictionary[int(code)].as_py()
        return [(np.flatnonzero(of == i), {n: name(j, kind[j]) for j, n in enumerate(names)}) for i, kind in enumerate(kinds)]


class _Search:
    """Users of the same groups in one block.  Leaves that cannot reach a user's best k are not looked at.

    Bounds and products inside leaves only choose pairs, with room for rounding; these are then scored one by one.
    """

    def __init__(self, scorer: BlockScorer, users: _Users, block: Block, pairs: Pairs, groups: dict[str, str | None]):
        self.scorer, self.users, self.block, self.pairs, self.groups = scorer, users, block, pairs, groups
        self.listed = {n: block.group_values(n, g) for n, g in groups.items() if g is not None}
        self.usable = np.flatnonzero(block.usable)

    def parts(self, row: np.ndarray, slot: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Contribution of every signal to these pairs, and whether the signal is warm for the user."""
        users, block, out = self.users, self.block, {}
        for name, _, missing, method, weight in self.scorer.dense:
            x = _dots(users.profiles[name][0][row], block.vectors[name][0][slot])
            value = _scale(x[:, None], tuple(s[row] for s in users.stats[name]), method)[:, 0] * weight
            _fixed(value)
            warm = users.warm[name][row]
            value[~warm] = 0.0
            if missing == "drop":
                value[~block.vectors[name][1][slot]] = 0.0
            out[name] = value, warm
        for name in self.scorer.group_names:
            value = users.floors[name][row].copy()
            if name in self.listed:
                here = self.listed[name][slot]
                value = np.where(np.isnan(here) | np.isnan(value), value, here)
            out[name] = value, ~np.isnan(value)
        for j, name in enumerate(self.scorer.user_names):
            warm = ~np.isnan(users.floors[name][row])
            out[name] = self.pairs.values(j, row, slot, users.floors[name]), warm
        return {n: (np.where(warm, value, 0.0), warm) for n, (value, warm) in out.items()}

    def scores(self, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
        final = self.block.common[slot].copy()
        for value, _ in self.parts(row, slot).values():
            final += value
        return _fixed(final)

    def table(self, rows: np.ndarray) -> pa.Table:
        """The best of these users in this block, as far as they are among the best of the blocks so far."""
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(self.usable):
            found += self._own(rows)
            found += self._walk(rows)
        row, slot, score = (np.concatenate(x) for x in zip(*found))
        keep = score >= self.users.best[row, 0]
        row, slot, score = row[keep], slot[keep], score[keep]
        out = {USER_ID: self.users.ids.take(pa.array(row)), ITEM_ID: self.block.ids.take(pa.array(slot)), "_row": row, "_score": score}
        for name in self.scorer.item_names:
            out[f"c_{name}"] = pa.array(self.block.base[name][slot])
        for name, (value, warm) in self.parts(row, slot).items():
            out[f"c_{name}"] = pa.array(value, mask=~warm)
        return pa.table(out)

    def _own(self, rows: np.ndarray):
        """Items that a signal of the users' own lists."""
        row, slot = self.pairs.own
        mine = np.isin(row, rows)
        row, slot = row[mine], slot[mine]
        score = self.scores(row, slot)
        order = np.lexsort((slot, -score, row))
        row, slot, score = row[order], slot[order], score[order]
        few = np.arange(len(row)) - np.searchsorted(row, row) < self.scorer.k
        yield self._kept(row[few], slot[few], score[few])

    def _kept(self, row: np.ndarray, slot: np.ndarray, score: np.ndarray):
        """Raise the users' best scores; rows are in order and have at most k entries each."""
        best, k = self.users.best, self.scorer.k
        some, first, of = np.unique(row, return_index=True, return_inverse=True)
        fresh = np.full((len(some), k), -np.inf)
        fresh[of, np.arange(len(row)) - first[of]] = score
        best[some] = np.sort(np.concatenate([best[some], fresh], axis=1), axis=1)[:, -k:]
        return row, slot, score

    def _walk(self, rows: np.ndarray):
        """All other items, leaf by leaf."""
        users, block, dense = self.users, self.block, self.scorer.dense
        # Nothing is ranked for users whom no signal can score.
        rows = rows[np.logical_or.reduce([users.open[rows], *(users.warm[n][rows] for n, *_ in dense)])]
        if not len(rows):
            return
        base = block.common[self.usable].copy()
        for values in self.listed.values():
            base += np.nan_to_num(values[self.usable])
        # Groups' floors hold for items they do not list.
        rest = {n: np.isnan(v[self.usable]) for n, v in self.listed.items()}
        axes = [base[:, None]]
        for name, _, _, _, weight in dense:
            v = block.vectors[name][0][self.usable]
            wide = v.std(axis=0).max() if v.size else 0.0
            axes.append(v * (weight / (2 * wide)) if np.isfinite(wide) and wide > 0 else v)
        leaves = Leaves(np.concatenate(axes, axis=1))
        slots, starts = self.usable[leaves.order], leaves.ends[:-1]
        base = base[leaves.order]
        rest = {n: r[leaves.order] for n, r in rest.items()}
        # Unlisted items of the group get the same floor, whoever asks.
        for n, r in rest.items():
            floor = users.floors[n][rows]
            base[r] += floor[~np.isnan(floor)][0] if (~np.isnan(floor)).any() else 0.0
        vectors = {n: block.vectors[n][0][slots] for n, *_ in dense}
        scored = {n: self.scorer._scored(block, n, missing)[slots] for n, _, missing, _, _ in dense}
        hulls = {n: Hull(vectors[n], leaves) for n, *_ in dense}
        highest = np.maximum.reduceat(base, starts)
        gaps = {n: np.logical_or.reduceat(~scored[n], starts) for n, *_ in dense}
        levels = [(hulls, highest, gaps)]
        for _ in range(2 if all(dim <= FEW for _, dim, *_ in dense) else 0):
            lower, most, some = levels[0]
            first = _nodes(len(most))
            some = {n: np.logical_or.reduceat(g, first) for n, g in some.items()}
            levels.insert(0, ({n: h.nodes() for n, h in lower.items()}, np.maximum.reduceat(most, first), some))
        leaf_of = np.full(len(block), -1)
        leaf_of[slots] = np.repeat(np.arange(len(leaves)), np.diff(leaves.ends))
        place_of = np.zeros(len(block), int)
        place_of[slots] = np.arange(len(slots)) - np.repeat(starts, np.diff(leaves.ends))
        plain = 1e-13 * (1 + np.abs(base).max() + sum(w for *_, w in dense))
        step = _rows_to_bound(len(levels[0][1]))
        for i in range(0, len(rows), step):
            here = rows[i : i + step]
            shift, slack = np.zeros(len(here)), np.full(len(here), plain)
            for name in self.scorer.user_names:
                shift += np.nan_to_num(users.floors[name][here])
            for name, dim, *_ in dense:
                p, slope, up = users.profiles[name][0][here], users.line[name][0][here], users.line[name][1][here]
                size = np.sqrt((p * p).sum(axis=1)) + np.sqrt(hulls[name].norm2.max())
                slack += 16 * (dim + 4) * EPS * slope * size * size + 4 * EPS * np.abs(up)

            def least(mine, here=here, slack=slack):
                return _less(users.best[here[mine], 0], slack[mine])

            reach = [
                lambda mine, at, here=here, shift=shift, level=level: self._reach(here[mine], shift[mine], *level, at)
                for level in levels
            ]
            brought = self._brought(here, leaf_of, place_of)
            for leaf, mine in _descent(reach, least, np.arange(len(here))):
                yield self._leaf(here, mine, slack, shift, base, vectors, scored, slots, leaves.at(leaf), brought, leaf)

    def _reach(self, who: np.ndarray, shift: np.ndarray, hulls, highest, gaps, at: slice) -> np.ndarray:
        """Rows x leaves, or nodes: no score of an item there is higher, but for rounding."""
        bound = highest[None, at] + shift[:, None]
        for name, *_ in self.scorer.dense:
            slope, up = (x[who] for x in self.users.line[name])
            most = hulls[name].upper(self.users.profiles[name][0][who], at)
            with np.errstate(invalid="ignore"):
                most = slope[:, None] * most + up[:, None]
            most[np.isnan(most)] = np.inf
            open_ = gaps[name][at]
            if open_.any():
                most[:, open_] = np.maximum(most[:, open_], 0.0)
            bound += most
        bound[np.isnan(bound)] = np.inf
        return bound

    def _brought(self, here: np.ndarray, leaf_of: np.ndarray, place_of: np.ndarray):
        """What these users bring along, by leaf: it is not found on the walk."""
        local = np.full(len(self.users.ids), -1)
        local[here] = np.arange(len(here))
        row, leaf, place = local[self.pairs.row], leaf_of[self.pairs.slot], place_of[self.pairs.slot]
        mine = (row >= 0) & (leaf >= 0)
        order = np.argsort(leaf[mine], kind="stable")
        return leaf[mine][order], row[mine][order], place[mine][order]

    def _leaf(self, here, mine, slack, shift, base, vectors, scored, slots, at, brought, leaf):
        users, k = self.users, self.scorer.k
        x = base[None, at] + shift[mine][:, None]
        ranked = np.broadcast_to(users.open[here[mine]][:, None], x.shape)
        for name, *_ in self.scorer.dense:
            who = here[mine]
            part = _products(users.profiles[name][0][who], vectors[name][at])
            part *= users.line[name][0][who][:, None]
            part += users.line[name][1][who][:, None]
            if not scored[name][at].all():
                part[:, ~scored[name][at]] = 0.0
            x += part
            ranked = ranked | (users.warm[name][who][:, None] & scored[name][at][None, :])
        x[np.isnan(x)] = np.inf
        x[~ranked] = -np.inf
        leaf_in, row, place = brought
        start, stop = np.searchsorted(leaf_in, [leaf, leaf + 1])
        if stop > start:
            local = np.full(len(here), -1)
            local[mine] = np.arange(len(mine))
            known = local[row[start:stop]]
            x[known[known >= 0], place[start:stop][known >= 0]] = -np.inf
        least = users.best[here[mine], 0]
        if x.shape[1] > k:
            least = np.maximum(least, np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k])
        row, column = np.nonzero((x >= _less(least, slack[mine])[:, None]) & (x > -np.inf))
        exact = np.full(x.shape, -np.inf)
        exact[row, column] = self.scores(here[mine[row]], slots[at][column])
        row, column = _best(exact, k)
        score = exact[row, column]
        keep = score >= users.best[here[mine[row]], 0]
        row, column, score = row[keep], column[keep], score[keep]
        return self._kept(here[mine[row]], slots[at][column], score)
