"""Nearest neighbours among the rows of sorted partitions, on arrays.

Not every pair within the radius is formed: where a group of right rows is dense,
a left row asks a grid of a fraction of the radius first, and only the rows that
find fewer than ``n`` there ask one twice as wide, up to the radius itself.
"""

from __future__ import annotations

import numpy as np

FEW = 48  # right rows of a group that a left row looks at one by one
PAIRS = 1 << 21  # candidate pairs held at a time
ROWS = 1 << 16  # rows gathered before a search


def firsts(group, pos, n: int):
    """Rows that have fewer than ``n`` others of the same group and place before
    them; equal places lie together."""
    at = np.arange(len(group))
    if not len(at):
        return at
    new = np.r_[True, (group[1:] != group[:-1]) | (pos[1:] != pos[:-1]).any(axis=1)]
    return at[at - np.maximum.accumulate(np.where(new, at, 0)) < n]


def pairs_of(start, stop):
    """(row, position) for every position of every row's range."""
    size = stop - start
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) + np.repeat(start - (np.cumsum(size) - size), size)


def slices(size, most: int):
    """Runs of rows with about ``most`` pairs each, one row at least."""
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


class Grid:
    """Right rows of some groups in cubes, of an edge for each group."""

    def __init__(self, group, pos, used, base, span, edge):
        side = np.where(used, np.floor(span / edge).astype(np.int64) + 1, 0)
        self.side, self.base, self.edge = side, base, edge
        self.offset = np.cumsum(side**3) - side**3
        mine = np.flatnonzero(used[group])
        g = group[mine]
        c = np.minimum(np.floor((pos[mine] - base[g]) / edge[g, None]).astype(np.int64), side[g, None] - 1)
        key = self.offset[g] + (c[:, 0] * side[g] + c[:, 1]) * side[g] + c[:, 2]
        order = np.argsort(key, kind="stable")
        self.keys, self.rows = key[order], mine[order]

    def ranges(self, group, pos):
        """Nine ranges of rows for each place: the cubes beside it, those along z as one."""
        side, offset = self.side[group], self.offset[group]
        c = np.floor((pos - self.base[group]) / self.edge[group, None])
        c = np.clip(c, -2, side[:, None] + 1).astype(np.int64)
        low, high = np.maximum(c[:, 2] - 1, 0), np.minimum(c[:, 2] + 1, side - 1)
        start, stop = np.zeros((len(group), 9), np.int64), np.zeros((len(group), 9), np.int64)
        for k in range(9):
            x, y = c[:, 0] + k // 3 - 1, c[:, 1] + k % 3 - 1
            ok = np.flatnonzero((x >= 0) & (x < side) & (y >= 0) & (y < side) & (low <= high))
            line = offset[ok] + (x[ok] * side[ok] + y[ok]) * side[ok]
            start[ok, k] = np.searchsorted(self.keys, line + low[ok], "left")
            stop[ok, k] = np.searchsorted(self.keys, line + high[ok], "right")
        return start, stop


def nearest(lgroup, left, rgroup, right, n: int, chord: float, low: float = 0.0):
    """(left row, right row, squared chord) of each left row's ``n`` nearest right
    rows of its group with ``low < chord of both < chord`` (``low = 0`` keeps zero).

    Right rows ascend by group, then in the order that settles ties, places first.
    """
    kept = firsts(rgroup, right, n)
    kept = kept[np.isfinite(right[kept]).all(axis=1)]
    rgroup, right = rgroup[kept], right[kept]
    groups = int(max(lgroup.max(initial=-1), rgroup.max(initial=-1))) + 1
    count = np.bincount(rgroup, minlength=groups)
    begin = np.cumsum(count) - count
    found = []

    def ask(rows, start, stop, order, bound):
        """Searches the rows' ranges; which of them hold ``n`` within the bound."""
        full = np.zeros(len(rows), bool)
        size = (stop - start).sum(axis=1)
        for a, b in slices(size, PAIRS):
            row, at = pairs_of(start[a:b].ravel(), stop[a:b].ravel())
            row, at = row // start.shape[1], at if order is None else order[at]
            one, other = left[rows[a:b]][row], right[at]
            d2 = np.zeros(len(row))
            for k in range(3):
                d2 += (one[:, k] - other[:, k]) * (one[:, k] - other[:, k])
            near = d2 < (bound[a:b] * bound[a:b])[row]
            if low > 0:
                near &= d2 > low**2
            row, at, d2 = row[near], at[near], d2[near]
            hits = np.bincount(row, minlength=b - a)
            full[a:b] = (hits >= n) | (bound[a:b] >= chord)
            go = full[a:b][row]
            row, at, d2 = row[go], at[go], d2[go]
            best = np.lexsort((at, d2, row))
            row, at, d2 = row[best], at[best], d2[best]
            lead = np.searchsorted(row, row, "left")
            top = np.arange(len(row)) - lead < n
            found.append((rows[a:b][row[top]], kept[at[top]], d2[top]))
        return full

    todo = np.flatnonzero((count[lgroup] > 0) & np.isfinite(left).all(axis=1)) if groups else np.zeros(0, np.int64)
    few = todo[count[lgroup[todo]] <= FEW]
    start = begin[lgroup[few]][:, None]
    ask(few, start, start + count[lgroup[few]][:, None], None, np.full(len(few), chord))
    todo = todo[count[lgroup[todo]] > FEW]
    if len(todo):
        base, span = np.zeros((groups, 3)), np.zeros(groups)
        some = np.flatnonzero(count)
        base[some] = np.minimum.reduceat(right, begin[some])
        span[some] = (np.maximum.reduceat(right, begin[some]) - base[some]).max(axis=1)
        step = np.maximum(span * np.sqrt((3 * n + 2) / (np.pi * np.maximum(count, 1))), chord / 4096)
        while len(todo):
            reach = np.sqrt(low**2 + step**2)
            reach = np.where(reach < chord, reach, chord)
            used = np.zeros(groups, bool)
            used[lgroup[todo]] = True
            grid = Grid(rgroup, right, used, base, span, reach * (1 + 1e-9) + 1e-15)
            rest = []
            for a in range(0, len(todo), ROWS):
                rows = todo[a : a + ROWS]
                rest.append(rows[~ask(rows, *grid.ranges(lgroup[rows], left[rows]), grid.rows, reach[lgroup[rows]])])
            todo, step = np.concatenate(rest), step * 2
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    li, ri, d2 = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(li, kind="stable")
    return li[order], ri[order], d2[order]


def matcher(keys: list[str], side: str, place: list[str], left: str, right: str, row_id: str, names: list[str], n: int, chord: float, low: float, keep_all: bool):
    """A function for ``mapInArrow`` over rows sorted by ``keys``, then right rows
    (``side`` 0) in the order that settles ties, then left rows.

    A left row comes when all right rows of its group are there, so a group is
    never held whole: between searches only its right rows are.
    """
    import pyarrow as pa

    def groups(table):
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            codes = table.column(k).combine_chunks()
            codes = codes if pa.types.is_int64(codes.type) else codes.dictionary_encode().indices
            gone = np.asarray(codes.is_null())
            codes = codes.fill_null(0).to_numpy(zero_copy_only=False)
            new[1:] |= (codes[1:] != codes[:-1]) | (gone[1:] != gone[:-1])
        return np.cumsum(new)

    def search(table):
        group = groups(table)
        is_left = table.column(side).to_numpy().astype(bool)
        pos = np.stack([table.column(p).to_numpy().astype(float) for p in place], axis=1)
        l, r = np.flatnonzero(is_left), np.flatnonzero(~is_left)  # noqa: E741
        li, ri, d2 = nearest(group[l], pos[l], group[r], pos[r], n, chord, low)
        one, other = l[li], pa.array(r[ri])
        d2 = pa.array(d2)
        if keep_all:
            alone = np.setdiff1d(np.arange(len(l)), li)
            one, nothing = np.r_[one, l[alone]], len(alone)
            other, d2 = pa.concat_arrays([other, pa.nulls(nothing, other.type)]), pa.concat_arrays([d2, pa.nulls(nothing, d2.type)])
        lefts, rights, ids = (table.column(c).combine_chunks() for c in (left, right, row_id))
        for a in range(0, len(one), 10_000):
            mine = pa.array(one[a : a + 10_000])
            yield pa.RecordBatch.from_arrays([lefts.take(mine), rights.take(other[a : a + 10_000]), d2[a : a + 10_000], ids.take(mine)], names=names)

    def held(table):
        """The right rows of the last group: all that later left rows can need."""
        group = groups(table)
        mine = np.flatnonzero((group == group[-1]) & ~table.column(side).to_numpy().astype(bool))
        return table.take(pa.array(mine)).combine_chunks()

    def run(batches):
        kept, pending, rows = None, [], 0
        for batch in batches:
            pending.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= max(ROWS, kept.num_rows if kept is not None else 0):
                table = pa.concat_tables(([kept] if kept is not None else []) + pending)
                yield from search(table)
                kept, pending, rows = held(table), [], 0
        if rows:
            yield from search(pa.concat_tables(([kept] if kept is not None else []) + pending))

    return run
