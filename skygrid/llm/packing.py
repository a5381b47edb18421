"""Sequence packing by best-fit decreasing over a segment tree.

A document is its token ids followed by one end id. Documents longer than a
window are first cut into full windows; what remains (1 to window ids) is
placed in the open window with the tightest remaining capacity, found in a
segment tree indexed by remaining capacity, longest pieces first.

Scale. Piece lengths are integers up to the window, so best fit depends only
on the histogram of lengths: the driver packs ``window`` counters, never the
pieces. All windows with the same remaining capacity are one class, and a
class takes pieces of one length in bulk; this gives the very packing that
one-at-a-time best fit gives, because a window that still has room after
taking a piece is the tightest one for the next piece. The plan has at most
about window^2 / 2 ranges, whatever the corpus size. Each piece then finds its
range from (length, ordinal).
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import docs_of, materialise, ship, table
from .tokens import Encoder

END_ID = 0


class CapacitySegmentTree:
    """Which remaining capacities have open windows: set, clear, and the
    smallest marked capacity not below a bound, each in O(log window)."""

    def __init__(self, window: int):
        self.leaf = 1
        while self.leaf < window + 1:
            self.leaf *= 2
        self.mark = [0] * (2 * self.leaf)

    def put(self, capacity: int, on: bool) -> None:
        i = capacity + self.leaf
        self.mark[i] = int(on)
        i //= 2
        while i:
            self.mark[i] = self.mark[2 * i] | self.mark[2 * i + 1]
            i //= 2

    def tightest(self, least: int) -> int:
        """-1 if no marked capacity is >= least."""
        i = least + self.leaf
        if i >= 2 * self.leaf:
            return -1
        if self.mark[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.mark[i + 1]:
                i += 1
                while i < self.leaf:
                    i = 2 * i if self.mark[2 * i] else 2 * i + 1
                return i - self.leaf
            i //= 2
        return -1


def plan_windows(counts: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing on a histogram {length: pieces}.

    Returns rows (length, first ordinal, pieces, first window, pieces per
    window, offset of the first piece in a window) and the number of windows.
    """
    tree = CapacitySegmentTree(window)
    open_: dict[int, deque] = {}  # capacity -> ranges of windows (first, count)
    out, made = [], 0

    def give(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            q = open_.setdefault(capacity, deque())
            if not q:
                tree.put(capacity, True)
            q.append((first, n))

    for length in sorted(counts, reverse=True):
        left, ordinal = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                per = window // length
                n = -(-left // per)
                first, made, room = made, made + n, window
            else:
                per = room // length
                first, n = open_[room].popleft()
                if not open_[room]:
                    tree.put(room, False)
            full = min(n, left // per)
            if full:
                out.append((length, ordinal, full * per, first, per, window - room))
                give(room - per * length, first, full)
                ordinal, left = ordinal + full * per, left - full * per
            if full < n:
                rest = first + full
                if left:  # fewer pieces than one window takes
                    out.append((length, ordinal, left, rest, per, window - room))
                    give(room - left * length, rest, 1)
                    ordinal, left, rest = ordinal + left, 0, rest + 1
                if rest < first + n:
                    q = open_.setdefault(room, deque())
                    if not q:
                        tree.put(room, True)
                    q.appendleft((rest, first + n - rest))
    return np.array(out, dtype=np.int64).reshape(-1, 6), made


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, rank long"


def cut_documents(docs: DataFrame, window: int, vocabulary: str | None) -> DataFrame:
    """Token pieces of each document, with the piece's rank among those of its
    length in the task that made it. ``ids`` are little-endian uint32."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = Encoder(vocabulary)
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    n = len(piece)
                    for col, v in zip(rows, (doc, at, n, len(ids), piece.tobytes(), part, int(seen[n]))):
                        col.append(v)
                    seen[n] += 1
                    size += 4 * n
                if size > 4_000_000:
                    yield _batch(rows)
                    rows, size = [[] for _ in range(7)], 0
            if rows[0]:
                yield _batch(rows)

    return docs.mapInArrow(run, PIECES)


def _batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
    names = ("doc_id", "start", "length", "doc_tokens", "ids", "part", "rank")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=list(names))


class Packed:
    """``pieces``: every token piece with its place (doc_id, start, length,
    doc_tokens, ids_crc32, sequence_id, offset). ``sequences()``: the windows
    themselves, padded."""

    def __init__(self, pieces: DataFrame, stored: DataFrame, window: int, windows: int):
        self.pieces, self.stored, self.window, self.windows = pieces, stored, window, windows

    def sequences(self, pad_id: int = 50256) -> DataFrame:
        """(sequence_id, length, ids array<long>): one row per window, padded
        with ``pad_id``, unless the length is a power of two. A window has at
        most ``window`` pieces, so a group is bounded."""
        window = self.window
        full = self.pieces.join(self.stored.select("part", "length", "rank", "ids"), ["part", "length", "rank"])

        def assemble(pdf):
            import pandas as pd

            pdf = pdf.sort_values("offset")
            ids = np.frombuffer(b"".join(pdf["ids"]), "<u4").astype(np.int64)
            n = len(ids)
            if n & (n - 1):
                ids = np.append(ids, np.full(window - n, pad_id, np.int64))
            return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "length": [n], "ids": [ids]})

        return full.groupBy("sequence_id").applyInPandas(assemble, "sequence_id long, length long, ids array<long>")


def pack(docs: DataFrame, window: int = 1024, vocabulary: str | None = None) -> Packed:
    """Pack all documents into windows of at most ``window`` ids.

    Null text counts as empty and gives the end id alone; a text longer than a
    window is cut into full windows and a rest; pieces of equal length are alike
    to the packing and take places in the order of tasks and rows; an empty table
    gives no rows; repeated rows and rows without doc_id are packed once each;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    stored = materialise(cut_documents(docs_of(docs), window, vocabulary).withColumn("ids_crc32", F.crc32("ids")))
    tally = stored.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= window rows
    plan, windows = plan_windows(counts, window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    narrow = stored.select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "part", "rank").join(starts, ["part", "length"])
    shared = spark.sparkContext.broadcast(plan)  # bounded by window^2 / 2 rows

    def place(batches):
        rows = shared.value
        key = rows[:, 0] * (1 << 45) - (1 << 45) * (window + 1)  # sorts by length, then ordinal
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows, key = rows[order], (key + rows[:, 1])[order]
        for b in batches:
            col = {n: b.column(n).to_numpy() for n in ("length", "rank", "before")}
            nth = col["before"] + col["rank"]
            r = rows[np.searchsorted(key, col["length"] * (1 << 45) - (1 << 45) * (window + 1) + nth, side="right") - 1]
            q = nth - r[:, 1]
            seq, off = r[:, 3] + q // r[:, 4], r[:, 5] + (q % r[:, 4]) * col["length"]
            keep = [b.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                keep + [pa.array(seq), pa.array(off), b.column("part"), b.column("rank")],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "rank"],
            )

    pieces = narrow.mapInArrow(
        place,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, rank long",
    )
    return Packed(pieces, stored, window, windows)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).pieces.drop("part", "rank")
