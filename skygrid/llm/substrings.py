"""Exact removal of repeated byte strings with sharded FM-indexes.

Windows of ``k`` bytes whose minimiser recurs in another document go, as short
stretches, to the shard their minimiser names, so all places of one string meet
in one shard. A shard indexes the stretches that hold the first place of a
repeating string: the Burrows-Wheeler transform of their suffixes, sorted up to
``k`` symbols, in a bit-packed wavelet matrix with rank blocks, beside one byte a
symbol for common prefixes. The stretches of all other documents, which are no
part of the indexed text, are streamed through it from right to left by backward
search: each step prepends a symbol, and where that leaves no interval, falls
back to the parent interval, so the match always is the longest prefix of what
follows that the index holds (matching statistics, cut at ``k``). Where it reaches
``k``, the window is one the index knows, and its document joins the owners of
that interval; the smallest of them decides what is removed.

Scale. A chunk sends each distinct stretch once, so copies meet as one row a
chunk; an anchor found in more than ``hot_docs`` documents is spread window by
window over all shards. Nothing grows beyond a chunk or a shard (see ``passages``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, table
from .passages import (
    ANSWERED,
    SENT,
    anchor_runs,
    answer_rows,
    answer_runs,
    by_chunk,
    by_number,
    chunk_size,
    expand,
    gram_hashes,
    numbers,
    own_places,
    pack_chunks,
    place_segments,
    removed_mask,
    report_anchors,
    rows_of,
    sent_rows,
    shard_count,
    shared_anchors,
    squeeze,
    tiles,
)

GRAM = 16
HOT_DOCS = 2000
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)  # the bits before each bit


class BitVector:
    """Packed bits with a running count per 64-bit word."""

    __slots__ = ("words", "before", "zeros")

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((n >> 6) + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), np.int32)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:])
        self.zeros = n - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before position i."""
        w = i >> 6
        return self.before.take(w) + np.bitwise_count(self.words.take(w) & BELOW.take(i & 63))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, s = [], symbols
        for level in range(levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.levels.append((level, BitVector(bit.astype(bool))))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Positions of [lo, hi) in the block of ``symbol`` after all levels."""
        at, symbol = np.concatenate([lo, hi]), np.concatenate([symbol, symbol])
        for level, bv in self.levels:
            ones = bv.ones(at)
            at = np.where((symbol >> level) & 1, ones + bv.zeros, at - ones)
        return at[: len(lo)], at[len(lo) :]


class Minima:
    """Smallest values of blocks of blocks of a byte array that ends in zero:
    nearest places left or right with less than a bound, many at once."""

    WIDE = 16

    def __init__(self, values: np.ndarray):
        self.levels = []
        while True:
            whole = np.zeros(-(-len(values) // self.WIDE) * self.WIDE, np.uint8)
            whole[: len(values)] = values
            self.levels.append(whole.reshape(-1, self.WIDE))
            if len(whole) == self.WIDE:
                break
            values = self.levels[-1].min(1)
        self.step = np.arange(self.WIDE)

    def seek(self, pos: np.ndarray, bound: np.ndarray, back: bool, level: int = 0) -> np.ndarray:
        """Last place up to (``back``), or first from, each position with a value
        below the bound; there must be one."""
        block = pos // self.WIDE
        low, at = self._low(level, block, bound), (pos - block * self.WIDE)[:, None]
        low &= self.step <= at if back else self.step >= at
        out, none = block * self.WIDE + self._pick(low, back), np.flatnonzero(~low.any(1))
        if len(none):
            up = self.seek(block[none] + (-1 if back else 1), bound[none], back, level + 1)
            out[none] = up * self.WIDE + self._pick(self._low(level, up, bound[none]), back)
        return out

    def _low(self, level, block, bound):
        return self.levels[level].take(block, axis=0) < bound[:, None]

    def _pick(self, low, back):
        return self.WIDE - 1 - low[:, ::-1].argmax(1) if back else low.argmax(1)


class FMIndex:
    """FM-index of texts for patterns of at most ``k`` symbols.

    Symbols are bytes + 1; 0 separates texts. Suffixes are sorted by their first
    ``k`` symbols, which leaves every interval of a pattern up to that length
    intact. Kept are the wavelet matrix (about 1.5 bytes a byte), common prefixes
    of neighbours (one byte), and a mark where a new k-string begins; ``home``,
    the k-string that starts at each symbol, serves to build from and may go.
    """

    def __init__(self, text: np.ndarray, k: int):
        used = np.union1d([0], text)
        self.dense = np.full(257, -1, np.int64)
        self.dense[used] = np.arange(len(used))
        text = self.dense.astype(np.int16)[text]  # separators stay 0
        levels = max(1, int(len(used) - 1).bit_length())
        self.n, self.k = len(text), k
        order, new, common = self._sort(text, k, levels)
        self.prefix = Minima(np.append(common, 0))
        self.common = self.prefix.levels[0].ravel()
        self.begins = BitVector(new)
        self.groups = int(new.sum())  # k-strings, those cut short by the end included
        self.home = np.empty(self.n, np.int32)
        self.home[order] = np.cumsum(new) - 1
        bwt = text[order - 1]
        counts = np.bincount(bwt, minlength=1 << levels)
        # after the last level symbols stand in the order of their reversed bits
        seq = np.argsort([int(f"{s:0{levels}b}"[::-1], 2) for s in range(1 << levels)])
        block = np.zeros(1 << levels, np.int64)
        block[seq] = np.cumsum(counts[seq]) - counts[seq]
        self.shift = np.cumsum(counts) - counts - block
        self.tree = WaveletMatrix(bwt, levels)

    @staticmethod
    def _sort(text, k, levels):
        """Suffix order by the first k symbols, where a new k-string begins in
        it, and the common prefix, cut at k, of every suffix with the one before.
        Prefixes double; only groups of several suffixes are sorted again."""
        n = len(text)
        have = min(63 // levels, k)
        padded = np.append(text, np.zeros(k + 8, np.int64)).astype(np.uint8)
        key = np.zeros(n, np.uint64)
        for j in range(have):
            key = (key << np.uint64(levels)) | padded[j : j + n]
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        del key
        known = np.zeros(n, np.uint8)  # common prefix of neighbours, at least
        rank = np.zeros(n + k, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
        while have < k:
            step = min(have, k - have)
            alone = new & np.r_[new[1:], True]
            places = np.flatnonzero(~alone).astype(np.int32)  # positions in the order of groups of several
            members = order[places]
            pair = (rank[members].astype(np.uint64) << np.uint64(32)) | rank[members + step].astype(np.uint64)
            o = np.argsort(pair)
            members, pair = members[o], pair[o]
            order[places] = members
            split = np.r_[True, pair[1:] != pair[:-1]]
            fresh = split & ~new[places]
            known[places[fresh]] = have
            new = new.copy()
            new[places] = split
            rank[members] = np.maximum.accumulate(np.where(split, places, np.int32(0)))
            have += step
        common = np.full(n, k, np.uint8)
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        at = np.flatnonzero(new)[1:]
        depth = known[at].astype(np.int64)
        while len(at):
            a = np.ascontiguousarray(eight[order[at - 1] + depth]).view(np.uint64)[:, 0]
            b = np.ascontiguousarray(eight[order[at] + depth]).view(np.uint64)[:, 0]
            x = a ^ b
            same = np.bitwise_count((x & -x) - np.uint64(1)).astype(np.int64) >> 3  # equal bytes, 8 if all
            depth += np.where(x == 0, 8, same)
            go = (x == 0) & (depth < k)
            common[at[~go]] = np.minimum(depth[~go], k)
            at, depth = at[go], depth[go]
        common[0] = 0
        return order, new, common

    def extend(self, symbol, lo, hi):
        a, b = self.tree.rank(symbol, lo, hi)
        shift = self.shift[symbol]
        return a + shift, b + shift

    def parent(self, lo, hi, depth=None):
        """The interval of the longest shorter prefix that holds more suffixes (or
        of ``depth`` symbols), and its depth."""
        if depth is None:
            depth = np.maximum(self.common[lo], self.common[hi])
        some = depth > 0
        a, b = np.zeros_like(lo), np.full_like(hi, self.n)
        if some.any():
            bound = depth[some].astype(np.uint8)
            a[some] = self.prefix.seek(lo[some], bound, True)
            b[some] = self.prefix.seek(hi[some], bound, False)
        return a, b, depth.astype(np.int64)

    def matching(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Stream texts (symbols text[start:end]) through the index. Yields
        (which text, position, k-string) wherever the match reaches ``k``: that
        k-string of the index starts there. A text whose match can no longer
        reach ``k`` before its start is left."""
        k = self.k
        symbols = self.dense.astype(np.int16)[text]
        who = np.flatnonzero(ends - starts >= k)
        starts, at = starts[who], ends[who].copy()
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        have = np.zeros(len(at), np.int64)  # matching statistic of the position, cut at k
        while len(who):
            at -= 1
            c = symbols[at]
            full = np.flatnonzero(have == k)
            if len(full):
                wide = full[(self.common[lo[full]] >= k - 1) | (self.common[hi[full]] >= k - 1)]
                have[full] = k - 1
                if len(wide):
                    lo[wide], hi[wide], _ = self.parent(lo[wide], hi[wide], np.full(len(wide), k - 1))
            a, b = self.extend(np.maximum(c, 0), lo, hi)
            ok = (a < b) & (c > 0)
            lost = np.flatnonzero(~ok)
            lo, hi = np.where(ok, a, lo), np.where(ok, b, hi)
            have += ok
            while len(lost):
                lost = lost[have[lost] > 0]  # no prefix is left to prepend to: the match is empty
                known = lost[c[lost] > 0]
                none = lost[c[lost] <= 0]
                lo[none], hi[none], have[none] = 0, self.n, 0
                if not len(known):
                    break
                lo[known], hi[known], have[known] = self.parent(lo[known], hi[known])
                # a match that cannot reach k any more needs no more steps
                known = known[have[known] + 1 + at[known] - starts[known] >= k]
                a, b = self.extend(c[known], lo[known], hi[known])
                ok = a < b
                lo[known[ok]], hi[known[ok]] = a[ok], b[ok]
                have[known[ok]] += 1
                lost = known[~ok]
            hit = np.flatnonzero(have == k)
            if len(hit):
                yield who[hit], at[hit], self.begins.ones(lo[hit] + 1) - 1
            live = (at > starts) & (have + at - starts >= k)
            if not live.all():
                who, starts, at, lo, hi, have = (x[live] for x in (who, starts, at, lo, hi, have))


def _symbols(payload):
    ids, lens, raw = expand(payload)
    stop = np.cumsum(lens)
    return ids, stop - lens, stop, raw


def find_anchors(chunks: DataFrame, k: int, buckets: int) -> DataFrame:
    def run(batches):
        for chunk, payload in rows_of(batches):
            ids, _, stop, raw = _symbols(payload)
            first, _, h = anchor_runs(raw, stop, k, GRAM)
            rows = list(report_anchors(h, ids[np.searchsorted(stop, first, side="right")], buckets))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                names=["bucket", "chunk", "blob"],
            )

    return chunks.mapInArrow(run, "bucket int, chunk long, blob binary")


def segments_of(payload, shared, k: int, buckets: int, shards: int):
    ids, _, stop, raw = _symbols(payload)
    body = raw.tobytes()
    return place_segments(anchor_runs(raw, stop, k, GRAM), shared, ids, stop, k, buckets, shards, lambda s, e: body[s:e])


def send_segments(joined: DataFrame, k: int, buckets: int, shards: int) -> DataFrame:
    """(shard, chunk, blob, own): the chunk's distinct segments for a shard with
    the smallest document of each; ``own`` rows hold the places of its segments,
    which a shard hands back as they are."""

    def run(batches):
        for chunk, payload, shared in rows_of(batches):
            if not shared:
                continue
            by, places = segments_of(payload, shared, k, buckets, shards)
            rows = [
                (g, squeeze(np.array([len(t) for t in texts], np.int32), np.array(docs, np.int64), np.array(many, np.uint8), np.frombuffer(b"".join(texts), np.uint8)))
                for g, (texts, docs, many) in by.items()
            ]
            yield sent_rows(chunk, rows, places, shards)

    return joined.mapInArrow(run, SENT)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def split_stretches(raw: np.ndarray, lens, windows, k) -> tuple[np.ndarray, np.ndarray]:
    """(to index, to stream): masks of the stretches of a shard. Of the stretches
    that share a window's hash, the first is indexed, the others are streamed.
    Those that share none, met by chance of one anchor only, need neither."""
    h = np.concatenate([gram_hashes(x, k) for _, x in tiles(raw, k)])[_ranges(np.cumsum(lens) - lens, windows)]
    index, use = np.zeros(len(lens), bool), np.zeros(len(lens), bool)
    order = np.argsort(h)
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    several = ~(new & np.r_[new[1:], True])
    if several.any():
        who = np.repeat(np.arange(len(lens), dtype=np.int32), windows)[order[several]]
        index[np.minimum.reduceat(who, np.flatnonzero(new[several]))] = True
        use[who] = True
    return index, use & ~index


def least_owners(raw: np.ndarray, lens: np.ndarray, least: np.ndarray, several: np.ndarray, k: int) -> np.ndarray:
    """The smallest document that holds it, for every window of the distinct
    stretches of a shard, one after another. ``least``: the smallest document of
    each stretch; ``several``: others have it too."""
    windows = lens - k + 1
    doc = np.repeat(least, windows)  # of windows that no other stretch has
    index, stream = split_stretches(raw, lens, windows, k)
    index |= several  # indexed for its first document, streamed for the others
    if not index.any():
        return doc
    base, first = np.cumsum(lens) - lens, np.cumsum(windows) - windows
    use = np.flatnonzero(index)
    ends = np.cumsum(lens[use] + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.int16)
    text[_ranges(ends - lens[use], lens[use])] = raw[np.repeat(index, lens)]
    text += 1
    text[ends] = 0
    fm = FMIndex(text, k)
    owner = np.full(fm.groups, np.iinfo(np.int64).max)
    mine = fm.home[_ranges(ends - lens[use], windows[use])]
    np.minimum.at(owner, mine, np.repeat(least[use], windows[use]))
    guests = np.flatnonzero(stream | several)
    found = np.full(len(doc), -1)
    for who, at, group in fm.matching(raw.astype(np.int16) + np.int16(1), base[guests], base[guests] + lens[guests]):
        g = guests[who]
        np.minimum.at(owner, group, least[g])
        found[first[g] + at - base[g]] = group
    found[_ranges(first[use], windows[use])] = mine
    hit = found >= 0
    doc[hit] = owner[found[hit]]
    return doc


def index_shards(segments: DataFrame, k: int, shards: int) -> DataFrame:
    """(chunk, blob, own): for every segment a chunk sent, runs of windows with
    one smallest document (segment number, windows, document)."""

    def run(batches):
        for shard, rows in numbers(batches):
            sent = [(chunk, blob) for chunk, blob, own in rows if not own]
            yield own_places(rows)
            if not sent:
                continue
            known: dict[bytes, int] = {}
            least: list[int] = []
            several: list[int] = []
            which = []
            for _, blob in sent:
                lens, docs, many, raw = expand(blob)
                body, at, mine = raw.tobytes(), 0, []
                for length, d, m in zip(lens.tolist(), docs.tolist(), many.tolist()):
                    t = body[at : at + length]
                    at += length
                    j = known.setdefault(t, len(least))
                    if j == len(least):
                        least.append(d)
                        several.append(m)
                    elif d != least[j]:
                        least[j] = min(d, least[j])
                        several[j] = 1
                    mine.append(j)
                which.append(np.array(mine, np.int64))
            lens = np.array([len(t) for t in known], np.int64)
            raw = np.frombuffer(b"".join(known), np.uint8)
            del known
            doc = least_owners(raw, lens, np.array(least, np.int64), np.array(several, bool), k)
            runs, size, val = answer_runs(lens - k + 1, doc)
            lo = np.cumsum(runs) - runs
            chunks, blobs = [], []
            for (chunk, _), mine in zip(sent, which):
                cnt = runs[mine]
                idx = np.repeat(lo[mine], cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                chunks.append(chunk)
                blobs.append(squeeze(np.array([shard], np.int64), cnt.astype(np.int16), size[idx].astype(np.int16), val[idx]))
            yield answer_rows(chunks, blobs)

    return by_number(segments, "shard", shards).mapInArrow(run, ANSWERED)


SPANS = "array<struct<start:long,end:long>>"
REMOVED = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans {SPANS}"


def apply_removal(joined: DataFrame, k: int) -> DataFrame:
    """The surviving bytes and the removed spans of every document."""
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]

    def run(batches):
        for _, payload, answers, places in rows_of(batches):
            ids, start, stop, raw = _symbols(payload)
            gone = removed_mask(len(raw), ids, stop, places, answers, k) if answers else np.zeros(len(raw), bool)
            rows = [[] for _ in names]
            body, n = raw.tobytes(), 0
            for d, s, e in zip(ids.tolist(), start.tolist(), stop.tolist()):
                g = gone[s:e]
                if g.any():
                    edge = np.flatnonzero(np.diff(np.r_[False, g, False]))
                    spans = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]
                    kept = raw[s:e][~g].tobytes()
                else:
                    spans, kept = [], body[s:e]
                for col, v in zip(rows, (d, e - s, e - s - len(kept), len(spans), kept, spans)):
                    col.append(v)
                n += len(kept)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)

    return joined.mapInArrow(run, REMOVED)


def remove_repeats(docs: DataFrame, k: int = 50, hot_docs: int = HOT_DOCS, chunk_bytes: int | None = None) -> DataFrame:
    """Cut every byte covered by a ``k``-byte string that also starts in a
    document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (bytes that remain),
    spans (removed ranges). Null text counts as empty; texts below ``k`` bytes
    stay whole, long ones are read whole; rows that repeat a doc_id do not remove
    each other; rows without doc_id have no place in the order of documents, they
    stay whole and remove nothing; an empty table gives no rows; extra columns
    are ignored.
    """
    if not GRAM < k < 256:
        raise ValueError(f"k must be above {GRAM} and below 256")
    spark = docs.sparkSession
    chunk_bytes = chunk_bytes or chunk_size(docs)
    chunks = pack_chunks(docs, chunk_bytes)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.count())
    shards = shard_count(n, chunk_bytes)
    shared = shared_anchors(find_anchors(chunks, k, n), hot_docs, n)
    # one shuffle of the chunks serves both passes over them
    base = chunks.join(shared, "chunk", "left").select("chunk", "payload", "shared")
    answers = by_chunk(index_shards(send_segments(base, k, n, shards), k, shards))
    joined = chunks.join(answers, "chunk", "left").select("chunk", "payload", "answers", "places")
    raw, none = F.col("text").cast("binary"), F.lit(0).cast("long")
    whole = docs_of(docs).where("doc_id is null").select(
        "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), raw.alias("kept"), F.array().cast(SPANS).alias("spans")
    )
    return apply_removal(joined, k).unionByName(whole)


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
m AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT g.doc_id, g.i, g.i - lag(g.i) OVER (PARTITION BY g.doc_id ORDER BY g.i) AS step FROM g JOIN m USING (s) WHERE m.low < g.doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
r AS (SELECT doc_id, k, min(i) AS s0, max(i) + 50 AS e0 FROM run GROUP BY doc_id, k),
p AS (SELECT doc_id, s0, e0, coalesce(lag(e0) OVER (PARTITION BY doc_id ORDER BY s0), 0) AS before FROM r),
k AS (
  SELECT p.doc_id, sum(p.e0 - p.s0) AS gone, count(*) AS spans, max(p.e0) AS last,
    string_agg(substr(d.h, 2 * p.before + 1, 2 * (p.s0 - p.before)), '' ORDER BY p.s0) AS t
  FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(k.gone, 0)::BIGINT AS n_removed, coalesce(k.spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.t, '') || substr(d.h, 2 * coalesce(k.last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
