"""Removal of repeated word windows by a distributed suffix merge sort.

Candidates are windows of ``k`` words whose minimiser (five words) recurs in
another document (see ``passages``); other windows cannot repeat. A chunk sends
them, by minimiser, to shards as sorted suffix runs: the text once, and for each
suffix (cut at ``k`` words) in sorted order where it starts in the text and how
long a prefix it shares with its predecessor, so a run is front-coded without
repeating text. A shard merges its runs with a loser tree that carries the known
common prefix of every loser with the last winner: a longer known prefix decides
without looking at text, and equal ones compare only what follows. Equal
neighbours in the merged order are equal windows; the smallest document among
them goes back to the chunks.

Runs are dealt by minimiser, not by ranges of the sorted order: equal windows
still meet, in one shard, and no order over all shards is needed or made.

Scale. A chunk sends each distinct segment once, so copies cost one entry a
chunk; an anchor found in more than ``hot_docs`` documents is spread window by
window over all shards. Nothing grows beyond a chunk or a shard.
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
)

GRAM = 5
HOT_DOCS = 2000


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be at least ``at``."""
    n = min(len(a), len(b))
    step = 32
    while at < n:
        if a[at : at + step] == b[at : at + step]:
            at += step
        elif step == 1:
            return at
        else:
            step //= 4 if step == 32 else 8
    return n


def suffix_run(segments: list[bytes], k: int):
    """The sorted run of all k-word suffixes of the segments: where each starts
    in the joined text, its length, the prefix shared with its predecessor; and
    the number of suffixes of each segment."""
    starts, lens, windows, base = [], [], [], 0
    for s in segments:
        words = s.split(b" ")
        at, edge = base, [base]
        for w in words:
            at += len(w) + 1
            edge.append(at)
        n = len(words) - k + 1
        starts += edge[:n]
        lens += [e - b - 1 for b, e in zip(edge[:n], edge[k:])]
        windows.append(n)
        base += len(s) + 1
    body = b"\n".join(segments)
    texts = [body[b : b + n] for b, n in zip(starts, lens)]
    order = sorted(range(len(texts)), key=texts.__getitem__)
    shared, last = [], b""
    for i in order:
        t = texts[i]
        shared.append(common_prefix(last, t))
        last = t
    o = np.array(order, np.int64)
    return body, np.array(starts, np.int32)[o], np.array(lens, np.int32)[o], np.array(shared, np.int32), o, np.array(windows, np.int64)


def repeating(parts: list[tuple]) -> list[np.ndarray]:
    """For each sorted run (text, starts, lengths, ...), where it has suffixes
    whose hash another suffix of the shard has: the others, met by chance of one
    anchor, need no merge. This prunes only, the merge decides."""
    h = np.array([hash(body[s : s + n]) for body, starts, lens, *_ in parts for s, n in zip(starts.tolist(), lens.tolist())], np.int64)
    order = np.argsort(h)
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]][: len(s)]
    twice = np.zeros(len(h), bool)
    twice[order] = ~(new & np.r_[new[1:], True][: len(s)])
    return [np.flatnonzero(x) for x in np.split(twice, np.cumsum([len(p[1]) for p in parts])[:-1])]


def thin(keep: np.ndarray, starts, lens, shared, docs):
    """The run of some suffixes of a run: each shares with the one before it the
    least of what the suffixes between them share."""
    if len(keep):
        shared = np.minimum.reduceat(shared[: keep[-1] + 1], np.r_[0, keep[:-1] + 1])
    return starts[keep], lens[keep], shared[: len(keep)], docs[keep]


class Run:
    """A sorted run under merge. ``known``: what the head shares with the last
    suffix merged, -1 once the run is used up."""

    __slots__ = ("body", "starts", "lens", "shared", "docs", "at", "n", "text", "known", "answer")

    def __init__(self, body: bytes, starts, lens, shared, docs):
        self.body, self.starts, self.lens, self.shared, self.docs = body, starts.tolist(), lens.tolist(), shared.tolist(), docs.tolist()
        self.at, self.n, self.text, self.known = -1, len(self.starts), b"", 0
        self.answer = [0] * self.n
        self.step()

    def step(self):
        self.at = at = self.at + 1
        if at == self.n:
            self.known = -1
            return
        s = self.starts[at]
        self.text = self.body[s : s + self.lens[at]]
        self.known = self.shared[at]


def merge(runs: list[Run]):
    """Yield the run whose head is next in sorted order; its ``known`` is what
    that head shares with the suffix yielded before.

    A loser tree: each inner node keeps the loser of its match. All ``known``
    values on the winner's path refer to the last winner, so the longer one is
    the smaller suffix and equal ones need only bytes beyond the prefix.
    """
    size = 1
    while size < len(runs):
        size *= 2
    lanes = runs + [None] * (size - len(runs))

    def match(a, b):
        """(winner, loser)."""
        if a is None or a.known < 0:
            return b, a
        if b is None or b.known < 0:
            return a, b
        if a.known != b.known:
            return (a, b) if a.known > b.known else (b, a)
        x, y = a.text, b.text
        if x == y:
            b.known = len(y)
            return a, b
        p = common_prefix(x, y, a.known)
        if p == len(x) or (p < len(y) and x[p] < y[p]):
            b.known = p
            return a, b
        a.known = p
        return b, a

    for r in runs:
        if r.known >= 0:
            r.known = 0
    loser = [None] * size
    lane_of = {id(r): i for i, r in enumerate(runs)}
    level = lanes
    at = size // 2
    while len(level) > 1:
        nxt = []
        for i in range(0, len(level), 2):
            w, other = match(level[i], level[i + 1])
            loser[at + i // 2] = other
            nxt.append(w)
        level, at = nxt, at // 2
    winner = level[0]
    while winner is not None and winner.known >= 0:
        yield winner
        lane = lane_of[id(winner)]
        winner.step()
        node, cur = (lane + size) // 2, winner
        while node:
            other = loser[node]
            if other is not None and other.known >= 0:
                ck, ok = (cur.known if cur is not None else -1), other.known
                if ck < ok:
                    loser[node], cur = cur, other
                elif ck == ok:
                    cur, loser[node] = match(cur, other)
            node //= 2
        winner = cur


def merge_groups(runs: list[Run]) -> None:
    """Give every suffix of every run the smallest document of its equals."""
    group, least, last = [], 0, -1

    for r in merge(runs):
        i = r.at
        if not group or not (r.known == last == len(r.text)):
            for q, j in group:
                q.answer[j] = least
            group, least, last = [], r.docs[i], len(r.text)
        elif r.docs[i] < least:
            least = r.docs[i]
        group.append((r, i))
    for q, j in group:
        q.answer[j] = least


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _words(payload):
    """ids, first word and end word of each document, all words."""
    ids, lens, raw = expand(payload)
    body, at, words, ends = raw.tobytes(), 0, [], []
    for n in lens.tolist():
        words += body[at : at + n].split()
        at += n
        ends.append(len(words))
    stop = np.array(ends, np.int64)
    return ids, np.r_[0, stop[:-1]].astype(np.int64), stop, words


def _runs(stop, words, k):
    return anchor_runs(word_hashes(words), stop, k, min(GRAM, k))


def find_anchors(chunks: DataFrame, k: int, buckets: int) -> DataFrame:
    def run(batches):
        for chunk, payload in rows_of(batches):
            ids, _, stop, words = _words(payload)
            first, _, h = _runs(stop, words, k)
            rows = list(report_anchors(h, ids[np.searchsorted(stop, first, side="right")], buckets))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                names=["bucket", "chunk", "blob"],
            )

    return chunks.mapInArrow(run, "bucket int, chunk long, blob binary")


def segments_of(payload, shared, k: int, buckets: int, shards: int):
    ids, _, stop, words = _words(payload)
    return place_segments(_runs(stop, words, k), shared, ids, stop, k, buckets, shards, lambda s, e: b" ".join(words[s:e]))


def send_runs(joined: DataFrame, k: int, buckets: int, shards: int) -> DataFrame:
    """(shard, chunk, blob, own): the chunk's sorted suffix run for a shard;
    ``own`` rows hold the places of its segments, which a shard hands back as
    they are."""

    def run(batches):
        for chunk, payload, shared in rows_of(batches):
            if not shared:
                continue
            by, places = segments_of(payload, shared, k, buckets, shards)
            rows = []
            for g, (texts, docs, _) in by.items():
                body, starts, lens, pre, order, windows = suffix_run(texts, k)
                small = np.uint16 if len(body) < 65536 else np.int32
                blob = squeeze(
                    starts.astype(small), lens.astype(small), pre.astype(small), order.astype(small),
                    windows.astype(np.int32), np.array(docs, np.int64), np.frombuffer(body, np.uint8),
                )
                rows.append((g, blob))
            yield sent_rows(chunk, rows, places, shards)

    return joined.mapInArrow(run, SENT)


def merge_shards(parts: DataFrame, shards: int) -> DataFrame:
    """(chunk, blob, own): for every segment a chunk sent, runs of windows with one
    smallest document."""

    def run(batches):
        for g, rows in numbers(batches):
            sent = [(chunk, blob) for chunk, blob, own in rows if not own]
            yield own_places(rows)
            if not sent:
                continue
            parts, back = [], []
            for _, blob in sent:
                starts, lens, pre, order, windows, docs, body = expand(blob)
                order = order.astype(np.int64)
                parts.append((body.tobytes(), starts, lens, pre, np.repeat(docs, windows)[order]))
                back.append((order, windows))
            again = repeating(parts)
            runs = [Run(body, *thin(k, starts, lens, pre, docs)) for k, (body, starts, lens, pre, docs) in zip(again, parts)]
            merge_groups(runs)
            blobs = []
            for r, k, (*_, docs), (order, windows) in zip(runs, again, parts, back):
                doc = np.empty(len(order), np.int64)
                doc[order] = docs  # of suffixes that no other equals
                doc[order[k]] = r.answer
                cnt, size, val = answer_runs(windows, doc)
                blobs.append(squeeze(np.array([g], np.int64), cnt.astype(np.int16), size.astype(np.int16), val))
            yield answer_rows([c for c, _ in sent], blobs)

    return by_number(parts, "shard", shards).mapInArrow(run, ANSWERED)


SPANS = "array<struct<start:long,end:long>>"
KEPT = f"doc_id long, n_words long, n_removed long, kept string, spans {SPANS}"


def apply_removal(joined: DataFrame, k: int) -> DataFrame:
    kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = ["doc_id", "n_words", "n_removed", "kept", "spans"]

    def run(batches):
        for _, payload, answers, places in rows_of(batches):
            ids, start, stop, words = _words(payload)
            gone = removed_mask(len(words), ids, stop, places, answers, k) if answers else np.zeros(len(words), bool)
            rows = [[] for _ in names]
            for d, s, e in zip(ids.tolist(), start.tolist(), stop.tolist()):
                g = gone[s:e]
                kept, spans = words[s:e], []
                if g.any():
                    edge = np.flatnonzero(np.diff(np.r_[False, g, False]))
                    spans = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]
                    kept = [x for x, y in zip(kept, g.tolist()) if not y]
                for col, v in zip(rows, (d, e - s, e - s - len(kept), b" ".join(kept).decode(), spans)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)

    return joined.mapInArrow(run, KEPT)


def remove_repeats(docs: DataFrame, k: int = 13, hot_docs: int = HOT_DOCS, chunk_bytes: int | None = None) -> DataFrame:
    """Cut every word covered by a ``k``-word window whose word sequence also
    starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept (the remaining words, joined by a
    space), spans (removed ranges of words). Null text has no words; texts below
    ``k`` words stay whole, long ones are read whole; rows that repeat a doc_id do
    not remove each other; rows without doc_id have no place in the order of
    documents, they stay whole and remove nothing; an empty table gives no rows;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    chunk_bytes = chunk_bytes or chunk_size(docs)
    chunks = pack_chunks(docs, chunk_bytes)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.count())
    shards = shard_count(n, chunk_bytes)
    shared = shared_anchors(find_anchors(chunks, k, n), hot_docs, n)
    # one shuffle of the chunks serves both passes over them
    base = chunks.join(shared, "chunk", "left").select("chunk", "payload", "shared")
    answers = by_chunk(merge_shards(send_runs(base, k, n, shards), shards))
    joined = chunks.join(answers, "chunk", "left").select("chunk", "payload", "answers", "places")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    whole = docs_of(docs).where("doc_id is null").select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(words, " ").alias("kept"), F.array().cast(SPANS).alias("spans")
    )
    return apply_removal(joined, k).unionByName(whole)


def op5_suffixes(spark, sf_dir: str) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s),
r AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN m USING (s) WHERE m.low < g.doc_id),
w AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (
  SELECT w.doc_id, count(*) AS kept, string_agg(w.x, ' ' ORDER BY w.p) AS t
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.p = w.p WHERE r.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.kept, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
