"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

A CGK random walk reads a string of words with a pointer that a shared random
bit of (step, word) moves on or not; it writes the word read at each step, so
strings at small edit distance become strings at small Hamming distance.
Windows of a third to three fifths of an item's size are taken from the items at every offset
and from the documents at a fixed stride; repeated samples of a few positions
of their embeddings are looked up in sorted tables. Sample width and repeats
are chosen from simulated edits of the items themselves so that windows at the
allowed distance meet with probability ``recall``. Every candidate is verified
by an exact edit distance of the whole item against the document around it.

An item is found in a document if some passage is at word edit distance of at
most ``(1 - similarity)`` times the item's words, words compared without case
and ASCII punctuation.

Scale. One narrow pass over the documents. The item tables are broadcast in
blocks of at most ``block_words`` item words (some tens of MB), one pass a
block, so what is broadcast has a fixed bound however large the benchmark is.
Windows that no passage at the allowed distance can hold are skipped before
embedding: a word of no item costs an edit, so around a window inside a passage
of an item of n words, some n words hold at most as many such words as the item
may have edits.
"""

from __future__ import annotations

import string
import warnings
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import docs_of, map_rows, ship, table
from .passages import gram_hashes, mix

MIN_WORDS = 5
MOST_REPEATS = 512
_DROP = string.punctuation.encode()


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(None, _DROP).split()


def _bits(symbols: np.ndarray, step: int) -> np.ndarray:
    """One shared random bit for each (step, word)."""
    salt = np.uint64((step * 0x9E3779B97F4A7C15 + 0x51ED27) % (1 << 64))
    return (mix(symbols.astype(np.uint64) + salt) >> np.uint64(63)).astype(np.int64)


def cgk_embed(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Embeddings (steps x windows) of the windows words[start : start + size];
    3 * size steps, -1 once the window is used up."""
    at = np.zeros(len(starts), np.int64)
    out = np.empty((3 * size, len(starts)), np.int32)
    for step in range(3 * size):
        inside = at < size
        s = np.where(inside, words[starts + np.minimum(at, size - 1)], -1)
        out[step] = s
        at += np.where(inside, _bits(s + 2, step), 0)
    return out


class SizeClass:
    """Sample tables of all item windows of one size."""

    def __init__(self, size: int, words, starts, owner, offset, items, recall: float, edits: float, rng):
        self.size, self.owner, self.offset = size, owner, offset
        self.spans = self._spans([len(w) for w in items], edits)
        e = cgk_embed(words, starts, size)
        self.width, repeats = self._tune(words, items, recall, edits, rng)
        self.positions = rng.integers(0, 3 * size * 2 // 3, (repeats, self.width))
        self.tables = []
        for r in range(repeats):
            sig = self.signature(e, r)
            order = np.argsort(sig, kind="stable")
            self.tables.append((sig[order], order.astype(np.int32)))

    def _spans(self, lengths, edits):
        """(words, unknown words at most) of the spans of which one must cover a
        window: item lengths within a fifth share the least of them."""
        out = []
        for n in sorted(set(lengths)):
            most = int(edits * n + 1e-9)
            if out and n <= 1.2 * out[-1][0]:
                out[-1] = (out[-1][0], most)
            else:
                out.append((n, most))
        return out

    def possible(self, known, starts):
        """Which windows lie in a span that a passage may be; known: running
        count of known words. Beyond both ends all words are unknown."""
        found = np.zeros(len(starts), bool)
        for n, most in self.spans:
            count = np.r_[np.zeros(n, np.int64), known, np.full(n, known[-1])]
            fits = np.r_[0, np.cumsum(count[n:] - count[:-n] >= n - most)]  # spans by start, from -n
            found |= fits[starts + n + 1] > fits[starts + self.size]
        return found

    def signature(self, embedded, r):
        h = np.full(embedded.shape[1], r + 1, np.uint64)
        for p in self.positions[r]:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (embedded[p] + 2).astype(np.uint64))
        return h

    def _tune(self, words, items, recall, edits, rng):
        """Widest sample, and its repeats, with which edited items are found.

        Items get the allowed share of edits, in each of three ways: scattered
        with words of the items, scattered with words of no item, and a block
        of such words in one place. Their windows at a random phase of the
        stride are compared with the item's own windows, and the share of
        agreeing positions gives the chance of meeting in any window. Each way
        must reach ``recall``; if none of the widths does, repeats are added, and
        a warning gives what was reached. ``possible`` passes all of these windows.
        """
        size, pool, agree = self.size, words[words > 0], ([], [], [])
        for i in rng.permutation(len(items))[:60]:
            ours = cgk_embed(np.r_[items[i], np.zeros(size, np.int32)], np.arange(len(items[i]) - size + 1), size)[: 2 * size]
            for way, out in enumerate(agree):
                w = items[i].tolist()
                n = int(edits * len(w) + 1e-9)  # as many as the verifier admits
                if way == 2:
                    j = int(rng.integers(len(w) - n + 1))
                    w[j : j + n] = [0] * n
                for _ in range(n if way < 2 else 0):
                    kind, j, new = rng.integers(3), int(rng.integers(len(w))), 0 if way else int(rng.choice(pool))
                    if kind == 0:
                        w[j] = new
                    elif kind == 1:
                        w.insert(j, new)
                    elif len(w) > 1:
                        del w[j]
                at = np.arange(int(rng.integers(max(1, size // 4))), len(w) - size + 1, max(1, size // 4))
                if not len(at):
                    at = np.zeros(1, np.int64)
                theirs = cgk_embed(np.array(w + [0] * size, np.int32), at, size)[: 2 * size]
                out.append((theirs[:, :, None] == ours[:, None, :]).mean(0).max(1))
        for width, repeats in ((8, 12), (7, 12), (6, 16), (5, 16), (5, 24), (4, 24), (3, 32), (2, 48), (1, 64)):
            hit = [np.mean([1 - np.prod((1 - a**width) ** repeats) for a in way]) for way in agree]
            if min(hit) >= recall:
                break
        while min(hit) < recall and repeats < MOST_REPEATS:
            repeats += 16
            hit = [np.mean([1 - np.prod((1 - a**width) ** repeats) for a in way]) for way in agree]
        if min(hit) < recall:
            warnings.warn(f"items with windows of {size} words: recall {min(hit):.3f} reached of {recall}", stacklevel=2)
        return width, repeats

    def candidates(self, words, starts):
        """(item number, shift between text and item word, window) of all hits."""
        e = cgk_embed(words, starts, self.size)
        items, shifts, who = [], [], []
        for r, (keys, order) in enumerate(self.tables):
            sig = self.signature(e, r)
            lo, hi = np.searchsorted(keys, sig), np.searchsorted(keys, sig, side="right")
            n = hi - lo
            w = np.repeat(np.arange(len(starts)), n)
            at = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            items.append(self.owner[at])
            shifts.append(starts[w] - self.offset[at])
            who.append(w)
        return np.concatenate(items), np.concatenate(shifts), np.concatenate(who)


def best_passage(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """(distance, start, end) of the passage of ``text`` nearest to ``item``,
    by the bit-parallel edit distance; the first of equals."""

    def scan(pattern, seq, anywhere):
        n, full = len(pattern), (1 << len(pattern)) - 1
        eq: dict[int, int] = {}
        for i, c in enumerate(pattern):
            eq[c] = eq.get(c, 0) | 1 << i
        top = 1 << (n - 1)
        pv, mv, score, best, where = full, 0, n, n, 0
        for j, c in enumerate(seq):
            m = eq.get(c, 0) if c else 0
            xv = m | mv
            xh = (((m & pv) + pv) ^ pv) | m
            ph, mh = mv | (~(xh | pv) & full), pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = (ph << 1 | (not anywhere)) & full, mh << 1 & full
            pv, mv = mh | (~(xv | ph) & full), ph & xv
            if score < best:
                best, where = score, j + 1
        return best, where

    d, end = scan(item, text, True)
    _, back = scan(item[::-1], text[:end][::-1], False)
    return d, end - back, end


class ItemIndex:
    def __init__(self, rows, similarity: float, recall: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.similarity = similarity
        self.ids, self.items, self.vocab = [], [], {}
        short: dict[int, dict] = {}
        for item, text in rows:
            w = words_of(text)
            numbers = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w]
            if len(w) >= MIN_WORDS:
                self.ids.append(item)
                self.items.append(numbers)
            elif w:
                short.setdefault(len(w), {}).setdefault(tuple(numbers), []).append(item)
        self.short = []  # (words, sorted hashes, items by words) of each length below MIN_WORDS
        for n, those in sorted(short.items()):
            hashes = np.concatenate([gram_hashes(np.array(w, np.uint64), n) for w in those])
            self.short.append((n, np.sort(hashes), those))
        by: dict[int, list] = {}
        for i, w in enumerate(self.items):
            by.setdefault(1 << int(0.6 * len(w)).bit_length() - 1, []).append(i)
        self.classes = []
        for size, members in sorted(by.items()):
            words = np.array([x for i in members for x in self.items[i]] + [0] * (2 * size), np.int32)
            lens = np.array([len(self.items[i]) for i in members])
            base = np.cumsum(lens) - lens
            n = lens - size + 1
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(np.array(members, np.int32), n)
            self.classes.append(SizeClass(size, words, np.repeat(base, n) + offset, owner, offset, [np.array(self.items[i], np.int32) for i in members], recall, 1 - similarity, rng))

    def search(self, texts: list[str]) -> list[list[tuple]]:
        """For each text (item_id, distance, item words, start, end) of every
        item found: its nearest passage, positions in words of the text."""
        found: list[list] = [[] for _ in texts]
        if not (self.items or self.short) or not texts:
            return found
        stop, parts = [], []
        for t in texts:
            raw = words_of(t)
            parts.append(np.fromiter(map(self.vocab.get, raw, repeat(0)), np.int32, len(raw)))
        words = np.concatenate(parts)
        stop = np.cumsum([len(p) for p in parts])
        first = np.r_[0, stop[:-1]]
        inside = np.r_[0, np.cumsum(words > 0)]
        for n, hashes, those in self.short:  # no edits are allowed: the words as they are
            h = gram_hashes(words.astype(np.uint64), n)
            at = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h)
            doc = np.searchsorted(stop, at, side="right")
            at, doc = at[at + n <= stop[doc]], doc[at + n <= stop[doc]]
            # the first place of each phrase in each text
            _, once = np.unique(np.stack([doc.astype(np.uint64), h[at]]), axis=1, return_index=True)
            for d, a in zip(doc[once].tolist(), at[once].tolist()):
                a, phrase = a - int(first[d]), tuple(words[a : a + n].tolist())
                found[d] += [(item, 0, n, a, a + n) for item in those.get(phrase, ())]
        spots: dict[tuple, set] = {}
        for c in self.classes:
            step = max(1, c.size // 4)
            n = np.maximum(0, (stop - first - c.size) // step + 1)
            rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts = np.repeat(first, n) + rel * step
            starts = starts[c.possible(inside, starts)]
            near = max(1, c.size // 2)
            for at in range(0, len(starts), 20_000):
                part = starts[at : at + 20_000]
                item, shift, who = c.candidates(words, part)
                doc = np.searchsorted(stop, part[who], side="right")
                hits = np.unique(np.stack([doc, item, (shift - first[doc]) // near]), axis=1)
                for d, i, s in hits.T.tolist():
                    spots.setdefault((d, i), set()).add(s * near)
        for (d, i), shifts in sorted(spots.items()):
            w, text = self.items[i], parts[d]
            most = int((1 - self.similarity) * len(w) + 1e-9)
            best, held = None, set(w)
            for s in sorted(shifts):
                lo = max(0, s - most - len(w) // 4)
                hi = max(lo, s + 2 * len(w) + most)
                around = text[lo:hi].tolist()
                # all but ``most`` words of the item must be there, each in a place of its own
                if sum(map(set(around).__contains__, w)) < len(w) - most or sum(map(held.__contains__, around)) < len(w) - most:
                    continue
                e, a, b = best_passage(w, around)
                if e <= most and (best is None or e < best[0]):
                    best = (e, a + lo, b + lo)
                    if e == 0:
                        break
            if best:
                found[d].append((self.ids[i], best[0], len(w), best[1], best[2]))
        return found


def _groups(column, words: int = 400_000):
    """Row ranges of a text column holding a bounded amount of text each (a
    single longer text is a range of its own)."""
    start, size = 0, 0
    for i, t in enumerate(column):
        size += len(t.as_py() or "")
        if size >= 6 * words:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(column):
        yield start, len(column)


def item_blocks(benchmark: DataFrame, block_words: int, **how):
    """Indexes over blocks of items; each block's size is bounded."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    items = items.withColumn("n", F.size(F.split("text", r"\s+")))
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-2 * total // block_words))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = sorted((r["item_id"], r["text"]) for r in part.select("item_id", "text").collect())
        if rows:
            yield ItemIndex(rows, **how)


MATCH = "doc_id long, item_id long, distance int, item_words int, start int, end int, similarity double"


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95, block_words: int = 200_000) -> DataFrame:
    """One row for each document and item found in it (its nearest passage).

    Items below five words are found by the same words in a row, without edits;
    items without words are in no document. Of passages at equal distance one is
    reported. Null and empty texts hold no item; texts are read whole, however
    long; rows that repeat a doc_id, or have none, are searched each on their own,
    and so are repeated items; an empty table on either side gives no rows; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    texts, out = docs_of(docs), spark.createDataFrame([], MATCH)
    for index in item_blocks(benchmark, block_words, similarity=similarity, recall=recall):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            idx = shared.value
            for b in batches:
                ids, rows = b.column(0).to_pylist(), []
                for lo, hi in _groups(b.column(1)):
                    got = idx.search(b.column(1)[lo:hi].to_pylist())
                    rows += [(d, *m, 1 - m[1] / m[2]) for d, ms in zip(ids[lo:hi], got) for m in ms]
                cols = list(zip(*rows)) or [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                names = ["doc_id", "item_id", "distance", "item_words", "start", "end", "similarity"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        out = out.unionByName(texts.mapInArrow(run, MATCH))
    return out


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, column: str = "contaminated", similarity: float = 0.8, recall: float = 0.95, block_words: int = 200_000) -> DataFrame:
    """``docs`` with all its rows and columns and a flag, which must be a new name:
    holds some item. Null and empty texts hold none; repeated rows are flagged
    alike; an empty table stays empty, and no item flags no row."""
    spark = docs.sparkSession
    ship(spark)
    at, schema = docs.columns.index("text"), StructType([*docs.schema.fields, StructField(column, BooleanType())])
    out = docs.withColumn(column, F.lit(False))
    for index in item_blocks(benchmark, block_words, similarity=similarity, recall=recall):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            idx = shared.value
            for b in batches:
                old = b.column(b.num_columns - 1).to_pylist()
                new = []
                for lo, hi in _groups(b.column(at)):
                    got = idx.search([t or "" for t in b.column(at)[lo:hi].to_pylist()])
                    new += [f or bool(ms) for f, ms in zip(old[lo:hi], got)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, pa.bool_())], names=schema.names)

        out = map_rows(out, run, schema)
    return out


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
