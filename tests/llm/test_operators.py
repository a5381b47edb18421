"""The corpus operators against brute force on small, awkward tables."""


import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skygrid.llm import common, decontamination, embeddings, licenses, packing, passages, pii, quality, sharding, shingles, simhash, substrings, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "Ré", "st") for b in ("n", "rt", "s", "lla", "x", "ü")]


def make(seed=1, n=60):
    rng = random.Random(seed)
    shared = [" ".join(rng.choices(WORDS, k=rng.randint(14, 40))) for _ in range(5)]
    out = []
    for i in range(n):
        t = " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))
        if i % 3 == 0:
            t += "\n" + rng.choice(shared) + " " + rng.choice(WORDS)
        if i % 7 == 0:
            t = rng.choice(shared)
        out.append([i, t])
    out[4][1], out[5][1], out[6][1] = None, "", " \t "
    out[8][1] = out[7][1]
    out[9][1] = " ".join(rng.choices(WORDS, k=4000))  # far longer than the others
    out[10][1] = "x" * 3000
    return [(i, t, None if i % 4 else "en", "s", None) for i, t in out]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns whose names clash with those the operators use inside
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({"fp": F.lit(1), "chunk": F.lit("c"), "shard": F.lit(0), "length": F.lit(None).cast("long"), "part": F.lit(2), "start": F.lit(0)})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def text(r):
    return r[1] or ""


# ---- packing ---------------------------------------------------------------------


def naive_bfd(lengths, window):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        if fit:
            b = min(fit, key=lambda b: bins[b])
            bins[b] -= n
        else:
            bins.append(window - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([16, 50, 101])
    lengths = [rng.randint(1, window) for _ in range(rng.randint(1, 400))]
    plan, windows = packing.plan_windows({n: lengths.count(n) for n in set(lengths)}, window)
    room = {}
    seen = {}
    for length, first, pieces, w0, per, off in plan.tolist():
        assert first == seen.get(length, 0)
        seen[length] = first + pieces
        for i in range(pieces):
            w, at = w0 + i // per, off + i % per * length
            assert window - room.get(w, window) == at
            room[w] = room.get(w, window) - length
    assert windows == len(room) and sorted(room.values()) == naive_bfd(lengths, window)
    assert seen == {n: lengths.count(n) for n in set(lengths)}


def test_segment_tree():
    t = packing.CapacitySegmentTree(40)
    on = set()
    rng = random.Random(0)
    for _ in range(300):
        c = rng.randint(0, 40)
        t.put(c, c not in on)
        on ^= {c}
        least = rng.randint(0, 40)
        assert t.tightest(least) == min((x for x in on if x >= least), default=-1)


def test_packing_round_trip(docs, rows, nothing):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    packed = packing.pack(docs, window=64)
    got = packed.pieces.toPandas()
    for r in rows:
        ids = np.array([*tok.encode(text(r), add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == r[0]].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        for p in mine.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for _, w in got.groupby("sequence_id"):
        w = w.sort_values("offset")
        assert w.offset.tolist() == [0, *w.length.cumsum().tolist()[:-1]] and w.length.sum() <= 64
    seqs = packed.sequences().toPandas()
    assert len(seqs) == packed.windows and all(len(x) == (n if n & (n - 1) == 0 else 64) for x, n in zip(seqs.ids, seqs.length))
    assert packing.pack(nothing).pieces.count() == 0


def test_packing_of_added_tokens_and_repeats(spark):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    from skygrid.llm.tokens import Encoder

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", " <|endoftext|>\n", "", "plain"]
    for t in texts:
        assert Encoder()(t).tolist() == tok.encode(t, add_special_tokens=False).ids
    assert 50256 in Encoder()(texts[0]) and 50256 not in Encoder(plain=True)(texts[0])
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[0]), (2, None), (3, "x" * 5000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=64).pieces.toPandas()
    ids = np.array([*tok.encode(texts[0], add_special_tokens=False).ids, 0], "<u4")
    same = got[got.ids_crc32 == zlib.crc32(ids.tobytes())]
    assert len(same) == 3 and same.doc_id.isna().sum() == 1 and not same.duplicated(["sequence_id", "offset"]).any()
    assert got[got.doc_id == 2].length.tolist() == [1]


# ---- substrings and word windows ----------------------------------------------------


def brute_bytes(rows, k):
    first = {}
    raw = {r[0]: text(r).encode() for r in rows}
    for d in sorted(raw):
        for i in range(len(raw[d]) - k + 1):
            first.setdefault(raw[d][i : i + k], d)
    out = {}
    for d, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - k + 1):
            if first[b[i : i + k]] < d:
                gone[i : i + k] = True
        out[d] = bytes(x for x, g in zip(b, gone) if not g)
    return out


@pytest.mark.parametrize("k,hot,chunk", [(50, 2000, 4_000_000), (50, 2, 3000), (20, 3, 2000)])
def test_substrings(docs, rows, k, hot, chunk):
    got = {r.doc_id: bytes(r.kept) for r in substrings.remove_repeats(docs, k, hot, chunk).collect()}
    assert got == brute_bytes(rows, k)


@pytest.mark.parametrize("k,hot,chunk", [(13, 2000, 4_000_000), (13, 2, 3000), (6, 3, 2000)])
def test_word_windows(docs, rows, k, hot, chunk):
    split = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", text(r)) for r in rows}
    first = {}
    for d in sorted(split):
        for i in range(len(split[d]) - k + 1):
            first.setdefault(tuple(split[d][i : i + k]), d)
    want = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        want[d] = " ".join(x for x, g in zip(w, gone) if not g)
    got = suffixes.remove_repeats(docs, k, hot, chunk).toPandas()
    assert dict(zip(got.doc_id, got.kept)) == want


def test_passages_edge_tables(spark, nothing):
    for mod in (substrings, suffixes):
        assert mod.remove_repeats(nothing).count() == 0
        t = " ".join(WORDS)
        twice = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None)], "doc_id long, text string")
        assert sorted((str(r.doc_id), r.n_removed) for r in mod.remove_repeats(twice).collect()) == [("1", 0), ("1", 0), ("2", 0), ("None", 0)]
        nulls = mod.remove_repeats(spark.createDataFrame([(None, f" {t}\t{t} "), (None, None)], "doc_id long, text string")).collect()
        assert sorted(bytes(r.kept, "utf-8") if isinstance(r.kept, str) else bytes(r.kept) for r in nulls) == [b"", f"{t} {t}".encode() if mod is suffixes else f" {t}\t{t} ".encode()]


def symbols(text: bytes):
    return np.frombuffer(text, np.uint8).astype(np.int64) + 1


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("k", [4, 8, 11])
def test_matching_of_texts_outside_the_index(seed, k):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 3, rng.integers(1, 30)).astype(np.uint8).tobytes() for _ in range(40)]
    index = substrings.FMIndex(np.concatenate([np.r_[symbols(t), 0] for t in texts]), k)
    whole = b"\xff".join(texts) + b"\xff"
    queries = [rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint8).tobytes() for _ in range(60)]
    queries += [texts[3] + b"\x07" + texts[4], texts[5][:5] + texts[6]]
    assert not any(q in whole for q in queries[-2:])
    lens = np.array([len(q) for q in queries])
    ends = np.cumsum(lens)
    got = {(w, int(a)): g for who, at, group in index.matching(symbols(b"".join(queries)), ends - lens, ends) for w, a, g in zip(who.tolist(), at, group.tolist())}
    first = {whole[i : i + k]: index.home[i] for i in range(len(whole) - k + 1)}
    want = {(w, int(e - n) + i): first[q[i : i + k]] for w, (q, n, e) in enumerate(zip(queries, lens, ends)) for i in range(len(q) - k + 1) if q[i : i + k] in first}
    assert got == want and (want or k == 11)


def test_index_is_compact():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(98, 123, 400_000), 0)
    text[200_000:300_000] = text[:100_000]
    fm = substrings.FMIndex(text, 50)
    held = sum(x.nbytes for _, b in fm.tree.levels for x in (b.words, b.before)) + sum(x.nbytes for x in fm.prefix.levels) + fm.begins.words.nbytes + fm.begins.before.nbytes
    assert held < 4 * len(text)


@pytest.mark.parametrize("seed", range(8))
def test_least_owners(seed):
    rng = np.random.default_rng(seed)
    k, texts = 6, list(dict.fromkeys(rng.integers(97, 99, rng.integers(6, 14)).astype(np.uint8).tobytes() for _ in range(60)))
    least, several = rng.integers(0, 40, len(texts)), rng.random(len(texts)) < 0.2
    lens = np.array([len(t) for t in texts])
    got = substrings.least_owners(np.frombuffer(b"".join(texts), np.uint8), lens, least, several, k)
    low = {}
    for t, d in zip(texts, least.tolist()):
        for i in range(len(t) - k + 1):
            low[t[i : i + k]] = min(d, low.get(t[i : i + k], d))
    assert got.tolist() == [low[t[i : i + k]] for t in texts for i in range(len(t) - k + 1)]
    index, stream = substrings.split_stretches(np.frombuffer(b"".join(texts), np.uint8), lens, lens - k + 1, k)
    assert index.any() and stream.any() and not (index & stream).any()


def test_chunks_grow_with_the_root_of_the_corpus(spark):
    assert passages.chunk_size(spark.createDataFrame([("abc",), (None,)], "text string")) == passages.CHUNK_BYTES
    big = spark.range(3).select(F.lit("x" * 1000).alias("text"))
    assert passages.chunk_size(big.crossJoin(spark.range(10**6))) == passages.CHUNK_BYTES


class Here:
    """Stands for a frame: hands out the function instead of a plan."""

    def mapInArrow(self, run, schema):
        return run


def test_tasks_of_substrings_need_little_memory():
    """Above their input, by byte of text: chunks of one batch are looked at one by one, in tiles."""
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 123, 1 << 20).astype(np.uint8)
    payload = passages.squeeze(np.arange(1 << 10), np.full(1 << 10, 1 << 10), raw)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([payload] * 4, pa.binary())], names=["chunk", "payload"])
    find = substrings.find_anchors(Here(), 50, 8)
    lens = np.full(1 << 13, 64)
    shard = raw[: 1 << 19].copy()
    shard[1 << 18 : 1 << 19] = shard[: 1 << 18]
    peaks = []
    for work in (lambda: [b.num_rows for b in find([batch])], lambda: substrings.least_owners(shard, lens, np.arange(1 << 13), np.zeros(1 << 13, bool), 50)):
        work()
        tracemalloc.start()
        work()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[0] < 20 * len(raw), peaks
    assert peaks[1] < 60 * len(shard), peaks


def test_places_return_as_sent():
    rng = np.random.default_rng(5)
    shard, first = rng.integers(0, 7, 300), rng.permutation(10**6)[:300]
    number = np.zeros(300, np.int64)
    for g in range(7):
        here = np.flatnonzero(shard == g)
        number[here] = np.r_[np.arange(len(here) - 3), rng.integers(0, 3, 3)]
    back = passages.unpack_places(passages.pack_places(shard, number, first))
    assert sorted(zip(*(x.tolist() for x in back))) == sorted(zip(shard.tolist(), number.tolist(), first.tolist()))
    assert all(not len(x) for x in passages.unpack_places(passages.pack_places(*[np.zeros(0, np.int64)] * 3)))


@pytest.mark.parametrize("mod,k", [(substrings, 50), (suffixes, 13)])
def test_removal_does_not_look_for_anchors_again(mod, k, monkeypatch):
    t = " ".join(WORDS).encode()
    payload = passages.squeeze(np.arange(3), np.full(3, len(t)), np.frombuffer(t * 3, np.uint8))
    sent = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([payload], pa.binary())], names=["chunk", "payload"])
    reports = [r for b in mod.find_anchors(Here(), k, 1)([sent]) for r in b.to_pylist()]
    shared = [passages.squeeze(passages.expand(r["blob"])[0].astype(np.uint64), np.zeros(len(passages.expand(r["blob"])[0]), np.uint8)) for r in reports]
    monkeypatch.setattr(passages, "by_number", lambda rows, *_: rows)
    monkeypatch.setattr(mod, "by_number", lambda rows, *_: rows)
    send, answer = (mod.send_segments, lambda: mod.index_shards(Here(), k, 1)) if mod is substrings else (mod.send_runs, lambda: mod.merge_shards(Here(), 1))
    parts = list(send(Here(), k, 1, 1)([pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([payload], pa.binary()), pa.array([shared])], names=["chunk", "payload", "shared"])]))
    back = [r for b in answer()(parts) for r in b.to_pylist()]
    answers, (places,) = [r["blob"] for r in back if not r["own"]], [r["blob"] for r in back if r["own"]]
    monkeypatch.setattr(mod, "anchor_runs", None)
    joined = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([payload], pa.binary()), pa.array([answers]), pa.array([places], pa.binary())], names=["chunk", "payload", "answers", "places"])
    (out,) = mod.apply_removal(Here(), k)([joined])
    size = len(t) if mod is substrings else len(WORDS)
    assert out.column("n_removed").to_pylist() == [0, size, size]


def test_packets_between_chunks_do_not_shrink_with_the_corpus():
    """Chunks times shards is what a corpus sends; each packet has a fixed cost."""

    class Texts:
        def __init__(self, total):
            self.total = total

        def agg(self, _):
            return self

        def first(self):
            return [self.total]

    for total in (10**9, 10**10, 5 * 10**10, 10**11, 10**12):
        size = passages.chunk_size(Texts(total))
        chunks = -(-total // size)
        shards = passages.shard_count(chunks, size)
        assert size <= 16_000_000 and total / shards <= 8_000_000 + 1
        assert total > 5 * 10**10 or total / (chunks * shards) > 1900
    assert passages.chunk_size(Texts(10**14)) == 100_000_000


@pytest.mark.parametrize("seed", range(5))
def test_loser_tree_merges_in_order(seed):
    rng = random.Random(seed)
    runs, want = [], []
    for _ in range(rng.randint(1, 9)):
        segs = [" ".join(rng.choices("ab", k=rng.randint(3, 9))).encode() for _ in range(rng.randint(1, 6))]
        body, starts, lens, shared, order, windows = suffixes.suffix_run(segs, 3)
        want += [body[s : s + n] for s, n in zip(starts, lens)]
        runs.append(suffixes.Run(body, starts, lens, shared, np.arange(len(starts))))
    got, last = [], b""
    for r in suffixes.merge(runs):
        assert r.known == suffixes.common_prefix(last, r.text)
        got.append(last := r.text)
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(8))
def test_only_repeating_suffixes_are_merged(seed):
    rng = random.Random(seed)
    parts, texts = [], []
    for _ in range(rng.randint(1, 6)):
        segs = [" ".join(rng.choices("abcd", k=rng.randint(3, 9))).encode() for _ in range(rng.randint(1, 6))]
        body, starts, lens, shared, *_ = suffixes.suffix_run(segs, 3)
        parts.append((body, starts, lens, shared, np.arange(len(starts))))
        texts.append([body[s : s + n] for s, n in zip(starts, lens)])
    count = Counter(t for ts in texts for t in ts)
    for keep, ts, (body, starts, lens, shared, docs) in zip(suffixes.repeating(parts), texts, parts):
        assert [ts[i] for i in keep] == [t for t in ts if count[t] > 1]
        starts, lens, shared, docs = suffixes.thin(keep, starts, lens, shared, docs)
        assert docs.tolist() == keep.tolist() and [body[s : s + n] for s, n in zip(starts, lens)] == [ts[i] for i in keep]
        assert shared.tolist()[1:] == [suffixes.common_prefix(ts[a], ts[b]) for a, b in zip(keep, keep[1:])] and len(shared) == len(keep)


def test_packed_arrays():
    a, b = np.arange(5, dtype=np.uint16), np.zeros(0, np.int64)
    x, y = passages.expand(passages.squeeze(a, b))
    assert x.tolist() == a.tolist() and x.dtype == a.dtype and not len(y)


# ---- near-duplicates ---------------------------------------------------------------


def brute_components(values, linked):
    n = len(values)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if label[j] < label[i] and linked(values[i], values[j]):
                    label[i], changed = label[j], True
    return label


def plain_fingerprint(t, size=3):
    """The contract's fingerprint, one bit at a time."""
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, rows, nothing):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {r[0]: plain_fingerprint(text(r)) for r in rows}
    assert {d: f % (1 << 64) for d, (f, _) in got.items()} == fps and fps[4] == fps[5] == fps[6] == 0
    ids = sorted(fps)
    label = brute_components([fps[i] for i in ids], lambda a, b: bin(a ^ b).count("1") <= 3)
    assert {i: got[i][1] for i in ids} == {i: ids[k] for i, k in zip(ids, label)}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}
    some = spark.createDataFrame([(5, "A b c d"), (5, "a B c d"), (3, "a b C d"), (None, "a b c d"), (None, "other"), (9, "zz yy xx")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(some).collect()) == [("3", "3"), ("5", "3"), ("5", "3"), ("9", "9"), ("None", "3"), ("None", "None")]
    clash = some.withColumn("simhash", F.lit("kept")).withColumn("_simhash", F.lit(1)).withColumn("key", F.lit(2))
    assert simhash.keep_one(clash).columns == clash.columns and simhash.keep_one(clash).where("simhash = 'kept'").count() == 4


def test_links_come_from_the_trees(spark):
    visits = spark.sparkContext.accumulator(0)
    table = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    long = table.where(F.length("text") > 4000).select(F.col("doc_id") + 10**6, F.concat("text", F.lit(" more")))
    got = simhash.near_duplicates(table.union(long), visits=visits).collect()
    fps = np.array(sorted({r.fp for r in got}), np.int64).view(np.uint64)
    assert len(fps) < visits.value < len(fps) ** 2 / 3  # every fingerprint walks the tree, and leaves most of it out
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    label = np.arange(len(fps))
    while (low := np.where(near, label[None], len(fps)).min(1)).tolist() != label.tolist():
        label = low
    at = {int(f): i for i, f in enumerate(fps)}
    least = {}
    for r in got:
        k = label[at[r.fp % (1 << 64)]]
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == least[label[at[r.fp % (1 << 64)]]] for r in got) and len(least) < len(fps)


def test_bk_tree_and_shards(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (60, 12), dtype=np.uint64)
    values = np.unique(np.r_[base, (base[:, None] ^ flips).ravel(), base[:30] ^ flips[:30, 0] ^ flips[:30, 1] ^ flips[:30, 2]])
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 3
    tree = simhash.BKTree(values)
    got = {(q, m) for a, b in tree.search(values, 3) for q, m in zip(a.tolist(), b.tolist())}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near))))
    assert sorted(tree.member.tolist()) == list(range(len(values)))
    for n in (0, 1, 2):
        assert sum(len(a) for a, _ in simhash.BKTree(values[:n]).search(values[:3], 64)) == 3 * n
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    label = brute_components(values.tolist(), lambda a, b: bin(a ^ b).count("1") <= 3)
    signed = values.view(np.int64).tolist()
    group = lambda f: sorted(sorted(x) for x in _groups(f))
    for cap in (20_000, 40, 2):  # one shard, keyed shards, shards split again and again
        roots = {r.node: r.root for r in common.components(simhash.links(frame, 3, cap)).collect()}
        assert group({v: roots.get(v, v) for v in signed}) == group({v: label[i] for i, v in enumerate(signed)})


def _groups(of):
    by = {}
    for k, v in of.items():
        by.setdefault(v, []).append(k)
    return by.values()


def test_near_copies_against_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(11)
    vocab, line = [f"w{i}" for i in range(3000)], " ".join(f"common{i}" for i in range(12))
    rows = []
    for i in range(40):
        base = rng.choices(vocab, k=rng.randint(6, 150))
        for k in (0, 0, 1, 2, 3, 5):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w) + (" " + line if i % 3 == 0 else "")))
    rows += [(900, ""), (901, None), (902, "one two"), (903, "One  two"), (7, rows[100][1]), (7, rows[100][1]), (None, "one two")]
    grams = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for w in ((t or "").lower().split() for _, t in rows)]
    live = [i for i, r in enumerate(rows) if r[0] is not None]
    root = {i: i for i in live}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in live:
        for b in live:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) - 1e-9:
                x, y = top(a), top(b)
                x, y = sorted((x, y), key=lambda i: rows[i][0])
                root[y] = x
    want = sorted([str(rows[min((j for j in live if top(j) == i), key=lambda j: rows[j][0])][0]) for i in live if top(i) == i] + ["None"])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert got == want and 40 < len(want) < len(rows)
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0


def test_keep_one_with_a_repeated_doc_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(7, a), (7, b), (9, b)], "doc_id long, text string")
    for keep in (simhash.keep_one, shingles.keep_one):
        assert sorted(map(tuple, keep(docs).collect())) == [(7, a), (7, b)]


def test_components_on_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 51: 50}


def brute_links(vecs, cosine=0.95):
    """(links, smallest row number reachable) of every vector."""
    n, links, label = len(vecs), np.zeros(len(vecs), int), np.arange(len(vecs))
    near = np.zeros((n, n), bool)
    for d in {len(v) for v in vecs}:
        at = np.array([i for i, v in enumerate(vecs) if len(v) == d])
        x = np.array([vecs[i] for i in at], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    links = near.sum(1)
    np.fill_diagonal(near, True)
    while (low := np.where(near, label[None], n).min(1)).tolist() != label.tolist():
        label = low
    return links, label


def same_as_brute(got, vecs):
    links, label = brute_links(vecs)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], label[i], label[i] == i) for i in range(len(vecs))}
    return links


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    near = base[rng.integers(0, 40, 80)] + rng.normal(scale=0.08, size=(80, 16))
    vecs = [v.astype(np.float32).tolist() for v in np.r_[base, near, near[:5]]]
    rows = [(i, v, 0) for i, v in enumerate(vecs)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, [1.0] * 3, 0), (905, [], 0), (906, [float("inf")] + [1.0] * 15, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("node", "x", "low", "copies", "kept", "e", "ok")})
    got = {r.vec_id: r for r in embeddings.near_duplicates(table, tile=16, leaf_rows=8).collect()}
    same_as_brute([got[i] for i in range(len(vecs))], vecs)
    for i in range(900, 907):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    vecs = [rng.normal(size=d).tolist() for d in (16,) * 6 + (8,) * 3 + (2,)]
    vecs += [vecs[6], vecs[6], vecs[0], vecs[9], vecs[9] + [0.0] * 6]
    docs = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    assert same_as_brute(embeddings.near_duplicates(docs).collect(), vecs)[10] == 2


def test_embeddings_at_the_threshold(spark):
    """Pairs of exactly the threshold in every direction, and pairs a hair below."""
    s = np.sqrt(1 - 0.95**2)
    vecs = []
    for k in range(0, 16, 2):
        a, b, c = np.zeros(16), np.zeros(16), np.zeros(16)
        a[k], b[k], b[k + 1], c[k], c[k + 1] = 1, 0.95, s, 0.95 - 1e-9, -s
        vecs += [a.tolist(), b.tolist(), c.tolist()]
    links, _ = brute_links(vecs)
    assert same_as_brute(embeddings.near_duplicates(spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")).collect(), vecs).sum() == links.sum() >= 16


def test_embeddings_in_many_leaves_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 24))
    x = np.r_[rng.normal(size=(1500, 24)), centres[rng.integers(0, 12, 1500)] + rng.normal(scale=0.25, size=(1500, 24)), centres[0] + rng.normal(scale=0.1, size=(300, 24))]
    vecs = x.astype(np.float32).tolist()
    monkeypatch.setattr(embeddings.math, "isqrt", lambda n: 1)  # leaves as for far more rows
    monkeypatch.setattr(embeddings, "SMALL", 32)
    seen = []
    plan = embeddings.plan_tiles
    monkeypatch.setattr(embeddings, "plan_tiles", lambda d, space, tile: seen.append(space) or plan(d, space, tile))
    got = embeddings.near_duplicates(spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>"), tile=200, leaf_rows=100).collect()
    assert same_as_brute(got, [np.float64(v) for v in x.astype(np.float32)]).max() > 200
    tree = seen[0].trees[0]
    assert len(tree.lo) == 64 and np.isfinite(tree.least[tree.least <= tree.most]).all()  # exact boxes


def test_repeated_and_missing_vector_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0]), (3, [1e200, 1e198]), (4, [-0.0, -1.0])]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [("1", 1, "1"), ("1", 2, "1"), ("2", 1, "1"), ("3", 2, "1"), ("4", 0, "4"), ("None", 0, "None"), ("None", 2, "1")]


# ---- decontamination, licences, personal data -------------------------------------------


def test_edit_distance():
    rng = random.Random(1)

    def full(p, t):
        prev = list(range(len(t) + 1))
        for i, c in enumerate(p, 1):
            cur = [i]
            for j, e in enumerate(t, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != e)))
            prev = cur
        return prev[-1]

    for _ in range(150):
        p, t = [rng.randint(1, 4) for _ in range(rng.randint(1, 8))], [rng.randint(1, 4) for _ in range(rng.randint(0, 10))]
        want = min(full(p, t[a:b]) for a in range(len(t) + 1) for b in range(a, len(t) + 1))
        d, a, b = decontamination.best_passage(p, t)
        assert d == want == full(p, t[a:b])


def test_decontamination(spark, docs, rows):
    rng = random.Random(9)
    fresh = [f"{a}{b}" for a in "qzjw" for b in ("op", "ul", "ax", "ir", "em")]
    items = [(i, " ".join(rng.choices(fresh, k=rng.randint(15, 50)))) for i in range(12)] + [(90, "too short"), (91, None)]
    def leak(t, k):
        w = t.split()
        for j in rng.sample(range(len(w)), k):
            w[j] = "edit"
        return "Before all. " + " ".join(w).upper() + "! and after"
    extra = [(1000 + i, leak(t, 0 if i % 2 else len(t.split()) // 10)) for i, t in items[:12]]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_items(table, bench).collect()}
    assert {(1000 + i, i) for i in range(12)} <= found and all(d >= 1000 for d, _ in found)
    small = {(r.doc_id, r.item_id) for r in decontamination.find_items(table, bench, block_words=60).collect()}
    assert small == found
    flags = decontamination.flag_contaminated(table, bench)
    assert {r.doc_id for r in flags.where("contaminated").collect()} == {d for d, _ in found}
    assert decontamination.find_items(table.limit(0), bench).count() == 0
    assert decontamination.find_items(table, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [27, 55, 110])
def test_leaks_with_a_block_of_unknown_words(n):
    rng = random.Random(n)
    items = [[f"w{i}x{j}" for j in range(n)] for i in range(100)]
    index = decontamination.ItemIndex([(i, " ".join(w)) for i, w in enumerate(items)], similarity=0.8, recall=0.95)
    texts, edits = [], int(0.2 * n + 1e-9)
    for w in items:
        j, w = rng.randint(0, n - edits), list(w)
        w[j : j + edits] = ["unknown"] * edits
        texts.append("before " * rng.randint(40, 80) + " ".join(w) + " after" * 60)
    # every window inside the passage passes the filter
    for t in texts:
        words = np.array([index.vocab.get(x, 0) for x in decontamination.words_of(t)])
        first = next(i for i, x in enumerate(decontamination.words_of(t)) if x not in (b"before",))
        known = np.r_[0, np.cumsum(words > 0)]
        for c in index.classes:
            assert c.possible(known, np.arange(first, first + n - c.size + 1)).all()
    found = [any(m[0] == i for m in got) for i, got in enumerate(index.search(texts))]
    assert np.mean(found) >= 0.95


@pytest.mark.parametrize("n", [5, 10, 15])
def test_leaks_at_the_allowed_distance(n):
    rng = random.Random(n)
    items = [[f"w{i}x{j}" for j in range(n)] for i in range(200)]
    index = decontamination.ItemIndex([(i, " ".join(w)) for i, w in enumerate(items)], similarity=0.8, recall=0.95)
    texts = []
    for w in items:
        w = list(w)
        for j in rng.sample(range(n), n // 5):
            w[j] = "unknown"
        texts.append("before " * rng.randint(10, 30) + " ".join(w) + " after" * 20)
    assert np.mean([any(m[0] == i for m in got) for i, got in enumerate(index.search(texts))]) >= 0.95


def edited(w, n, rng, pool):
    """n random edits of a word list: words replaced, put in or left out."""
    w = list(w)
    for _ in range(n):
        kind, j = rng.randrange(3), rng.randrange(len(w))
        if kind == 0:
            w[j] = rng.choice(pool)
        elif kind == 1:
            w.insert(j, rng.choice(pool))
        else:
            del w[j]
    return w


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_items_in_documents_against_brute_force(spark, share):
    """Every item against every document by exact edit distance of its best
    passage: nothing else is found, and of what is there at least 0.9."""
    d = "/root/testdata/sf0.01"
    rng = random.Random(int(share * 100))
    items = [(r.item_id, r.text) for r in common.table(spark, d, "benchmark").orderBy("item_id").limit(60).collect()]
    texts = [r.text for r in common.table(spark, d, "documents").where("length(text) between 300 and 1500").orderBy("doc_id").limit(80).collect()]
    pool = [w for t in texts[:20] for w in t.split()] + ["odd", "strange", "word"]
    rows = list(enumerate(texts))
    for n, (_, t) in enumerate(items):
        w = t.split()
        at = rng.randrange(1, 60)
        host = texts[n % len(texts)].split()
        rows.append((1000 + n, " ".join(host[:at] + edited(w, int(share * len(w)), rng, pool) + host[at:])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.find_items(docs, bench).collect()}
    number: dict = {}
    names = lambda t: [number.setdefault(w, len(number) + 1) for w in decontamination.words_of(t)]
    want = {}
    for i, t in items:
        p = names(t)
        for k, text_ in rows:
            e, _, _ = decontamination.best_passage(p, names(text_))
            if e <= int(0.2 * len(p) + 1e-9):
                want[k, i] = e
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(want) >= len(items) and len(got) >= 0.9 * len(want), (len(got), len(want))


def test_decontamination_edge_tables(spark):
    item = " ".join(f"w{i}" for i in range(20))
    far = "x " * 120_000 + item + " y" * 50
    rows = [(1, item), (1, item), (None, item), (2, None), (3, ""), (4, far)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item_id", "contaminated", "_contaminated", "n", "distance")})
    bench = spark.createDataFrame([(7, item), (7, item), (8, item), (None, item), (9, "")], "item_id long, text string").withColumn("n", F.lit("x"))
    got = sorted((str(r.doc_id), r.item_id, r.start) for r in decontamination.find_items(docs, bench).collect())
    assert got == sorted(2 * [("1", 7, 0), ("1", 7, 0), ("1", 8, 0)] + [("None", 7, 0)] * 2 + [("None", 8, 0)] + [("4", 7, 120_000)] * 2 + [("4", 8, 120_000)])
    flags = decontamination.flag_contaminated(docs, bench, "found")
    assert flags.columns == [*docs.columns, "found"] and sorted(str(r.doc_id) for r in flags.where("found").collect()) == ["1", "1", "4", "None"]


def test_tuning_reports_recall_out_of_reach():
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(20)]
    with pytest.warns(UserWarning, match="recall"):
        decontamination.ItemIndex(rows, similarity=0.8, recall=1.1)


def test_items_below_five_words(spark):
    items = [(1, "Tiny, item!"), (2, "solo"), (3, "one two three four"), (4, "tiny item"), (5, " ... "), (6, None), (7, " ".join(f"w{i}" for i in range(20)))]
    texts = [(10, "a tiny item, then another TINY ITEM"), (11, "solo"), (12, "x one two three four y"), (13, "one two three"), (14, "tiny"), (15, "item solos"), (16, None), (17, items[-1][1])]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(10, 1, 0, 2, 1, 3), (10, 4, 0, 2, 1, 3), (11, 2, 0, 1, 0, 1), (12, 3, 0, 4, 1, 5), (17, 7, 0, 20, 0, 20)}
    for b in (bench, bench.where("item_id < 7")):
        got = {tuple(r)[:6] for r in decontamination.find_items(docs, b).collect()}
        assert got == {w for w in want if b is bench or w[1] < 7}
        assert {r.doc_id for r in decontamination.flag_contaminated(docs, b).where("contaminated").collect()} == {w[0] for w in got}


def test_licenses(spark):
    mit = licenses.TEMPLATES[3][1]
    cases = [(1, "Some words. Released under the MIT License. More"), (2, "x " * 90 + mit.replace("person", "human") + " y" * 50), (3, None), (4, "MIT"), (5, "nothing of this kind here at all"), (6, "Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (2, "MIT"), (6, "CC-BY-NC-4.0")}
    for top, window, stride in licenses.classes():
        assert stride <= window - top + 1


def test_licenses_edge_tables(spark):
    mit = licenses.TEMPLATES[3][1]
    rows = [(1, mit), (1, mit), (None, mit), (2, "word " * 100_000 + mit), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("license", "w", "window", "words", "band", "template", "start")})
    got = [(str(r.doc_id), r.license) for r in licenses.scan(docs).collect()]
    assert set(got) == {("1", "MIT"), ("2", "MIT"), ("None", "MIT")} or set(got) == {("1", "MIT"), ("2", "MIT")}
    assert licenses.scan(docs.limit(0)).count() == 0


PII = [
    "mail a.b+c@x-y.example.com, or d@e.f@g.h no", "a@b..c@d.e", "@@x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.2.3 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 5 41111111111111111111",
    "call +1 (555) 123-4567 or +44 20 7946 0958 +1-2 ++12345678", "é 🙂 x@y.io 🙂 10.0.0.1", "", None, "a" * 5000 + "@b.c", "1" * 5000, "x@y" + ".z" * 9000, "GB82 WEST 1234 5698 7654 32 GB83WEST12345698765432",
    "phone 555-123-4567", "tel: x 555-123-4567 +", "ssn 123-45-6789 then 123-45-6789", "12-34 5-6 7890123456789 0",
]


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15),
}


def test_pii(spark):
    rng = random.Random(4)
    noise = ["".join(rng.choices("a1@.+- (5", k=60)) for _ in range(150)]
    cases = list(enumerate(PII + noise))
    got = {r.doc_id: r.f for r in pii.with_spans(spark.createDataFrame(cases, "doc_id long, text string"), "f").collect()}
    for i, t in cases:
        want = [(k, *m.span()) for k, (p, ok) in BASE.items() for m in re.finditer(p, t or "") if ok(m.group())]
        assert [(s.kind, s.start, s.end) for s in got[i] if s.kind in BASE] == want, t
    assert [s.kind for s in got[12]] == ["iban"] and not got[13] == [] and "localphone" in {s.kind for s in got[13]}
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert clean[6] == "é 🙂 [EMAIL] 🙂 [IP]" and clean[8] is None and clean[7] == ""


def test_pii_edge_tables(spark):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co"), (2, "z" * 200_000 + " a@b.co")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("pii", "_pii", "found", "kind", "start", "end")})
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and sorted(r.text[-9:] for r in clean.collect()) == ["[EMAIL]", "[EMAIL]", "[EMAIL]", "z [EMAIL]"]
    assert clean.where("pii = 'x' and _pii = 'x'").count() == 4 and pii.redact(docs.limit(0)).count() == 0 and pii.with_spans(docs.limit(0)).count() == 0


# ---- sharding, quality -------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_in_bulk(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 100), 7, 33]) for _ in range(300)]
    known = sorted(set(sizes), reverse=True)
    runs, bins = sharding.best_fit_decreasing(known, [sizes.count(s) for s in known], 100)
    load, seen = {}, {}
    for s, n, b in runs:
        load[b] = load.get(b, 0) + s * n
        seen[s] = seen.get(s, 0) + n
    assert max(load.values()) <= 100 and seen == {s: sizes.count(s) for s in known}
    assert sorted(100 - v for v in load.values()) == naive_bfd(sizes, 100) and bins == len(load)
    assert sharding.best_fit_decreasing([5], [1], 4) is None and sharding.equal_bins([], [], 3) == []
    table = sharding.ranges(runs)
    for s, n, b in runs:  # the ranges give back the bins of all ordinals
        k = sum(m for t, m, _ in runs[: [id(r) for r in runs].index(id(next(r for r in runs if r == [s, n, b])))] if t == s)
        row = max(r for r in map(tuple, table.tolist()) if r[:2] <= (s, k))
        assert row[2] == b


def test_sharding(spark, docs, rows, nothing):
    got = sharding.shard_documents(docs, shards=4).toPandas()
    size = {r[0]: len(text(r).encode()) + 1 for r in rows}
    assert dict(zip(got.doc_id, got["size"])) == size
    assert dict(zip(got.doc_id, got.text_crc32)) == {r[0]: zlib.crc32(text(r).encode()) for r in rows}
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    where = dict(zip(got.doc_id, got.shard))
    assert where[7] == where[8] and where[4] == where[5]
    # against brute force: the same loads as one-at-a-time best fit of whole groups at some capacity
    groups = {}
    for r in rows:
        groups[text(r)] = groups.get(text(r), 0) + size[r[0]]
    left, free = sorted(groups.values(), reverse=True), 4
    loads = sorted(got.groupby("shard")["size"].sum())
    while left[0] * free > sum(left):
        loads.remove(left.pop(0))
        free -= 1
    assert len(loads) == free and [max(loads) - x for x in sorted(loads, reverse=True)] == naive_bfd(left, max(loads))
    assert max(loads) - sum(left) / free <= left[0]
    assert sharding.shard_documents(nothing).count() == 0


def test_groups_are_never_parted(spark):
    long = "one long text " * 4000
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(900)] + [(1000, long), (1001, "text 3"), (1001, "text 3"), (None, "text 6"), (None, None)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), fine=10).toPandas()
    assert len(got) == len(rows)
    assert (got.groupby(["text_crc32", "size"]).shard.nunique() == 1).all()
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    loads = got.groupby("shard")["size"].sum().sort_values()
    assert loads.iloc[-1] == len(long) + 1 and loads.iloc[-2] == 600 * 10 and len(loads) == 8  # each alone in its shard
    assert loads.iloc[:6].max() - loads.iloc[:6].min() <= 10


def test_quality(spark, sf, docs, nothing):
    table, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = quality.train(table, labels)
    s = quality.scores(docs, model)
    assert s.columns == [*docs.columns, "quality_score"] and s.where("quality_score between 0 and 1").count() == docs.count()
    assert quality.scores(nothing, model).count() == 0
    assert quality.train(table, labels.limit(0)).score(np.zeros((2, quality.TERMS), np.float32)).tolist() == [0.5, 0.5]


def test_votes_against_brute_force(spark):
    """Scores from the model's own vectors, neighbour by neighbour."""
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, d, "documents").select("doc_id", "text"), common.table(spark, d, "labels")
    model = quality.train(docs, labels, sample=200)
    assert len(model.vectors) == 200
    # the labelled rows are those outside the held-out fold, by hash
    fold = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id")).limit(200)
    assert sorted(model.labels.tolist()) == sorted(float(r.quality) for r in fold.collect())
    rows = docs.orderBy("doc_id").limit(150).collect()
    got = {r.doc_id: r.s for r in quality.scores(docs, model, "s").where(F.col("doc_id").isin([r.doc_id for r in rows])).collect()}
    held = [np.asarray(v, float) for v in model.vectors]
    for r in rows:
        z = ((quality.terms(r.text or "") - model.mean) * model.weight) @ model.axes
        z = np.asarray(z, float) / max(np.linalg.norm(z), 1e-12)
        near = sorted(((float(z @ v), float(y)) for v, y in zip(held, model.labels)), reverse=True)[: model.neighbours]
        w = [max(c, 0.0) ** model.power for c, _ in near]
        want = (sum(a * y for a, (_, y) in zip(w, near)) + 1e-6 * model.prior) / (sum(w) + 1e-6)
        assert abs(got[r.doc_id] - want) < 1e-3


def test_quality_edge_tables(spark):
    rows = [(1, "some words here"), (1, "some words here"), (None, "some words here"), (2, None), (3, ""), (4, "long " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("quality_score", "label", "quality", "terms")})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    model = quality.train(docs, labels)
    out = quality.scores(docs, model, "s").collect()
    assert len(out) == 6 and len({r.s for r in out if r.text == "some words here"}) == 1 and len({r.s for r in out if not r.text}) == 1
    assert all(0 <= r.s <= 1 for r in out)


def test_held_out_accuracy(spark):
    from skygrid.llm.quality import op7_quality

    d = "/root/testdata/sf0.01"
    got = op7_quality(spark, d).join(common.table(spark, d, "labels"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95



def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    common.table(spark, "/root/testdata/sf0.001", "documents").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        common.table(spark, "/root/testdata/sf0.001", t).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.materialise(stage(spark, seen, str(tmp_path)))
        if i < 4:
            assert out.columns == docs.columns
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in seen.select("doc_id").collect()}
            seen = out
    assert out.select("doc_id").distinct().count() == seen.count()
    run = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    key = ["doc_id", "start"]
    assert run.sort_values(key)[["doc_id", "start", "ids_crc32"]].reset_index(drop=True).equals(out.toPandas().sort_values(key)[["doc_id", "start", "ids_crc32"]].reset_index(drop=True))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_with_nulls_and_clashing_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents").limit(60)
    odd = spark.createDataFrame([(None, "no id at all", None, None, None), (5001, None, None, None, None), (5002, "", "en", "s", 0), (5003, "twice the same words in this text", "en", "s", 1), (5003, "twice the same words in this text", "en", "s", 1)], docs.schema)
    names = ("quality_score", "score", "_score", "contaminated", "simhash", "set", "keys", "pii", "low", "node", "root", "a.b")
    docs = docs.unionByName(odd).withColumns({c: F.lit("kept") for c in names})
    for t in ("labels", "benchmark"):
        common.table(spark, sf, t).write.parquet(f"{tmp_path}/{t}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, out = seen, common.materialise(stage(spark, seen, str(tmp_path)))
        assert out.columns == docs.columns and all(set(r) == {"kept"} for r in out.select([f"`{c}`" for c in names]).distinct().collect())
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "near_duplicates":
            assert ids.count(5003) <= 1 and len([i for i in ids if i in (5001, 5002)]) <= 1
        if name in ("decontamination", "personal_data"):
            assert {5001, 5002, None} & {r.doc_id for r in before.select("doc_id").collect()} <= set(ids)
        seen = out
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == seen.select("doc_id").distinct().count()


def test_scratch_tables_go(spark, tmp_path):
    import os

    with common.scratch(spark):
        a, b = common.materialise(spark.range(3)), common.materialise(spark.range(4), outer=True)
        assert a.count() == 3
    here = lambda d: d._skygrid_table.removeprefix("file:")
    assert not os.path.exists(here(a)) and b.count() == 4
    common.discard(b)
    assert not os.path.exists(here(b))
    assert common.free_name(spark.range(1).selectExpr("id as Mark", "id as _mark"), "mark") == "__mark"
