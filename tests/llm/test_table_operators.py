"""Sharding, near copies, packing, search, chat formatting and URL rules
against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabforge.llm import bm25_pack, hilbert, ngram_join, reply_trees, topk, url_filter
from tabforge.llm.common import read

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, shard string"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None, "x") for i, t in texts], DOC)


# --- sharding

@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 3)])
def test_hilbert_curve_is_one_path_through_all_cells(spark, dims, bits):
    cells = [tuple(i >> bits * d & (1 << bits) - 1 for d in range(dims)) for i in range(1 << bits * dims)]
    names = [f"c{d}" for d in range(dims)]
    df = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names))
    at = sorted((r["h"], tuple(r[n] for n in names)) for r in
                df.withColumn("h", hilbert.hilbert_index([F.col(n) for n in names], bits)).collect())
    assert [h for h, _ in at] == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for (_, x), (_, y) in zip(at, at[1:]))


def test_shards_obey_their_law(spark):
    texts = [(i, "same" if i < 40 else f"é {i}" * (i % 7)) for i in range(101)] + [(None, None), (3, "same"), (3, "same")]
    rows = hilbert.shard_documents(_docs(spark, texts)).collect()
    assert len(rows) == 104 and all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append((r["slot"], r["hilbert"]))
    assert sorted(by) == list(range(8))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in by.values())
    runs = [h for k in sorted(by) for _, h in sorted(by[k])]
    assert runs == sorted(runs)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert hilbert.shard_documents(_docs(spark, texts).limit(0)).count() == 0


def test_shard_files(spark, tmp_path):
    out = hilbert.hilbert_shards(_docs(spark, [(i, "t" * i) for i in range(50)]).drop("shard"),
                                 ["source", "doc_id"], ["doc_id"], 4)
    hilbert.write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


# --- near copies

def _brute(texts, words, n, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = words((t or "").translate(low))
        sets[i] = {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    home = {i: i for i in sets}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and den * both >= num * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                home[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_components_against_brute_force(spark, words, n, num):
    rng = random.Random(n)
    texts = []
    for g in range(12):
        base = [rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 30))
                for _ in range(rng.choice([3, 9, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):          # copies of copies: chains
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = f"new{rng.randint(0, 9)}"
            texts.append(" ".join(base).title() if rng.random() < 0.3 else " ".join(base))
    texts += [None, "", " \n\t", "one", "ONE", "one two", "shared line of words " * 3, "long " * 3000]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           ngram_join.ngram_components(_docs(spark, texts), n, num, 100).collect()}
    assert got == _brute(texts, words, n, num, 100)


def test_near_copy_stage_keeps_one_of_each_group(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(5, body), (2, body), (2, body), (9, body + " tail"), (None, body), (7, "other text entirely here now"),
            (8, None)]
    kept = ngram_join.keep_one_per_group(_docs(spark, rows))
    assert kept.columns == _docs(spark, rows).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 7, 8, None]
    assert ngram_join.ngram_components(_docs(spark, rows).limit(0)).count() == 0


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(2, a), (5, a), (5, b), (6, b), (5, b), (7, c), (7, a + " tail"), (8, ""), (8, c), (9, None), (9, "")]
    kept = ngram_join.keep_one_per_group(_docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(2, a), (5, b), (7, c), (8, ""), (9, "")]


# --- packing

def _pack_here(docs, idf, mean, window):
    """Pieces (document's place in ``docs``, start, length, sequence, offset)
    of a few documents (doc_id, ids), packed here."""
    n = np.array([len(ids) for _, ids in docs], np.int64)
    bm = bm25_pack._Bm25(idf, mean, window, np.zeros(0, np.int64))
    terms = [bm.weights(ids[k:]) for (_, ids), k in zip(docs, n // window * window)]

    def ask(seeds, counts, unused):
        own = np.flatnonzero(unused)
        tile = bm25_pack._Tile(bm, own, [len(terms[i][0]) for i in own], np.concatenate([terms[i][0] for i in own]),
                     np.concatenate([terms[i][1] for i in own]))
        return [f["item"] for f in tile.best(seeds, [terms[i][0] for i in seeds], counts, len(docs))]
    windows = bm25_pack._Windows(n // window * window, n % window, window, ask)
    pieces = [p for block in windows.run() for p in block]
    for i, k in enumerate(n // window):
        for w in range(k):
            pieces.append((i, w * window, window, windows.seq, 0))
            windows.seq += 1
    return pieces, windows.seq


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer
    tk, enc = Tokenizer.from_file(bm25_pack.default_tokenizer()), bm25_pack.Encoder(bm25_pack.default_tokenizer())
    rng = random.Random(1)
    letters = "aB'sé ÉßµÀ ²½ ,.\n\t\x1c\xa0\u0301\u200bİΣσ 中文😀're'Ll123—"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) + rng.choice(["", " <|endoftext|> x"])
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tk.encode(t, add_special_tokens=False).ids


def test_encoder_merges_the_distinct_words_of_many_texts_at_once(monkeypatch):
    enc, rng = bm25_pack.Encoder(bm25_pack.default_tokenizer()), random.Random(2)
    letters = "aB'sé ÉßµÀ ²½ ,.\n\t're'Ll12th er in an''-\x0b\x00\x80"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 45))) + rng.choice(["", " " + "ab" * 50]) for _ in range(1500)]
    texts += ["", " \n", "é" * 32, "x" * 65, "Σ", "a <|endoftext|> b"]
    monkeypatch.setattr(bm25_pack, "CHARS_AT_ONCE", 1000)
    got = enc.encode_all(texts)
    assert all(np.frombuffer(z, enc.dtype).tolist() == enc.tk.encode(t, add_special_tokens=False).ids
               for t, z in zip(texts, got))
    calls = []
    monkeypatch.setattr(bm25_pack, "CHARS_AT_ONCE", 1 << 23)
    monkeypatch.setattr(enc.merges, "_rank", lambda x, y, rank=enc.merges._rank: calls.append(1) or rank(x, y))
    enc.encode_all([f"{t} word{i}, n{i:b}" for i, t in enumerate(texts)])
    assert 0 < len(calls) <= 3 * (bm25_pack.LONGEST_PART + 1)      # rounds, not words


def test_encoder_cuts_a_long_word_once():
    enc, calls = bm25_pack.Encoder(bm25_pack.default_tokenizer()), []

    class Cutter:
        def findall(self, word, own=enc.pattern):
            calls.append(len(word))
            return own.findall(word)
    enc.pattern = Cutter()
    for word in ("'aé" * 20_000, "'" * 50_000 + "s", "x" * 50_000, "1" * 50_000):
        want = enc.tk.encode(f"a {word} b", add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(f"a {word} b"), enc.dtype).tolist() == want
    assert calls == [60_000, 50_001]


def test_pieces_hold_every_token_once(spark):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(bm25_pack.default_tokenizer())
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(200)]
    texts = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 5, 300, 1500])))) for i in range(40)]
    texts += [(100, None), (101, "hot copy " * 50), (102, "hot copy " * 50), (103, "very long " * 9000)]
    rows = bm25_pack.pack_documents(_docs(spark, texts), with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in texts:
        want, at = tk.encode(t or "", add_special_tokens=False).ids + [bm25_pack.EOS], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids"] == want[at:at + r["length"]]
            at += r["length"]
        assert at == len(want)
    sizes = []
    for v in by_seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert max(sizes) <= 2048 and sum(x < 2048 for x in sizes) <= 1
    assert bm25_pack.pack_documents(_docs(spark, texts).limit(0)).count() == 0


def test_neighbours_share_a_window():
    rng = np.random.default_rng(0)
    topics = [np.arange(100 * k, 100 * k + 60) for k in range(8)]
    docs = [(i, rng.choice(topics[i % 8], 500).astype("<u2")) for i in range(64)]
    pieces, _ = _pack_here(docs, np.ones(1000), 500.0, 2048)
    by = defaultdict(set)
    for i, _, _, seq, _ in pieces:
        by[seq].add(i % 8)
    assert sum(len(v) == 1 for v in by.values()) >= len(by) / 2


def test_neighbours_come_from_the_whole_corpus(spark):
    enc, rng = bm25_pack.Encoder(bm25_pack.default_tokenizer()), random.Random(7)
    words = [w for w in sorted(enc.tk.get_vocab()) if w.isascii() and w.isalpha() and w.islower()
             and len(enc.encode(w)) == enc.dtype.itemsize]
    rng.shuffle(words)
    common, rare = words[:1500], words[1500:1900]
    make = lambda own: " ".join(own + rng.sample(common, 69 - len(own)))
    texts = [(i, make(rare[10 * i:10 * i + 10])) for i in range(40)] + [(i, make([])) for i in range(100, 2500)]
    texts += [(i + 50, make(rare[10 * i:10 * i + 10])) for i in range(40)]      # shares few words with i
    by_seq = defaultdict(set)
    for r in bm25_pack.pack_documents(_docs(spark, texts), window=128).collect():
        by_seq[r["sequence_id"]].add(r["doc_id"])
    assert all(any({i, i + 50} <= v for v in by_seq.values()) for i in range(40))


def test_neighbours_are_those_of_a_brute_force_search(spark):
    """Every window's documents, one seed after the other, by BM25 scores of
    all unused rests."""
    rng, window = random.Random(12), 64
    vocab = [f"word{i}" for i in range(90)]
    texts = [(i, " ".join(rng.choices(vocab, [1 / (k + 1) for k in range(90)], k=rng.randint(0, 150)))) for i in range(19)]
    texts += [(i, texts[3][1]) for i in range(19, 24)]      # copies; every seed's list holds all of these
    rows = bm25_pack.pack_documents(_docs(spark, texts).coalesce(1), window=window, with_ids=True).collect()
    enc = bm25_pack.Encoder(bm25_pack.default_tokenizer())
    ids = [[*np.frombuffer(enc.encode(t), enc.dtype).tolist(), bm25_pack.EOS] for _, t in texts]
    rest = [v[len(v) // window * window:] for v in ids]
    left = [len(r) for r in rest]
    n_items, df = sum(map(bool, left)), Counter(t for r in rest for t in set(r))
    mean = sum(left) / n_items
    idf = {t: np.log1p((n_items - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    top = np.log1p((n_items + 0.5) / 0.5) if enc.size > len(df) else max(idf.values())   # of tokens that no rest has
    scale = 2.0 ** np.floor(np.log2(min((1 << 24) / window, 1 << 15) / max(1e-9, top * (bm25_pack.K1 + 1))))

    def weight(t, r):
        tf = r.count(t)
        return np.rint(np.float32(0) + idf[t] * tf * (bm25_pack.K1 + 1) / (
            tf + bm25_pack.K1 * (1 - bm25_pack.B + bm25_pack.B * len(r) / mean)) * scale)
    index = [{t: weight(t, r) for t in set(r)} for r in rest]
    want, n = [], len(texts)
    while any(left):
        seed = next(i for i in range(n) if left[i])
        near = sorted((i for i in range(n) if left[i] and i != seed), key=lambda i: (
            -sum(index[i].get(t, 0) for t in index[seed]), (i - seed) % n))
        room, held = window, []
        for i in [seed, *near]:
            take = min(room, left[i])
            if take:
                held.append((texts[i][0], take))
                left[i] -= take
                room -= take
        want.append(held)
    by_seq = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["offset"]):
        by_seq[r["sequence_id"]].append((r["doc_id"], r["length"]))
    assert [by_seq[k] for k in range(len(want))] == want


def test_tiles_give_the_best_of_all_unused_items():
    """Items in batches of any size, cut into tiles; many equal scores."""
    rng, vocab, k = np.random.default_rng(8), 40, 9
    terms = [np.unique(rng.integers(0, vocab, rng.integers(1, 9))).astype("<u2") for _ in range(3000)]
    weights = [rng.integers(1, 4, len(t)).astype("<u2") for t in terms]
    unused, order = rng.random(3000) < 0.7, rng.permutation(3000)
    batches = [pa.RecordBatch.from_arrays(
        [pa.array(p), pa.array([terms[i].tobytes() for i in p], pa.binary()), pa.array([weights[i].tobytes() for i in p], pa.binary())],
        names=["item", "terms", "weights"]) for p in np.split(order, [0, 5, 1500, 1501])]
    bm = bm25_pack._Bm25(np.ones(vocab), 5.0, 64, np.arange(0, vocab, 3))
    seeds, found, sizes = rng.choice(3000, 30, replace=False), defaultdict(list), []
    for held in bm25_pack._tiles(batches, unused, 640):
        number, t, w = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
        at = np.argsort(number.to_numpy())
        (t, n), (w, _) = bm25_pack._flat(t.take(pa.array(at)), "<u2"), bm25_pack._flat(w.take(pa.array(at)), "<u2")
        sizes.append(len(n))
        for s, f in zip(seeds, bm25_pack._Tile(bm, number.to_numpy()[at], n, t, w).best(seeds, [terms[i] for i in seeds], [k] * 30, 3000)):
            found[s] += f.tolist()
    left = int(unused.sum())
    assert sizes == [640] * (left // 640) + [left % 640] * (left % 640 > 0)
    for s in seeds.tolist():
        score = {i: float(weights[i][np.isin(terms[i], terms[s])].sum()) for i in np.flatnonzero(unused).tolist()}
        rank = lambda i: (-score[i], (i - s) % 3000)
        assert sorted((i for i, _ in found[s]), key=rank)[:k] == sorted(score, key=rank)[:k]
        assert all(score[i] == v for i, v in found[s])


def test_short_texts_fill_windows_too():
    rng = np.random.default_rng(3)
    docs = [(i, np.array([1], "<u2")) for i in range(700)]
    docs += [(i, rng.integers(0, 300, k).astype("<u2")) for i, k in enumerate(rng.integers(1, 150, 300))]
    pieces, n = _pack_here(docs, np.linspace(0.1, 5, 300), 20.0, 128)
    sizes = Counter()
    for i, start, length, seq, offset in pieces:
        sizes[seq] += length
    total = sum(len(ids) for _, ids in docs)
    assert sum(sizes.values()) == total and n == -(-total // 128) and sum(v < 128 for v in sizes.values()) <= 1


# --- search

def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = [(i, [float(x) for x in rng.choice([-0.5, -0.1, 0.0, 0.25, 0.3], 6)]) for i in range(400)]
    vecs += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6),
             (500, [0.1, 0.2]), (600, [0.3, 0.4]), (700, [1e6] * 6), (300, vecs[300][1]), (800, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vecs], "vec_id long, embedding array<double>, rank int, score int")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=7).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vecs
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {i: v for i, v in ok if i % 100 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_components_beyond_the_doubles_take_no_part(spark):
    df = spark.createDataFrame([(0, [1e306, 0.0]), (100, [0.5, 0.5]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()] == [(100, 1, 1, 1024 * 1024)]


def test_block_and_tile_sizes_do_not_matter(monkeypatch):
    rng = np.random.default_rng(6)
    q, c, ids = rng.integers(-3, 4, (5, 4)).astype(float), rng.integers(-3, 4, (90, 4)).astype(float), np.arange(90)
    whole = topk._best(topk._scores(q, c), ids, ids[:5], 6)
    parts = None
    for k in range(0, 90, 7):
        parts = topk._merge(parts, topk._best(topk._scores(q, c[k:k + 7]), ids[k:k + 7], ids[:5], 6), 5, 6)
    assert all((a == b).all() for a, b in zip(whole, parts))
    big = np.array([[2.0 ** 40, 1.0]])
    assert topk._scores(big, np.array([[2.0 ** 20, 3.0]]))[0, 0] == 2 ** 60 + 3


# --- chat formatting

def test_branches_of_a_tree(spark):
    rows = [(1, "r", None, "system", "be kind", 0.0), (1, "a", "r", "user", "hi <|user|>", 1.0),
            (1, "b", "a", "assistant", "one</s>", 0.5), (1, "c", "a", "assistant", "two", 2.0),
            (1, "d", "c", "user", None, 0.0), (1, "e", "b", "user", "deep", 9.0), (2, "z", None, None, "alone", None)]
    df = spark.createDataFrame(rows, "tree long, node string, parent string, role string, text string, score double")
    out = {(r["tree"], r["branch"]): r for r in reply_trees.format_trees(df, branches=2).withColumn(
        "turns", reply_trees.read_turns(F.col("formatted"))).withColumn(
        "loss", reply_trees.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert sorted(out) == [(1, 1), (1, 2), (2, 1)]
    assert [tuple(t) for t in out[1, 1]["turns"]] == [("system", "be kind"), ("user", "hi <|user|>"),
                                                      ("assistant", "one</s>"), ("user", "deep")]
    assert out[1, 1]["leaf"] == "e" and out[1, 1]["loss"] == "one</s>" and out[1, 2]["loss"] == "two"
    assert out[1, 1]["formatted"].count("</s>") == 4 and "<|user|>\nhi <\\|user|\\>" in out[1, 1]["formatted"]


def test_circles_missing_parents_and_repeated_nodes(spark):
    rows = [(1, "a", "b"), (1, "b", "a"),                                       # a circle alone
            (2, "c", "e"), (2, "d", "c"), (2, "e", "d"), (2, "f", "d"),         # a circle with a reply
            (3, "g", "nowhere"), (3, "h", "g"), (4, "i", "i")]                  # no parent, own parent
    df = spark.createDataFrame([(t, n, p, "user", n, 1.0) for t, n, p in rows],
                               "tree long, node string, parent string, role string, text string, score double")
    out = reply_trees.format_trees(df, branches=9).withColumn("turns", reply_trees.read_turns(F.col("formatted")))
    got = {(r["tree"], r["leaf"]): "".join(t["text"] for t in r["turns"]) for r in out.collect()}
    assert got == {(1, "b"): "ab", (2, "e"): "cde", (2, "f"): "cdf", (3, "h"): "gh", (4, "i"): "i"}
    with pytest.raises(ValueError, match="node"):
        reply_trees.format_trees(df.unionByName(df.limit(1)))


def test_long_circle_ends(spark):
    df = spark.range(300).select(F.lit(1).alias("tree"), F.col("id").alias("node"), ((F.col("id") + 1) % 300).alias("parent"),
                                 F.lit("user").alias("role"), F.lit("x").alias("text"), F.lit(1.0).alias("score"))
    out = reply_trees.format_trees(df).collect()
    assert [(r["leaf"], r["n_turns"]) for r in out] == [(1, 300)]


def test_null_conversations_are_one(spark):
    df = spark.createDataFrame([(None, 1, "user", "b"), (None, 0, "user", "a"), (3, 0, "user", "c")],
                               "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in reply_trees.format_conversations(df).collect()}
    assert got == {None: 2, 3: 1}


def test_conversations_read_back(spark):
    rng = random.Random(8)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>", "\\", "<", ">", "|", "[", "\n", "é", " a"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a|>b"]),
             rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 12)))])) for c in range(60)
            for t in range(rng.randint(1, 9))]
    rows += [(7, 0, "user", "again"), (7, 0, "user", "again"), (99, None, "assistant", "x" * 100_000)]
    rows += [(500, t, "user", f"turn {t}") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in reply_trees.format_conversations(df).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else -1, r is not None, r or "", x is not None, x or ""))
    assert sorted(got) == sorted(by)
    for c, v in by.items():
        v = [(r, x) for _, _, r, _, x in sorted(v)]
        loss = "".join(x for r, x in v if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(v) and g["loss_chars"] == len(loss)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in v).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


# --- URLs

def test_url_rules_against_brute_force(spark):
    rules = url_filter.RULES + [("block", "example.org", "/en/12"), ("allow", "b.example.org", ""),
                                ("block", "EXAMPLE.net", "/a/b/c")]
    hosts = ["example.org", "www.example.org", "a.b.EXAMPLE.org", "x.com", "com", "badexample.org", "example.net",
             "example.org:80", "", "..org"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/126", "/en/2", "/fr/", "/de/1?x=/fr/", "/de#y", "/a/b/c/d", "/a/b/cd",
             "?/es/", "//es/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/es/", "://org/x", "a://b://org/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls[:20])],
                               "page_id long, url string, rule string")
    rows = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = url_filter.filter_pages(df, rows).collect()
    assert len(got) == len(urls) + 20
    for r in got:
        u = (urls + urls[:20])[r["page_id"]] or ""
        host = path = ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = rest[:cut].lower(), rest[cut:]
            path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h) + len(p), len(h), v == "block", h.lower() + p, v) for v, h, p in rules
                if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits, default=None)
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == ((best[3], best[4]) if best else (None, "allow"))


def test_very_long_urls_and_odd_rules(spark):
    deep = "http://" + "a." * 300_000 + "example.org/" + "es/" * 300_000
    df = spark.createDataFrame([(1, deep), (2, "http://example.org" + "/x" * 400_000), (3, "http://x.org/es/")],
                               "page_id long, url string")
    rows = spark.createDataFrame(url_filter.RULES + [("block", None, "/"), ("block", "x.org", None)],
                                 "verdict string, host string, path string")
    got = {r["page_id"]: r["rule"] for r in url_filter.filter_pages(df, rows).collect()}
    assert got == {1: "example.org/es/", 2: "org/", 3: "x.org"}
    none = url_filter.filter_pages(df, rows.limit(0)).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}


# --- pipeline

def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    docs = read(spark, SF, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema == docs.schema and 0 < out.count() <= docs.count()
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        else:
            assert out.select("doc_id").distinct().count() == docs.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
