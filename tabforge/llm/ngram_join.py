"""Jaccard self-join on word n-gram sets, with vertical partitioning.

The n-grams get one global order, rare before common, and that order is cut
into fragments.  Every document's set falls into one segment per fragment;
the overlap of two documents is counted fragment by fragment and the partial
counts are summed per pair.

Plan
1. ``profile``: one pass over the texts gives each document its set size and
   a 64-bit signature of its set (equal sets collapse to one *class*), and a
   count sketch of all n-grams of all documents.  The sketch has a fixed size
   (``2**SKETCH_BITS`` counters), so broadcasting it is bounded.
2. ``prefixes``: documents linked at similarity t share an n-gram among the
   ``n - ceil(t n) + 1`` first ones in the global order, whatever that order
   is.  Those prefix n-grams are the only rows that are shuffled by n-gram.
3. Sparse round: in each n-gram's bucket every class is paired with one pivot
   class only, the one with the fewest n-grams of its own (in a group of near
   copies that is the text they were made from).  Verified pairs are links;
   their connected components are the first estimate.
4. Exhaustive round: bucket mates that are still in *different* components
   are compared as well.  Pairs inside one component cannot change the
   components, so a large group of near copies never becomes all its pairs.
   After this round no link between different components is left unchecked:
   the components are exact.

Pairs are filtered where they are formed, in the join itself: by size, by the
position of the shared n-gram, and by a 256-bit parity map of each set, whose
differing bits never outnumber the differing n-grams.

Hot groups: equal sets are one class; the bucket, link and label joins have
written tables on both sides, which lets the adaptive planner split a hot
key.  Executors may be lost at any time: every step ends in a written table.

Null text, or a text without words: empty set, size 0, linked with nothing.
A null id is a document of its own.  Repeated rows are in one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, pack_counts, sum_counts

SKETCH_BITS = 20
SKETCH_CHUNKS = 64
FRAGMENTS = 4
SLICES = 4                  # of the prefix n-grams, dealt out one after the other
WORD_CACHE = 400_000        # entries of a task's word-hash cache,
CACHED_CHARS = 200          # of words up to this length

MAP = ["m0", "m1", "m2", "m3"]

_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, w):
        if len(self) >= WORD_CACHE:
            self.clear()
        h = xxhash.xxh64_intdigest(w)
        if len(w) <= CACHED_CHARS:
            self[w] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_set(text: str | None, n: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of the text in
    lower-cased A-Z; a shorter text is one shingle; no words: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(n, len(words))
    h = np.array([cache[w] for w in words], dtype=np.uint64)
    m = len(h) - k + 1
    acc = np.full(m, np.uint64(k))
    for i in range(k):
        acc = acc * _P + h[i:i + m]
    return np.unique(_mix(acc))


def _signature(u: np.ndarray) -> int:
    s = int(_mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(f"{len(u)}:{s}"))))


def _parity(u: np.ndarray) -> np.ndarray:
    """Four words of the set's parity map: bit b is set if an odd number of
    n-grams fall on it."""
    odd = np.bincount((u >> np.uint64(24)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _signed(u: np.ndarray) -> np.ndarray:
    return u.view(np.int64)


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, sig, parity map) of each document, and in rows with a chunk
    number the sketch counts of the task."""
    def run(batches):
        cache, size = _WordHash(), 1 << SKETCH_BITS
        counts = np.zeros(size, np.int64)
        for b in batches:
            ns, sigs, maps = [], [], []
            for t in b.column(1).to_pylist():
                u = gram_set(t, n, cache)
                ns.append(len(u))
                maps.append(_parity(u))
                sigs.append(_signature(u) if len(u) else None)
                np.add.at(counts, (u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            z = len(ns)
            maps = np.array(maps, np.int64).reshape(z, 4)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(sigs, pa.int64()),
                 *(pa.array(maps[:, k]) for k in range(4)), pa.nulls(z, pa.int32()), pa.nulls(z, pa.binary())],
                names=["doc_id", "n", "sig", *MAP, "chunk", "counts"])
        packed = pack_counts(counts, SKETCH_CHUNKS)
        if packed is not None:
            none = [pa.nulls(packed.num_rows, pa.int64())] * 7
            yield pa.RecordBatch.from_arrays([*none, *packed.columns],
                                             names=["doc_id", "n", "sig", *MAP, "chunk", "counts"])
    return docs.mapInArrow(run, "doc_id long, n long, sig long, m0 long, m1 long, m2 long, m3 long, chunk int, counts binary")


def _order(u: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Indices that put the hashes into the global order (count, hash)."""
    return np.lexsort((u, sketch[(u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))


def _prefixes(docs: DataFrame, n: int, num: int, den: int, sketch_bc) -> DataFrame:
    """(gram, sig, n, pos) of the prefix n-grams of each document."""
    def run(batches):
        cache, sketch, seen = _WordHash(), sketch_bc.value, set()
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for t in b.column(0).to_pylist():
                u = gram_set(t, n, cache)
                size = len(u)
                if not size:
                    continue
                sig = _signature(u)
                if sig in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(sig)
                p = size + (-num * size) // den + 1
                cols[0].append(_signed(u[_order(u, sketch)[:p]]))
                cols[1].append(np.full(p, sig, np.int64))
                cols[2].append(np.full(p, size, np.int32))
                cols[3].append(np.arange(p, dtype=np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols],
                                                 names=["gram", "sig", "n", "pos"])
    return docs.select("text").mapInArrow(run, "gram long, sig long, n int, pos int")


def _cuts(sketch: np.ndarray) -> np.ndarray:
    """Share of all n-gram occurrences that lie before each count."""
    mass = np.bincount(np.minimum(sketch, 1 << 22), weights=sketch)
    return np.concatenate([[0.0], np.cumsum(mass)]) / max(1.0, mass.sum())


def _fragment_of(u: np.ndarray, sketch: np.ndarray, cum: np.ndarray) -> np.ndarray:
    c = np.minimum(sketch[(u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], 1 << 22)
    part = u.astype(np.float64) / 2.0 ** 64
    place = cum[c] + (cum[c + 1] - cum[c]) * part
    return np.minimum((place * FRAGMENTS).astype(np.int64), FRAGMENTS - 1)


def _segments(docs: DataFrame, n: int, wanted_bc, sketch_bc) -> DataFrame:
    """(doc_id, sig, frag, seg) of documents in the wanted bit set."""
    def run(batches):
        cache, (size, wanted), sketch = _WordHash(), wanted_bc.value, sketch_bc.value
        cum = _cuts(sketch)
        for b in batches:
            ids, sigs, frags, segs = [], [], [], []
            doc_ids = b.column(0).to_pylist()
            hit = [i for i, d in enumerate(doc_ids) if d is not None and
                   wanted[(s := _slot(d, size)) >> 3] >> (s & 7) & 1]
            texts = b.column(1).take(pa.array(hit, pa.int32())).to_pylist()
            for i, t in zip(hit, texts):
                u = gram_set(t, n, cache)
                if not len(u):
                    continue
                sig, f = _signature(u), _fragment_of(u, sketch, cum)
                for k in np.unique(f):
                    ids.append(doc_ids[i])
                    sigs.append(sig)
                    frags.append(int(k))
                    segs.append(u[f == k].tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sigs, pa.int64()),
                     pa.array(frags, pa.int32()), pa.array(segs, pa.binary())],
                    names=["doc_id", "sig", "frag", "seg"])
    return docs.mapInArrow(run, "doc_id long, sig long, frag int, seg binary")


def _needed_bits(n: int) -> int:
    """Size of the bit set of ``n`` wanted documents, as a power of two: at
    least sixteen slots each, up to 32 MB.  Beyond that it passes more than
    it need; the join behind it decides."""
    return min(28, max(16, (16 * n).bit_length()))


def _slot(doc_id: int, bits: int) -> int:
    return (doc_id ^ doc_id >> bits) & (1 << bits) - 1


def _partial_overlaps(joined: DataFrame) -> DataFrame:
    """(a, b, frag, common) from rows with both segments of a fragment."""
    def run(batches):
        for b in batches:
            xs, ys = b.column(3).to_pylist(), b.column(4).to_pylist()
            common = []
            for x, y in zip(xs, ys):
                if x == y:
                    common.append(len(x) // 8)
                    continue
                z = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                z.sort()
                common.append(int((z[1:] == z[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2),
                                              pa.array(common, pa.int64())],
                                             names=["a", "b", "frag", "common"])
    return joined.select("a", "b", "frag", "sx", "sy").mapInArrow(
        run, "a long, b long, frag int, common long")


def _verify(docs, pairs: DataFrame, classes: DataFrame, n: int, num: int, den: int,
            sketch_bc, scratch: Scratch, tag: str) -> DataFrame:
    """Links among ``pairs`` (a, b, na, nb): overlaps are counted per
    fragment and summed per pair."""
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = scratch.write(ends.join(classes, "sig").select("sig", F.col("rep").alias("doc_id")),
                           f"wanted_{tag}")
    size = _needed_bits(wanted.count())
    slot = F.expr(f"(doc_id ^ shiftright(doc_id, {size})) & {(1 << size) - 1}L")
    bits = (wanted.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("v")))
    bitset = np.zeros((1 << size) // 64, np.int64)
    for r in bits.collect():
        bitset[r["word"]] = r["v"]
    wanted_bc = spark.sparkContext.broadcast((size, bitset.tobytes()))
    seg = scratch.write(_segments(docs, n, wanted_bc, sketch_bc).join(wanted, ["doc_id", "sig"], "left_semi")
                        .select("sig", "frag", "seg"), f"segments_{tag}")
    left = pairs.select("a", "b").join(
        seg.select(F.col("sig").alias("a"), "frag", F.col("seg").alias("sx")), "a")
    both = left.join(seg.select(F.col("sig").alias("b"), "frag", F.col("seg").alias("sy")), ["b", "frag"])
    common = (_partial_overlaps(both).groupBy("a", "b", "frag").agg(F.max("common").alias("common"))
              .groupBy("a", "b").agg(F.sum("common").alias("common")))
    links = common.join(pairs, ["a", "b"]).where(
        F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num).select("a", "b")
    links = scratch.write(links, f"links_{tag}")
    scratch.drop(f"segments_{tag}", f"wanted_{tag}")
    return links


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the label is the same
    within a component and is one of its nodes.  Rounds of neighbour minimum
    and pointer jumping, each ending in a written table; a round's work is
    one pass over links and labels, the number of rounds about the logarithm
    of the longest chain."""
    edges = scratch.write(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        f"edges_{tag}")
    labels = scratch.write(edges.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.min("a")).alias("label")), f"label_{tag}_0")
    k = 0
    while True:
        near = edges.join(labels.select(F.col("node").alias("a"), "label"), "a").select(
            F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        # hooking: the label of a node also moves what its old label points to
        up = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(
            labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where(
            F.col("la") < F.col("lb")).select(
            F.col("lb").alias("node"), F.col("la").alias("label"), F.lit(None).cast("long").alias("own"))
        mine = labels.select("node", "label", F.col("label").alias("own"))
        low = scratch.write(near.union(up).union(mine).groupBy("node").agg(
            F.min("label").alias("label"), F.max("own").alias("own")), f"low_{tag}_{k}")
        jump = low.join(low.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        k += 1
        new = scratch.write(jump.select("node", F.least("label", "far").alias("label"), "own"),
                            f"label_{tag}_{k}")
        moved = new.where(F.col("label") < F.col("own")).limit(1).count()
        scratch.drop(f"low_{tag}_{k - 1}", f"label_{tag}_{k - 1}")
        labels = new.select("node", "label")
        if not moved:
            scratch.drop(f"edges_{tag}")
            return labels


def _named(s: str) -> list:
    """Names and columns of one end of a pair."""
    names = [s, f"n{s}", f"p{s}", *(f"{m}{s}" for m in MAP)]
    return [(k, F.col(k)) for k in names]


def ngram_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each document: two documents link
    when ``den * |A and B| >= num * |A or B|`` for their n-gram sets;
    component_id is the smallest id reachable over links."""
    return _grouped(docs, words, num, den, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """:func:`ngram_components` with sig, the signature of the row's n-gram
    set (null without words), and home, a number of the component."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram_join")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prof = scratch.write(_profile(docs, words), "profile")
    sketch_bc = spark.sparkContext.broadcast(
        sum_counts(prof.where("chunk is not null"), SKETCH_CHUNKS, 1 << SKETCH_BITS))
    rows = prof.where("chunk is null").select("doc_id", "n", "sig")
    classes = scratch.write(
        prof.where("sig is not null and doc_id is not null").groupBy("sig").agg(
            F.min("doc_id").alias("rep"), *(F.max(m).alias(m) for m in MAP)), "classes")

    pre = scratch.write(_prefixes(docs, words, num, den, sketch_bc), "prefixes")
    # one slice of the n-grams after the other, so that only a slice of the
    # prefixes lies in shuffle files at a time
    for part in range(SLICES):
        some = pre.where(F.pmod("gram", F.lit(SLICES)) == part)
        shared = scratch.write(some.groupBy("gram").agg(F.min("sig").alias("low"), F.max("sig").alias("top"))
                               .where("low < top").select("gram"), f"shared_{part}")
        own = scratch.write(some.join(shared, "gram").select("gram", "sig", "n", "pos").distinct(), f"bucket/{part}")
        scratch.drop(f"shared_{part}")
        scratch.release()
    bucket = spark.read.schema(own.schema).parquet(*(scratch.path(f"bucket/{part}") for part in range(SLICES)))
    scratch.drop("prefixes")
    # how much of a class's prefix others have too
    share = bucket.groupBy("sig").agg(
        (F.count(F.lit(1)) / (F.max("n") * (1 - num / den) + 1)).alias("share"))
    members = scratch.write(
        bucket.join(scratch.write(share.join(classes.drop("rep"), "sig"), "share"), "sig"), "members")
    scratch.drop("bucket", "share")

    side = lambda s: [F.col("sig").alias(s), F.col("n").cast("long").alias(f"n{s}"),
                      F.col("pos").cast("long").alias(f"p{s}"), *(F.col(m).alias(f"{m}{s}") for m in MAP)]
    differ = sum(F.bit_count(F.col(f"{m}a").bitwiseXOR(F.col(f"{m}b"))) for m in MAP)
    likely = differ * (num + den) <= (F.col("na") + F.col("nb")) * (den - num)
    # sizes fit, and what the two sets hold from their first common n-gram on
    # can still reach the overlap that a link needs
    fits = (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (
        F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (num + den)
        >= (F.col("na") + F.col("nb")) * num) & likely
    pair = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"),
            F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("nx"),
            F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("ny")]

    def pairs_of(df):
        return df.select(*pair).distinct().select(
            F.col("x").alias("a"), F.col("y").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb"))

    heads = scratch.write(
        members.groupBy("gram").agg(F.max(F.struct("share", "sig", "n", "pos", *MAP)).alias("h"))
        .select("gram", "h.*").select("gram", *side("a")), "heads")
    tries = scratch.write(pairs_of(members.select("gram", *side("b")).join(heads, "gram").where(
        (F.col("a") != F.col("b")) & fits)), "tries")
    links = _verify(docs, tries, classes, words, num, den, sketch_bc, scratch, "sparse")
    labels = components(links, scratch, "sparse")
    scratch.release()

    home = scratch.write(members.join(labels, F.col("sig") == F.col("node"), "left").select(
        "gram", "sig", "n", "pos", *MAP, F.coalesce("label", "sig").alias("home")), "home")
    mixed = home.groupBy("gram").agg(F.min("home").alias("x"), F.max("home").alias("y")).where("x < y")
    one = F.struct("sig", "n", "pos", *MAP)
    homes = scratch.write(home.join(scratch.write(mixed.select("gram"), "mixed"), "gram").groupBy("gram", "home").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("first"),
        (F.count(F.lit(1)) == 1).alias("alone"), F.min(one).alias("m")).select("*", "m.*").drop("m"), "homes")
    h = lambda s: homes.select("gram", F.col("home").alias(f"h{s}"), F.col("least").alias(f"l{s}"),
                               F.col("most").alias(f"t{s}"), F.col("first").alias(f"f{s}"),
                               F.col("alone").alias(f"alone{s}"), *side(s))
    # a pair of components is worth opening if some sizes in their ranges
    # fit; of a component that has one member here, that member is compared
    met = scratch.write(h("a").join(h("b"), "gram").where(
        (F.col("ha") < F.col("hb")) & (F.col("ta") * den >= F.col("lb") * num)
        & (F.col("tb") * den >= F.col("la") * num)
        & (F.least(F.col("ta") - F.col("fa"), F.col("tb") - F.col("fb")) * (num + den)
           >= (F.col("la") + F.col("lb")) * num)
        & (~F.col("alonea") | ~F.col("aloneb") | fits)), "met")
    member = lambda s: home.select("gram", F.col("home").alias(f"h{s}"), *side(s))
    of_a, of_b = [c for _, c in _named("a")], [c for _, c in _named("b")]
    both_alone = met.where("alonea and aloneb").select(*of_a, *of_b)
    open_a = met.where("not alonea and aloneb").select("gram", "ha", *of_b).join(member("a"), ["gram", "ha"]).where(fits)
    open_b = met.where("alonea and not aloneb").select("gram", "hb", *of_a).join(member("b"), ["gram", "hb"]).where(fits)
    open_both = met.where("not alonea and not aloneb").select("gram", "ha", "hb").join(
        member("a"), ["gram", "ha"]).join(member("b"), ["gram", "hb"]).where(fits)
    ends = [k for k, _ in (*_named("a"), *_named("b"))]
    opened = both_alone.select(*ends).unionByName(open_a.select(*ends)).unionByName(
        open_b.select(*ends)).unionByName(open_both.select(*ends))
    rest = scratch.write(pairs_of(opened).join(tries.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    scratch.drop("members", "heads", "home", "mixed", "homes", "met")
    if rest.limit(1).count():
        more = _verify(docs, rest, classes, words, num, den, sketch_bc, scratch, "rest")
        if more.limit(1).count():
            labels = components(links.union(more), scratch, "all")
    scratch.release()

    homes_of = scratch.write(classes.join(labels, F.col("sig") == F.col("node"), "left").select(
        "sig", "rep", F.coalesce("label", "sig").alias("home")), "homes_of")
    least = scratch.write(homes_of.groupBy("home").agg(F.min("rep").alias("component_id")), "least")
    ids = scratch.write(homes_of.join(least, "home").select("sig", "home", "component_id"), "ids")
    return rows.join(ids, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "sig", "home",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _signed_rows(docs: DataFrame, words: int, text_col: str) -> DataFrame:
    """``docs`` with __sig, the signature of each row's n-gram set."""
    at = docs.columns.index(text_col)

    def run(batches):
        cache = _WordHash()
        for b in batches:
            sets = [gram_set(t, words, cache) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([_signature(u) if len(u) else None for u in sets], pa.int64())],
                names=[*b.schema.names, "__sig"])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__sig", T.LongType())]))


def keep_one_per_group(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (all columns): one of each component, with its
    smallest id.  Repeated rows of a kept id stay once; rows without an id
    stay, and so do rows without words, once per id.  Rows of one id with
    different n-gram sets are told apart by their sets."""
    scratch = Scratch(docs.sparkSession, "keep_one")
    found = scratch.write(_grouped(docs, words, num, den, id_col, text_col).where("doc_id is not null").select(
        "doc_id", "sig", "home", "component_id"), "found")
    first = found.where("sig is not null and doc_id = component_id").groupBy("home").agg(
        F.min("component_id").alias("__id"), F.min("sig").alias("__own"))
    kept = scratch.write(first.select("__id", "__own").unionByName(
        found.where("sig is null").select(F.col("doc_id").alias("__id"), F.lit(None).cast("long").alias("__own"))
    ).distinct(), "kept")
    set_of = F.struct(F.col("sig").isNull(), F.col("sig"))
    mixed = scratch.write(found.groupBy(F.col("doc_id").alias("__id")).agg(
        F.min(set_of).alias("low"), F.max(set_of).alias("top")).where("low <> top").select("__id"), "mixed")
    same_id = F.col(id_col) == F.col("__id")
    out = docs.join(kept.join(mixed, "__id", "left_anti"), same_id, "left_semi").dropDuplicates([id_col])
    if mixed.limit(1).count():
        told = _signed_rows(docs.join(mixed, same_id, "left_semi"), words, text_col)
        out = out.unionByName(told.join(
            kept, same_id & F.col("__sig").eqNullSafe(F.col("__own")), "left_semi").dropDuplicates([id_col, "__sig"]).drop("__sig"))
    return out.unionByName(docs.where(F.col(id_col).isNull()))
