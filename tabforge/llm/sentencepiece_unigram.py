"""SentencePiece encoding and decoding with a unigram model.

Pieces with log scores are stored in a double-array trie over UTF-8 bytes;
the segmentation of a text is its best path (Viterbi).  Spaces are written as
the marker U+2581, one is put before the text, and characters without a piece
fall back to byte pieces.  Decoding joins the pieces, puts bytes back
together and turns markers into spaces.

No piece crosses from a letter into a marker or holds a line feed, so the best
path of a text is that of its words one by one: each distinct word of a batch
is segmented once, all of them together, position by position, with numpy.

The model file gives pieces and their order.  A BPE file has merge ranks in
place of probabilities: a piece of rank r then scores log of its Zipf
probability, rounded to 1/64 so that sums are exact; a unigram file's own
scores are rounded alike.  Ties go to the path whose last piece starts
earlier.

Null and empty text: no pieces; they decode to the empty text.  A marker that
stands in a text decodes to a space, as usual.  Repeated rows are encoded
alike.  Trie, cache and batches have bounded size; texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNIT = 64                   # scores are multiples of 1 / UNIT
UNKNOWN_PENALTY = 10        # below the lowest score
WORD_CACHE = 300_000        # entries,
CACHED_CHARS = 200          # of words up to this length
BATCH_CHARS = 1 << 20

_WORDS = re.compile(r"\n+| *[^ \n]+| +")
_NORMAL, _USER, _BYTE = 1, 4, 6


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[tuple[str, int, int]]:
    """(piece, kind, score in units of 1/UNIT) by id."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    own = [i for i, p in enumerate(proto.pieces) if p.type in (_NORMAL, _USER)]
    if proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM:
        score = {i: round(proto.pieces[i].score * UNIT) for i in own}
    else:
        ranked = sorted(own, key=lambda i: (-proto.pieces[i].score, i))
        total = math.log(sum(1 / r for r in range(1, len(own) + 1)))
        score = {i: round(-(math.log(r) + total) * UNIT) for r, i in enumerate(ranked, 1)}
    return [(p.piece, p.type, score.get(i, 0)) for i, p in enumerate(proto.pieces)]


class DoubleArray:
    """Double-array trie: from state s, byte b leads to ``base[s] + b`` if
    that cell's ``check`` is s; ``value`` is the piece that ends there."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, v in keys.items():
            at = 0
            for b in key:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = children[at][b] = len(children)
                    children.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = v
        size = 4 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = -2
        cell, free = {0: 0}, 256      # no byte is larger than the first free cell
        begin = [0] * 9             # by number of children: where such a node was placed last
        for node in range(len(children)):
            kids = children[node]
            if not kids:
                continue
            while check[free] != -1:
                free += 1
            low, group = min(kids), min(len(kids), 8)
            at = free if group == 1 else max(free, begin[group])
            while True:
                b = at - low
                if b >= 0 and check[at] == -1 and all(check[b + c] == -1 for c in kids):
                    break
                at += 1
            s = cell[node]
            base[s], begin[group] = b, at
            for c, kid in kids.items():
                check[b + c], cell[kid], value[b + c] = s, b + c, ends[kid]
        last = max(cell.values()) + 257
        self.base, self.check, self.value = (np.array(x[:last], np.int32) for x in (base, check, value))


class Unigram:
    """Encoder and decoder of a piece list."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.size = len(pieces)
        own = {p: i for i, (p, kind, _) in enumerate(pieces) if kind in (_NORMAL, _USER)}
        bad = [p for p in own if MARK in p.lstrip(MARK) or "\n" in p]
        if bad:
            raise ValueError(f"pieces that cross words: {bad[:5]}")
        self.trie = DoubleArray({p.encode("utf-8"): i for p, i in own.items()})
        self.score = np.array([s for _, _, s in pieces], np.int32)
        self.unknown = int(min(self.score[i] for i in own.values())) - UNKNOWN_PENALTY * UNIT
        self.byte_id = np.full(256, -1, np.int64)
        for i, (p, kind, _) in enumerate(pieces):
            if kind == _BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        self.surface = [bytes([int(p[3:5], 16)]) if kind == _BYTE else
                        p.replace(MARK, " ").encode("utf-8") if kind in (_NORMAL, _USER) else b""
                        for p, kind, _ in pieces]
        self.cache: dict[str, bytes] = {}

    # -- encoding

    def _best_paths(self, words: list[bytes], n: int) -> list[bytes]:
        """Piece ids (4 bytes each) of words of n bytes."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        w = len(words)
        text = np.frombuffer(b"".join(words), np.uint8).reshape(w, n).astype(np.int32)
        char = (text & 0xC0) != 0x80                    # a character starts here
        low = np.iinfo(np.int32).min
        best = np.full((w, n + 1), low, np.int32)
        best[:, 0] = 0
        come = np.zeros((w, n + 1), np.int32)           # where the last piece starts
        piece = np.full((w, n + 1), -1, np.int32)       # -1: a character without a piece
        for i in range(n):
            rows = np.nonzero(char[:, i])[0]
            if not len(rows):
                continue
            width = 1 + (text[rows, i] >= 0xC0) + (text[rows, i] >= 0xE0) + (text[rows, i] >= 0xF0)
            single = np.zeros(len(rows), bool)
            at, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for j in range(i, n):
                nxt = base[state] + text[rows[at], j]
                ok = check[nxt] == state
                at, state = at[ok], nxt[ok]
                if not len(at):
                    break
                v = value[state]
                hit = v >= 0
                if hit.any():
                    r, p = rows[at[hit]], v[hit]
                    single[at[hit][width[at[hit]] == j + 1 - i]] = True
                    s = best[r, i] + self.score[p]
                    up = s > best[r, j + 1]
                    r = r[up]
                    best[r, j + 1], come[r, j + 1], piece[r, j + 1] = s[up], i, p[up]
            lone = ~single
            if lone.any():
                r, e = rows[lone], i + width[lone]
                s = best[r, i] + self.unknown
                up = s > best[r, e]
                r, e = r[up], e[up]
                best[r, e], come[r, e], piece[r, e] = s[up], i, -1
        out = []
        come, piece = come.tolist(), piece.tolist()
        for k in range(w):
            ids, e = [], n
            while e:
                s = come[k][e]
                p = piece[k][e]
                if p >= 0:
                    ids.append(p)
                else:
                    ids.extend(self.byte_id[list(words[k][s:e])][::-1].tolist())
                e = s
            out.append(np.array(ids[::-1], "<u4").tobytes())
        return out

    def _segment(self, words: set[str]) -> dict[str, bytes]:
        by_size: dict[int, list[str]] = {}
        raw = {w: w.replace(" ", MARK).encode("utf-8", "replace") for w in words}
        for w, z in raw.items():
            by_size.setdefault(len(z), []).append(w)
        got = {}
        for n, ws in by_size.items():
            step = max(1, (1 << 18) // n)
            for k in range(0, len(ws), step):
                part = ws[k:k + step]
                got.update(zip(part, self._best_paths([raw[w] for w in part], n)))
        return got

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four little-endian bytes each."""
        out: list[bytes] = []
        group, chars = [], 0
        for t in texts:
            group.append(_WORDS.findall(" " + t.replace(MARK, " ")) if t else [])
            chars += len(t)
            if chars >= BATCH_CHARS:
                out += self._encode_group(group)
                group, chars = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, group: list[list[str]]) -> list[bytes]:
        cache = self.cache
        cache.update(self._segment(set().union(*group) - cache.keys()))
        out = [b"".join([cache[w] for w in words]) for words in group]
        for w in {w for words in group for w in words if len(w) > CACHED_CHARS}:
            del cache[w]
        if len(cache) > WORD_CACHE:
            cache.clear()
        return out

    # -- decoding

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of each row."""
    return _run(docs, model, id_col, text_col, False)


def round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Per row: id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids),
    n_byte_ids, text_crc32 of the decoded text, and whether it equals the
    text."""
    return _run(docs, model, id_col, text_col, True)


def _run(docs: DataFrame, model: str | None, id_col: str, text_col: str, digest: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Unigram(load_pieces(model or default_model())))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        uni = shared.value
        is_byte = np.zeros(uni.size, bool)
        is_byte[uni.byte_id[uni.byte_id >= 0]] = True
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for k in range(0, len(texts), 1000):
                part = texts[k:k + 1000]
                ids = uni.encode_batch(part)
                arrays = [np.frombuffer(z, "<u4") for z in ids]
                head = b.column(0).slice(k, len(part))
                if not digest:
                    yield pa.RecordBatch.from_arrays(
                        [head, pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32()))],
                        names=[id_col, "ids"])
                    continue
                back = [uni.decode(a) for a in arrays]
                yield pa.RecordBatch.from_arrays(
                    [head, pa.array([len(a) for a in arrays], pa.int64()),
                     pa.array([zlib.crc32(z) for z in ids], pa.int64()),
                     pa.array([int(is_byte[a].sum()) for a in arrays], pa.int64()),
                     pa.array([zlib.crc32(t.encode("utf-8", "replace")) for t in back], pa.int64()),
                     pa.array([t == u for t, u in zip(back, part)], pa.bool_())],
                    names=[id_col, "n_ids", "ids_crc32", "n_byte_ids", "text_crc32", "round_trip"])
    schema = f"`{id_col}` {id_type}, " + (
        "n_ids long, ids_crc32 long, n_byte_ids long, text_crc32 long, round_trip boolean" if digest
        else "ids array<int>")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
