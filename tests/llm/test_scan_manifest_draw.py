"""License scans, Merkle manifest and importance resampling against brute
force, on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tabforge.llm import importance_resampling as ir
from tabforge.llm import license_scan as ls
from tabforge.llm import merkle_manifest as mm

# columns that clash with the operators' own names
DOC = ("doc_id long, text string, lang string, source string, n_chars long, row long, words string, p int, "
       "weight long, tree string, at long, id long")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "w", 1, 3, "t", 5, 9) for r in rows], DOC)


MIT_NOTICE = next(t for t in ls.NOTICES if t.label == "mit").text
TEXTS = [
    None, "", " \n\t", "mit", "license", "MIT License", "mit-license; MIT  LICENSE mit license",
    "the MIT\nLicense and the GNU General Public License, general public licence", "general public public license",
    "apache İ license", "Apache License " * 400, "é " * 50_000 + "mit license", "mit license" + " x" * 50_000,
    "gnu affero general public license v3", "Licensed under CC BY-NC 4.0.", MIT_NOTICE,
    "before " + MIT_NOTICE.replace("free of charge", "wholly free of any charge").replace("rights", "right") + " after",
    " ".join(MIT_NOTICE.split()[:30]), " ".join(reversed(MIT_NOTICE.split())), MIT_NOTICE + " filler text " + MIT_NOTICE,
    "MIT License",
]


def _phrase_places(words, phrase):
    want = phrase.split()
    return [i for i in range(len(words) - len(want) + 1) if words[i:i + len(want)] == want]


def test_license_scan_against_brute_force(spark):
    rows = [(i if i != 4 else None, t, "en", "s", None) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s", 1)] * 2
    got = ls.scan_documents(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for doc_id, text, *_ in rows:
        words = _words(text)
        places = {t.label: _phrase_places(words, t.text) for t in ls.BASE}
        every = sorted(p for v in places.values() for p in v)
        want[(doc_id, len(words), len(every), every[0] if every else None, every[-1] if every else None,
              ",".join(sorted(k for k, v in places.items() if v)))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                   for r in got) == want
    by_text = {rows[i][1]: r for r in got for i in [next(k for k, x in enumerate(rows) if x[0] == r["doc_id"])]}
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
               for r in got)
    assert by_text[MIT_NOTICE]["labels"] == "mit" and by_text[MIT_NOTICE]["score"] == 1.0
    assert by_text[TEXTS[16]]["labels"] == "mit" and 0.6 <= by_text[TEXTS[16]]["score"] < 1    # merged diagonals
    assert by_text[TEXTS[17]]["labels"] == "" and by_text[TEXTS[17]]["score"] == 0             # too short a share
    assert by_text[TEXTS[18]]["labels"] == ""
    assert by_text[TEXTS[13]]["labels"] == "agpl,gpl" and by_text[TEXTS[14]]["labels"] == "cc-by-nc"
    assert ls.scan_documents(_docs(spark, rows).limit(0)).count() == 0


def test_license_spans(spark):
    spans = ls.find_licenses(_docs(spark, [(1, TEXTS[19], "en", "s", None)])).collect()
    n = len(_words(MIT_NOTICE))
    assert sorted((r["label"], r["first_word"], r["n_span"]) for r in spans) == [("mit", 0, n), ("mit", n + 2, n)]
    shifted = ls.find_licenses(_docs(spark, [(1, TEXTS[16], "en", "s", None)])).collect()
    assert len(shifted) == 1 and shifted[0]["first_word"] == 1 and shifted[0]["covered"] < n


def test_license_templates_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(TEXTS)]
    small = {tuple(r) for r in ls.scan_documents(_docs(spark, rows)).collect()}
    monkeypatch.setattr(ls, "BROADCAST_GRAMS", 0)
    assert {tuple(r) for r in ls.scan_documents(_docs(spark, rows)).collect()} == small
    with pytest.raises(ValueError):
        ls.scan_documents(_docs(spark, rows), [ls.Template("one", "word")])


# --- Merkle manifest

def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _tree(leaves, fanout):
    """root, and per leaf its list of (slot, run) up to the root."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for k, a in enumerate(at):
            paths[k].append((a % fanout, runs[a // fanout]))
            at[k] = a // fanout
        nodes = [_h(*r) for r in runs]
    return nodes[0], paths


def _manifest(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r)))
        trees[g] = _tree([_leaf(*r) for r in groups[g]], fanout)
    root, tops = _tree([trees[g][0] for g in langs], fanout)
    out = Counter()
    for i, g in enumerate(langs):
        subroot, paths = trees[g]
        for r, path in zip(groups[g], paths):
            path = path + tops[i]
            proof = _h(*(x for slot, run in path for k, x in enumerate(run) if k != slot))
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            folded = _leaf(*r[:4], r[4] + 1) if hit else _leaf(*r)
            for slot, run in path:
                folded = _h(*(folded if k == slot else x for k, x in enumerate(run)))
            out[(r[0], _leaf(*r), subroot, root, proof, folded, folded == root)] += 1
    return out


MERKLE = ([(i, f"text {i}" * (i % 5), "en", f"s{i % 3}", i) for i in range(37)]
          + [(i, "ü" * i, "de", None, None) for i in (3, 9, 9, 2)] + [(9, "ü" * 9, "de", None, None)]
          + [(50, "lone", "fr", "s", 4), (51, None, None, "s", 4), (None, "", None, None, 0), (None, "", None, None, 0),
             (60, "long " * 60_000, "", "s", 300_000), (61, "a", "", "s", 1), (62, "a", "é", "s", 1)])


@pytest.mark.parametrize("fanout,rows", [(2, MERKLE), (3, MERKLE), (2, MERKLE[:1]), (2, MERKLE[-1:] + MERKLE[:2]),
                                         (2, [(7, "same", "en", "s", 1)] * 5)])
def test_manifest_against_brute_force(spark, fanout, rows):
    got = mm.document_manifest(_docs(spark, rows), fanout).collect()
    assert Counter(map(tuple, got)) == _manifest(rows, fanout)
    assert any(not r["verified"] for r in got) == any(
        r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in rows)


def test_manifest_of_an_empty_table(spark):
    got = mm.document_manifest(_docs(spark, MERKLE).limit(0))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.count() == 0


# --- importance resampling

def _resample(rows, target, max_run, buckets, min_words, percent):
    def hist(text):
        w = _words(text)
        runs = [" ".join(w[i:i + n]) for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]
        return len(w), Counter(zlib.crc32(x.encode()) % buckets for x in runs)
    docs = [(r[0], *hist(r[1])) for r in rows]
    s, t = Counter(), Counter()
    for _, _, h in docs:
        s.update(h)
    for x in target:
        t.update(hist(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    scored = []
    for i, n, h in docs:
        weight = sum(gain(b) * c for b, c in h.items())
        u = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))
        scored.append((i, n, sum(h.values()), weight, score))
    able = sorted((x for x in scored if x[1] >= min_words), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    drawn = able[:percent * len(able) // 100]
    rest = scored.copy()
    for x in drawn:
        rest.remove(x)
    return Counter([(*(x[0], *x[2:]), k + 1) for k, x in enumerate(drawn)] + [(x[0], *x[2:], None) for x in rest])


def _draw_rows():
    rows = [(i, " ".join(f"Wort{(i * k) % 23} straße_{k % 5}" for k in range(i % 40)), "de", "s", None) for i in range(120)]
    rows += [(200, rows[39][1], "de", "s", None)] * 3 + [(None, rows[39][1], "de", "s", None)]
    return rows + [(300, None, None, None, None), (301, "", "en", "s", 0), (302, " .\n", "en", "s", 0),
                   (303, "A\x00b " * 40_000, "en", "s", 0), (304, "x" * 400_000 + " 𝒳y é", "en", "s", 0)]


@pytest.mark.parametrize("max_run,buckets,min_words,percent", [(1, 10_000, 20, 10), (3, 97, 5, 50), (2, 1, 0, 100)])
def test_resampling_against_brute_force(spark, max_run, buckets, min_words, percent):
    rows, target = _draw_rows(), [None, "", "wort7 straße", "Wort7 wort9 " * 20]
    goal = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, n_words int")
    got = ir.resample(_docs(spark, rows), goal, max_run=max_run, buckets=buckets, min_words=min_words, draw_percent=percent)
    assert Counter(map(tuple, got.collect())) == _resample(rows, target, max_run, buckets, min_words, percent)


def test_resampling_with_empty_tables(spark):
    rows = _draw_rows()
    goal = spark.createDataFrame([(1, "wort")], "item_id long, text string")
    assert ir.resample(_docs(spark, rows).limit(0), goal).count() == 0
    got = ir.resample(_docs(spark, rows), goal.limit(0)).collect()
    assert Counter(map(tuple, got)) == _resample(rows, [], 1, 10_000, 20, 10)


def test_words_and_offsets():
    low = "été 12 𝒳y\x00z_q".encode()
    assert [low[a:b].decode() for a, b in ir.word_offsets(ir.splitter(), low.decode())] == _words(low.decode())
