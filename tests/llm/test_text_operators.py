"""Line rules, toxicity, SentencePiece and HTML against brute force,
held-out accuracy and the public library."""

import html
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm import html_lstm, line_rules, sentencepiece_unigram as spu, toxicity
from tabforge.llm.common import read

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_base_counts_against_brute_force(spark, words):
    random.seed(1)
    texts = [" ".join(random.choices("a b c d e | x# y$".split(), k=random.randint(0, 60)))
             .replace(" e", "\n") for _ in range(300)] + [None, "", "\n \n", "x" * 50_000, "é ü\x0b\x0cß\n" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_rules.judge_documents(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = words(t)
        seen = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if seen[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover),
                len(w) < 10 or 100 * len(cover) > 20 * len(w))
        r = got[i]
        assert want == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                        r["base_failed"])
        assert not (r["base_failed"] and r["kept"])


def test_lines_are_removed_before_the_document_is_judged(spark):
    prose = "\n".join(" ".join(f"word{i}{c}" for c in "abcdefghijkl") + "." for i in range(8))
    junk = "home | login | menu | search\n### $$$ %%% &&&\nWOW!! BUY!! NOW!! CHEAP!!\nAll rights reserved.\n"
    df = spark.createDataFrame([(1, junk + prose), (2, junk * 8 + "one line of prose is too little here.")],
                               "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_rules.judge_documents(df, with_text=True).collect()}
    assert got[1]["kept"] and got[1]["clean_text"].strip() == prose
    assert not got[2]["kept"]


def test_every_failing_line_counts_against_the_document():
    legal = "\n".join(f"licensed under word{i} name{i}" for i in range(20))
    junk = "\n".join(f"########## $$$$$$$$$$\nword{i} name{i}" for i in range(30))
    lines = "\n".join(f"only line\nw{i}" for i in range(30))
    for text in (legal, junk, lines):
        got = line_rules.judge(text)
        assert not got["base_failed"] and not got["kept"]
    prose = "ten short words of a clean text that shall stay"
    licence = "This work is licensed under the terms of a licence whose long name stands here"
    # a lone boilerplate line counts like any other
    assert not line_rules.judge(licence + "\n" + prose)["kept"] and line_rules.judge(
        licence + "\n" + prose + " and nine more words follow here so that most of it stays")["kept"]
    assert not line_rules.judge(licence)["kept"] and not line_rules.judge((licence + "\n") * 2 + prose)["kept"]


def test_kept_documents_lose_their_failing_lines(spark):
    prose = "\n".join(" ".join(f"word{i}{c}" for c in "abcdefghijkl") + "." for i in range(8))
    junk = "home | login | menu | search\nAll rights reserved.\n"
    df = spark.createDataFrame([(1, junk + prose, 400), (2, junk, 50), (3, prose, None), (4, None, None)],
                               "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_rules.clean_good(df).collect()}
    assert got == {1: (prose, len(prose)), 3: (prose, None)}


def test_one_boilerplate_line_can_reject():
    text = "copyright (c) " + "word " * 600 + "\ntwo more"
    assert not line_rules.judge(text)["kept"]


def test_quality_labels_of_documents(spark):
    docs = read(spark, SF, "documents").join(read(spark, SF, "labels"), "doc_id")
    got = line_rules.judge_documents(docs).join(read(spark, SF, "labels").select("doc_id", "quality"), "doc_id")
    wrong = got.where("(quality = 0 and kept) or (quality = 1 and not kept and not base_failed)").count()
    assert wrong <= 0.01 * got.count()


def test_filters_keep_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "few words", "x", 5), (2, None, None, None)],
                               "doc_id long, text string, kept string, n_words int")
    assert line_rules.clean_good(df).columns == df.columns and line_rules.clean_good(df).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_rules.judge_documents(empty).count() == 0
    model = {"lexicon": {}, "weights": None}
    assert toxicity.drop_toxic(df, model).collect() == df.collect()
    assert toxicity.score_documents(empty, model).count() == 0


# --- toxicity

def test_composed_grammar_tells_clause_kinds():
    symbols = toxicity._Symbols({"gloop": 2.0, "zarg*": 3.0})
    kinds = lambda t: dict(zip(toxicity.KINDS, toxicity.clause_weights(t, symbols)))
    assert kinds("what a gloop.")["plain"] == 2.0
    assert kinds("you are a gloop")["aimed"] == 2.0
    assert kinds("this is not a gloop")["negated"] == 2.0
    assert kinds("not one two three four five gloop")["negated"] == 0.0
    assert kinds("they said the zargon thing. fine")["reported"] == 3.0
    assert kinds("I will kill you")["threat"] == 1.0
    assert kinds("we kill time")["threat"] == 0.0
    assert kinds("gloop. gloop zargs! all fine")["plain"] == 5.0
    assert not any(kinds("").values()) and not any(kinds("you are kind").values())


def test_held_out_toxicity(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score_documents(docs, model)
    assert got.count() == docs.count()
    rows = got.where(toxicity.held_out()).join(labels, "doc_id").collect()
    right = sum((r["score"] >= toxicity.THRESHOLD) == bool(r["toxic"]) for r in rows)
    # the few labels of this table do not show every language's words
    assert right >= 0.93 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, f"plain words {i}" + (" blarg you" if i % 3 == 0 else "")) for i in range(60)]
                                 + [(None, None), (60, ""), (0, "plain words 0 blarg you")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (5, None), (99, 1)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == 63
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert (r["score"] >= 0.3) == (r["doc_id"] % 3 == 0)
        else:
            assert r["score"] < 0.3
    assert toxicity.fit(docs, labels.where("toxic = 0"))["weights"] is None


# --- SentencePiece

def test_unigram_equals_the_public_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    pieces = spu.load_pieces(spu.default_model())
    proto = pb.ModelProto()
    with open(spu.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    for p, (_, kind, score) in zip(proto.pieces, pieces):
        if kind == 1:
            p.score = score / spu.UNIT
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    random.seed(2)
    texts = ["".join(random.choice("ab the▁  \n\té中😀x1,.") for _ in range(random.randint(0, 40))) for _ in range(1500)]
    texts += ["", "word " * 5000, "日本語のテキスト", "a\n\n\nb", "   "]
    uni = spu.Unigram(pieces)
    for t, z in zip(texts, uni.encode_batch(texts)):
        ids = np.frombuffer(z, "<u4")
        assert ids.tolist() == library.encode(t)
        assert uni.decode(ids) == library.decode(ids.tolist())


def test_round_trip_of_rows(spark):
    texts = ["plain text", None, "", "tabs\tand\nlines", "sign 𓀀 中", "a▁b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in spu.round_trip(df).collect()}
    assert [got[i]["round_trip"] for i in range(6)] == [True, True, True, True, True, False]
    assert got[1]["n_ids"] == 0 and got[4]["n_byte_ids"] > 0
    assert spu.round_trip(df.limit(0)).count() == 0


# --- HTML

def test_labeller_on_generated_pages():
    rng, right, total = random.Random(1234), 0, 0
    ex = html_lstm.Extractor(html_lstm.train())
    for _ in range(150):
        page, labels = html_lstm.generate_page(rng)
        blocks = html_lstm.blocks_of(page)
        assert len(blocks) == len(labels)
        x, mask = html_lstm._pad([ex.vectors(blocks)])
        got = html_lstm.logits(x, mask, ex.net)[0][:, 0] > 0
        right += int((got == np.array(labels)).sum())
        total += len(labels)
    assert right >= 0.98 * total


def test_articles_of_the_pages_table(spark):
    pages = read(spark, SF, "pages")
    got = {r["page_id"]: r for r in html_lstm.extract_pages(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        text = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>|</?p>|</?h1>", " ", inner)))
        assert got[r["page_id"]]["text"] == " ".join(text.split())
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_html_edges(spark):
    odd = [None, "", "<p", "<div><p>a<div>b</p></i>c", "<!-- open", "x" * 200_000, "<script>var a='<p>';</script>",
           "<ul>" + "<li>y" * 3000]
    df = spark.createDataFrame([(i, None, h, "x") for i, h in enumerate(odd)],
                               "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_lstm.extract_pages(df).collect()}
    assert len(got) == len(odd) and got[0]["text"] == "" and got[1]["n_chars"] == 0 and got[6]["text"] == ""
    assert [b.text for b in html_lstm.blocks_of("<p>a &amp; b&lt;<b>c</b>d\n e<br>f<p>g")] == ["a & b<cd e f", "g"]


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a \"" * 250_000 + ">", "<div>x" * 100_000, "<div>" * 50_000 + "</p>x" * 50_000,
                                  "<!" * 500_000, "<script>x" * 100_000, "<a<b " * 200_000 + "\">"])
def test_broken_markup_takes_linear_time(page):
    import time
    began = time.time()
    blocks = html_lstm.blocks_of(page)
    html_lstm.Vectors()(blocks) if blocks else None
    assert time.time() - began < 20
