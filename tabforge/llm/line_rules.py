"""Line-first quality rules.

Every line of a text is judged on its own; failing lines are taken out, and a
document that loses too much of its text that way is rejected.

A line fails by
* ``symbols``: many characters of ``#*$%&<>`` for its number of words;
* ``navigation``: many ``|`` separators, or only words of a menu;
* ``punctuation``: no letter or digit at all, or shouting (most of its words
  end in a run of exclamation or question marks);
* ``boilerplate``: a licence, copyright, cookie or sign-up phrase;
* ``stutter``: a good part of its words repeat the word before;
* ``repeat``: it equals an earlier line.

A document is rejected if its words are too few, if too many of them stand in
repeated five-word windows (the base rules), or if the failing lines hold
more than half of its word characters.  Every occurrence of a failing line
counts, by whichever rule it fails.  The text of a kept document is what its
passing lines leave.

Null text: no words, hence rejected.  Empty text likewise.  Repeated rows are
judged alike.  All in one pass over the rows, without a shuffle.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20     # of the words, in repeated five-word windows
WINDOW = 5
MAX_LOST_PERCENT = 50       # of the word characters, in failing lines
SYMBOLS_PER_10_WORDS = 3
BARS_PER_10_WORDS = 3
STUTTER_PERCENT = 30

# Words of menus and phrases of boilerplate lines.
MENU_WORDS = frozenset("""home login logout register menu sitemap search next previous back top contact
about help faq share print impressum startseite anmelden suche weiter zurück accueil connexion rechercher
suivant inicio buscar siguiente anterior""".split())
BOILERPLATE = ("licensed under", "all rights reserved", "copyright (c)", "©", "terms of service",
               "terms of use", "privacy policy", "cookie policy", "we use cookies", "enable javascript",
               "subscribe to our newsletter", "sign up for our newsletter", "alle rechte vorbehalten",
               "tous droits réservés", "todos los derechos reservados")

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SHOUT = re.compile(r"[!?]{2}(?![^\x20\x09-\x0D])")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_P = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[str]) -> int:
    """Words that stand in a window found twice or more in the text."""
    m = len(words) - WINDOW + 1
    if m < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    acc = np.zeros(m, np.uint64)
    for i in range(WINDOW):
        acc = acc * _P + h[i:i + m]
    order = np.argsort(acc, kind="stable")
    same = acc[order[1:]] == acc[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(m, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(words), bool)
    for i in range(WINDOW):
        cover[i:i + m] |= hit
    return int(cover.sum())


def line_fault(line: str, words: list[str]) -> str | None:
    """Name of the rule that the line, with these words, fails by itself, if
    any."""
    n = len(words)
    bars = line.count("|")
    if 10 * (sum(map(line.count, _SYMBOLS)) - bars) > SYMBOLS_PER_10_WORDS * n:
        return "symbols"
    if 10 * bars > BARS_PER_10_WORDS * n or n <= 6 and all(w.lower() in MENU_WORDS for w in words):
        return "navigation"
    if ("!!" in line or "?" in line) and 2 * len(_SHOUT.findall(line)) > n or not any(map(str.isalnum, line)):
        return "punctuation"
    if n >= 5 and 100 * sum(map(eq, words, words[1:])) > STUTTER_PERCENT * n:
        return "stutter"
    low = line.lower()
    return "boilerplate" if any(p in low for p in BOILERPLATE) else None


def judge(text: str) -> dict:
    """Base counts, verdicts and cleaned text of one text."""
    split = _WORDS.findall if _OTHER_SPACE.search(text) else str.split
    words, seen, dup, lost, kept = [], set(), 0, 0, []
    for line in text.split("\n"):
        own = split(line)
        if not own:
            kept.append(line)
            continue
        words += own
        if line in seen:
            dup += 1
            fault = "repeat"
        else:
            seen.add(line)
            fault = line_fault(line, own)
        if fault is None:
            kept.append(line)
            continue
        lost += sum(map(len, own))
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _SPACE))
    repeats = repeat_words(words)
    base_failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    return {"n_words": n, "word_chars": word_chars, "n_symbols": sum(map(text.count, _SYMBOLS)),
            "n_dup_lines": dup, "n_repeat_words": repeats, "base_failed": base_failed,
            "kept": not base_failed and 100 * lost <= MAX_LOST_PERCENT * word_chars,
            "clean_text": "\n".join(kept)}


_TYPES = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
          "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}
_SQL = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    with_text: bool = False) -> DataFrame:
    """id, base counts, base_failed, kept of each row, and with ``with_text``
    the text without its failing and repeated lines."""
    names = [k for k in _TYPES if with_text or k != "clean_text"]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [judge(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([g[k] for g in got], _TYPES[k]) for k in names)], names=[id_col, *names])
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {id_type}, " + ", ".join(f"{k} {_SQL[_TYPES[k]]}" for k in names))


def clean_good(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Rows of ``docs`` that are kept, all columns, with the failing lines
    taken out of their text; a count of characters beside it, unless null,
    is made that of the new text."""
    at = docs.columns.index(text_col)
    count = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for b in batches:
            got = [judge(t or "") for t in b.column(at).to_pylist()]
            good = [g["kept"] for g in got]
            b, texts = b.filter(pa.array(good, pa.bool_())), [g["clean_text"] for g in got if g["kept"]]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if count is not None:
                cols[count] = pa.array([None if old is None else len(t) for old, t in zip(cols[count].to_pylist(), texts)],
                                       b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)
    return docs.mapInArrow(run, docs.schema)
