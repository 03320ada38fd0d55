"""Operator 9, quality rules: line-first cleaning.

Each line with a word is judged by itself: navigation (many `|` words), symbol soup, shouting, lines of which boilerplate
phrases are a good part (MENTION of the words, or anything if the line is of under MIN_WORDS words; a mention in prose is none), short lines without closing punctuation, and copies of an earlier line. Lines that fail are removed; a text that loses more
than MAX_LOST of its word characters is rejected. Before that, whole-text base rules reject texts of under
MIN_WORDS words and those in which over MAX_REPEAT percent of the words lie in repeated 5-word windows.

Row-local: no shuffle, and a row's result does not depend on the rows around it. Very long texts are judged whole, in about
twenty bytes of memory a byte. Lines and windows are compared by 64-bit hashes within their text. A line equal to several earlier ones is one
duplicate; shares exactly at a limit: MAX_LOST and MAX_REPEAT still pass, NAVIGATION, SYMBOLS and SHOUTING too, MENTION fails. Null and empty texts have no words, so they
fail the base rules and have an empty cleaned text; null ids pass through; repeated rows get equal results; an empty table
gives no rows; further input columns are ignored by score() and pass through clean(), where the documents' own
columns win over the measures of the same name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnfield.llm import rows, vec

MIN_WORDS, MAX_REPEAT, WINDOW, MAX_LOST = 10, 20, 5, 0.5
#: Shares of a line's words, or letters, from which a line fails.
NAVIGATION, SYMBOLS, SHOUTING = 0.25, 0.5, 0.7
#: A line of at most so many words needs closing punctuation.
SHORT = 3
#: Share of a line's words in boilerplate phrases from which it fails.
MENTION = 0.25
BOILERPLATE = re.compile(rb"(?<![\w\x80-\xff])(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|click here|subscribe (?:now|to our)|licensed under|sign (?:in|up)|javascript)(?![\w\x80-\xff])", re.I)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BAR = np.arange(256) == 0x7C
_UPPER, _LETTER, _CLOSING = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_CLOSING[list(b".!?:;\"')]}")] = True
#: Closing marks beyond ASCII: full stops, question and exclamation marks, colons, ellipses, quotes and brackets of other scripts.
CLOSING = "。．｡！？：；…‥」』】）］｝〉》〕〗〙〛｣”’»›‹«“‘؟۔؛।॥։።፧‽⁇⁈⁉·;᠃။។៕༎།"

_MARKS = sorted({x.encode() for x in CLOSING})

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_chars long, kept boolean"


def _phrases(data: np.ndarray, offsets: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Words in boilerplate phrases of each line. Texts are set apart by line breaks, so no phrase, and no look around one, reaches across."""
    out = np.zeros(len(lo), np.int64)
    begin = offsets[:-1] + np.arange(len(offsets) - 1)
    for m in BOILERPLATE.finditer(np.insert(data, offsets[1:-1], 10).tobytes()):
        text = np.searchsorted(begin, m.start(), "right") - 1
        out[np.searchsorted(lo, m.start() - text, "right") - 1] += m[0].count(b" ") + 1
    return out


def measure(texts: pa.Array, cleaned: bool = False) -> dict:
    """Base measures, verdicts and, if asked, the cleaned texts of a slice."""
    w = vec.Words(texts)
    data, n = w.data, len(texts)
    # windows that are there twice or more in their text
    at, text, hashes = w.windows(WINDOW)
    again = vec.repeated(vec.keyed(hashes, text))
    repeat = vec.sums_by(w.first, vec.covered(at[again], WINDOW, len(w.start)).astype(np.int64))
    # lines: from a text's start or after \n, up to the next \n or the text's end
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(w.offsets, breaks, "right") - 1
    lines_in = np.bincount(owner, minlength=n) + 1
    of = np.repeat(np.arange(n), lines_in)
    lo, hi = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
    head = np.cumsum(lines_in) - lines_in
    tail = np.ones(len(of), bool)
    tail[head] = False
    lo[head], lo[tail] = w.offsets[:-1], breaks + 1
    last = np.zeros(len(of), bool)
    last[head + lines_in - 1] = True
    hi[last], hi[~last] = w.offsets[1:], breaks
    first_word = np.searchsorted(w.start, lo)
    words = np.searchsorted(w.start, hi) - first_word
    full = words > 0
    keys = vec.keyed(vec.ranges(data, lo, hi), of)
    copy = np.zeros(len(of), bool)
    some = np.flatnonzero(full)
    _, original = np.unique(keys[some], return_index=True)
    copy[some] = True
    copy[some[original]] = False
    # line rules
    line_chars = vec.tiled(w.inside & ((data & 0xC0) != 0x80), lo, hi)
    bars, symbols, letters, upper = (vec.tiled(m[data], lo, hi) for m in (_BAR, _SYMBOL, _LETTER, _UPPER))
    closing = np.zeros(len(of), bool)
    last_byte = np.zeros(len(of), np.int64)
    last_byte[some] = w.end[first_word[some] + words[some] - 1] - 1
    closing[some] = _CLOSING[data[last_byte[some]]]
    far = some[data[last_byte[some]] >= 0x80]
    for mark in _MARKS if len(far) else ():  # their last bytes also end letters: all bytes are compared
        at = last_byte[far] - (len(mark) - 1)
        hit = at >= lo[far]
        for i, byte in enumerate(mark):
            hit &= data[np.maximum(at + i, 0)] == byte
        closing[far] |= hit
    fails = (bars > NAVIGATION * words) & (words > 1) | (symbols > SYMBOLS * words) & (symbols > 2) | (upper > SHOUTING * letters) & (words > 3)
    fails |= ~closing & (words <= SHORT) | copy
    phrases = _phrases(data, w.offsets, lo)
    fails |= (phrases > 0) & ((phrases >= MENTION * words) | (words < MIN_WORDS))
    fails &= full
    word_chars = np.bincount(of, line_chars, n).astype(np.int64)
    lost = np.bincount(of[fails], line_chars[fails], n).astype(np.int64)
    failed = (w.count < MIN_WORDS) | (100 * repeat > MAX_REPEAT * w.count)
    out = {
        "n_words": w.count.astype(np.int64), "word_chars": word_chars, "n_symbols": w.per_text(_SYMBOL[data]), "n_dup_lines": np.bincount(of[copy], minlength=n).astype(np.int64),
        "n_repeat_words": repeat, "base_failed": failed, "lost_chars": lost, "kept": ~failed & (lost <= MAX_LOST * word_chars),
    }
    if cleaned:
        raw, result, bad = data.tobytes(), [], np.split(fails, head[1:])
        for k in range(n):
            whole = raw[w.offsets[k] : w.offsets[k + 1]].decode()
            result.append("\n".join(x for x, drop in zip(whole.split("\n"), bad[k], strict=True) if not drop) if bad[k].any() else whole)
        out["cleaned"] = pa.array(result, pa.string())
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every row."""
    return rows.map_texts(docs.select("doc_id", "text"), lambda texts, _: measure(texts), ["doc_id"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def clean(docs: DataFrame) -> DataFrame:
    """The kept rows with their failing lines removed and n_chars, where present, counted anew."""
    names = docs.columns

    def cleaned(texts: pa.Array, part: pa.RecordBatch) -> dict:
        made = measure(texts, cleaned=True)
        return {"text": made["cleaned"], "_kept": made["kept"]}

    plain = docs.select(*names)
    schema = StructType(list(plain.schema.fields)).add("_kept", "boolean")
    out = rows.map_texts(plain, cleaned, names, schema).filter("_kept").select(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(rows.documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
