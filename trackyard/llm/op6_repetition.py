"""Quality rules on repetition coverage, from rolling hashes in numpy.

For several n-gram lengths every n-gram of a text is hashed; the characters inside n-grams
that occurred before in the text, and inside lines that did, are measured as shares of the
text's word characters.  Too large a share, too few words, too many repeated three-word
windows or too many symbols drop the document.

Words are ``[^\\x20\\x09-\\x0D]+``; lines are split at \\n and count only with a word in them.
NULL texts are empty: no words, so the base rule drops them.  A NULL doc_id stays NULL;
repeated rows get a result each; an empty table gives no rows; other columns are not read.
Very long texts are read whole; a task needs memory in proportion to the longest one (some sixty bytes a byte).
Ties: none possible, as every row is judged by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trackyard.llm.common import (U, Words, appended, column_bytes, ddl, grams, mix, pick, prefix_hash, range_hash,
                                  read, text_slices)

MIN_WORDS = 50
WINDOW = 3
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: Largest shares of word characters that may lie in earlier seen n-grams of a length, or lines.
GRAM_SHARES = {5: 0.40, 7: 0.35, 10: 0.30}
LINE_SHARE = 0.30
SYMBOLS_PER_WORD = 0.30

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [*(f"gram{n}_share" for n in GRAM_SHARES), "line_share"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeats(key: np.ndarray, first_too: bool) -> np.ndarray:
    """True where the key occurred before (or, with ``first_too``, occurs elsewhere)."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = (same[:-1] | same[1:]) if first_too else same[:-1]
    return out


def _windows(w: Words, h: np.ndarray, n: int, first_too: bool) -> np.ndarray:
    """For each word: whether a repeated n-word window of its text covers it."""
    edge = np.zeros(len(h) + 1, np.int64)
    if len(h) >= n:
        g = grams(h, n)
        at = np.flatnonzero(w.row[:len(g)] == w.row[n - 1:])
        key = mix(g[at] + w.row[at].astype(U) * U(0x9E3779B97F4A7C15))
        at = at[_repeats(key, first_too)]
        edge[at] += 1
        np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measures(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and shares of each text of a batch."""
    w, rows = Words(data, offs), len(offs) - 1
    sums = lambda at, weights=None: np.bincount(at, weights, rows)
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))       # code points up to a byte
    chars = letters[w.end] - letters[w.start]
    word_chars = sums(w.row, chars)
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    out = {"n_words": w.counts, "word_chars": word_chars, "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]]}

    # lines: each text starts one, and so does each line break in it
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate((offs[:-1], breaks + 1)))
    row_of = np.sort(np.concatenate((np.arange(rows), np.searchsorted(offs, breaks, side="right") - 1)))
    last = np.append(row_of[1:] != row_of[:-1], True)
    ends = np.append(starts[1:] - 1, 0)
    ends[last] = offs[1:]
    first = np.searchsorted(w.start, starts)
    after = np.searchsorted(w.start, ends)
    full = after > first
    starts, ends, row_of, first, after = (x[full] for x in (starts, ends, row_of, first, after))
    line = range_hash(prefix_hash(data.astype(U) + U(1)), starts, ends)
    again = _repeats(mix(line + row_of.astype(U) * U(0x9E3779B97F4A7C15)), False)
    out["n_dup_lines"] = sums(row_of[again])
    total = np.concatenate(([0], np.cumsum(chars)))
    in_lines = sums(row_of[again], (total[after] - total[first])[again])

    h = w.hash
    out["n_repeat_words"] = sums(w.row[_windows(w, h, WINDOW, True)])
    base = np.maximum(word_chars, 1)
    for n in GRAM_SHARES:
        mine = _windows(w, h, n, False)
        out[f"gram{n}_share"] = sums(w.row[mine], chars[mine]) / base
    out["line_share"] = in_lines / base
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)"""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    kept = ~failed & (m["line_share"] <= LINE_SHARE) & (m["n_symbols"] <= SYMBOLS_PER_WORD * m["n_words"])
    for n, most in GRAM_SHARES.items():
        kept &= m[f"gram{n}_share"] <= most
    return failed, kept


RULED = ", ".join([f"{c} long" for c in COLUMNS] + ["base_failed boolean, kept boolean"] + [f"{c} double" for c in SHARES])


def rules(df: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of ``df`` (which has ``text``) with counts, verdicts and shares."""

    def run(batches):
        for b in text_slices(batches):
            m = measures(*column_bytes(b.column("text")))
            failed, kept = verdict(m)
            yield appended(b, keep, **{c: pa.array(m[c].astype(np.int64)) for c in COLUMNS},
                           base_failed=pa.array(failed), kept=pa.array(kept),
                           **{c: pa.array(m[c].astype(float)) for c in SHARES})

    return df.mapInArrow(run, ddl(df, keep, RULED))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: repetition counts and verdict for every document."""
    return rules(pick(read(spark, sf_dir, "documents")), ["doc_id"])
