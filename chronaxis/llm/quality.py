"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words get 64-bit hashes; for several n the hashes of all windows roll over the
text in numpy, windows whose hash occurs twice or more mark their words, and the
marked characters are measured against all.  The hashes are of one text only, so
chance equality (about n squared over 2^64) doesn't matter.

A text fails the base rules if it has under ten words, or if over a fifth of its
words lie in repeated five-word windows.  The method also rejects texts where repeated
windows of any other length (short ones find a phrase that recurs with other words
about it), or the repeated lines, cover more than ``LIMITS`` of the characters.

Cases: null text counts as empty: no words, base_failed; repeated rows each return a
row; an empty table gives no rows; whole texts are read, however long; only the text
and the id are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, as_bytes, slices

SYMBOLS = b"#*$%&|<>"
#: Greatest share of the characters in words that repeated windows of n words may cover.
LIMITS = {2: 0.40, 3: 0.30, 4: 0.25, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
LINE_LIMIT = 0.30
MIN_WORDS, WINDOW, MAX_PERCENT = 10, 5, 20
NGRAMS = tuple(range(2, 11))
_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _COLUMNS) + ", base_failed boolean, kept boolean, dup_line_share double, " + ", ".join(f"dup_{n}gram_share double" for n in NGRAMS)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated(hashes: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether it lies in a window of ``n`` words that occurs twice or more."""
    size = len(hashes) - n + 1
    marked = np.zeros(len(hashes), bool)
    if size < 2:
        return marked
    rolled = hashes[:size].copy()
    for i in range(1, n):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * _MIX + hashes[i : i + size]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return marked
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.searchsorted(twice, rolled)
    at[at == len(twice)] = 0
    starts = np.flatnonzero(twice[at] == rolled)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: bytes) -> list:
    """The columns of ``SCHEMA`` after the id."""
    words = text.split()
    n_words = len(words)
    continued = lambda b: int(np.count_nonzero((np.frombuffer(b, np.uint8) & 0xC0) == 0x80))
    word_chars = len(text) - continued(text) - sum(text.count(bytes([c])) for c in SPACE_BYTES)
    n_symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE_BYTES)]
    n_dup_lines, line_share = 0, 0.0
    if len(lines) > 1 and len(distinct := set(lines)) < len(lines):
        n_dup_lines = len(lines) - len(distinct)
        all_chars = sum(map(len, lines))
        line_share = (all_chars - sum(map(len, distinct))) / all_chars
    shares = dict.fromkeys(NGRAMS, 0.0)
    n_repeat = 0
    if n_words:
        hashes = np.fromiter(map(hash, words), np.int64, n_words).view(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, n_words)
        total = int(sizes.sum())
        for n in NGRAMS:
            marked = repeated(hashes, n)
            if not marked.any():
                break  # a longer window can't repeat where a shorter doesn't
            shares[n] = float(sizes[marked].sum() / total)
            if n == WINDOW:
                n_repeat = int(marked.sum())
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_PERCENT * n_words
    kept = not failed and line_share <= LINE_LIMIT and all(shares[n] <= limit for n, limit in LIMITS.items())
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, kept, line_share, *shares.values()]


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row; see ``SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *_COLUMNS, "base_failed", "kept", "dup_line_share", *[f"dup_{n}gram_share" for n in NGRAMS]]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * (1 + len(NGRAMS))
        for batch in slices(batches):
            made = list(zip(*map(measure, as_bytes(batch.column(1))), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(made, kinds, strict=True)]], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
