import re
from collections import Counter

import numpy as np
import pytest

from chronaxis.llm import quality
from tests.llm.fixtures import SF, awkward, query


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    marked = [False] * len(words)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            marked[i : i + 5] = [True] * 5
    n = len(words)
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(marked), n < 10 or 100 * sum(marked) > 20 * n]


def test_query_equals_brute_force(spark, tmp_path):
    line = "a repeated line of some eight or nine words\n"
    extra = [(1000, line * 3 + "and a tail " * 4, "en", "a", 1), (1001, "# * $ % & | < > ##\n\n \n", None, None, 1), (1002, "x " * 40, None, None, 1)]
    rows = awkward() + extra
    got = query(spark, "op6_quality", tmp_path, rows=rows)
    want = sorted([str(r[0]), *plain(r[1])] for r in rows)
    assert sorted([str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_given_documents(spark):
    from chronaxis.llm.queries import op6_quality

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op6_quality(spark, SF).collect():
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] == plain(texts[r.doc_id])


@pytest.mark.parametrize("n", [2, 5, 9])
def test_coverage_by_brute_force(n):
    rng = np.random.default_rng(n)
    for size in (0, 1, n, 40, 200):
        words = rng.integers(0, 4, size)
        seen = Counter(tuple(words[i : i + n]) for i in range(size - n + 1))
        want = np.zeros(size, bool)
        for i in range(size - n + 1):
            if seen[tuple(words[i : i + n])] > 1:
                want[i : i + n] = True
        hashes = np.array([hash(bytes([w])) for w in words], np.int64).view(np.uint64) if size else np.zeros(0, np.uint64)
        assert (quality.repeated(hashes, n) == want).all()


def test_repeated_lines_are_rejected(spark):
    text = b"\n".join([b"some quite long line that is here again", b"one more", b"some quite long line that is here again", b"other words entirely, new ones, unlike any before it"])
    assert quality.measure(text)[3] == 1


def test_empty_table(spark, tmp_path):
    assert query(spark, "op6_quality", tmp_path, rows=[]) == []
