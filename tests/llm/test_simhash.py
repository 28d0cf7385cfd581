import random

import numpy as np
import pytest
import xxhash

from chronaxis.llm import common, simhash
from tests.llm.fixtures import awkward, frame, query


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    k = min(4, len(words))
    ones, n = [0] * 64, len(words) - k + 1
    for i in range(n):
        h = xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > n)


def brute_components(fps):
    """Index of the least reachable item, for each item."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_query_equals_brute_force(spark, tmp_path):
    rows = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0))
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = sorted((str(r[0]), f"{fp:016x}", str(rows[c][0])) for r, fp, c in zip(rows, fps, brute_components(fps), strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in query(spark, "op5_simhash", tmp_path))
    assert got == want


def test_long_lists_are_exact(spark):
    """Dense clusters, with lists both under and over the limit."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fp = centre
            for _ in range(rng.randrange(7)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    signed = sorted(int(np.uint64(x).view(np.int64)) for x in fps)
    items = [x & (2**64 - 1) for x in signed]
    want = {signed[i]: signed[c] for i, c in enumerate(brute_components(items))}
    for limit in (3, 20_000):
        df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
        got = {r.node: r.root for r in simhash.components(simhash.links(df, limit)).collect()}
        assert {x: got.get(x, x) for x in signed} == want


@pytest.mark.parametrize("hot", [3, 1000])
def test_components_of_stars_and_paths(spark, monkeypatch, hot):
    """A star with a third of all links, a long path and small cycles, with and without the split of busy nodes."""
    monkeypatch.setattr(simhash, "join_to_groups", lambda *a: common.join_to_groups(*a, hot=hot, least=hot))
    path = list(range(5000, 5200))
    random.Random(2).shuffle(path)
    edges = [(-7, i) for i in range(300)] + list(zip(path, path[1:], strict=False)) + [(9000 + i, 9000 + (i + 1) % 5) for i in range(5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {-7: -7, **dict.fromkeys(range(300), -7), **dict.fromkeys(path, 5000), **dict.fromkeys(range(9000, 9005), 9000)}


def test_drop_near_copies(spark):
    docs = frame(spark)
    got = simhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert got.count() == len(set(brute_components([plain_fingerprint(r[1]) for r in awkward()])))


def test_empty_table(spark, tmp_path):
    assert query(spark, "op5_simhash", tmp_path, rows=[]) == []
