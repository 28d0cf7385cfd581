import math
import random
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from chronaxis.llm import mixing
from chronaxis.llm.mixing import mix, remix, solve
from tests.llm.fixtures import awkward, frame, query


def totals(spark, made):
    return spark.createDataFrame(list(made.items()), "source string, n_tokens long")


def test_exponent_meets_entropy(spark):
    made = {"a": 90_000, "b": 9_000, "c": 1_000}
    found = solve(totals(spark, made), target_entropy=0.8, max_repeats=None)
    w = {r.source: r.weight for r in found.weights.collect()}
    assert sum(w.values()) == pytest.approx(1)
    assert -sum(x * math.log(x) for x in w.values()) / math.log(3) == pytest.approx(0.8, abs=1e-3)
    raw = {k: (v / 100_000) ** found.exponent for k, v in made.items()}
    assert w["c"] == pytest.approx(raw["c"] / sum(raw.values()))


def test_repetition_limit_binds(spark):
    found = solve(totals(spark, {"a": 90_000, "b": 9_000, "c": 1_000}), target_entropy=1.0, max_repeats=3.0)
    epochs = {r.source: r.epochs for r in found.weights.collect()}
    assert max(epochs.values()) <= 3.0 + 1e-6 and max(epochs.values()) == pytest.approx(3.0, rel=1e-3)
    assert min(epochs.values()) == pytest.approx(1.0)


def test_budgets_and_passes(spark):
    rows = [(i, "w " * 50, None, "big" if i % 10 else "small", None) for i in range(2000)]
    got = mix(frame(spark, rows), target_entropy=1.0, max_repeats=2.5, block_tokens=500).collect()
    seen = defaultdict(Counter)
    for r in got:
        seen[r.source][r.doc_id] += 1
        assert 0 <= r.progress < 1 + 1e-9
    assert set(seen["big"].values()) == {1} and len(seen["big"]) == 1800
    assert set(seen["small"].values()) <= {2, 3} and len(seen["small"]) == 200
    assert sum(seen["small"].values()) == pytest.approx(500, abs=20)
    orders = defaultdict(dict)
    for r in got:
        if r.source == "small":
            orders[r["pass"]].setdefault(r.block, r.progress)
    assert sorted(orders[0], key=orders[0].get) != sorted(orders[1], key=orders[1].get)


def hashed(*values):
    """Chained 64-bit hash of integers (kind, value), texts and nulls, as a signed number."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack(*v), h)
    return h - (1 << 64) if h >> 63 else h


def plain_mix(rows, target_entropy, max_repeats, block_tokens=100_000, seed=7):
    """(doc_id, source, n_tokens, weight, pass, block, progress) of every draw, by plain loops."""
    docs = [(r[0], "" if r[3] is None else "=" + r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), r[1]) for r in rows]
    totals = Counter()
    for _, source, n, _ in docs:
        totals[source] += n
    live = {s: n / sum(totals.values()) for s, n in totals.items() if n}

    def weights(alpha):
        raw = {s: p**alpha for s, p in live.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    def bisect(ok):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid) else (low, mid)
        return low

    def entropy(alpha):
        return -sum(w * math.log(w) for w in weights(alpha).values()) / math.log(len(live)) if len(live) > 1 else 1.0

    def repeats(alpha):
        drawn = [w / live[s] for s, w in weights(alpha).items()]
        return max(drawn) / min(drawn)

    alpha = 1.0 if entropy(1.0) >= target_entropy else bisect(lambda a: entropy(a) >= target_entropy)
    if repeats(alpha) > max_repeats:
        alpha = bisect(lambda a: repeats(a) > max_repeats)
    w = weights(alpha)
    least = min(w[s] / live[s] for s in w)
    out = []
    for source, total in totals.items():
        epochs = round(w[source] / live[source] / least, 9) if total else 1.0
        n_blocks = max(1, math.ceil(total / block_tokens))
        members = defaultdict(list)
        for doc_id, s, n, text in docs:
            if s == source:
                text_hash = hashed(text)
                members[hashed(("<i", seed), None if doc_id is None else ("<q", doc_id), ("<q", text_hash)) % n_blocks].append((doc_id, n))
        for p in range(max(math.ceil(epochs) - 1, 0) + 1):
            keyed = []
            for b in members:
                u = hashed(("<i", seed), source, ("<i", p), ("<q", b))
                keyed.append((((u & (2**64 - 1)) >> 8) % 256, u, b))
            start = 0
            for _, _, b in sorted(keyed):
                size = sum(n for _, n in members[b])
                if not total or epochs - p >= 1 or start + size / 2 <= (epochs - p) * total:
                    out += [(d, source[1:] if source else None, n, w.get(source, 0.0), p, b, (p + start / total) / epochs if total else 0.0) for d, n in members[b]]
                start += size
    return out


def same(got, want):
    key = lambda r: (str(r[0]), str(r[1]), r[4], r[2])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (*a[:3], *a[4:6]) == (*b[:3], *b[4:6]) and (a[3], a[6]) == pytest.approx((b[3], b[6]), abs=1e-6)


def test_query_equals_brute_force(spark, tmp_path):
    rows = [*awkward(), *[(1000 + i, "w " * (i % 7), None, "=" if i % 3 else "", None) for i in range(60)]]
    same([tuple(r) for r in query(spark, "op3_mixing", tmp_path, rows=rows)], plain_mix(rows, 0.98, 4.0))


@pytest.mark.parametrize("few", [0, 10])
def test_blocks_equal_brute_force(spark, monkeypatch, few):
    """Many blocks and passes; weights broadcast and joined by key."""
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(60), None, rng.choice(["hot"] * 20 + ["b", "c", None]), None) for i in range(1500)] + [(1, "twice", None, "b", None)] * 2
    got = mix(frame(spark, rows), target_entropy=0.95, max_repeats=6.0, block_tokens=300).drop("row").collect()
    same([tuple(r) for r in got], plain_mix(rows, 0.95, 6.0, 300))


def test_null_is_no_named_source(spark):
    rows = [(i, "w " * 9, None, s, None) for i, s in enumerate([None, "\0null", "", "=", "null"] * 4)]
    got = mix(frame(spark, rows)).groupBy("source").count().collect()
    assert {r.source for r in got} == {None, "\0null", "", "=", "null"}


def test_names_do_not_clash(spark):
    docs = frame(spark).withColumns({"pass": F.lit(7), "__source": F.lit("mine"), "__hash": F.lit(1), "row": F.lit("r"), "progress": F.lit(2), "a.b": F.lit(3)})
    got = remix(docs, target_entropy=0.98, max_repeats=2.0)
    assert got.columns == docs.columns
    assert {(r["pass"], r["__source"], r["__hash"], r.row, r.progress, r["a.b"], r.block) for r in got.collect()} == {(7, "mine", 1, "r", 2, 3, 0)}


def test_awkward_rows_are_all_there(spark, tmp_path):
    got = query(spark, "op3_mixing", tmp_path)
    assert {r.doc_id for r in got} == {r[0] for r in awkward()}
    assert {r.source for r in got} == {"a", "b", None}


def test_remix_keeps_columns(spark):
    docs = frame(spark)
    got = remix(docs, target_entropy=0.98, max_repeats=2.0)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.select("doc_id").collect()} == {r[0] for r in awkward()}


def test_empty_table(spark, tmp_path):
    assert query(spark, "op3_mixing", tmp_path, rows=[]) == []
