import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from chronaxis.llm import hidden_markov as hm
from tests.llm.fixtures import awkward, frame, query


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [b""]


def held_out(doc_id):
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 5 == 1


def tiny(seed=0):
    rng = np.random.default_rng(seed)
    emit = rng.dirichlet(np.ones(hm.CLASSES), 3)
    return hm.States(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), emit)


def test_forward_equals_sum_over_paths():
    states, sequences = tiny(), [np.array([5, 9, 0]), np.array([0]), np.array([7, 7, 7, 0])]
    got = hm.forward(np.concatenate(sequences), states)
    for like, seq in zip(got, sequences, strict=True):
        total = 0.0
        for path in product(range(3), repeat=len(seq)):
            p = states.start[path[0]] * states.emit[path[0], seq[0]]
            for t in range(1, len(seq)):
                p *= states.move[path[t - 1], path[t]] * states.emit[path[t], seq[t]]
            total += p
        assert like == pytest.approx(math.log(total))


def test_expected_counts_equal_sum_over_paths():
    states, sequences = tiny(1), [np.array([5, 9, 0]), np.array([9, 5, 5, 0]), np.array([0])]
    starts, moves, emits, like = hm.expected_counts(np.concatenate(sequences), states)
    want_s, want_m, want_e = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hm.CLASSES))
    for seq in sequences:
        paths = list(product(range(3), repeat=len(seq)))
        ps = np.array([states.start[p[0]] * states.emit[p[0], seq[0]] * np.prod([states.move[p[t - 1], p[t]] * states.emit[p[t], seq[t]] for t in range(1, len(seq))]) for p in paths])
        for p, w in zip(paths, ps / ps.sum(), strict=True):
            want_s[p[0]] += w
            for t in range(len(seq)):
                want_e[p[t], seq[t]] += w
                if t:
                    want_m[p[t - 1], p[t]] += w
    assert starts == pytest.approx(want_s, abs=1e-5)
    assert moves == pytest.approx(want_m, abs=1e-5)
    assert emits == pytest.approx(want_e, abs=1e-5)
    assert like == pytest.approx(hm.forward(np.concatenate(sequences), states).sum())


def test_streams_hold_every_word():
    texts = [" Ab  c\n", None, "", "\x1c \x85\tÜber ABER", "x", " ", "über aber"]
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    edges, data = hm.flat_bytes(column)
    words, rows = hm.split_words(edges, data)
    got = [[] for _ in texts]
    for w, r in zip(words.to_pylist(), rows, strict=True):
        got[r].append(w)
    assert got == [words_of(t) for t in texts]
    stream = hm.class_stream(edges, data)
    assert stream.tolist() == [c for t in texts for c in hm.word_classes(pa.array(words_of(t), pa.binary()))]
    assert np.array_equal(hm.word_classes(pa.array([b"xaber", b"aber"])), hm.word_classes(pa.array([b"yaber", b"aber"]))) and (stream == 0).sum() == len(texts)
    encoded = next(hm._encode(iter([pa.record_batch([pa.nulls(len(texts)), column], names=["doc_id", "text"])])))
    assert [np.frombuffer(x, np.uint16)[-1] for x in encoded.column(0).to_pylist()] == [0] * len(texts)
    assert np.array_equal(next(hm._lots(iter([encoded]))), stream)


def test_likelihood_grows(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["un deux trois quatre", "one two three four"][i % 2].split()) for _ in range(30)) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    likes = hm.HiddenMarkovModel.train(docs, iterations=4).likelihoods
    assert all(b > a - 0.01 * abs(a) for a, b in zip(likes, likes[1:], strict=False))  # the prior may cost a little


@pytest.mark.parametrize("head", [50_000, 3])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, head):
    """Base columns by counting; the score by the model's own states and plain loops."""
    monkeypatch.setattr(hm, "HEAD", head)
    got = query(spark, "op1_hidden_markov", tmp_path)
    rows = awkward()
    counts = Counter(w for r in rows if not held_out(r[0]) for w in words_of(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(r[0]), len(w := words_of(r[1])), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4), held_out(r[0])) for r in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4), r.held_out) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    docs = frame(spark)
    from chronaxis.llm.common import crc_bucket
    from pyspark.sql import functions as F

    model = hm.HiddenMarkovModel.train(docs.filter(crc_bucket(F.col("doc_id"), 5) != 1))
    plain = []
    for r in rows:
        w = words_of(r[1])
        g = hm.word_classes(pa.array(w, pa.binary()))
        like = hm.forward(g, model.states)[0] / math.log(10)
        plain.append((str(r[0]), round(like + sum(math.log10((counts[x] + 0.5) / (model.class_tokens[c] + 0.5 * (model.class_distinct[c] + 1))) for x, c in zip(w, g, strict=True)), 4)))
    for (a, x), (b, y) in zip(sorted(plain), sorted((str(r.doc_id), r.score) for r in got), strict=True):
        assert a == b and x == pytest.approx(y, rel=1e-4)


def test_beats_the_base_on_held_out_texts(spark):
    from chronaxis.llm.queries import op1_hidden_markov

    got = [r for r in op1_hidden_markov(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty_tables(spark, tmp_path):
    assert query(spark, "op1_hidden_markov", tmp_path, rows=[]) == []
    one = next(i for i in range(100) if held_out(i))
    got = query(spark, "op1_hidden_markov", tmp_path, rows=[(one, "only held out", "en", "a", 1)])  # nothing to learn from
    assert got[0].n_known == 0 and got[0].train_tokens == 0 and math.isfinite(got[0].score)
