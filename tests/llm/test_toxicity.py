import math
import random
import zlib

import numpy as np
import pytest

from chronaxis.llm.toxicity import FuzzyTrie, Matcher, ToxicityModel, edits, induce
from tests.llm.fixtures import SF, awkward, frame, query

LABELS = "doc_id long, quality int, toxic int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = [("idiot", False, 1.0), ("worthless", False, 2.0), ("scum", False, 1.0), ("pathet", True, 1.5)]
    trie = FuzzyTrie(terms)
    for _ in range(4000):
        base = list(rng.choice([t[0] for t in terms]) + rng.choice(["", "ic", "s"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(1, len(base))
            base[at : at + rng.randrange(2)] = rng.choice(["", "x", "e"])
        word = "".join(base)
        want = []
        for text, stem, _ in terms:
            heads = [word[:k] for k in range(len(word) + 1)] if stem else [word]
            best = min(distance(text, h) for h in heads if h[:1] == text[0]) if word[:1] == text[0] else 99
            if best <= edits(text, stem):
                want.append(best)
        found = trie.match(word)
        assert (found[0] if found else None) == (min(want) if want else None), word


def test_automaton_edits_any_letter():
    rng = random.Random(4)
    terms = [("idiot", False, 1.0), ("worthless", False, 2.0), ("scum", False, 1.0), ("pathet", True, 1.5)]
    trie = FuzzyTrie(terms)
    assert all(trie.match(w) for w in ("xdiot", "diot", "1diot", "aidiot", "orthless", "owrthless", "athetic"))
    for _ in range(4000):
        base = list(rng.choice([t[0] for t in terms]) + rng.choice(["", "ic", "s"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(base))
            base[at : at + rng.randrange(2)] = rng.choice(["", "x", "e"])
        word = "".join(base)
        want = []
        for text, stem, _ in terms:
            best = min(distance(text, h) for h in ([word[:k] for k in range(len(word) + 1)] if stem else [word]))
            if best <= edits(text, stem):
                want.append(best)
        found = trie.match(word)
        assert (found[0] if found else None) == (min(want) if want else None), word


def test_words_stay_beside_a_stem_that_forgives_less(spark):
    rng = random.Random(5)
    rows = [(" ".join([f"w{rng.randrange(300)}" for _ in range(30)] + ([rng.choice(["idiot", "idiots"])] if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(400)]
    terms = induce(spark.createDataFrame(rows, "text string, toxic int"))
    found = {(t, stem) for t, stem, _ in terms}
    assert any(stem and "idiot".startswith(t) for t, stem in found) and {("idiot", False), ("idiots", False)} <= found
    trie = FuzzyTrie(terms)
    assert all(trie.match(w) for w in ("idiiot", "diot", "idots"))


def test_quotation_is_told_from_abuse():
    matcher = Matcher([("idiot", False, 3.0)])
    abuse, quoted, typo = matcher.features(b"you are an idiot ok"), matcher.features(b'he said "idiot" to me'), matcher.features(b"you idoit idiott ok")
    assert abuse[0] > 0 and abuse[2] == 0
    assert quoted[0] == 0 and quoted[2] > 0
    assert typo[1] > 0


def test_the_score_decides_over_quoted_hits(spark):
    weights = [0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 0.0, -1.0]
    rows = frame(spark, [(1, 'he said "idiot" to me', "en", "s", 0), (2, "nothing here", "en", "s", 0), (3, "you idiot there", "en", "s", 0)])
    for bias, want in ((-1.0, {2, 3}), (1.0, {2}), (-9.0, {1, 2, 3})):
        model = ToxicityModel([("idiot", False, 3.0)], [*weights[:-1], bias])
        scores = {r.doc_id: r.score for r in model.score(rows).collect()}
        kept = {r.doc_id for r in model.keep_clean(rows).collect()}
        assert kept == want == {i for i, x in scores.items() if x < 0.5 or i == 2}


def test_planted_terms_are_learned(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        if toxic := i % 5 == 0:
            words[rng.randrange(60)] = rng.choice(["grumblor", "snarkel"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    model = ToxicityModel.fit(frame(spark, rows[:500]), spark.createDataFrame(labels[:500], LABELS))
    assert {"grumblor", "snarkel"} <= {t[0] for t in model.terms}
    more = [(900, "such a grumblr here", "en", "s", 0), (901, "w1 w2 w3", "en", "s", 0), (902, None, None, None, None)]
    got = {r.doc_id: r.score for r in model.score(frame(spark, rows[500:] + more)).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(500, 600))
    assert got[900] > got[901] and got[901] == pytest.approx(got[902])
    kept = model.keep_clean(frame(spark, rows[500:]))
    assert kept.columns == frame(spark, []).columns and kept.count() == 80


def plain_terms(rows):
    """The lexicon of (text, toxic) rows, counted word by word."""
    from chronaxis.llm.toxicity import core

    counts, total = {}, [0, 0]
    for text, toxic in rows:
        cores = {core(w) for w in (text or "").lower().encode().split()}
        total[toxic] += 1
        words = {(c, False) for c in cores if 3 <= len(c) <= 32 and c[0].isalpha()}
        for key in words | {(c[:k], True) for c in cores for k in (4, 5, 6) if len(c) >= k and c[0].isalpha()}:
            counts.setdefault(key, [0, 0])[toxic] += 1
    rate, ranked = total[1] / sum(total), []
    for (term, stem), (n, p) in counts.items():
        g2 = 2 * sum(x * math.log(x / ((p + n) * r)) for x, r in ((p, rate), (n, 1 - rate)) if x)
        if p >= 4 and (p + 0.5) / (total[1] + 1) / ((n + 0.5) / (total[0] + 1)) >= 6 and g2 >= 15:
            ranked.append((-round(g2, 6), stem, -len(term), term, p / (p + n), math.log((p + 0.5) / (n + 0.5))))
    out, beside = [], []
    for _, stem, _, term, precision, weight in sorted(ranked):
        over = [x for x in out if (x[1] and term.startswith(x[0])) or (stem and x[0].startswith(term))]
        if not any(precision < x[3] + 0.15 for x in over):
            out.append((term, stem, weight, precision))
        elif not stem and all(edits(x[0], x[1]) < edits(term, False) for x in over):
            beside.append((term, stem, weight))
    return [x[:3] for x in out] + beside


def plain_features(text, terms):
    from chronaxis.llm.toxicity import QUOTES, SAYING, core

    words = [w.decode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    hits = []
    for i, w in enumerate(words):
        c = core(w.encode())
        near = [(min(distance(t, c[:k]) for k in (range(len(c) + 1) if stem else [len(c)])), -weight, n) for n, (t, stem, weight) in enumerate(terms)]
        near = [x for x in near if x[0] <= edits(*terms[x[2]][:2])]
        if near:
            around = words[max(0, i - 4) : i + 5]
            hits.append((*min(near), any(q in x for x in around for q in QUOTES[:6]) or any(core(x.encode()) in SAYING for x in around)))
    live = [h for h in hits if not h[3]]
    fuzzy = [h for h in live if h[0]]
    best = max([-h[1] * (1 - 0.15 * h[0]) for h in live] + [0.0])
    log = math.log1p
    return [log(len(live)), log(len(fuzzy)), log(len(hits) - len(live)), log(len({h[2] for h in live})), best, max([-h[1] for h in fuzzy] + [0.0]), log(1000 * len(live) / max(len(words), 1)), 1.0]


def plain_fit(x, y):
    """The ridge-logistic optimum by Newton steps that are halved until the loss falls."""
    penalty = np.array([0.1] * (x.shape[1] - 1) + [1e-6])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * penalty @ (w * w)
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (p - y) + penalty * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w - size * step
    return w


def test_query_equals_brute_force(spark, tmp_path):
    """Lexicon, edit distances, windows and weights by plain loops, over awkward rows and planted terms."""
    rng = random.Random(6)
    rows, labels = [r for r in awkward(n=30) if len(r[1] or "") < 5000], []
    for i in range(1000, 1300):
        words = [f"w{rng.randrange(60)}" for _ in range(25)]
        if toxic := i % 4 == 0:
            words[rng.randrange(25)] = rng.choice(["grumblor", "Grumblors!", "snark", "snrk", "grmblor", "snarks"])
        if i % 7 == 0:
            at = rng.randrange(20)
            words[at : at + 3] = ['"you', rng.choice(["grumblor", "snark"]), 'said"']
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    labels += [(3, 1, 0), (4, 0, None), (None, 1, 1), (1001, 0, 1), (1001, 0, 1), (77_777, 0, 1)]
    got = query(spark, "op10_toxicity", tmp_path, rows=rows, labels=spark.createDataFrame(labels, LABELS).repartition(3))
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 0
    votes = {}
    for i, _, toxic in labels:
        if toxic is not None and i is not None and not out(i):
            votes.setdefault(i, []).append(toxic)
    learned = [(r[1], int(sum(votes[r[0]]) / len(votes[r[0]]) >= 0.5)) for r in rows if r[0] in votes]
    terms = plain_terms(learned)
    assert {t for t, *_ in terms} & {"snark", "grumbl", "grumblor"}
    w = plain_fit(np.array([plain_features(t, terms) for t, _ in learned]), np.array([float(y) for _, y in learned]))
    want = [(str(r[0]), out(r[0]), 1 / (1 + math.exp(-float(np.dot(plain_features(r[1], terms), w))))) for r in rows]
    for a, b in zip(sorted((str(r.doc_id), r.held_out, r.score, r.predicted) for r in got), sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6) and a[3] == (a[2] >= 0.5)


def test_query_held_out(spark):
    from chronaxis.llm.queries import op10_toxicity

    got = {r.doc_id: r for r in op10_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(got[i].predicted == y for i, y in labels.items()) / len(labels) > 0.8


def test_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0), (2, 0, 1)], LABELS)
    got = query(spark, "op10_toxicity", tmp_path, labels=labels)
    assert len(got) == len(awkward())
    assert query(spark, "op10_toxicity", tmp_path, rows=[], labels=labels.limit(0)) == []
