"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

A lexicon of words and word stems is induced from labelled texts: terms that occur
in far more toxic than other documents, by the log-likelihood ratio.  The terms
form a trie.  The Levenshtein automata of all terms are intersected with it in one
machine whose states (trie node, edits) are made deterministic as words need
them; edits may fall on any letter, the first too.  For each hit the words
around it tell quotation (quote marks, verbs of saying) from abuse; counts of
exact, misspelled and quoted hits enter a logistic model.

The lexicon and the model are fitted on at most ``max_train`` labelled rows, chosen
by a hash of their ids; everything else reads every row and the whole text.

Cases: null text counts as empty, and an empty text gets the score of a text
without hits; rows without a label, or with a null one, are not learned from;
an id that is labelled twice counts as toxic if half of its labels say so; no
labels at all: every score is 0; repeated rows each return a row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

MAX_TRAIN = 20_000
MAX_TERMS = 300
WINDOW = 4
QUOTES = ('"', "“", "”", "«", "»", "„", "‘", "’")
SAYING = {"said", "says", "say", "called", "quote", "quoted", "wrote", "dit", "cite", "sagte", "zitat", "dijo", "cita"}
_TRIM = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "“”«»„‘’…–—¡¿"
N_FEATURES = 8


def core(word: bytes) -> str:
    """A word without the punctuation around it, in lower case."""
    return word.decode("utf-8", "replace").lower().strip(_TRIM)


def edits(term: str, stem: bool) -> int:
    """Edits that a term of this length forgives."""
    n = len(term)
    return 0 if n < 5 or stem and n < 6 else 1 if n < 9 or stem else 2


@dataclass
class FuzzyTrie:
    """Levenshtein automata of all terms, intersected with their trie.

    ``terms`` are (text, stem, weight); a stem also matches what begins with it.
    """

    terms: list[tuple[str, bool, float]]
    cached: int = 200_000

    def __post_init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]
        for i, (text, stem, _) in enumerate(self.terms):
            node, allowed = 0, edits(text, stem)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.most[0] = max(self.most[0], allowed)
            self.ends[node].append(i)
        self._forget()

    def _forget(self) -> None:
        """Start the deterministic machine anew: its states are numbered as words need them, 0 is the start."""
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stem_ends: list[tuple | None] = []
        self.word_ends: list[tuple | None] = []
        self.n_moves = 0
        self._number(self._closed({(0, 0)}))

    def _number(self, states: frozenset) -> int:
        """The number of a set of states; -1 for the empty set."""
        if not states:
            return -1
        number = self.numbers.get(states)
        if number is None:
            number = self.numbers[states] = len(self.states)
            self.states.append(states)
            self.moves.append({})
            self.stem_ends.append(self._best(states, False))
            self.word_ends.append(self._best(states, True))
        return number

    def _closed(self, states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With what is reached by skipping letters of terms."""
        todo, found = list(states), {}
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or found.get(node, 99) <= e:
                continue
            found[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(found.items())

    def _step(self, states: frozenset, c: str) -> frozenset:
        out = set()
        for node, e in states:
            children = self.children[node]
            if c in children:
                out.add((children[c], e))
            out.add((node, e + 1))
            out.update((child, e + 1) for child in children.values())
        return self._closed(out)

    def _best(self, states: frozenset, whole: bool) -> tuple[int, float, int] | None:
        """(edits, less weight, number) of the best term that ends here; only stems unless the word ends too."""
        found = [(e, -self.terms[i][2], i) for node, e in states for i in self.ends[node] if (whole or self.terms[i][1]) and e <= edits(*self.terms[i][:2])]
        return min(found, default=None)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number) of the best term: fewest edits, then weight."""
        if self.n_moves > self.cached:
            self._forget()
        at, best, moves, stem_ends = 0, None, self.moves, self.stem_ends
        for c in word:
            after = moves[at].get(c)
            if after is None:
                after = moves[at][c] = self._number(self._step(self.states[at], c))
                self.n_moves += 1
            if after < 0:
                break
            at = after
            end = stem_ends[at]
            if end is not None and (best is None or end < best):
                best = end
        else:
            end = self.word_ends[at]
            if end is not None and (best is None or end < best):
                best = end
        return (best[0], best[2]) if best else None


class Matcher:
    """Features of a text; word results are kept in a bounded cache."""

    def __init__(self, terms: list[tuple[str, bool, float]], cached: int = 100_000):
        self.trie, self.terms, self.cached = FuzzyTrie(terms), terms, cached
        self.known: dict[bytes, int] = {}

    def _look(self, word: bytes) -> int:
        """0, or 1 + 8 * term + edits."""
        found = self.trie.match(core(word)[:64])
        value = 1 + 8 * found[1] + found[0] if found else 0
        if len(word) <= 64:
            if len(self.known) >= self.cached:
                self.known.clear()
            self.known[word] = value
        return value

    def features(self, text: bytes) -> list[float]:
        words = text.lower().split()
        get, look = self.known.get, self._look
        values = [v if (v := get(w)) is not None else look(w) for w in words]
        hits = [i for i, v in enumerate(values) if v] if any(values) else []
        exact = fuzzy = quoted = 0
        best, best_fuzzy, seen = 0.0, 0.0, set()
        for i in hits:
            term, e = divmod(values[i] - 1, 8)
            around = [w.decode("utf-8", "replace") for w in words[max(0, i - WINDOW) : i + WINDOW + 1]]
            if any(q in w for w in around for q in QUOTES[:6]) or any(w.strip(_TRIM) in SAYING for w in around):
                quoted += 1
                continue
            # A misspelled hit counts as a hit; the two features of misspelled hits alone let
            # the model take that back where they are chance, and stay at zero if none was seen.
            weight = self.terms[term][2]
            seen.add(term)
            best = max(best, weight * (1.0 - 0.15 * e))
            if e:
                fuzzy += 1
                best_fuzzy = max(best_fuzzy, weight)
            else:
                exact += 1
        return [math.log1p(exact + fuzzy), math.log1p(fuzzy), math.log1p(quoted), math.log1p(len(seen)), best, best_fuzzy, math.log1p(1000.0 * (exact + fuzzy) / max(len(words), 1)), 1.0]


def chosen_rows(docs: DataFrame, labels: DataFrame, keep: Column, max_train: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``text, toxic`` of at most ``max_train`` labelled rows; the ids are few enough to broadcast."""
    ids = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & keep)
        .groupBy(F.col(id_col).alias("__id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    )
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "__id").select("text", "toxic")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, toxic, documents) summed within a task; flushed when the table is large."""
    schema = pa.schema([("term", pa.string()), ("stem", pa.bool_()), ("toxic", pa.int32()), ("docs", pa.int64())])
    counts: Counter = Counter()

    def flush():
        rows = [(*k, v) for k, v in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    for batch in slices(batches):
        for text, toxic in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            cores = {core(w) for w in set(text.lower().split())}
            counts[("", False, toxic)] += 1
            counts.update((w, False, toxic) for w in cores if 3 <= len(w) <= 32 and w[0].isalpha())
            counts.update((w, True, toxic) for w in {c[:k] for c in cores for k in (4, 5, 6) if len(c) >= k and c[0].isalpha()})
            if len(counts) > 120_000:
                yield flush()
    yield flush()


def induce(rows: DataFrame, max_terms: int = MAX_TERMS) -> list[tuple[str, bool, float]]:
    """The lexicon: (text, stem, weight).

    A word under a stem that forgives fewer edits stays beside it, over and above ``max_terms``.
    """
    counts = (
        rows.mapInArrow(_term_counts, "term string, stem boolean, toxic int, docs long")
        .groupBy("term", "stem").agg(F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("n"))
    ).persist()
    try:
        total = counts.filter("term = ''").first()
        if total is None or not total.p or not total.n:
            return []
        lift = (F.col("p") + 0.5) / F.lit(total.p + 1.0) / ((F.col("n") + 0.5) / F.lit(total.n + 1.0))
        a, b = F.col("p").cast("double"), F.col("n").cast("double")
        rate = F.lit(total.p / (total.p + total.n))
        # G squared against the base rate
        g2 = 2 * (F.when(a > 0, a * F.ln(a / ((a + b) * rate))).otherwise(0.0) + F.when(b > 0, b * F.ln(b / ((a + b) * (1 - rate)))).otherwise(0.0))
        top = (
            counts.filter((F.col("term") != "") & (F.col("p") >= 4)).select("term", "stem", "p", "n", lift.alias("lift"), g2.alias("g2")).filter("lift >= 6 and g2 >= 15")
            .orderBy(F.desc("g2"), "stem", F.desc(F.length("term")), "term").limit(8 * max_terms).collect()
        )
    finally:
        counts.unpersist()
    out: list[tuple[str, bool, float, float]] = []
    beside: list[tuple[str, bool, float]] = []
    for r in sorted(top, key=lambda r: (-round(r.g2, 6), r.stem, -len(r.term), r.term)):
        precision = r.p / (r.p + r.n)
        covered = [x for x in out if (x[1] and r.term.startswith(x[0])) or (r.stem and x[0].startswith(r.term))]
        term = (r.term, r.stem, math.log((r.p + 0.5) / (r.n + 0.5)))
        if any(precision < x[3] + 0.15 for x in covered):
            if not r.stem and all(edits(x[0], x[1]) < edits(r.term, False) for x in covered):
                beside.append(term)
        elif len(out) < max_terms:
            out.append((*term, precision))
    return [x[:3] for x in out] + beside


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    terms: list[tuple[str, bool, float]]
    weights: list[float] | None

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, keep: Column | None = None, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
        rows = chosen_rows(docs, labels, F.lit(True) if keep is None else keep, max_train, id_col, text_col, label_col)
        terms = induce(rows)

        def run(batches):
            matcher = Matcher(terms)
            for batch in slices(batches):
                made = np.array([matcher.features(t) for t in as_bytes(batch.column(0))], np.float64).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, made.T.copy())], names=["toxic", *[f"f{i}" for i in range(N_FEATURES)]])

        names = [f"f{i}" for i in range(N_FEATURES)]
        made = rows.mapInArrow(run, "toxic int, " + ", ".join(f"{x} double" for x in names)).groupBy("toxic", *names).agg(F.count("*").alias("n")).toPandas()
        if made["toxic"].nunique() < 2:
            return cls(terms, None)
        made = made.sort_values(["toxic", *names])
        times = made["n"].to_numpy()
        x = np.repeat(made[names].to_numpy(np.float64), times, axis=0)
        return cls(terms, _fit(x, np.repeat(made["toxic"].to_numpy(np.float64), times)).tolist())

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, score, n_hits`` for each row."""
        terms, weights = self.terms, self.weights
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_hits", pa.int64())])

        def run(batches):
            matcher = Matcher(terms)
            for batch in slices(batches):
                x = np.array([matcher.features(t) for t in as_bytes(batch.column(1))], np.float64).reshape(-1, N_FEATURES)
                score = np.zeros(len(x)) if weights is None else 1 / (1 + np.exp(-np.clip(x @ np.array(weights), -30, 30)))
                hits = np.rint(np.expm1(x[:, 0])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(hits)], schema=schema)

        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_hits long")

    def keep_clean(self, docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
        """The rows that score below the threshold or have no hit at all, not even a quoted one, whole, with their own columns."""
        terms, weights, names = self.terms, self.weights, docs.columns
        at = names.index(text_col)

        def run(batches):
            matcher = Matcher(terms)
            for batch in slices(batches):
                x = np.array([matcher.features(t) for t in as_bytes(batch.column(at))], np.float64).reshape(-1, N_FEATURES)
                yield batch.filter(pa.array((x @ np.array(weights) < math.log(threshold / (1 - threshold))) | ((x[:, 0] == 0) & (x[:, 2] == 0))))

        return docs if weights is None else docs.mapInArrow(run, docs.schema)
