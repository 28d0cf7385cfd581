"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Characters of the lower-cased text give hashed n-grams of one to three; document
frequencies are counted over all training rows and summed across partitions.  The
weights are trained by follow-the-regularised-leader (per-coordinate rates, an L1
and an L2 penalty), on at most ``rows_per_class`` different texts of each language,
those with the smallest hashes; every fifth of them is left out and sets the
temperature of the final probabilities.

Bounds: ``SLOTS`` hashed n-grams and the ``max_classes`` most frequent languages (then
by name; rarer ones are neither learned nor predicted), so model, statistics and what
is sent to the driver have a fixed size, however often a row repeats.

Cases: null, empty or letterless text: ``und`` with score 0; rows with a null
language are not learned from; no training row at all: everything is ``und``; one
language only: it is predicted with score 1; repeated rows each return a row; an
empty table gives no rows; only the text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, slices

BITS = 16
SLOTS = 1 << BITS
MAX_CLASSES = 256
ROWS_PER_CLASS = 800
UNKNOWN = "und"
_PIECE = 1 << 18


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of the text's n-grams; any run of characters that aren't letters is one blank."""
    total: np.ndarray | None = None
    text = text.lower()
    for at in range(0, len(text), _PIECE):
        # Pieces overlap by two, so that all n-grams are seen once.
        codes = np.frombuffer(text[max(0, at - 2) : at + _PIECE].encode("utf-32-le", "replace"), np.uint32)
        new = codes[2 if at else 0 :]
        hashes = [new * np.uint32(2654435761)]
        if len(codes) > 1:
            two = codes[:-1] * np.uint32(40503) + codes[1:]
            hashes.append((two[1 if at else 0 :] + np.uint32(77)) * np.uint32(2246822519))
        if len(codes) > 2:
            hashes.append(((two[:-1] * np.uint32(40503) + codes[2:]) + np.uint32(991)) * np.uint32(3266489917))
        slots = np.concatenate(hashes) >> np.uint32(32 - BITS)
        made = np.bincount(slots, minlength=SLOTS) if len(slots) > 4096 or len(text) > _PIECE else slots
        if len(text) <= _PIECE and len(slots) <= 4096:
            return tuple(np.unique(slots, return_counts=True))
        total = made if total is None else total + made
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.flatnonzero(total)
    return found, total[found]


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many rows hold each slot; the last entry is the number of rows.  Each task sends at most one row a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS + 1, np.int64)
        for batch in slices(batches):
            for text in as_bytes(batch.column(0)):
                slots, _ = ngram_counts(text.decode("utf-8", "replace"))
                seen[slots] += 1
                seen[SLOTS] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["slot", "n"])

    made = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS + 1, np.int64)
    out[made["slot"].to_numpy(np.int64)] = made["n"].to_numpy(np.int64)
    return out


@dataclass
class LanguageModel:
    classes: list[str]
    weights: np.ndarray  # SLOTS by classes, mostly zero
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Slots and the normalised TF-IDF values."""
        slots, n = ngram_counts(text)
        x = (1 + np.log(n)) * self.idf[slots]
        norm = np.sqrt((x * x).sum())
        return slots, x / norm if norm else x

    def logits(self, text: str) -> np.ndarray:
        slots, x = self.vector(text)
        return x.astype(np.float32) @ self.weights[slots] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        if not self.classes or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(text).astype(np.float64) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.classes[best], float(min(1.0, p[best] / p.sum()))


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic-net penalties; the bias has no L1 penalty."""
    z, g2 = np.zeros((SLOTS + 1, n_classes)), np.zeros((SLOTS + 1, n_classes))
    strong = np.full((SLOTS + 1, 1), l1)
    strong[SLOTS] = 0.0

    def solved(at):
        zz = z[at]
        return np.where(np.abs(zz) <= strong[at], 0.0, -(zz - np.sign(zz) * strong[at]) / ((beta + np.sqrt(g2[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slots, x, y = rows[i]
            at, v = np.append(slots, SLOTS), np.append(x, 1.0)
            w = solved(at)
            p = v @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1.0
            g = v[:, None] * p[None, :]
            old = g2[at]
            g2[at] = old + g * g
            z[at] += g - (np.sqrt(g2[at]) - np.sqrt(old)) / alpha * w
    w = solved(np.arange(SLOTS + 1))
    return w[:SLOTS].astype(np.float32), w[SLOTS]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section on its logarithm (0.5 to 20)."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    low, high, ratio = np.log(0.5), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, keep: Column | None = None, rows_per_class: int = ROWS_PER_CLASS, max_classes: int = MAX_CLASSES, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on the rows of ``docs`` where ``keep`` holds and the language isn't null."""
    text, lang = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(lang_col).cast("string")
    part = docs.filter(lang.isNotNull() & (F.lit(True) if keep is None else keep)).select(text.alias("text"), lang.alias("lang"), F.xxhash64(F.lit("language"), text).alias("h"))
    sizes = [(r.lang, r.n) for r in part.groupBy("lang", "h").agg(F.count("*").alias("rows")).groupBy("lang").agg(F.sum("rows").alias("rows"), F.count("*").alias("n")).orderBy(F.desc("rows"), "lang").limit(max_classes).collect()]
    if not sizes:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32), np.zeros(0), np.zeros(SLOTS), 1.0)
    classes = sorted(x for x, _ in sizes)
    part = part.filter(F.col("lang").isin(classes))
    seen = document_frequencies(part, "text")
    idf = np.log((1.0 + seen[SLOTS]) / (1.0 + seen[:SLOTS])) + 1.0
    # A threshold on the hash admits somewhat more than is wanted of each language; copies go; the smallest hashes stay.
    share = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, min(1.0, (1.3 * rows_per_class + 50) / n))])
    few = part.filter((F.col("h") / 2.0**64 + 0.5) <= share[F.col("lang")]).dropDuplicates(["lang", "h"])
    chosen = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rank") <= rows_per_class).select("lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [ngram_counts(t.decode("utf-8", "replace")) for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s.astype(np.uint32).tobytes() for s, _ in made], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in made], pa.binary())], names=["lang", "h", "slots", "n"]
            )

    model = LanguageModel(classes, np.zeros((SLOTS, len(classes)), np.float32), np.zeros(len(classes)), idf, 1.0)
    rows = []
    for r in sorted(chosen.mapInArrow(run, "lang string, h long, slots binary, n binary").collect(), key=lambda r: (r.h, r.lang)):
        slots, n = np.frombuffer(bytes(r.slots), np.uint32).astype(np.int64), np.frombuffer(bytes(r.n), np.uint32)
        if len(slots):
            x = (1 + np.log(n)) * idf[slots]
            rows.append((slots, x / np.sqrt((x * x).sum()), classes.index(r.lang)))
    left_out, fitted = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    model.weights, model.bias = follow_the_leader(fitted or rows, len(classes))
    scores = np.array([x @ model.weights[s] + model.bias for s, x, _ in left_out]).reshape(len(left_out), len(classes))
    model.temperature = calibrate(scores, np.array([y for *_, y in left_out], int))
    return model


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [model.predict(t.decode("utf-8", "replace")) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in made], pa.string()), pa.array([s for _, s in made], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
