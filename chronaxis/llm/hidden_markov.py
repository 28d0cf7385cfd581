"""A hidden Markov language model over words.

States emit words through word classes: P(word | state) = P(class | state) *
P(word | class).  A word's class is a hash of its ending, so the state-dependent
part has a fixed size (``STATES`` by ``CLASSES``) and can be sent everywhere, while
the word counts, which grow with the corpus, stay in a table that is joined.

Training: one pass counts the words of all training texts, another encodes each
text once as 16-bit word classes, written to the shared folder; neighbouring classes
give a first guess of the states on the driver; then every Baum-Welch iteration reads
the encoded texts, runs forward-backward over every one of them, sums expected counts
inside each task, and adds the tasks' sums across partitions.  It stops after
``ITERATIONS``, or where an iteration gained less than ``TOLERANCE`` a token.

Scoring: the scaled forward recursion gives the exact likelihood of a text's class
sequence, the end included; the words' counts complete it.  The most frequent
words (``HEAD`` at most, of bounded length) are broadcast; all other tokens
meet the count table by a shuffle, summed per text and word beforehand, so that no
hot word is ever shuffled.

Unknown words take the share that additive smoothing leaves to one unseen word in
each class, so the model is a distribution over texts with one unknown word a class.

Cases: null text counts as empty and scores its end alone; no training row: every
token is unknown and states are uniform; repeated rows each return a row; an empty
table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, as_bytes, checkpointed, slices

STATES = 8
CLASSES = 2048
COARSE = 8  # neighbouring classes are counted in groups of this many
HEAD = 100_000
HEAD_BYTES = 48
ITERATIONS = 4  # at most
TOLERANCE = 0.01  # least gain a token, in nats, that is worth another iteration
END = b""
_TOKENS = 1_000_000


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[list(SPACE_BYTES)] = True


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(edges, bytes) of a string or binary column, A-Z lower-cased in strings: value i lies between edges i and i + 1; null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    text = pa.types.is_large_string(column.type) or pa.types.is_string(column.type)
    if column.null_count:
        column = column.fill_null("" if text else b"")
    _, edges, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    edges = np.frombuffer(edges, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
    return edges - edges[0], _LOWER[data] if text else data


def class_stream(edges: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Classes of all words of lower-cased texts, in order, with 0 for the end after each text.

    A word's class is a hash of its last four bytes.
    """
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    last, first = ~blank, ~blank
    last[:-1] &= blank[1:] | edge[1:-1]
    first[1:] &= blank[:-1] | edge[1:-1]
    ends, starts = np.flatnonzero(last), np.flatnonzero(first)
    size = ends - starts
    key = np.zeros(len(ends), np.uint32)
    for i in range(4):
        held = size >= i
        key[held] |= data[ends[held] - i].astype(np.uint32) << np.uint32(8 * i)
    key *= np.uint32(2654435761)
    key ^= key >> np.uint32(15)
    key *= np.uint32(2246822519)
    key ^= key >> np.uint32(13)
    out = np.zeros(len(key) + len(edges) - 1, np.uint16)
    out[np.arange(len(key)) + np.searchsorted(edges[1:], starts, "right")] = key % np.uint32(CLASSES - 1) + np.uint32(1)
    return out


def word_classes(words: pa.Array) -> np.ndarray:
    """The class of each of some lower-cased words; the empty word is the end."""
    edges, data = flat_bytes(words)
    out = np.zeros(len(words), np.int32)
    stream = class_stream(edges, data)
    out[np.diff(edges) > 0] = stream[stream > 0]
    return out


def split_words(edges: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words as binary, number of the text of each): the words of all texts, then one end (empty) for each text."""
    texts = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    lists = pc.ascii_split_whitespace(texts)  # splits at the six characters of SPACE_BYTES, and at no others
    words = lists.flatten().cast(pa.large_binary())
    rows = pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)  # white space at the start or end of a text leaves empty pieces
    n = len(edges) - 1
    return pa.concat_arrays([words.filter(full), pa.array([END] * n, pa.large_binary())]), np.concatenate([rows.filter(full).to_numpy(), np.arange(n)])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text: its class stream as 16-bit integers."""
    for batch in slices(batches, 4 << 20):
        edges, data = flat_bytes(batch.column(1))
        stream = class_stream(edges, data)
        at = np.concatenate(([0], np.flatnonzero(stream == 0) + 1)) * 2
        yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(stream)])], names=["classes"])


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Encoded texts, end to end, in lots of about ``_TOKENS``, or one text."""
    lot, size = [], 0
    for batch in slices(batches, 2 * _TOKENS):
        stream = flat_bytes(batch.column(0))[1].view(np.uint16)
        if lot and size + len(stream) > _TOKENS:
            yield np.concatenate(lot)
            lot, size = [], 0
        lot.append(stream)
        size += len(stream)
    if lot:
        yield np.concatenate(lot)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, n): counts of neighbouring classes, in groups of ``COARSE``, summed within a task."""
    size = CLASSES // COARSE
    pairs = np.zeros(size * size, np.int64)
    for stream in _lots(batches):
        inside = stream[:-1] != 0
        pairs += np.bincount(stream[:-1][inside].astype(np.int64) // COARSE * size + stream[1:][inside] // COARSE, minlength=size * size)
    at = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pairs[at])], names=["i", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words: (word, class, n), merged within a task while they are few."""
    parts: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for piece in table.combine_chunks().to_batches(max_chunksize=100_000):
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.binary()), pa.array(word_classes(piece.column(0))), piece.column(1)], names=["word", "g", "n"])

    for batch in slices(batches, 4 << 20):
        words, _ = split_words(*flat_bytes(batch.column(1)))
        found = pc.value_counts(words)
        parts.append(pa.table({"word": found.field(0), "n": found.field(1)}))
        if sum(p.num_rows for p in parts) > 1_000_000:
            parts = [merged()]
            if parts[0].num_rows > 600_000:
                yield from rows(parts[0])
                parts = []
    if parts:
        yield from rows(merged())


@dataclass
class States:
    """Start, transition and class probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def guess(cls, pairs: np.ndarray, class_counts: np.ndarray, states: int = STATES, rounds: int = 60, seed: int = 11) -> States:
        """Expectation-maximisation on neighbouring coarse classes; fine classes share in proportion to their counts."""
        rng = np.random.default_rng(seed)
        size = len(pairs)
        total = pairs.sum()
        share = (pairs.sum(1) + pairs.sum(0) + 1e-3) / (2 * total + 1e-3 * size)
        emit = share[None] * np.exp(rng.normal(0, 0.5, (states, size)))
        emit /= emit.sum(1, keepdims=True)
        move = rng.dirichlet(np.full(states, 2.0), states) * 0.3 + 0.7 * np.eye(states)
        start = np.full(states, 1.0 / states)
        p = pairs / max(total, 1)
        for _ in range(rounds if total else 0):
            joint = start[:, None] * move
            ratio = p / np.maximum(emit.T @ joint @ emit, 1e-300)
            left = emit * (joint @ (emit @ ratio.T))  # expected first classes by state
            right = emit * (joint.T @ (emit @ ratio))
            both = joint * (emit @ ratio @ emit.T)
            start = both.sum(1) + 1e-9
            start /= start.sum()
            move = both + 1e-9
            move /= move.sum(1, keepdims=True)
            emit = left + right + 1e-7 * share
            emit /= emit.sum(1, keepdims=True)
        coarse = np.arange(CLASSES) // COARSE
        fine = (class_counts + 0.5) / np.bincount(coarse, class_counts + 0.5)[coarse]
        out = emit[:, coarse] * fine[None]
        return cls(start, move, out / out.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, class_counts: np.ndarray) -> States:
        """The M-step, smoothed by a little of the overall class shares."""
        share = (class_counts + 0.5) / (class_counts + 0.5).sum()
        s, m, e = start + 0.01, move + 0.01, emit + 5.0 * share[None]
        return cls(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True))


def _by_step(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Order (longest first), all classes by step and then by sequence, and where each step starts.

    The classes of a step stand together, so every step of a recursion works on slices.
    """
    starts = np.concatenate(([0], np.flatnonzero(stream == 0) + 1))
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], starts[:-1][order]
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), "right")
    edges = np.concatenate(([0], np.cumsum(active)))
    step = np.arange(edges[-1]) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = np.empty(edges[-1], np.int64)
    values[edges[step] + np.repeat(np.arange(len(sizes)), sizes)] = stream[np.repeat(starts, sizes) + step]
    return order, values, edges.tolist()


def forward(stream: np.ndarray, states: States) -> np.ndarray:
    """Natural log-likelihood of each sequence of the stream, by the scaled forward recursion."""
    order, values, edges = _by_step(stream)
    emit, move = np.ascontiguousarray(states.emit.T), states.move
    out, logs = np.zeros(len(order)), np.zeros(len(order))
    alpha = np.broadcast_to(states.start, (len(order), len(states.start)))
    for t, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
        n = end - start
        b = emit[values[start:end]]
        b *= alpha[:n] @ move if t else alpha
        scale = b.sum(1)
        b /= scale[:, None]
        logs[:n] += np.log(scale)
        alpha = b
    out[order] = logs
    return out


def expected_counts(stream: np.ndarray, states: States) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts, moves and emissions, and the log-likelihood."""
    order, values, edges = _by_step(stream)
    k = len(states.start)
    emit, move = np.ascontiguousarray(states.emit.T), states.move
    alphas, scales = np.empty((len(values), k)), np.empty(len(values))
    alpha = np.broadcast_to(states.start, (len(order), k))
    for t, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
        b = emit[values[start:end]]
        b *= alpha[: end - start] @ move if t else alpha
        scale = b.sum(1)
        alpha = np.divide(b, scale[:, None], out=alphas[start:end])
        scales[start:end] = scale
    moves = np.zeros((k, k))
    beta = np.ones((len(order), k))
    back_move = np.ascontiguousarray(move.T)
    for t in range(len(edges) - 2, -1, -1):
        start, end = edges[t], edges[t + 1]
        if t + 2 < len(edges):
            after = edges[t + 2]
            m = after - end  # these go on after this step
            back = emit[values[end:after]]
            back *= beta[:m]
            back /= scales[end:after, None]
            moves += alphas[start : start + m].T @ back
            np.matmul(back, back_move, out=beta[:m])
        # What was read above is now turned into the posterior of the states.
        alphas[start:end] *= beta[: end - start]
    starts = alphas[: edges[1]].sum(0)
    emits = np.stack([np.bincount(values, alphas[:, s], CLASSES) for s in range(k)])
    return starts, moves * move, emits, float(np.log(scales).sum())


def baum_welch(encoded: DataFrame, states: States, class_counts: np.ndarray) -> tuple[States, float]:
    """One iteration over all ``encoded`` texts (``classes``); returns also the log-likelihood before it."""
    k = len(states.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + k * CLASSES + 1)
        for lot in _lots(batches):
            s, m, e, like = expected_counts(lot, states)
            total += np.concatenate([s, m.ravel(), e.ravel(), [like]])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "v"])

    made = encoded.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(k + k * k + k * CLASSES + 1)
    total[made["i"].to_numpy(np.int64)] = made["v"].to_numpy()
    return States.from_counts(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k : -1].reshape(k, CLASSES), class_counts), float(total[-1])


@dataclass
class HiddenMarkovModel:
    states: States
    counts: DataFrame  # word, g, n
    n_tokens: int
    n_distinct: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray
    likelihoods: list[float]

    @classmethod
    def train(cls, docs: DataFrame, iterations: int = ITERATIONS, states: int = STATES, id_col: str = "doc_id", text_col: str = "text") -> HiddenMarkovModel:
        texts = _texts(docs, id_col, text_col)
        encoded = checkpointed(texts.mapInArrow(_encode, "classes binary"))
        counts = checkpointed(texts.mapInArrow(_count, "word binary, g int, n long").groupBy("word", "g").agg(F.sum("n").alias("n")))
        by_class = counts.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
        class_tokens, class_distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        class_tokens[by_class["g"].to_numpy(int)], class_distinct[by_class["g"].to_numpy(int)] = by_class["n"].to_numpy(int), by_class["v"].to_numpy(int)
        near = encoded.mapInArrow(_neighbours, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()  # at most (CLASSES / COARSE) squared rows
        pairs = np.zeros((CLASSES // COARSE) ** 2)
        pairs[near["i"].to_numpy(int)] = near["n"].to_numpy(float)
        pairs = pairs.reshape(CLASSES // COARSE, -1)
        model, likelihoods = States.guess(pairs, class_tokens.astype(float), states), []
        for _ in range(iterations if class_tokens.sum() else 0):
            model, like = baum_welch(encoded, model, class_tokens.astype(float))
            likelihoods.append(like)
            if len(likelihoods) > 1 and like - likelihoods[-2] < TOLERANCE * class_tokens.sum():
                break
        return cls(model, counts, int(class_tokens.sum()), int(class_distinct.sum()), class_tokens, class_distinct, likelihoods)

    def frequent(self) -> DataFrame:
        """At most ``HEAD`` of the most frequent words, each of at most ``HEAD_BYTES``: under 10 MB whatever the corpus.

        A histogram of the counts (exact to 4096, then logarithmic, so of bounded size) gives
        the least count that admits no more than ``HEAD`` words.
        """
        short = self.counts.filter(F.length("word") <= HEAD_BYTES)
        step = F.when(F.col("n") <= 4096, F.col("n")).otherwise(4096 + F.floor(16 * F.log2(F.col("n") / 4096)).cast("long"))
        admitted, least = 0, None
        for r in sorted(short.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), reverse=True):
            admitted += r.words
            if admitted > HEAD:
                break
            least = r.least
        return short.filter(F.col("n") >= (2**62 if least is None else least)).select("word", "n")

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for each row."""
        states, n, v = self.states, self.n_tokens, self.n_distinct
        log_rest = np.log10(self.class_tokens + 0.5 * (self.class_distinct + 1))
        spark = docs.sparkSession
        top = self.frequent().toPandas()
        head = spark.sparkContext.broadcast((pa.array(list(map(bytes, top["word"])), pa.large_binary()), np.append(np.log10(top["n"].to_numpy(float) + 0.5), 0.0)))
        schema = pa.schema([("word", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("times", pa.int64()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("head_log", pa.float64()), ("model_log", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each text and each of its words that isn't in the head, and one for the text itself.

            The text's own row has a key that no UTF-8 word equals, so it joins nothing and is spread evenly.
            """
            import xxhash

            known, logs = head.value
            for batch in slices(batches, 4 << 20):
                n_texts = batch.num_rows
                if not n_texts:
                    continue
                edges, data = flat_bytes(batch.column(1))
                stream = class_stream(edges, data)
                words, rows = split_words(edges, data)
                at = pc.index_in(words, value_set=known)
                found = at.is_valid().to_numpy(zero_copy_only=False)
                head_log = np.bincount(rows, logs[at.fill_null(len(known)).to_numpy()], n_texts)
                n_head = np.bincount(rows, found, n_texts).astype(np.int64)
                sizes = np.diff(np.flatnonzero(stream == 0), prepend=-1)
                rest = np.add.reduceat(log_rest[stream], np.cumsum(sizes) - sizes)
                model_log = forward(stream, states) / np.log(10.0) - rest
                texts = as_bytes(batch.column(1))
                hashes = np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64).view(np.int64)
                keys = [b"\xff" + x[:8] + h for x, h in zip(texts, map(bytes, hashes.view("V8")), strict=True)]
                ids, hashes = batch.column(0), pa.array(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), ids, hashes, pa.nulls(n_texts, pa.int64()), pa.array(sizes), pa.array(n_head), pa.array(head_log), pa.array(model_log)], schema=schema)
                tail = pa.table({"row": rows[~found], "word": words.filter(pa.array(~found))}).group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                for piece in tail.to_batches(max_chunksize=100_000):
                    row = piece.column(0)
                    yield pa.RecordBatch.from_arrays([piece.column(1).cast(pa.binary()), ids.take(row), hashes.take(row), piece.column(2), *[pa.nulls(len(row), t.type) for t in list(schema)[4:]]], schema=schema)

        pieces = _texts(docs, id_col, text_col).mapInArrow(run, "word binary, doc_id long, text_hash long, times long, n_tokens long, n_head long, head_log double, model_log double")
        joined = pieces.join(self.counts.select("word", "n"), "word", "left")
        times = F.coalesce("times", F.lit(0))
        summed = joined.groupBy("doc_id", "text_hash").agg(
            F.count("n_tokens").alias("rows"), F.first("n_tokens", True).alias("n_tokens"), F.first("n_head", True).alias("n_head"), F.first("head_log", True).alias("head_log"), F.first("model_log", True).alias("model_log"),
            F.sum(F.when(F.col("n").isNotNull(), times).otherwise(0)).alias("n_tail"), F.sum(times * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_log"),
        )
        # Repeated rows (same id and text) are summed together: divide, and give each its row again.
        log_counts = F.col("head_log") + F.col("tail_log") / F.col("rows")
        return summed.select(
            "doc_id", "n_tokens", (F.col("n_head") + (F.col("n_tail") / F.col("rows")).cast("long")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
            (log_counts - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"), (log_counts + F.col("model_log")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("__copy"),
        ).drop("__copy")
