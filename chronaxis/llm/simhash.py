"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes.  Two fingerprints that differ in
at most four bits share at least four of them, so among any seven positions they
share at least three.  The index therefore holds, for each distinct fingerprint,
one posting for every choice of three of the first seven positions; for two
postings of one list the shared positional bytes are tallied, pairs below the
guaranteed four are dropped, and the rest is verified bit by bit.

Copies are folded first, so a list holds distinct fingerprints only, and a list
yields the spanning forest of its links, never all its pairs.  A list of over
``list_limit`` fingerprints isn't compared pair by pair: its members are dealt out
to the centres within two bits of them (two fingerprints at four bits or fewer
have such a centre in common, and all that share one are linked), which is exact
and grows with the list, not with its square.

Components are found by alternating large-star and small-star steps on DataFrames.

Cases: null text counts as empty; a text without words has fingerprint zero and is
linked like any other; null ids come first when the smallest id is taken; repeated
rows each return a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, checkpointed, fetch, join_to_groups, row_hash, slices

MAX_BITS = 4
#: Three of the first seven positional bytes: 35 postings a fingerprint.
POSTINGS = tuple(combinations(range(7), 3))
_SEVEN = np.uint64(0x7F7F7F7F7F7F7F7F)
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("tie", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("list", pa.int64())])


def fingerprint(text: bytes, words: int = 4) -> int:
    """The fingerprint as a signed 64-bit integer."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    k = min(words, len(tokens))
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(tokens) - k + 1].tolist(), (starts[k:] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", tie: Column | None = None) -> DataFrame:
    """``doc_id, fp, tie`` for each row; the last is a hash of the whole text unless another is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x, words) for x in as_bytes(batch.column(1))], pa.int64()), batch.column(2)], schema=_FP)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), (F.xxhash64(F.coalesce(text, F.lit(""))) if tie is None else tie).alias("tie")).mapInArrow(run, "doc_id long, fp long, tie long")


def _postings(fps: DataFrame) -> DataFrame:
    """``list, fp``: the list's key holds the choice of positions and the three bytes."""
    byte = lambda p: F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255).cast("long"))
    keys = [F.lit(i << 24).cast("long") + byte(p) * 65536 + byte(q) * 256 + byte(r) for i, (p, q, r) in enumerate(POSTINGS)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("list"))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(lists: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest links among sorted postings, each list compared within itself."""
    found_a, found_b, kept, lag = [], [], 0, 1
    whole = fps.view(np.uint64)
    live = np.arange(len(lists))
    while len(live):
        live = live[live + lag < len(lists)]
        live = live[lists[live] == lists[live + lag]]
        other = live + lag
        differ = whole[live] ^ whole[other]
        # The top bit of each byte that isn't zero: eight less these are the shared positional bytes.
        tally = 8 - np.bitwise_count((((differ & _SEVEN) + _SEVEN) | differ) & ~_SEVEN).astype(np.int8)
        ok = tally >= 8 - MAX_BITS
        ok[ok] = np.bitwise_count(differ[ok]) <= MAX_BITS
        if ok.any():
            found_a.append(live[ok])
            found_b.append(other[ok])
            kept += int(ok.sum())
        if kept > 1_000_000:
            root = _roots(np.concatenate(found_a), np.concatenate(found_b), len(lists))
            linked = np.flatnonzero(root != np.arange(len(lists)))
            found_a, found_b, kept = [linked], [root[linked]], len(linked)
        lag += 1
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = _roots(np.concatenate(found_a), np.concatenate(found_b), len(lists))
    linked = np.flatnonzero(root != np.arange(len(lists)))
    return fps[linked], fps[root[linked]]


def _link_lists(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted postings; members of a list beyond the limit pass as (fp, null, list)."""

    def out(a, b=None, key=None):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if key is None else pa.array(key, pa.int64())], schema=_LINK)

    lists, fps, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        lists = np.concatenate([lists, batch.column(1).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column(0).to_numpy(zero_copy_only=False)])
        if over is not None:  # the rest of a list that was too long
            n = int(np.searchsorted(lists, over, "right"))
            yield out(fps[:n], None, lists[:n])
            lists, fps = lists[n:], fps[n:]
            if not len(lists):
                continue
            over = None
        last = int(np.searchsorted(lists, lists[-1]))
        if len(lists) - last > limit:
            yield out(fps[last:], None, lists[last:])
            over = lists[-1]
            rest = len(lists)
        else:
            rest = last
        starts = np.flatnonzero(np.diff(lists[:last], prepend=lists[0] - 1)) if last else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, last))
        for start, n in zip(starts[sizes > limit].tolist(), sizes[sizes > limit].tolist(), strict=True):
            yield out(fps[start : start + n], None, lists[start : start + n])
        small = np.repeat((sizes > 1) & (sizes <= limit), sizes)
        a, b = _compare(lists[:last][small], fps[:last][small])
        yield out(a, b)
        lists, fps = lists[rest:], fps[rest:]
    if len(lists):
        yield out(*_compare(lists, fps))


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, centre, fp) for all centres within two bits that keep the list's three bytes."""
    schema = pa.schema([("list", pa.int64()), ("centre", pa.int64()), ("fp", pa.int64())])
    masks = {}
    for i, held in enumerate(POSTINGS):
        free = [np.uint64(1 << (8 * p + k)) for p in range(8) if p not in held for k in range(8)]
        masks[i] = np.array([np.uint64(0), *free, *(x | y for x, y in combinations(free, 2))], np.uint64)
    for batch in batches:
        fps, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        for choice in np.unique(keys >> 24).tolist():
            own, mask = np.flatnonzero(keys >> 24 == choice), masks[choice]
            for at in range(0, len(own), 256):
                some = own[at : at + 256]
                centres = (fps[some].view(np.uint64)[:, None] ^ mask[None, :]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[some], len(mask))), pa.array(centres.ravel()), pa.array(np.repeat(fps[some], len(mask)))], schema=schema)


def links(fps: DataFrame, list_limit: int = 20_000) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect all that are within ``MAX_BITS``."""
    made = checkpointed(_postings(fps).repartition("list").sortWithinPartitions("list", "fp").select("fp", "list").mapInArrow(lambda b: _link_lists(b, list_limit), "a long, b long, list long"))
    found = made.filter("b is not null").select("a", "b")
    long_lists = made.filter("b is null").select(F.col("a").alias("fp"), "list")
    if long_lists.take(1):
        dealt = long_lists.mapInArrow(_centres, "list long, centre long, fp long")
        roots = dealt.groupBy("list", "centre").agg(F.min("fp").alias("root"))
        found = found.unionByName(dealt.join(roots, ["list", "centre"]).filter("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable from each node that has an edge (columns ``a, b``).

    A node with very many links (the centre of a star, as all become) doesn't meet
    them in one task: see :func:`join_to_groups`.  Every round shrinks the links or
    moves them to smaller nodes, so the rounds end, after about the logarithm of the nodes.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before, now = None, mark(edges)
    while now[0] and now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = checkpointed(join_to_groups(both.filter("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_to_groups(large, least, "u", "n").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = checkpointed(small)
        before, now = now, mark(edges)
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", tie: Column | None = None) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id, tie, kept``.

    ``component_id`` is the smallest id of the component; ``kept`` marks its row
    (of several with that id: the one with the smallest tie, see :func:`fingerprints`).
    """
    rows = checkpointed(fingerprints(docs, words, id_col, text_col, tie))
    groups = checkpointed(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "tie")).alias("least"), F.count("*").alias("copies")))
    roots = components(links(groups.select("fp")))
    placed = checkpointed(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "copies", "least", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("members"))
    placed = checkpointed(join_to_groups(placed, least, "root", "members").select("fp", "copies", "first"))
    joined = join_to_groups(rows, placed, "fp", "copies")
    return joined.select("doc_id", "fp", F.col("first.doc_id").alias("component_id"), "tie", F.struct("doc_id", "tie").eqNullSafe(F.col("first")).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id (then the smallest hash of all columns), with all its columns."""
    least = F.lit(-(2**63))
    found = near_duplicates(docs, words, id_col, text_col, row_hash(docs)).filter("kept")
    winners = checkpointed(found.groupBy(F.coalesce("doc_id", least).alias("id"), F.col("tie").alias("hash")).agg(F.count("*").alias("times")))
    return fetch(docs, {"id": F.coalesce(F.col(id_col).cast("long"), least), "hash": row_hash(docs)}, winners)
