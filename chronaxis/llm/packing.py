"""Hierarchical multi-length packing of token sequences.

A document's ids are routed to context-size tiers: whole longest windows first,
the rest to the shortest tier that holds it.  Each tier is packed by best fit;
what a longer window leaves free is filled from shorter tiers, cutting a piece
where that closes the gap.  The last open windows of a partition are cut to powers
of two, which need no padding.  Full windows are dealt into step groups of equal
token counts, tier by tier.

Each partition is packed on its own, in bounded buffers, so there is no shuffle
and no state that grows with the input; a lost task repeats only its partition.

Cases: null text counts as empty and yields the end id alone; repeated rows are
packed as often as they come; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int32()), ("step_group", pa.int64())]
)
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Ids of a byte-level BPE vocabulary, as little-endian 32-bit integers; texts with a special token take the tokenizer's own path."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [x["content"] for x in made.get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(letters[c] for c in word): i for word, i in made["model"]["vocab"].items() if word not in self.special}
        self.fast = tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.asarray(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=1)
def _codec(path: str) -> Codec:
    """One codec a worker process, kept from task to task."""
    return Codec(path)


class Packer:
    """Packs pieces of one partition; ``emit`` gets (piece, sequence, offset, window)."""

    def __init__(self, tiers: tuple[int, ...], emit: Any, group_tokens: int, first_id: int, open_bins: int = 256):
        self.tiers, self.emit, self.group_tokens, self.next_id, self.open_bins = tiers, emit, group_tokens, first_id, open_bins
        self.base = first_id
        self.open: dict[int, list[tuple[int, int, list]]] = {w: [] for w in tiers}  # by free space: (free, number, pieces)
        self.made = dict.fromkeys(tiers, 0)
        self.serial = 0

    def add(self, doc: Any, start: int, n: int) -> None:
        """A piece of at most the longest window."""
        self._fit(doc, start, n, next(w for w in self.tiers if w >= n))

    def _fit(self, doc: Any, start: int, n: int, tier: int) -> None:
        """Best fit among the tier's open windows; else a new one.  The fullest goes when too many are open."""
        if n == tier:
            self._close([(doc, start, n)], tier)
            return
        bins = self.open[tier]
        at = bisect_left(bins, (n, -1))
        if at < len(bins):
            free, serial, pieces = bins.pop(at)
            pieces.append((doc, start, n))
            free -= n
        else:
            self.serial += 1
            free, serial, pieces = tier - n, self.serial, [(doc, start, n)]
        if not free:
            self._close(pieces, tier)
            return
        insort(bins, (free, serial, pieces))
        if len(bins) > self.open_bins:
            self._fill(tier, *bins.pop(0)[::2])

    def _fill(self, tier: int, free: int, pieces: list) -> None:
        """Close a window: take pieces of shorter tiers' open windows, cutting the last to fit."""
        for short in [w for w in reversed(self.tiers) if w <= tier]:
            bins = self.open[short]
            while free and bins:
                room, serial, own = bins.pop()
                while free and own:
                    doc, start, n = own.pop()
                    take = min(n, free)
                    pieces.append((doc, start, take))
                    free, room = free - take, room + n
                    if take < n:
                        own.append((doc, start + take, n - take))
                        room -= n - take
                if own:
                    insort(bins, (room, serial, own))
        self._close(pieces, tier, free)

    def _close(self, pieces: list, window: int, free: int = 0) -> None:
        if free:  # nothing is left to fill with: cut into powers of two
            left = window - free
            queue = list(pieces)
            while left:
                size, part, room = 1 << (left.bit_length() - 1), [], 1 << (left.bit_length() - 1)
                while room:
                    doc, start, n = queue.pop(0)
                    take = min(n, room)
                    part.append((doc, start, take))
                    room -= take
                    if take < n:
                        queue.insert(0, (doc, start + take, n - take))
                self._write(part, size)
                left -= size
            return
        self._write(pieces, window)

    def _write(self, pieces: list, window: int) -> None:
        tier = next(w for w in self.tiers if w >= window)
        group = self.base + (self.made[tier] * tier // self.group_tokens) * len(self.tiers) + self.tiers.index(tier)
        self.made[tier] += 1
        offset = 0
        for doc, start, n in pieces:
            self.emit(doc, start, n, self.next_id, offset, window, group)
            offset += n
        self.next_id += 1

    def finish(self) -> None:
        for tier in reversed(self.tiers):
            while self.open[tier]:
                self._fill(tier, *self.open[tier].pop(0)[::2])


def _packed(batches: Iterator[pa.RecordBatch], path: str, end_id: int, tiers: tuple[int, ...], group_tokens: int) -> Iterator[pa.RecordBatch]:
    codec, out = _codec(path), []
    end = end_id.to_bytes(4, "little")

    def emit(doc, start, n, sequence, offset, window, group):
        doc_id, ids, at, total = doc
        out.append((doc_id, start, n, zlib.crc32(ids[4 * (start - at) : 4 * (start - at + n)]), total, sequence, offset, window, group))

    def flush():
        columns = list(zip(*out, strict=True)) or [()] * len(_ARROW)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    packer = Packer(tiers, emit, group_tokens, TaskContext.get().partitionId() << 33)
    for batch in slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            ids = codec.encode(text.decode("utf-8", "replace")) + end
            n = len(ids) // 4
            # Only the rest after the longest windows may wait in an open window.
            whole = n - n % tiers[-1]
            for start in range(0, whole, tiers[-1]):
                packer.add((doc_id, ids, 0, n), start, tiers[-1])
            if n > whole:
                packer.add((doc_id, ids[4 * whole :], whole, n), whole, n - whole)
            if len(out) >= 20_000:
                yield flush()
    packer.finish()
    yield flush()


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, group_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; see ``SCHEMA``.  ``tiers`` are powers of two, ascending."""
    if list(tiers) != sorted(set(tiers)) or any(w & (w - 1) for w in tiers):
        raise ValueError("tiers must be ascending powers of two")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lambda batches: _packed(batches, tokenizer_path, end_id, tiers, group_tokens), SCHEMA
    )
