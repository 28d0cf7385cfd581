"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that ``bytes.split()`` splits at: the same six characters.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the folder in ``spark.checkpoint.dir``.

    The written copy survives lost executors.  Where the setting is absent (tests,
    local sessions) a temporary folder is used; on a cluster its absence is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if given is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            given = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(given)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; see :func:`checkpointed`."""
    checkpointed(spark.range(0))
    return spark.sparkContext.getCheckpointDir()


def crc_bucket(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(n))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes the empty text."""
    return [x or b"" for x in pc.cast(column, pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``max_bytes`` or one row, so that very long texts don't meet in memory."""
    for batch in batches:
        rows = max(1, batch.num_rows * max_bytes // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def join_to_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, hot: int = 1000, least: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row a key and the key's row count in ``size``.

    Groups with more than 1/``hot`` of all rows (and more than ``least``) are at most
    ``hot`` in number, so these may be broadcast whatever the input; all others are joined
    by shuffle and none of them is large.  No row is dropped: each key is on exactly one side.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(total // hot, least)
    big = groups.filter(F.col(size) > limit)
    if not big.take(1):
        return rows.join(groups, key)
    return (
        rows.join(F.broadcast(big), key)
        .unionByName(rows.join(F.broadcast(big.select(key)), key, "left_anti").join(groups.filter(F.col(size) <= limit), key))
    )


def row_hash(df: DataFrame, *first: str) -> Column:
    """A hash of all columns that can be hashed (maps can't), those in ``first`` included; equal for repeated rows."""
    return F.xxhash64(*first, *[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind and c not in first])


def fetch(docs: DataFrame, keys: dict[str, Column], winners: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys are in ``winners`` (the key columns and ``times``, the rows that have them).

    One semi-join fetches the rows, hashed on the narrow side so that no text is
    sorted.  Only where a winner is a repeated row are rows deduplicated besides,
    and then partly before the shuffle, so a row repeated any number of times meets
    in no task.  The row travels as one struct, so that its names can't clash.
    """
    names = list(keys)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in keys.items()])
    single = keyed.join(winners.filter("times = 1").select(*names).hint("shuffle_hash"), names, "left_semi")
    again = winners.filter("times > 1").select(*names)
    if again.take(1):
        single = single.unionByName(keyed.dropDuplicates(names).join(again.hint("shuffle_hash"), names, "left_semi"))
    return single.select("row.*")
