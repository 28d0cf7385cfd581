"""Exact deduplication against a persistent digest index.

The index is a table, bucketed and sorted by digest, with one row for each text
ever seen and the batch that brought it.  New data is reduced to digests and
anti-joined with what other batches brought (a sort-merge join that doesn't shuffle
the index); what is new is appended.

A batch has a name, and only other batches make its texts known.  So a job that
failed after the append may be run again under the same name: it finds the same
texts new, and appends nothing twice.

Cases: null text counts as empty; rows whose texts are equal after the white space
is deleted form a group; the longest original text stays, then the smallest id
(null ids first), then the first row (in :func:`drop_copies`: that with the smallest
hash of all columns); repeated rows leave one kept row; an empty table gives no rows;
further columns may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, fetch, join_to_groups, row_hash, shared_folder


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without its white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "").cast("binary"), 256)


class DigestIndex:
    """The persistent index: ``text_sha256, keep_id, group_size, batch``.  Leaving a ``with`` block drops it."""

    SCHEMA = "text_sha256 string, keep_id long, group_size long, batch string"

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets
        self.path = path
        if not spark.catalog.tableExists(table):
            self._write(spark.createDataFrame([], self.SCHEMA))

    @classmethod
    def temporary(cls, spark: SparkSession, buckets: int = 64) -> DigestIndex:
        """A new, empty index in the folder that the cluster shares."""
        name = f"digest_index_{uuid.uuid4().hex}"
        return cls(spark, name, f"{shared_folder(spark)}/{name}", buckets)

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *error) -> None:
        self.drop()

    def drop(self) -> None:
        """Drop the table and delete its files."""
        self.spark.sql(f"drop table if exists {self.table}")
        if self.path:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _write(self, df: DataFrame) -> None:
        writer = df.write.mode("append").format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
        if self.path:
            writer = writer.option("path", self.path)
        writer.saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def new_only(self, groups: DataFrame, batch: str) -> DataFrame:
        """The groups whose digest no other batch brought (sort-merge anti-join)."""
        return groups.join(self.read().filter(F.col("batch") != batch).select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def known(self, groups: DataFrame, batch: str) -> DataFrame:
        """The other groups, with the id that another batch kept as ``keep_id``."""
        first = self.read().filter(F.col("batch") != batch).select("text_sha256", F.col("keep_id").alias("first_id"))
        return groups.join(first.hint("merge"), "text_sha256").withColumn("keep_id", F.col("first_id")).drop("first_id")

    def append(self, new: DataFrame, batch: str) -> None:
        """Add what :meth:`new_only` found, but for what an earlier run of the batch has added."""
        own = self.read().filter(F.col("batch") == batch).select("text_sha256")
        rows = new.join(own.hint("merge"), "text_sha256", "left_anti").select("text_sha256", "keep_id", "group_size", F.lit(batch).alias("batch"))
        self._write(rows.repartition(self.buckets, "text_sha256"))


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``, plus ``known``.

    ``known`` is true if another batch brought the text; then nothing of the
    group is kept.  ``group_size`` counts the rows of this batch.
    """
    rows = checkpointed(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"), digest(F.col(text_col)).alias("text_sha256")).withColumn("row_id", F.monotonically_increasing_id())
    )
    groups = checkpointed(
        rows.groupBy("text_sha256")
        .agg(F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id", "row_id")).alias("best"), F.count("*").alias("group_size"))
        .select("text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), "group_size")
    )
    new = checkpointed(index.new_only(groups, batch).withColumn("known", F.lit(False)))
    decided = new.unionByName(checkpointed(index.known(groups, batch).withColumn("known", F.lit(True))))
    index.append(new, batch)
    return join_to_groups(rows, decided, "text_sha256", "group_size").select("doc_id", "keep_id", "group_size", (~F.col("known") & (F.col("row_id") == F.col("keep_row"))).alias("kept"), "text_sha256", "known")


def drop_copies(docs: DataFrame, index: DigestIndex, batch: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The winners are found on digests and narrow keys alone; whole rows are shuffled
    once, by a key that differs within a group, so that a hot group of copies isn't
    gathered anywhere.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = {"digest": digest(F.col(text_col)), "n": -F.length(text), "id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "hash": row_hash(docs)}
    rows = docs.select(*[c.alias(name) for name, c in keys.items()]).groupBy(*keys).agg(F.count("*").alias("times"))
    groups = rows.groupBy("digest").agg(F.min(F.struct("n", "id", "hash", "times")).alias("best"), F.sum("times").alias("group_size"))
    groups = checkpointed(groups.select(F.col("digest").alias("text_sha256"), F.col("best.id").alias("keep_id"), "best", "group_size"))
    new = checkpointed(index.new_only(groups, batch))
    index.append(new, batch)
    return fetch(docs, keys, new.select(F.col("text_sha256").alias("digest"), "best.n", "best.id", "best.hash", "best.times"))
