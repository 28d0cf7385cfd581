"""Sources and sinks: series, intervals, directions, batch files, literals."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEARLY = "series string, year int, value double"
INTERVAL = "name string, start_year string, end_year string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); a temporary one in local sessions without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if given is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            given = tempfile.mkdtemp(prefix="scratch-")
        sc.setCheckpointDir(given)
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, kept and marked for broadcast if it has no more than ``rows`` rows; beyond, joined as Spark sees fit."""
    kept = df.persist()
    if kept.limit(rows + 1).count() <= rows:
        return F.broadcast(kept)
    kept.unpersist()
    return df


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written by the driver to any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def enforce_columns(df: DataFrame, *needed: str) -> DataFrame:
    """``df``, or an error that names the missing columns."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def number(c: str) -> Column:
    """The value as a double; what isn't a number, and NaN, is null."""
    made = F.col(c).try_cast("double")
    return F.when(~F.isnan(made), made)


def yearly_series(spark: SparkSession, path: str, year: int = 0, value: int = 1, skip: int = 0, series: str = "series") -> DataFrame:
    """One sheet landed as headerless CSV: a year and a value column by position, the first ``skip`` rows dropped.

    Years are cut to whole numbers; rows without a year or a value go.  Rows are
    taken as text lines and split by the CSV reader, so the wide rest is never typed.
    """
    width = max(year, value) + 1
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).csv(path)
    rows = raw.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    if skip:
        # Head lines lie in the first block of a file.
        first = rows.filter("__b = 0").groupBy("__f").agg(F.min("__i").alias("__0"))
        rows = rows.join(F.broadcast(first), "__f").filter(F.col("__i") - F.col("__0") >= skip)
    return rows.select(F.lit(series).alias("series"), number(f"c{year}").cast("int").alias("year"), number(f"c{value}").alias("value")).dropna()


def merged_macro(wages: DataFrame, earnings: DataFrame) -> DataFrame:
    """``year, cpi, real_earn`` by a full outer join of two yearly series."""
    return wages.select("year", F.col("value").alias("cpi")).join(earnings.select("year", F.col("value").alias("real_earn")), "year", "full_outer")


def interval_series(spark: SparkSession, path: str, skip: Sequence[str] = (), start_from: float | None = None) -> DataFrame:
    """All interval CSV files under ``path``: ``series`` is the file's stem; rows without a start are dropped."""
    df = enforce_columns(spark.read.option("header", True).csv(path), "name", "start_year", "end_year")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    made = df.select(stem.alias("series"), "name", number("start_year").alias("start_year"), number("end_year").alias("end_year")).filter(~F.col("series").isin(*skip) & F.col("start_year").isNotNull())
    return made if start_from is None else made.filter(F.col("start_year") >= start_from)


def interval_directory(spark: SparkSession, path: str, skip: Sequence[str] = (), start_from: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows as of :func:`interval_series`, ``series, message`` of the files that lack a column).

    Each file is read by its own header, in whatever order its columns stand, so a
    bad file costs nothing but itself.  Fields in quotes may hold commas, not line ends.
    """
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    lines = spark.read.text(f"{path}/*.csv").select(stem.alias("series"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", "\r$", "").alias("line"))
    lines = lines.filter(~F.col("series").isin(*skip) & (F.trim("line") != ""))
    # A file's header is the first line of its first block.
    heads = lines.groupBy("series").agg(F.min(F.struct("block", "i", "line")).alias("h"))
    names = F.transform(F.split(F.regexp_replace("h.line", "\ufeff", ""), ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    needed = F.array(*[F.lit(c) for c in ("name", "start_year", "end_year")])
    heads = heads.select("series", F.col("h.i").alias("head"), names.alias("names"), F.array_except(needed, names).alias("lost"))
    bad = heads.filter(F.size("lost") > 0).select("series", F.concat(F.lit("missing columns: "), F.array_join("lost", ", ")).alias("message"))
    # One row a file: broadcast by a hint that AQE may drop when the files are very many.
    good = heads.filter(F.size("lost") == 0)
    fields = F.transform(F.split("line", ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    rows = lines.join(good, "series").filter(F.col("i") != F.col("head")).withColumn("fields", fields)
    at = lambda c: F.nullif(F.get("fields", F.array_position("names", c) - 1), F.lit("")).alias(c)
    made = rows.select("series", at("name"), at("start_year"), at("end_year")).select("series", "name", number("start_year").alias("start_year"), number("end_year").alias("end_year")).filter("start_year is not null")
    return made if start_from is None else made.filter(F.col("start_year") >= start_from), bad


def save_directions(directions: DataFrame, path: str) -> None:
    """``model, axis, layer, vec`` as a table partitioned by model and layer."""
    enforce_columns(directions, "model", "axis", "layer", "vec").write.mode("overwrite").partitionBy("model", "layer").parquet(path)


def load_directions(spark: SparkSession, path: str, model: str, layer: int | None = None) -> DataFrame:
    df = spark.read.parquet(path).filter(F.col("model") == model)
    df = df if layer is None else df.filter(F.col("layer") == layer)
    if not df.take(1):
        raise FileNotFoundError(f"no directions for {model} under {path}; build the axes first")
    return df


def write_requests(texts: DataFrame, path: str, model: str) -> None:
    """Batch requests as JSON lines: ``custom_id`` (req-<n>) and the body; ``texts`` has ``ord, text``."""
    body = F.struct(F.lit(model).alias("model"), F.col("text").alias("input"))
    texts.select(F.concat(F.lit("req-"), F.col("ord").cast("string")).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), body.alias("body")).write.mode("overwrite").json(path)


RESPONSE = "custom_id string, error string, response struct<body:struct<data:array<struct<embedding:array<float>>>>>"


def read_responses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(``ord, embedding``, failed rows) of batch responses; blank lines are skipped."""
    raw = spark.read.schema(RESPONSE).json(path)
    vec = F.get(F.col("response.body.data"), F.lit(0))["embedding"]
    good = raw.filter(F.col("error").isNull() & vec.isNotNull())
    return good.select(F.split("custom_id", "-")[1].cast("int").alias("ord"), vec.alias("embedding")), raw.filter(F.col("error").isNotNull())


def save_state(spark: SparkSession, path: str, **state) -> None:
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str) -> dict:
    """The state document; an absent one is an error."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except Exception as e:
        raise FileNotFoundError(f"no batch state under {path}; submit first") from e


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV with a header and empty fields for nulls; for result frames, which are small by construction."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that Spark's file systems have."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    raise FileNotFoundError(", ".join(PurePosixPath(p).name for p in paths))
