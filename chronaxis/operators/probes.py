"""Probe sentences and their embeddings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(slots: DataFrame, templates: DataFrame, **named: str) -> DataFrame:
    """Every slot row with every template; ``{name}`` in ``pattern`` becomes the named column.  Templates are a literal list and broadcast."""
    text = F.col("pattern")
    for name, column in named.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.col(column).cast("string"))
    return slots.crossJoin(F.broadcast(templates)).withColumn("text", text).drop("pattern")


def year_neighbourhood(years: DataFrame, half: int = 3, year: str = "year") -> DataFrame:
    """Each year with the years within ``half`` of it."""
    return years.withColumn("near_year", F.explode(F.sequence(F.col(year) - half, F.col(year) + half)))


def distinct_texts(texts: DataFrame, order: str) -> DataFrame:
    """Distinct texts by first appearance: ``text, ord``; run before any costly embedding."""
    return texts.groupBy("text").agg(F.min(order).alias("ord"))


def embed_from_table(texts: DataFrame, table: DataFrame) -> DataFrame:
    """Texts with their precomputed vectors; texts without one are an error that names some."""
    missing = [r.text for r in texts.select("text").distinct().join(table.select("text"), "text", "left_anti").limit(5).collect()]
    if missing:
        raise KeyError(f"no embedding for {missing}")
    return texts.join(table, "text")


def embed_with(texts: DataFrame, embed: Callable[[list[str]], list[list[list[float]]]]) -> DataFrame:
    """``text, layers`` by a function from a batch of texts to vectors by layer; each distinct text is embedded once."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"text": pdf["text"], "layers": embed(pdf["text"].tolist())})

    return texts.select("text").distinct().mapInPandas(run, "text string, layers array<array<float>>")


def by_layer(embedded: DataFrame) -> DataFrame:
    """One row a layer: ``layer, vec``."""
    return embedded.select(*[c for c in embedded.columns if c != "layers"], F.posexplode("layers").alias("layer", "vec"))
