"""Small documents with the awkward cases."""

import random

from chronaxis.llm import queries

SF = "/root/testdata/sf0.001"


def awkward(n: int = 60, seed: int = 3) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, near copies, repeated rows."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "Über", "año", "naïve", "x", "1.2.3.4", "end."]
    texts: list = [None, "", " \n\t ", "one", "one two three", "ONE two  three", "one two", "😀 smile 😀"]
    base = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(120))
    for i in range(12):
        parts = base.split()
        if i % 3:
            parts[rng.randrange(len(parts))] = f"changed{i}"
        texts.append(" ".join(parts))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(n - len(texts))]
    texts.append("long " + " ".join(rng.choice(words) for _ in range(30_000)))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(t) if t else None) for i, t in enumerate(texts)]
    return [*rows, rows[10], (None, "no id here", "en", "a", 10), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    """The documents as a frame, with columns whose names clash with those used inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    return df.withColumns({"kept": F.lit("x"), "fp": F.lit(1), "score": F.lit("y"), "block": F.lit(0), "weight": F.lit(None).cast("string"), "n_tokens": F.lit(2)})


def query(spark, name, tmp_path, rows=None, **tables):
    """A contract query over the awkward documents."""
    frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return queries.queries()[name](spark, str(tmp_path)).collect()
