"""The contract queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, mixing, packing, pii, quality, simhash, toxicity, url_filter
from .common import crc_bucket
from .hidden_markov import HiddenMarkovModel


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 5) == 1
    return HiddenMarkovModel.train(docs.filter(~held_out)).score(docs).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with exact_dedup.DigestIndex.temporary(spark) as index:
        found = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), index, "documents")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents),
r as (select *, row_number() over (partition by text_sha256 order by n desc, doc_id) as rn, count(*) over (partition by text_sha256) as group_size,
  first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id from d)
select doc_id, keep_id, group_size, rn = 1 as kept, text_sha256 from r
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), target_entropy=0.98, max_repeats=4.0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    model = language_id.train(docs, keep=~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(_table(spark, sf_dir, "documents"))


_NS = quality.NGRAMS
OP6_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
size as (select doc_id, sum(strlen(w)) as total from w group by doc_id),
win as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as g from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select unnest(range(2, {max(_NS) + 1})) as n))),
dup as (select doc_id, n, g from win group by all having count(*) > 1),
marked as (select distinct doc_id, n, i + unnest(range(n)) as i from win semi join dup using (doc_id, n, g)),
cover as (select doc_id, n, sum(strlen(w)) as covered, count(*) as k from marked join w using (doc_id, i) group by all),
m as (select d.doc_id, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
  coalesce((select k from cover c where c.doc_id = d.doc_id and n = {quality.WINDOW}), 0) as n_repeat_words,
  coalesce((list_sum(list_transform(ls, lambda x: strlen(x))) - list_sum(list_transform(list_distinct(ls), lambda x: strlen(x)))) / list_sum(list_transform(ls, lambda x: strlen(x))), 0)::double as dup_line_share,
  {", ".join(f"coalesce((select covered from cover c where c.doc_id = d.doc_id and n = {n}) / (select total from size z where z.doc_id = d.doc_id), 0)::double as dup_{n}gram_share" for n in _NS)} from d),
f as (select *, n_words < {quality.MIN_WORDS} or {quality.MAX_PERCENT} * n_words < 100 * n_repeat_words as base_failed from m)
select *, not base_failed and dup_line_share <= {quality.LINE_LIMIT} and {" and ".join(f"dup_{n}gram_share <= {limit}" for n, limit in quality.LIMITS.items())} as kept from f
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tuple(k for k in pii.KINDS if k.base)
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base], F.sha2(pii.described(base).cast("binary"), 256).alias("base_sha256"), pii.described(pii.KINDS).alias("spans"))


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "bad_mean", "bad_low")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.ToxicityModel.fit(docs, _table(spark, sf_dir, "labels"), keep=crc_bucket(F.col("doc_id"), 5) != 0)
    return model.score(docs).select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hidden_markov, op2_exact_dedup, op3_mixing, op4_language_id, op5_simhash, op6_quality, op7_pii, op8_url_filter, op9_packing, op10_toxicity, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op6_quality": OP6_SQL}
