import hashlib
import re

import pytest
from pyspark.sql import functions as F

from chronaxis.llm.exact_dedup import DigestIndex, digest, drop_copies, exact_dedup
from chronaxis.llm.simhash import drop_near_copies
from tests.llm.fixtures import awkward, frame, query


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        t = text or ""
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest(), []).append((-len(t), doc_id is not None, doc_id or 0, doc_id))
    return {h: (min(g)[3], len(g)) for h, g in groups.items()}


def test_query_equals_brute_force(spark, tmp_path):
    got, want = query(spark, "op2_exact_dedup", tmp_path), brute(awkward())
    assert len(got) == len(awkward())
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(want)


def test_empty_table(spark, tmp_path):
    assert query(spark, "op2_exact_dedup", tmp_path, rows=[]) == []


def test_index_keeps_what_came_before(spark):
    index = DigestIndex.temporary(spark, buckets=4)
    first = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    again = spark.createDataFrame([(3, "ab"), (4, "d"), (5, "d ")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup(first, index, "1").collect() if r.kept} == {1, 2}
    got = {r.doc_id: r for r in exact_dedup(again, index, "2").collect()}
    assert not got[3].kept and got[3].known and got[3].keep_id == 1
    assert got[5].kept and not got[4].kept
    assert index.read().count() == 3
    assert {r.doc_id for r in drop_copies(spark.createDataFrame([(6, "c"), (7, "e")], "doc_id long, text string"), index, "3").collect()} == {7}
    index.drop()
    assert not spark.catalog.tableExists(index.table)


@pytest.mark.parametrize("run", [lambda d, i: {r.doc_id for r in exact_dedup(d, i, "2").collect() if r.kept}, lambda d, i: {r.doc_id for r in drop_copies(d, i, "2").collect()}])
def test_a_batch_that_failed_may_run_again(spark, run, monkeypatch):
    """Lost before, during or after the append: the same rows stay when the batch is run again."""
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, "old")], "doc_id long, text string")
    with DigestIndex.temporary(spark, buckets=4) as index:
        exact_dedup(docs.filter("doc_id = 4"), index, "1")
        with monkeypatch.context() as m:
            m.setattr(DigestIndex, "_write", lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                run(docs, index)
        drop_copies(docs.filter("doc_id = 3"), index, "2")  # a part of the append had come through
        for _ in range(2):  # the result of the first run is lost
            assert run(docs, index) == {1, 3}
        assert sorted((r.keep_id, r.batch) for r in index.read().collect()) == [(1, "2"), (3, "2"), (4, "1")]


def test_index_is_not_shuffled(spark):
    docs = spark.range(100).selectExpr("id as doc_id", "cast(id as string) as text")
    with DigestIndex.temporary(spark, buckets=8) as index:
        exact_dedup(docs, index, "1")
        plan = index.new_only(docs.select(digest(F.col("text")).alias("text_sha256")), "2")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_drop_copies_returns_whole_rows(spark):
    docs = frame(spark).withColumns({"digest": F.lit("mine"), "n": F.lit(1), "id": F.lit(2), "hash": F.lit(3), "times": F.lit(4), "row": F.lit("5"), "m": F.create_map(F.lit(1), F.lit(2))})
    got = drop_copies(docs, DigestIndex.temporary(spark, buckets=4), "all")
    assert got.columns == docs.columns
    want = brute(awkward())
    rows = got.collect()
    assert len(rows) == len(want) and {(r.digest, r.n, r.id, r.hash, r.times, r.row) for r in rows} == {("mine", 1, 2, 3, 4, "5")}


def test_ties_are_defined(spark):
    """Rows with one id and text, but other columns: the same row stays, however the rows are dealt."""
    rows = [(1, "a", f"v{i}") for i in range(20)] + [(2, "b", "same")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    for keep in (lambda d: drop_copies(d, DigestIndex.temporary(spark, buckets=4), "x"), drop_near_copies):
        stays = [sorted(map(tuple, keep(d).collect())) for d in (df, df.orderBy(F.desc("other")), df.repartition(7))]
        assert stays[0] == stays[1] == stays[2] and len(stays[0]) == 2
