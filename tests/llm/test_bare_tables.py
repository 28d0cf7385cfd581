"""Every contract query, and the pipeline's stages, on tables that hold nothing but nulls, blanks or no row at all."""

import pytest

import corpus_pipeline
from chronaxis.llm import queries
from tests.llm.fixtures import frame

ROWS = {
    "none": [],
    "nulls": [(None, None, None, None, None)] * 3,
    "blank": [(i, t, None, "s", 0) for i, t in enumerate(["", " \n", "\t", None, "\x0b\x0c\r"])],
    "repeated": [(1, "one and the same text", "en", "s", 0)] * 40,
}


@pytest.fixture(scope="module", params=sorted(ROWS))
def folder(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    rows = ROWS[request.param]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, i % 2) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(r[0], r[1]) for r in rows], "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    return path, rows


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"pipeline"}))
def test_query(spark, folder, name):
    path, rows = folder
    got = queries.queries()[name](spark, path).collect()
    assert len(got) >= len(rows) if name in ("op3_mixing", "op9_packing") else len(got) == len(rows)


def test_pipeline(spark, folder):
    path, rows = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert bool(got) == bool(rows)
    assert len({r.doc_id for r in got}) == bool(rows)  # all texts of each table are near copies
