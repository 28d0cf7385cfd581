import corpus_pipeline
from chronaxis.llm.queries import pipeline
from tests.llm.fixtures import SF, awkward, frame


def test_stages_keep_the_columns(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, 1, 0), (10, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id for r in docs.collect()} <= {r[0] for r in awkward()} and docs.count() > 20


def test_run_equals_brute_force(spark):
    """Every document that toxicity keeps is represented; copies and near copies are not."""
    import hashlib
    import re

    from chronaxis.llm.toxicity import ToxicityModel
    from tests.llm.test_simhash import brute_components, plain_fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = ToxicityModel.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in model.score(docs).filter("score < 0.5 or n_hits = 0").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in clean)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest(), []).append((-len(t), i, t))
    kept = sorted(min(g)[1:] for g in groups.values())
    roots = brute_components([plain_fingerprint(t) for _, t in kept])
    want = {kept[i][0] for i in set(roots)}
    got = pipeline(spark, SF).collect()
    assert {r.doc_id for r in got} == want
