"""Operators against values worked out by hand, with ties, constants, gates, nulls and edges."""

import math
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from chronaxis.functions import stats
from chronaxis.functions import vectors as V
from chronaxis.operators import geometry, linalg, probes, series
from chronaxis.plans import literals
from chronaxis.queries import oracle_sql, queries
from chronaxis.sources import tables
from chronaxis.streaming.windows import windowed_mean

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize(
    ("r", "n", "p"), [(0.7933732870175974, 68, 7.238483982737284e-16), (0.8535328472725884, 68, 2.3463399830390356e-20), (-0.12683566433566432, 65, 0.31402425158749053), (0.8729064039408866, 29, 6.627344834912999e-10)]
)
def test_p_values(r, n, p):
    assert stats.t_test_p(r, n) == pytest.approx(p, rel=1e-10)


def test_p_value_edges():
    assert stats.t_test_p(1.0, 10) == 0.0 and stats.t_test_p(None, 10) is None and stats.t_test_p(0.5, 2) is None


def test_ranks_constants_and_gate(spark):
    rows = [("tie", 1.0, 1.0), ("tie", 2.0, 2.0), ("tie", 2.0, 3.0), ("tie", 3.0, 4.0), ("flat", 5.0, 1.0), ("flat", 5.0, 2.0), ("flat", 5.0, 3.0), ("few", 1.0, 1.0), ("few", 2.0, 2.0), ("gap", 1.0, None), ("gap", float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    ranks = [r[0] for r in df.filter("g = 'tie'").orderBy("x", "y").select(stats.average_rank("x", ["g"])).collect()]
    assert sorted(ranks) == [1, 2.5, 2.5, 4]
    got = {r.g: r for r in stats.spearman(df, ["g"], "x", "y").collect()}
    assert got["tie"].rho == pytest.approx(0.9486832980505138) and got["flat"].rho is None and got["few"].rho is None and "gap" not in got


def test_rolling_width(spark):
    df = spark.range(68).select(F.lit("a").alias("g"), F.col("id").alias("t"), F.col("id").alias("x"), (-F.col("id")).alias("y"))
    for width in (14, 15):  # an even width acts as the next odd one
        got = stats.rolling_spearman(df, ["g"], "t", "x", "y", width).collect()
        assert len(got) == 54 and all(r.rho == pytest.approx(-1) and r.n == 15 for r in got)


def test_kendall_forms_agree(spark):
    df = spark.createDataFrame([(i, float((i * 7) % 11), float((i * 3) % 5)) for i in range(30)], "i int, x double, y double").withColumn("g", F.lit(1))
    a, b = stats.kendall_tau(df, ["g"], "x", "y", "i").first().tau, stats.kendall_tau_sorted(df, ["g"], "x", "y").first().tau
    assert a == pytest.approx(b) and -1 <= a <= 1


def test_poly_and_scaling_of_constants(spark):
    df = spark.createDataFrame([("c", float(i), 3.0) for i in range(5)] + [("q", float(i), float(i * i)) for i in range(-3, 4)], "g string, x double, y double")
    got = {r.g: r for r in stats.poly_r2(df, ["g"], "x", "y").collect()}
    assert got["c"].r2_linear == got["c"].r2_quadratic == 0 and got["q"].r2_quadratic == pytest.approx(1) and got["q"].r2_linear == pytest.approx(0)
    scaled = df.select("g", stats.zscore("y", ["g"]).alias("z"), stats.minmax("y", ["g"]).alias("m")).filter("g = 'c'").collect()
    assert {(r.z, r.m) for r in scaled} == {(0.0, 0.0)}


def test_log_differences_skip_what_is_not_positive(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 3.0, 0.0), ("a", 3, 4.0, math.e)], "g string, t int, v double, r double")
    got = [r.d_real for r in stats.first_differences(df, ["g"], "t", "v", "r").orderBy("t").collect()]
    assert got == [None, None, None]


def test_moving_average_repeats_the_edges(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(6)], "g string, t int, v double")
    got = [r.s for r in series.moving_average(df, ["g"], "t", "v", "s").orderBy("t").collect()]
    assert got == pytest.approx([0.6, 1.2, 2.0, 3.0, 3.8, 4.4])


def test_ordinals(spark):
    p = spark.createDataFrame([("a", "1", 0.0, 10.0), ("a", "2", 8.0, 20.0), ("a", "3", 30.0, 45.0), ("a", "4", 40.0, None)], "series string, name string, start_year double, end_year double")
    grid = spark.createDataFrame([(-5,), (9,), (25,), (40,), (60,)], "year int")
    got = [r.ordinal for r in series.ordinals(p, grid, natural=False).orderBy("year").collect()]
    assert got[0] == 0 and got[1] == 0.5 and got[2] == pytest.approx(1 + 17 / 22) and got[3] == 2.5 and got[4] == 3
    masked = [r.ordinal for r in series.ordinals(p, grid).orderBy("year").collect()]
    assert masked[0] is None and masked[4] is None


def test_band_mean_without_rows_is_null(spark):
    got = series.band_mean(spark.createDataFrame([(0,), (100,)], "year int"), spark.createDataFrame([(1, 2.0)], "year int, v double"), ["v"]).orderBy("year").collect()
    assert [r.v for r in got] == [2.0, None]


def test_angle_and_lengths(spark):
    row = spark.range(1).select(V.angle(F.lit(-0.11480625313399401)).alias("a"), V.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("d"), V.angle(F.lit(1.0000001)).alias("z")).first()
    assert row.a == pytest.approx(83.407549843646) and row.d is None and row.z == 0


@pytest.mark.parametrize(("periods", "purity"), [(3, 2 / 3), (7, 2 / 7)])
def test_neighbours_break_ties_by_row(spark, periods, purity):
    df = spark.createDataFrame([(i, i // 4, [1.0, 1.0]) for i in range(4 * periods)], "i int, pid int, vec array<double>").withColumn("g", F.lit(0))
    near = geometry.neighbours(df, ["g"], "pid", "i")
    assert geometry.purity(near, ["g"], "pid").first().purity == pytest.approx(purity)
    assert {round(r[1], 9) for r in geometry.confusion(near, ["g"], "pid").groupBy("pid").agg(F.sum("share")).collect()} == {1.0}


@pytest.mark.parametrize("block", [3, 512])
def test_neighbours_by_blocks_equal_brute_force(spark, monkeypatch, block):
    """With and without groups, many blocks and one; labels as text; a group of a single label has no neighbour."""
    import numpy as np

    monkeypatch.setattr(geometry, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(["a", "b", "lone"][i % 3], i, "same" if i % 3 == 2 else "pqrs"[int(rng.integers(4))], np.round(rng.normal(size=3), 1).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, i long, l string, vec array<double>").repartition(5)
    for groups in ([], ["g"]):
        want = {}
        for g, i, label, v in rows:
            near = [(round(math.dist(v, w), 9), j, m) for h, j, m, w in rows if m != label and (not groups or h == g)]
            if near:
                want[i] = min(near)[2]
        assert {r.i: r.near for r in geometry.neighbours(df, groups, "l", "i").collect()} == want


def _embeddings(path, rows):
    """A folder with ``rows`` (id, label, vector) as the table of embeddings."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path.mkdir()
    ids, labels, vecs = zip(*rows, strict=True)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vecs, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), path / "embeddings.parquet")
    return str(path)


def _shuffled(spark, run):
    """Bytes that the stages of ``run`` write for others."""
    sc = spark.sparkContext
    jvm, store = sc._jvm, sc._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = stages()
    return sum(s.shuffleWriteBytes() for s in map(made.apply, range(made.size())) if s.stageId() not in before)


@pytest.mark.parametrize("name", ["confusion", "knn_purity"])
def test_nearest_points_are_shuffled_as_the_input_grows(spark, monkeypatch, tmp_path, name):
    """Four times the points: about four times the bytes, not the square."""
    import numpy as np

    monkeypatch.setattr(geometry, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, i % 5, rng.normal(size=64).tolist()) for i in range(2048)]
    few, many = (_shuffled(spark, queries()[name](spark, _embeddings(tmp_path / str(n), rows[:n])).collect) for n in (512, 2048))
    assert 0 < many < 6 * few


@pytest.mark.parametrize("name", ["confusion", "knn_purity"])
@pytest.mark.parametrize("block", [4, 512])
def test_nearest_points_of_odd_rows_equal_sql(spark, monkeypatch, tmp_path, name, block):
    """Copies, near copies, many under one vector; vectors that are missing, infinite or no numbers; rows without a label."""
    import duckdb
    import numpy as np

    monkeypatch.setattr(geometry, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(5)), np.round(rng.normal(size=4), 1).tolist()) for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(200 + i, i % 3, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]
    rows += [(300 + i, i % 2 + 3, [x + 1e-7 * i for x in rows[i][2]]) for i in range(9)]
    rows += [(400, 1, [math.nan] * 4), (401, 2, [math.nan, 0.0, 0.0, 0.0]), (402, 7, [math.inf, 0.0, 0.0, 0.0]), (403, 8, [-math.inf, 0.0, 0.0, 0.0]), (404, 9, None), (405, None, [0.5, 0.5, 0.5, 0.5]), (406, 8, [math.inf, 1.0, 0.0, 0.0])]
    at = _embeddings(tmp_path / "odd", rows)
    sql = f"with embeddings as (select * from read_parquet('{at}/embeddings.parquet')), " + oracle_sql()[name].strip().removeprefix("with")
    want = sorted(duckdb.sql(sql).fetchall())
    assert sorted(map(tuple, queries()[name](spark, at).collect())) == want


@pytest.mark.parametrize("own", [True, False])
def test_bounds_lose_no_nearest_point(monkeypatch, own):
    """Small matrices, points far off and a cluster of near copies, against all distances."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(geometry, "ROWS", 7)
    monkeypatch.setattr(geometry, "COLUMNS", 5)
    monkeypatch.setattr(geometry, "PAIRS", 11)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(90, 6))
    v[:30] = v[0] + rng.normal(size=(30, 6)) * 1e-9
    v[30:33] *= 1e6
    v[40:60] = np.round(v[40:60])
    label, block = rng.integers(0, 4, 90), np.zeros(90, int) if own else rng.integers(0, 2, 90)
    table = pa.table({"id": np.arange(90), "l": label, "copies": np.ones(90, int), "__v": pa.array(v.tolist()), "__b": block, "__p": np.zeros(90, int), "__q": np.full(90, 0 if own else 1)})
    got = {r["id"]: (r["__d"], r["__k2"]) for r in geometry.block_pair(table, [], "l", "id").to_pylist()}
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 9)
    for i in range(90):
        assert got[i] == min((d[i, j], j) for j in range(90) if label[j] != label[i] and (own or block[j] != block[i]))


def test_constant_layer(spark):
    df = spark.createDataFrame([(0, i % 3, [2.0, 2.0]) for i in range(9)], "layer int, pid int, vec array<double>")
    long = V.spread(df, "vec")
    assert geometry.bw_ratio(long, ["layer"], "pid").first().bw == 0 and geometry.robustness(long, ["layer"], "pid").first().robustness == 0


def test_velocity_and_dimension(spark):
    path = spark.createDataFrame([("s", float(t), [float(x), 0.0]) for t, x in [(0, 0), (1, 5), (10, 23)]], "series string, year double, vec array<double>")
    assert [r.velocity for r in geometry.velocity(path, ["series"], "year").orderBy("at").collect()] == [None, 2.0]
    line = spark.createDataFrame([("s", float(t), [float(t), 1.0]) for t in range(12)], "series string, year double, vec array<double>")
    got = geometry.local_dimension(line, ["series"], "year").collect()
    assert len(got) == 4 and all(r.dimension == pytest.approx(1) for r in got)


def test_linear_algebra(spark):
    rows = [("a", i, [float(i), 2.0 * i + (i % 2) * 0.1, 1.0]) for i in range(8)]
    df = spark.createDataFrame(rows, "g string, t int, vec array<double>")
    axis = linalg.first_component(df, ["g"], "t").first().axis
    assert math.hypot(*axis) == pytest.approx(1) and axis[1] > 0.8
    scores = linalg.component_scores(df, ["g"], "t", k=2).orderBy("t", "component").collect()
    assert sum(r.share for r in scores[:2]) == pytest.approx(1) and len({round(r.score, 3) for r in scores if r.component == 0}) == 8
    fit = linalg.min_norm_axis(df, ["g"], "t").first().axis
    assert math.hypot(*fit) == pytest.approx(1)
    assert linalg.classical_mds(df.withColumn("vec", F.array(F.col("vec")[0], F.col("vec")[1] * 0 + 1)), ["g"], "t").first().stress == pytest.approx(0, abs=1e-8)
    bumps = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 1.0, 0.0, 5.0, 0.0, None, 1.0])], "g string, t int, v double")
    assert [r.t for r in linalg.peaks(bumps, ["g"], "t", "v").collect()] == [3]


@pytest.mark.parametrize("held", [1, 8_000_000])
def test_moments_are_summed_over_tasks(spark, monkeypatch, held):
    """Groups over many tasks, a null group among them, against one decomposition each."""
    import numpy as np

    monkeypatch.setattr(linalg, "HELD", held)
    rng = np.random.default_rng(5)
    x = rng.normal(3, 1, (90, 5)) * [1, 2, 3, 4, 5]
    rows = [(["a", "b", None][i % 3], i, x[i].tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, t int, vec array<double>").repartition(7)
    made = {r.g: r for r in linalg.components(df, ["g"], k=3).collect()}
    for n, g in enumerate(["a", "b", None]):
        own = x[n::3] - x[n::3].mean(0)
        s, vt = np.linalg.svd(own, full_matrices=False)[1:]
        assert np.abs(np.array(made[g].axes)) == pytest.approx(np.abs(vt[:3]), abs=1e-9)
        assert made[g].explained == pytest.approx((s**2 / (s**2).sum())[:3]) and all(max(a, key=abs) > 0 for a in made[g].axes)
    axis = {r.g: np.array(r.axis) for r in linalg.first_component(df, ["g"], "t").collect()}
    assert np.corrcoef(x[::3] @ axis["a"], np.arange(0, 90, 3))[0, 1] >= 0 and abs(axis["a"] @ made["a"].axes[0]) == pytest.approx(1)


def test_missing_texts_are_named(spark):
    texts = spark.createDataFrame([("a",), ("lost",)], "text string")
    with pytest.raises(KeyError, match="lost"):
        probes.embed_from_table(texts, spark.createDataFrame([("a", 1)], "text string, v int"))
    made = probes.by_layer(probes.embed_with(texts, lambda batch: [[[float(len(t))], [1.0]] for t in batch]))
    assert {(r.text, r.layer, r.vec[0]) for r in made.collect()} == {("a", 0, 1.0), ("a", 1, 1.0), ("lost", 0, 4.0), ("lost", 1, 1.0)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text("title,,\nyear,wage,cpi\n1209.0,1,2.5\n1210,1,\nnote,1,4\n1211,1,3.5\n")
    got = tables.yearly_series(spark, str(tmp_path / "sheet.csv"), 0, 2, skip=2, series="cpi").orderBy("year").collect()
    assert [(r.year, r.value) for r in got] == [(1209, 2.5), (1211, 3.5)]
    (tmp_path / "iv").mkdir()
    (tmp_path / "iv" / "ages.csv").write_text("name,start_year,end_year\none,-700,-600\ntwo,1,x\nthree,?,5\n")
    (tmp_path / "iv" / "skipped.csv").write_text("name,start_year,end_year\nz,1,2\n")
    got = tables.interval_series(spark, str(tmp_path / "iv"), skip=["skipped"]).orderBy("start_year").collect()
    assert [(r.series, r.name, r.end_year) for r in got] == [("ages", "one", -600.0), ("ages", "two", None)]
    assert tables.interval_series(spark, str(tmp_path / "iv"), skip=["skipped"], start_from=-600).count() == 1
    with pytest.raises(ValueError, match="vec"):
        tables.save_directions(spark.createDataFrame([("m", "time", 4)], "model string, axis string, layer int"), str(tmp_path / "d"))
    tables.save_directions(spark.createDataFrame([("m", "time", 4, [1.0])], "model string, axis string, layer int, vec array<double>"), str(tmp_path / "d"))
    assert tables.load_directions(spark, str(tmp_path / "d"), "m", 4).first().vec == [1.0]
    with pytest.raises(FileNotFoundError):
        tables.load_directions(spark, str(tmp_path / "d"), "other")
    tables.write_csv(spark.createDataFrame([("a", None)], "k string, v double"), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text() == "k,v\na,\n"


def test_broadcast_only_what_is_small(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    left, right = spark.range(50), spark.range(20).withColumn("v", F.lit(1))
    few, many = left.join(tables.small(right, 20), "id"), left.join(tables.small(right, 19), "id")
    assert "strategy=broadcast" in plan(few) and "strategy=broadcast" not in plan(many)
    assert few.count() == many.count() == 20


def test_batch_files(spark, tmp_path):
    tables.write_requests(spark.createDataFrame([("hello", 3)], "text string, ord int"), str(tmp_path / "req"), "small")
    assert "req-3" in "".join(f.read_text() for f in (tmp_path / "req").glob("*.json"))  # in any of the parts
    (tmp_path / "res.jsonl").write_text('{"custom_id":"req-3","response":{"body":{"data":[{"embedding":[0.5,1]}]}}}\n\n{"custom_id":"req-4","error":"late"}\n')
    good, bad = tables.read_responses(spark, str(tmp_path / "res.jsonl"))
    assert [(r.ord, r.embedding) for r in good.collect()] == [(3, [0.5, 1.0])] and bad.count() == 1
    tables.save_state(spark, str(tmp_path / "state"), batch_id="b", texts=["x"])
    assert tables.load_state(spark, str(tmp_path / "state")) == {"batch_id": "b", "texts": ["x"]}
    with pytest.raises(FileNotFoundError):
        tables.load_state(spark, str(tmp_path / "none"))


def test_stream_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 01:00:00' as ts, 'a' as event_type, 2.0D as value union all select timestamp'2024-01-01 05:00:00', 'a', 4.0D").write.parquet(str(tmp_path / "in"))
    stream = windowed_mean(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.mean_value, r.n) for r in spark.table("windowed").collect()] == [(3.0, 2)]


def test_sampling(spark):
    df = literals.year_grid(spark, 0, 99, 1).withColumn("g", F.lit(1))
    assert [r.year for r in series.stride_sample(df, ["g"], ["year"], 5).orderBy("year").collect()] == [0, 25, 50, 74, 99]
    assert series.every_nth(df, "year", ["g"]).count() == 17


def test_entry_imports_without_the_training_data_part(tmp_path):
    shutil.copytree(f"{ROOT}/chronaxis", tmp_path / "chronaxis", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'spearman_levels' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
