"""Each query against DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from luxtrace.plans import rasters, workload  # noqa: F401  the raster queries register themselves

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _rows(df):
    df = df[sorted(df.columns)].astype(str)
    return df.columns.tolist(), sorted(map(tuple, df.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_equal_to_sql(spark, duck, sf_dir, tmp_path, name):
    workload.QUERIES[name](spark, sf_dir).write.parquet(str(tmp_path / "out"))
    got, want = duck.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df(), duck.sql(workload.ORACLES[name]).df()
    assert _rows(got) == _rows(want)
    assert len(got)


@pytest.mark.parametrize("name", ["keccak_ids", "merkle_roots", "replay_calls"])
def test_runs(spark, sf_dir, name):
    assert workload.QUERIES[name](spark, sf_dir).count()


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() and "owner" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_residual_energy_against_the_kernel(spark, sf_dir):
    import numpy as np

    from luxtrace.operators.raster.kernels import noise_residual

    rows = {str(r["vec_id"]): np.array(r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = workload.QUERIES["dwt_residual_energy"](spark, sf_dir).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert len(got) == len(rows)
    for r in got:
        plane = np.tile((rows[r["frame_id"]] * 0.5 + 0.5).astype(np.float32), (64, 1))
        assert r["energy"] == pytest.approx(float((noise_residual(plane).astype(float) ** 2).sum()), abs=2e-9)


def test_scores_of_all_pairs_against_the_kernels(spark, sf_dir):
    """The query gives each pair once; values are compared on planes whose peaks don't tie, more bodies than a block holds."""
    import numpy as np

    from luxtrace.operators.raster import frames
    from luxtrace.operators.raster import kernels as K

    df = workload.QUERIES["pce_scores"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    pairs = [(r["image_id"], r["body_id"]) for r in df.collect()]
    assert len(pairs) == len(set(pairs)) == 2 * n
    bodies = {f"b{k}": {0: K.synthetic_sensor((32, 40), k), 1: K.synthetic_sensor((32, 40), 100 + k)} for k in range(2 * frames.BODIES + 3)}
    images = {f"i{k}": {c: K.synthetic_exposure(p, 7 + k) for c, p in bodies[f"b{k}"].items()} for k in range(5)}
    rows = lambda of: [(name, c, *p.shape, p.ravel().tolist()) for name, planes in of.items() for c, p in planes.items()]
    given = [spark.createDataFrame(rows(of), f"{key} string, plane int, h int, w int, data array<float>").repartition(3) for of, key in ((images, "image_id"), (bodies, "body_id"))]
    got = {(r["image_id"], r["body_id"]): r["pce"] for r in frames.score_planes(*given).collect()}
    assert got == {(i, b): pytest.approx(K.score(p, k), rel=1e-6) for i, p in images.items() for b, k in bodies.items()}


def test_scores_are_of_four_planes_with_a_fingerprint(spark, tmp_path):
    """Planes of equal rows left no fingerprint, and a single plane no sum of surfaces."""
    import numpy as np

    from luxtrace.operators.raster import kernels as K
    from luxtrace.plans import workload

    v = np.random.default_rng(5).normal(0, 0.125, (30, 64)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist(), i % 10) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    mosaics = [(np.outer(x.astype(float), x) * 0.5 + 0.5).astype(np.float32) for x in v]
    images = [{0: m[::2, ::2], 1: m[::2, 1::2], 2: m[1::2, 1::2], 3: m[1::2, ::2]} for m in mosaics]
    bodies = {}
    for b in (0, 1):
        own = images[b::2]
        bodies[str(b)] = {c: K.postprocess(sum(K.noise_residual(i[c]) * i[c].astype(float) for i in own) / sum(i[c].astype(float) ** 2 for i in own)) for c in range(4)}
    assert all(k.std() > 1e-4 for planes in bodies.values() for k in planes.values())
    got = {(int(r["image_id"]), r["body_id"]): r["pce"] for r in workload.pce_scores(spark, str(tmp_path)).collect()}
    assert got == {(i, b): pytest.approx(K.score(p, k), rel=1e-3, abs=1e-3) for i, p in enumerate(images) for b, k in bodies.items()}
