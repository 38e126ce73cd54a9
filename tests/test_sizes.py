"""What larger tables bring: late years, ids that meet twice, plans that must not grow faster than their input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from luxtrace.functions import labels
from luxtrace.operators import verdict


def test_years_beyond_9999(spark):
    got = spark.createDataFrame([(253402300799,), (253402300800,), (781000000000,)], "s long").select(labels.iso_time("s").alias("t"), labels.iso_date("s").alias("d")).collect()
    assert [(r["t"], r["d"]) for r in got] == [("9999-12-31T23:59:59.000Z", "9999-12-31"), ("10000-01-01T00:00:00.000Z", "10000-01-01"), ("26718-11-27T20:26:40.000Z", "26718-11-27")]


def test_competing_of_an_image_with_two_records(spark):
    """The counts of a probe's verdicts are added up, as in SQL: one row for each probe."""
    probes = spark.createDataFrame([(1, 7, 0, True), (2, 8, 0, True)], "probe_id long, image_id long, probe_hash long, chain_ok boolean")
    index = spark.createDataFrame([(7, 0), (8, 1), (9, 3)], "image_id long, image_hash64 long")
    records = spark.createDataFrame([(7, "a", 50), (7, "a", 50), (8, "b", 10), (9, "c", 90)], "image_id long, body_id string, registered_at long")
    got = {r["probe_id"]: tuple(r)[1:] for r in verdict.split_competing(verdict.verdicts(probes, index, records)).collect()}
    assert got == {1: (2, 2, 8), 2: (0, 3, None)}


def test_record_numbers_of_large_keys(spark, tmp_path):
    """Equal to the query's SQL where years have five digits and where a double no longer holds every second."""
    import duckdb

    from luxtrace.plans import workload

    spark.createDataFrame([(k, 100.0 + k % 7) for k in (1, 2932930, 2932931, 6672079, 6672080, 8999999)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(workload.ORACLES["record_numbers"]).fetchall()
    assert sorted(map(tuple, workload.record_numbers(spark, str(tmp_path)).collect())) == sorted(want)


def test_stream_state_stays_in_the_jvm(spark):
    """The keyed state is an aggregate of Spark's own: no Python for each entity."""
    from luxtrace.schema import EVENTS
    from luxtrace.streaming.fold import keyed_updates

    plan = keyed_updates(spark.createDataFrame([], EVENTS))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Python" not in plan and "Pandas" not in plan


def test_split_flips_ask_few_values_and_lose_no_pair(spark):
    from luxtrace.operators import similarity

    r = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [r.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 7, 9, 10, 10, 10, 11)] + [b ^ (m << at) for b in base for at in (0, 20, 40, 54) for m in (7, 0x3FF)]
    probes = spark.createDataFrame([(i, signed(b)) for i, b in enumerate(base)], "probe_id long, probe_hash long")
    index = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(near)], "image_id long, image_hash64 long")
    want = sorted((i, k, bin(b ^ x).count("1")) for i, b in enumerate(base) for k, x in enumerate(near) if bin(b ^ x).count("1") <= 10)
    for plan in (similarity.WIDE, similarity.MIDDLE):
        assert sorted(map(tuple, similarity.near_by_wide_bands(probes, index, plan=plan).collect())) == want
        pairs = similarity._wide_pairs(probes, index, plan)
        allowed = sum(bin((b ^ x) >> at & (1 << n) - 1).count("1") <= (other if bin(b ^ x).count("1") % 2 else same) for b in base for x in near for at, n, same, other in plan)
        assert pairs.count() == allowed
    assert sum(sum(math.comb(n, k) for k in range(most)) for _, n, same, other in similarity.WIDE for most in (same, other)) == 871
    masks = similarity._masks(23, 2)
    assert spark.range(1).select(F.size(masks)).first()[0] == 277  # of the first band, 2,048 before


def test_flipped_values_are_never_broadcast(spark):
    """An id and its hash are small, the hundreds of values they become are not, which Spark's sizes don't tell."""
    from luxtrace.operators import similarity

    probes = spark.range(50).selectExpr("id AS probe_id", "xxhash64(id) AS probe_hash")
    index = spark.range(50).selectExpr("id AS image_id", "xxhash64(id) AS image_hash64")
    found = [similarity.near_by_wide_bands(probes, index, plan=plan) for plan in (similarity.WIDE, similarity.MIDDLE)]
    for df in (*found, similarity.near_by_bands(probes, index), similarity._wide_pairs(probes, index)):
        assert df.count() >= 50
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_confirmed_matches_are_never_broadcast(spark):
    """Neither the registry's records nor the probes: written hashes are smaller than their rows."""
    probes = spark.range(50).selectExpr("id AS probe_id", "id AS image_id", "id AS probe_hash")
    records = spark.range(50).selectExpr("id AS image_id", "'a' AS body_id", "id AS registered_at", "id AS image_hash64")
    found = verdict.confirmed(probes, records.select("image_id", "image_hash64"), records)
    assert found.count() == 500 and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_picture_log_is_written_once(spark, sf_dir):
    from luxtrace.plans import workload

    log = workload._picture_log(spark, sf_dir, workload._picture_files(spark, sf_dir))
    assert log.count() > 6 and "MapIn" not in log._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ragged", [False, True])
def test_consistency_equals_that_of_all_pairs(spark, ragged):
    from luxtrace.operators import statistics

    r = np.random.default_rng(2)
    rows = lambda kind: [(f"{kind}{i}", i % 3, k, None if r.random() < 0.05 else float(r.normal()) * (i != 4)) for i in range(12) for k in range(8) if not ragged or (i + k) % 5]
    p, q = rows("p"), rows("r")
    got = {x["probe_id"]: x["consistency"] for x in statistics.body_consistency(spark.createDataFrame(p, "probe_id string, body_id int, pos int, v double"), spark.createDataFrame(q, "ref_id string, body_id int, pos int, v double")).collect()}
    vectors = lambda rows: {i: {k: v or 0.0 for j, _, k, v in rows if j == i} for i in {x[0] for x in rows}}
    body, a, b = {x[0]: x[1] for x in p + q}, vectors(p), vectors(q)
    for i, x in a.items():
        found = []
        for j, y in b.items():
            at = x.keys() & y.keys()
            if body[i] == body[j] and at:
                size = (sum(x[k] ** 2 for k in at) * sum(y[k] ** 2 for k in at)) ** 0.5
                found.append(sum(x[k] * y[k] for k in at) / size if size else 0.0)
        assert got.pop(i) == pytest.approx(sum(found) / len(found), abs=1e-12)
    assert not got


def test_tiles_of_a_small_image_are_measured_once(monkeypatch):
    from luxtrace.operators.raster import kernels as K

    made = []
    monkeypatch.setattr(K.np, "var", lambda x, f=np.var: made.append(1) or f(x))
    grey = np.random.default_rng(1).integers(0, 256, (31, 31))
    assert K.detail(grey) > 0 and len(made) == 1


def test_samples_of_bytes(spark):
    from luxtrace.operators.raster import frames

    got = frames.samples(spark.createDataFrame([("a", bytearray([0, 7, 255])), ("b", None)], "k string, p binary"), "p", "data").collect()
    assert [(r["k"], r["data"]) for r in got] == [("a", [0.0, 7.0, 255.0]), ("b", None)]
