"""Similarity, verdicts, catalogue, statistics, streams and readers on small tables."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from luxtrace.operators import catalogue, lineage, ordered, similarity, statistics, verdict
from luxtrace.schema import CATALOGUE
from luxtrace.sources import rasters

SIGNED = lambda x: x - (1 << 64) if x >> 63 else x


def test_bands_find_what_a_scan_finds(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    near = []
    for b in base:
        for n in (0, 1, 5, 10, 11):
            x = b
            for bit in r.sample(range(64), n):
                x ^= 1 << bit
            near.append(x)
    probes = spark.createDataFrame([(i, SIGNED(b)) for i, b in enumerate(base)] + [(999, None)], "probe_id long, probe_hash long")
    index = spark.createDataFrame([(i, SIGNED(x)) for i, x in enumerate(near)] + [(10_000, None)], "image_id long, image_hash64 long")
    a, b = (sorted(map(tuple, f(probes, index).collect())) for f in (similarity.near_by_bands, similarity.near_by_scan))
    want = sorted((i, j, (x ^ y).bit_count()) for i, x in enumerate(base) for j, y in enumerate(near) if (x ^ y).bit_count() <= 10)
    assert a == b == want
    assert sorted(map(tuple, similarity.near_by_wide_bands(probes, index).collect())) == want
    assert similarity.near_by_bands(probes.limit(0), index).count() == similarity.near_by_wide_bands(probes, index.limit(0)).count() == 0


def test_wide_bands_compare_few(spark):
    """Random hashes: less than a thousandth of all pairs."""
    from pyspark.sql import functions as F

    probes = spark.range(100).select(F.col("id").alias("probe_id"), F.xxhash64("id").alias("probe_hash"))
    index = spark.range(60_000).select(F.col("id").alias("image_id"), F.xxhash64(F.lit("x"), "id").alias("image_hash64"))
    n = similarity.compared(probes, index).first()
    assert n["possible"] == 6_000_000 and n["compared"] < n["possible"] / 1000
    with pytest.raises(ValueError):
        similarity.near_by_scan(probes, index)


def test_range_by_halving(spark):
    cuts = sorted({float(random.Random(2).randint(-1000, 1000)) for _ in range(77)} | {-5.5, 2.0**53, 1e-300})
    df = spark.range(-1200, 1200).select(F.col("id").alias("p"), ordered._range_of(F.col("id"), cuts).alias("r"))
    assert all(x["r"] == sum(c <= x["p"] for c in cuts) for x in df.collect())


def test_verdict_order(spark):
    h = 0b1111 << 40
    probes = spark.createDataFrame([(1, 100, h, True), (2, 200, h, True), (3, 300, ~h, True), (4, 400, ~h, True), (5, 100, h, False)], "probe_id long, image_id long, probe_hash long, chain_ok boolean")
    index = spark.createDataFrame([(100, h), (101, h ^ 1), (102, h ^ 3), (103, h)], "image_id long, image_hash64 long")
    records = spark.createDataFrame([(100, "b", 50), (101, "b", 40), (102, "c", 40)], "image_id long, body_id string, registered_at long")
    scores = spark.createDataFrame([(3, 0, "x", 100.0), (3, 1, "y", 100.0), (4, 0, "x", 99.9)], "probe_id long, enrolled int, body_id string, pce double")
    got = {r["probe_id"]: r for r in verdict.verdicts(probes, index, records, scores).collect()}
    assert [got[k]["verdict"] for k in range(1, 6)] == ["registered", "derived", "fingerprint-only", "no-record", "withheld"]
    assert got[2]["reported"] == 101 and got[2]["distance"] == 1  # the earliest; the nearer one at a tie
    assert {c["image_id"]: c["earlier"] for c in got[1]["competing"]} == {101: True, 102: True}
    assert got[3]["best_body"] == "x" and got[5]["reported"] is None


def row(**values):
    return tuple(values.get(f.name) for f in CATALOGUE)


def test_catalogue_merges(spark):
    old = spark.createDataFrame([row(image_hash="a", body_id="B1", pce=1.0, file_name="a.cr3", description="kept", block_number=5), row(image_hash="b", body_id="b1", pce=2.0, block_number=None), row(image_hash="c", body_id="b2", description="")], CATALOGUE)
    new = spark.createDataFrame([row(image_hash="a", pce=9.0, file_name="late", tx_hash="t", noted_at=2), row(image_hash="a", file_name="early", noted_at=1), row(image_hash="d", pce=4.0, noted_at=1)], CATALOGUE)
    got = {r["image_hash"]: r for r in catalogue.upsert(old, new, "noted_at").collect()}
    assert (got["a"]["file_name"], got["a"]["pce"], got["a"]["tx_hash"], got["a"]["description"], got["d"]["pce"], len(got)) == ("late", 1.0, "t", "kept", 4.0, 4)
    bodies = spark.createDataFrame([("b1", "one")], "body_id string, body_name string")
    chain = spark.createDataFrame([("E", "0X1", "B1", 7, 70)], "image_hash string, perceptual_hash string, body_id string, pce long, registered_at long")
    left = {r["image_hash"]: r for r in catalogue.sync(old, bodies, chain, 4).collect()}
    assert set(left) == {"a", "c", "e"} and left["e"]["body_name"] == "one" and left["e"]["description"] == ""
    assert set(r["image_hash"] for r in catalogue.sync(old, bodies, chain, 5).collect()) == {"c", "e"}
    s = catalogue.statistics(old).first()
    assert (s["n_images"], s["n_described"]) == (3, 1)
    assert catalogue.statistics(old.limit(0)).first()["n_described"] is None
    captions = spark.createDataFrame([("a", "x"), ("zz", "y")], "image_hash string, description string")
    assert {r["image_hash"]: r["description"] for r in catalogue.describe(old, captions).collect()}["a"] == "x"
    assert {r["image_hash"]: r["found"] for r in catalogue.known(old, captions).collect()} == {"a": True, "zz": False}
    assert catalogue.clear(old)[1].first()[0] == 3
    names = spark.createDataFrame([("cam",), ("cam-2",), ("camera",), ("cam-4",), ("cam-03",), ("gap-2",), ("gap-1",)], "name string")
    assert catalogue.import_name(names, "gap") == "gap-3" and catalogue.import_name(names.limit(0), "cam") == "cam"
    assert catalogue.import_name(names, "cam") == "cam-3" and catalogue.import_name(names, "new") == "new"
    checks = spark.createDataFrame([("a", True), ("b", None)], "name string, go boolean")
    assert tuple(catalogue.ready(checks).first()) == (False, ["b"])


def test_running_sum(spark):
    r = random.Random(1)
    rows = [(p, r.randint(0, 3)) for p in r.sample(range(10**6), 500)]
    df = spark.createDataFrame(rows, "p long, v int").repartition(7)
    for inclusive in (True, False):
        got = {x["p"]: x["s"] for x in ordered.running_sum(df, "p", F.col("v"), "s", inclusive=inclusive, ranges=16).collect()}
        total, want = 0, {}
        for p, v in sorted(rows):
            want[p] = total + (v if inclusive else 0)
            total += v
        assert got == want
    assert ordered.running_sum(df.limit(0), "p", F.col("v"), "s").count() == 0


def test_roots(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node long")
    edges = spark.createDataFrame([(i, i - 1) for i in range(40) if i % 20], "node long, parent long")
    assert {(r["node"], r["root"], r["depth"]) for r in lineage.roots(nodes, edges).collect()} == {(i, i // 20 * 20, i % 20) for i in range(40)}


def test_likelihood_needs_samples(spark):
    many = spark.createDataFrame([(bool(i % 2), float(i % 37)) for i in range(200)], "genuine boolean, x double")
    values = spark.createDataFrame([(1, 5.0), (2, -36.0), (3, 100.0)], "value_id long, value double")
    for r in statistics.likelihood_ratio(many, values).collect():
        g, f = (sum(1 for i in range(200) if bool(i % 2) == w and i % 37 >= abs(r["value"])) for w in (True, False))
        assert r["ratio"] == pytest.approx(((g + 1) / 102) / ((f + 1) / 102))
    assert all(r["ratio"] is None for r in statistics.likelihood_ratio(many.limit(80), values).collect())


def test_chain_takes_few_rounds(spark):
    n = 200
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, n)], "node long, parent long")
    out = lineage.roots(nodes, edges)
    assert {(r["node"], r["root"], r["depth"]) for r in out.collect()} == {(i, 0, i) for i in range(n)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") < 15


@pytest.mark.parametrize("late", [False, True])
def test_stream_equals_batch(spark, tmp_path, sf_dir, late):
    """In order, and with files that come in another order than their blocks, resets among them; one file comes twice."""
    import os
    import shutil

    from luxtrace.operators import event_fold
    from luxtrace.sources.events import generated_log
    from luxtrace.streaming import fold

    log = generated_log(spark, sf_dir)
    source, cp = str(tmp_path / "log"), str(tmp_path / "cp")
    log.repartitionByRange(3, "block_number").write.parquet(source)
    files = sorted((tmp_path / "log").glob("*.parquet"))
    shutil.copy(files[1], tmp_path / "log" / "again.parquet")
    for k, f in enumerate(files):
        os.utime(f, (1_700_000_000 + (-k if late else k),) * 2)
    fold.stream_registry(spark, source, cp, files_per_batch=1).awaitTermination()
    fold.stream_records(spark, source, str(tmp_path / "records"), str(tmp_path / "cp2"), files_per_batch=1).awaitTermination()
    folded = event_fold.with_epoch(event_fold.positioned(log))
    plain = lambda df, like: sorted((tuple(map(str, r)) for r in df.select(like.columns).collect()))
    records = str(tmp_path / "records")
    pairs = (
        (fold.bodies_from_state(spark, cp), event_fold.bodies_current(folded)), (fold.images_from_state(spark, cp), event_fold.images_current(folded)), (fold.sessions_from_state(spark, cp), event_fold.sessions(event_fold.of_last_epoch(folded))),
        (fold.commits_from_stream(spark, cp, records), event_fold.commits(folded)), (fold.attestations_from_stream(spark, cp, records), event_fold.attestations(folded)), (fold.challenges_from_stream(spark, cp, records), event_fold.challenges(folded)),
    )
    for got, want in pairs:
        assert plain(got, want) == plain(want, want)
    assert fold.bodies_from_state(spark, str(tmp_path / "none")).count() == 0


def test_reset_that_comes_late(spark, tmp_path):
    """An image and a session are registered at 40 and 60, a body at 41 and 61; the reset at 50 comes after all of them. A batch touches the entities it names."""
    from test_registry import event

    from luxtrace.schema import EVENTS
    from luxtrace.streaming import fold

    def put(name, events):
        spark.createDataFrame([tuple(e[f.name] for f in EVENTS) for e in events], EVENTS).coalesce(1).write.parquet(str(tmp_path / name))
        (file,) = (tmp_path / name).glob("*.parquet")
        (tmp_path / "log").mkdir(exist_ok=True)
        file.rename(tmp_path / "log" / f"{name}.parquet")

    def follow():
        counted = []
        fold.stream_registry(spark, str(tmp_path / "log"), str(tmp_path / "cp"), touched=lambda batch, n: counted.append(batch.count())).awaitTermination()
        return counted

    many = [event(k, "ImageRegistered", image_hash=f"0x{k}", level=0, pce=k) for k in range(100, 160)]
    put("a", [event(40, "ImageRegistered", image_hash="0xa", level=0, pce=200), event(60, "ImageRegistered", image_hash="0xa", level=1, pce=300), event(42, "SessionCommitted", session_id="s", merkle_root="old", frame_count=1), event(62, "SessionCommitted", session_id="s", merkle_root="new", frame_count=2), *many])
    assert follow() == [62]
    put("b", [event(61, "BodyRegistered", body_id="b", owner="second"), event(41, "BodyRegistered", body_id="b", owner="first"), event(45, "BodyTransferred", body_id="b", to_address="third"), event(46, "BodyRevoked", body_id="b")])
    assert follow() == [1]
    before = fold.bodies_from_state(spark, str(tmp_path / "cp")).first()
    assert (before["owner"], before["first_owner"], before["revoked"]) == ("second", "first", True)
    put("c", [event(50, "RegistryReset")])
    assert follow() == [1]
    image = fold.images_from_state(spark, str(tmp_path / "cp")).where("image_hash = '0xa'").collect()
    assert [(r["level"], r["pce"]) for r in image] == [(1, 300)]
    body, session = fold.bodies_from_state(spark, str(tmp_path / "cp")).first(), fold.sessions_from_state(spark, str(tmp_path / "cp")).first()
    assert (body["owner"], body["first_owner"], body["revoked"]) == ("second", "second", False) and (session["merkle_root"], session["frame_count"]) == ("new", 2)
    put("d", [event(170, "RegistryReset")])
    follow()
    assert fold.images_from_state(spark, str(tmp_path / "cp")).count() == fold.bodies_from_state(spark, str(tmp_path / "cp")).count() == 0


def png(rgb):
    h, w = rgb.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"".join(b"\0" + rgb[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_readers(spark, tmp_path):
    rgb = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(png(rgb))
    (tmp_path / "img" / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0rest")
    (tmp_path / "img" / "c.CR3").write_bytes(b"raw")
    got = {r["image_id"].rsplit("/", 1)[1]: r for r in rasters.read_images(spark, str(tmp_path / "img")).collect()}
    assert np.array_equal(np.frombuffer(got["a.png"]["data"], np.uint8).reshape(5, 7, 3), rgb)
    assert got["b.jpg"]["error"] == "jpeg is not lossless" and got["c.CR3"]["error"] == "raw file"
    f = rasters.folder_listing(spark, str(tmp_path / "img")).first()
    assert (f["n_files"], f["n_raw"]) == (3, 1)
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "body.npz").write_bytes(rasters.fingerprint_bytes({1: np.ones((2, 3), np.float32)}, {"frames": 4}))
    k = rasters.read_fingerprints(spark, str(tmp_path / "k")).first()
    assert (k["body_id"], k["plane"], k["h"], k["w"], k["data"]) == ("body", 1, 2, 3, [1.0] * 6) and '"frames": 4' in k["meta"]
    before = rasters.change_signature(spark, str(tmp_path / "k")).first()["signature"]
    (tmp_path / "k" / "other.npz").write_bytes(b"x")
    assert rasters.change_signature(spark, str(tmp_path / "k")).first()["signature"] != before


def test_exif(spark):
    entries = [(271, b"Maker\0"), (305, b"Fw\0")]
    heap, rows = b"", b""
    for tag, value in entries:
        if len(value) > 4:
            rows += struct.pack("<HHII", tag, 2, len(value), 8 + 2 + 12 * len(entries) + 4 + len(heap))
            heap += value
        else:
            rows += struct.pack("<HHI4s", tag, 2, len(value), value)
    tiff = b"II*\0" + struct.pack("<IH", 8, len(entries)) + rows + struct.pack("<I", 0) + heap
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    df = spark.createDataFrame([(bytes(x),) for x in (tiff, jpeg, b"", b"\xff\xd8\xff", tiff[:20])] + [(None,)], "content binary")
    got = [(r["make"], r["software"]) for r in rasters.with_exif(df.coalesce(1)).collect()]
    assert got[:2] == [("Maker", "Fw")] * 2 and set(got[2:]) == {(None, None)}
