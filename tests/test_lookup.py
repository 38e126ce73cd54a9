"""Lookups, the read API, sessions, signatures and the evaluation of scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_registry import event, fold

from luxtrace.functions import signing
from luxtrace.functions.keccak import verify_proof
from luxtrace.operators import lookup, sessions
from luxtrace.operators.event_fold import bodies_current, images_current
from luxtrace.operators.raster import evaluation, triangle
from luxtrace.operators.raster import kernels as K
from luxtrace.schema import CID_PREFIX

H = lambda k: "0x" + f"{k:064x}"
OWNER = "0x" + "a" * 40


@pytest.fixture(scope="module")
def log(spark):
    e = [
        event(1, "BodyRegistered", body_id=H(1), owner=OWNER, body_commitment=H(77)), event(2, "ImageRegistered", body_id=H(1), image_hash=H(10), perceptual_hash=H(5), level=0, pce=150),
        event(2, "Commit", asset_cid=CID_PREFIX + H(10)[2:]) | {"log_index": 1, "tx_hash": "0x" + f"{2:064x}"}, event(3, "ImageRegistered", body_id=H(1), image_hash=H(11), parent_hash=H(10), perceptual_hash=H(5), level=1, pce=120), event(4, "BodyTransferred", body_id=H(1), to_address="0x" + "b" * 40),
    ]
    return fold(spark, e).cache()


def test_points(spark, log):
    images, bodies = images_current(log), bodies_current(log)
    assert lookup.image(images, H(10).upper().replace("0X", "0x")).count() == 1
    assert [r["image_hash"] for r in lookup.images_like(images, H(5)).collect()] == [H(10), H(11)]
    assert lookup.body(bodies, H(1)).count() == lookup.body(bodies, H(77)).count() == 1 and lookup.body(bodies, H(3)).count() == 0
    assert [x["image_hash"] for x in lookup.bodies_of(bodies, images, "0x" + "B" * 40).first()["images"]] == [H(10), H(11)]
    with pytest.raises(ValueError):
        lookup.bodies_of(bodies, images, "someone")
    assert lookup.lineage(images, H(10)).first()["children"] == [H(11)] and lookup.lineage(images, H(11)).first()["parent"] == H(10)
    s = lookup.status(log).first()
    assert (s["epoch"], s["resettable"], s["indexed_block"], s["n_bodies"], s["n_images"]) == (0, False, 4, 1, 2)
    claims = spark.createDataFrame([(H(10), "0x" + f"{2:064x}"), (H(10), "0xdead")], "image_hash string, tx_hash string")
    assert sorted(r["confirmed"] for r in lookup.registration_transactions(log, claims).collect()) == [False, True]


def test_more_than_a_thousand_images(spark):
    e = [event(1, "BodyRegistered", body_id=H(1), owner=OWNER)] + [event(2 + k, "ImageRegistered", body_id=H(1), image_hash=H(5000 - k), level=0, pce=150) for k in range(1001)]
    f = fold(spark, e)
    bodies, images = bodies_current(f), images_current(f)
    all_of_them = lookup.bodies_of(bodies, images, OWNER).first()
    assert all_of_them["n_images"] == 1001 and [x["image_hash"] for x in all_of_them["images"]] == [H(5000 - k) for k in range(1001)]
    some = lookup.with_images(bodies, images, 3).first()
    assert some["n_images"] == 1001 and [x["image_hash"] for x in some["images"]] == [H(5000), H(4999), H(4998)]


def test_read_api(spark, log):
    asked = spark.createDataFrame([(H(10),), (H(11),), (H(99),), ("0xABC",), (None,)], "image_hash string")
    got = {r["image_hash"]: r for r in lookup.record_view(log, asked, chain_id=1, registry="0xr", page="https://p", page_chain=1, page_registry="0xR").collect()}
    assert {k: r["status"] for k, r in got.items()} == {H(10): 200, H(11): 200, H(99): 404, "0xABC": 400, None: 400}
    r = got[H(10)]
    assert (r["owner"], r["level"], r["tx_hash"], r["cacheable"], r["verify_url"]) == (OWNER, "unedited raw", "0x" + f"{2:064x}", True, f"https://p?hash={H(10)}")


def test_sessions(spark):
    frames = [("s", i, bytes([i]) * 32, p, b) for i, (p, b) in enumerate([(150.0, True), (99.6, True), (99.4, True), (200.0, False), (None, True), (300.0, True)])]
    df = spark.createDataFrame(frames, "session string, frame_id long, image_hash binary, pce double, body_registered boolean")
    known = spark.createDataFrame([(bytes([5]) * 32,)], "image_hash binary")
    judged = sessions.judged(df, known).cache()
    assert {r["frame_id"]: r["refused"] for r in judged.collect()} == {0: None, 1: None, 2: "score below the threshold", 3: "camera is not registered", 4: "no score", 5: "already registered"}
    root = sessions.roots(judged).first()
    assert root["frame_count"] == 2
    assert all(verify_proof(bytes(r["image_hash"]), [bytes(p) for p in r["proof"]], bytes(root["merkle_root"])) for r in sessions.proofs(judged).collect())


def test_signatures(spark):
    one = (1).to_bytes(32, "big")
    assert signing.address_of(one) == "0x7E5F4552091A69125d5DfCb7b8C2659029395Bdf"
    s = signing.sign(b"record", one)
    assert s == signing.sign(b"record", one) and signing.recover(b"record", s) == signing.address_of(one) and signing.recover(b"other", s) != signing.address_of(one)
    df = spark.createDataFrame([(b"record", s), (b"record", None), (b"record", b"short")], "message binary, signature binary").coalesce(1)
    assert [r["signer"] for r in signing.with_signer(df).collect()] == [signing.address_of(one), None, None]


def test_evaluation(spark):
    k = {c: K.synthetic_sensor((64, 64), c) for c in range(4)}
    carrier = {c: K.synthetic_exposure(np.zeros((64, 64), np.float32), 50 + c) for c in range(4)}
    score = lambda a: K.score(evaluation.inject_planes(carrier, k, a), k)
    alpha = evaluation.minimum_alpha(score, target=100.0, tolerance=0.02)
    assert score(0.0) < 60 and 0 < alpha < 4 and score(alpha) >= 100
    assert evaluation.minimum_alpha(lambda a: 0.0, target=1.0) is None
    whole = float(np.corrcoef(k[0].ravel(), evaluation.degrade(k[0], bits=3).ravel())[0, 1])
    part = float(np.corrcoef(k[0].ravel(), evaluation.degrade(k[0], downsample=4).ravel())[0, 1])
    assert 0.9 < whole < 1 and part < 0.5
    field = evaluation.mosaic_field(k, [[0, 1], [3, 2]], (128, 128))
    assert np.array_equal(field[1::2, 1::2], k[2])
    r = np.random.default_rng(3)
    i, w = r.uniform(0.2, 0.8, (2, 9, 8)), r.normal(size=(2, 9, 8))
    kk = r.normal(size=(9, 8))
    rows = [(f, y, x, float(i[f, y, x]), float(w[f, y, x]), float(kk[y, x])) for f in (0, 1) for y in range(9) for x in range(8)]
    pairs = spark.createDataFrame([(0, 1)], "a int, b int")
    got = evaluation.triangle_pairs(spark.createDataFrame(rows, "frame_id int, row int, col int, i double, w double, k double"), pairs, 4).first()
    cut = lambda a: [a[y : y + 4, x : x + 4].ravel() for y in (0, 4) for x in (0, 4)]
    corr = lambda a, b: float(np.corrcoef(a.ravel(), b.ravel())[0, 1])
    att = [[np.linalg.norm(v) / (np.sqrt((u**2).mean()) * np.linalg.norm(q)) * corr(v, u * q) for u, v, q in zip(cut(i[f]), cut(w[f]), cut(kk), strict=True)] for f in (0, 1)]
    top = sum(p * q * (u * v).mean() for p, q, u, v in zip(*att, cut(i[0]), cut(i[1]), strict=True))
    bottom = np.prod([sum(p * u.mean() for p, u in zip(att[f], cut(i[f]), strict=True)) for f in (0, 1)])
    assert got["observed"] == pytest.approx(corr(w[0], w[1])) and got["predicted"] == pytest.approx(corr(w[0], kk) * corr(w[1], kk) * top * 4 / bottom)
    planes = spark.createDataFrame([(f, 9, 8, i[f].ravel().tolist(), w[f].ravel().tolist(), kk.ravel().tolist()) for f in (0, 1)], "frame_id int, h int, w int, light array<double>, noise array<double>, k array<double>")
    by_blocks = triangle.pair_correlations(triangle.frame_blocks(planes, 4), pairs).first()
    assert by_blocks["observed"] == pytest.approx(got["observed"]) and by_blocks["predicted"] == pytest.approx(got["predicted"])
    alone = triangle.triangle_test(planes, pairs.withColumn("innocent", F.lit(False)), 4).first()
    assert alone["d"] == 0 and alone["pearson"] is None
    assert evaluation.synthetic_carrier((20, 30)).shape == (20, 30, 3)
    assert len(np.unique(evaluation.degrade(k[0], bits=1))) == 2 and np.count_nonzero(evaluation.degrade(k[0], crop=0.5)) <= 32 * 32
