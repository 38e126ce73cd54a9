"""Call replay and event fold against plain sequential programs."""

import random

import pytest

from luxtrace.operators import event_fold, registry
from luxtrace.operators.lineage import connected_parts
from luxtrace.operators.registry import CALLS, ZERO_ADDRESS, body_calls, replay, with_epochs
from luxtrace.schema import CID_PREFIX, EVENTS, ZERO_WORD

ADMIN = "0x" + "ad" * 20


def sequential(calls):
    """The registry as one loop over calls."""
    epoch, owner, revoked, images, sessions, out = 0, {}, set(), set(), set(), {}
    for c in calls:
        f, body, sender, error = c["function"], (epoch, c["body_id"]), c["sender"].lower(), None
        if f == "registerBody":
            error = "empty commitment" if c["commitment"] in (None, ZERO_WORD) else "bodyId must derive from commitment" if c["derived_id"] != c["body_id"] else "body already registered" if body in owner else None
            if not error:
                owner[body] = sender
        elif f in ("revokeBody", "transferBody"):
            last = "already revoked" if f == "revokeBody" else "body revoked"
            error = "unknown body" if body not in owner else "not the body owner" if owner[body] != sender else last if body in revoked else None
            if not error and f == "transferBody":
                error = "zero owner" if (c["to_address"] or ZERO_ADDRESS) == ZERO_ADDRESS else None
                if not error:
                    owner[body] = c["to_address"].lower()
            elif not error:
                revoked.add(body)
        elif f == "registerImage":
            image, parent = (epoch, c["image_hash"]), c["parent_hash"]
            error = (
                "unknown body" if body not in owner else "body revoked" if body in revoked else "not the body owner" if owner[body] != sender else "empty image hash" if c["image_hash"] in (None, ZERO_WORD)
                else "image already registered" if image in images else "modification level out of range" if not 0 <= c["level"] <= 2
                else "unknown parent image" if parent not in (None, ZERO_WORD) and (epoch, parent) not in images else None
            )
            if not error:
                images.add(image)
        elif f == "commitSession":
            s = (epoch, c["session_id"])
            error = "empty root" if c["merkle_root"] in (None, ZERO_WORD) else "empty session" if c["session_id"] in (None, ZERO_WORD) else "session already committed" if s in sessions else None
            if not error:
                sessions.add(s)
        elif f in ("attest", "challenge"):
            error = "empty subject" if c["subject"] in (None, ZERO_WORD) else None
        elif f == "resetAll":
            error = None if sender == ADMIN else "not the admin"
            epoch += error is None
        out[c["call_id"]] = error
    return out


def random_calls(n, seed):
    r = random.Random(seed)
    word = lambda k: "0x" + f"{k:064x}"
    who = lambda: "0x" + f"{r.randint(1, 3):040x}"
    out = []
    for i in range(n):
        c = dict.fromkeys(f.name for f in CALLS)
        f = r.choices(["registerBody", "revokeBody", "transferBody", "registerImage", "commitSession", "attest", "commit", "resetAll"], [6, 1, 4, 40, 3, 1, 1, 0.4])[0]
        body = word(r.randint(1, 4))
        c |= {"call_id": i, "function": f, "sender": who(), "body_id": body, "commitment": r.choice([body, body, body, ZERO_WORD, None]), "derived_id": r.choice([body] * 6 + [word(9)]), "to_address": r.choice([who(), who(), ZERO_ADDRESS]), "image_hash": r.choice([word(r.randint(1, 25)), ZERO_WORD] + [word(r.randint(1, 25))] * 8)}
        c |= {"parent_hash": r.choice([None, None, ZERO_WORD, word(r.randint(1, 25)), word(r.randint(1, 25))]), "level": r.choice([0, 1, 2, 2, 3]), "session_id": r.choice([word(r.randint(0, 3)), None]), "merkle_root": word(r.randint(0, 3)), "subject": word(r.randint(0, 2)), "block_timestamp": i, "pce": 1}
        c["sender"] = ADMIN if f == "resetAll" and r.random() < 0.8 else c["sender"]
        out.append(c)
    return out


def test_replay_is_sequential(spark):
    for seed in (1, 2):
        calls = random_calls(700, seed)
        df = spark.createDataFrame([tuple(c[f.name] for f in CALLS) for c in calls], CALLS).repartition(5)
        got = {r["call_id"]: r["error"] for r in replay(df, admin=ADMIN).collect()}
        want = sequential(calls)
        assert got == want
        assert len(set(want.values())) > 12


def as_table(spark, calls, parts=5):
    return spark.createDataFrame([tuple(c[f.name] for f in CALLS) for c in calls], CALLS).repartition(parts)


def test_one_body_with_all_calls_is_shared_out(spark):
    """Owners take turns, strangers call as well, most of the body's ranges begin in the middle of it."""
    r = random.Random(5)
    body, who = "0x" + "b" * 64, [f"0x{k:040x}" for k in range(1, 7)]
    calls, owner = [], None
    for i in range(3000):
        f = "registerBody" if owner is None or r.random() < 0.02 else "revokeBody" if i == 2800 or r.random() < 0.0005 else "transferBody"
        sender = owner if owner and r.random() < 0.6 else r.choice(who)
        to = r.choice([*who, ZERO_ADDRESS])
        owner = sender if owner is None and i > 20 else to if f == "transferBody" and sender == owner and to != ZERO_ADDRESS else owner
        calls.append(dict.fromkeys(c.name for c in CALLS) | {"call_id": i, "function": f, "sender": sender, "body_id": body, "commitment": body if i > 20 else None, "derived_id": body, "to_address": to})
    for k in range(3):
        calls.append(dict.fromkeys(c.name for c in CALLS) | {"call_id": 5000 + k, "function": "registerBody", "sender": who[0], "body_id": f"0x{k}", "commitment": "x", "derived_id": f"0x{k}"})
    timed = with_epochs(as_table(spark, calls), admin=ADMIN)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folded = body_calls(timed)
        got = {x["call_id"]: x["error"] for x in folded.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sequential(calls)
    assert got == want and len(set(want.values())) >= 5


def test_maps_of_runs_compose():
    """What a run does, from every beginning, is what its calls do one by one."""
    r = random.Random(6)
    for _ in range(300):
        who = [f"s{k}" for k in range(4)]
        calls = [(r.choice(["registerBody", "revokeBody", "transferBody", "transferBody", "transferBody"]), r.choice(who), r.choice([*who, ZERO_ADDRESS]), r.random() < 0.2, r.random() < 0.9) for _ in range(r.randint(0, 12))]
        run = registry._Run()
        for c in calls:
            run.call(*c)
        named = dict(run.mapping())
        for begin in ["", *("o" + s for s in [*who, "other"]), "rs0"]:
            state = begin
            for c in calls:
                state, _ = registry._step(state, *c)
            assert named.get(begin, begin) == state


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_chain_of_a_thousand_edits(spark, most, monkeypatch):
    """By passes in few jobs; a short chain also by rounds."""
    n = 1000 if most > 3 else 12
    body, who = "0x" + "b" * 64, "0x" + "1" * 40
    good = [(0, f"h{k}", f"h{k - 1}" if k else None, 10 + k) for k in range(n)] + [(0, "h5", "h0", 7), (0, "late", "h9", 12), (0, "late", "h9", 50), (0, "alone", None, 3), (1, "h1", "h0", 4), (0, "twice", "never", 60), (0, "h6", "h6", 1)]
    df = spark.createDataFrame(good, "epoch long, h string, parent string, call_id long")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = {(x["epoch"], x["h"]): x["at"] for x in registry.first_acceptable(df, most).collect()}
    jobs = len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before))
    assert got == {(0, f"h{k}"): 10 + k for k in range(n)} | {(0, "late"): 50, (0, "alone"): 3}
    assert most == 3 or jobs < 150
    assert registry.first_acceptable(df.limit(0)).count() == 0


def test_connected_parts(spark):
    r = random.Random(7)
    edges = [(f"n{r.randint(0, 150):03d}", f"n{r.randint(0, 150):03d}") for _ in range(120)] + [("star", f"n{k:03d}") for k in range(40)] + [("self", "self"), (None, "n000")]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {x["node"]: x["part"] for x in connected_parts(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: root(x) for x in list(up)}


def event(block, kind, **values):
    return {f.name: None for f in EVENTS} | {"block_number": block, "log_index": 0, "tx_hash": "0x" + f"{block:064x}", "block_timestamp": 100 + block, "kind": kind} | values


def fold(spark, events):
    return event_fold.with_epoch(event_fold.positioned(spark.createDataFrame([tuple(e[f.name] for f in EVENTS) for e in events], EVENTS)))


def test_resets_transfers_and_parents(spark):
    e = [
        event(1, "BodyTransferred", body_id="b", to_address="x"), event(2, "BodyRegistered", body_id="b", owner="a", body_commitment=ZERO_WORD), event(3, "ImageRegistered", body_id="b", image_hash="child", parent_hash="parent"),
        event(4, "ImageRegistered", body_id="b", image_hash="parent"), event(5, "Commit", asset_cid=CID_PREFIX + "ab" * 32), event(6, "RegistryReset"), event(7, "BodyRevoked", body_id="b"),
        event(8, "BodyRegistered", body_id="b", owner="c", body_commitment="0x" + "1" * 64), event(9, "BodyTransferred", body_id="b", to_address="d"), event(10, "BodyRevoked", body_id="b"), event(11, "ImageRegistered", body_id="b", image_hash="parent"),
        event(12, "ImageRegistered", body_id="b", image_hash="child", parent_hash="parent"), event(13, "Commit", asset_cid=CID_PREFIX + "short"),
    ]
    f = fold(spark, e).cache()
    b = {r["epoch"]: r for r in event_fold.bodies(f).collect()}
    assert (b[0]["owner"], b[0]["revoked"], b[0]["body_commitment"]) == ("a", False, None)
    assert (b[1]["owner"], b[1]["first_owner"], b[1]["revoked"], b[1]["registered_at"]) == ("d", "c", True, 108)
    assert [r["epoch"] for r in event_fold.bodies_current(f).collect()] == [1]
    parents = {(r["epoch"], r["image_hash"]): r["parent"] for r in event_fold.images(f).collect()}
    assert parents == {(0, "child"): None, (0, "parent"): None, (1, "parent"): None, (1, "child"): "parent"}
    commits = [(r["commit_index"], r["epoch"], r["image"]) for r in event_fold.commits(f).orderBy("pos").collect()]
    assert commits == [(0, 0, "0x" + "ab" * 32), (1, 1, None)]
    state = event_fold.current_epoch(f).first()
    assert (state["epoch"], state["resettable"]) == (1, True)
    then = {r["image_hash"]: (r["owner_then"], r["revoked_then"]) for r in event_fold.owner_as_of(f, event_fold.images_current(f)).collect()}
    assert then == {"parent": ("d", True), "child": ("d", True)}


def test_nothing_counts_before_the_first_registration(spark):
    e = [
        event(1, "BodyTransferred", body_id="b", to_address="x"), event(2, "BodyRevoked", body_id="b"), event(3, "BodyRegistered", body_id="b", owner="a"), event(4, "ImageRegistered", body_id="b", image_hash="i"),
        event(5, "ImageRegistered", body_id="c", image_hash="j"), event(6, "BodyRegistered", body_id="c", owner="d"), event(7, "BodyRevoked", body_id="b"), event(8, "ImageRegistered", body_id="b", image_hash="k"),
    ]
    f = fold(spark, e)
    then = {r["image_hash"]: (r["owner_then"], r["revoked_then"]) for r in event_fold.owner_as_of(f, event_fold.images_current(f)).collect()}
    assert then == {"i": ("a", False), "j": (None, False), "k": ("a", True)}


def test_empty_log(spark):
    f = fold(spark, [])
    assert event_fold.bodies_current(f).count() == event_fold.images_current(f).count() == event_fold.commits(f).count() == 0
