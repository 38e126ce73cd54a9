"""Driver queries on the generated tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from luxtrace.functions import hashing, labels, words
from luxtrace.operators import catalogue, event_fold, lookup, similarity, statistics, verdict
from luxtrace.schema import BODY_TAG, CID_PREFIX, PIXEL_TAG, RECORD_TAG, SESSION_TAG
from luxtrace.sources.events import generated_log, word

#: A registry's address in queries that make links.
REGISTRY = "0x" + "5" * 40

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_fold.with_epoch(event_fold.positioned(generated_log(spark, sf_dir)))


# --- the same log in SQL: one common prefix for the fold queries
_WORD = "'0x' || lpad(lower(printf('%x', {0})), {1}, '0')"
_W = lambda x, n=64: _WORD.format(f"({x})::bigint", n)
_IMG = lambda x: f"'0x' || sha256('image' || ({x})::bigint::varchar)"
EV = f"""
WITH raw AS (
  SELECT event_id, floor(epoch(ts))::bigint AS sec, user_id AS u, event_type AS t, value, regexp_extract(props, '([0-9]+)', 1)::int AS k FROM events
), kinds AS (
  SELECT *, CASE WHEN t = 'error' AND k = 99 THEN 'RegistryReset' WHEN t = 'error' AND k < 10 THEN 'BodyRevoked' WHEN t = 'error' AND k < 20 THEN 'Challenged'
    WHEN t = 'error' AND k < 30 THEN 'SessionCommitted' WHEN t = 'signup' THEN 'BodyRegistered' WHEN t = 'click' AND k < 20 THEN 'BodyTransferred' WHEN t = 'purchase' THEN 'ImageRegistered'
    WHEN t = 'click' OR (t = 'view' AND k < 50) THEN 'Commit' WHEN t = 'view' THEN 'Attested' END AS kind FROM raw
), ev AS (
  SELECT event_id, sec, u, k, value, kind, t, coalesce(sum((kind = 'RegistryReset')::int) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS epoch,
    {_W("u")} AS body_id, {_W("u", 40)} AS own, {_W("(u * 7 + k) % 150", 40)} AS dest, {_IMG("u * 100 + k")} AS image_hash,
    CASE WHEN k % 5 = 0 THEN {_IMG("u * 100 + (k + 37) % 100")} END AS parent_hash
  FROM kinds WHERE kind IS NOT NULL
), cur AS (SELECT count(*) FILTER (WHERE kind = 'RegistryReset') AS epoch FROM ev
), reg AS (
  SELECT epoch, body_id, min(event_id) AS reg_at FROM ev WHERE kind = 'BodyRegistered' GROUP BY ALL
), body AS (
  SELECT r.epoch, r.body_id, r.reg_at,
    arg_max(CASE WHEN e.kind = 'BodyRegistered' THEN e.own ELSE e.dest END, e.event_id) FILTER (WHERE e.kind IN ('BodyRegistered', 'BodyTransferred')) AS owner,
    arg_min(e.own, e.event_id) FILTER (WHERE e.kind = 'BodyRegistered') AS first_owner, min(e.sec) FILTER (WHERE e.event_id = r.reg_at) AS registered_at,
    coalesce(bool_or(e.kind = 'BodyRevoked'), false) AS revoked
  FROM reg r JOIN ev e ON e.epoch = r.epoch AND e.body_id = r.body_id AND e.event_id >= r.reg_at AND e.kind IN ('BodyRegistered', 'BodyTransferred', 'BodyRevoked') GROUP BY ALL
), first_image AS (
  SELECT * FROM ev WHERE kind = 'ImageRegistered' QUALIFY row_number() OVER (PARTITION BY epoch, image_hash ORDER BY event_id) = 1
), image AS (
  SELECT i.epoch, i.image_hash, i.body_id, i.event_id, i.sec AS registered_at, (i.k % 4)::int AS level, floor(i.value)::bigint AS pce, p.image_hash AS parent
  FROM first_image i LEFT JOIN first_image p ON p.epoch = i.epoch AND p.image_hash = i.parent_hash AND p.event_id < i.event_id
), com AS (
  SELECT event_id, sec, epoch, u, t, k, row_number() OVER (ORDER BY event_id) - 1 AS commit_index,
    CASE WHEN t IN ('view', 'purchase') THEN '{CID_PREFIX}' || substr(image_hash, 3) ELSE 'ipfs:' || k::varchar END AS asset_cid, CASE WHEN t IN ('view', 'purchase') THEN image_hash END AS image,
    '0x' || sha256(event_id::varchar) AS tx_hash
  FROM ev WHERE kind IN ('Commit', 'ImageRegistered')
), as_of AS (
  SELECT i.*, (SELECT arg_max(CASE WHEN e.kind = 'BodyRegistered' THEN e.own ELSE e.dest END, e.event_id) FROM ev e JOIN reg r ON r.epoch = e.epoch AND r.body_id = e.body_id
     WHERE e.epoch = i.epoch AND e.body_id = i.body_id AND e.kind IN ('BodyRegistered', 'BodyTransferred') AND e.event_id >= r.reg_at AND e.event_id < i.event_id) AS owner_then,
    EXISTS (SELECT 1 FROM ev e JOIN reg r ON r.epoch = e.epoch AND r.body_id = e.body_id WHERE e.epoch = i.epoch AND e.body_id = i.body_id AND e.kind = 'BodyRevoked' AND e.event_id >= r.reg_at AND e.event_id < i.event_id) AS revoked_then
  FROM image i
), early AS (SELECT image, arg_min(tx_hash, event_id) AS tx_hash, min(event_id) AS commit_event FROM com WHERE image IS NOT NULL GROUP BY image)
"""


# --- P1: the fold


@query(EV + "SELECT event_id AS block_number, kind, epoch FROM ev UNION ALL SELECT event_id, 'Commit', epoch FROM ev WHERE kind = 'ImageRegistered'")
def registry_epoch(spark, d):
    return folded(spark, d).select("block_number", "kind", "epoch")


@query(EV + "SELECT cur.epoch AS epoch, cur.epoch > 0 AS resettable, (SELECT count(*) FROM body b WHERE b.epoch = cur.epoch) AS n_bodies, (SELECT count(*) FROM image i WHERE i.epoch = cur.epoch) AS n_images FROM cur")
def registry_state(spark, d):
    f = folded(spark, d)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return event_fold.current_epoch(f).crossJoin(n(event_fold.bodies_current(f), "n_bodies")).crossJoin(n(event_fold.images_current(f), "n_images"))  # one row each


_BODY = "body_id, owner, first_owner, revoked, registered_at"


@query(EV + f"SELECT {_BODY} FROM body JOIN cur USING (epoch)")
def bodies_current(spark, d):
    return event_fold.bodies_current(folded(spark, d)).select(*_BODY.split(", "))


@query(EV + f"SELECT epoch, {_BODY} FROM body")
def bodies_all_epochs(spark, d):
    return event_fold.bodies(folded(spark, d)).select("epoch", *_BODY.split(", "))


@query(EV + f"SELECT {_BODY} FROM body JOIN cur USING (epoch)")
def streaming_fold(spark, d):
    """The same fold with the log arriving as a stream of files."""
    from luxtrace.streaming.fold import bodies_from_state

    return bodies_from_state(spark, f"{_streamed(spark, d)}/checkpoint").select(*_BODY.split(", "))


def _streamed(spark: SparkSession, d: str) -> str:
    """The folder of a stream that has followed the log in two batches of files; its state is in ``checkpoint``."""
    from luxtrace.shared import shared_dir
    from luxtrace.streaming.fold import stream_registry

    base = shared_dir(spark, "stream")
    half = max(2, -(-table(spark, d, "events").count() // 200_000))  # files of a batch
    generated_log(spark, d).repartitionByRange(2 * half, "block_number").write.parquet(f"{base}/log")
    stream_registry(spark, f"{base}/log", f"{base}/checkpoint", files_per_batch=half).awaitTermination()
    return base


_IMAGE = "image_hash, body_id, registered_at, level, pce, parent"


@query(EV + f"SELECT {_IMAGE} FROM image JOIN cur USING (epoch)")
def images_current(spark, d):
    return event_fold.images_current(folded(spark, d)).select(*_IMAGE.split(", "))


@query(EV + f"SELECT {_IMAGE} FROM image JOIN cur USING (epoch)")
def streaming_images(spark, d):
    from luxtrace.streaming.fold import images_from_state

    return images_from_state(spark, f"{_streamed(spark, d)}/checkpoint").select(*_IMAGE.split(", "))


@query(EV + f"SELECT epoch, {_W('k')} AS session_id, arg_min({_W('u + 1')}, event_id) AS merkle_root, arg_min(k::bigint, event_id) AS frame_count, arg_min(sec, event_id) AS committed_at FROM ev JOIN cur USING (epoch) WHERE kind = 'SessionCommitted' GROUP BY epoch, k")
def streaming_sessions(spark, d):
    from luxtrace.streaming.fold import sessions_from_state

    return sessions_from_state(spark, f"{_streamed(spark, d)}/checkpoint")


@query(EV + "SELECT event_id AS block_number, epoch, commit_index, asset_cid, image FROM com")
def streaming_commits(spark, d):
    """Commits that came as a stream, with epochs from the resets in the keyed state."""
    from luxtrace.streaming.fold import commits_from_stream, stream_records

    base = _streamed(spark, d)
    stream_records(spark, f"{base}/log", f"{base}/records", f"{base}/records-checkpoint", files_per_batch=64).awaitTermination()
    return commits_from_stream(spark, f"{base}/checkpoint", f"{base}/records").select("block_number", "epoch", "commit_index", "asset_cid", "image")


@query(EV + "SELECT b.owner, b.body_id, b.registered_at, count(i.image_hash) AS n_images, coalesce(string_agg(i.image_hash, ',' ORDER BY i.registered_at, i.image_hash), '') AS images FROM body b JOIN cur USING (epoch) LEFT JOIN image i ON i.epoch = b.epoch AND i.body_id = b.body_id GROUP BY ALL")
def bodies_by_owner(spark, d):
    f = folded(spark, d)
    out = lookup.with_images(event_fold.bodies_current(f), event_fold.images_current(f))
    return out.select("owner", "body_id", "registered_at", "n_images", F.coalesce(F.array_join(F.col("images.image_hash"), ","), F.lit("")).alias("images"))


@query(EV + "SELECT image_hash, body_id, owner_then, revoked_then FROM as_of JOIN cur USING (epoch)")
def owner_as_of(spark, d):
    f = folded(spark, d)
    return event_fold.owner_as_of(f, event_fold.images_current(f)).select("image_hash", "body_id", "owner_then", "revoked_then")


@query(EV + """SELECT a.image_hash, a.body_id, coalesce(a.owner_then, b.owner) AS owner, coalesce(b.revoked, false) AS body_revoked, a.registered_at, a.pce,
  CASE a.level WHEN 0 THEN 'unedited raw' WHEN 1 THEN 'adjusted' WHEN 2 THEN 'generative edit' ELSE a.level::varchar END AS level, a.parent,
  CASE WHEN t.commit_event = a.event_id THEN t.tx_hash END AS tx_hash, a.pce >= 100 AS passes
FROM as_of a JOIN cur USING (epoch) LEFT JOIN body b ON b.epoch = a.epoch AND b.body_id = a.body_id LEFT JOIN early t ON t.image = a.image_hash""")
def image_record(spark, d):
    """The public record of each registered image: owner at that time, level in words, and the transaction if the earliest
    commit of its content id is the registration's own."""
    f = folded(spark, d)
    out = lookup.record_view(f, event_fold.images_current(f).select("image_hash"), chain_id=8453, registry=REGISTRY)
    return out.select("image_hash", "body_id", "owner", F.coalesce("revoked", F.lit(False)).alias("body_revoked"), "registered_at", "pce", "level", "parent", "tx_hash", (F.col("pce") >= 100).alias("passes"))


@query(EV + "SELECT event_id AS block_number, epoch, commit_index, asset_cid, image FROM com")
def commit_index(spark, d):
    return event_fold.commits(folded(spark, d)).select("block_number", "epoch", "commit_index", "asset_cid", "image")


@query(EV + "SELECT epoch, asset_cid, count(*) AS n_commits, string_agg(commit_index::varchar, ',' ORDER BY commit_index) AS indices FROM com GROUP BY ALL")
def commits_per_cid(spark, d):
    return event_fold.commits_by_cid(event_fold.commits(folded(spark, d))).select("epoch", "asset_cid", "n_commits", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


@query(EV + "SELECT image, tx_hash, commit_event AS block_number FROM early")
def earliest_commit(spark, d):
    return event_fold.earliest_commits(folded(spark, d))


@query(EV + f"SELECT {_IMG('k % 20')} AS subject, epoch, count(*) AS n, min(sec) AS first_at, count(DISTINCT own) AS n_by FROM ev WHERE kind = 'Attested' GROUP BY ALL")
def attestations_by_subject(spark, d):
    return event_fold.attestations(folded(spark, d)).groupBy("subject", "epoch").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_at"), F.countDistinct("attester").alias("n_by"))


@query(EV + f"SELECT {_IMG('k % 20')} AS subject, count(*) AS n, max(sec) AS last_at FROM ev WHERE kind = 'Challenged' GROUP BY ALL")
def challenges_by_subject(spark, d):
    return event_fold.challenges(folded(spark, d)).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_at"))


@query(EV + f"SELECT epoch, {_W('k')} AS session_id, arg_min({_W('u + 1')}, event_id) AS merkle_root, arg_min(k::bigint, event_id) AS frame_count, arg_min(sec, event_id) AS committed_at FROM ev WHERE kind = 'SessionCommitted' GROUP BY epoch, k")
def sessions(spark, d):
    return event_fold.sessions(folded(spark, d))


@query(EV + """SELECT i.image_hash, i.level, b.owner, i.parent, coalesce(string_agg(c.image_hash || ':' || c.level, ',' ORDER BY c.image_hash), '') AS derivatives
FROM image i JOIN cur USING (epoch) LEFT JOIN body b ON b.epoch = i.epoch AND b.body_id = i.body_id LEFT JOIN image c ON c.epoch = i.epoch AND c.parent = i.image_hash GROUP BY ALL""")
def image_nested(spark, d):
    """Each image with its body, its parent and what was made from it."""
    f = folded(spark, d)
    out = lookup.nested_images(event_fold.images_current(f), event_fold.bodies_current(f))
    return out.withColumn("derivatives", F.array_join(F.transform("derivatives", lambda x: F.concat_ws(":", x["image_hash"], x["level"].cast("string"))), ","))


@query(EV + f"""SELECT q.probe, coalesce(b1.body_id, b2.body_id) AS body_id, CASE WHEN b1.body_id IS NOT NULL THEN 'id' WHEN b2.body_id IS NOT NULL THEN 'commitment' ELSE 'none' END AS found_by
FROM (SELECT DISTINCT {_W('k')} AS probe FROM ev) q LEFT JOIN (SELECT body_id FROM body JOIN cur USING (epoch)) b1 ON b1.body_id = q.probe
LEFT JOIN (SELECT com, min(body_id) AS body_id FROM (SELECT epoch, body_id, arg_min(CASE WHEN k % 2 = 1 THEN {_W('k')} END, event_id) AS com FROM (SELECT * FROM ev WHERE kind = 'BodyRegistered' QUALIFY row_number() OVER (PARTITION BY epoch, body_id ORDER BY event_id) = 1) GROUP BY epoch, body_id) JOIN cur USING (epoch) GROUP BY com) b2 ON b2.com = q.probe""")
def body_lookup(spark, d):
    """A body by its id, else by its commitment."""
    f = folded(spark, d)
    b = event_fold.bodies_current(f)
    e = table(spark, d, "events").select(F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), "event_type")
    used = e.where(~((F.col("event_type") == "error") & (F.col("k") >= 30) & (F.col("k") < 99)))
    probes = used.select(word(F.col("k")).alias("probe")).distinct()
    return lookup.bodies_by_key(b, probes.select(F.col("probe").alias("key"))).withColumnRenamed("key", "probe")


@query(EV + "SELECT b.body_id, b.revoked, count(i.image_hash) AS n_images, min(i.registered_at) AS first_at, max(i.pce) AS max_pce FROM body b JOIN cur USING (epoch) LEFT JOIN image i ON i.epoch = b.epoch AND i.body_id = b.body_id GROUP BY ALL")
def index_health(spark, d):
    f = folded(spark, d)
    return lookup.body_health(event_fold.bodies_current(f), event_fold.images_current(f))


@query(EV + """SELECT e.event_id AS call_id, CASE WHEN r.reg_at IS NULL OR r.reg_at > e.event_id THEN 'unknown body'
  WHEN EXISTS (SELECT 1 FROM ev v WHERE v.kind = 'BodyRevoked' AND v.epoch = e.epoch AND v.body_id = e.body_id AND v.event_id < e.event_id AND v.event_id > r.reg_at) THEN 'body revoked'
  WHEN EXISTS (SELECT 1 FROM first_image i WHERE i.epoch = e.epoch AND i.image_hash = e.image_hash AND i.event_id < e.event_id) THEN 'image already registered'
  WHEN e.k % 4 > 2 THEN 'modification level out of range' END AS error
FROM ev e LEFT JOIN reg r ON r.epoch = e.epoch AND r.body_id = e.body_id WHERE e.kind = 'ImageRegistered'""")
def register_image_checks(spark, d):
    """The checks of a registration in their order, against a trusted log."""
    return event_fold.registration_checks(folded(spark, d)).withColumnRenamed("block_number", "call_id")


@query()
def replay_calls(spark, d):
    """All calls replayed as untrusted: owners, revocations, duplicates and parents decide one another. Tested by brute force."""
    from luxtrace.operators.registry import replay

    return replay(generated_calls(spark, d), admin="0x" + "0" * 40)


def generated_calls(spark: SparkSession, d: str) -> DataFrame:
    from luxtrace.operators.registry import CALLS

    log = generated_log(spark, d).where("log_index = 0")  # registrations make their commits themselves
    name = {"BodyRegistered": "registerBody", "BodyRevoked": "revokeBody", "BodyTransferred": "transferBody", "ImageRegistered": "registerImage", "SessionCommitted": "commitSession", "Commit": "commit", "RegistryReset": "resetAll", "Attested": "attest", "Challenged": "challenge"}
    function = F.create_map(*[F.lit(x) for kv in name.items() for x in kv])[F.col("kind")]
    sender = F.coalesce(F.col("owner"), F.col("by_address"), F.col("recorder"), F.when(F.col("kind") == "RegistryReset", F.lit("0x" + "0" * 40)), F.concat(F.lit("0x"), F.right("body_id", F.lit(40))), F.lit("0x" + "0" * 40))
    made = {"call_id": F.col("block_number"), "sender": sender, "function": function, "commitment": F.col("body_id"), "derived_id": F.col("body_id")}
    return log.select(*[made.get(f.name, F.col(f.name) if f.name in log.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CALLS])


# --- lineage


@query("SELECT c.conv_id, c.turn, p.turn AS parent_turn, p.role AS parent_role FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def lineage_parent(spark, d):
    c = table(spark, d, "conversations")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("parent_turn"), F.col("role").alias("parent_role"))
    return c.select("conv_id", "turn").join(p, ["conv_id", "turn"], "left")


@query("SELECT p.conv_id, p.turn, count(c.turn) AS n_children, max(c.role) AS child_role FROM conversations p LEFT JOIN conversations c ON p.conv_id = c.conv_id AND c.turn = p.turn + 1 GROUP BY ALL")
def lineage_children(spark, d):
    c = table(spark, d, "conversations")
    kids = c.groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.count(F.lit(1)).alias("n_children"), F.max("role").alias("child_role"))
    return c.select("conv_id", "turn").join(kids, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("n_children", F.lit(0)).alias("n_children"), "child_role")


@query("""WITH RECURSIVE up AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)
  UNION ALL SELECT c.conv_id, c.turn, u.root, u.depth + 1 FROM up u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.turn + 1) SELECT * FROM up""")
def lineage_root(spark, d):
    """The closure of the parent relation: each step doubles the distance looked at, so rounds are few."""
    from luxtrace.operators.lineage import roots

    c = table(spark, d, "conversations").select("conv_id", "turn")
    node = F.struct("conv_id", "turn")
    kept = c.select(node.alias("node"))
    parent = F.struct(F.col("conv_id"), (F.col("turn") - 1).alias("turn"))
    edges = c.select(node.alias("node"), parent.alias("parent")).join(kept.withColumnRenamed("node", "parent"), "parent", "left_semi")
    return roots(kept, edges).select("node.conv_id", "node.turn", F.col("root.turn").alias("root"), "depth")


# --- catalogue (orders as photographs, customers as cameras)


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("o_orderkey")), 64, "0")).alias("image_hash"), F.lit("").alias("perceptual_hash"), F.col("o_custkey").cast("string").alias("body_id"), F.concat(F.lit("camera "), (F.col("o_custkey") % 50).cast("string")).alias("body_name"),
        F.col("o_totalprice").alias("pce"), F.unix_timestamp("o_orderdate").alias("registered_at"), F.lit(None).cast("string").alias("tx_hash"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("block_number"), F.col("o_orderpriority").alias("session_id"),
        F.concat(F.lit("IMG_"), F.col("o_orderkey").cast("string"), F.lit(".CR3")).alias("file_name"), F.lit("/photos").alias("file_path"), F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "").alias("description"), F.lit(0).cast("long").alias("noted_at"),
    )


CAT = """WITH cat AS (SELECT '0x' || lpad(lower(printf('%x', o_orderkey::bigint)), 64, '0') AS image_hash, o_orderkey, o_custkey::varchar AS body_id, 'camera ' || (o_custkey % 50)::varchar AS body_name, o_totalprice AS pce, floor(epoch(o_orderdate))::bigint AS registered_at,
  CASE WHEN o_orderkey % 3 != 0 THEN o_orderkey END AS block_number, o_orderpriority AS session_id, 'IMG_' || o_orderkey::varchar || '.CR3' AS file_name, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN '' END AS description FROM orders)
"""


@query(CAT + "SELECT count(*) AS n_images, count(DISTINCT session_id) AS n_sessions, count(DISTINCT body_id) AS n_bodies, min(pce) AS min_pce, max(pce) AS max_pce, round(avg(pce), 3) AS avg_pce, sum((description <> '')::int)::bigint AS n_described, min(registered_at) AS first_at, max(registered_at) AS last_at FROM cat")
def catalogue_stats(spark, d):
    return catalogue.statistics(_catalogue(spark, d)).withColumn("avg_pce", F.round("avg_pce", 3))


@query(CAT + "SELECT body_name, count(*) AS n_images FROM cat GROUP BY 1")
def catalogue_per_body(spark, d):
    return catalogue.per_body(_catalogue(spark, d))


@query(CAT + "SELECT image_hash, registered_at, file_name FROM cat ORDER BY registered_at DESC NULLS LAST, image_hash LIMIT 500")
def catalogue_listing(spark, d):
    return catalogue.listing(_catalogue(spark, d)).select("image_hash", "registered_at", "file_name")


@query(CAT + "SELECT image_hash, file_name, body_name FROM cat WHERE lower(file_name) LIKE '%g_12%' OR lower(body_name) LIKE '%g_12%'")
def catalogue_search(spark, d):
    return catalogue.search(_catalogue(spark, d), "G_12").select("image_hash", "file_name", "body_name")


@query(CAT + """, new AS (SELECT image_hash, file_name || '.new' AS file_name, CASE WHEN o_orderkey % 2 = 0 THEN 'tx' END AS tx_hash FROM cat WHERE o_orderkey % 5 = 0)
SELECT c.image_hash, coalesce(n.file_name, c.file_name) AS file_name, n.tx_hash, c.session_id, c.pce FROM cat c LEFT JOIN new n USING (image_hash)""")
def catalogue_upsert(spark, d):
    c = _catalogue(spark, d)
    key = F.conv(F.substring("image_hash", 3, 64), 16, 10).cast("long")
    new = c.where(key % 5 == 0).select(*[F.concat("file_name", F.lit(".new")).alias(x) if x == "file_name" else F.when(key % 2 == 0, "tx").alias(x) if x == "tx_hash" else F.lit(None).cast("string").alias(x) if x == "session_id" else F.lit(-1.0).alias(x) if x == "pce" else F.col(x) for x in c.columns])
    return catalogue.upsert(c, new, "noted_at").select("image_hash", "file_name", "tx_hash", "session_id", "pce")


@query(CAT + """, bodies AS (SELECT DISTINCT body_id, 'renamed ' || body_id AS name FROM cat WHERE body_id::bigint % 4 = 0), chain AS (SELECT image_hash, body_id, pce + 1 AS pce FROM cat WHERE o_orderkey % 7 != 0 AND body_id::bigint % 4 = 0)
SELECT c.image_hash, coalesce(ch.pce, c.pce) AS pce, CASE WHEN ch.image_hash IS NOT NULL THEN b.name ELSE c.body_name END AS body_name FROM cat c LEFT JOIN bodies b ON b.body_id = c.body_id LEFT JOIN chain ch ON ch.image_hash = c.image_hash
WHERE ch.image_hash IS NOT NULL OR b.body_id IS NULL OR NOT (c.block_number IS NULL OR c.block_number <= 5000)""")
def catalogue_sync(spark, d):
    c = _catalogue(spark, d)
    own = c.where(F.col("body_id").cast("long") % 4 == 0)
    bodies = own.select("body_id").distinct().withColumn("body_name", F.concat(F.lit("renamed "), "body_id"))
    key = F.conv(F.substring("image_hash", 3, 64), 16, 10).cast("long")
    chain = own.where(key % 7 != 0).select("image_hash", "perceptual_hash", "body_id", (F.col("pce") + 1).alias("pce"), "registered_at")
    return catalogue.sync(c, bodies, chain, 5000).select("image_hash", "pce", "body_name")


@query("SELECT c_custkey::varchar AS body_id FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F')")
def needs_attention(spark, d):
    enrolled = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("body_id"))
    on_chain = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("body_id"), (~((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))).alias("revoked"))
    return catalogue.needs_attention(enrolled, on_chain)


@query("SELECT o_orderpriority AS folder, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS serials FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def serials_disagree(spark, d):
    frames = table(spark, d, "orders").select(F.col("o_orderpriority").alias("folder"), F.col("o_orderstatus").alias("serial"))
    return catalogue.serials_disagree(frames).select("folder", F.array_join("serials", ",").alias("serials"))


# --- hashes


@query(f"SELECT doc_id, sha256(unhex('{PIXEL_TAG.hex()}') || unhex(lpad(printf('%x', strlen(text)), 8, '0')) || unhex('0000000100000003') || encode(text)) AS image_hash FROM documents")
def pixel_identity(spark, d):
    """Content hash of rasters: here each text's bytes as one column of pixels."""
    t = F.encode("text", "UTF-8")
    return table(spark, d, "documents").select("doc_id", F.substring(hashing.pixel_hash(F.length(t), F.lit(1), t), 3, 64).alias("image_hash"))


@query("SELECT min(doc_id) AS first_doc, count(*) AS n, sha256(text) AS content FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, d):
    h = F.sha2(F.col("text").cast("binary"), 256).alias("content")
    return table(spark, d, "documents").select("doc_id", h).groupBy("content").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"SELECT doc_id, '{CID_PREFIX}' || sha256(text) AS cid, '0x' || sha256(text) AS image FROM documents")
def asset_cid(spark, d):
    cid = words.content_id(F.sha2(F.col("text").cast("binary"), 256))
    return table(spark, d, "documents").select("doc_id", cid.alias("cid"), words.image_of_content_id(cid).alias("image"))


_REC = f"unhex('{RECORD_TAG.hex()}') || unhex(sha256(text)) || unhex(lpad(printf('%x', doc_id), 16, '0')) || unhex(sha256(source)) || unhex(lpad(printf('%x', doc_id % 3), 2, '0')) || unhex(repeat('00', 32)) || unhex(sha256(lang)) || unhex(lpad(printf('%x', n_chars), 8, '0')) || unhex(lpad(printf('%x', 1757000000 + doc_id), 16, '0'))"


@query(f"SELECT doc_id, sha256({_REC}) AS digest, octet_length({_REC}) AS n_bytes FROM documents")
def canonical_records(spark, d):
    h = lambda c: hashing.sha256(F.col(c).cast("binary"))
    record = hashing.canonical_record(h("text"), words.big_endian("doc_id", 8), h("source"), F.col("doc_id") % 3, F.unhex(F.lit("00" * 32)), h("lang"), "n_chars", F.col("doc_id") + 1757000000)
    return table(spark, d, "documents").select("doc_id", F.sha2(record, 256).alias("digest"), F.length(record).cast("long").alias("n_bytes"))


_LEN = lambda x: f"unhex(lpad(printf('%x', strlen({x})), 8, '0')) || encode({x})"
_HMAC_KEY = b"bench key"
_PADDED = _HMAC_KEY.ljust(64, b"\0")
_IPAD, _OPAD = (bytes(b ^ p for b in _PADDED).hex() for p in (0x36, 0x5C))


@query(f"SELECT doc_id, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || {_LEN('n_chars::varchar')} || {_LEN('source')} || {_LEN('lang')}))) AS mac FROM documents")
def metadata_hmacs(spark, d):
    mac = hashing.metadata_hmac(_HMAC_KEY, F.col("n_chars"), F.col("source"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(mac)).alias("mac"))


@query(f"SELECT doc_id, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || unhex('{BODY_TAG.hex()}') || {_LEN('source')} || {_LEN('lang')} || {_LEN('doc_id::varchar')} || {_LEN(chr(39) * 2)} || unhex('00000020') || unhex(sha256(text))))) AS mac FROM documents")
def body_commitments(spark, d):
    mac = hashing.body_commitment(_HMAC_KEY, F.col("source"), F.col("lang"), F.col("doc_id"), F.lit(None).cast("string"), F.concat(F.lit("0x"), F.sha2(F.col("text").cast("binary"), 256)))
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(mac)).alias("mac"))


@query(f"SELECT source, sha256(unhex('{SESSION_TAG.hex()}') || unhex(sha256(source))) AS session_id FROM documents GROUP BY source")
def session_ids(spark, d):
    s = table(spark, d, "documents").select("source").distinct()
    return s.select("source", F.lower(F.hex(hashing.session_id(hashing.sha256(F.col("source").cast("binary"))))).alias("session_id"))


@query("""SELECT doc_id, '{"body_id":"' || sha256(source) || '","image_hash":"' || sha256(text) || '","metadata_hmac":"' || sha256(lang) || '","modification_level":' || (doc_id % 3) || ',"parent_image_hash":"' || repeat('0', 64) || '","pce_score":' || n_chars || ',"perceptual_hash":"' || lpad(lower(printf('%x', doc_id)), 16, '0') || '","registered_at":' || (1757000000 + doc_id) || ',"version":"@TAG@"}' AS data FROM documents""".replace("@TAG@", RECORD_TAG.decode()))
def commit_data(spark, d):
    h = lambda c: hashing.sha256(F.col(c).cast("binary"))
    data = hashing.commit_data(h("image"), words.big_endian("doc_id", 8), h("source"), F.col("doc_id") % 3, F.unhex(F.lit("00" * 32)), h("lang"), F.col("n_chars"), F.col("doc_id") + 1757000000)
    return table(spark, d, "documents").withColumnRenamed("text", "image").select("doc_id", data.alias("data"))


@query("""SELECT o_orderkey, greatest(0, least(4294967295, round_even(o_totalprice - 1000, 0)))::bigint AS score, round_even(o_totalprice, 0) >= 100 AS registers, o_totalprice >= 100 AS verifies,
 CASE WHEN o_totalprice <= 1 THEN 0.0 ELSE round(least(100.0, log10(o_totalprice) / 5 * 100), 6) END AS rail, strftime(to_timestamp(o_orderkey * 86399) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM orders""")
def record_numbers(spark, d):
    """Scores as the record holds them, thresholds, the score rail and times."""
    o = table(spark, d, "orders")
    # SQL's to_timestamp takes seconds as a double: from 2**59 microseconds on (year 20237) it holds every second one exactly.
    seconds = F.unix_seconds(F.timestamp_seconds((F.col("o_orderkey") * 86399).cast("double")))
    return o.select("o_orderkey", hashing.clamp_score(F.col("o_totalprice") - 1000).alias("score"), (F.bround("o_totalprice") >= 100).alias("registers"), (F.col("o_totalprice") >= 100).alias("verifies"), F.round(labels.score_rail("o_totalprice"), 6).alias("rail"), labels.iso_time(seconds).alias("iso"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'unedited raw' WHEN 1 THEN 'adjusted' WHEN 2 THEN 'generative edit' ELSE '3' END AS level, substr(sha256(p_name), 1, 6) || '…' || right(sha256(p_name), 4) AS short, regexp_matches('0x' || sha256(p_name), '^0x[0-9a-f]{64}$') AS is_hash, lower(p_name) LIKE '%.cr3' AS is_raw FROM part")
def record_labels(spark, d):
    h = F.sha2(F.col("p_name").cast("binary"), 256)
    return table(spark, d, "part").select("p_partkey", labels.level_name(F.col("p_size") % 4).alias("level"), labels.short_hash(h).alias("short"), words.is_hash(F.concat(F.lit("0x"), h)).alias("is_hash"), words.is_raw("p_name").alias("is_raw"))


@query("SELECT c_custkey, n_nationkey::bigint AS nation, '0x' || lpad(lower(printf('%x', c_custkey)), 40, '0') AS address, NULL::bigint AS beyond FROM customer JOIN nation ON n_nationkey = c_nationkey")
def abi_words(spark, d):
    """Numbers and addresses read back from ABI-encoded words; a short answer reads as nothing."""
    data = F.concat(words.big_endian("c_nationkey", 32), words.big_endian("c_custkey", 32))
    return table(spark, d, "customer").withColumn("data", data).select("c_custkey", words.abi_uint("data", 0).alias("nation"), words.abi_address("data", 1).alias("address"), words.abi_uint("data", 2).alias("beyond"))


# --- similarity (embeddings as the 8 × 8 coefficients of perceptual hashes)


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    high, low = hashing.phash_bits("embedding")
    return table(spark, d, "embeddings").select("vec_id", high.alias("hi"), low.alias("lo"))


PH = """WITH med AS (SELECT vec_id, embedding, list_sort(embedding[2:64])[32] AS m FROM embeddings), ph AS (
  SELECT vec_id, list_sum([CASE WHEN embedding[i] > m THEN (1::bigint << (32 - i)::int) ELSE 0 END FOR i IN range(1, 33)])::bigint AS hi, list_sum([CASE WHEN embedding[i] > m THEN (1::bigint << (64 - i)::int) ELSE 0 END FOR i IN range(33, 65)])::bigint AS lo FROM med)
"""
NEAR = PH + """, probes AS (SELECT vec_id AS probe_id, hi, xor(lo, (1::bigint << (vec_id % 14)::int) - 1) AS lo FROM ph),
 near AS (SELECT p.probe_id, i.vec_id AS image_id, (bit_count(xor(p.hi, i.hi)) + bit_count(xor(p.lo, i.lo)))::int AS distance FROM probes p JOIN ph i ON bit_count(xor(p.hi, i.hi)) + bit_count(xor(p.lo, i.lo)) <= 10)
"""


@query(PH + "SELECT * FROM ph")
def phash_bits(spark, d):
    return _hashes(spark, d)


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ph = _hashes(spark, d)
    both = lambda lo: F.shiftleft("hi", 32).bitwiseOR(lo)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("vec_id") % 14).cast("int")) - 1
    probes = ph.select(F.col("vec_id").alias("probe_id"), both(F.col("lo").bitwiseXOR(mask)).alias("probe_hash"))
    return probes, ph.select(F.col("vec_id").alias("image_id"), both(F.col("lo")).alias("image_hash64"))


@query(NEAR + "SELECT * FROM near")
def near_matches(spark, d):
    return similarity.near_by_bands(*_near(spark, d)).select("probe_id", "image_id", F.col("distance").cast("int"))


@query(NEAR + "SELECT * FROM near")
def near_matches_scan(spark, d):
    probes, index = _near(spark, d)
    return similarity.near_matches(probes, index).select("probe_id", "image_id", F.col("distance").cast("int"))


@query(NEAR + "SELECT * FROM near")
def near_matches_wide(spark, d):
    """By the plan for a large index."""
    return similarity.near_by_wide_bands(*_near(spark, d)).select("probe_id", "image_id", F.col("distance").cast("int"))


_WIDE_X = "xor(p.hi, i.hi) * 4294967296::hugeint + xor(p.lo, i.lo)"
_WIDE_SUM = " + ".join(f"(bit_count(((x >> {at}) & {(1 << n) - 1})::bigint) <= CASE WHEN odd THEN {other} ELSE {same} END)::bigint" for at, n, same, other in similarity.WIDE)


@query(NEAR + f", pair AS (SELECT {_WIDE_X} AS x, (bit_count(xor(p.hi, i.hi)) + bit_count(xor(p.lo, i.lo))) % 2 = 1 AS odd FROM probes p, ph i) SELECT sum({_WIDE_SUM})::bigint AS compared, count(*) AS possible FROM pair")
def near_compared(spark, d):
    """How many pairs the plan for a large index compares, of how many."""
    return similarity.compared(*_near(spark, d))


@query(NEAR + "SELECT probe_id, arg_min(image_id, (distance, image_id)) AS image_id, min(distance) AS distance FROM near GROUP BY 1")
def nearest_match(spark, d):
    return similarity.nearest(similarity.near_by_bands(*_near(spark, d))).select("probe_id", "image_id", F.col("distance").cast("int"))


@query(NEAR + "SELECT distance, count(*) AS n FROM near GROUP BY 1")
def hamming_histogram(spark, d):
    return similarity.near_by_bands(*_near(spark, d)).groupBy(F.col("distance").cast("int").alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def _verdict_inputs(spark: SparkSession, d: str):
    """Two planted copies of each image; a third of them isn't in the registry."""
    ph = _hashes(spark, d)
    flip = lambda n, m: F.shiftleft("hi", 32).bitwiseOR(F.col("lo").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("vec_id") % n + m).cast("int")) - 1))
    index = ph.select(F.col("vec_id").alias("image_id"), flip(3, 0).alias("image_hash64")).union(ph.select((F.col("vec_id") + 10000).alias("image_id"), flip(4, 1).alias("image_hash64")))
    records = index.where(F.col("image_id") % 3 != 0).select("image_id", (F.col("image_id") % 7).cast("string").alias("body_id"), (F.lit(1_700_000_000) + F.col("image_id") * 7919 % 100_003).alias("registered_at"))
    probes = ph.select(F.col("vec_id").alias("probe_id"), F.when(F.col("vec_id") % 4 == 0, F.col("vec_id")).otherwise(F.col("vec_id") + 50_000).alias("image_id"), flip(14, 0).alias("probe_hash"), (F.col("vec_id") % 50 != 49).alias("chain_ok"))
    scores = ph.select(F.col("vec_id").alias("probe_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("enrolled")).select("probe_id", "enrolled", F.concat(F.lit("b"), F.col("enrolled").cast("string")).alias("body_id"), (F.col("probe_id") * 37 % 300 - F.col("enrolled") * 10).cast("double").alias("pce"))
    return probes, index, records, scores


VER = PH + """, idx AS (SELECT vec_id AS image_id, hi, xor(lo, (1::bigint << (vec_id % 3)::int) - 1) AS lo FROM ph UNION ALL SELECT vec_id + 10000, hi, xor(lo, (1::bigint << (vec_id % 4 + 1)::int) - 1) FROM ph),
rec AS (SELECT image_id, (image_id % 7)::varchar AS body_id, 1700000000 + image_id * 7919 % 100003 AS registered_at FROM idx WHERE image_id % 3 != 0),
prb AS (SELECT vec_id AS probe_id, CASE WHEN vec_id % 4 = 0 THEN vec_id ELSE vec_id + 50000 END AS own, hi, xor(lo, (1::bigint << (vec_id % 14)::int) - 1) AS lo, vec_id % 50 != 49 AS ok FROM ph),
cand AS (SELECT p.probe_id, i.image_id, bit_count(xor(p.hi, i.hi)) + bit_count(xor(p.lo, i.lo)) AS distance FROM prb p JOIN idx i ON i.image_id <> p.own AND bit_count(xor(p.hi, i.hi)) + bit_count(xor(p.lo, i.lo)) <= 10),
rk AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY distance, image_id) AS rank FROM cand),
found AS (SELECT k.*, r.body_id, r.registered_at FROM rk k JOIN rec r USING (image_id) WHERE rank <= 10),
first AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY registered_at, rank) = 1),
best AS (SELECT vec_id AS probe_id, (vec_id * 37 % 300)::double AS pce FROM ph),
ver AS (SELECT p.probe_id, p.ok, x.image_id AS x_id, f.image_id AS f_id, coalesce(x.image_id, f.image_id) AS reported, coalesce(x.body_id, f.body_id) AS body_id, coalesce(x.registered_at, f.registered_at) AS registered_at, f.distance,
  CASE WHEN NOT p.ok THEN 'withheld' WHEN x.image_id IS NOT NULL THEN 'registered' WHEN f.image_id IS NOT NULL THEN 'derived' WHEN b.pce >= 100 THEN 'fingerprint-only' ELSE 'no-record' END AS verdict
  FROM prb p LEFT JOIN rec x ON x.image_id = p.own LEFT JOIN first f ON f.probe_id = p.probe_id JOIN best b ON b.probe_id = p.probe_id)
"""


@query(VER + "SELECT probe_id, verdict, CASE WHEN ok THEN reported END AS reported, CASE WHEN ok THEN body_id END AS body_id, CASE WHEN ok THEN registered_at END AS registered_at, CASE WHEN verdict = 'derived' THEN distance::int END AS distance FROM ver")
def verdicts(spark, d):
    out = verdict.verdicts(*_verdict_inputs(spark, d))
    return out.select("probe_id", "verdict", "reported", "body_id", "registered_at", F.col("distance").cast("int"))


@query(VER + "SELECT v.probe_id, count(*) FILTER (WHERE f.registered_at < v.registered_at) AS n_earlier, count(*) FILTER (WHERE f.registered_at >= v.registered_at) AS n_later, arg_min(f.image_id, (f.registered_at, f.image_id)) FILTER (WHERE f.registered_at < v.registered_at) AS first_earlier FROM ver v JOIN found f ON f.probe_id = v.probe_id AND f.image_id <> v.reported WHERE v.ok GROUP BY 1")
def competing(spark, d):
    out = verdict.verdicts(*_verdict_inputs(spark, d)).where("verdict != 'withheld'")
    split = verdict.split_competing(out).where("n_earlier + n_later > 0")
    return split.select("probe_id", F.col("n_earlier").cast("long"), F.col("n_later").cast("long"), "first_earlier")


@query(VER + """, near1 AS (SELECT p.probe_id, i.image_id, bit_count(xor(p.hi, i.hi)) + bit_count(xor(p.lo, i.lo)) AS distance FROM prb p JOIN idx i ON bit_count(xor(p.hi, i.hi)) + bit_count(xor(p.lo, i.lo)) <= 10), n1 AS (SELECT probe_id, arg_min(image_id, (distance, image_id)) AS image_id, min(distance) AS distance FROM near1 GROUP BY 1)
SELECT p.probe_id, CASE WHEN x.image_id IS NOT NULL THEN 'exact' WHEN n.image_id IS NOT NULL THEN 'lead' ELSE 'none' END AS kind, coalesce(x.image_id, n.image_id) AS image_id, CASE WHEN x.image_id IS NOT NULL THEN 0 ELSE n.distance::int END AS distance FROM prb p LEFT JOIN rec x ON x.image_id = p.own LEFT JOIN n1 n ON n.probe_id = p.probe_id""")
def file_lookup(spark, d):
    probes, index, records, _ = _verdict_inputs(spark, d)
    return verdict.lookup(probes, index, records).select("probe_id", "kind", "image_id", F.col("distance").cast("int"))


@query(VER + "SELECT probe_id, stage, name, CASE stage WHEN 1 THEN CASE WHEN (probe_id * 37 % 300) >= 100 THEN 'match' ELSE 'no match' END WHEN 3 THEN CASE WHEN verdict IN ('registered', 'derived') THEN 'registered' ELSE 'no registration' END END AS result FROM ver CROSS JOIN (VALUES (1, 'pixel match'), (2, 'consistency'), (3, 'registration')) s(stage, name)")
def verdict_stages(spark, d):
    return verdict.stages(verdict.verdicts(*_verdict_inputs(spark, d))).select("probe_id", "stage", "name", "result")


# --- statistics


@query("SELECT l_partkey, round(sum(l_discount * l_quantity) / greatest(sum(l_quantity * l_quantity), 2.220446049250313e-16), 9) AS k FROM lineitem GROUP BY 1")
def ml_fingerprint(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(statistics.ml_fingerprint("l_discount", "l_quantity"), 9).alias("k"))


@query("SELECT l_suppkey, round(avg((l_quantity / 50.0 >= 0.99)::int), 9) AS saturated FROM lineitem GROUP BY 1")
def saturation_fraction(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(statistics.saturated_share(F.col("l_quantity") / 50.0), 9).alias("saturated"))


@query("SELECT l_suppkey, round(sum(l_tax * l_quantity) / sum(l_quantity * l_quantity), 9) AS alpha, round(sum(l_tax * l_discount) / sqrt(sum(l_tax * l_tax) * sum(l_discount * l_discount)), 9) AS cosine FROM lineitem GROUP BY 1")
def strength_and_collinearity(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(statistics.strength("l_tax", "l_quantity"), 9).alias("alpha"), F.round(statistics.collinearity("l_tax", "l_discount"), 9).alias("cosine"))


@query("""WITH a AS (SELECT l_suppkey, sum(l_tax * l_quantity) / sum(l_quantity * l_quantity) AS alpha FROM lineitem GROUP BY 1), s AS (SELECT l.*, l_tax - alpha * l_quantity AS r FROM lineitem l JOIN a USING (l_suppkey))
SELECT l_orderkey, l_linenumber, round(r - avg(r) OVER (PARTITION BY l_suppkey), 8) + 0.0 AS stripped FROM s""")
def strip_projection(spark, d):
    out = statistics.strip_projection(table(spark, d, "lineitem"), "l_suppkey", "l_tax", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", (F.round("stripped", 8) + 0.0).alias("stripped"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_tax - avg(l_tax) OVER (PARTITION BY l_linenumber) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, round(v - avg(v) OVER (PARTITION BY l_orderkey), 8) + 0.0 AS zero_mean FROM a""")
def zero_mean_2d(spark, d):
    out = statistics.zero_mean(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_tax")
    return out.select("l_orderkey", "l_linenumber", (F.round("zero_mean", 8) + 0.0).alias("zero_mean"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS box FROM events")
def box_mean_zero_padded(spark, d):
    return table(spark, d, "events").select("event_id", F.round(statistics.box_mean("user_id", "event_id", "value", 2), 6).alias("box"))


@query("SELECT event_id, round(lead(value, 2) OVER w - 2 * lead(value, 1) OVER w + value, 6) AS d2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def second_difference(spark, d):
    return table(spark, d, "events").select("event_id", F.round(statistics.second_difference("user_id", "event_id", "value"), 6).alias("d2"))


@query("""WITH s AS (SELECT l.quality = 1 AS g, abs(d.n_chars::double) AS m FROM labels l JOIN documents d USING (doc_id)), n AS (SELECT count(*) FILTER (WHERE g) AS ng, count(*) FILTER (WHERE NOT g) AS nf FROM s)
SELECT v.p_partkey AS value_id, least(n.ng, n.nf) >= 50 AS sufficient, CASE WHEN least(n.ng, n.nf) >= 50 THEN round(((SELECT count(*) FROM s WHERE g AND m >= abs(v.p_retailprice)) + 1)::double / (n.ng + 2) / (((SELECT count(*) FROM s WHERE NOT g AND m >= abs(v.p_retailprice)) + 1)::double / (n.nf + 2)), 9) END AS ratio FROM part v, n""")
def likelihood_ratio(spark, d):
    samples = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select((F.col("quality") == 1).alias("genuine"), F.col("n_chars").alias("x"))
    values = table(spark, d, "part").select(F.col("p_partkey").alias("value_id"), F.col("p_retailprice").alias("value"))
    return statistics.likelihood_ratio(samples, values).select("value_id", "sufficient", F.round("ratio", 9).alias("ratio"))


@query("""WITH s AS (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS sd, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(sum(sign((value - m) / sd) * ((value - m) / sd) * ((value - m) / sd)) / sqrt(3.0 * max(n)), 6) AS pooled FROM s GROUP BY 1""")
def pooled_triangle(spark, d):
    return statistics.pooled_triangle(table(spark, d, "events"), "event_type", "value").select("event_type", F.round("pooled", 6).alias("pooled"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(sqrt(var_pop(l_extendedprice) * (1 - corr(l_extendedprice, l_quantity) ^ 2)), 4) AS residual_std, round(corr(l_extendedprice, l_quantity), 8) AS pearson FROM lineitem GROUP BY 1")
def calibration_fit(spark, d):
    out = statistics.calibration(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("residual_std", 4).alias("residual_std"), F.round("pearson", 8).alias("pearson"))


@query("SELECT l_shipdate::date::varchar AS day, round(10 * log10(255.0 * 255.0 / avg((l_quantity - l_linenumber) ^ 2)), 6) AS psnr FROM lineitem GROUP BY 1 HAVING avg((l_quantity - l_linenumber) ^ 2) > 0")
def psnr(spark, d):
    out = table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.round(statistics.psnr("l_quantity", "l_linenumber"), 6).alias("psnr"))
    return out.where(F.col("psnr") != float("inf"))


# --- kernels (golden and property tests; SQL cannot express them)


def _planes(spark: SparkSession, d: str) -> DataFrame:
    """Small planes made from embeddings: each vector repeated to 64 × 64 samples within 0 and 1."""
    row = F.transform("embedding", lambda x: (x * 0.5 + 0.5).cast("float"))
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("frame_id"), F.lit(0).alias("plane"), F.lit(64).alias("h"), F.lit(64).alias("w"), F.flatten(F.array_repeat(row, 64)).alias("data"))


@query()
def dwt_residual_energy(spark, d):
    from luxtrace.operators.raster.frames import residuals

    w = residuals(_planes(spark, d))
    return w.select("frame_id", F.round(F.aggregate("data", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")), 9).alias("energy"))


def _mosaic_frames(spark: SparkSession, d: str) -> DataFrame:
    """The four planes of a 64 × 64 mosaic for each vector: the products of its samples, 0.5 where they are zero.

    Rows and columns differ, so a fingerprint has something left once their means are gone.
    """
    half = lambda k: F.filter("embedding", lambda _, i: i % 2 == k)
    outer = lambda a, b: F.flatten(F.transform(a, lambda y: F.transform(b, lambda x: (x.cast("double") * y * 0.5 + 0.5).cast("float"))))
    planes = F.array(*[F.struct(F.lit(c).alias("plane"), outer(half(i), half(j)).alias("data")) for i, j, c in ((0, 0, 0), (0, 1, 1), (1, 1, 2), (1, 0, 3))])
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("frame_id"), (F.col("label") % 2).cast("string").alias("body_id"), F.explode(planes).alias("p"))
    return rows.select("frame_id", "body_id", "p.plane", F.lit(32).alias("h"), F.lit(32).alias("w"), "p.data")


@query()
def pce_scores(spark, d):
    """Every frame against the fingerprints of two bodies, estimated from the frames of even and of odd labels.

    The score is that of the sum of all four planes' correlation surfaces.
    """
    from luxtrace.operators.raster.frames import estimate_fingerprints, score_planes

    p = _mosaic_frames(spark, d)
    images = p.withColumnRenamed("frame_id", "image_id").drop("body_id")
    return score_planes(images, estimate_fingerprints(p)).select("image_id", "body_id", F.round("pce", 6).alias("pce"), "path", "error")


@query()
def keccak_ids(spark, d):
    from luxtrace.functions.keccak import body_id

    h = hashing.sha256(F.col("text").cast("binary"))
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(body_id(h))).alias("body_id"))


@query()
def merkle_roots(spark, d):
    """A Merkle root for each source's documents, and the id of its session."""
    from luxtrace.functions.keccak import merkle_roots as roots

    frames = table(spark, d, "documents").select("source", hashing.sha256(F.col("text").cast("binary")).alias("leaf"))
    return roots(frames, "source").select("source", F.lower(F.hex("merkle_root")).alias("merkle_root"), "frame_count", F.lower(F.hex(hashing.session_id("merkle_root"))).alias("session_id"))


# --- the read API, text and small rules


@query(EV + "SELECT cur.epoch AS epoch, cur.epoch > 0 AS resettable, (SELECT max(event_id) FROM ev) AS indexed_block, (SELECT count(*) FROM body b WHERE b.epoch = cur.epoch) AS n_bodies, (SELECT count(*) FROM image i WHERE i.epoch = cur.epoch) AS n_images FROM cur")
def index_status(spark, d):
    return lookup.status(folded(spark, d), most=None)


@query(EV + ", own AS (SELECT image.* FROM image JOIN cur USING (epoch)) SELECT image_hash, body_id, level FROM own WHERE image_hash = (SELECT min(image_hash) FROM own)")
def image_point(spark, d):
    """One image by its hash, in capitals."""
    images = event_fold.images_current(folded(spark, d))
    key = images.agg(F.min("image_hash")).first()[0] or ""
    return lookup.image(images, key.upper()).select("image_hash", "body_id", "level")


@query("SELECT sha256(text) AS image_hash, source AS perceptual_hash FROM documents WHERE source = 'src3' ORDER BY 1 LIMIT 10")
def images_like(spark, d):
    """Ten images of one perceptual hash."""
    rows = table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("image_hash"), F.col("source").alias("perceptual_hash"))
    return lookup.images_like(rows, "SRC3")


@query(EV + "SELECT image_hash FROM image JOIN cur USING (epoch) ORDER BY image_hash LIMIT 1000")
def index_scan(spark, d):
    """The first thousand rows that a near search reads."""
    return lookup.index_scan(event_fold.images_current(folded(spark, d))).select("image_hash")


@query(EV + "SELECT i.epoch, i.image_hash, i.body_id FROM image i JOIN body b ON b.epoch = i.epoch AND b.body_id = i.body_id WHERE b.revoked")
def images_of_revoked(spark, d):
    """What revoked cameras have registered, in every epoch."""
    f = folded(spark, d)
    return lookup.images_of(event_fold.images(f), event_fold.bodies(f).where("revoked"), None, by=("epoch", "body_id")).select("epoch", "image_hash", "body_id")


@query(EV + "SELECT image_hash, CASE WHEN level % 2 = 0 THEN '0x' || sha256(event_id::varchar) ELSE '0x0' END AS tx_hash, level % 2 = 0 AS confirmed FROM image JOIN cur USING (epoch)")
def registration_transactions(spark, d):
    """Claims that a transaction registered an image, half of them false."""
    f = folded(spark, d)
    claims = event_fold.images_current(f).select("image_hash", F.when(F.col("level") % 2 == 0, F.col("tx_hash")).otherwise("0x0").alias("tx_hash"))
    return lookup.registration_transactions(f, claims)


_LEVEL_REPORT = "CASE {0} WHEN 0 THEN 'unedited RAW' WHEN 1 THEN 'adjusted' WHEN 2 THEN 'generative edit' ELSE ({0})::varchar END"
_ISO = "strftime(to_timestamp({0}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z')"


@query(EV + f"""SELECT i.image_hash, 'Image ' || i.image_hash || chr(10) || 'Registered ' || {_ISO.format('i.registered_at')} || ' by ' || coalesce(b.owner, 'an unknown owner') || chr(10) || 'Modification: ' || {_LEVEL_REPORT.format('i.level')} || chr(10)
  || 'Score: ' || i.pce || ' against a threshold of 100' || CASE WHEN b.revoked THEN chr(10) || 'The camera was revoked later; the record stands.' ELSE '' END AS said,
  'Image ' || i.image_hash || chr(10) || coalesce('Made from ' || i.parent, 'No parent is recorded.') || chr(10) || coalesce('Derived: ' || (SELECT string_agg(c.image_hash, ', ' ORDER BY c.image_hash) FROM image c WHERE c.epoch = i.epoch AND c.parent = i.image_hash), 'Nothing derived from it is recorded.') AS lineage
FROM image i JOIN cur USING (epoch) LEFT JOIN body b ON b.epoch = i.epoch AND b.body_id = i.body_id""")
def image_texts(spark, d):
    """Each image in words, and its lineage."""
    f = folded(spark, d)
    images, b = event_fold.images_current(f), event_fold.bodies_current(f)
    nested = lookup.nested_images(images, b).select("image_hash", "parent", "owner", F.col("derivatives.image_hash").alias("children"))
    out = images.select("image_hash", "body_id", "level", "pce", "registered_at").join(nested, "image_hash").join(b.select("body_id", "revoked"), "body_id", "left")
    return out.select("image_hash", labels.describe_image("image_hash", "level", "pce", "registered_at", "owner", "revoked").alias("said"), labels.describe_lineage("image_hash", "parent", "children").alias("lineage"))


@query(EV + "SELECT b.body_id, 'Camera ' || b.body_id || chr(10) || 'Owner ' || b.owner || chr(10) || count(i.image_hash) || ' registered images' || CASE WHEN b.revoked THEN chr(10) || 'Revoked.' ELSE '' END AS said FROM body b JOIN cur USING (epoch) LEFT JOIN image i ON i.epoch = b.epoch AND i.body_id = b.body_id GROUP BY b.body_id, b.owner, b.revoked")
def body_texts(spark, d):
    f = folded(spark, d)
    out = lookup.with_images(event_fold.bodies_current(f), event_fold.images_current(f))
    return out.select("body_id", labels.describe_body("body_id", "owner", "n_images", "revoked").alias("said"))


@query(EV + """, asked AS (SELECT image_hash FROM image JOIN cur USING (epoch) UNION ALL SELECT '0x' || sha256('none' || u::varchar) FROM (SELECT DISTINCT u FROM raw) UNION ALL SELECT 'bad ' || u::varchar FROM (SELECT DISTINCT u FROM raw))
SELECT q.image_hash, CASE WHEN q.image_hash LIKE 'bad%' THEN 400 WHEN i.image_hash IS NULL THEN 404 ELSE 200 END AS status, i.image_hash IS NOT NULL AS registered, cur.epoch > 0 AS test_mode,
  i.image_hash IS NOT NULL AND cur.epoch = 0 AND t.commit_event = i.event_id AS cacheable, CASE WHEN i.image_hash IS NOT NULL THEN 'https://page.example/?hash=' || q.image_hash END AS verify_url
FROM asked q CROSS JOIN cur LEFT JOIN image i ON i.epoch = cur.epoch AND i.image_hash = q.image_hash LEFT JOIN early t ON t.image = i.image_hash""")
def read_api(spark, d):
    """Answers to good, unknown and malformed requests."""
    f = folded(spark, d)
    users = table(spark, d, "events").select(F.col("user_id").cast("string").alias("u")).distinct()
    unknown = users.select(F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("none"), "u").cast("binary"), 256)).alias("image_hash"))
    asked = event_fold.images_current(f).select("image_hash").union(unknown).union(users.select(F.concat(F.lit("bad "), "u")))
    out = lookup.record_view(f, asked, chain_id=8453, registry=REGISTRY.upper().replace("0X", "0x"), page="https://page.example/", page_chain=8453, page_registry=REGISTRY)
    return out.select("image_hash", "status", "registered", "test_mode", F.coalesce("cacheable", F.lit(False)).alias("cacheable"), "verify_url")


@query(EV + """, c AS (SELECT e.event_id AS call_id, CASE WHEN r.reg_at IS NULL OR r.reg_at > e.event_id THEN 'This camera is not registered.'
  WHEN EXISTS (SELECT 1 FROM ev v WHERE v.kind = 'BodyRevoked' AND v.epoch = e.epoch AND v.body_id = e.body_id AND v.event_id < e.event_id AND v.event_id > r.reg_at) THEN 'This camera was revoked.'
  WHEN EXISTS (SELECT 1 FROM first_image i WHERE i.epoch = e.epoch AND i.image_hash = e.image_hash AND i.event_id < e.event_id) THEN 'This photograph is already registered.'
  WHEN e.k % 4 > 2 THEN 'execution reverted: modification level out of range' END AS message
FROM ev e LEFT JOIN reg r ON r.epoch = e.epoch AND r.body_id = e.body_id WHERE e.kind = 'ImageRegistered') SELECT * FROM c WHERE message IS NOT NULL""")
def call_messages(spark, d):
    """What a user reads when a registration is refused."""
    failed = event_fold.registration_checks(folded(spark, d)).where("error IS NOT NULL")
    return failed.select(F.col("block_number").alias("call_id"), labels.call_message(F.concat(F.lit("execution reverted: "), "error")).alias("message"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'https://page.example/?hash=' || o_orderkey END AS link FROM orders")
def verify_links(spark, d):
    """Only the one registry on the one chain that the page reads has links."""
    chain, registry = F.when(F.col("o_custkey") % 3 == 0, 8453).otherwise(84532), F.when(F.col("o_orderkey") % 2 == 0, "0x" + "A" * 40).otherwise("0x" + "B" * 40)
    return table(spark, d, "orders").select("o_orderkey", labels.verify_link(chain, registry, F.col("o_orderkey").cast("string"), page="https://page.example/", chain=8453, address="0x" + "a" * 40).alias("link"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN round((p_size % 22) / 21.0, 9) END AS share FROM part")
def progress_shares(spark, d):
    label = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("Searching — "), (F.col("p_size") % 22).cast("string"), F.lit(" of 21"))).otherwise(F.lit("Searching"))
    return table(spark, d, "part").select("p_partkey", F.round(labels.progress_share(label), 9).alias("share"))


@query("""WITH f AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '.CR3' WHEN 1 THEN '.jpg' ELSE '.png' END AS ending, p_size % 4 IN (0, 1) AS starts, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Maker' END AS make, CASE p_partkey % 5 WHEN 0 THEN 'Adobe Something' WHEN 1 THEN 'Firmware 1' END AS software, p_retailprice - 1200 AS detail FROM part)
SELECT p_partkey, CASE WHEN ending = '.CR3' THEN 'refused' WHEN starts THEN 'jpeg' ELSE 'lossless' END AS decoder, coalesce(make, '') <> '' AND coalesce(software, '') NOT LIKE 'Adobe%' AS camera_jpeg,
  CASE WHEN detail < 200 THEN 'too soft to measure' WHEN ending = '.CR3' THEN NULL WHEN coalesce(make, '') <> '' AND coalesce(software, '') NOT LIKE 'Adobe%' THEN 'written by the camera, which removes the fingerprint' END AS reason FROM f""")
def file_kinds(spark, d):
    """Which decoder a file goes to, whether the camera wrote it as it is, and why it can't be measured."""
    size, key = F.col("p_size") % 4, F.col("p_partkey")
    p = table(spark, d, "part").select(
        "p_partkey", F.concat("p_name", F.when(size == 0, ".CR3").when(size == 1, ".jpg").otherwise(".png")).alias("name"), F.unhex(F.when(size < 2, "FFD8FFE0").otherwise("89504E47")).alias("content"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, "Maker").alias("make"), F.when(key % 5 == 0, "Adobe Something").when(key % 5 == 1, "Firmware 1").alias("software"), (F.col("p_retailprice") - 1200).alias("detail"),
    )
    camera = words.is_camera_jpeg("make", "software")
    return p.select("p_partkey", words.decoder_for("name", "content").alias("decoder"), camera.alias("camera_jpeg"), labels.diagnosis("detail", words.is_raw("name"), camera).alias("reason"))


@query("""SELECT n_nationkey, n_nationkey % 6 IN (2, 3) AS may_test, n_nationkey % 6 IN (2, 3) AND n_nationkey % 4 = 0 AS may_reset, lower(hex('lux'::blob)) || '03' || '00' || repeat('8021', 8) AS suffix FROM nation""")
def chain_rules(spark, d):
    """Chains on which a registry may be one for tests, and resets that were typed out."""
    k = F.col("n_nationkey")
    chain = F.when(k % 6 == 0, 1).when(k % 6 == 1, 8453).when(k % 6 == 2, 11155111).when(k % 6 == 3, 31337).when(k % 6 == 4, 99)
    test = words.may_test(chain)
    typed = F.when(k % 4 == 0, F.lit(f"  {REGISTRY.upper()} ")).when(k % 4 == 1, F.lit("yes"))
    return table(spark, d, "nation").select("n_nationkey", test.alias("may_test"), words.may_reset(test, F.lit(REGISTRY), typed).alias("may_reset"), F.lit(words.builder_suffix("lux")).alias("suffix"))


@query("""SELECT c_custkey, '0x' || lpad(lower(printf('%x', c_custkey)), 64, '0') AS word, CASE c_custkey % 3 WHEN 0 THEN lpad(lower(printf('%x', c_custkey)), 8, '0') WHEN 1 THEN lower(hex(('key ' || c_custkey)::blob)) END AS key FROM customer""")
def words_and_keys(spark, d):
    """Bytes as words, and keys given as hex, as text or not at all."""
    c, n = table(spark, d, "customer"), F.col("c_custkey")
    given = F.when(n % 3 == 0, F.concat(F.lit("0x"), F.lpad(F.hex(n), 8, "0"))).when(n % 3 == 1, F.concat(F.lit("  key "), n.cast("string"), F.lit(" "))).otherwise(F.lit("  "))
    return c.select("c_custkey", words.pad_word(words.big_endian("c_custkey", 4)).alias("word"), F.lower(F.hex(words.hmac_key(given))).alias("key"))


@query("SELECT n_regionkey = 0 AND false OR bool_and(n_nationkey % 4 <> 0) AS ready, string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE n_nationkey % 4 = 0) AS missing FROM nation GROUP BY n_regionkey = 0 AND false")
def ready_gate(spark, d):
    checks = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 != 0, True).alias("go"))
    return catalogue.ready(checks).select("ready", F.array_join("missing", ",").alias("missing"))


@query("SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 9) AS mean, min(l_quantity) AS least, max(l_quantity) AS largest FROM lineitem GROUP BY 1")
def corpus_tables(spark, d):
    return statistics.corpus_table(table(spark, d, "lineitem"), "l_returnflag", "l_quantity").withColumn("mean", F.round("mean", 9))


@query(CAT + "SELECT image_hash, CASE WHEN o_orderkey % 4 = 0 THEN 'caption ' || o_orderkey ELSE description END AS description FROM cat")
def captions(spark, d):
    c = _catalogue(spark, d)
    return catalogue.describe(c, _captions(c)).select("image_hash", "description")


@query(CAT + "SELECT image_hash, true AS found FROM cat WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'none' || substr(image_hash, 5), false FROM cat WHERE o_orderkey % 4 = 0")
def captions_known(spark, d):
    c = _catalogue(spark, d)
    return catalogue.known(c, _captions(c))


def _captions(c: DataFrame) -> DataFrame:
    """Captions of every fourth photograph, and of as many that don't exist."""
    key = F.conv(F.substring("image_hash", 3, 64), 16, 10).cast("long")
    own = c.where(key % 4 == 0).select("image_hash", F.concat(F.lit("caption "), key.cast("string")).alias("description"))
    return own.union(own.select(F.concat(F.lit("none"), F.substring("image_hash", 5, 64)), "description"))


@query("SELECT count(*) AS removed FROM orders")
def catalogue_clear(spark, d):
    return catalogue.clear(_catalogue(spark, d))[1]


@query(CAT + "SELECT image_hash, file_name FROM cat ORDER BY registered_at DESC NULLS LAST, image_hash LIMIT 6")
def recent_six(spark, d):
    return catalogue.listing(_catalogue(spark, d), 6).select("image_hash", "file_name")


@query("SELECT o_orderkey, c_name AS body_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def local_names(spark, d):
    """Names of the local enrolment for ids that differ in case and 0x."""
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("0X"), F.hex("o_custkey")).alias("body_id"))
    local = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.lower(F.hex("c_custkey")).alias("body_id"), F.col("c_name").alias("name"))
    return verdict.with_body_names(rows, local).select("o_orderkey", "body_name")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'camera is not registered' WHEN o_orderkey % 5 = 0 THEN 'already registered' WHEN o_orderkey % 7 = 0 THEN 'no score' WHEN round_even(o_totalprice / 1000, 0) < 100 THEN 'score below the threshold' END AS refused FROM orders""")
def session_frames(spark, d):
    """Frames of an import, judged by the rounded score."""
    from luxtrace.operators import sessions as imports

    o = table(spark, d, "orders")
    key = hashing.sha256(F.col("o_orderkey").cast("string").cast("binary"))
    frames = o.select(F.col("o_orderpriority").alias("session"), F.col("o_orderkey").alias("frame_id"), key.alias("image_hash"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 1000).alias("pce"), F.when(F.col("o_custkey") % 4 != 0, True).alias("body_registered"))
    return imports.judged(frames, o.where("o_orderkey % 5 = 0").select(key.alias("image_hash"))).select(F.col("frame_id").alias("o_orderkey"), "refused")


# --- from files to verdicts (documents as little pictures)


_GREY = "P5 32 32 255\n"


def _picture_files(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, file_id, content``: a grey picture of each text's digests, near copies of half of them, raw files and broken ones."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    pixels = F.concat(*[F.unhex(F.sha2(F.concat(text, F.lit(f"#{i}")).cast("binary"), 256)) for i in range(32)])
    t = table(spark, d, "documents").select("doc_id", pixels.alias("p"))
    whole = F.concat(F.lit(_GREY).cast("binary"), F.col("p"))
    copy = F.concat(F.lit(_GREY).cast("binary"), F.unhex(F.lit("80")), F.substring("p", 2, 1023))
    kinds = (("photo", ".pgm", F.lit(True), whole), ("copy", ".pgm", k % 2 == 0, copy), ("raw", ".CR3", k % 10 == 0, whole), ("bad", ".pgm", k % 13 == 0, F.substring(whole, 1, 500)))
    made = F.array(*[F.when(on, F.struct(F.concat(F.lit(f"{name} "), k.cast("string"), F.lit(end)).alias("file_id"), content.alias("content"))) for name, end, on, content in kinds])
    return t.select("doc_id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("f")).select("doc_id", "f.*")


def _picture_log(spark: SparkSession, d: str, files: DataFrame) -> DataFrame:
    """A log in which every third document's picture is registered, by five cameras, the last of them revoked."""
    from luxtrace.operators.verify import hashed
    from luxtrace.schema import EVENTS
    from luxtrace.shared import cut
    from luxtrace.sources.rasters import decode_files

    own = files.where("doc_id % 3 = 0 AND file_id LIKE 'photo%'")
    seen = hashed(decode_files(own)).join(own.select("doc_id", "file_id"), "file_id")
    k = F.col("doc_id")
    # Written once: the log is folded three times, and each would decode the pictures again.
    images = cut(seen.select((k * 10 + 100).alias("block_number"), F.lit("ImageRegistered").alias("kind"), word(k % 5).alias("body_id"), "image_hash", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("perceptual_hash")), 16, "0")).alias("perceptual_hash"), (k % 4).cast("int").alias("level"), k.alias("pce"), (F.lit(1_700_000_000) + k * 7919 % 100_003).alias("block_timestamp")))
    cameras = spark.range(5).select(F.col("id").alias("block_number"), F.lit("BodyRegistered").alias("kind"), word(F.col("id")).alias("body_id"), word(F.col("id") + 10, 40).alias("owner"), F.lit(1_600_000_000).cast("long").alias("block_timestamp"))
    revoked = cameras.where("block_number = 4").select(F.lit(50).cast("long").alias("block_number"), F.lit("BodyRevoked").alias("kind"), "body_id", "block_timestamp")
    parts = [df.select(*[F.col(f.name) if f.name in df.columns else F.lit(0 if f.name == "log_index" else None).cast(f.dataType).alias(f.name) for f in EVENTS]) for df in (images, cameras, revoked)]
    return event_fold.with_epoch(event_fold.positioned(parts[0].unionByName(parts[1]).unionByName(parts[2])))


_BASIS = "cos(pi() * (2 * {1} + 1) * {0} / 64) * sqrt(2.0 / 32) / CASE WHEN {0} = 0 THEN sqrt(2.0) ELSE 1 END"
_HEX1024 = " || ".join(f"sha256(coalesce(text, '') || '#{i}')" for i in range(32))
PICTURES = f"""WITH doc AS (SELECT doc_id, {_HEX1024} AS hx FROM documents),
file AS (SELECT doc_id, 'photo ' || doc_id || '.pgm' AS file_id, hx, NULL AS reason FROM doc UNION ALL SELECT doc_id, 'copy ' || doc_id || '.pgm', '80' || substr(hx, 3), NULL FROM doc WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'raw ' || doc_id || '.CR3', NULL, 'raw file' FROM doc WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 'bad ' || doc_id || '.pgm', NULL, 'cannot be decoded' FROM doc WHERE doc_id % 13 = 0),
pic AS (SELECT DISTINCT hx, '0x' || sha256(unhex('{PIXEL_TAG.hex()}000000200000002000000003' || regexp_replace(hx, '(..)', '\\1\\1\\1', 'g'))) AS image_hash FROM file WHERE hx IS NOT NULL),
px AS (SELECT hx, i // 32 AS y, i % 32 AS x, ('0x' || substr(hx, 2 * i::int + 1, 2))::int AS v FROM (SELECT hx, unnest(range(1024)) AS i FROM pic)),
side AS (SELECT u, n, {_BASIS.format('u', 'n')} AS b FROM range(8) a(u), range(32) c(n)),
half AS (SELECT hx, u, x, sum(v * b) AS t FROM px JOIN side ON n = y GROUP BY ALL),
coef AS (SELECT hx, list(t ORDER BY u, w) AS c FROM (SELECT hx, h.u, s.u AS w, sum(t * b) AS t FROM half h JOIN side s ON s.n = h.x GROUP BY ALL) GROUP BY hx),
med AS (SELECT hx, c, list_sort(c[2:64])[32] AS m FROM coef),
ph AS (SELECT hx, list_sum([CASE WHEN c[i] > m THEN (1::bigint << (32 - i)::int) ELSE 0 END FOR i IN range(1, 33)])::bigint AS hi, list_sum([CASE WHEN c[i] > m THEN (1::bigint << (64 - i)::int) ELSE 0 END FOR i IN range(33, 65)])::bigint AS lo FROM med),
rec AS (SELECT image_hash, hi, lo, arg_min(doc_id, doc_id) AS doc_id FROM file JOIN pic USING (hx) JOIN ph USING (hx) WHERE doc_id % 3 = 0 AND file_id LIKE 'photo%' GROUP BY ALL),
reg AS (SELECT *, 1700000000 + doc_id * 7919 % 100003 AS registered_at, doc_id % 5 AS cam FROM rec),
near AS (SELECT p.image_hash AS probe, r.image_hash, r.registered_at, bit_count(xor(q.hi, r.hi)) + bit_count(xor(q.lo, r.lo)) AS distance FROM pic p JOIN ph q USING (hx) JOIN reg r ON r.image_hash <> p.image_hash AND bit_count(xor(q.hi, r.hi)) + bit_count(xor(q.lo, r.lo)) <= 10),
conf AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY distance, image_hash) AS rank FROM near QUALIFY rank <= 10),
first AS (SELECT * FROM conf QUALIFY row_number() OVER (PARTITION BY probe ORDER BY registered_at, rank) = 1),
ver AS (SELECT f.file_id, f.reason, p.image_hash, coalesce(x.image_hash, n.image_hash) AS reported, CASE WHEN f.hx IS NULL THEN 'refused' WHEN x.image_hash IS NOT NULL THEN 'registered' WHEN n.image_hash IS NOT NULL THEN 'derived' ELSE 'no-record' END AS verdict, n.distance
  FROM file f LEFT JOIN pic p USING (hx) LEFT JOIN reg x ON x.image_hash = p.image_hash LEFT JOIN first n ON n.probe = p.image_hash)
"""


@query(PICTURES + f"""SELECT v.file_id, v.verdict, CASE v.verdict WHEN 'refused' THEN 'decode' WHEN 'registered' THEN 'registry' ELSE 'index' END AS stage, v.image_hash, v.reported, CASE WHEN v.verdict = 'derived' THEN v.distance::int END AS distance, v.reason,
  CASE WHEN r.cam IS NOT NULL THEN {_W('r.cam')} END AS body_id, CASE WHEN r.cam IS NOT NULL THEN {_W('r.cam + 10', 40)} END AS owner, r.cam = 4 AS revoked, r.registered_at, CASE WHEN r.cam IS NOT NULL THEN false END AS resettable,
  count(c.image_hash) AS n_competing, count(c.image_hash) FILTER (WHERE c.registered_at < r.registered_at) AS n_earlier
FROM ver v LEFT JOIN reg r ON r.image_hash = v.reported LEFT JOIN conf c ON v.reported IS NOT NULL AND c.probe = v.image_hash AND c.image_hash <> v.reported GROUP BY ALL""")
def file_verdicts(spark, d):
    """Files to verdicts in stages: decoded, hashed, looked up in the registry, then in the index."""
    from luxtrace.operators.verify import verify_files
    from luxtrace.sources.rasters import decode_files

    files = _picture_files(spark, d)
    out = verify_files(decode_files(files), _picture_log(spark, d, files))
    competing = F.coalesce("competing", F.array().cast(dict(out.dtypes)["competing"]))
    return out.select("file_id", "verdict", "stage", "image_hash", "reported", "distance", "reason", "body_id", "owner", "revoked", "registered_at", "resettable", F.size(competing).cast("long").alias("n_competing"), F.size(F.filter(competing, lambda m: m["earlier"])).cast("long").alias("n_earlier"))


# --- replay and proofs with SQL


REC = EV.replace("WITH raw", "WITH RECURSIVE raw", 1)
_ZERO = "0x" + "0" * 64


@query(REC + f""", call AS (SELECT event_id AS call_id, epoch, body_id, kind, own AS sender, dest, row_number() OVER (PARTITION BY epoch, body_id ORDER BY event_id) AS n FROM ev WHERE kind IN ('BodyRegistered', 'BodyRevoked', 'BodyTransferred')),
step AS (SELECT NULL::bigint AS call_id, epoch, body_id, 0::bigint AS n, NULL::varchar AS owner, false AS revoked, NULL::varchar AS error FROM (SELECT DISTINCT epoch, body_id FROM call)
  UNION ALL SELECT call_id, epoch, body_id, n, CASE WHEN error IS NOT NULL THEN owner WHEN kind = 'BodyRegistered' THEN sender WHEN kind = 'BodyTransferred' THEN dest ELSE owner END, revoked OR (error IS NULL AND kind = 'BodyRevoked'), error
  FROM (SELECT c.call_id, c.epoch, c.body_id, c.n, c.kind, c.sender, c.dest, s.owner, s.revoked, CASE WHEN c.kind = 'BodyRegistered' THEN CASE WHEN c.body_id = '{_ZERO}' THEN 'empty commitment' WHEN s.owner IS NOT NULL THEN 'body already registered' END
    WHEN s.owner IS NULL THEN 'unknown body' WHEN s.owner <> c.sender THEN 'not the body owner' WHEN s.revoked THEN CASE WHEN c.kind = 'BodyRevoked' THEN 'already revoked' ELSE 'body revoked' END WHEN c.kind = 'BodyTransferred' AND c.dest = '{_ZERO[:42]}' THEN 'zero owner' END AS error
    FROM step s JOIN call c ON c.epoch = s.epoch AND c.body_id = s.body_id AND c.n = s.n + 1))
SELECT call_id, epoch, body_id, error, owner, revoked FROM step WHERE n > 0""")
def replay_bodies(spark, d):
    """Registrations, transfers and revocations of bodies as untrusted calls, each with the body's state after it."""
    from luxtrace.operators.registry import body_calls, with_epochs

    return body_calls(with_epochs(generated_calls(spark, d), admin=_ZERO[:42]))


@query(EV + """SELECT event_id AS call_id, CASE kind WHEN 'SessionCommitted' THEN CASE WHEN k = 0 THEN 'empty session' WHEN row_number() OVER (PARTITION BY kind, epoch, k ORDER BY event_id) > 1 THEN 'session already committed' END END AS error
FROM ev WHERE kind IN ('SessionCommitted', 'Commit', 'Attested', 'Challenged', 'RegistryReset')""")
def replay_others(spark, d):
    """Sessions, commits, attestations, challenges and resets as untrusted calls."""
    from luxtrace.operators.registry import other_calls, with_epochs

    return other_calls(with_epochs(generated_calls(spark, d), admin=_ZERO[:42]), admin=_ZERO[:42])


_STEPS = " + ".join(f"((((n + {2**k - 1}) // {2**k}) > 1 AND xor(i // {2**k}, 1) < (n + {2**k - 1}) // {2**k})::int)" for k in range(26))


@query(f"""WITH leaf AS (SELECT coalesce(source, '') AS source, sha256(text) AS leaf, row_number() OVER (PARTITION BY source ORDER BY sha256(text)) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE text IS NOT NULL),
own AS (SELECT source, leaf, min(place)::bigint AS i, n FROM leaf GROUP BY ALL)
SELECT source, leaf, n AS frame_count, ({_STEPS})::int AS steps, true AS included FROM own""")
def session_proofs(spark, d):
    """Each source's documents as an import: proofs of all of them, verified against the session's root."""
    from luxtrace.functions.keccak import verify_inclusion
    from luxtrace.operators import sessions as imports

    frames = table(spark, d, "documents").where("text IS NOT NULL").select(F.coalesce("source", F.lit("")).alias("session"), hashing.sha256(F.col("text").cast("binary")).alias("image_hash"), F.lit(None).cast("string").alias("refused"))
    got = imports.registered(frames).withColumnRenamed("image_hash", "leaf").withColumnRenamed("merkle_root", "root")
    checked = verify_inclusion(got.select("session", "leaf", "proof", "root", "frame_count"))
    return checked.select(F.col("session").alias("source"), F.lower(F.hex("leaf")).alias("leaf"), "frame_count", F.size("proof").alias("steps"), "included")


# --- the triangle test on small frames


_TRI_K = "sin({0} * 1.7) * 0.4"


@query(f"""WITH px AS (SELECT vec_id AS f, i, i // 8 // 4 * 2 + i % 8 // 4 AS blk, embedding[i + 1]::double * 0.5 + 0.5 AS l, {_TRI_K.format('i')} AS k, 0.3 * ({_TRI_K.format('i')}) * (embedding[i + 1]::double * 0.5 + 0.5) + 0.05 * embedding[(i * 7) % 64 + 1]::double AS n FROM embeddings, (SELECT unnest(range(64)) AS i) u),
blk AS (SELECT f, blk, avg(l) AS m, sqrt(sum(n * n)) / greatest(sqrt(avg(l * l)) * sqrt(sum(k * k)), 1e-30) * (covar_pop(n, l * k) * count(*) / sqrt(greatest(var_pop(n) * count(*) * var_pop(l * k) * count(*), 1e-30))) AS att FROM px GROUP BY ALL),
own AS (SELECT f, corr(n, k) AS c FROM px GROUP BY 1),
pair AS (SELECT f AS a, f + g AS b, f % 3 = 0 AS innocent FROM (SELECT DISTINCT f FROM px), (VALUES (1), (2)) t(g) WHERE f + g IN (SELECT f FROM px)),
mut AS (SELECT p.a, p.b, x.blk, avg(x.l * y.l) AS mutual FROM pair p JOIN px x ON x.f = p.a JOIN px y ON y.f = p.b AND y.i = x.i GROUP BY ALL),
obs AS (SELECT p.a, p.b, corr(x.n, y.n) AS observed FROM pair p JOIN px x ON x.f = p.a JOIN px y ON y.f = p.b AND y.i = x.i GROUP BY ALL),
pre AS (SELECT t.a, t.b, ca.c * cb.c * sum(x.att * y.att * t.mutual) * count(*) / (sum(x.att * x.m) * sum(y.att * y.m)) AS predicted FROM mut t JOIN blk x ON x.f = t.a AND x.blk = t.blk JOIN blk y ON y.f = t.b AND y.blk = t.blk JOIN own ca ON ca.f = t.a JOIN own cb ON cb.f = t.b GROUP BY t.a, t.b, ca.c, cb.c),
tri AS (SELECT p.*, predicted, observed FROM pair p JOIN pre USING (a, b) JOIN obs USING (a, b)),
line AS (SELECT regr_slope(observed, predicted) AS s, regr_intercept(observed, predicted) AS t, sqrt(var_pop(observed) * (1 - corr(observed, predicted) ^ 2)) AS sd, corr(observed, predicted) AS r FROM tri WHERE innocent)
SELECT a, b, round(predicted, 7) AS predicted, round(observed, 7) AS observed, round((observed - (s * predicted + t)) / sd, 5) AS d, round(r, 6) AS pearson FROM tri, line""")
def triangle_test(spark, d):
    """Pairs of small frames made from embeddings: predicted and observed correlation, calibration and distance in one plan."""
    from luxtrace.operators.raster.triangle import triangle_test as test

    e, at = F.col("embedding"), F.sequence(F.lit(0), F.lit(63))
    k = F.transform(at, lambda i: F.sin(i * 1.7) * 0.4)
    light = F.transform(at, lambda i: F.get(e, i).cast("double") * 0.5 + 0.5)
    noise = F.transform(at, lambda i: 0.3 * (F.sin(i * 1.7) * 0.4) * (F.get(e, i).cast("double") * 0.5 + 0.5) + 0.05 * F.get(e, (i * 7 % 64).cast("int")).cast("double"))
    frames = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), light.alias("light"), noise.alias("noise"), k.alias("k"))
    ids = frames.select(F.col("frame_id").alias("a"))
    pairs = ids.select("a", F.explode(F.array(F.col("a") + 1, F.col("a") + 2)).alias("b"), (F.col("a") % 3 == 0).alias("innocent")).join(ids.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b", "innocent")
    out = test(frames, pairs, 4)
    return out.select("a", "b", F.round("predicted", 7).alias("predicted"), F.round("observed", 7).alias("observed"), F.round("d", 5).alias("d"), F.round("pearson", 6).alias("pearson"))
