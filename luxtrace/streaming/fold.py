"""The registry fold over a stream of event files, in Spark's own keyed state.

The state is a streaming aggregate in RocksDB, a row for each body, image or session and slot: its registrations have a slot
each, by position, and of a body the last change of owner and the last revocation have one. A batch reads and writes the slots
that its events name and no others, without leaving the JVM. A reset isn't written into them: resets are an entity too, and
which events count is decided when the state is read, by the same fold that reads a whole log. So events and resets may come
in any order, late or twice. Commits, attestations and challenges are never changed by later events; they go to a Parquet
table by Spark's own file sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.operators.event_fold import attestations, bodies_current, challenges, commits, images_current, of_last_epoch, positioned, sessions, with_epoch
from luxtrace.schema import EVENTS
from luxtrace.shared import cut

_NAMES = [f.name for f in EVENTS]
#: Kinds with a state, and the column that names the entity; a reset's entity is the registry.
KEYED = {"BodyRegistered": "body_id", "BodyTransferred": "body_id", "BodyRevoked": "body_id", "ImageRegistered": "image_hash", "SessionCommitted": "session_id"}
RECORDS = ("Commit", "Attested", "Challenged")
#: Of these only the last of each body can matter, wherever resets are: each has one slot. All others have their position.
_LAST = {"BodyTransferred": -1, "BodyRevoked": -2}


def _entity(kind: Column) -> Column:
    out = F.when(kind == "RegistryReset", F.lit(""))
    for name, column in KEYED.items():
        out = out.when(kind == name, F.coalesce(F.col(column), F.lit("")))
    return out


def _with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of its own for the stream, so that the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def _slot(kind: Column) -> Column:
    out = F.col("pos")
    for name, slot in _LAST.items():
        out = F.when(kind == name, F.lit(slot).cast("long")).otherwise(out)
    return out


def keyed_updates(events: DataFrame) -> DataFrame:
    """``family, entity, slot, event`` of the slots that a stream of events touches: the last event of each by position."""
    kind = F.col("kind")
    family = F.when(kind.startswith("Body"), "body").when(kind == "ImageRegistered", "image").when(kind == "SessionCommitted", "session").otherwise("registry")
    rows = positioned(events).where(kind.isin(*KEYED, "RegistryReset")).withColumn("family", family).withColumn("entity", _entity(kind)).withColumn("slot", _slot(kind))
    return rows.groupBy("family", "entity", "slot").agg(F.max(F.struct("pos", *_NAMES)).alias("event"))


def stream_registry(spark: SparkSession, source: str, checkpoint: str, *, files_per_batch: int = 4, available_now: bool = True, touched=None):
    """Follow a folder of Parquet event files; returns the query. The state is in ``checkpoint``.

    ``touched(batch, number)``, if given, gets the entities of each batch (``family, entity, n_slots``).
    """
    events = _with_rocksdb(spark).readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = keyed_updates(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    entities = lambda batch, n: touched(batch.groupBy("family", "entity").agg(F.count(F.lit(1)).alias("n_slots")), n)
    writer = writer.foreachBatch(entities) if touched else writer.format("noop")
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="3 seconds").start()


def stream_records(spark: SparkSession, source: str, table: str, checkpoint: str, *, files_per_batch: int = 4, available_now: bool = True):
    """Follow the same folder and write commits, attestations and challenges to the Parquet table ``table``, each once."""
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source).where(F.col("kind").isin(*RECORDS))
    writer = events.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="3 seconds").start()


def _has_batch(spark: SparkSession, checkpoint: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(path) and len(system.listStatus(path)) > 0


def _state_rows(spark: SparkSession, checkpoint: str, families: tuple[str, ...]) -> DataFrame:
    """The events in the state after the last batch, of ``families`` and the resets; none before the first batch."""
    if not _has_batch(spark, checkpoint):
        return spark.createDataFrame([], EVENTS)
    state = spark.read.format("statestore").load(checkpoint).where(F.col("key.family").isin(*families, "registry"))
    (last,) = state.schema["value"].dataType.names  # the aggregate's own state: the last event
    return state.select(F.col("value")[last].alias("event")).select(*[F.col("event")[n].alias(n) for n in _NAMES])


def current_log(spark: SparkSession, checkpoint: str, families: tuple[str, ...] = ("body", "image", "session")) -> DataFrame:
    """The state after the last batch as a folded log, read once by Spark's state reader; before the first batch an empty one."""
    return with_epoch(positioned(cut(_state_rows(spark, checkpoint, families))))


def bodies_from_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The current bodies after the batches so far."""
    return bodies_current(current_log(spark, checkpoint, ("body",)))


def images_from_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    return images_current(current_log(spark, checkpoint, ("image",)))


def sessions_from_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    return sessions(of_last_epoch(current_log(spark, checkpoint, ("session",))))


def records_log(spark: SparkSession, checkpoint: str, table: str) -> DataFrame:
    """Commits, attestations and challenges so far as a folded log; their epochs come from the resets in the state."""
    rows = spark.read.schema(EVENTS).parquet(table).dropDuplicates(["block_number", "log_index"])
    return with_epoch(positioned(cut(rows.unionByName(_state_rows(spark, checkpoint, ())))))


def commits_from_stream(spark: SparkSession, checkpoint: str, table: str) -> DataFrame:
    return commits(cut(records_log(spark, checkpoint, table)))  # folded once; the index reads it several times


def attestations_from_stream(spark: SparkSession, checkpoint: str, table: str) -> DataFrame:
    return attestations(records_log(spark, checkpoint, table))


def challenges_from_stream(spark: SparkSession, checkpoint: str, table: str) -> DataFrame:
    return challenges(records_log(spark, checkpoint, table))
