"""Replaying untrusted registry calls: which are accepted, and with which error the others are refused.

Calls of bodies are ranged by body and position. A body that spans ranges is a chain of runs; what a run does is a map from
the state before it to the state after it, and maps compose, so a prefix scan gives the state in which each run begins and
all ranges are replayed at once. A body with all the calls is shared out like many bodies.

Images need their body's state at the call and, mutually, other images: a call is accepted if it is the first acceptable one
for its hash and its parent was accepted before. Only images that edits connect decide one another, so each connected part
is one pass in order of position; a part too large for a pass is solved by rounds over all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from luxtrace.operators.lineage import connected_parts
from luxtrace.operators.ordered import as_of, running_sum
from luxtrace.schema import ZERO_WORD
from luxtrace.shared import cut, drop

ZERO_ADDRESS = "0x" + "0" * 40
#: Calls of a connected part of images that one task replays in order; more are solved by rounds.
PASS_CALLS = 1 << 20
#: States of a body: none, owned and revoked; the last two with the owner.
_NONE, _OWNED, _REVOKED = "", "o", "r"

#: One row for each call; columns that a function lacks are null.
CALLS = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("call_id", T.LongType()), ("sender", T.StringType()), ("function", T.StringType()), ("block_timestamp", T.LongType()), ("body_id", T.StringType()), ("commitment", T.StringType()), ("derived_id", T.StringType()),
        ("to_address", T.StringType()), ("image_hash", T.StringType()), ("parent_hash", T.StringType()), ("level", T.IntegerType()), ("pce", T.LongType()), ("session_id", T.StringType()), ("merkle_root", T.StringType()), ("subject", T.StringType()),
    )]
)


def with_epochs(calls: DataFrame, *, admin: str | None) -> DataFrame:
    """Calls with ``epoch``: resets by the admin of a test registry before each; ``admin`` None means no test registry."""
    resets = (F.col("function") == "resetAll") & (F.lower("sender") == F.lit((admin or "").lower())) & F.lit(admin is not None)
    return running_sum(calls, "call_id", resets, "epoch", inclusive=False)


def _missing(word: Column) -> Column:
    return word.isNull() | (F.lower(word) == ZERO_WORD)


def _streamed(df: DataFrame, rows: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``rows`` over a task's rows in order, from and to Arrow batches."""
    out = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
        for r in rows(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            held.append(r)
            if len(held) == 8192:
                yield pack()
                held = []
        if held:
            yield pack()

    return df.mapInArrow(run, out)


def _step(state: str, function: str, sender: str, to: str, empty: bool, derived: bool) -> tuple[str, str | None]:
    """The state after one call, and its error."""
    if function == "registerBody":
        error = "empty commitment" if empty else "bodyId must derive from commitment" if not derived else "body already registered" if state else None
        return (state, error) if error else (_OWNED + sender, None)
    if not state:
        return state, "unknown body"
    if state[1:] != sender:
        return state, "not the body owner"
    if state[0] == _REVOKED:
        return state, "already revoked" if function == "revokeBody" else "body revoked"
    if function == "revokeBody":
        return _REVOKED + sender, None
    return (state, "zero owner") if to == ZERO_ADDRESS else (_OWNED + to, None)


class _Run:
    """What some calls in order do to each state they may begin in; states that aren't named stay as they are.

    Beginnings that have come to the same state are one group from then on, so a call costs the same whatever their number.
    """

    def __init__(self):
        self.begins: dict[str, int] = {}
        self.up: list[int] = []
        self.now: dict[str, int] = {}  # state to group
        self._group(_NONE)

    def _root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def _move(self, k: int, state: str) -> None:
        there = self.now.get(state)
        if there is None:
            self.now[state] = k
        else:
            self.up[k] = there

    def _group(self, state: str) -> None:
        """A state first named here has not been touched so far: whoever begins in it is in it."""
        if state not in self.begins:
            self.begins[state] = len(self.up)
            self.up.append(len(self.up))
            self._move(len(self.up) - 1, state)

    def call(self, function: str, sender: str, to: str, empty: bool, derived: bool) -> None:
        state = _NONE if function == "registerBody" else _OWNED + sender
        self._group(state)
        after, error = _step(state, function, sender, to, empty, derived)
        if not error and after != state and state in self.now:
            self._move(self.now.pop(state), after)

    def mapping(self) -> Iterator[tuple[str, str]]:
        of = {k: state for state, k in self.now.items()}
        return ((state, of[self._root(k)]) for state, k in self.begins.items())


_CALL = ("epoch", "body_id", "part", "call_id", "function", "sender", "to", "empty", "derived")


def _runs(calls: DataFrame) -> DataFrame:
    """``epoch, body_id, part, begin, end``: the map of each body's run in each part."""

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        key, run = None, None
        for epoch, body, part, _, *call in it:
            if (epoch, body, part) != key:
                if run:
                    yield from ((*key, a, b) for a, b in run.mapping())
                key, run = (epoch, body, part), _Run()
            run.call(*call)
        if run:
            yield from ((*key, a, b) for a, b in run.mapping())

    return _streamed(calls, rows, "epoch long, body_id string, part int, begin string, end string")


def _entries(runs: DataFrame, first: DataFrame, span: int) -> DataFrame:
    """``epoch, body_id, part, state`` in which each run but a body's first begins: a prefix scan over the runs' maps.

    Each round composes every run's map with that of the runs before it, over twice as many runs as the round before. Maps
    that reach back to the body's first run have one beginning left, none.
    """
    keys = ["epoch", "body_id", "part"]
    of_first = first.select("epoch", "body_id", "first")
    whole = cut(runs.join(of_first, ["epoch", "body_id"]).where(f"part > first OR begin = '{_NONE}'"))
    d = 1
    while d < span:
        here = whole.select(*keys, F.col("begin").alias("between"), "end")
        before = whole.select("epoch", "body_id", (F.col("part") + d).alias("part"), "begin", F.col("end").alias("between"), "first").join(here.select(*keys).distinct(), keys)
        composed = before.join(here, [*keys, "between"], "left").select(*keys, "begin", F.coalesce("end", "between").alias("end"), "first")
        only_here = whole.join(before.select(*keys, "begin"), [*keys, "begin"], "left_anti").select(*composed.columns)
        wider = cut(composed.union(only_here).where(f"part - {2 * d - 1} > first OR begin = '{_NONE}'"))
        drop(whole)
        whole, d = wider, 2 * d
    return whole.where(f"begin = '{_NONE}'").select("epoch", "body_id", (F.col("part") + 1).alias("part"), F.col("end").alias("state"))


def body_calls(calls: DataFrame) -> DataFrame:
    """``call_id, epoch, body_id, error, owner, revoked``: outcome of body calls and the body's state after each.

    ``derived_id`` is the id that follows from the commitment.
    """
    names = F.col("function").isin("registerBody", "revokeBody", "transferBody")
    own = calls.where(names).select(
        "epoch", "body_id", "call_id", "function", F.coalesce(F.lower("sender"), F.lit("")).alias("sender"), F.coalesce(F.lower("to_address"), F.lit(ZERO_ADDRESS)).alias("to"), _missing(F.col("commitment")).alias("empty"), F.col("derived_id").eqNullSafe(F.col("body_id")).alias("derived"),
    )
    order = ["epoch", "body_id", "call_id"]
    ranged = cut(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    spans = cut(ranged.groupBy("epoch", "body_id").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last"))  # a body for each range at most
    span = spans.agg(F.max(F.col("last") - F.col("first"))).first()[0]
    by_part = lambda df: df.repartition("part").sortWithinPartitions("part", *order)
    if span:
        long = ranged.join(spans, ["epoch", "body_id"]).where("part < last").select(*_CALL)
        entries = _entries(_runs(by_part(long)), spans, span)
        given = ranged.join(entries, ["epoch", "body_id", "part"], "left")
    else:
        given = ranged.withColumn("state", F.lit(None).cast("string"))

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        key, state = None, _NONE
        for epoch, body, part, call, *what, entry in it:
            if (epoch, body, part) != key:
                key, state = (epoch, body, part), entry or _NONE
            state, error = _step(state, *what)
            yield call, epoch, body, error, state[1:] or None, state[:1] == _REVOKED

    return _streamed(by_part(given.select(*_CALL, "state")), rows, "call_id long, epoch long, body_id string, error string, owner string, revoked boolean")


def _by_rounds(good: DataFrame) -> DataFrame:
    """``epoch, h, at``: of each hash the first acceptable call, by rounds that each look one generation further."""
    first = cut(good.where("parent IS NULL").groupBy("epoch", "h").agg(F.min("call_id").alias("at")))
    while True:
        known = first.select(F.col("epoch").alias("__e"), F.col("h").alias("__h"), F.col("at").alias("__at"))
        fitting = good.join(known, (F.col("epoch") == F.col("__e")) & (F.col("parent") == F.col("__h")), "left").where("parent IS NULL OR __at < call_id")
        new = cut(fitting.groupBy("epoch", "h").agg(F.min("call_id").alias("at")))
        done = new.join(first, ["epoch", "h", "at"], "left_anti").isEmpty()
        drop(first)
        if done:
            return new
        first = new


def _by_passes(calls: DataFrame) -> DataFrame:
    """The same from ``part, epoch, h, parent, call_id``: each part's calls in order, with the hashes accepted so far."""

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        part, accepted = None, set()
        for of, epoch, h, parent, call in it:
            if of != part:
                part, accepted = of, set()
            if h not in accepted and (parent is None or parent in accepted):
                accepted.add(h)
                yield epoch, h, call

    return _streamed(calls.repartition("part").sortWithinPartitions("part", "call_id"), rows, "epoch long, h string, at long")


def first_acceptable(good: DataFrame, most: int = PASS_CALLS) -> DataFrame:
    """``epoch, h, at`` of calls (``epoch, h, parent, call_id``) that only other images can refuse.

    Hashes without an edit in or out take their first call. The others fall into the parts that edits connect; parts of up
    to ``most`` calls are replayed in one pass each, larger ones by rounds.
    """
    node = lambda c: F.concat_ws("|", F.col("epoch").cast("string"), c)
    edges = good.where("parent IS NOT NULL").select(node("h").alias("a"), node("parent").alias("b")).distinct()
    parts = connected_parts(edges)
    placed = cut(good.join(parts, node("h") == F.col("node"), "left").select("part", "epoch", "h", "parent", "call_id"))
    out = placed.where("part IS NULL").groupBy("epoch", "h").agg(F.min("call_id").alias("at"))
    large = placed.where("part IS NOT NULL").groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("part")
    out = out.union(_by_passes(placed.where("part IS NOT NULL").join(large, "part", "left_anti").select("part", "epoch", "h", "parent", "call_id")))
    return out if large.isEmpty() else out.union(_by_rounds(placed.join(large, "part", "left_semi").drop("part")))


def image_calls(calls: DataFrame, folded_bodies: DataFrame) -> DataFrame:
    """``call_id, error`` of registerImage calls; ``folded_bodies`` is what ``body_calls`` gives."""
    key = F.concat_ws("|", F.col("epoch").cast("string"), F.col("body_id"))
    own = calls.where(F.col("function") == "registerImage").withColumn("__key", key)
    state = folded_bodies.where("error IS NULL").select(key.alias("__key"), F.col("call_id").alias("__at"), "owner", "revoked")
    own = as_of(own, state, "__key", "call_id", change_pos="__at", values={"owner": "body_owner", "revoked": "body_revoked"})
    body_error = (
        F.when(F.col("body_owner").isNull(), "unknown body").when(F.col("body_revoked"), "body revoked").when(F.lower("sender") != F.col("body_owner"), "not the body owner").when(_missing(F.col("image_hash")), "empty image hash")
    )
    own = cut(own.withColumn("early", body_error).withColumn("parent", F.when(~_missing(F.col("parent_hash")), F.lower("parent_hash"))).withColumn("h", F.lower("image_hash")))
    first = cut(first_acceptable(own.where("early IS NULL AND level BETWEEN 0 AND 2").select("epoch", "h", "parent", "call_id")))
    mine = first.select(F.col("epoch").alias("__e1"), F.col("h").alias("__h1"), F.col("at").alias("mine"))
    theirs = first.select(F.col("epoch").alias("__e2"), F.col("h").alias("__h2"), F.col("at").alias("theirs"))
    out = own.join(mine, (F.col("epoch") == F.col("__e1")) & (F.col("h") == F.col("__h1")), "left").join(theirs, (F.col("epoch") == F.col("__e2")) & (F.col("parent") == F.col("__h2")), "left")
    error = (
        F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("mine") < F.col("call_id"), "image already registered").when(F.col("level").isNull() | ~F.col("level").between(0, 2), "modification level out of range")
        .when(F.col("parent").isNotNull() & ~F.coalesce(F.col("theirs") < F.col("call_id"), F.lit(False)), "unknown parent image")
    )
    return out.select("call_id", error.alias("error"))


def other_calls(calls: DataFrame, *, admin: str | None) -> DataFrame:
    """``call_id, error`` of sessions, attestations, challenges, commits and resets."""
    own = calls.where(~F.col("function").isin("registerBody", "revokeBody", "transferBody", "registerImage"))
    whole = (F.col("function") == "commitSession") & ~_missing(F.col("merkle_root")) & ~_missing(F.col("session_id"))
    first = own.where(whole).groupBy("epoch", F.lower("session_id").alias("__s")).agg(F.min("call_id").alias("__first")).withColumnRenamed("epoch", "__e")
    out = own.join(first, (F.col("epoch") == F.col("__e")) & (F.lower("session_id") == F.col("__s")), "left")
    session = F.when(_missing(F.col("merkle_root")), "empty root").when(_missing(F.col("session_id")), "empty session").when(F.col("__first") < F.col("call_id"), "session already committed")
    reset = F.lit("not a test registry") if admin is None else F.when(F.lower("sender") != admin.lower(), "not the admin")
    error = F.when(F.col("function") == "commitSession", session).when(F.col("function").isin("attest", "challenge"), F.when(_missing(F.col("subject")), "empty subject")).when(F.col("function") == "resetAll", reset)
    return out.select("call_id", error.alias("error"))


def replay(calls: DataFrame, *, admin: str | None = None) -> DataFrame:
    """``call_id, accepted, error`` for every call."""
    timed = cut(with_epochs(calls, admin=admin))
    folded = cut(body_calls(timed))
    out = folded.select("call_id", "error").union(image_calls(timed, folded)).union(other_calls(timed, admin=admin))
    return out.select("call_id", F.col("error").isNull().alias("accepted"), "error")
