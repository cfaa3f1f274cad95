"""Logs, queues and caches that a stream or a periodic job keeps up: each operator is a function of tables, so it serves as the
body of ``foreachBatch`` and as a batch job alike, and a repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewater.workspace import materialize


def routed(kind: Column, pattern: str) -> Column:
    """Whether an event type meets a subscription: exact, ``*``, or ``prefix:*``."""
    if pattern == "*":
        return F.lit(True)
    return kind.startswith(pattern[:-1]) if pattern.endswith("*") else kind == pattern


class Bus:
    """Subscriptions by type pattern; ``publish`` hands each subscriber its part of a micro-batch, in order of subscription,
    after the batch was logged."""

    def __init__(self, log: Callable[[DataFrame, int], None] | None = None):
        self.log, self.subscribers = log, []

    def subscribe(self, pattern: str, handler: Callable[[DataFrame, int], None]) -> None:
        self.subscribers.append((pattern, handler))

    def publish(self, events: DataFrame, batch: int = 0, kind: str = "type") -> None:
        if self.log:
            self.log(events, batch)
        for pattern, handler in self.subscribers:
            handler(events.where(routed(F.col(kind), pattern)), batch)

    def start(self, stream: DataFrame, checkpoint: str, kind: str = "type"):
        return stream.writeStream.foreachBatch(lambda df, n: self.publish(df, n, kind)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered(new: DataFrame, last: int, *order: str) -> DataFrame:
    """The events with ``seq`` past ``last``, strictly rising in the given order: dealt by range, counted per partition and offset,
    so no task holds all of them."""
    placed = materialize(new.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before), "_p").withColumn("seq", F.lit(last) + F.col("_before") + F.col("_m") - F.col("_first") + 1).select("seq", *new.columns)


def appended(log: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """New log rows: events whose key the log lacks, numbered on from its last."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long"))).first()[0]
    return numbered(new.join(log.select(key), key, "left_anti"), last, *order)


def after(log: DataFrame, cursor: int, limit: int, pattern: str = "*", kind: str = "type") -> DataFrame:
    """Log rows past a cursor."""
    return log.where((F.col("seq") > cursor) & routed(F.col(kind), pattern)).orderBy("seq").limit(limit)


def to_scan(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Inputs (path, fingerprint) that no finished checkpoint covers: new or changed ones."""
    return inputs.join(done.where("finished").select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def submitted(tasks: DataFrame, known: DataFrame) -> DataFrame:
    """What happens to submitted tasks (kind, input_hash, task): of equal ones the first counts. ``cached`` if one is done,
    ``joined`` if one waits or runs, ``retry`` if all failed, ``new`` else."""
    state = known.groupBy("kind", "input_hash").agg(F.max(F.struct((F.col("status") == "done").alias("d"), F.col("status").isin("pending", "executing").alias("o"))).alias("s"))
    first = tasks.groupBy("kind", "input_hash").agg(F.min("task").alias("task"), F.count("*").alias("submissions"))
    verdict = F.when(F.col("s").isNull(), "new").when(F.col("s.d"), "cached").when(F.col("s.o"), "joined").otherwise("retry")
    return first.join(state, ["kind", "input_hash"], "left").select("kind", "input_hash", "task", "submissions", verdict.alias("verdict"))


def recovered(tasks: DataFrame, paused: list[str]) -> DataFrame:
    """Tasks after a restart: those that were running wait again, those of paused kinds are held."""
    return tasks.withColumn("status", F.when(F.col("kind").isin(paused) & F.col("status").isin("pending", "executing"), "paused").when(F.col("status") == "executing", "pending").otherwise(F.col("status")))


def tails(old: DataFrame, new: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The last ``most`` items of each conversation after new ones: only the short tails and the new items are read."""
    both = old.unionByName(new).dropDuplicates([key, order])
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= most).drop("_r")


def sequence_counts(tail: DataFrame, key: str, order: str, item: str, length: int, fresh: DataFrame) -> DataFrame:
    """How often each sequence of ``length`` items ends in a fresh item: what an incremental index adds to its counts."""
    by = Window.partitionBy(key).orderBy(order)
    before = [F.lag(item, k).over(by) for k in range(length - 1, -1, -1)]
    named = tail.withColumn("signature", F.when(F.lag(item, length - 1).over(by).isNotNull(), F.concat_ws(">", *before)))
    return named.join(fresh.select(key, order), [key, order], "left_semi").where("signature is not null").groupBy("signature").agg(F.count("*").alias("n"))


LEASE_STEPS = {"claim": ("free", "claimed"), "begin": ("claimed", "begun"), "complete": ("begun", "done"), "mark_unknown": ("begun", "unknown"), "reconcile": ("unknown", "free")}


def leases(operations: DataFrame) -> DataFrame:
    """A leased work queue replayed: (task, state, owner, token, until, refused) from operations (task, seq, op, owner, token, at,
    seconds). A claim takes a free or expired task and raises its fencing token; every other step needs its owner and
    current token, and ``renew`` moves the end of the lease. Operations that don't fit are refused and counted. The fold is
    sequential within a task by nature; tasks are dealt over the cluster."""
    step = F.struct("seq", "op", "owner", "token", "at", "seconds")
    log = operations.groupBy("task").agg(F.sort_array(F.collect_list(step)).alias("log"))
    none = F.struct(F.lit("free").alias("state"), F.lit(None).cast("string").alias("owner"), F.lit(0).cast("long").alias("token"), F.lit(0).cast("long").alias("until"), F.lit(0).cast("long").alias("refused"))

    def fold(s: Column, o: Column) -> Column:
        over = s["state"].isin("claimed", "begun") & (o["at"] >= s["until"])
        free = (s["state"] == "free") | (over & (s["state"] == "claimed"))
        mine = (s["owner"] == o["owner"]) & (s["token"] == o["token"]) & ~over
        end = o["at"] + o["seconds"]
        become = lambda state, owner, token, until: F.struct(state.alias("state"), owner.alias("owner"), token.alias("token"), until.alias("until"), s["refused"].alias("refused"))
        out = F.struct(s["state"].alias("state"), s["owner"].alias("owner"), s["token"].alias("token"), s["until"].alias("until"), (s["refused"] + 1).alias("refused"))
        out = F.when((o["op"] == "renew") & mine & s["state"].isin("claimed", "begun"), become(s["state"], s["owner"], s["token"], end)).otherwise(out)
        for op, (before, to) in LEASE_STEPS.items():
            if op == "claim":
                out = F.when((o["op"] == op) & free, become(F.lit(to), o["owner"], s["token"] + 1, end)).otherwise(out)
            elif op == "reconcile":
                out = F.when((o["op"] == op) & (s["state"] == before), become(F.lit(to), F.lit(None).cast("string"), s["token"], F.lit(0).cast("long"))).otherwise(out)
            else:
                out = F.when((o["op"] == op) & mine & (s["state"] == before), become(F.lit(to), s["owner"], s["token"], s["until"])).otherwise(out)
        return out

    return log.select("task", F.aggregate("log", none, fold).alias("s")).select("task", "s.*")


class Progress(StreamingQueryListener):
    """Progress of queries as (query, batch, rows), handed on to a callback; returning False from it stops the query."""

    def __init__(self, spark: SparkSession, on_progress: Callable[[str, int, int], bool | None]):
        self.spark, self.on_progress = spark, on_progress

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.on_progress(p.name or str(p.id), p.batchId, p.numInputRows) is False:
            query = self.spark.streams.get(str(p.id))
            if query is not None:
                query.stop()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
