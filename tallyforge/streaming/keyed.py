"""Runs as they arrive, kept by seed: completions, seeds that have gone quiet, and a summary that is carried forward.

Of each run the row of the largest sequence counts; a delivery that is repeated, late or out of order is settled by that.
For every seed that a batch touches there is what the seed counted before, to be taken back, and what it counts now; the
summary is the running sum of these.

Runs lie in tables of the shared folder, and a batch is a few native joins and aggregations over its own rows and the runs
of the seeds that it touches; it scans the tables for these. Where seeds that go quiet are wanted (``idle_seconds``), the
runs of a seed are a map in the state store of the query instead, which has timers; its state function is Python, with
a call and several exchanges with the store for each seed that a batch touches. A folder belongs to one of both ways.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyforge.operators import runs
from tallyforge.sources.folders import deleted, shared_folder
from tallyforge.streaming.incremental import COMPACT, run_log_stream, whole_tables

#: What a run is, besides its key and the columns of its sequence.
RUN = ("f_rate double", "s_rate double", "n_req long", "total_iterations int", "end_time string", "success boolean")
#: What a seed adds to the summary.
SHARE = ("actual_k", "first_success", "functional_pass", "first_s", "best_s", "n_req", "first_iterations")
EVENT = "uuid {0}, kind string, sign int, " + ", ".join(f"{c} double" for c in SHARE)
_EVENT = Row("uuid", "kind", "sign", *SHARE)
#: Sums of shares are decimals, so that what is taken back cancels exactly.
EXACT = "decimal(38,12)"
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _share(run: str, k: int) -> tuple[list[Column], Column, Column]:
    """Aggregates over the runs of a seed, whose column ``run`` is null for those that aren't there; from these, what the
    seed adds to the summary (null without a valid run 0) and whether it is complete.

    All of them hold numbers only, so that Spark aggregates by hashing; a struct would take a sort on both sides of the shuffle.
    """
    there, of = F.col(run).isNotNull(), lambda c: F.col(f"{run}.{c}")
    valid = F.coalesce((of("end_time") != "") & (of("total_iterations") > 0), F.lit(False))
    # Of a null index and 0, both of which are run 0, the latter.
    first = F.when(valid & runs.is_first(), F.col("run_index").isNull().cast("int"))
    firsts = ("success", "s_rate", "n_req", "total_iterations")
    sums = [
        F.count_if(valid).alias(f"{run}_k"), F.bool_or(valid & of("success")).alias(f"{run}_passed"), F.max(F.when(valid, of("s_rate"))).alias(f"{run}_best"),
        F.min(first).alias(f"{run}_first"), *(F.min_by(of(c), first).alias(f"{run}_first_{c}") for c in firsts),
        F.count_if(there & F.col("run_index").isNotNull()).alias(f"{run}_n"), F.bool_or(there & runs.is_first()).alias(f"{run}_has"),
    ]
    own = lambda c: F.col(f"{run}_first_{c}")
    values = (F.col(f"{run}_k"), own("success"), F.col(f"{run}_passed"), own("s_rate"), F.col(f"{run}_best"), own("n_req"), own("total_iterations"))
    share = F.struct(*(F.coalesce(v.cast("double"), F.lit(0.0)).alias(c) for c, v in zip(SHARE, values, strict=True)))
    return sums, F.when(F.col(f"{run}_first").isNotNull(), share), F.col(f"{run}_has") & (F.col(f"{run}_n") >= k)


def _events(pairs: DataFrame, k: int) -> DataFrame:
    """EVENT of rows (uuid, run_index, before, after): the run as it was, null for a new one, and as it is.

    Without a column ``before`` all runs are new.
    """
    new, now, complete = _share("after", k)
    if "before" in pairs.columns:
        old, was, was_complete = _share("before", k)
    else:
        old, was, was_complete = [], F.when(F.lit(False), now), F.lit(False)
    seeds = pairs.groupBy("uuid").agg(*old, *new).select("uuid", was.alias("was"), now.alias("now"), (complete & ~was_complete).alias("completed"))
    other, zeros = ~F.col("was").eqNullSafe(F.col("now")), F.struct(*(F.lit(0.0).alias(c) for c in SHARE))
    event = lambda when, kind, sign, share: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(sign).alias("sign"), share.alias("share")))
    found = F.array(
        event(other & F.col("was").isNotNull(), "share", -1, F.col("was")), event(other & F.col("now").isNotNull(), "share", 1, F.col("now")),
        event(F.col("completed"), "completed", 0, F.coalesce("now", zeros)),
    )
    rows = seeds.select("uuid", F.explode(F.array_compact(found)).alias("e"))
    return rows.select("uuid", "e.kind", "e.sign", "e.share.*")


class SeedRuns(StatefulProcessor):
    """The runs of a seed; gives shares (sign -1 and 1), ``completed`` once, and ``quiet`` when ``idle_ms`` pass without a delivery
    before the seed is complete."""

    def __init__(self, sequence: Sequence[str], k: int, idle_ms: int | None):
        self.sequence, self.k, self.idle_ms = list(sequence), k, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = ", ".join([*self.sequence, *RUN])
        self.names = [c.split()[0] for c in (*self.sequence, *RUN)]
        self.handle = handle
        self.runs = handle.getMapState("runs", "known boolean, run_index int", columns)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Each run is read and written once for a batch, however often it was delivered.
        latest: dict[tuple, tuple] = {}
        for row in rows:
            run = (row["run_index"] is not None, row["run_index"] or 0)
            new = tuple(row[c] for c in self.names)
            if run not in latest or self._order(new) > self._order(latest[run]):
                latest[run] = new
        held = {tuple(k): tuple(v) for k, v in self.runs.iterator()}
        before, was_complete = self._share(held), self._complete(held)
        for run, new in latest.items():
            if run not in held or self._order(new) > self._order(held[run]):
                held[run] = new
                self.runs.updateValue(run, new)
        after = self._share(held)
        if before != after:
            for sign, share in ((-1, before), (1, after)):
                if share:
                    yield _EVENT(key[0], "share", sign, *share)
        complete = self._complete(held)
        if complete and not was_complete:
            yield _EVENT(key[0], "completed", 0, *(after or [0.0] * len(SHARE)))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not complete:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        share = self._share({tuple(k): tuple(v) for k, v in self.runs.iterator()})
        yield _EVENT(key[0], "quiet", 0, *(share or [0.0] * len(SHARE)))

    def close(self) -> None:
        pass

    def _complete(self, held: dict[tuple, tuple]) -> bool:
        """runs.completed_seeds of one seed. Runs are never taken back, so it stays complete."""
        return len({n for known, n in held if known}) >= self.k and any(not n for _, n in held)

    def _order(self, run: tuple) -> tuple:
        """Nulls come first, as in Spark."""
        return tuple((v is not None, v) for v in run[: len(self.sequence)])

    def _share(self, held: dict[tuple, tuple]) -> list[float] | None:
        """passk_per_seed of one seed, None where it has no valid run 0."""
        at = {c: i for i, c in enumerate(self.names)}
        valid = [(n, run) for (_, n), run in held.items() if run[at["end_time"]] and (run[at["total_iterations"]] or 0) > 0]
        first = min((v for v in valid if v[0] == 0), default=None, key=lambda v: v[0])
        if first is None:
            return None
        of = lambda c: first[1][at[c]]
        best = max((run[at["s_rate"]] for _, run in valid if run[at["s_rate"]] is not None), default=0.0)
        passed = any(run[at["success"]] for _, run in valid)
        return [float(x or 0) for x in (len(valid), of("success"), passed, of("s_rate"), best, of("n_req"), of("total_iterations"))]


def seed_events(stream: DataFrame, k: int, idle_seconds: float | None = None) -> DataFrame:
    """The events (EVENT) of a stream of runs (uuid, run_index, RUN, seq); seq is a struct."""
    sequence = [f"__s{i} {f.dataType.simpleString()}" for i, f in enumerate(stream.schema["seq"].dataType.fields)]
    fields = [F.col(f"seq.{f.name}").alias(f"__s{i}") for i, f in enumerate(stream.schema["seq"].dataType.fields)]
    kept = [F.col(c.split()[0]).cast(c.split()[1]) for c in RUN]
    rows = stream.select("uuid", F.col("run_index").cast("int").alias("run_index"), *fields, *kept)
    kind = stream.schema["uuid"].dataType.simpleString()
    idle = None if idle_seconds is None else int(idle_seconds * 1000)
    mode = "None" if idle is None else "ProcessingTime"
    return rows.groupBy("uuid").transformWithState(SeedRuns(sequence, k, idle), EVENT.format(kind), "Update", mode)


def totals_of(events: DataFrame, k: int) -> DataFrame:
    """The signed sums of the shares of events, one row."""
    s = lambda c: F.coalesce(F.sum(F.col("sign") * c.cast("decimal(25,12)")), F.lit(0)).cast(EXACT)
    one, full = F.lit(1), F.when(F.col("actual_k") == k, 1).otherwise(0)
    degraded = F.when((F.col("actual_k") > 0) & (F.col("actual_k") < k), 1).otherwise(0)
    products = {"first_weight": F.col("first_s") * F.col("n_req"), "best_weight": F.col("best_s") * F.col("n_req")}
    plain = {c: F.col(c) for c in ("actual_k", "first_success", "functional_pass", "n_req", "first_iterations")}
    sums = {"seeds": one, "full": full, "degraded": degraded, **plain, **products}
    return events.where("kind = 'share'").agg(*(s(c).alias(name) for name, c in sums.items()))


def summary_of(totals: DataFrame) -> DataFrame:
    """runs.passk_summary from totals."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return totals.select(
        F.col("seeds").cast("long").alias("total_seeds"), F.col("full").cast("long").alias("seeds_with_full_k"), F.col("degraded").cast("long").alias("seeds_degraded"),
        ratio("actual_k", "seeds").alias("avg_actual_k"), ratio("first_success", "seeds").alias("pass1_functional"), ratio("functional_pass", "seeds").alias("passk_functional"),
        ratio("first_weight", "n_req").alias("pass1_security"), ratio("best_weight", "n_req").alias("passk_security"), ratio("first_iterations", "seeds").alias("avg_iterations"),
    )


class Live:
    """Runs, events and totals of a stream, as tables of each batch below a folder that a restarted stream gives again.

    A batch that comes again replaces its own tables. Totals are one row; only those of the last two batches are kept.
    ``runs-n`` has the latest runs of batch n alone, ``all-n`` those up to batch n; one of these is written in ``compact``
    batches, of what came before the batch, and what it covers is deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, k: int, compact: int = COMPACT):
        self.spark, self.folder, self.k, self.compact = spark, folder, k, compact

    def _held(self, before: int) -> tuple[DataFrame | None, list[str]]:
        """Rows of the runs that arrived before a batch, several for some, and the tables that have them."""
        last = max((n for n in whole_tables(self.spark, self.folder, "all") if n < before), default=-1)
        names = [f"all-{last}"] * (last >= 0) + [f"runs-{n}" for n in whole_tables(self.spark, self.folder, "runs") if last < n < before]
        tables = [self.spark.read.parquet(f"{self.folder}/{n}") for n in names]
        return (reduce(DataFrame.unionByName, tables) if tables else None), names

    def arrived(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The events of a batch of runs (uuid, run_index, RUN, seq), whose runs are kept."""
        kept = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in RUN]
        rows = batch.select("uuid", F.col("run_index").cast("int").alias("run_index"), F.struct(*kept).alias("run"), "seq")
        # Of equal sequences the first one stays, so that what is taken back is what was counted.
        runs.upsert_latest(rows).withColumn("at", F.struct("seq", F.lit(-batch_id).alias("n"))).drop("seq").write.mode("overwrite").parquet(f"{self.folder}/runs-{batch_id}")
        new = self.spark.read.parquet(f"{self.folder}/runs-{batch_id}")
        held, names = self._held(batch_id)
        if len(names) > self.compact:
            runs.upsert_latest(held, seq="at").write.mode("overwrite").parquet(f"{self.folder}/all-{batch_id - 1}")
            for name in names:
                if name != f"all-{batch_id - 1}":
                    deleted(self.spark, f"{self.folder}/{name}")
            held = self.spark.read.parquet(f"{self.folder}/all-{batch_id - 1}")
        if held is None:
            return _events(new.select("uuid", "run_index", F.col("run").alias("after")), self.k)
        touched = new.select(F.col("uuid").alias("__uuid")).distinct()
        held = held.join(touched, F.col("uuid").eqNullSafe(F.col("__uuid")), "left_semi").withColumn("old", F.lit(True))
        both = held.unionByName(new.withColumn("old", F.lit(False)))
        before, after = F.max_by("run", F.when(F.col("old"), F.col("at"))), F.max_by("run", "at")
        return _events(both.groupBy("uuid", "run_index").agg(before.alias("before"), after.alias("after")), self.k)

    def totals(self, before: int | None = None) -> DataFrame:
        done = [n for n in whole_tables(self.spark, self.folder, "totals") if before is None or n < before]
        if done:
            return self.spark.read.parquet(f"{self.folder}/totals-{done[-1]}")
        return totals_of(self.spark.createDataFrame([], EVENT.format("long")), self.k)

    def summary(self) -> DataFrame:
        return summary_of(self.totals())

    def events(self, kind: str) -> DataFrame:
        """The seeds of all events of a kind so far."""
        done = whole_tables(self.spark, self.folder, "events")
        empty = self.spark.createDataFrame([], EVENT.format("long"))
        rows = self.spark.read.parquet(*(f"{self.folder}/events-{n}" for n in done)) if done else empty
        return rows.where(F.col("kind") == kind).select("uuid", *SHARE)

    def add(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Takes the events of a batch; gives its seeds of kind completed or quiet."""
        with _cached(batch) as rows:
            both = self.totals(batch_id).unionByName(totals_of(rows, self.k))
            both.agg(*(F.sum(c).cast(EXACT).alias(c) for c in both.columns)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/totals-{batch_id}")
            rows.where("kind <> 'share'").write.mode("overwrite").parquet(f"{self.folder}/events-{batch_id}")
        for n in whole_tables(self.spark, self.folder, "totals"):
            if n < batch_id - 1:
                deleted(self.spark, f"{self.folder}/totals-{n}")
        return self.spark.read.parquet(f"{self.folder}/events-{batch_id}")


@contextlib.contextmanager
def _cached(rows: DataFrame) -> Iterator[DataFrame]:
    """The rows of a batch, read twice; what is lost is computed again from the state."""
    rows.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def follow(
    stream: DataFrame,
    live: Live,
    trigger: dict | None = None,
    on_event: Callable[[DataFrame, int], None] | None = None,
    on_update: Callable[[DataFrame, int], None] | None = None,
    idle_seconds: float | None = None,
):
    """Starts the query; trigger as for ``DataStreamWriter.trigger``, by default what is there now.

    on_event gets the seeds that a batch completed or that went quiet, on_update the summary behind the batch. Seeds go
    quiet only where idle_seconds is given.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        events = live.add(batch if idle_seconds is not None else live.arrived(batch, batch_id), batch_id)
        if on_event:
            on_event(events, batch_id)
        if on_update:
            on_update(live.summary(), batch_id)

    spark = live.spark
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)  # a query keeps the settings that it starts with
    try:
        source = stream if idle_seconds is None else seed_events(stream, live.k, idle_seconds)
        writer = source.writeStream.outputMode("update").foreachBatch(handle)
        return writer.option("checkpointLocation", f"{live.folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.unset(_STORE[0]) if before is None else spark.conf.set(_STORE[0], before)


def live_results(spark: SparkSession, path: str, k: int, files: int | None = None, folder: str | None = None) -> Live:
    """Reads the run log of a table as a stream of files to its present end; a folder of an earlier run is gone on with."""
    live = Live(spark, folder or shared_folder(spark), k)
    follow(run_log_stream(spark, path, files), live).awaitTermination()
    return live

