"""Results that arrive over time: every micro-batch is upserted, the summary is that of the batch query.

State lies in the shared folder as tables: ``base-n`` has the latest row for each key up to batch n, ``delta-n`` the
latest rows of batch n alone, ``done-n`` the seeds that batch n completed. Only tables that were written whole count, so
a stream may be stopped at any point and restarted: a batch that comes again replaces its own tables and announces the
same seeds. A batch writes what it brought; the base is rewritten once in ``COMPACT`` batches, and what it covers is
deleted. A delivery that is repeated replaces itself; dropDuplicates would keep the first one and be wrong here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import runs
from tallyforge.plans import bindings as B
from tallyforge.sources.folders import shared_folder

COMPACT = 16


def whole_tables(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the batches whose table ``kind-n`` in the folder is whole, in order."""
    of = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    system = of("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(of("")):
        return []
    names = [x.getPath().getName() for x in system.listStatus(of(""))]
    numbers = sorted(int(n.rpartition("-")[2]) for n in names if n.startswith(f"{kind}-"))
    return [n for n in numbers if system.exists(of(f"{kind}-{n}/_SUCCESS"))]


class LatestRuns:
    """Keyed state over micro-batches, below a folder that a restarted stream gives again."""

    def __init__(self, spark: SparkSession, folder: str, keys=("uuid", "run_index"), seq: str = "seq", compact: int = COMPACT):
        self.spark, self.folder, self.keys, self.seq, self.compact = spark, folder, list(keys), seq, compact

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _written(self, kind: str) -> list[int]:
        return whole_tables(self.spark, self.folder, kind)

    def _drop(self, name: str) -> None:
        path, system = self._path(name)
        system.delete(path, True)

    def _read(self, names: list[str]) -> DataFrame | None:
        tables = [self.spark.read.parquet(f"{self.folder}/{n}") for n in names]
        return reduce(DataFrame.unionByName, tables) if tables else None

    def update(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The state after the batch; applying a batch again changes nothing."""
        runs.upsert_latest(batch, self.keys, self.seq).write.mode("overwrite").parquet(f"{self.folder}/delta-{batch_id}")
        bases, deltas = self._written("base"), self._written("delta")
        if len([n for n in deltas if n > (bases or [-1])[-1]]) >= self.compact:
            self.current().write.mode("overwrite").parquet(f"{self.folder}/base-{batch_id}")
            for name in [*(f"delta-{n}" for n in deltas), *(f"base-{n}" for n in bases if n != batch_id)]:
                self._drop(name)
        return self.current()

    def current(self) -> DataFrame | None:
        """The latest row for each key; None before the first batch."""
        base = (self._written("base") or [-1])[-1]
        names = [f"base-{base}"] * (base >= 0) + [f"delta-{n}" for n in self._written("delta") if n > base]
        rows = self._read(names)
        return rows if rows is None or len(names) == 1 else runs.upsert_latest(rows, self.keys, self.seq)

    def completed(self, batch: DataFrame, batch_id: int, k: int) -> DataFrame:
        """Runs of the seeds that this batch has completed and no earlier one. Only seeds of the batch are looked at."""
        touched = self.current().join(batch.select("uuid").distinct(), "uuid", "left_semi")
        seeds = runs.completed_seeds(touched, k).select("uuid")
        before = self._read([f"done-{n}" for n in self._written("done") if n < batch_id])
        seeds = seeds if before is None else seeds.join(before, "uuid", "left_anti")
        seeds.write.mode("overwrite").parquet(f"{self.folder}/done-{batch_id}")
        return touched.join(self.spark.read.parquet(f"{self.folder}/done-{batch_id}"), "uuid", "left_semi")


def with_copies(batch: DataFrame, mapping: DataFrame) -> DataFrame:
    """The batch, and each run that represents others once more for each of them, with ``copied_from``.

    mapping: (uuid, run_index, rep_uuid, rep_run_index); a representative that maps to itself isn't copied.
    """
    others = mapping.where("uuid <> rep_uuid OR run_index <> rep_run_index").withColumnsRenamed({"uuid": "__uuid", "run_index": "__run"})
    found = batch.withColumn("run_index", F.coalesce("run_index", F.lit(0))).join(others, (F.col("uuid") == F.col("rep_uuid")) & (F.col("run_index") == F.col("rep_run_index")))
    source = F.concat(F.col("rep_uuid").cast("string"), F.lit("_run_"), F.col("rep_run_index").cast("string"))
    kept = [c for c in batch.columns if c not in ("uuid", "run_index")]
    kinds = {f.name: f.dataType for f in batch.schema}
    copies = found.select(F.col("__uuid").cast(kinds["uuid"]).alias("uuid"), F.col("__run").cast(kinds["run_index"]).alias("run_index"), *kept, source.alias("copied_from"))
    return batch.withColumn("copied_from", F.lit(None).cast("string")).unionByName(copies)


def follow(
    stream: DataFrame,
    state: LatestRuns,
    k: int,
    on_complete: Callable[[DataFrame, int], None] | None = None,
    mapping: DataFrame | None = None,
    on_update: Callable[[DataFrame, int], None] | None = None,
):
    """Starts the query that keeps the state.

    on_complete gets Pass@k of the seeds that a batch has just completed, once for each seed, on_update the summary so far.
    With a mapping a representative's result is copied to its duplicates as it arrives, so that they count at once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = with_copies(batch, mapping) if mapping is not None else batch
        state.update(batch, batch_id)
        if on_complete:
            on_complete(runs.passk_per_seed(runs.valid_runs(state.completed(batch, batch_id, k)), k), batch_id)
        if on_update:
            on_update(runs.passk_summary(runs.passk_per_seed(runs.valid_runs(state.current()), k), k), batch_id)

    checkpoint = f"{state.folder}/checkpoint"
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_log_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The run log of a table, read as a stream of its files."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    folder, _, name = path.rstrip("/").rpartition("/")
    # A stream reads folders: of a table that is one file, the file in its folder.
    inputs = spark.read.parquet(path).inputFiles()
    single = inputs and inputs[0].endswith(f"/{name}")
    raw = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return raw.selectExpr(*B.RUN_LOG)


def realtime_summary(spark: SparkSession, path: str, k: int, files: int | None = None, folder: str | None = None) -> DataFrame:
    """The Pass@k summary of a run log that is read as a stream of files; a folder of an earlier run is gone on with."""
    state = LatestRuns(spark, folder or shared_folder(spark))
    follow(run_log_stream(spark, path, files), state, k).awaitTermination()
    rows = state.current()
    rows = B.run_log_of(spark.read.parquet(path)) if rows is None else rows
    return runs.passk_summary(runs.passk_per_seed(runs.valid_runs(rows), k), k)
