"""Readers of task catalogues, result documents, reports, chats and code files.

All take paths that Spark can read and give lazy DataFrames; no file is opened by the driver itself.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import req_index_of_file
from tallyforge.sources import schemas

#: Characters that end a line.
_LINE_ENDS = r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for a whole-file JSON object (rows for an array); columns that are missing are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cwe_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue; reading a row without id, name or description fails."""
    rows = json_document(spark, path, schemas.CWE)
    missing = F.raise_error(F.lit("a catalogue entry lacks cwe_id, name or description")).cast("string")
    whole = F.col("cwe_id").isNotNull() & F.col("name").isNotNull() & F.col("description").isNotNull()
    return rows.withColumn("cwe_id", F.when(whole, F.col("cwe_id")).otherwise(missing))


def batch_all_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a document whose ``cwes`` is a map by id, with the map's key as cwe_id."""
    cwes = json_document(spark, path, schemas.BATCH_ALL).select(F.explode("cwes").alias("key", "cwe"))
    rows = cwes.select("key", F.explode("cwe.seeds").alias("seed"))
    return rows.select("seed.*", "key").withColumn("cwe_id", F.col("key")).drop("key")


def batch_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a document of one batch; a seed without cwe_id has that of the batch."""
    rows = json_document(spark, path, schemas.BATCH).select(F.col("batch_info.cwe_id").alias("of"), F.explode("seeds").alias("seed"))
    return rows.select("seed.*", "of").withColumn("cwe_id", F.coalesce("cwe_id", "of")).drop("of")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of either layout: each reader finds nothing in the other's documents."""
    return batch_all_seeds(spark, path).unionByName(batch_seeds(spark, path))


def cwe_info(spark: SparkSession, path: str) -> DataFrame:
    """(cwe_id, cwe_name, cwe_description) of either layout; the description is '' where it isn't written."""
    every = json_document(spark, path, schemas.BATCH_ALL).select(F.explode("cwes").alias("cwe_id", "c")).select("cwe_id", "c.cwe_name", "c.cwe_description")
    one = json_document(spark, path, schemas.BATCH).where("batch_info.cwe_id IS NOT NULL").select("batch_info.cwe_id", "batch_info.cwe_name", "batch_info.cwe_description")
    return every.unionByName(one).fillna("", ["cwe_description"])


def result_path(spark: SparkSession, folder: str) -> str:
    """The filtered results if there are some, else the results."""
    for name in ("result_filtered.json", "result.json"):
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"no result_filtered.json or result.json in {folder}")


def effective_seeds(spark: SparkSession, report: str) -> DataFrame:
    """seed_uuid of the effective seeds of a filter report."""
    rows = json_document(spark, report, schemas.FILTER_REPORT).select(F.explode("seed_details").alias("d"))
    return rows.where("d.is_effective").select("d.seed_uuid").distinct()


def test_cases(spark: SparkSession, folder: str, report: str | None = None, present: DataFrame | None = None) -> DataFrame:
    """Eligible seeds of a result folder; a report chooses result.json and its effective seeds."""
    rows = seeds(spark, f"{folder}/result.json" if report else result_path(spark, folder))
    rows = rows.where("status = 'completed' AND coalesce(passed, false) AND coalesce(tb_validated, true)")
    if report:
        rows = rows.join(effective_seeds(spark, report), "seed_uuid", "left_semi")
    return rows if present is None else rows.join(present, "seed_uuid", "left_semi")


def test_files(cases: DataFrame) -> DataFrame:
    """Test files bound to requirements: (seed_uuid, suite, requirement_index, requirement, file, explanation).

    Files without an index, or with one beyond the requirements, are left out.
    """
    out = None
    for suite, files, requirements in (("functional", "functional_test_files", "function_requirements"), ("security", "security_test_files", "security_requirements")):
        rows = cases.select("seed_uuid", F.col(requirements).alias("r"), F.explode(files).alias("file", "explanation"))
        rows = rows.withColumn("requirement_index", req_index_of_file(F.col("file"))).where(F.col("requirement_index") < F.size("r"))
        rows = rows.select("seed_uuid", F.lit(suite).alias("suite"), "requirement_index", F.get("r", F.col("requirement_index")).alias("requirement"), "file", "explanation")
        out = rows if out is None else out.unionByName(rows)
    return out


def _where(spark: SparkSession, path: str) -> str | None:
    """The full address of a file as Spark's readers give it; null where there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getFileStatus(place).getPath().toString() if system.exists(place) and system.getFileStatus(place).isFile() else None


def named_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, exists, bytes, lines, content), a row for each of the paths; a missing file has nulls and is warned about.

    Only what the driver is asked for by name is looked up there; the files are read by Spark.
    """
    found = {p: _where(spark, p) for p in dict.fromkeys(paths)}
    for path, at in found.items():
        if at is None:
            warnings.warn(f"no such file: {path}", stacklevel=2)
    asked = spark.createDataFrame(list(found.items()), "path string, __at string")
    at_all = [at for at in found.values() if at]
    read = spark.read.format("binaryFile").load(at_all) if at_all else spark.createDataFrame([], "path string, length long, content binary")
    rows = read.select(F.col("path").alias("__at"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("content"))
    rows = rows.select("__at", "bytes", "content", _line_count(F.col("content")).alias("lines"))
    # Spark reads no row of a file without content.
    there = F.col("__at").isNotNull()
    known = lambda c, empty: F.when(there, F.coalesce(F.col(c), F.lit(empty))).alias(c)
    return asked.join(rows, "__at", "left").select("path", there.alias("exists"), known("bytes", 0), known("lines", 0), known("content", ""))


def code_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, code) of one code file, which must be there."""
    if _where(spark, path) is None:
        raise FileNotFoundError(path)
    return named_files(spark, [path]).select("path", F.col("content").alias("code"))


def _line_count(content: Column) -> Column:
    """Lines by any of the line ends; one at the end of the text begins no further line."""
    lines = F.size(F.split(F.regexp_replace(content, rf"\r\n|{_LINE_ENDS}", "\n"), "\n"))
    return F.when(content == "", 0).otherwise(lines - F.when(content.rlike(rf"{_LINE_ENDS}\z"), 1).otherwise(0))


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(folder, file, content, bytes, lines) of text files below a path; Spark lists no files without content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    content = F.decode("content", "UTF-8")
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("folder"), name.alias("file"), content.alias("content"), F.col("length").alias("bytes"), _line_count(content).alias("lines"))


def bench_files(spark: SparkSession, path: str) -> DataFrame:
    """Test benches (tb_*) and golden files (others) of seed folders."""
    rows = text_files(spark, path, "*.{v,c}")
    return rows.withColumn("kind", F.when(F.col("file").startswith("tb_"), "bench").otherwise("golden"))


def eval_results(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a result document; a null run_index stays null, n_req is the size of the last security suite."""
    rows = json_document(spark, path, schemas.EVAL_RESULT).select(F.explode("results").alias("r")).select("r.*")
    last = F.try_element_at("iterations", F.lit(-1))
    return rows.withColumn("n_req", F.coalesce(F.when(last.isNotNull(), F.size(last["security_results"])), F.lit(0)))


def chat_contexts(spark: SparkSession, path: str) -> DataFrame:
    """(folder, turn, type, content) of initial_context.json files; a corrupt file gives one row with null turn."""
    files = text_files(spark, path, "initial_context.json")
    parsed = files.select("folder", F.from_json("content", schemas.CHAT_CONTEXT).alias("m"))
    return parsed.select("folder", F.posexplode_outer("m").alias("turn", "x")).select("folder", "turn", "x.type", "x.content")
