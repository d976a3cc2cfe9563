"""Writers of result documents and code files. Nothing is collected; a document is assembled by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import runs


def write_rows(rows: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII characters as they are."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_document(summary: DataFrame, rows: DataFrame, path: str, name: str = "results") -> None:
    """A summary of one row as {path}/summary, the rows it is of as {path}/{name}; a document of any size stays split."""
    write_rows(summary, f"{path}/summary")
    write_rows(rows, f"{path}/{name}")


def single_document(summary: DataFrame, rows: DataFrame, path: str, name: str = "results") -> None:
    """One indented JSON file {summary, rows} for results that fit in a row."""
    listed = rows.agg(F.collect_list(F.struct(*rows.columns)).alias(name))
    whole = summary.select(F.struct(*summary.columns).alias("summary")).crossJoin(F.broadcast(listed))  # both sides have one row
    whole.select(F.to_json(F.struct("summary", name), {"pretty": "true", "ignoreNullFields": "false"})).coalesce(1).write.mode("overwrite").text(path)


def write_passk(valid: DataFrame, k: int, path: str) -> None:
    """The Pass@k document of valid runs."""
    seeds = runs.passk_per_seed(valid, k)
    write_document(runs.passk_summary(seeds, k), seeds, f"{path}/eval_result_pass_at_{k}.json")


def write_code(code: DataFrame, path: str) -> None:
    """Code files under cwe_id=/language=; (uuid, run_index, iteration) stay columns, so no folder holds a single run."""
    code.write.mode("overwrite").partitionBy("cwe_id", "language").parquet(path)


def write_chat(chat: DataFrame, path: str) -> None:
    """One JSON line for each conversation with its messages in order."""
    messages = F.sort_array(F.collect_list(F.struct("turn", "type", "content")))
    chat.groupBy("conv_id").agg(F.transform(messages, lambda m: F.struct(m["type"].alias("type"), m["content"].alias("content"))).alias("messages")).write.mode("overwrite").json(path)


def write_filtered(seeds: DataFrame, report: DataFrame, path: str, suffix: str = "", dry_run: bool = False) -> bool:
    """The filtered seeds and their report; a dry run writes neither."""
    if dry_run:
        return False
    end = f"_{suffix}" if suffix else ""
    write_rows(seeds, f"{path}/result_filtered{end}.json")
    write_rows(report, f"{path}/filter_report{end}.json")
    return True


def append_seeds(seeds: DataFrame, path: str) -> None:
    """Appends seed rows, in_progress where they have no status."""
    seeds.withColumn("status", F.coalesce("status", F.lit("in_progress"))).write.mode("append").parquet(path)
