"""Logical relations of code-evaluation data, bound to the star-schema tables.

Every function takes (spark, sf_dir) and returns a lazy DataFrame; ``SQL`` has the same relations as DuckDB CTEs. All
rates are multiples of 1/4, so sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: one task each; passed fails for every fourth, tb_validated is null, true or false."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS uuid",
        "o_orderpriority AS cwe_id",
        "if(o_custkey % 2 = 0, 'c', 'verilog') AS language",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'failed' END AS status",
        "o_orderkey % 4 <> 0 AS passed",
        "CASE o_orderkey % 3 WHEN 0 THEN null WHEN 1 THEN true ELSE false END AS tb_validated",
    )


RUN_LOG = (
    "l_orderkey AS uuid",
    "l_linenumber - 1 AS run_index",
    "(cast(l_quantity AS int) % 5) / 4.0D AS f_rate",
    "cast(l_partkey % 5 AS int) / 4.0D AS s_rate",
    "l_suppkey % 4 AS n_req",
    "cast(l_quantity AS int) % 6 AS total_iterations",
    "if(l_returnflag = 'R', null, date_format(l_shipdate, 'yyyy-MM-dd')) AS end_time",
    "(cast(l_quantity AS int) % 5) = 4 AS success",
    "named_struct('t', l_shipdate, 'p', l_partkey, 's', l_suppkey, 'x', l_extendedprice) AS seq",
)


def run_log_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(*RUN_LOG)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: finished runs as they arrive; (uuid, run_index) repeats, seq orders the deliveries."""
    return run_log_of(table(spark, sf_dir, "lineitem"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: generated code; comments are wrapped around it so that normalisation has work to do."""
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS uuid",
        "doc_id AS run_index",
        "concat('/* ', source, ' */ ', coalesce(text, ''), ' // ', cast(doc_id AS string)) AS code",
    )


def verdict_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels: the outcome of a run, functional and security."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").selectExpr("source AS uuid", "doc_id AS run_index", "quality = 1 AS functional", "toxic = 0 AS secure")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def mutant_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: a mutant of a seed run against a test bench."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS seed", "l_linenumber AS mutant", "l_suppkey % 4 AS tb", "l_linestatus = 'F' AS detected"
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: judged attempts at a requirement, ordered by (ts, event_id)."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS req",
        "event_id AS seq",
        "ts",
        "CASE event_type WHEN 'error' THEN 'code_issue' WHEN 'click' THEN 'tb_issue' WHEN 'view' THEN 'problem_issue' WHEN 'signup' THEN 'unclear' ELSE 'success' END AS verdict",
        "value > 30 AS passed",
        "props",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: numbered lines (1-based)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    return rows.select("doc_id", (F.col("n") + 1).alias("n"), "line")


SQL = {
    "seeds": """seeds AS (SELECT o_orderkey AS uuid, o_orderpriority AS cwe_id, if(o_custkey % 2 = 0, 'c', 'verilog') AS language,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'failed' END AS status, o_orderkey % 4 <> 0 AS passed,
        CASE o_orderkey % 3 WHEN 0 THEN null WHEN 1 THEN true ELSE false END AS tb_validated FROM orders)""",
    "run_log": """run_log AS (SELECT l_orderkey AS uuid, l_linenumber - 1 AS run_index, (CAST(l_quantity AS INT) % 5) / 4.0::DOUBLE AS f_rate,
        CAST(l_partkey % 5 AS INT) / 4.0::DOUBLE AS s_rate, l_suppkey % 4 AS n_req, CAST(l_quantity AS INT) % 6 AS total_iterations,
        if(l_returnflag = 'R', null, strftime(l_shipdate, '%Y-%m-%d')) AS end_time, (CAST(l_quantity AS INT) % 5) = 4 AS success,
        l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM lineitem)""",
    "runs": """runs AS (SELECT * FROM run_log QUALIFY row_number() OVER (PARTITION BY uuid, run_index
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1)""",
    "valid": "valid AS (SELECT * FROM runs WHERE end_time IS NOT NULL AND end_time <> '' AND total_iterations > 0)",
    "code": """code AS (SELECT source AS uuid, doc_id AS run_index, '/* ' || source || ' */ ' || coalesce(text, '') || ' // ' || doc_id AS code FROM documents)""",
    "verdict_runs": """verdict_runs AS (SELECT source AS uuid, doc_id AS run_index, quality = 1 AS functional, toxic = 0 AS secure FROM documents JOIN labels USING (doc_id))""",
    "mutant_runs": """mutant_runs AS (SELECT l_orderkey AS seed, l_linenumber AS mutant, l_suppkey % 4 AS tb, l_linestatus = 'F' AS detected FROM lineitem)""",
    "attempts": """attempts AS (SELECT user_id AS req, event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'code_issue' WHEN 'click' THEN 'tb_issue'
        WHEN 'view' THEN 'problem_issue' WHEN 'signup' THEN 'unclear' ELSE 'success' END AS verdict, value > 30 AS passed, props FROM events)""",
    "lines": """lines AS (SELECT doc_id, CAST(u.i AS INT) AS n, string_split(coalesce(text, ''), chr(10))[u.i] AS line
        FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i))""",
}


def sql(names: str, body: str) -> str:
    """DuckDB SQL with the named relations in front."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
