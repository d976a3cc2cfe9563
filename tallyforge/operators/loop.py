"""State of generation loops as joins over their logs: locked tests, revisions, failure details, replies to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T

TEST_KEY = ["suite", "requirement_index"]


def rerun(previous: DataFrame, outputs: DataFrame, verify: bool = True) -> DataFrame:
    """The next state of tests (suite, requirement_index, passed, output, locked, expected_output) after new outputs.

    A locked test stays as it is while its outcome agrees with the expected output, else it is unlocked and failed; an
    unlocked one takes the new verdict and is locked with the output it passed with. Without an output nothing changes.
    """
    rows = previous.join(outputs.select(*TEST_KEY, F.col("output").alias("__new"), F.coalesce("passed", F.lit(False)).alias("__passed")), TEST_KEY, "left")
    known, locked = F.col("__new").isNotNull(), F.coalesce("locked", F.lit(False))
    broken = known & locked & F.lit(verify) & ~T.same_outcome(F.col("expected_output"), F.col("__new"))
    fresh = known & ~locked
    changed = lambda old, when_broken, when_fresh: F.when(broken, when_broken).when(fresh, when_fresh).otherwise(F.col(old)).alias(old)
    return rows.select(
        *TEST_KEY,
        changed("passed", F.lit(False), F.col("__passed")),
        changed("output", F.col("__new"), F.col("__new")),
        changed("locked", F.lit(False), F.col("__passed")),
        changed("expected_output", F.col("expected_output"), F.when(F.col("__passed"), F.col("__new"))),
    )


def revisions(conflicts: DataFrame) -> DataFrame:
    """Requirements to revise, from conflicts (seq, req1_id, req2_id, reason): each once, by its first conflict.

    A conflict of which an id can't be read is left out as a whole.
    """
    read = conflicts.withColumns({"a": T.req_id(F.col("req1_id")), "b": T.req_id(F.col("req2_id"))}).where("a.index IS NOT NULL AND b.index IS NOT NULL")
    side = lambda own, other, nth: read.select(
        F.col(f"{own}.suite").alias("suite"), F.col(f"{own}.index").alias("requirement_index"), F.struct("seq", F.lit(nth).alias("nth")).alias("at"),
        F.concat(F.lit("Contradiction with "), F.col("req2_id" if other == "b" else "req1_id"), F.lit(": "), "reason").alias("feedback"),
    )
    both = side("a", "b", 1).unionByName(side("b", "a", 2))
    return both.groupBy("suite", "requirement_index").agg(F.min_by("feedback", "at").alias("feedback"))


def revised(requirements: DataFrame, replies: DataFrame) -> DataFrame:
    """requirements (suite, requirement_index, requirement) with the revision of a reply; the original where it can't be read."""
    new = F.nullif(F.trim(T.parsed(F.col("reply"), "revised_requirement string")["revised_requirement"]), F.lit(""))
    rows = requirements.join(replies.select(*TEST_KEY, new.alias("__new")), TEST_KEY, "left")
    return rows.select(*TEST_KEY, F.coalesce("__new", "requirement").alias("requirement"), F.coalesce(F.col("__new") != F.col("requirement"), F.lit(False)).alias("changed"))


def failure_details(tests: DataFrame, key: str) -> DataFrame:
    """Failed tests (suite, test_id, description, error) of a key as texts, functional ones first, then by id."""
    label = F.when(F.col("suite") == "functional", "[Functional] ").otherwise("[Security] ")
    more = lambda c, before: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), F.col(c))).otherwise("")
    detail = F.concat(label, "test_id", more("description", " - "), more("error", "\n  Error: "))
    order = F.struct((F.col("suite") != "functional").alias("s"), "test_id", detail.alias("d"))
    return tests.where("NOT passed").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["d"]).alias("details"))


def seeds_of(replies: DataFrame) -> DataFrame:
    """Valid seeds of model replies (cwe_id, reply): both fields and a known language; an unreadable reply gives none."""
    rows = replies.select("cwe_id", F.posexplode(T.parsed(F.col("reply"), "seeds array<struct<question:string, language:string>>")["seeds"]).alias("nth", "s"))
    return rows.select("cwe_id", "nth", F.col("s.question").alias("question"), F.lower("s.language").alias("language")).where("question IS NOT NULL AND language IN ('c', 'verilog')")


def without_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key doesn't start with the prefix."""
    return rows.where(~F.coalesce(F.col(key).startswith(prefix), F.lit(False)))


def scored_iterations(tests: DataFrame) -> DataFrame:
    """Replay of an evaluation loop: (uuid, run_index, iteration) with rates of both suites and whether the loop stops.

    The loop stops at the first iteration whose functional tests all pass; later ones are not part of the run.
    """
    keys = ["uuid", "run_index", "iteration"]
    suite = lambda name: F.when(F.col("suite") == name, F.col("passed"))
    rows = tests.groupBy(*keys).agg(
        F.coalesce(F.avg(suite("functional").cast("int")), F.lit(0.0)).alias("f_rate"),
        F.coalesce(F.avg(suite("security").cast("int")), F.lit(0.0)).alias("s_rate"),
        F.coalesce(F.bool_and(suite("functional")), F.lit(True)).alias("success"),
    )
    stop = rows.where("success").groupBy("uuid", "run_index").agg(F.min("iteration").alias("stop"))
    return rows.join(stop, ["uuid", "run_index"], "left").where("stop IS NULL OR iteration <= stop").drop("stop")
