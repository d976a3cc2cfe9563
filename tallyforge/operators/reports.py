"""Documents of runs over their life: appended entries, finalised results, suites of single tests, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import runs

# How the texts of a suite are put together.
_BENCH_SEPARATOR = "\n\n// ========================================\n\n"


def suite_pass_rates(results: DataFrame) -> DataFrame:
    """(uuid, suite, n_tests, n_passed, pass_rate) of test results (uuid, suite, passed)."""
    passed = F.count_if(F.coalesce("passed", F.lit(False)))
    return results.groupBy("uuid", "suite").agg(F.count(F.lit(1)).alias("n_tests"), passed.alias("n_passed"), (passed / F.count(F.lit(1)).cast("double")).alias("pass_rate"))


def all_tests_passed(seeds: DataFrame, tests: DataFrame, suites: DataFrame) -> DataFrame:
    """(uuid, all_passed, by): by single tests where both suites have some, else by the totals of suites; none passes.

    tests (uuid, suite, passed), suites (uuid, suite, passed_tests, total_tests).
    """
    single = tests.groupBy("uuid").agg(F.countDistinct("suite").alias("n_suites"), F.every(F.coalesce("passed", F.lit(False))).alias("every"))
    whole = suites.groupBy("uuid").agg(F.every(F.col("passed_tests") == F.col("total_tests")).alias("whole"))
    rows = seeds.select("uuid").join(single, "uuid", "left").join(whole, "uuid", "left")
    by_tests = F.coalesce(F.col("n_suites") == 2, F.lit(False))
    return rows.select("uuid", F.when(by_tests, F.col("every")).otherwise(F.coalesce("whole", F.lit(True))).alias("all_passed"), F.when(by_tests, "tests").otherwise("suites").alias("by"))


def coverage(lines: DataFrame) -> DataFrame:
    """Line and branch coverage per seed over the union of what all test benches reach: (seed, kind, line, covered)."""
    merged = lines.groupBy("seed", "kind", "line").agg(F.bool_or("covered").alias("covered"))
    counts = merged.groupBy("seed").pivot("kind", ["line", "branch"]).agg(F.count(F.lit(1)).alias("total"), F.count_if("covered").alias("covered")).fillna(0)
    rate = lambda k: F.coalesce(F.try_divide(F.col(f"{k}_covered").cast("double"), F.col(f"{k}_total").cast("double")), F.lit(0.0)).alias(f"{k}_coverage")
    return counts.select("seed", *(f"{k}_{c}" for k in ("line", "branch") for c in ("total", "covered")), rate("line"), rate("branch"))


def effectiveness_report(seeds: DataFrame, coverages: DataFrame) -> DataFrame:
    """Totals over quality.per_seed, and the mean line coverage of the seeds that have one (seed, line_coverage)."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), F.lit(0.0))
    rows = seeds.join(coverages.select("seed", "line_coverage"), "seed", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("seeds"),
        F.count_if("is_effective").alias("effective"),
        F.coalesce(F.avg(F.col("is_effective").cast("int")), F.lit(0.0)).alias("effectiveness_rate"),
        F.coalesce(F.sum("mutants"), F.lit(0)).alias("mutants"),
        F.coalesce(F.sum("detected_mutants"), F.lit(0)).alias("detected"),
        ratio("detected_mutants", "mutants").alias("detection_rate"),
        ratio("detected_pairs", "pairs").alias("per_tb_rate"),
        F.count("line_coverage").alias("seeds_with_coverage"),
        F.coalesce(F.avg("line_coverage"), F.lit(0.0)).alias("mean_line_coverage"),
    )


def batch_all_counters(groups: DataFrame) -> DataFrame:
    """The counters of a whole batch from those of its groups (seeds.batch_counters without the total)."""
    return groups.agg(
        F.count(F.lit(1)).alias("total_cwes"),
        F.count_if("succeeded").alias("successful_cwes"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_seeds", "completed_seeds", "successful_seeds")),
    )


def appended_entries(entries: DataFrame) -> DataFrame:
    """The entry of each cwe_id after appends (seq, cwe_id, total_seeds): a later one takes the place of an earlier one."""
    return runs.upsert_latest(entries, ["cwe_id"], "seq")


def entry_counters(entries: DataFrame) -> DataFrame:
    """Counters of the document after appends: entries are recounted, seeds are added up with every append."""
    return entries.groupBy("cwe_id").agg(F.sum("total_seeds").alias("n")).agg(F.count(F.lit(1)).alias("total_cwes"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_seeds"))


def finalised(results: DataFrame, mapping: DataFrame, end_time: Column | None = None) -> DataFrame:
    """Results and copies for duplicates without one of their own, with ``copied_from``; the end time is stamped where it lacks.

    mapping: (uuid, run_index, rep_uuid, rep_run_index).
    """
    results = results.withColumn("run_index", F.coalesce("run_index", F.lit(0)))
    missing = mapping.where("uuid <> rep_uuid OR run_index <> rep_run_index").join(results.select("uuid", "run_index"), ["uuid", "run_index"], "left_anti")
    source = results.withColumnsRenamed({"uuid": "rep_uuid", "run_index": "rep_run_index"})
    kept = [c for c in results.columns if c not in ("uuid", "run_index")]
    name = F.concat(F.col("rep_uuid").cast("string"), F.lit("_run_"), F.col("rep_run_index").cast("string"))
    copies = missing.join(source, ["rep_uuid", "rep_run_index"]).select("uuid", "run_index", *kept, name.alias("copied_from"))
    whole = results.select("uuid", "run_index", *kept, F.lit(None).cast("string").alias("copied_from")).unionByName(copies)
    return whole if end_time is None else whole.withColumn("end_time", F.coalesce("end_time", end_time))


def case_tests(files: DataFrame, outcomes: DataFrame, skip_missing: bool = False) -> DataFrame:
    """All tests of cases in the order they run: functional ones first, then by file.

    files (uuid, suite, requirement_index, file), outcomes (uuid, file, passed, output); a bench without an outcome is
    missing, and failed or left out.
    """
    rows = files.join(outcomes.select("uuid", "file", F.coalesce("passed", F.lit(False)).alias("__passed"), "output", F.lit(True).alias("__there")), ["uuid", "file"], "left")
    rows = rows.where("__there") if skip_missing else rows
    error = F.when(F.col("__there").isNull(), F.concat(F.lit("Testbench file not found: "), "file"))
    return rows.select("uuid", "suite", "requirement_index", "file", F.coalesce("__passed", F.lit(False)).alias("passed"), "output", error.alias("error"), (F.col("suite") != "functional").cast("int").alias("turn"))


def suites_of(tests: DataFrame) -> DataFrame:
    """Tests (uuid, suite, requirement_index, code, output, passed, explanation, error) as suites with their judgments.

    A suite's texts are arrays of its tests in order, joined; a case has as many tests as its task has requirements.
    """
    passed, output, error = F.coalesce("passed", F.lit(False)), F.coalesce("output", F.lit("")), F.coalesce("error", F.lit(""))
    failed = F.concat_ws(
        " | ",
        F.when(F.coalesce("explanation", F.lit("")) != "", F.concat(F.lit("Test intent: "), "explanation")),
        F.when(output != "", F.concat(F.lit("Output: "), F.substring(output, 1, 150))).when(error != "", F.concat(F.lit("Error: "), F.substring(error, 1, 150))).otherwise("No output - test may have crashed"),
    )
    number = F.col("requirement_index").cast("string")
    one = F.struct(
        "requirement_index",
        F.concat(F.upper("suite"), F.lit("-REQ-"), number).alias("test_id"),
        F.when(passed, "PASS").otherwise("FAIL").alias("verdict"),
        F.when(passed, F.when(output != "", F.substring(output, 1, 200)).otherwise("Passed")).otherwise(failed).alias("reason"),
        F.concat(F.lit("// Test for requirement "), number, F.lit("\n"), F.coalesce("code", F.lit(""))).alias("code"),
        F.concat(F.lit("// Requirement "), number, F.lit(": "), F.when(passed, "PASS").otherwise("FAIL"), F.lit("\n"), output).alias("output"),
    )
    rows = tests.groupBy("uuid", "suite").agg(F.sort_array(F.collect_list(one)).alias("x"), F.count(F.lit(1)).alias("total_tests"), F.count_if(passed).alias("passed_tests"))
    return rows.select(
        "uuid",
        "suite",
        F.array_join(F.transform("x", lambda t: t["code"]), _BENCH_SEPARATOR).alias("test_code"),
        F.array_join(F.transform("x", lambda t: t["output"]), "\n").alias("test_output"),
        F.transform("x", lambda t: F.struct(t["test_id"].alias("test_id"), t["verdict"].alias("verdict"), t["reason"].alias("reason"), F.when(t["verdict"] == "FAIL", "CODE_BUG").alias("root_cause"))).alias("judgments"),
        "total_tests",
        "passed_tests",
        (F.col("total_tests") - F.col("passed_tests")).alias("failed_tests"),
        (F.col("passed_tests") / F.col("total_tests").cast("double")).alias("pass_rate"),
    )


def partitioned_verdicts(judged: DataFrame) -> DataFrame:
    """Judgments (…, verdict) that go to somebody, with who that is; an unclear one goes to nobody."""
    to = F.when(F.col("verdict") == "problem_issue", "Architect").when(F.col("verdict") == "tb_issue", "RedTeamer").when(F.col("verdict") == "code_issue", "Expert")
    return judged.withColumn("routed_to", to).where("routed_to IS NOT NULL")


def requirement_test(tests: DataFrame, suite: str, index: int) -> DataFrame:
    """The test of one requirement; no row if there is none."""
    return tests.where((F.col("suite") == suite) & (F.col("requirement_index") == index)).limit(1)


def iso(ts: Column) -> Column:
    """A timestamp in ISO form; microseconds are written only where there are some."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def compact(ts: Column) -> Column:
    """A timestamp for names of folders."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")
