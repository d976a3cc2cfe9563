"""Command line: python -m tallyforge.cli query | passk | cases | filter | effectiveness | verify."""

from __future__ import annotations

import argparse
import os


def settings(defaults: dict[str, str], env_text: str = "", environ: dict[str, str] | None = None) -> dict[str, str]:
    """Settings of a .env text: KEY=VALUE, # comments, quotes taken off; defaults < text < environment."""
    out = dict(defaults)
    for line in env_text.splitlines():
        bare = line.strip()
        if bare and not bare.startswith("#") and "=" in bare:
            key, _, value = bare.partition("=")
            out[key.strip()] = value.strip().strip("\"'")
    environ = os.environ if environ is None else environ
    return out | {k: environ[k] for k in out if environ.get(k)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tallyforge", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("query", help="run a registered query and write its rows")
    one.add_argument("name")
    one.add_argument("tables", help="folder of the tables")
    one.add_argument("--output", help="Parquet folder; without it rows are shown")
    one = commands.add_parser("passk", help="Pass@k of a result document")
    one.add_argument("results", help="eval_result.json")
    one.add_argument("output")
    one.add_argument("--k", type=int, default=5)
    one = commands.add_parser("cases", help="eligible tasks of a result folder")
    one.add_argument("folder")
    one.add_argument("output")
    one.add_argument("--filter-report")
    one.add_argument("--language")
    one.add_argument("--limit", type=int, default=0)
    one = commands.add_parser("filter", help="quality gate over (uuid, mutation_rate, coverage)")
    one.add_argument("rates", help="Parquet folder")
    one.add_argument("output")
    one.add_argument("--mutation-threshold", type=float, default=0.5)
    one.add_argument("--coverage-threshold", type=float, default=0.8)
    one.add_argument("--suffix", default="")
    one.add_argument("--dry-run", action="store_true")
    one = commands.add_parser("effectiveness", help="mutation report over (seed, mutant, tb, detected); status 1 below 0.5")
    one.add_argument("runs", help="Parquet folder")
    one.add_argument("output")
    one = commands.add_parser("verify", help="claims (uuid, passed) against tests (uuid, passed); status 1 if any differ")
    one.add_argument("claims", help="Parquet folder")
    one.add_argument("tests", help="Parquet folder")
    one.add_argument("output")
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import functions as F

    from tallyforge.operators import quality, runs, seeds
    from tallyforge.plans.registry import QUERIES
    from tallyforge.session import spark_session
    from tallyforge.sources import documents, sinks

    args = parser().parse_args(argv)
    spark = spark or spark_session()
    if args.command == "query":
        rows = QUERIES[args.name](spark, args.tables)
        if args.output:
            rows.write.mode("overwrite").parquet(args.output)
        else:
            rows.show(20, truncate=100)
    elif args.command == "passk":
        results = documents.eval_results(spark, args.results).withColumnsRenamed({"final_functional_pass_rate": "f_rate", "final_security_pass_rate": "s_rate"})
        sinks.write_passk(runs.valid_runs(results), args.k, args.output)
    elif args.command == "cases":
        cases = documents.test_cases(spark, args.folder, args.filter_report)
        cases = seeds.with_language(cases, args.language) if args.language else cases
        sinks.write_rows(seeds.prefix(cases, args.limit, "seed_uuid"), args.output)
    elif args.command == "effectiveness":
        rates = quality.per_seed(spark.read.parquet(args.runs))
        report = quality.report(rates)
        sinks.write_document(report, rates, args.output, "seed_results")
        row = report.first()
        return int(row.seeds == 0 or row.effective < 0.5 * row.seeds)
    elif args.command == "verify":
        checked = quality.verified(spark.read.parquet(args.claims), spark.read.parquet(args.tests))
        summary = checked.agg(F.count(F.lit(1)).alias("seeds"), F.count_if("actual").alias("passed"), F.count_if(~F.col("consistent")).alias("inconsistent"))
        sinks.write_document(summary, checked, args.output)
        return int(summary.first().inconsistent > 0)
    else:
        reason = quality.gate(F.col("mutation_rate"), F.col("coverage"), args.mutation_threshold, args.coverage_threshold)
        gated = spark.read.parquet(args.rates).withColumn("reason", reason)
        sinks.write_filtered(gated.where("reason IS NULL"), quality.breakdown(gated), args.output, args.suffix, args.dry_run)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
