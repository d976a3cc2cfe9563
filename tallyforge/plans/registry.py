"""Named queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import mutants as M
from tallyforge.functions import text as T
from tallyforge.operators import dedup, history, loop, matching, quality, runs, scan, seeds
from tallyforge.plans import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, relations: str = "", body: str = "") -> Callable[[Query], Query]:
    """Registers a query; body is its DuckDB SQL over the named relations."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = B.sql(relations, body) if relations else body
        return f

    return add


K = 3
_VALID = "run_log runs valid"
_PER_SEED = """SELECT uuid, count(*) AS actual_k, bool_or(success) AS functional_pass, bool_or(s_rate = 1.0) AS security_pass, max(f_rate) AS best_f, max(s_rate) AS best_s,
  count(*) FILTER (success) AS functional_passed_runs, arg_min(success, run_index) AS first_success, arg_min(f_rate, run_index) AS first_f, arg_min(s_rate, run_index) AS first_s,
  arg_min(n_req, run_index) AS n_req, arg_min(total_iterations, run_index) AS first_iterations, 3 AS requested_k FROM valid GROUP BY uuid HAVING bool_or(run_index = 0)"""


def _runs(spark, d):
    return runs.upsert_latest(B.run_log(spark, d))


def _valid(spark, d):
    return runs.valid_runs(_runs(spark, d))


_PASSK_SUMMARY = f"""SELECT count(*) AS total_seeds, count(*) FILTER (actual_k = 3) AS seeds_with_full_k, count(*) FILTER (actual_k > 0 AND actual_k < 3) AS seeds_degraded,
  coalesce(avg(actual_k), 0.0::DOUBLE) AS avg_actual_k, coalesce(avg(first_success::INT), 0.0::DOUBLE) AS pass1_functional, coalesce(avg(functional_pass::INT), 0.0::DOUBLE) AS passk_functional,
  coalesce(sum(first_s * n_req) / nullif(sum(n_req), 0)::DOUBLE, 0.0::DOUBLE) AS pass1_security, coalesce(sum(best_s * n_req) / nullif(sum(n_req), 0)::DOUBLE, 0.0::DOUBLE) AS passk_security,
  coalesce(avg(first_iterations), 0.0::DOUBLE) AS avg_iterations FROM ({_PER_SEED})"""


@query("passk_summary", _VALID, _PASSK_SUMMARY)
def _(spark, d):
    return runs.passk_summary(runs.passk_per_seed(_valid(spark, d), K), K)


@query("passk_per_seed", _VALID, _PER_SEED)
def _(spark, d):
    return runs.passk_per_seed(_valid(spark, d), K)


@query("passk_by_source", "verdict_runs", """SELECT uuid, count(*) AS actual_k, bool_or(functional) AS functional_pass, bool_or(secure) AS security_pass,
  arg_min(functional, run_index) AS first_success, count(*) FILTER (functional) AS functional_passed_runs FROM verdict_runs GROUP BY uuid""")
def _(spark, d):
    return B.verdict_runs(spark, d).groupBy("uuid").agg(
        F.count(F.lit(1)).alias("actual_k"), F.bool_or("functional").alias("functional_pass"), F.bool_or("secure").alias("security_pass"),
        F.min_by("functional", "run_index").alias("first_success"), F.count_if("functional").alias("functional_passed_runs"),
    )


@query("pass1_per_seed", _VALID, "SELECT uuid, success, f_rate, s_rate, total_iterations FROM valid WHERE coalesce(run_index, 0) = 0")
def _(spark, d):
    return _valid(spark, d).where(runs.is_first()).select("uuid", "success", "f_rate", "s_rate", "total_iterations")


#: Rates of a run's first iteration: each iteration after it added a quarter.
_FIRST = "greatest({0}_rate - 0.25 * (total_iterations - 1), 0.0)"
_RUN_SUMMARY = """SELECT count(*) AS n_runs, coalesce(avg(first_f), 0.0::DOUBLE) AS avg_first_functional, coalesce(avg(first_s), 0.0::DOUBLE) AS avg_first_security,
  coalesce(avg(f_rate), 0.0::DOUBLE) AS avg_final_functional, coalesce(avg(s_rate), 0.0::DOUBLE) AS avg_final_security, coalesce(avg((first_f = 1.0)::INT), 0.0::DOUBLE) AS full_first_functional,
  coalesce(avg((first_s = 1.0)::INT), 0.0::DOUBLE) AS full_first_security, coalesce(avg((f_rate = 1.0)::INT), 0.0::DOUBLE) AS full_final_functional,
  coalesce(avg((s_rate = 1.0)::INT), 0.0::DOUBLE) AS full_final_security, coalesce(avg(total_iterations), 0.0::DOUBLE) AS avg_iterations"""
_WITH_FIRST = f"(SELECT *, CAST({_FIRST.format('f')} AS DOUBLE) AS first_f, CAST({_FIRST.format('s')} AS DOUBLE) AS first_s FROM valid)"


def with_first_rates(valid: DataFrame) -> DataFrame:
    return valid.withColumns({f"first_{x}": F.expr(_FIRST.format(x)).cast("double") for x in "fs"})


@query("run_summary", _VALID, f"{_RUN_SUMMARY} FROM {_WITH_FIRST}")
def _(spark, d):
    return runs.run_summary(with_first_rates(_valid(spark, d)))


_METRICS = ("first_functional", "first_security", "final_functional", "final_security")


@query("initial_summary", "seeds", f"""SELECT language, count(*) AS n_planned, 0::BIGINT AS n_runs, {", ".join(f"0.0::DOUBLE AS avg_{m}" for m in _METRICS)} FROM seeds GROUP BY language""")
def _(spark, d):
    return runs.initial_summary(B.seeds(spark, d), ["language"], [f"avg_{m}" for m in _METRICS])


@query("run_upsert", "run_log runs", "SELECT uuid, run_index, f_rate, s_rate, n_req, total_iterations, end_time, success FROM runs")
def _(spark, d):
    return _runs(spark, d).drop("seq")


@query("partial_update", "seeds", """SELECT s.uuid, s.cwe_id, s.language, coalesce(u.status, s.status) AS status, coalesce(u.passed, s.passed) AS passed FROM seeds s LEFT JOIN
  (SELECT user_id AS uuid, arg_max(st, event_id) FILTER (st IS NOT NULL) AS status, arg_max(ps, event_id) FILTER (ps IS NOT NULL) AS passed FROM
    (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS st, CASE WHEN event_type = 'click' THEN value > 30 END AS ps FROM events) GROUP BY user_id) u USING (uuid)""")
def _(spark, d):
    updates = B.table(spark, d, "events").selectExpr(
        "user_id AS uuid", "event_id AS seq", "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status", "CASE WHEN event_type = 'click' THEN value > 30 END AS passed"
    )
    return runs.partial_update(B.seeds(spark, d).drop("tb_validated"), updates, "uuid", "seq", ["status", "passed"])


@query("run_accounting", _VALID, "SELECT count(*) AS runs, count(DISTINCT uuid) AS seeds, coalesce(count(*) / nullif(count(DISTINCT uuid), 0)::DOUBLE, 0.0::DOUBLE) AS avg_k FROM valid")
def _(spark, d):
    return runs.run_accounting(_valid(spark, d))


@query("security_weighted_rate", _VALID, """SELECT run_index, coalesce(sum(s_rate * n_req) / nullif(sum(n_req), 0)::DOUBLE, 0.0::DOUBLE) AS rate FROM valid GROUP BY run_index""")
def _(spark, d):
    return _valid(spark, d).groupBy("run_index").agg(runs.weighted_rate("s_rate", "n_req").alias("rate"))


@query("completed_seeds", "run_log runs", "SELECT uuid, count(DISTINCT run_index) AS n_runs FROM runs GROUP BY uuid HAVING count(DISTINCT run_index) >= 3 AND bool_or(coalesce(run_index, 0) = 0)")
def _(spark, d):
    return runs.completed_seeds(_runs(spark, d), K)


@query("realtime_valid_runs", _VALID, """SELECT valid.uuid, valid.run_index FROM valid SEMI JOIN (SELECT uuid FROM runs GROUP BY uuid HAVING count(DISTINCT run_index) >= 3 AND bool_or(run_index = 0)) c ON c.uuid = valid.uuid""")
def _(spark, d):
    done = runs.completed_seeds(_runs(spark, d), K)
    return _valid(spark, d).join(done, "uuid", "left_semi").select("uuid", "run_index")


@query("iteration_first_last", "run_log runs", """SELECT uuid, arg_min(f_rate, run_index) AS first_f, arg_max(f_rate, run_index) AS final_f, arg_min(s_rate, run_index) AS first_s, arg_max(s_rate, run_index) AS final_s, count(*) AS iterations FROM runs GROUP BY uuid""")
def _(spark, d):
    return runs.first_last(_runs(spark, d))


# Task selection


@query("eligible_seeds", "seeds", """SELECT uuid, cwe_id, language FROM seeds WHERE status = 'completed' AND coalesce(passed, false) AND coalesce(tb_validated, true) AND uuid IN (SELECT l_orderkey FROM lineitem)""")
def _(spark, d):
    present = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uuid"))
    return seeds.eligible(B.seeds(spark, d), present).select("uuid", "cwe_id", "language")


@query("missing_directories", "seeds", "SELECT uuid FROM seeds WHERE uuid NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    present = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uuid"))
    return B.seeds(spark, d).join(present, "uuid", "left_anti").select("uuid")


@query("passed_seeds", "seeds", "SELECT uuid FROM seeds WHERE coalesce(passed, false)")
def _(spark, d):
    return B.seeds(spark, d).where("coalesce(passed, false)").select("uuid")


@query("seed_dirs", "", "SELECT c_custkey AS uuid, 'cwe-' || lower(replace('CWE-' || c_nationkey, 'CWE-', '')) || '/' || c_custkey AS dir, lower('CWE-' || c_nationkey) || '/' || c_custkey AS script_dir FROM customer")
def _(spark, d):
    cwe = F.concat(F.lit("CWE-"), F.col("c_nationkey").cast("string"))
    script = F.concat(F.lower(cwe), F.lit("/"), F.col("c_custkey").cast("string"))
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("uuid"), seeds.seed_dir(cwe, F.col("c_custkey")).alias("dir"), script.alias("script_dir"))


@query("language_filter", "seeds", "SELECT uuid, language FROM seeds WHERE lower(language) = lower('Verilog')")
def _(spark, d):
    return seeds.with_language(B.seeds(spark, d), "Verilog").select("uuid", "language")


@query("topk_cwe", "seeds", "SELECT cwe_id, count(*) AS n FROM seeds GROUP BY cwe_id ORDER BY n DESC, cwe_id LIMIT 10")
def _(spark, d):
    return seeds.top_groups(B.seeds(spark, d), "cwe_id")


@query("language_priority_limit", "seeds", "SELECT cwe_id, uuid, language, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cwe_id ORDER BY if(language = 'verilog', 0, 1), uuid) AS INT) AS rank FROM seeds) WHERE rank <= 50")
def _(spark, d):
    return seeds.by_language_priority(B.seeds(spark, d), "verilog", "cwe_id", 50).select("cwe_id", "uuid", "language", "rank")


@query("limit_prefix", "seeds", "SELECT uuid, cwe_id FROM seeds ORDER BY uuid LIMIT 100")
def _(spark, d):
    return seeds.prefix(B.seeds(spark, d), 100).select("uuid", "cwe_id")


@query("batch_counters_rollup", "seeds", """SELECT cwe_id, count(*) AS total_seeds, count(*) FILTER (status IN ('completed', 'failed')) AS completed_seeds, count(*) FILTER (coalesce(passed, false)) AS successful_seeds,
  CAST(grouping(cwe_id) AS INT) AS is_total, count(*) FILTER (coalesce(passed, false)) > 0 AS succeeded FROM seeds GROUP BY ROLLUP (cwe_id)""")
def _(spark, d):
    return seeds.batch_counters(B.seeds(spark, d))


@query("seed_statistics", "seeds", "SELECT count(*) AS total, count(*) / nullif(count(DISTINCT cwe_id), 0)::DOUBLE AS avg_per_cwe FROM seeds")
def _(spark, d):
    return B.seeds(spark, d).groupBy("cwe_id").count().agg(F.sum("count").alias("total"), F.avg("count").alias("avg_per_cwe"))


@query("language_distribution", "seeds", "SELECT language, count(*) AS n FROM seeds GROUP BY language ORDER BY language")
def _(spark, d):
    return B.seeds(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy("language")


@query("status_counts", "seeds", "SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status NOT IN ('completed', 'failed')) AS other, 100.0::DOUBLE * avg(passed::INT) AS success_percent FROM seeds")
def _(spark, d):
    is_ = lambda *x: F.col("status").isin(*x)
    return B.seeds(spark, d).agg(F.count_if(is_("completed")).alias("completed"), F.count_if(is_("failed")).alias("failed"), F.count_if(~is_("completed", "failed")).alias("other"), (100.0 * F.avg(F.col("passed").cast("int"))).alias("success_percent"))


@query("seed_validity", "", """SELECT event_id, event_type AS language FROM events WHERE props IS NOT NULL AND event_type IS NOT NULL AND lower(event_type) IN ('click', 'view')""")
def _(spark, d):
    return B.table(spark, d, "events").where("props IS NOT NULL AND lower(event_type) IN ('click', 'view')").selectExpr("event_id", "event_type AS language")


# Joins


@query("effective_semi_join", "seeds mutant_runs", "SELECT uuid, language FROM seeds WHERE uuid IN (SELECT seed FROM mutant_runs GROUP BY seed HAVING avg(detected::INT) >= 0.5)")
def _(spark, d):
    good = B.mutant_runs(spark, d).groupBy("seed").agg(F.avg(F.col("detected").cast("int")).alias("r")).where("r >= 0.5")
    return B.seeds(spark, d).join(good.withColumnRenamed("seed", "uuid"), "uuid", "left_semi").select("uuid", "language")


_SEED_RATES = """SELECT seed, count(*) AS mutants, sum(detected::INT)::BIGINT AS detected_mutants, sum(pairs)::BIGINT AS pairs, sum(detected_pairs)::BIGINT AS detected_pairs, avg(detected::INT) AS mutation_rate,
  sum(detected_pairs)::DOUBLE / sum(pairs)::DOUBLE AS tb_rate, avg(detected::INT) >= 0.5 AS is_effective FROM
  (SELECT seed, mutant, bool_or(detected) AS detected, count(*) AS pairs, count(*) FILTER (detected) AS detected_pairs FROM mutant_runs GROUP BY seed, mutant) GROUP BY seed"""


@query("seed_validation_left_join", "seeds mutant_runs", f"""SELECT s.uuid, coalesce(s.language, 'unknown') AS language, r.mutation_rate, coalesce(r.is_effective, false) AS is_effective FROM seeds s LEFT JOIN ({_SEED_RATES}) r ON r.seed = s.uuid""")
def _(spark, d):
    rates = quality.per_seed(B.mutant_runs(spark, d)).select(F.col("seed").alias("uuid"), "mutation_rate", "is_effective")
    rows = B.seeds(spark, d).join(rates, "uuid", "left")
    return rows.select("uuid", F.coalesce("language", F.lit("unknown")).alias("language"), "mutation_rate", F.coalesce("is_effective", F.lit(False)).alias("is_effective"))


@query("claimed_vs_actual", "seeds mutant_runs", """SELECT s.uuid, s.passed AS claimed, coalesce(r.failed, 0) AS failed, coalesce(r.failed, 0) = 0 AS actual, s.passed = (coalesce(r.failed, 0) = 0) AS consistent
  FROM seeds s LEFT JOIN (SELECT seed, count(*) FILTER (detected) AS failed FROM mutant_runs GROUP BY seed) r ON r.seed = s.uuid""")
def _(spark, d):
    failed = B.mutant_runs(spark, d).groupBy(F.col("seed").alias("uuid")).agg(F.count_if("detected").alias("failed"))
    rows = B.seeds(spark, d).join(failed, "uuid", "left").withColumn("failed", F.coalesce("failed", F.lit(0)))
    return rows.select("uuid", F.col("passed").alias("claimed"), "failed", (F.col("failed") == 0).alias("actual"), (F.col("passed") == (F.col("failed") == 0)).alias("consistent"))


@query("cwe_hint_lookup", "", "SELECT c.c_custkey, c.c_custkey % 3 AS hint, coalesce(n.n_name, '') AS cwe_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND c.c_custkey % 3 = 2")
def _(spark, d):
    cases = B.table(spark, d, "customer").withColumn("hint", F.col("c_custkey") % 3)
    nation = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.lit(2).cast("long").alias("hint"))
    return cases.join(nation, ["c_nationkey", "hint"], "left").select("c_custkey", "hint", F.coalesce("n_name", F.lit("")).alias("cwe_name"))


@query("cwe_point_lookup", "", "SELECT n_nationkey, n_name FROM nation WHERE n_name = 'NATION_7' LIMIT 1")
def _(spark, d):
    return B.table(spark, d, "nation").where("n_name = 'NATION_7'").select("n_nationkey", "n_name").limit(1)


@query("requirement_position_join", "lines", """SELECT f.doc_id, f.idx, l.line AS requirement FROM (SELECT doc_id, n AS row, CAST(regexp_extract('tb_functional_req_' || (n * 2 - 2) || '_m.c', 'req_(\\d+)_', 1) AS INT) AS idx FROM lines) f
  JOIN lines l ON l.doc_id = f.doc_id AND l.n = f.idx + 1""")
def _(spark, d):
    lines = B.lines(spark, d)
    name = F.concat(F.lit("tb_functional_req_"), (F.col("n") * 2 - 2).cast("string"), F.lit("_m.c"))
    files = lines.select("doc_id", T.req_index_of_file(name).alias("idx"))
    return files.join(lines.select("doc_id", (F.col("n") - 1).alias("idx"), F.col("line").alias("requirement")), ["doc_id", "idx"])


@query("guidance_join", "attempts", """SELECT f.req, f.seq, coalesce(g.guidance, 'Review implementation based on test output.') AS guidance FROM (SELECT * FROM attempts WHERE NOT passed) f
  LEFT JOIN (SELECT req, verdict, 'Fix ' || max(seq) AS guidance FROM attempts WHERE passed AND verdict <> 'success' GROUP BY req, verdict) g ON g.req = f.req AND g.verdict = f.verdict""")
def _(spark, d):
    rows = B.attempts(spark, d)
    guidance = rows.where("passed AND verdict <> 'success'").groupBy("req", "verdict").agg(F.concat(F.lit("Fix "), F.max("seq").cast("string")).alias("guidance"))
    return rows.where("NOT passed").join(guidance, ["req", "verdict"], "left").select("req", "seq", F.coalesce("guidance", F.lit("Review implementation based on test output.")).alias("guidance"))


@query("accepted_output_check", "attempts", """SELECT j.req, bool_and(a.seq IS NOT NULL) AS complete, if(bool_and(a.seq IS NOT NULL), count(*) FILTER (j.passed = a.passed), null) AS agreeing
  FROM (SELECT req, verdict, bool_or(passed) AS passed FROM attempts GROUP BY req, verdict) j LEFT JOIN (SELECT req, verdict, max(seq) AS seq, bool_and(passed) AS passed FROM attempts WHERE seq % 7 <> 0 GROUP BY req, verdict) a
  ON a.req = j.req AND a.verdict = j.verdict GROUP BY j.req""")
def _(spark, d):
    rows = B.attempts(spark, d)
    judged = rows.groupBy("req", "verdict").agg(F.bool_or("passed").alias("passed"))
    accepted = rows.where("seq % 7 <> 0").groupBy("req", "verdict").agg(F.max("seq").alias("seq"), F.bool_and("passed").alias("accepted"))
    joined = judged.join(accepted, ["req", "verdict"], "left")
    whole = F.bool_and(F.col("seq").isNotNull())
    return joined.groupBy("req").agg(whole.alias("complete"), F.when(whole, F.count_if(F.col("passed") == F.col("accepted"))).alias("agreeing"))


@query("mutant_tb_cross", "mutant_runs", "SELECT a.seed, a.mutant, b.tb FROM (SELECT DISTINCT seed, mutant FROM mutant_runs) a JOIN (SELECT DISTINCT seed, tb FROM mutant_runs) b USING (seed)")
def _(spark, d):
    rows = B.mutant_runs(spark, d)
    return rows.select("seed", "mutant").distinct().join(rows.select("seed", "tb").distinct(), "seed")


@query("expand_k_runs", "", "SELECT p_partkey, CAST(r.i AS INT) AS run_index FROM part, range(0, 3) AS r(i)")
def _(spark, d):
    return runs.expand_runs(B.table(spark, d, "part").select("p_partkey"), K)


@query("hint_sweep", "", "SELECT c_custkey, CAST(r.i AS INT) AS hint FROM customer, range(0, 3) AS r(i)")
def _(spark, d):
    return B.table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("hint"))


@query("signal_contains_join", "lines", """SELECT l.doc_id, l.n FROM lines l JOIN (SELECT doc_id, string_split(lower(line), ' ') AS signals FROM lines WHERE n = 1) s USING (doc_id)
  WHERE len(list_filter(s.signals, lambda x: length(x) >= 6 AND contains(l.line, x))) > 0""")
def _(spark, d):
    lines = B.lines(spark, d)
    long = F.filter(F.split(F.lower("line"), " "), lambda x: F.length(x) >= 6)
    signals = lines.where("n = 1").select("doc_id", long.alias("patterns"))
    return matching.with_hits(lines, signals, "doc_id").where("hit").select("doc_id", "n")


# Dedup of code

_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(code, '/\*.*?\*/', '', 'gs'), '//[^\n]*', '', 'g'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g')"""
_HASHES = f"(SELECT uuid, run_index, sha256(normal) AS code_hash FROM (SELECT uuid, run_index, {_NORMAL} AS normal FROM code) WHERE normal <> '')"
_GROUPS = f"(SELECT uuid, code_hash, min(run_index) AS rep_run_index, count(*) AS size FROM {_HASHES} GROUP BY uuid, code_hash)"


@query("code_normalize_hash", "code", f"SELECT uuid, run_index, code_hash FROM {_HASHES}")
def _(spark, d):
    return dedup.hashed(B.code(spark, d))


@query("dedup_groups", "code", f"SELECT uuid, code_hash, uuid AS rep_uuid, rep_run_index, size FROM {_GROUPS}")
def _(spark, d):
    return dedup.groups(dedup.hashed(B.code(spark, d)))


@query("dedup_groups_global", "code", f"SELECT code_hash, arg_min(uuid, (run_index, uuid)) AS rep_uuid, min(run_index) AS rep_run_index, count(*) AS size FROM {_HASHES} GROUP BY code_hash")
def _(spark, d):
    return dedup.groups(dedup.hashed(B.code(spark, d)), "global")


@query("dedup_representatives", "code", f"SELECT h.uuid, h.run_index, h.uuid AS rep_uuid, g.rep_run_index FROM {_HASHES} h JOIN {_GROUPS} g ON g.uuid = h.uuid AND g.code_hash = h.code_hash")
def _(spark, d):
    return dedup.representatives(dedup.hashed(B.code(spark, d)))


@query("dedup_stats", "code", f"""SELECT CAST(sum(size) AS BIGINT) AS total, count(*) AS unique_codes, CAST(sum(size) - count(*) AS BIGINT) AS duplicates, max(size) AS max_group, avg(size) AS avg_group, (sum(size) - count(*))::DOUBLE / sum(size)::DOUBLE AS rate FROM {_GROUPS}""")
def _(spark, d):
    return dedup.stats(dedup.groups(dedup.hashed(B.code(spark, d))))


@query("dedup_copy_results", "code verdict_runs", f"""SELECT m.uuid, m.run_index, v.functional, v.secure, m.uuid || '/' || m.rep AS copied_from FROM (SELECT h.uuid, h.run_index, g.rep_run_index AS rep FROM {_HASHES} h JOIN {_GROUPS} g ON g.uuid = h.uuid AND g.code_hash = h.code_hash) m
  JOIN verdict_runs v ON v.uuid = m.uuid AND v.run_index = m.rep WHERE m.run_index <> m.rep AND NOT EXISTS (SELECT 1 FROM verdict_runs w WHERE w.uuid = m.uuid AND w.run_index = m.run_index)""")
def _(spark, d):
    mapping = dedup.representatives(dedup.hashed(B.code(spark, d)))
    return dedup.copied_results(mapping, B.verdict_runs(spark, d))


# Scores, gates and reports


@query("all_passed_empty_true", "seeds", """SELECT uuid, count(l_orderkey) AS n_tests, coalesce(avg((l_linestatus = 'F')::INT), 0.0::DOUBLE) AS pass_rate, coalesce(bool_and(l_linestatus = 'F'), true) AS all_passed FROM seeds LEFT JOIN lineitem ON l_orderkey = uuid GROUP BY uuid""")
def _(spark, d):
    results = B.table(spark, d, "lineitem").selectExpr("l_orderkey AS uuid", "l_linestatus = 'F' AS passed")
    return quality.suite_rates(B.seeds(spark, d), results)


@query("combined_pass_rate", "", """SELECT l_orderkey AS uuid, if(count(*) FILTER (l_linenumber % 2 = 0) = 0 OR count(*) FILTER (l_linenumber % 2 = 1) = 0, 0.0::DOUBLE, avg((l_linestatus = 'F')::INT)) AS rate FROM lineitem GROUP BY l_orderkey""")
def _(spark, d):
    rows = B.table(spark, d, "lineitem").selectExpr("l_orderkey AS uuid", "l_linenumber % 2 AS suite", "l_linestatus = 'F' AS passed")
    both = (F.count_if(F.col("suite") == 0) > 0) & (F.count_if(F.col("suite") == 1) > 0)
    return rows.groupBy("uuid").agg(F.when(both, F.avg(F.col("passed").cast("int"))).otherwise(F.lit(0.0)).alias("rate"))


@query("suite_union_rate", "mutant_runs", "SELECT suite, count(*) AS n, avg(detected::INT) AS rate FROM (SELECT 'functional' AS suite, detected FROM mutant_runs WHERE tb < 2 UNION ALL SELECT 'security', detected FROM mutant_runs WHERE tb >= 2) GROUP BY suite")
def _(spark, d):
    rows = B.mutant_runs(spark, d)
    both = rows.where("tb < 2").select(F.lit("functional").alias("suite"), "detected").unionByName(rows.where("tb >= 2").select(F.lit("security").alias("suite"), "detected"))
    return both.groupBy("suite").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("detected").cast("int")).alias("rate"))


@query("failed_requirements", "attempts", "SELECT req, seq, verdict FROM attempts WHERE NOT passed")
def _(spark, d):
    return B.attempts(spark, d).where("NOT passed").select("req", "seq", "verdict")


@query("mutation_detection", "mutant_runs", "SELECT seed, mutant, bool_or(detected) AS detected, count(*) AS pairs, count(*) FILTER (detected) AS detected_pairs FROM mutant_runs GROUP BY seed, mutant")
def _(spark, d):
    return quality.per_mutant(B.mutant_runs(spark, d))


@query("mutation_per_seed", "mutant_runs", _SEED_RATES)
def _(spark, d):
    return quality.per_seed(B.mutant_runs(spark, d))


@query("mutation_report", "mutant_runs", f"""SELECT count(*) AS seeds, count(*) FILTER (is_effective) AS effective, count(*) FILTER (NOT is_effective) AS weak, sum(mutants)::BIGINT AS mutants, sum(detected_mutants)::BIGINT AS detected,
  sum(detected_mutants)::DOUBLE / sum(mutants)::DOUBLE AS micro_rate, sum(detected_pairs)::DOUBLE / sum(pairs)::DOUBLE AS micro_tb_rate FROM ({_SEED_RATES})""")
def _(spark, d):
    return quality.report(quality.per_seed(B.mutant_runs(spark, d)))


_GATED = f"""(SELECT s.uuid, r.mutation_rate, CASE WHEN r.mutation_rate IS NULL THEN 'directory_not_found' WHEN r.mutation_rate < 0.5 AND cov < 0.8 THEN 'low_mutation_and_coverage' WHEN r.mutation_rate < 0.5 THEN 'low_mutation_rate'
  WHEN cov < 0.8 THEN 'low_coverage' END AS reason FROM (SELECT uuid, CASE WHEN uuid % 5 = 0 THEN null ELSE (uuid % 5) / 4.0::DOUBLE END AS cov FROM seeds) s LEFT JOIN ({_SEED_RATES}) r ON r.seed = s.uuid)"""


def _gated(spark, d):
    rates = quality.per_seed(B.mutant_runs(spark, d)).select(F.col("seed").alias("uuid"), "mutation_rate")
    coverage = F.when(F.col("uuid") % 5 != 0, (F.col("uuid") % 5).cast("int") / F.lit(4.0))
    rows = B.seeds(spark, d).select("uuid").join(rates, "uuid", "left")
    return rows.select("uuid", "mutation_rate", quality.gate(F.col("mutation_rate"), coverage).alias("reason"))


@query("quality_gate", "seeds mutant_runs", f"SELECT * FROM {_GATED}")
def _(spark, d):
    return _gated(spark, d)


@query("filter_breakdown", "seeds mutant_runs", f"""SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS validated, count(*) FILTER (reason <> 'directory_not_found') AS filtered, count(*) FILTER (reason = 'low_mutation_and_coverage') AS both_low,
  count(*) FILTER (reason = 'low_mutation_rate') AS low_mutation, count(*) FILTER (reason = 'low_coverage') AS low_coverage, count(*) FILTER (reason = 'directory_not_found') AS no_data FROM {_GATED}""")
def _(spark, d):
    return quality.breakdown(_gated(spark, d))


@query("upper_median", "run_log", "SELECT avg(s_rate) AS mean, min(s_rate) AS least, max(s_rate) AS most, list_sort(list(s_rate))[count(*) // 2 + 1] AS median FROM run_log")
def _(spark, d):
    return quality.upper_median(B.run_log(spark, d), "s_rate")


@query("coverage_union", "mutant_runs", """SELECT seed, count(*) AS lines_total, count(*) FILTER (covered) AS lines_covered, count(*) FILTER (covered) / count(*)::DOUBLE AS coverage FROM (SELECT seed, mutant AS line, bool_or(detected) AS covered FROM mutant_runs GROUP BY seed, mutant) GROUP BY seed""")
def _(spark, d):
    return quality.coverage_union(B.mutant_runs(spark, d).selectExpr("seed", "mutant AS line", "detected AS covered"))


@query("tested_lines_union", "mutant_runs", "SELECT seed, mutant AS line FROM mutant_runs WHERE tb < 2 UNION SELECT seed, mutant FROM mutant_runs WHERE tb = 3")
def _(spark, d):
    rows = B.mutant_runs(spark, d).selectExpr("seed", "mutant AS line", "tb")
    return rows.where("tb < 2").drop("tb").union(rows.where("tb = 3").drop("tb")).distinct()


@query("verdict_counts", "attempts", "SELECT verdict, count(*) AS n, CASE verdict WHEN 'problem_issue' THEN 'Architect' WHEN 'tb_issue' THEN 'RedTeamer' ELSE 'Expert' END AS agent FROM attempts GROUP BY verdict")
def _(spark, d):
    return B.attempts(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).withColumn("agent", T.responsible(F.col("verdict")))


# Ordered logs


@query("iteration_issue_tags", "attempts", """SELECT req, coalesce(nullif(concat_ws(',', if(bool_or(verdict = 'problem_issue'), 'problem_issue', null), if(bool_or(verdict = 'tb_issue'), 'tb_issue', null), if(bool_or(verdict IN ('code_issue', 'unclear')), 'code_issue', null)), ''), 'PASS') AS tags FROM attempts GROUP BY req""")
def _(spark, d):
    return history.issue_tags(B.attempts(spark, d))


@query("affected_suites", "attempts", "SELECT req, bool_or(verdict = 'code_issue') AS functional, bool_or(verdict = 'tb_issue') AS security, bool_or(verdict IN ('code_issue', 'tb_issue')) AS any_suite FROM attempts GROUP BY req")
def _(spark, d):
    has = lambda *x: F.bool_or(F.col("verdict").isin(*x))
    return B.attempts(spark, d).groupBy("req").agg(has("code_issue").alias("functional"), has("tb_issue").alias("security"), has("code_issue", "tb_issue").alias("any_suite"))


@query("attempt_history_repeat", "attempts", """SELECT req, seq, CAST(nth AS INT) AS nth, array_to_string(last3, ',') AS last3, nth >= 3 AND len(list_distinct(last3)) = 1 AS repeated FROM (SELECT req, seq, row_number() OVER w AS nth, list(verdict) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3
  FROM attempts WINDOW w AS (PARTITION BY req ORDER BY ts, seq))""")
def _(spark, d):
    return history.repeated_verdicts(B.attempts(spark, d))


@query("attempt_log", "attempts", """SELECT req, seq, verdict, CAST(row_number() OVER (PARTITION BY req ORDER BY ts, seq) AS INT) AS nth FROM (SELECT *, coalesce(max((verdict <> 'success')::INT) OVER (PARTITION BY req ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM attempts) WHERE verdict <> 'success' OR seen = 1""")
def _(spark, d):
    return history.logged_attempts(B.attempts(spark, d))


@query("chat_compress", "", """SELECT conv_id, turn, role, text FROM (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS first, max(turn) OVER (PARTITION BY conv_id) AS last, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
  WHERE n <= 3 OR first IS NULL OR turn <= first OR turn = last""")
def _(spark, d):
    return history.compress_chat(B.chat(spark, d))


@query("chat_prefix_rollback", "", """SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS down FROM conversations) WHERE up <= 2 OR down <= 2""")
def _(spark, d):
    return history.rollback_chat(B.chat(spark, d), 2)


@query("chat_role_map", "", "SELECT conv_id, turn, CASE role WHEN 'system' THEN 'SystemMessage' WHEN 'user' THEN 'HumanMessage' WHEN 'assistant' THEN 'AIMessage' END AS type FROM conversations")
def _(spark, d):
    return history.role_names(B.chat(spark, d))


@query("chat_context_document", "", """SELECT conv_id, count(*) AS n, string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id""")
def _(spark, d):
    rows = B.chat(spark, d).select("conv_id", "turn", F.concat_ws(":", "role", F.coalesce("text", F.lit(""))).alias("line"))
    return history.feedback(rows, "conv_id", "turn", "line").join(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conv_id").select("conv_id", "n", F.col("feedback").alias("context"))


@query("comment_lookback", "lines", """SELECT doc_id, n, CAST(len(hits) AS INT) AS n_hits, coalesce(array_to_string(hits, '|'), '') AS hits FROM (SELECT doc_id, n, coalesce(list(trim(line)) FILTER (contains(line, 'the')) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS hits FROM lines)""")
def _(spark, d):
    return history.look_back(B.lines(spark, d), "the")


@query("section_lines", "lines", """SELECT doc_id, n FROM (SELECT doc_id, n, max(n) FILTER (contains(line, 'ing')) OVER w AS a, max(n) FILTER (contains(line, 'tion')) OVER w AS b FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE a IS NOT NULL AND (b IS NULL OR a > b)""")
def _(spark, d):
    return history.section_lines(B.lines(spark, d), "ing", "tion").select("doc_id", "n")


@query("concat_feedback", "attempts", "SELECT req, string_agg('[' || verdict || '] ' || props, chr(10) ORDER BY seq) AS feedback FROM attempts WHERE NOT passed GROUP BY req")
def _(spark, d):
    rows = B.attempts(spark, d).where("NOT passed").select("req", "seq", F.concat(F.lit("["), "verdict", F.lit("] "), "props").alias("line"))
    return history.feedback(rows, "req", "seq", "line")


@query("distinct_in_order", "attempts", "SELECT req, string_agg(verdict, ',' ORDER BY first) AS verdicts FROM (SELECT req, verdict, min(seq) AS first FROM attempts GROUP BY req, verdict) GROUP BY req")
def _(spark, d):
    first = B.attempts(spark, d).groupBy("req", "verdict").agg(F.min("seq").alias("first"))
    return history.feedback(first, "req", "first", "verdict", ",").withColumnRenamed("feedback", "verdicts")


@query("first_wins_revisions", "attempts", "SELECT req, verdict, min(seq) AS seq FROM attempts GROUP BY req, verdict")
def _(spark, d):
    return B.attempts(spark, d).groupBy("req", "verdict").agg(F.min("seq").alias("seq"))


@query("locked_tests", "attempts", "SELECT req, bool_or(passed) AS locked, arg_min(props, seq) FILTER (passed) AS accepted_output, count(*) FILTER (NOT passed) AS failures FROM attempts GROUP BY req")
def _(spark, d):
    accepted = F.min_by("props", F.when(F.col("passed"), F.col("seq")))
    return B.attempts(spark, d).groupBy("req").agg(F.bool_or("passed").alias("locked"), F.when(F.bool_or("passed"), accepted).alias("accepted_output"), F.count_if(~F.col("passed")).alias("failures"))


@query("problem_diff", "attempts", """SELECT req, seq, verdict IS DISTINCT FROM prev AS changed, props IS DISTINCT FROM prev_props AS props_changed FROM (SELECT *, lag(verdict) OVER w AS prev, lag(props) OVER w AS prev_props FROM attempts WINDOW w AS (PARTITION BY req ORDER BY ts, seq))""")
def _(spark, d):
    before = {f"{c}_before": scan.Fold("tail", F.col(c), 1, before=True) for c in ("verdict", "props")}
    rows = scan.scanned(B.attempts(spark, d).select("req", "ts", "seq", "verdict", "props"), ["req"], ["ts", "seq"], before)
    changed = lambda c: ~F.col(c).eqNullSafe(F.get(f"{c}_before", F.lit(0)))
    return rows.select("req", "seq", changed("verdict").alias("changed"), changed("props").alias("props_changed"))


@query("requirement_changes", "lines", """SELECT doc_id, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i), '') AS spots FROM (SELECT doc_id, i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS o, string_split(replace(coalesce(text, ''), 'ing', 'ed'), chr(10)) AS n FROM documents), unnest(range(1, greatest(len(o), len(n)) + 1)) u(i)
  WHERE o[i] IS DISTINCT FROM n[i]) GROUP BY doc_id""")
def _(spark, d):
    text = F.coalesce("text", F.lit(""))
    spots = T.changes(F.split(text, "\n"), F.split(F.replace(text, F.lit("ing"), F.lit("ed")), "\n"))
    rows = B.table(spark, d, "documents").select("doc_id", spots.alias("s"))
    return rows.where(F.size("s") > 0).select("doc_id", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("spots"))


# Text functions

_OUT = """CASE event_id % 7 WHEN 0 THEN '[TEST] PASS' WHEN 1 THEN '[test] fail' WHEN 2 THEN '[CASE-' || event_id || ']  PASS' WHEN 3 THEN 'x [case-1]FAIL [CASE-2] PASS' WHEN 4 THEN '' WHEN 5 THEN 'ok, failed nothing' ELSE event_type || ' passed' END"""


def _outputs(spark, d):
    return B.table(spark, d, "events").select("event_id", "value", F.expr(_OUT).alias("output"), F.expr("if(event_id % 2 = 0, 'c', 'verilog')").alias("language"))


_OUTPUTS = f"(SELECT event_id, value, {_OUT} AS output, if(event_id % 2 = 0, 'c', 'verilog') AS language FROM events)"


@query("verdict_marker", "", f"""SELECT event_id, if(language = 'c', NOT regexp_matches(upper(output), '\\[CASE-\\d+\\]\\s*FAIL') AND regexp_matches(upper(output), '\\[CASE-\\d+\\]\\s*PASS'), NOT contains(upper(output), '[TEST] FAIL') AND contains(upper(output), '[TEST] PASS')) AS eval_rule,
  NOT regexp_matches(output, '(?i)\\[CASE-\\d+\\]\\s*FAIL') AND regexp_matches(output, '(?i)\\[CASE-\\d+\\]\\s*PASS') AS c_rule, CASE WHEN value > 100 THEN 'crash' WHEN trim(output) = '' THEN 'no_output' WHEN contains(output, '[TEST] FAIL') THEN 'fail' WHEN contains(output, '[TEST] PASS') THEN 'pass' ELSE 'no_marker' END AS verilog_rule,
  len(regexp_extract_all(output, '\\[CASE-\\d+\\]'))::INT AS n_cases FROM {_OUTPUTS}""")
def _(spark, d):
    out = F.col("output")
    return _outputs(spark, d).select("event_id", T.verdict_eval(out, F.col("language")).alias("eval_rule"), T.verdict_c(out).alias("c_rule"), T.verdict_verilog(out, F.col("value") > 100).alias("verilog_rule"), T.case_count(out).alias("n_cases"))


@query("verdict_substring", "", f"""SELECT event_id, NOT contains(upper(output), 'FAIL') AND contains(upper(output), 'PASS') AS substring_rule, CASE WHEN contains(upper(output), 'FAIL') THEN false WHEN contains(upper(output), 'PASS') THEN true ELSE event_id % 3 = 0 END AS exit_rule FROM {_OUTPUTS}""")
def _(spark, d):
    return _outputs(spark, d).select("event_id", T.verdict_substring(F.col("output")).alias("substring_rule"), T.verdict_exit(F.col("output"), F.col("event_id") % 3).alias("exit_rule"))


_NAMES = """CASE p_partkey % 5 WHEN 0 THEN 'tb_functional_req_' || p_partkey || '_module.c' WHEN 1 THEN 'SEC-TEST-' || p_partkey WHEN 2 THEN 'functional-REQ-' || p_size WHEN 3 THEN 'Security-REQ-' || p_size || ': x' ELSE p_name END"""


@query("req_index_parse", "", f"SELECT p_partkey, CAST(nullif(regexp_extract(s, 'req_(\\d+)_', 1), '') AS INT) AS of_file, coalesce(CAST(nullif(regexp_extract(s, 'REQ-(\\d+)', 1), '') AS INT), CAST(nullif(regexp_extract(s, 'TEST-(\\d+)', 1), '') AS INT) - 1, -1) AS of_test FROM (SELECT p_partkey, {_NAMES} AS s FROM part)")
def _(spark, d):
    rows = B.table(spark, d, "part").select("p_partkey", F.expr(_NAMES).alias("s"))
    return rows.select("p_partkey", T.req_index_of_file(F.col("s")).alias("of_file"), T.req_index_of_test(F.col("s")).alias("of_test"))


@query("req_id_parse", "", f"SELECT p_partkey, nullif(lower(regexp_extract(s, '(?i)^(FUNCTIONAL|SECURITY)-REQ-(\\d+)', 1)), '') AS suite, CAST(nullif(regexp_extract(s, '(?i)^(FUNCTIONAL|SECURITY)-REQ-(\\d+)', 2), '') AS INT) AS idx FROM (SELECT p_partkey, {_NAMES} AS s FROM part)")
def _(spark, d):
    rows = B.table(spark, d, "part").select("p_partkey", T.req_id(F.expr(_NAMES)).alias("r"))
    return rows.select("p_partkey", F.col("r.suite").alias("suite"), F.col("r.index").alias("idx"))


@query("title_line", "", "SELECT doc_id, coalesce(trim(string_split(text, chr(10))[1]), 'Unknown') AS title, substr(text, 1, 200) AS preview FROM documents")
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.title(F.col("text")).alias("title"), T.preview(F.col("text")).alias("preview"))


@query("model_dir_name", "", """SELECT p_partkey, translate(if(starts_with(b, 'models--'), replace(substr(b, 9), '--', '-'), b), '/:' || chr(92), '---') AS dir FROM (SELECT p_partkey, string_split(n, '/')[-1] AS b FROM (SELECT p_partkey, if(p_partkey % 2 = 0, '/cache/models--' || p_brand || '--' || p_type, 'org/' || p_type || ':' || p_size) AS n FROM part))""")
def _(spark, d):
    name = F.expr("if(p_partkey % 2 = 0, concat('/cache/models--', p_brand, '--', p_type), concat('org/', p_type, ':', p_size))")
    return B.table(spark, d, "part").select("p_partkey", T.model_dir(name).alias("dir"))


@query("task_ids", "seeds", "SELECT uuid, 'TASK-' || cwe_id || '-SEED' || (uuid % 10) AS task_id FROM seeds")
def _(spark, d):
    return B.seeds(spark, d).select("uuid", T.task_id(F.col("cwe_id"), F.col("uuid") % 10).alias("task_id"))


_REPLY = """CASE turn % 4 WHEN 0 THEN '<think>no ```c x``` </think>Here:' || chr(10) || '```c' || chr(10) || 'int f() { return ' || conv_id || '; }' || chr(10) || '``` done' WHEN 1 THEN 'text ``` a' || turn || ' ``` tail' WHEN 2 THEN 'So void go(int x) { y; } end' ELSE '  plain ' || role || '  ' END"""


@query("code_block_extract", "", rf"""WITH r AS (SELECT conv_id, turn, regexp_replace({_REPLY}, '<think>.*?</think>', '', 'gis') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?is)```c\s*(.*?)\s*```') THEN trim(regexp_extract(t, '(?is)```c\s*(.*?)\s*```', 1)) WHEN regexp_matches(t, '(?s)```\s*(.*?)\s*```') THEN trim(regexp_extract(t, '(?s)```\s*(.*?)\s*```', 1))
  WHEN regexp_matches(t, '(?s)\bvoid\s+\w+\s*\(.*?\)\s*\{{.*?\}}') THEN regexp_extract(t, '(?s)\bvoid\s+\w+\s*\(.*?\)\s*\{{.*?\}}') ELSE trim(t) END AS code FROM r""")
def _(spark, d):
    return B.chat(spark, d).select("conv_id", "turn", T.code_block(F.expr(_REPLY), "c").alias("code"))


@query("think_strip", "", f"SELECT conv_id, turn, trim(regexp_replace({_REPLY}, '<think>.*?</think>', '', 'gis')) AS reply FROM conversations")
def _(spark, d):
    return B.chat(spark, d).select("conv_id", "turn", T.without_thinking(F.expr(_REPLY)).alias("reply"))


@query("json_parse", "", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return B.table(spark, d, "events").select("event_id", T.parsed(F.col("props"), "k bigint")["k"].alias("k"))


@query("error_predicates", "", """SELECT event_id, regexp_matches(lower(m), '502|503|504|timeout|connection|network|rate limit|too many requests|service unavailable') AS retryable, contains(m, 'Compilation failed:') OR contains(m, 'Compilation timeout') OR contains(m, 'Command failed:') AS compile_failed
  FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'HTTP 503' WHEN 1 THEN 'Compilation failed: x' WHEN 2 THEN 'Rate Limit hit' ELSE event_type END AS m FROM events)""")
def _(spark, d):
    m = F.expr("CASE event_id % 4 WHEN 0 THEN 'HTTP 503' WHEN 1 THEN 'Compilation failed: x' WHEN 2 THEN 'Rate Limit hit' ELSE event_type END")
    return B.table(spark, d, "events").select("event_id", T.retryable(m).alias("retryable"), T.compile_failed(m).alias("compile_failed"))


@query("exit_messages", "", """SELECT event_id, CASE WHEN c < 0 THEN 'Process killed by ' || CASE c WHEN -11 THEN 'SIGSEGV' WHEN -9 THEN 'SIGKILL' ELSE 'Signal ' || (-c) END || ' (code ' || c || '). ' || e WHEN c > 0 AND e = '' THEN 'Process exited with code ' || c ELSE e END AS message
  FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN -11 WHEN 1 THEN -9 WHEN 2 THEN -40 WHEN 3 THEN 2 ELSE 0 END AS c, if(event_id % 2 = 0, event_type, '') AS e FROM events)""")
def _(spark, d):
    c, e = F.expr("CASE event_id % 5 WHEN 0 THEN -11 WHEN 1 THEN -9 WHEN 2 THEN -40 WHEN 3 THEN 2 ELSE 0 END"), F.expr("if(event_id % 2 = 0, event_type, '')")
    return B.table(spark, d, "events").select("event_id", T.exit_message(c, e).alias("message"))


@query("prompt_hints", "", """SELECT c_custkey, concat_ws(chr(10), c_name, if(c_custkey % 3 >= 1, 'Weakness: ' || n_name, null), if(c_custkey % 3 >= 2, 'Description: ' || c_mktsegment, null)) AS prompt FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def _(spark, d):
    nation = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = B.table(spark, d, "customer").join(nation, "c_nationkey")
    return rows.select("c_custkey", T.prompt(F.col("n_name"), F.col("c_mktsegment"), F.col("c_name"), F.col("c_custkey") % 3).alias("prompt"))


# Loops over logs

_TESTS = """SELECT if(event_id % 2 = 0, 'functional', 'security') AS suite, CAST(user_id AS INT) AS requirement_index, event_id AS seq, if(value > 30, '[TEST] PASS ', '[TEST] FAIL ') || event_type AS output, value > 30 AS passed FROM events"""


def _tests(spark, d):
    return B.table(spark, d, "events").selectExpr(
        "if(event_id % 2 = 0, 'functional', 'security') AS suite", "cast(user_id AS int) AS requirement_index", "event_id AS seq", "concat(if(value > 30, '[TEST] PASS ', '[TEST] FAIL '), event_type) AS output", "value > 30 AS passed"
    )


@query("locked_rerun", "", f"""WITH t AS ({_TESTS}), p AS (SELECT suite, requirement_index, arg_min(passed, seq) AS passed, arg_min(output, seq) AS output FROM t GROUP BY suite, requirement_index), n AS (SELECT suite, requirement_index, arg_max(passed, seq) AS passed, arg_max(output, seq) AS output FROM t GROUP BY suite, requirement_index)
SELECT p.suite, p.requirement_index, n.passed, if(p.passed AND n.passed, p.output, n.output) AS output, n.passed AS locked, CASE WHEN p.passed THEN p.output WHEN n.passed THEN n.output END AS expected_output FROM p JOIN n USING (suite, requirement_index)""")
def _(spark, d):
    rows, key = _tests(spark, d), ["suite", "requirement_index"]
    first = rows.groupBy(*key).agg(F.min_by("passed", "seq").alias("passed"), F.min_by("output", "seq").alias("output"))
    first = first.withColumns({"locked": F.col("passed"), "expected_output": F.when(F.col("passed"), F.col("output"))})
    last = rows.groupBy(*key).agg(F.max_by("passed", "seq").alias("passed"), F.max_by("output", "seq").alias("output"))
    return loop.rerun(first, last)


_CONFLICTS = """SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'FUNCTIONAL-REQ-' ELSE 'security-req-' END || (user_id % 20) AS req1_id, if(event_id % 5 = 0, 'REQ', 'Security-REQ-') || (event_id % 20) AS req2_id, event_type AS reason FROM events"""


@query("requirement_revisions", "", f"""WITH c AS ({_CONFLICTS}), ok AS (SELECT * FROM c WHERE regexp_matches(req2_id, '(?i)^(FUNCTIONAL|SECURITY)-REQ-\\d+')), s AS (SELECT req1_id AS own, req2_id AS other, seq, 1 AS nth, reason FROM ok UNION ALL SELECT req2_id, req1_id, seq, 2, reason FROM ok)
SELECT lower(regexp_extract(own, '(?i)^(FUNCTIONAL|SECURITY)', 1)) AS suite, CAST(regexp_extract(own, '(\\d+)$', 1) AS INT) AS requirement_index, arg_min('Contradiction with ' || other || ': ' || reason, (seq, nth)) AS feedback FROM s GROUP BY 1, 2""")
def _(spark, d):
    conflicts = B.table(spark, d, "events").selectExpr(
        "event_id AS seq", "concat(CASE event_id % 3 WHEN 0 THEN 'FUNCTIONAL-REQ-' ELSE 'security-req-' END, user_id % 20) AS req1_id", "concat(if(event_id % 5 = 0, 'REQ', 'Security-REQ-'), event_id % 20) AS req2_id", "event_type AS reason"
    )
    return loop.revisions(conflicts)


@query("failure_details", "", """SELECT user_id, string_agg(d, '|' ORDER BY f DESC, event_id::VARCHAR) AS details FROM (SELECT user_id, event_id, event_id % 2 = 0 AS f, if(event_id % 2 = 0, '[Functional] ', '[Security] ') || event_id || if(event_id % 3 = 0, ' - ' || event_type, '') || chr(10) || '  Error: ' || props AS d FROM events WHERE value <= 30) GROUP BY user_id""")
def _(spark, d):
    rows = B.table(spark, d, "events").selectExpr("user_id", "if(event_id % 2 = 0, 'functional', 'security') AS suite", "cast(event_id AS string) AS test_id", "if(event_id % 3 = 0, event_type, '') AS description", "props AS error", "value > 30 AS passed")
    return loop.failure_details(rows, "user_id").select("user_id", F.array_join("details", "|").alias("details"))


@query("iteration_replay", "", """WITH t AS (SELECT l_orderkey AS uuid, l_suppkey % 2 AS run_index, l_linenumber AS iteration, avg((l_linestatus = 'F')::INT) FILTER (l_partkey % 2 = 0) AS f, avg((l_linestatus = 'F')::INT) FILTER (l_partkey % 2 = 1) AS s, coalesce(bool_and(l_linestatus = 'F') FILTER (l_partkey % 2 = 0), true) AS success FROM lineitem GROUP BY 1, 2, 3)
SELECT uuid, run_index, iteration, coalesce(f, 0.0::DOUBLE) AS f_rate, coalesce(s, 0.0::DOUBLE) AS s_rate, success FROM t QUALIFY iteration <= coalesce(min(iteration) FILTER (success) OVER (PARTITION BY uuid, run_index), 1000)""")
def _(spark, d):
    tests = B.table(spark, d, "lineitem").selectExpr("l_orderkey AS uuid", "l_suppkey % 2 AS run_index", "l_linenumber AS iteration", "if(l_partkey % 2 = 0, 'functional', 'security') AS suite", "l_linestatus = 'F' AS passed")
    return loop.scored_iterations(tests)


@query("history_without_suite", "attempts", "SELECT req, seq FROM attempts WHERE NOT starts_with(verdict, 'tb')")
def _(spark, d):
    return loop.without_prefix(B.attempts(spark, d), "verdict", "tb").select("req", "seq")


@query("result_projection", "run_log runs", """SELECT uuid, '{"run_index":' || run_index || ',"success":' || success || ',"total_iterations":' || total_iterations || '}' AS json FROM runs""")
def _(spark, d):
    return _runs(spark, d).select("uuid", F.to_json(F.struct("run_index", "success", "total_iterations")).alias("json"))


@query("hex_flips", "", "SELECT p_partkey, lower(to_hex(xor(p_partkey, 255))) AS flipped FROM part")
def _(spark, d):
    return B.table(spark, d, "part").select("p_partkey", T.flipped_hex(F.hex("p_partkey")).alias("flipped"))


# Mutants and static coverage

_CODE = """concat_ws('\n', text, CASE doc_id % 3 WHEN 0 THEN concat('int f(int x) {\n  if (x) return ', doc_id, ' + 0x1f;\n  // skip 5\n  return x == 3 && x > 1;\n}')
  WHEN 1 THEN concat('module m(input a);\n  reg [7:0] r;\n  if (!a) r <= 8\\'hA5;\n  else r <= 8\\'b0101;\n  assign y = a && r;\nendmodule // ', doc_id) END)"""


@query("mutants")
def _(spark, d):
    rows = B.table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.expr("if(doc_id % 3 = 1, 'verilog', 'c')").alias("language"), F.expr(_CODE).alias("code"))
    return M.mutated(rows)


_CODE_SQL = _CODE.replace("\n  WHEN 1", " WHEN 1").replace("\\'", "''").replace("\n", "' || chr(10) || '").replace("concat_ws('' || chr(10) || '', text,", "concat_ws(chr(10), text,")
_BENCH = "initial begin a = 1; if (y) $finish; end"


@query("static_coverage", "", rf"""WITH s AS (SELECT list_distinct(list_concat(regexp_extract_all('{_BENCH}', '(\w+)\s*[<]?=', 1), regexp_extract_all('{_BENCH}', 'if\s*\([^)]*(\w+)', 1))) AS signals),
l AS (SELECT doc_id AS seed, unnest(string_split({_CODE_SQL}, chr(10))) AS line FROM documents),
e AS (SELECT seed, line FROM (SELECT seed, line, trim(line, E' \t\n\r\x0b\x0c') AS bare FROM l) WHERE bare <> '' AND NOT regexp_matches(bare, '^(//|/\*|module|endmodule|input|output|reg|wire)') AND regexp_matches(bare, '=|if|else|case'))
SELECT seed, count(*) AS lines_total, count(*) FILTER (len(list_filter(signals, lambda x: contains(line, x))) > 0) AS lines_covered FROM e, s GROUP BY seed""")
def _(spark, d):
    docs = B.table(spark, d, "documents")
    golden = docs.select(F.col("doc_id").alias("seed"), F.expr(_CODE).alias("code"))
    benches = docs.select(F.col("doc_id").alias("seed"), F.lit(_BENCH).alias("code"))
    return M.static_coverage(golden, benches)


@query("realtime_summary", _VALID, _PASSK_SUMMARY)
def _(spark, d):
    from tallyforge.streaming import incremental

    return incremental.realtime_summary(spark, f"{d}/lineitem.parquet", K)


from tallyforge.plans import loops, reports, texts  # noqa: E402, F401  register their queries
