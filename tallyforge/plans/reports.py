"""Named queries over reports, life cycles of documents and replies; the SQL applies the same rules to the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import quality, reports, runs, seeds
from tallyforge.plans import bindings as B
from tallyforge.plans.registry import _RUN_SUMMARY, _SEED_RATES, _VALID, _WITH_FIRST, query, with_first_rates
from tallyforge.streaming import incremental

_TESTS = "(SELECT l_orderkey AS uuid, if(l_linenumber % 2 = 0, 'security', 'functional') AS suite, l_linenumber - 1 AS requirement_index, l_linestatus = 'F' AS passed, l_returnflag, l_partkey FROM lineitem)"


def _tests(spark, d):
    return B.table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS uuid", "if(l_linenumber % 2 = 0, 'security', 'functional') AS suite", "l_linenumber - 1 AS requirement_index", "l_linestatus = 'F' AS passed", "l_returnflag", "l_partkey"
    )


@query("pass_rate_by_suite", "", f"SELECT uuid, suite, count(*) AS n_tests, count(*) FILTER (passed) AS n_passed, avg(passed::INT) AS pass_rate FROM {_TESTS} GROUP BY uuid, suite")
def _(spark, d):
    return reports.suite_pass_rates(_tests(spark, d))


@query(
    "all_tests_passed",
    "seeds",
    f"""SELECT uuid, if(n_suites = 2, every_one, coalesce(whole, true)) AS all_passed, if(n_suites = 2, 'tests', 'suites') AS by FROM seeds
  LEFT JOIN (SELECT uuid, count(DISTINCT suite) AS n_suites, bool_and(passed) AS every_one FROM {_TESTS} GROUP BY uuid) USING (uuid)
  LEFT JOIN (SELECT uuid, bool_and(passed_tests = 3) AS whole FROM (SELECT o_orderkey AS uuid, unnest([o_custkey % 4, 3]) AS passed_tests FROM orders WHERE o_custkey % 5 <> 0) GROUP BY uuid) USING (uuid)""",
)
def _(spark, d):
    suites = B.table(spark, d, "orders").where("o_custkey % 5 <> 0").selectExpr("o_orderkey AS uuid", "inline(array(named_struct('suite', 'functional', 'passed_tests', o_custkey % 4), named_struct('suite', 'security', 'passed_tests', 3)))")
    return reports.all_tests_passed(B.seeds(spark, d), _tests(spark, d), suites.withColumn("total_tests", F.lit(3)))


_COVERED = """(SELECT l_orderkey AS seed, if(l_suppkey % 3 = 0, 'branch', 'line') AS kind, l_partkey % 12 AS line, l_linestatus = 'F' AS covered FROM lineitem WHERE l_orderkey % 3 <> 0)"""
_COVERAGE = f"""(SELECT *, coalesce(line_covered / nullif(line_total, 0)::DOUBLE, 0.0::DOUBLE) AS line_coverage, coalesce(branch_covered / nullif(branch_total, 0)::DOUBLE, 0.0::DOUBLE) AS branch_coverage FROM
  (SELECT seed, count(*) FILTER (kind = 'line') AS line_total, count(*) FILTER (kind = 'line' AND hit) AS line_covered, count(*) FILTER (kind = 'branch') AS branch_total,
     count(*) FILTER (kind = 'branch' AND hit) AS branch_covered FROM (SELECT seed, kind, line, bool_or(covered) AS hit FROM {_COVERED} GROUP BY seed, kind, line) GROUP BY seed))"""


def _coverage(spark, d):
    lines = B.table(spark, d, "lineitem").where("l_orderkey % 3 <> 0").selectExpr("l_orderkey AS seed", "if(l_suppkey % 3 = 0, 'branch', 'line') AS kind", "l_partkey % 12 AS line", "l_linestatus = 'F' AS covered")
    return reports.coverage(lines)


@query("branch_coverage", "", f"SELECT * FROM {_COVERAGE}")
def _(spark, d):
    return _coverage(spark, d)


@query(
    "effectiveness_report",
    "mutant_runs",
    f"""SELECT count(*) AS seeds, count(*) FILTER (is_effective) AS effective, coalesce(avg(is_effective::INT), 0.0::DOUBLE) AS effectiveness_rate, coalesce(sum(mutants), 0)::BIGINT AS mutants,
  coalesce(sum(detected_mutants), 0)::BIGINT AS detected, coalesce(sum(detected_mutants)::DOUBLE / nullif(sum(mutants), 0)::DOUBLE, 0.0::DOUBLE) AS detection_rate,
  coalesce(sum(detected_pairs)::DOUBLE / nullif(sum(pairs), 0)::DOUBLE, 0.0::DOUBLE) AS per_tb_rate, count(line_coverage) AS seeds_with_coverage,
  coalesce(round(avg(line_coverage), 9), 0.0::DOUBLE) AS mean_line_coverage FROM ({_SEED_RATES}) LEFT JOIN {_COVERAGE} USING (seed)""",
)
def _(spark, d):
    found = reports.effectiveness_report(quality.per_seed(B.mutant_runs(spark, d)), _coverage(spark, d))
    return found.withColumn("mean_line_coverage", F.round("mean_line_coverage", 9))


@query(
    "batch_all_counters",
    "seeds",
    """SELECT count(*) AS total_cwes, count(*) FILTER (successful_seeds > 0) AS successful_cwes, sum(total_seeds)::BIGINT AS total_seeds, sum(completed_seeds)::BIGINT AS completed_seeds, sum(successful_seeds)::BIGINT AS successful_seeds
  FROM (SELECT cwe_id, count(*) AS total_seeds, count(*) FILTER (status IN ('completed', 'failed')) AS completed_seeds, count(*) FILTER (coalesce(passed, false)) AS successful_seeds FROM seeds GROUP BY cwe_id)""",
)
def _(spark, d):
    return reports.batch_all_counters(seeds.batch_counters(B.seeds(spark, d)).where("is_total = 0").drop("is_total"))


def _entries(spark, d):
    return B.table(spark, d, "customer").selectExpr("c_custkey AS seq", "c_nationkey AS cwe_id", "c_custkey % 7 AS total_seeds")


@query("appended_entries", "", "SELECT c_nationkey AS cwe_id, arg_max(c_custkey % 7, c_custkey) AS total_seeds, max(c_custkey) AS seq FROM customer GROUP BY c_nationkey")
def _(spark, d):
    return reports.appended_entries(_entries(spark, d))


@query("entry_counters", "", "SELECT count(DISTINCT c_nationkey) AS total_cwes, coalesce(sum(c_custkey % 7), 0)::BIGINT AS total_seeds FROM customer")
def _(spark, d):
    return reports.entry_counters(_entries(spark, d))


_MAPPING = "(SELECT uuid, run_index, min(run_index) OVER (PARTITION BY uuid, n_req) AS rep FROM runs)"


def _mapping(rows):
    least = rows.groupBy("uuid", "n_req").agg(F.min("run_index").alias("rep_run_index"))
    return rows.select("uuid", "run_index", "n_req").join(least, ["uuid", "n_req"]).select("uuid", "run_index", F.col("uuid").alias("rep_uuid"), "rep_run_index")


_ALL_RUNS = f"""valid AS (SELECT uuid, run_index, f_rate, s_rate, total_iterations, NULL AS copied_from FROM done UNION ALL
  SELECT m.uuid, m.run_index, f_rate, s_rate, total_iterations, m.uuid || '_run_' || m.rep FROM {_MAPPING} m JOIN done r ON r.uuid = m.uuid AND r.run_index = m.rep WHERE m.run_index <> m.rep)"""
_DONE = f"done AS (SELECT r.* FROM runs r JOIN {_MAPPING} m USING (uuid, run_index) WHERE m.run_index = m.rep AND end_time IS NOT NULL AND end_time <> '' AND total_iterations > 0)"


def _finalised(spark, d):
    rows = runs.upsert_latest(B.run_log(spark, d))
    mapping = _mapping(rows)
    own = mapping.where("run_index = rep_run_index").select("uuid", "run_index")
    done = runs.valid_runs(rows).join(own, ["uuid", "run_index"], "left_semi").select("uuid", "run_index", "f_rate", "s_rate", "total_iterations")
    return reports.finalised(done, mapping)


@query("finalised_results", "run_log runs", "SELECT uuid, run_index, f_rate, s_rate, total_iterations, copied_from FROM valid".join((f"SELECT * FROM (WITH {_DONE}, {_ALL_RUNS} ", ")")))
def _(spark, d):
    return _finalised(spark, d)


@query("finalised_summary", "run_log runs", f"SELECT * FROM (WITH {_DONE}, {_ALL_RUNS} {_RUN_SUMMARY} FROM {_WITH_FIRST})")
def _(spark, d):
    return runs.run_summary(with_first_rates(_finalised(spark, d)))


@query("copies_on_arrival", "run_log runs", f"SELECT uuid, run_index, f_rate, copied_from FROM (WITH done AS (SELECT * FROM runs WHERE true), {_ALL_RUNS} SELECT * FROM valid)")
def _(spark, d):
    rows = runs.upsert_latest(B.run_log(spark, d))
    return incremental.with_copies(rows, _mapping(rows)).select("uuid", "run_index", "f_rate", "copied_from")


@query("partitioned_verdicts", "attempts", "SELECT req, seq, verdict, CASE verdict WHEN 'problem_issue' THEN 'Architect' WHEN 'tb_issue' THEN 'RedTeamer' ELSE 'Expert' END AS routed_to FROM attempts WHERE verdict IN ('problem_issue', 'tb_issue', 'code_issue')")
def _(spark, d):
    return reports.partitioned_verdicts(B.attempts(spark, d)).select("req", "seq", "verdict", "routed_to")


_FILES = f"(SELECT uuid, suite, requirement_index, 'tb_' || suite || '_req_' || requirement_index || '.c' AS file, passed, l_returnflag AS output, l_partkey % 9 = 0 AS missing FROM {_TESTS} QUALIFY row_number() OVER (PARTITION BY uuid, requirement_index ORDER BY l_partkey, passed, l_returnflag) = 1)"


def _files(spark, d):
    one = F.min_by(F.struct("suite", "passed", F.col("l_returnflag").alias("output"), (F.col("l_partkey") % 9 == 0).alias("missing")), F.struct("l_partkey", "passed", "l_returnflag"))
    rows = _tests(spark, d).groupBy("uuid", "requirement_index").agg(one.alias("x")).select("uuid", "requirement_index", "x.*")
    return rows.withColumn("file", F.concat(F.lit("tb_"), "suite", F.lit("_req_"), F.col("requirement_index").cast("string"), F.lit(".c")))


@query(
    "case_tests",
    "",
    f"SELECT uuid, suite, requirement_index, file, passed AND NOT missing AS passed, if(missing, null, output) AS output, if(missing, 'Testbench file not found: ' || file, null) AS error, (suite <> 'functional')::INT AS turn FROM {_FILES}",
)
def _(spark, d):
    rows = _files(spark, d)
    return reports.case_tests(rows.select("uuid", "suite", "requirement_index", "file"), rows.where("NOT missing").select("uuid", "file", "passed", "output"))


@query(
    "suites_of_tests",
    "",
    f"""SELECT uuid, suite, string_agg('// Test for requirement ' || requirement_index || chr(10) || file, chr(10) || chr(10) || '// ========================================' || chr(10) || chr(10) ORDER BY requirement_index) AS test_code,
  string_agg('// Requirement ' || requirement_index || ': ' || if(ok, 'PASS', 'FAIL') || chr(10) || out, chr(10) ORDER BY requirement_index) AS test_output, count(*) AS total_tests, count(*) FILTER (ok) AS passed_tests,
  count(*) FILTER (NOT ok) AS failed_tests, avg(ok::INT) AS pass_rate, string_agg(upper(suite) || '-REQ-' || requirement_index || '=' || if(ok, out, 'Test intent: ' || file || ' | ' || if(out <> '', 'Output: ' || out, 'Error: Testbench file not found: ' || file)), ';' ORDER BY requirement_index) AS reasons,
  string_agg(if(ok, '-', 'CODE_BUG'), ';' ORDER BY requirement_index) AS causes
  FROM (SELECT *, passed AND NOT missing AS ok, if(missing, '', output) AS out FROM {_FILES}) GROUP BY uuid, suite""",
)
def _(spark, d):
    rows = _files(spark, d)
    tests = reports.case_tests(rows.select("uuid", "suite", "requirement_index", "file"), rows.where("NOT missing").select("uuid", "file", "passed", "output"))
    found = reports.suites_of(tests.withColumns({"code": F.col("file"), "explanation": F.col("file")}))
    texts = lambda f: F.array_join(F.transform("judgments", f), ";")
    return found.withColumn("reasons", texts(lambda j: F.concat(j["test_id"], F.lit("="), j["reason"]))).withColumn("causes", texts(lambda j: F.coalesce(j["root_cause"], F.lit("-")))).drop("judgments")


@query("requirement_test", "", f"SELECT uuid, requirement_index, file FROM {_FILES} WHERE uuid = (SELECT min(l_orderkey) FROM lineitem WHERE l_linenumber = 1) AND suite = 'functional' AND requirement_index = 0")
def _(spark, d):
    least = B.table(spark, d, "lineitem").where("l_linenumber = 1").agg(F.min("l_orderkey").alias("uuid"))
    return reports.requirement_test(_files(spark, d).join(F.broadcast(least), "uuid"), "functional", 0).select("uuid", "requirement_index", "file")


@query("sorted_directories", "seeds", "SELECT uuid, 'cwe-' || cwe_id || '/' || uuid AS dir FROM seeds ORDER BY dir")
def _(spark, d):
    return B.seeds(spark, d).select("uuid", F.concat(F.lit("cwe-"), "cwe_id", F.lit("/"), F.col("uuid").cast("string")).alias("dir")).orderBy("dir")


@query("timestamps", "", "SELECT event_id, if(microsecond(ts) % 1000000 = 0, strftime(ts, '%Y-%m-%dT%H:%M:%S'), strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def _(spark, d):
    return B.table(spark, d, "events").select("event_id", reports.iso(F.col("ts")).alias("iso"), reports.compact(F.col("ts")).alias("stamp"))


@query("run_counters", "run_log runs", "SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM runs")
def _(spark, d):
    return runs.upsert_latest(B.run_log(spark, d)).agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


# Replies: whole texts of conversations and documents in several envelopes, of which each rule finds its own.

_WHITE_SQL = r"E' \t\n\r\x0b\x0c'"
_REPLY_CODE = """(SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'see' || chr(10) || '```verilog' || chr(10) || t || chr(10) || '```' || chr(10) || 'done' WHEN 1 THEN '```' || chr(10) || t || chr(10) || '``` ' || t
  WHEN 2 THEN '```c ' || t || ' ```' ELSE '  ' || t || chr(10) END AS reply FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations))"""


def _replies(spark, d, *envelopes):
    """The texts of all turns, each in one of the envelopes, in which None stands for the text."""
    return _enveloped(B.table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), envelopes)


def _enveloped(talks, envelopes):
    number, out = (F.col("conv_id") + F.col("turn")) % len(envelopes), F.lit(None).cast("string")
    for k, parts in enumerate(envelopes):
        out = F.when(number == k, F.concat(*(F.col("text") if p is None else F.lit(p) for p in parts))).otherwise(out)
    return talks.select("conv_id", "turn", out.alias("reply"))


@query("generated_code", "", rf"""SELECT conv_id, turn, trim(if(regexp_matches(reply, '(?s)```(?:verilog|c|systemverilog)?\s*\n(.*?)\n```'), regexp_extract(reply, '(?s)```(?:verilog|c|systemverilog)?\s*\n(.*?)\n```', 1), reply), {_WHITE_SQL}) AS code FROM {_REPLY_CODE}""")
def _(spark, d):
    rows = _replies(spark, d, ("see\n```verilog\n", None, "\n```\ndone"), ("```\n", None, "\n``` ", None), ("```c ", None, " ```"), ("  ", None, "\n"))
    return rows.select("conv_id", "turn", T.generated_code(F.col("reply")).alias("code"))


_SAFE = r"regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]', ' ', 'g')"
_REPLY_DECISION = f"""(SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'x ```json' || chr(10) || '{{"verdict": "TB_ISSUE", "guidance": "' || t || '"}}' || chr(10) || '``` y' WHEN 1 THEN t || ' {{"verdict": "problem_issue", "guidance": "' || t || '"}} ' || t
  WHEN 2 THEN '{{"guidance": "' || t || '", "verdict": "unclear"}}' WHEN 3 THEN t || ' the testbench has a bug. Fix: ' || t WHEN 4 THEN '```json {{"verdict": ' || t || '}} ``` problem_issue' ELSE t END AS reply
  FROM (SELECT conv_id, turn, {_SAFE} AS t FROM conversations))"""


def _safe_replies(spark, d, *envelopes):
    """As _replies, of the texts without signs that JSON has to escape."""
    return _enveloped(B.table(spark, d, "conversations").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 .,]", " ")), envelopes)


_PICK = r"""if(regexp_matches(reply, '(?s)```(?:json)?\s*(\{.*?\})\s*```'), regexp_extract(reply, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1),
  if(regexp_matches(reply, '(?s)\{\s*"verdict"\s*:\s*"[^"]+"\s*,\s*"guidance"\s*:\s*"[^"]*(?:\\.[^"]*)*"\s*\}'), regexp_extract(reply, '(?s)\{\s*"verdict"\s*:\s*"[^"]+"\s*,\s*"guidance"\s*:\s*"[^"]*(?:\\.[^"]*)*"\s*\}', 0), trim(reply)))"""
_HINT = r"(?i)(?:guidance|fix|solution)[:\s]*(.{20,200})"


@query(
    "arbiter_replies",
    "",
    rf"""SELECT conv_id, turn, CASE WHEN j THEN if(lower(source ->> 'verdict') IN ('code_issue', 'tb_issue', 'problem_issue', 'unclear'), lower(source ->> 'verdict'), 'code_issue')
  WHEN regexp_matches(lower(reply), 'tb_issue|testbench has|tb has bug') THEN 'tb_issue' WHEN regexp_matches(lower(reply), 'problem_issue|requirement unclear') THEN 'problem_issue' ELSE 'code_issue' END AS verdict,
  CASE WHEN j THEN coalesce(source ->> 'guidance', '') WHEN regexp_matches(reply, '{_HINT}') THEN trim(regexp_extract(reply, '{_HINT}', 1), {_WHITE_SQL}) ELSE 'Review implementation based on test output.' END AS guidance,
  if(j, 'json', 'words') AS by FROM (SELECT *, if(json_valid(source), json_type(source) = 'OBJECT', false) AS j FROM (SELECT *, {_PICK} AS source FROM {_REPLY_DECISION}))""",
)
def _(spark, d):
    rows = _safe_replies(
        spark, d, ('x ```json\n{"verdict": "TB_ISSUE", "guidance": "', None, '"}\n``` y'), (None, ' {"verdict": "problem_issue", "guidance": "', None, '"} ', None), ('{"guidance": "', None, '", "verdict": "unclear"}'),
        (None, " the testbench has a bug. Fix: ", None), ('```json {"verdict": ', None, "} ``` problem_issue"), (None,),
    )
    return rows.withColumn("x", T.arbiter(F.col("reply"))).select("conv_id", "turn", "x.*")


_REPLY_CHECK = f"""(SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN 'so ```json {{"has_contradictions": true, "contradictions": [{{"summary": "' || t || '"}}], "suggestions": ["' || t || '"]}} ```'
  WHEN 1 THEN 'I say {{"has_contradictions": false, "contradictions": [], "suggestions": ["' || t || '"]}} ' || t ELSE t || ' {{' END AS reply FROM (SELECT conv_id, turn, {_SAFE} AS t FROM conversations))"""


@query(
    "contradiction_replies",
    "",
    rf"""SELECT conv_id, turn, coalesce((source -> '$.has_contradictions')::BOOLEAN, false) AS found, coalesce(json_array_length(source, '$.contradictions'), 0)::INT AS n_items, coalesce(source ->> '$.contradictions[0].summary', '') AS summary,
  coalesce(source ->> '$.suggestions[0]', '') AS suggestion, source IS NULL AS failed FROM (SELECT conv_id, turn, if(regexp_matches(reply, '(?s)```(?:json)?\s*(\{{.*?\}})\s*```'), regexp_extract(reply, '(?s)```(?:json)?\s*(\{{.*?\}})\s*```', 1),
    nullif(regexp_extract(reply, '(?s)\{{.*"has_contradictions".*\}}', 0), '')) AS source FROM {_REPLY_CHECK})""",
)
def _(spark, d):
    rows = _safe_replies(
        spark, d, ('so ```json {"has_contradictions": true, "contradictions": [{"summary": "', None, '"}], "suggestions": ["', None, '"]} ```'),
        ('I say {"has_contradictions": false, "contradictions": [], "suggestions": ["', None, '"]} ', None), (None, " {"),
    )
    x = T.checked_requirements(F.col("reply"))
    none = lambda c: F.coalesce(c, F.lit(""))
    rows = rows.withColumn("x", x)
    return rows.select("conv_id", "turn", "x.found", F.size("x.items").alias("n_items"), none(F.get("x.items", F.lit(0))["summary"]).alias("summary"), none(F.get("x.suggestions", F.lit(0))).alias("suggestion"), "x.failed")


_REPLY_FEEDBACK = f"""(SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'a ```json' || chr(10) || '{{"verdict": "TB_ERROR", "reasoning": "' || t || '", "confidence": 0.5}}' || chr(10) || '```' WHEN 1 THEN t || ' {{"verdict": "CODE_BUG", "evidence": "' || t || '"}}'
  WHEN 2 THEN t || ' CODE_BUG ' ELSE t END AS reply FROM (SELECT conv_id, turn, {_SAFE} AS t FROM conversations))"""


@query(
    "feedback_replies",
    "",
    rf"""SELECT conv_id, turn, CASE WHEN source IS NOT NULL THEN coalesce(source ->> 'verdict', 'TB_ERROR') WHEN contains(reply, 'CODE_BUG') THEN 'CODE_BUG' END AS verdict,
  CASE WHEN source IS NOT NULL THEN source ->> 'reasoning' WHEN contains(reply, 'CODE_BUG') THEN 'RedTeam believes this is a code issue (legacy format)' END AS reasoning,
  CASE WHEN source IS NOT NULL THEN (source ->> 'confidence')::DOUBLE WHEN contains(reply, 'CODE_BUG') THEN 0.7::DOUBLE END AS confidence, source ->> 'evidence' AS evidence
  FROM (SELECT *, if(regexp_matches(reply, '(?s)```json\s*\n(.*?)\n```'), regexp_extract(reply, '(?s)```json\s*\n(.*?)\n```', 1), nullif(regexp_extract(reply, '(?s)\{{[^{{}}]*"verdict"[^{{}}]*\}}', 0), '')) AS source FROM {_REPLY_FEEDBACK})""",
)
def _(spark, d):
    rows = _safe_replies(
        spark, d, ('a ```json\n{"verdict": "TB_ERROR", "reasoning": "', None, '", "confidence": 0.5}\n```'), (None, ' {"verdict": "CODE_BUG", "evidence": "', None, '"}'), (None, " CODE_BUG "), (None,)
    )
    return rows.withColumn("x", T.red_team_feedback(F.col("reply"))).select("conv_id", "turn", "x.verdict", "x.reasoning", "x.confidence", "x.evidence")


_DECLARED = "(SELECT doc_id, coalesce(text, '') || chr(10) || if(doc_id % 2 = 0, 'module m' || (doc_id % 5) || ' (input a); endmodule', 'static int f' || (doc_id % 5) || ' (int a) { return a; }') AS code, if(doc_id % 2 = 0, 'm', 'f') || (doc_id % 4) AS name, if(doc_id % 2 = 0, 'verilog', 'c') AS language FROM documents)"


@query(
    "name_errors",
    "",
    rf"""SELECT doc_id, CASE WHEN language = 'verilog' THEN CASE WHEN len(found) = 0 THEN 'No module declaration found in code' WHEN NOT list_contains(found, name) THEN 'Module name mismatch: expected ''' || name || ''', but found ''' || array_to_string(found, ', ') || '''' END
  WHEN NOT regexp_matches(code, '\b\w+\s+' || name || '\s*\(') THEN 'Function ''' || name || ''' not found in code' END AS error FROM (SELECT *, regexp_extract_all(code, '\bmodule\s+(\w+)\s*[#(;]', 1) AS found FROM {_DECLARED})""",
)
def _(spark, d):
    number = lambda n: (F.col("doc_id") % n).cast("string")
    verilog = F.concat(F.lit("module m"), number(5), F.lit(" (input a); endmodule"))
    c = F.concat(F.lit("static int f"), number(5), F.lit(" (int a) { return a; }"))
    even = F.col("doc_id") % 2 == 0
    rows = B.table(spark, d, "documents").select(
        "doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.when(even, verilog).otherwise(c)).alias("code"), F.concat(F.when(even, "m").otherwise("f"), number(4)).alias("name"), F.when(even, "verilog").otherwise("c").alias("language")
    )
    return rows.select("doc_id", T.name_error(F.col("code"), F.col("name"), F.col("language")).alias("error"))
