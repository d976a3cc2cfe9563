"""Queries over logs of loops, sweeps and streams, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import dedup, fixpoint, history, matching, runs, scan, sweep
from tallyforge.plans import bindings as B
from tallyforge.plans.registry import _PASSK_SUMMARY, _VALID, K, query
from tallyforge.plans.reports import _SAFE, _safe_replies

# Evaluation loop with rollback

MOST_ITERATIONS = 50
_FIXES = """f AS (SELECT user_id AS uuid, event_id % 2 AS run_index, event_id AS iteration, event_type = 'purchase' AND event_id % 3 = 0 AS passed,
  CAST(nullif(event_id % 7, 0) AS INT) AS compiles_at FROM events)"""


@query("fix_replay", "", f"""WITH {_FIXES},
n AS (SELECT *, row_number() OVER (PARTITION BY uuid, run_index ORDER BY iteration) AS nth FROM f),
s AS (SELECT *, min(nth) FILTER (passed) OVER (PARTITION BY uuid, run_index) AS stop FROM n),
g AS (SELECT *, NOT passed AND coalesce(compiles_at <= 4, false) AS fine FROM s WHERE nth <= {MOST_ITERATIONS} AND (stop IS NULL OR nth <= stop))
SELECT uuid, run_index, iteration, passed, compiles_at, CAST(nth AS INT) AS nth, CAST(coalesce(max(nth) FILTER (fine) OVER w, 0) AS INT) AS code,
  CAST(2 * count(*) FILTER (fine) OVER w AS INT) AS messages, NOT passed AND NOT fine AS rolled_back
FROM g WINDOW w AS (PARTITION BY uuid, run_index ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    fixes = B.table(spark, d, "events").selectExpr(
        "user_id AS uuid", "event_id % 2 AS run_index", "event_id AS iteration", "event_type = 'purchase' AND event_id % 3 = 0 AS passed", "cast(nullif(event_id % 7, 0) AS int) AS compiles_at"
    )
    return history.fixed_iterations(fixes, MOST_ITERATIONS)


# The text of a document inside of two blocks; its own lines with "end" close them.
_OPENS = r"wire a;\nalways @(posedge clk) begin\n  if (a) begin\n"
_CLOSES = r"\n  end\nend\nassign z = a;"


@query("block_lines", "", rf"""WITH t AS (SELECT doc_id, string_split(E'{_OPENS}' || coalesce(text, '') || E'{_CLOSES}', chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, CAST(u.i AS INT) AS n, ls[u.i] AS line FROM t, unnest(range(1, len(ls) + 1)) AS u(i)),
s AS (SELECT doc_id, n, regexp_matches(line, 'always @|always_ff @|always_comb') AS opens, contains(line, 'end') AS ends, contains(line, 'begin')::INT - contains(line, 'end')::INT AS step FROM l),
o AS (SELECT *, max(n) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY n) AS opened FROM s),
p AS (SELECT doc_id, n, opened, ends, CAST(sum(step) OVER (PARTITION BY doc_id, opened ORDER BY n) AS INT) AS depth FROM o WHERE opened IS NOT NULL)
SELECT doc_id, n, depth FROM p QUALIFY n <= coalesce(min(n) FILTER (ends AND depth <= 0) OVER (PARTITION BY doc_id, opened), n)""")
def _(spark, d):
    code = F.concat(F.lit(_OPENS.replace(r"\n", "\n")), F.coalesce("text", F.lit("")), F.lit(_CLOSES.replace(r"\n", "\n")))
    lines = B.table(spark, d, "documents").select("doc_id", F.posexplode(F.split(code, "\n")).alias("n", "line"))
    return history.block_lines(lines.withColumn("n", F.col("n") + 1))


@query("ranked_directories", "seeds", """SELECT uuid, 'cwe-' || cwe_id || '/' || uuid AS dir, CAST(row_number() OVER (ORDER BY 'cwe-' || cwe_id || '/' || uuid) AS INT) AS nth FROM seeds""")
def _(spark, d):
    rows = B.seeds(spark, d).select("uuid", F.concat(F.lit("cwe-"), "cwe_id", F.lit("/"), F.col("uuid").cast("string")).alias("dir"))
    return scan.numbered(rows.withColumn("all", F.lit(1)), ["all"], ["dir"]).drop("all")


# Generation loop with a shared budget

BUDGET = 6
_LOG = """base AS (SELECT l_orderkey AS c, l_linenumber AS r, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
log AS (SELECT c AS "case", if(r % 2 = 0, 'functional', 'security') AS suite, r AS requirement_index, CAST(a AS INT) AS attempt, (p * (a + 3)) % 10 < 3 + a AS passed,
  CASE (p + a) % 4 WHEN 0 THEN 'problem_issue' WHEN 1 THEN 'tb_issue' ELSE 'code_issue' END AS verdict, (s + a) % 2 = 0 AS revised FROM base, range(0, 8) AS t(a) WHERE a < 3 + s % 6)"""
_FIXPOINT = f"""WITH RECURSIVE {_LOG},
t("case", suite, requirement_index, attempt, action, total, expert, red_team, iteration) AS (
  SELECT DISTINCT "case", suite, requirement_index, 0, 'initial', 1, 1, 0, 1 FROM log
  UNION ALL
  SELECT "case", suite, requirement_index,
    attempt + CASE following WHEN 'revise' THEN suite_revised::INT WHEN 'fix_tests' THEN (NOT passed AND verdict = 'tb_issue')::INT ELSE 1 END,
    following, total + 1, expert + (following <> 'fix_tests')::INT, red_team + (following = 'fix_tests')::INT, iteration + 1
  FROM (SELECT *, CASE WHEN revised_any THEN 'revise' WHEN tb_any THEN 'fix_tests' ELSE 'fix_code' END AS following
    FROM (SELECT t.*, log.passed, log.verdict, count(*) FILTER (NOT log.passed) OVER w AS failing, bool_or(log.passed IS NULL) OVER w AS lacking,
        coalesce(bool_or(NOT log.passed AND log.verdict = 'problem_issue' AND log.revised) OVER w, false) AS revised_any, coalesce(bool_or(NOT log.passed AND log.verdict = 'tb_issue') OVER w, false) AS tb_any,
        coalesce(bool_or(NOT log.passed AND log.verdict = 'problem_issue' AND log.revised) OVER (PARTITION BY t."case", t.suite), false) AS suite_revised
      FROM t LEFT JOIN log ON log."case" = t."case" AND log.suite = t.suite AND log.requirement_index = t.requirement_index AND log.attempt = t.attempt
      WINDOW w AS (PARTITION BY t."case")))
  WHERE NOT lacking AND failing > 0 AND total < {BUDGET}),
j AS (SELECT t.*, log.passed, log.verdict FROM t LEFT JOIN log ON log."case" = t."case" AND log.suite = t.suite AND log.requirement_index = t.requirement_index AND log.attempt = t.attempt)
SELECT "case", iteration, action, if(count(*) FILTER (NOT passed) = 0, 'PASS', concat_ws(',', if(bool_or(NOT passed AND verdict = 'problem_issue'), 'problem_issue', NULL),
    if(bool_or(NOT passed AND verdict = 'tb_issue'), 'tb_issue', NULL), if(bool_or(NOT passed AND verdict = 'code_issue'), 'code_issue', NULL))) AS issues,
  count(*) FILTER (NOT passed) AS n_failing, total, expert, red_team,
  CASE WHEN bool_or(passed IS NULL) THEN 'unrecorded' WHEN count(*) FILTER (NOT passed) = 0 THEN 'passed' WHEN total >= {BUDGET} THEN 'budget' END AS outcome
FROM j GROUP BY "case", iteration, action, total, expert, red_team"""


@query("fixpoint_replay", "", _FIXPOINT)
def _(spark, d):
    base = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("r")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    log = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("a")).where("a < 3 + s % 6").selectExpr(
        "c AS case", "if(r % 2 = 0, 'functional', 'security') AS suite", "r AS requirement_index", "a AS attempt", "(p * (a + 3)) % 10 < 3 + a AS passed",
        "CASE (p + a) % 4 WHEN 0 THEN 'problem_issue' WHEN 1 THEN 'tb_issue' ELSE 'code_issue' END AS verdict", "(s + a) % 2 = 0 AS revised",
    )
    return fixpoint.replayed(log, BUDGET)


# Sweeps


@query("swept_levels", "", """WITH o AS (SELECT o_custkey AS key, CAST(o_orderkey % 3 AS INT) AS level, bool_and(o_orderstatus <> 'F' OR o_orderkey % 4 <> 0) AS ok, count(*) AS n FROM orders GROUP BY ALL),
z AS (SELECT * FROM o WHERE level = 0), y AS (SELECT * FROM o WHERE level = 1 AND key IN (SELECT key FROM z WHERE ok)), x AS (SELECT * FROM o WHERE level = 2 AND key IN (SELECT key FROM y WHERE ok))
SELECT * FROM z UNION ALL SELECT * FROM y UNION ALL SELECT * FROM x""")
def _(spark, d):
    outcomes = B.table(spark, d, "orders").selectExpr("o_custkey AS key", "cast(o_orderkey % 3 AS int) AS level", "o_orderstatus <> 'F' OR o_orderkey % 4 <> 0 AS ok")
    return sweep.swept(outcomes, (0, 1, 2))


# Streams with keyed state


@query("live_summary", _VALID, _PASSK_SUMMARY)
def _(spark, d):
    from tallyforge.streaming import keyed

    return keyed.live_results(spark, f"{d}/lineitem.parquet", K).summary()


@query("live_completions", "run_log runs", "SELECT uuid FROM runs GROUP BY uuid HAVING count(DISTINCT run_index) >= 3 AND bool_or(coalesce(run_index, 0) = 0)")
def _(spark, d):
    from tallyforge.streaming import keyed

    return keyed.live_results(spark, f"{d}/lineitem.parquet", K).events("completed").select("uuid")


# Copies of results, replies in whole texts

_BODY = "'int step(int x) { return x * ' || (l_partkey % 40) || '; }'"
_WRITTEN = f"CASE l_orderkey % 3 WHEN 0 THEN {_BODY} || ' // run ' || l_orderkey WHEN 1 THEN '/* ' || l_orderkey || ' */' || {_BODY} ELSE replace({_BODY}, ' ', '  ') END"


@query("copied_results", "", rf"""WITH code AS (SELECT l_suppkey AS uuid, l_orderkey * 10 + l_linenumber AS run_index, min({_WRITTEN}) AS code, bool_or(l_linestatus = 'F') AS functional, bool_or(l_returnflag = 'R') AS secure FROM lineitem GROUP BY ALL),
h AS (SELECT *, sha256(regexp_replace(regexp_replace(regexp_replace(code, '/\*.*?\*/', '', 'gs'), '//[^\n]*', '', 'g'), '\s+', '', 'g')) AS code_hash FROM code),
m AS (SELECT uuid, run_index, min(run_index) OVER (PARTITION BY uuid, code_hash) AS rep FROM h)
SELECT m.uuid, m.run_index, r.functional, r.secure, m.uuid || '/' || m.rep AS copied_from FROM m JOIN code r ON r.uuid = m.uuid AND r.run_index = m.rep
WHERE m.run_index <> m.rep AND m.run_index % 5 = 0 AND m.rep % 5 <> 0""")
def _(spark, d):
    rows = B.table(spark, d, "lineitem").selectExpr("l_suppkey AS uuid", "l_orderkey * 10 + l_linenumber AS run_index", f"{_WRITTEN} AS code", "l_linestatus = 'F' AS functional", "l_returnflag = 'R' AS secure")
    code = rows.groupBy("uuid", "run_index").agg(F.min("code").alias("code"), F.bool_or("functional").alias("functional"), F.bool_or("secure").alias("secure"))
    mapping = dedup.representatives(dedup.hashed(code))
    # A fifth of the runs has no result yet, and what stands for them may be one of these.
    return dedup.copied_results(mapping, code.where("run_index % 5 <> 0").select("uuid", "run_index", "functional", "secure"))


_TAGS = ("think", "thinking", "reasoning", "reflection", "inner_thought")
_TAG = f"CASE turn % 5 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAGS))} END"
#: A thought of the whole text in front of it, and the text again in a fence for every other turn.
_THOUGHT = f"'<' || {_TAG} || '>' || coalesce(text, '') || '</' || upper({_TAG}) || '> so' || chr(10) || if(conv_id % 2 = 0, '```c' || chr(10) || coalesce(text, '') || chr(10) || '```', coalesce(text, ''))"
_UNTHOUGHT = _THOUGHT
for _t in _TAGS:
    _UNTHOUGHT = f"regexp_replace({_UNTHOUGHT}, '<{_t}>.*?</{_t}>', '', 'gis')"
_UNTHOUGHT = f"trim({_UNTHOUGHT}, E' \\t\\n\\r\\x0b\\x0c')"


@query("thoughtless_texts", "", f"SELECT conv_id, turn, {_UNTHOUGHT} AS reply FROM conversations")
def _(spark, d):
    return B.chat(spark, d).select("conv_id", "turn", T.without_thinking(F.expr(_THOUGHT)).alias("reply"))


@query("signal_lines", "lines", """SELECT l.doc_id, l.n, coalesce(len(list_filter(s.signals, lambda x: length(x) >= 6 AND contains(l.line, x))) > 0, false) AS hit FROM lines l
  LEFT JOIN (SELECT doc_id, string_split(lower(line), ' ') AS signals FROM lines WHERE n = 1) s USING (doc_id)""")
def _(spark, d):
    lines = B.lines(spark, d)
    signals = lines.where("n = 1").select("doc_id", F.filter(F.split(F.lower("line"), " "), lambda s: F.length(s) >= 6).alias("patterns"))
    return matching.with_hits(lines, signals, "doc_id").select("doc_id", "n", "hit")


_LEAKS = f"""(SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN 'so ```json {{"has_leakage": true, "leakages": [{{"req_id": "' || t || '"}}, {{"req_id": "x"}}], "suggestions": ["' || t || '"]}} ```'
  WHEN 1 THEN 'no: {{"has_leakage": false, "leakages": []}} ' || t ELSE t || ' {{' END AS reply FROM (SELECT conv_id, turn, {_SAFE} AS t FROM conversations))"""


@query("leakage_replies", "", rf"""SELECT conv_id, turn, coalesce((source -> '$.has_leakage')::BOOLEAN, false) AS found, coalesce(json_array_length(source, '$.leakages'), 0)::INT AS n_items,
  coalesce(source ->> '$.leakages[0].req_id', '') AS first, coalesce(json_array_length(source, '$.suggestions'), 0)::INT AS n_suggestions, source IS NULL AS failed
  FROM (SELECT conv_id, turn, if(regexp_matches(reply, '(?s)```(?:json)?\s*(\{{.*?\}})\s*```'), regexp_extract(reply, '(?s)```(?:json)?\s*(\{{.*?\}})\s*```', 1),
    nullif(regexp_extract(reply, '(?s)\{{.*"has_leakage".*\}}', 0), '')) AS source FROM {_LEAKS})""")
def _(spark, d):
    rows = _safe_replies(
        spark, d, ('so ```json {"has_leakage": true, "leakages": [{"req_id": "', None, '"}, {"req_id": "x"}], "suggestions": ["', None, '"]} ```'),
        ('no: {"has_leakage": false, "leakages": []} ', None), (None, " {"),
    )
    rows = rows.withColumn("x", T.checked_requirements(F.col("reply"), "leakages"))
    first = F.coalesce(F.get("x.items", F.lit(0))["req_id"], F.lit(""))
    return rows.select("conv_id", "turn", "x.found", F.size("x.items").alias("n_items"), first.alias("first"), F.size("x.suggestions").alias("n_suggestions"), "x.failed")


@query("inferred_languages", "", """WITH m AS (SELECT conv_id, CASE WHEN conv_id % 4 < 3 THEN 'SystemMessage' ELSE 'HumanMessage' END AS kind,
  CASE conv_id % 3 WHEN 0 THEN 'Write Verilog. ' WHEN 1 THEN 'You know C programming. ' ELSE '' END || coalesce(arg_min(text, turn), '') AS content FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN kind <> 'SystemMessage' THEN NULL WHEN contains(content, 'Verilog') OR contains(content, 'verilog') THEN 'verilog' WHEN contains(content, 'C programming') OR contains(content, '```c') THEN 'c' END AS language FROM m""")
def _(spark, d):
    first = B.chat(spark, d).groupBy("conv_id").agg(F.coalesce(F.min_by("text", "turn"), F.lit("")).alias("text"))
    kind = F.expr("CASE WHEN conv_id % 4 < 3 THEN 'SystemMessage' ELSE 'HumanMessage' END")
    said = F.concat(F.expr("CASE conv_id % 3 WHEN 0 THEN 'Write Verilog. ' WHEN 1 THEN 'You know C programming. ' ELSE '' END"), "text")
    return first.select("conv_id", T.inferred_language(kind, said).alias("language"))


@query("change_lists", "", """WITH d AS (SELECT doc_id, lang, source, if(doc_id % 2 = 0, upper(lang), lang) AS new_lang, string_split(coalesce(text, ''), chr(10)) AS o, string_split(replace(coalesce(text, ''), 'ing', 'ed') || if(doc_id % 3 = 0, chr(10) || 'more', ''), chr(10)) AS n FROM documents),
c AS (SELECT doc_id, -1 AS i, 'lang: ' || coalesce(lang, '(none)') || ' -> ' || coalesce(new_lang, '(none)') AS what FROM d WHERE lang IS DISTINCT FROM new_lang
  UNION ALL SELECT doc_id, i - 1, 'lines[' || (i - 1) || ']: ' || coalesce(o[i], '(none)') || ' -> ' || coalesce(n[i], '(none)') FROM d, unnest(range(1, greatest(len(o), len(n)) + 1)) AS u(i) WHERE o[i] IS DISTINCT FROM n[i])
SELECT doc_id, count(*)::INT AS n_changes, string_agg(what, chr(10) ORDER BY i) AS changes FROM c GROUP BY doc_id""")
def _(spark, d):
    text = F.coalesce("text", F.lit(""))
    lines = lambda x: F.split(x, "\n")
    more = F.expr("if(doc_id % 3 = 0, '\nmore', '')")
    old = F.struct("lang", lines(text).alias("lines"))
    new = F.struct(F.expr("if(doc_id % 2 = 0, upper(lang), lang)").alias("lang"), lines(F.concat(F.replace(text, F.lit("ing"), F.lit("ed")), more)).alias("lines"))
    rows = B.table(spark, d, "documents").select("doc_id", old.alias("o"), new.alias("n"))
    rows = rows.select("doc_id", T.change_list(F.col("o"), F.col("n"), ["lang"], ["lines"]).alias("c")).where(F.size("c") > 0)
    return rows.select("doc_id", F.size("c").alias("n_changes"), F.array_join("c", "\n").alias("changes"))


@query("finished_update", "seeds", """SELECT s.uuid, coalesce(u.status, s.status) AS status, strftime(u.end_time, '%Y-%m-%d %H:%M:%S.%f') AS end_time FROM seeds s LEFT JOIN
  (SELECT user_id AS uuid, arg_max(st, event_id) FILTER (st IS NOT NULL) AS status, arg_max(ts, event_id) FILTER (st IN ('completed', 'failed')) AS end_time FROM
    (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'in_progress' END AS st FROM events) GROUP BY user_id) u USING (uuid)""")
def _(spark, d):
    updates = B.table(spark, d, "events").selectExpr(
        "user_id AS uuid", "event_id AS seq", "ts AS at", "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'in_progress' END AS status"
    )
    base = B.seeds(spark, d).select("uuid", "status", F.lit(None).cast("timestamp").alias("end_time"))
    found = runs.partial_update(base, runs.with_end_time(updates), "uuid", "seq", ["status", "end_time"])
    return found.withColumn("end_time", F.date_format("end_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
