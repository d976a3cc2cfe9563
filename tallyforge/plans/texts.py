"""Named queries of text functions over whole texts of documents and conversations; the SQL applies the same rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import loop
from tallyforge.plans import bindings as B
from tallyforge.plans.registry import query

_WHITE_SQL = r"E' \t\n\r\x0b\x0c'"
_TEXT = "coalesce(text, '')"


def _docs(spark, d, *columns):
    return B.table(spark, d, "documents").selectExpr("doc_id", *columns)


_MODULE = f"{_TEXT} || chr(10) || 'module m' || (doc_id % 5) || ' (input a); endmodule'"


@query("module_check", "", rf"SELECT doc_id, list_contains(regexp_extract_all({_MODULE}, '\bmodule\s+(\w+)\s*[#(;]', 1), 'm' || (doc_id % 4)) AS declared FROM documents")
def _(spark, d):
    rows = _docs(spark, d, f"{_MODULE} AS code", "'m' || (doc_id % 4) AS name")
    return rows.select("doc_id", T.has_module(F.col("code"), F.col("name")).alias("declared"))


_PREFIX = "CASE doc_id % 5 WHEN 0 THEN 'FUNC-REQ-' WHEN 1 THEN 'SECURITY-REQ-' WHEN 2 THEN 'SEC-REQ-' WHEN 3 THEN 'FUNCTIONAL-REQ-' ELSE 'OTHER-REQ-' END || doc_id || ':  '"


@query(
    "requirement_prefixes",
    "lines",
    rf"""SELECT doc_id, string_agg(trim(regexp_replace({_PREFIX} || line, '^(FUNC-REQ-\d+|FUNCTIONAL-REQ-\d+|SEC-REQ-\d+|SECURITY-REQ-\d+):\s*', '')), chr(10) ORDER BY n) AS requirements FROM lines GROUP BY doc_id""",
)
def _(spark, d):
    rows = _docs(spark, d, f"transform(split({_TEXT}, '\\n'), x -> concat({_PREFIX}, x)) AS r")
    return rows.select("doc_id", F.array_join(T.stripped_requirements(F.col("r")), "\n").alias("requirements"))


_STDERR = f"replace({_TEXT}, ' of ', ' WarninG ') || chr(10) || if(doc_id % 3 = 0, 'a.c:1: warning: x', 'error: y')"


@query("warning_lines", "", f"SELECT doc_id, coalesce(array_to_string(list_filter(string_split({_STDERR}, chr(10)), lambda x: contains(lower(x), 'warning')), chr(10)), '') AS warnings FROM documents")
def _(spark, d):
    return _docs(spark, d, f"{_STDERR} AS stderr").select("doc_id", T.warnings(F.col("stderr")).alias("warnings"))


# Texts without signs that JSON has to escape, in replies with thinking, fences, comments and commas too many.
_SAFE = "(SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]', ' '{}) AS t FROM {})"
_LLM_JSON = """CASE (conv_id + turn) % 4 WHEN 0 THEN '<think>{' || t || '}</think>Sure ```json {"k": ' || conv_id || ', /* ' || t || ' */ "v": "' || t || '",} ``` bye' WHEN 1 THEN t || ' ["' || t || '", // ' || t || chr(10) || '] ' || t WHEN 2 THEN '```' || t || '``` ' ELSE '  ' || t || ' ' END"""


@query(
    "llm_json_clean",
    "",
    rf"""WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace({_LLM_JSON}, '(?is)<think>.*?</think>', '', 'g'), '(?i)```json\s*', '', 'g'), '```\s*', '', 'g') AS s FROM {_SAFE.format(", 'g'", "conversations")}),
b AS (SELECT conv_id, turn, if(regexp_matches(s, '(?s)(\{{.*\}}|\[.*\])'), regexp_extract(s, '(?s)(\{{.*\}}|\[.*\])', 1), s) AS s FROM a)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(s, '//[^\n]*\n', chr(10), 'g'), '(?s)/\*.*?\*/', '', 'g'), ',(\s*[}}\]])', '\1', 'g'), {_WHITE_SQL}) AS json FROM b""",
)
def _(spark, d):
    talks = B.table(spark, d, "conversations").selectExpr("conv_id", "turn", "regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]', ' ') AS t")
    return talks.select("conv_id", "turn", T.clean_json(F.expr(_LLM_JSON)).alias("json"))


_SAID = "coalesce(text, '') || CASE (conv_id + turn) % 4 WHEN 0 THEN ' the testbench has a flaw' WHEN 1 THEN ' Requirement unclear' WHEN 2 THEN ' TB has bug?' ELSE '' END"


@query(
    "arbiter_decision",
    "",
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower({_SAID}), 'tb_issue|testbench has|tb has bug') THEN 'tb_issue' WHEN regexp_matches(lower({_SAID}), 'problem_issue|requirement unclear') THEN 'problem_issue' ELSE 'code_issue' END AS verdict FROM conversations""",
)
def _(spark, d):
    return B.table(spark, d, "conversations").select("conv_id", "turn", T.decision(F.expr(_SAID)).alias("verdict"))


# Lines of documents behind the counters of a coverage report.
_GCOV = "CASE n % 6 WHEN 0 THEN '    -' WHEN 1 THEN '#####' WHEN 2 THEN '   ' || n WHEN 3 THEN n || '*' WHEN 4 THEN '=====' ELSE '' END || ':  ' || n || ':' || line"
_GCOV_PART = "trim(string_split(g, ':')[{}])"


@query(
    "gcov_lines",
    "lines",
    rf"""SELECT doc_id, n, TRY_CAST(number AS INT) AS line, count <> '#####' AS covered FROM (SELECT doc_id, n, {_GCOV_PART.format(1)} AS count, {_GCOV_PART.format(2)} AS number FROM (SELECT doc_id, n, {_GCOV} AS g FROM lines))
  WHERE regexp_matches(number, '^[+-]?\d+$') AND (count = '#####' OR regexp_matches(count, '^[+-]?\d+$'))""",
)
def _(spark, d):
    rows = B.lines(spark, d).select("doc_id", "n", T.gcov_line(F.expr(_GCOV)).alias("g")).where("g IS NOT NULL")
    return rows.select("doc_id", "n", "g.line", "g.covered")


@query(
    "alias_fallback",
    "",
    f"""SELECT doc_id, array_to_string(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END, chr(10)) AS chosen FROM (SELECT doc_id, list_filter(c, lambda x: contains(x, ' the ')) AS a, list_filter(c, lambda x: contains(x, 'q')) AS b, c
  FROM (SELECT doc_id, string_split({_TEXT}, chr(10)) AS c FROM documents))""",
)
def _(spark, d):
    rows = _docs(spark, d, f"split({_TEXT}, '\\n') AS c")
    having = lambda part: F.filter("c", lambda x: x.contains(part))
    return rows.select("doc_id", F.array_join(T.first_filled(having(" the "), having("q"), F.col("c")), "\n").alias("chosen"))


_TAG = "'[' || if({0} % 2 = 0, 'FUNC', 'SEC') || '-TEST-' || ({0} % 3) || '] OUTPUT ' || {1}"
_TAGGED = r"\[([A-Z]+-TEST-\d+)\]\s+OUTPUT\s+(.+)"


@query("tagged_outputs", "lines", f"SELECT doc_id, regexp_extract(o, '{_TAGGED}', 1) AS test, arg_max(regexp_extract(o, '{_TAGGED}', 2), n) AS output FROM (SELECT doc_id, n, {_TAG.format('(n - 1)', 'line')} AS o FROM lines) WHERE regexp_matches(o, '{_TAGGED}') GROUP BY 1, 2")
def _(spark, d):
    rows = _docs(spark, d, f"array_join(transform(split({_TEXT}, '\\n'), (x, i) -> {_TAG.format('i', 'x')}), '\\n') AS o")
    return rows.select("doc_id", F.explode(T.tagged_outputs(F.col("o"))).alias("test", "output"))


_EXPECTED = "'  ' || if(event_id % 3 = 0, 'Pass', event_type) || chr(10) || ' ' || if(event_id % 5 = 0, 'fail', coalesce(props, ''))"
_ACTUAL = "CASE event_id % 4 WHEN 0 THEN '[TEST] PASS' WHEN 1 THEN '[test] fail' WHEN 2 THEN '' ELSE event_type || ' passed' END"
_PASSES = "(NOT contains(upper({0}), 'FAIL') AND contains(upper({0}), 'PASS'))"


@query("verdict_deterministic", "", f"SELECT event_id, {_PASSES.format('e')} = {_PASSES.format('a')} AS same FROM (SELECT event_id, {_EXPECTED} AS e, {_ACTUAL} AS a FROM events)")
def _(spark, d):
    return B.table(spark, d, "events").select("event_id", T.same_outcome(F.expr(_EXPECTED), F.expr(_ACTUAL)).alias("same"))


_HELD = f"{_TEXT} || CASE doc_id % 7 WHEN 0 THEN ' Non-Blocking' WHEN 1 THEN ' syntax' WHEN 2 THEN ' impossible' ELSE '' END"
_BENCH = "if(doc_id % 3 = 0, 'a TestBench', '')"
_TOLD = "if(doc_id % 5 = 0, 'TB: delay', 'failed')"
_ALL_LOW = f"lower(concat_ws(' ', 'r', {_HELD}, {_BENCH}, {_TOLD}))"


@query(
    "knowledge_sections",
    "",
    f"""SELECT doc_id, if(doc_id % 2 = 0, '', concat_ws(',', if(regexp_matches(w, 'non-blocking|blocking|<=|timing|delay|cycle'), 'verilog_timing', null), if(regexp_matches(w, 'function|syntax|error|declaration'), 'verilog_syntax', null),
  if(regexp_matches(w, 'contradict|conflict|impossible|mutually'), 'common_contradictions', null), if(contains(b, 'testbench') OR contains(m, 'tb'), 'testbench_patterns', null))) AS sections
  FROM (SELECT doc_id, {_ALL_LOW} AS w, lower({_BENCH}) AS b, lower({_TOLD}) AS m FROM documents)""",
)
def _(spark, d):
    rows = _docs(spark, d, f"{_HELD} AS code", f"{_BENCH} AS bench", f"{_TOLD} AS message", "if(doc_id % 2 = 0, 'c', 'Verilog') AS language")
    return rows.select("doc_id", F.array_join(T.knowledge(F.col("language"), F.lit("r"), F.col("code"), F.col("bench"), F.col("message")), ",").alias("sections"))


_SEEDS_REPLY = """CASE doc_id % 3 WHEN 0 THEN 'so ```json {"seeds": [{"question": "' || t || '", "language": "C"}, {"question": "x", "language": "rust"}, {"language": "c"}, {"question": "' || t || ' 2", "language": "verilog"}], "reasoning": "' || t || '"} ```'
  WHEN 1 THEN t || ' {"seeds": []} ' || t ELSE 'sorry ' || t END"""


@query(
    "seeds_from_replies",
    "",
    rf"""WITH r AS (SELECT doc_id AS cwe_id, regexp_extract({_SEEDS_REPLY}, '(?s)(\{{.*\}}|\[.*\])', 1) AS s FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]', ' ', 'g') AS t FROM documents)),
j AS (SELECT cwe_id, if(json_valid(s), s, '{{}}') AS s FROM r)
SELECT * FROM (SELECT cwe_id, i::INT AS nth, s ->> ('$.seeds[' || i || '].question') AS question, lower(s ->> ('$.seeds[' || i || '].language')) AS language FROM j, unnest(range(coalesce(json_array_length(s, '$.seeds'), 0)::BIGINT)) u(i))
  WHERE question IS NOT NULL AND language IN ('c', 'verilog')""",
)
def _(spark, d):
    rows = _docs(spark, d, "regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]', ' ') AS t")
    return loop.seeds_of(rows.select(F.col("doc_id").alias("cwe_id"), F.expr(_SEEDS_REPLY).alias("reply")))


_MESSAGE = """CASE (conv_id + turn) % 5 WHEN 0 THEN '["a", "' || t || '", ""]' WHEN 1 THEN ' [{"type": "text", "text": "' || t || '"}, {"content": "z"}, {"type": "image"}]' WHEN 2 THEN '{"content": "' || t || '"}' WHEN 3 THEN '{"text": "' || t || '"}' ELSE t END"""


@query(
    "reply_texts",
    "",
    rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(m, '^\s*\["') THEN array_to_string(list_filter(from_json(j, '["VARCHAR"]'), lambda x: x <> ''), chr(10))
  WHEN regexp_matches(m, '^\s*\[\s*\{{') THEN array_to_string(list_filter(list_transform(from_json(j, '["JSON"]'), lambda x: coalesce(if(x ->> 'type' = 'text', x ->> 'text', null), x ->> 'content')), lambda x: x IS NOT NULL), chr(10))
  WHEN regexp_matches(m, '^\s*\{{') THEN coalesce(j ->> '$.content', j ->> '$.text') ELSE m END AS text FROM (SELECT *, if(json_valid(m), m, '[]') AS j FROM (SELECT conv_id, turn, {_MESSAGE} AS m FROM {_SAFE.format(", 'g'", "conversations")}))""",
)
def _(spark, d):
    talks = B.table(spark, d, "conversations").selectExpr("conv_id", "turn", "regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]', ' ') AS t")
    return talks.select("conv_id", "turn", T.reply_text(F.expr(_MESSAGE)).alias("text"))


_EXPLAINED = "CASE (conv_id + turn) % 3 WHEN 0 THEN 'x Test explanation: ' || coalesce(text, '') || '. b. c. d. ``` code' WHEN 1 THEN '# title' || chr(10) || ' first ' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || '```c' || chr(10) || 'third' ELSE coalesce(text, '') END"


@query(
    "explanations",
    "",
    rf"""WITH r AS (SELECT conv_id, turn, {_EXPLAINED} AS r FROM conversations), s AS (SELECT *, trim(regexp_extract(r, '(?is)Test Explanation:(.*?)(?:```|\z)', 1), {_WHITE_SQL}) AS s,
  list_filter(list_transform(string_split(regexp_replace(r, '(?s)(?m:^)[^\n]*(?:```|module ).*\z', ''), chr(10)), lambda x: trim(x, {_WHITE_SQL})), lambda x: x <> '' AND NOT starts_with(x, '#')) AS p FROM r)
SELECT conv_id, turn, CASE WHEN regexp_matches(r, '(?i)Test Explanation:') THEN if(len(string_split(s, '.')) > 3, array_to_string(string_split(s, '.')[1:3], '. ') || '.', s) WHEN len(p) > 0 THEN array_to_string(p[1:3], ' ') ELSE 'No explanation provided' END AS explanation FROM s""",
)
def _(spark, d):
    return B.table(spark, d, "conversations").select("conv_id", "turn", T.explanation(F.expr(_EXPLAINED)).alias("explanation"))


_SECTION = f"{_TEXT} || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'a = 1; b=0x1; @(posedge clk) c  =  b01; @(posedge clk) Expected y should hold ' || doc_id || '. end' WHEN 1 THEN '#5 q = 2; expect: it must be low' ELSE 'none' END"


@query(
    "test_intents",
    "",
    rf"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(s, '(\w+\s*=\s*[01xb\d]+)', 1)[1:5], lambda x: regexp_replace(x, '\s+', '', 'g')), ',') AS signals,
  CASE WHEN len(regexp_extract_all(s, '@\(posedge clk\)')) > 0 THEN len(regexp_extract_all(s, '@\(posedge clk\)')) || ' clock cycles' WHEN contains(s, '#') THEN 'time delays present' ELSE '' END AS timing,
  trim(regexp_extract(s, '[Ee]xpect.*?(?:should|must|will).*?([^\n.]+)', 1)) AS expected FROM (SELECT doc_id, {_SECTION} AS s FROM documents)""",
)
def _(spark, d):
    rows = _docs(spark, d, f"{_SECTION} AS s").select("doc_id", T.intent(F.col("s")).alias("x"))
    return rows.select("doc_id", F.array_join("x.signals", ",").alias("signals"), "x.timing", "x.expected")
