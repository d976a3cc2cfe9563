"""Text functions over generated code, test output and model replies, as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 white-space code points of the normalisation; Java's \s alone knows six.
_SPACE = r"(?U)[\s\x1c-\x1f]+"

# Tags of model replies, and messages that results depend on.
THINKING = ("think", "thinking", "reasoning", "reflection", "inner_thought")
RETRYABLE = ("502", "503", "504", "timeout", "connection", "network", "rate limit", "too many requests", "service unavailable")
C_TYPES = ("void", "int", "uint32_t", "uint16_t", "uint8_t", "char", "float", "double", "bool", "unsigned", "signed")
COMPILE_FAILURES = ("Compilation failed:", "Compilation timeout", "Command failed:")


def normalize_code(code: Column) -> Column:
    """Without block comments, then line comments, then all white space; string literals aren't protected."""
    bare = F.regexp_replace(F.coalesce(code, F.lit("")), r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?md)//.*?$", ""), _SPACE, "")


def code_hash(normal: Column) -> Column:
    return F.sha2(normal, 256)


# Five verdict rules coexist; each reads a test's output.
def verdict_eval(output: Column, language: Column) -> Column:
    """Any letter case; a fail marker wins; empty output fails. C: [CASE-n] PASS, Verilog: [TEST] PASS."""
    up = F.upper(F.coalesce(output, F.lit("")))
    c = F.when(up.rlike(r"\[CASE-\d+\]\s*FAIL"), False).otherwise(up.rlike(r"\[CASE-\d+\]\s*PASS"))
    v = F.when(up.contains("[TEST] FAIL"), False).otherwise(up.contains("[TEST] PASS"))
    return F.when(F.lower(language) == "c", c).otherwise(v)


def verdict_c(output: Column) -> Column:
    out = F.coalesce(output, F.lit(""))
    return F.when(out.rlike(r"(?i)\[CASE-\d+\]\s*FAIL"), False).otherwise(out.rlike(r"(?i)\[CASE-\d+\]\s*PASS"))


def verdict_verilog(output: Column, crashed: Column) -> Column:
    """Case-sensitive, as a diagnosis: crash, no_output, fail, pass or no_marker."""
    out = F.coalesce(output, F.lit(""))
    return F.when(crashed, "crash").when(F.trim(out) == "", "no_output").when(out.contains("[TEST] FAIL"), "fail").when(out.contains("[TEST] PASS"), "pass").otherwise("no_marker")


def verdict_substring(output: Column) -> Column:
    """Any FAIL fails, any PASS passes, neither fails."""
    up = F.upper(F.coalesce(output, F.lit("")))
    return F.when(up.contains("FAIL"), False).otherwise(up.contains("PASS"))


def verdict_exit(output: Column, code: Column) -> Column:
    """As verdict_substring, but without a marker the exit code decides."""
    up = F.upper(F.coalesce(output, F.lit("")))
    return F.when(up.contains("FAIL"), False).when(up.contains("PASS"), True).otherwise(code == 0)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def same_outcome(expected: Column, actual: Column) -> Column:
    """Whether two outputs agree in passing, white space aside."""
    return verdict_substring(collapsed(expected)).eqNullSafe(verdict_substring(collapsed(actual)))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")


def req_index_of_file(name: Column) -> Column:
    return _number(name, r"req_(\d+)_")


def req_index_of_test(test_id: Column) -> Column:
    """REQ-n is n, TEST-n is n - 1, else -1."""
    return F.coalesce(_number(test_id, r"REQ-(\d+)"), _number(test_id, r"TEST-(\d+)") - 1, F.lit(-1))


def req_id(text: Column) -> Column:
    """struct<suite, index> of an id at the start of the text; nulls for none."""
    pattern = r"(?i)^(FUNCTIONAL|SECURITY)-REQ-(\d+)"
    return F.struct(F.nullif(F.lower(F.regexp_extract(text, pattern, 1)), F.lit("")).alias("suite"), _number(text, pattern, 2).alias("index"))


def case_count(output: Column) -> Column:
    return F.regexp_count(F.coalesce(output, F.lit("")), F.lit(r"\[CASE-\d+\]"))


def tagged_outputs(output: Column) -> Column:
    """map of test id to its line, the last one of an id wins."""
    pattern = r"\[([A-Z]+-TEST-\d+)\]\s+OUTPUT\s+(.+)"
    hits = F.filter(F.split(F.coalesce(output, F.lit("")), "\n"), lambda x: x.rlike(pattern))
    pairs = F.transform(hits, lambda x, i: F.struct(F.regexp_extract(x, pattern, 1).alias("k"), i.alias("i"), F.regexp_extract(x, pattern, 2).alias("v")))
    # Ordered by id and place, the last of an id is the one before another id; an array of one binds the ordered pairs.
    last = F.transform(F.array(F.sort_array(pairs)), lambda s: F.filter(s, lambda x, j: ~x["k"].eqNullSafe(F.get(s, j + 1)["k"])))
    return F.map_from_entries(F.transform(F.get(last, F.lit(0)), lambda x: F.struct(x["k"], x["v"])))


def without_thinking(reply: Column) -> Column:
    """Without the five kinds of thinking tags, trimmed."""
    out = F.coalesce(reply, F.lit(""))
    for tag in THINKING:
        out = F.regexp_replace(out, rf"(?is)<{tag}>.*?</{tag}>", "")
    return F.btrim(out, F.lit(" \t\n\r\x0b\x0c"))


def code_block(reply: Column, language: str) -> Column:
    """The first fence of the language, else any fence, else a bare module or function, else the reply.

    An empty fence is a match, so existence is tested before the text is extracted.
    """
    text = without_thinking(reply)
    tags = ("verilog", "systemverilog", "v") if language == "verilog" else ("c", "cpp")
    fences = [(rf"(?is)```{t}\s*(.*?)\s*```", 1) for t in tags] + [(r"(?s)```\s*(.*?)\s*```", 1)]
    if language == "verilog":
        fences.append((r"(?is)(module\s+[\w_]+\s*\(.*?\)\s*;.*?endmodule)", 1))
    else:
        fences.append((rf"(?s)(\b(?:{'|'.join(C_TYPES)})\s+\w+\s*\(.*?\)\s*\{{.*?\}})", 1))
    out = text
    for pattern, group in reversed(fences):
        out = F.when(text.rlike(pattern), F.btrim(F.regexp_extract(text, pattern, group), F.lit(" \t\n\r\x0b\x0c"))).otherwise(out)
    return out


def clean_json(reply: Column) -> Column:
    """The JSON of a model's reply: no thinking, fences, comments or trailing commas."""
    out = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)```json\s*", ""), r"```\s*", "")
    pattern = r"(?s)(\{.*\}|\[.*\])"
    out = F.when(out.rlike(pattern), F.regexp_extract(out, pattern, 1)).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(out, r"//[^\n]*\n", "\n"), r"(?s)/\*.*?\*/", "")
    return F.btrim(F.regexp_replace(out, r",(\s*[}\]])", "$1"), F.lit(" \t\n\r\x0b\x0c"))


def parsed(reply: Column, schema: str) -> Column:
    """The cleaned reply as a struct; all null where it isn't JSON of the schema."""
    return F.from_json(clean_json(reply), schema)


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


# Where the JSON of a reply is looked for, words that tell a verdict, and what is said without guidance.
_FENCED_JSON = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
_DECISION_JSON = r'(?s)\{\s*"verdict"\s*:\s*"[^"]+"\s*,\s*"guidance"\s*:\s*"[^"]*(?:\\.[^"]*)*"\s*\}'
_FEEDBACK_JSON = r'(?s)\{[^{}]*"verdict"[^{}]*\}'
_GUIDANCE = r"(?i)(?:guidance|fix|solution)[:\s]*(.{20,200})"
_TB_WORDS, _PROBLEM_WORDS = "tb_issue|testbench has|tb has bug", "problem_issue|requirement unclear"
NO_GUIDANCE = "Review implementation based on test output."
_WHITE = " \t\n\r\x0b\x0c"


def _json_of(reply: Column, second: str) -> Column:
    """The fenced object, else what the second pattern finds, else the reply without a fence around it."""
    bare = F.regexp_replace(F.btrim(reply, F.lit(_WHITE)), r"^```\w*\s*", "")
    bare = F.btrim(F.regexp_replace(bare, r"```$", ""), F.lit(_WHITE))
    return F.when(reply.rlike(_FENCED_JSON), F.regexp_extract(reply, _FENCED_JSON, 1)).when(reply.rlike(second), F.regexp_extract(reply, second, 0)).otherwise(bare)


def arbiter(reply: Column) -> Column:
    """struct<verdict, guidance, by> of an arbiter's reply: by its JSON (json), else by words in it (words).

    An unknown verdict of the JSON is a code_issue, as is one that no word tells.
    """
    text = F.coalesce(reply, F.lit(""))
    read = F.from_json(_json_of(text, _DECISION_JSON), "verdict string, guidance string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good, low = read["_bad"].isNull() & read.isNotNull(), F.lower(text)
    known = F.lower(read["verdict"])
    verdict = F.when(known.isin("code_issue", "tb_issue", "problem_issue", "unclear"), known).otherwise("code_issue")
    said = F.when(low.rlike(_TB_WORDS), "tb_issue").when(low.rlike(_PROBLEM_WORDS), "problem_issue").otherwise("code_issue")
    hint = F.when(text.rlike(_GUIDANCE), F.btrim(F.regexp_extract(text, _GUIDANCE, 1), F.lit(_WHITE))).otherwise(NO_GUIDANCE)
    of_json = F.struct(verdict.alias("verdict"), F.coalesce(read["guidance"], F.lit("")).alias("guidance"), F.lit("json").alias("by"))
    return F.when(good, of_json).otherwise(F.struct(said.alias("verdict"), hint.alias("guidance"), F.lit("words").alias("by")))


def decision(reply: Column) -> Column:
    """The verdict of an arbiter's reply."""
    return arbiter(reply)["verdict"]


def checked_requirements(reply: Column, kind: str = "contradictions") -> Column:
    """struct<found, items, suggestions, failed> of a reply about contradictions or leakages; none found if it can't be read."""
    flag = "has_contradictions" if kind == "contradictions" else "has_leakage"
    text = F.coalesce(reply, F.lit(""))
    read = F.from_json(_json_of(text, rf'(?s)\{{.*"{flag}".*\}}'), f"{flag} boolean, {kind} array<map<string, string>>, suggestions array<string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = F.coalesce(read["_bad"].isNull() & read.isNotNull(), F.lit(False))
    none = lambda c, kind: F.when(good & c.isNotNull(), c).otherwise(F.array().cast(kind))
    return F.struct(
        (good & F.coalesce(read[flag], F.lit(False))).alias("found"),
        none(read[kind], "array<map<string, string>>").alias("items"),
        none(read["suggestions"], "array<string>").alias("suggestions"),
        (~good).alias("failed"),
    )


def red_team_feedback(reply: Column) -> Column:
    """struct<verdict, feedback_type, reasoning, confidence, evidence> of a reply; null if it can't be read.

    Without a verdict it is TB_ERROR. A reply that isn't JSON but says CODE_BUG disagrees, in the older form.
    """
    text = F.coalesce(reply, F.lit(""))
    fence = r"(?s)```json\s*\n(.*?)\n```"
    source = F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).when(text.rlike(_FEEDBACK_JSON), F.regexp_extract(text, _FEEDBACK_JSON, 0))
    kind = "verdict string, feedback_type string, reasoning string, confidence double, evidence string"
    read = F.from_json(source, kind + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    field = lambda name: read[name].alias(name)
    new = F.struct(F.coalesce(read["verdict"], F.lit("TB_ERROR")).alias("verdict"), *(field(n) for n in ("feedback_type", "reasoning", "confidence", "evidence")))
    note = F.when(source.isNull(), "RedTeam believes this is a code issue (legacy format)").otherwise("RedTeam believes this is a code issue")
    old = F.struct(F.lit("CODE_BUG").alias("verdict"), F.lit("disagree").alias("feedback_type"), note.alias("reasoning"), F.lit(0.7).alias("confidence"), F.lit(None).cast("string").alias("evidence"))
    return F.when(read.isNotNull() & read["_bad"].isNull(), new).when(text.contains("CODE_BUG"), old)


def generated_code(reply: Column) -> Column:
    """The first fence that begins and ends on lines of its own, else the whole reply; trimmed."""
    text, fence = F.coalesce(reply, F.lit("")), r"(?s)```(?:verilog|c|systemverilog)?\s*\n(.*?)\n```"
    return F.btrim(F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text), F.lit(_WHITE))


def responsible(verdict: Column) -> Column:
    return F.when(verdict == "problem_issue", "Architect").when(verdict == "tb_issue", "RedTeamer").otherwise("Expert")


def stripped_requirements(requirements: Column) -> Column:
    return F.transform(requirements, lambda x: F.trim(F.regexp_replace(x, r"^(FUNC-REQ-\d+|FUNCTIONAL-REQ-\d+|SEC-REQ-\d+|SECURITY-REQ-\d+):\s*", "")))


def first_filled(*arrays: Column) -> Column:
    """The first array that is neither null nor empty."""
    return F.coalesce(*(F.when(F.size(a) > 0, a) for a in arrays))


def warnings(stderr: Column) -> Column:
    return F.array_join(F.filter(F.split(F.coalesce(stderr, F.lit("")), "\n"), lambda x: F.lower(x).contains("warning")), "\n")


def retryable(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(RETRYABLE)), F.lit(False))


def compile_failed(message: Column) -> Column:
    return F.coalesce(message.rlike("|".join(COMPILE_FAILURES)), F.lit(False))


def has_module(code: Column, name: Column) -> Column:
    """Whether the Verilog code declares the module."""
    return F.array_contains(F.regexp_extract_all(code, F.lit(r"\bmodule\s+(\w+)\s*[#(;]"), F.lit(1)), name)


def has_function(code: Column, name: Column) -> Column:
    """Whether the C code has a type or word, the function's name and an opening bracket."""
    return F.regexp(code, F.concat(F.lit(r"\b\w+\s+\Q"), name, F.lit(r"\E\s*\(")))


def name_error(code: Column, name: Column, language: Column) -> Column:
    """What is wrong with the declared names, null if nothing is."""
    found = F.regexp_extract_all(code, F.lit(r"\bmodule\s+(\w+)\s*[#(;]"), F.lit(1))
    other = F.concat(F.lit("Module name mismatch: expected '"), name, F.lit("', but found '"), F.array_join(found, ", "), F.lit("'"))
    verilog = F.when(F.size(found) == 0, "No module declaration found in code").when(~F.array_contains(found, name), other)
    return F.when(language == "verilog", verilog).when(~has_function(code, name), F.concat(F.lit("Function '"), name, F.lit("' not found in code")))


def title(question: Column) -> Column:
    first = F.trim(F.get(F.split(question, "\n"), F.lit(0)))
    return F.coalesce(first, F.lit("Unknown"))


def model_dir(name: Column) -> Column:
    """A model name as a directory: base name, models--A--B is A-B, and / : \\ become -."""
    base = F.element_at(F.split(name, "/"), -1)
    hub = F.regexp_replace(F.regexp_replace(base, "^models--", ""), "--", "-")
    return F.translate(F.when(base.startswith("models--"), hub).otherwise(base), "/:\\", "---")


def gcov_line(line: Column) -> Column:
    """struct<line, covered> of a coverage line; null where it isn't executable or can't be read."""
    parts = F.split(line, ":", 3)
    count, number = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1))).try_cast("int")
    known = F.when(count == "#####", False).when(count.rlike(r"^[+-]?\d+$"), True)
    return F.when(number.isNotNull() & known.isNotNull(), F.struct(number.alias("line"), known.alias("covered")))


def executable(line: Column) -> Column:
    """Whether a Verilog line counts as executable."""
    bare = F.btrim(line, F.lit(" \t\n\r\x0b\x0c"))
    skipped = (bare == "") | bare.rlike(r"^(//|/\*|module|endmodule|input|output|reg|wire)")
    return ~skipped & bare.rlike("=|if|else|case")


def tested_signals(bench: Column) -> Column:
    """Signals assigned in a test bench, and the last letter of each condition (the pattern is greedy)."""
    assigned = F.regexp_extract_all(bench, F.lit(r"(\w+)\s*[<]?="), F.lit(1))
    return F.array_union(assigned, F.regexp_extract_all(bench, F.lit(r"if\s*\([^)]*(\w+)"), F.lit(1)))


def exit_message(exit_code: Column, stderr: Column) -> Column:
    """What to report of a process: the signal that killed it, its errors, or its exit code."""
    names = {4: "SIGILL", 6: "SIGABRT", 7: "SIGBUS", 8: "SIGFPE", 9: "SIGKILL", 11: "SIGSEGV", 15: "SIGTERM"}
    name = F.concat(F.lit("Signal "), (-exit_code).cast("string"))
    for number, known in names.items():
        name = F.when(exit_code == -number, known).otherwise(name)
    errors = F.coalesce(stderr, F.lit(""))
    killed = F.concat(F.lit("Process killed by "), name, F.lit(" (code "), exit_code.cast("string"), F.lit("). "), errors)
    exited = F.concat(F.lit("Process exited with code "), exit_code.cast("string"))
    return F.when(exit_code < 0, killed).when((exit_code > 0) & (errors == ""), exited).otherwise(errors)


def task_id(cwe: Column, nth: Column) -> Column:
    return F.concat(F.lit("TASK-"), cwe, F.lit("-SEED"), nth.cast("string"))


def head_lines(text: Column, n: int = 80) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def changes(old: Column, new: Column) -> Column:
    """Positions (1-based) at which two arrays of strings differ; missing items are null."""
    pairs = F.arrays_zip(old.alias("o"), new.alias("n"))
    spots = F.transform(pairs, lambda p, i: F.when(~p["o"].eqNullSafe(p["n"]), i + 1))
    return F.filter(spots, lambda x: x.isNotNull())


def prompt(name: Column, description: Column, question: Column, hint: Column) -> Column:
    """A task prompt: the question; from hint 1 the weakness's name, from hint 2 its description too."""
    return F.concat_ws("\n", question, F.when(hint >= 1, F.concat(F.lit("Weakness: "), name)), F.when(hint >= 2, F.concat(F.lit("Description: "), F.coalesce(description, F.lit("")))))


def explanation(reply: Column) -> Column:
    """The explanation of a test: its section up to the first fence, three sentences of it; else the prose before code."""
    text = F.coalesce(reply, F.lit(""))
    space = F.lit(" \t\n\r\x0b\x0c")
    section = F.btrim(F.regexp_extract(text, r"(?is)Test Explanation:(.*?)(?:```|\z)", 1), space)
    sentences = F.split(section, r"\.")
    short = F.when(F.size(sentences) > 3, F.concat(F.array_join(F.slice(sentences, 1, 3), ". "), F.lit("."))).otherwise(section)
    prose = F.transform(F.split(F.regexp_replace(text, r"(?s)(?m:^)[^\n]*(?:```|module ).*\z", ""), "\n"), lambda x: F.btrim(x, space))
    lines = F.slice(F.filter(prose, lambda x: (x != "") & ~x.startswith("#")), 1, 3)
    other = F.when(F.size(lines) > 0, F.array_join(lines, " ")).otherwise(F.lit("No explanation provided"))
    return F.when(text.rlike(r"(?i)Test Explanation:"), short).otherwise(other)


def reply_text(reply: Column) -> Column:
    """The text of a reply that is JSON: a list of strings or of blocks, or a message with content; other text as it is."""
    blocks = "array<struct<type: string, text: string, content: string>>"
    said = lambda b: F.coalesce(F.when(b["type"] == "text", b["text"]), b["content"])
    strings = F.when(reply.rlike(r'^\s*\["'), F.array_join(F.filter(F.from_json(reply, "array<string>"), lambda x: x != ""), "\n"))
    listed = F.when(reply.rlike(r"^\s*\[\s*\{"), F.array_join(F.filter(F.transform(F.from_json(reply, blocks), said), lambda x: x.isNotNull()), "\n"))
    message = F.when(reply.rlike(r"^\s*\{"), F.coalesce(F.get_json_object(reply, "$.content"), F.get_json_object(reply, "$.text")))
    return F.coalesce(strings, listed, message, reply, F.lit(""))


#: What makes a part of the hardware notes relevant.
KNOWLEDGE = {
    "verilog_timing": ("non-blocking", "blocking", "<=", "timing", "delay", "cycle"),
    "verilog_syntax": ("function", "syntax", "error", "declaration"),
    "common_contradictions": ("contradict", "conflict", "impossible", "mutually"),
}


def knowledge(language: Column, requirement: Column, code: Column, bench: Column, message: Column) -> Column:
    """Names of the notes that fit a failure, in order; none for other languages than Verilog."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    whole = F.concat_ws(" ", low(requirement), low(code), low(bench), low(message))
    found = [F.when(whole.rlike("|".join(words)), F.lit(name)) for name, words in KNOWLEDGE.items()]
    found.append(F.when(low(bench).contains("testbench") | low(message).contains("tb"), F.lit("testbench_patterns")))
    return F.when(F.lower(language) == "verilog", F.array_compact(F.array(*found))).otherwise(F.array().cast("array<string>"))


def flipped_hex(digits: Column) -> Column:
    """Hex digits (of 64 bits at most) exclusive-or FF, in lower case."""
    return F.lower(F.conv(F.conv(digits, 16, 10).cast("decimal(20,0)").cast("long").bitwiseXOR(F.lit(255)).cast("string"), 10, 16))


def intent(bench: Column) -> Column:
    """What a test section sets and how it is timed: struct<signals, timing, expected>."""
    sets = F.transform(F.slice(F.regexp_extract_all(bench, F.lit(r"(\w+\s*=\s*[01xb\d]+)"), F.lit(1)), 1, 5), lambda x: F.regexp_replace(x, r"\s+", ""))
    clocks = F.regexp_count(bench, F.lit(r"@\(posedge clk\)"))
    timing = F.when(clocks > 0, F.concat(clocks.cast("string"), F.lit(" clock cycles"))).when(bench.contains("#"), F.lit("time delays present")).otherwise(F.lit(""))
    expected = F.trim(F.regexp_extract(bench, r"[Ee]xpect.*?(?:should|must|will).*?([^\n.]+)", 1))
    return F.struct(sets.alias("signals"), timing.alias("timing"), expected.alias("expected"))


def relevant_code(code: Column, most: int = 20) -> Column:
    """Lines of always blocks, assignments, conditions and returns, a line once for each reason it counts; at most ``most``.

    The depth of a block goes up by a line with begin and down by one with end; it closes at zero or below.
    """
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("inside"), F.lit(0).alias("depth"))

    def step(state, line):
        opens = line.rlike(r"always @|always_ff @|always_comb")
        inside, before = state["inside"] | opens, F.when(opens, 0).otherwise(state["depth"])
        up = before + F.when(inside & line.contains("begin"), 1).otherwise(0)
        ends = inside & line.contains("end")
        depth = up - F.when(ends, 1).otherwise(0)
        reasons = F.array(F.when(inside, line), F.when(F.ltrim(line).startswith("assign"), line), F.when(line.rlike("if|else|return"), line))
        # One more than are shown tells that some are left out.
        kept = F.when(F.size(state["kept"]) > most, state["kept"]).otherwise(F.concat(state["kept"], F.array_compact(reasons)))
        return F.struct(kept.alias("kept"), (inside & ~(ends & (depth <= 0))).alias("inside"), depth.alias("depth"))

    kept = F.aggregate(F.split(code, "\n"), start, step, lambda s: s["kept"])
    cut = F.concat(F.array_join(F.slice(kept, 1, most), "\n"), F.lit("\n... (truncated)"))
    return F.when(F.size(kept) > most, cut).when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(F.concat(F.substring(code, 1, 500), F.lit("...")))


def change_list(old: Column, new: Column, fields: Sequence[str], lists: Sequence[str]) -> Column:
    """What differs between two versions of a problem, one text for each difference: ``field: old -> new``, and for lists
    ``field[i]`` (from 0) with the items at each position, ``(none)`` where one is missing."""
    shown = lambda c: F.coalesce(c, F.lit("(none)"))
    arrow = lambda name, a, b: F.concat(name, F.lit(": "), shown(a), F.lit(" -> "), shown(b))
    single = [F.when(~old[f].eqNullSafe(new[f]), arrow(F.lit(f), old[f], new[f])) for f in fields]
    out = F.array_compact(F.array(*single)) if single else F.array().cast("array<string>")
    for f in lists:
        pairs = F.arrays_zip(F.coalesce(old[f], F.array()).alias("o"), F.coalesce(new[f], F.array()).alias("n"))
        place = lambda i: F.concat(F.lit(f"{f}["), i.cast("string"), F.lit("]"))  # noqa: B023, E731
        each = F.transform(pairs, lambda p, i: F.when(~p["o"].eqNullSafe(p["n"]), arrow(place(i), p["o"], p["n"])))  # noqa: B023
        out = F.concat(out, F.array_compact(each))
    return out


def inferred_language(kind: Column, content: Column) -> Column:
    """The language that the first message of a chat tells: only a system message does; null where it names none."""
    system = F.coalesce(kind == "SystemMessage", F.lit(False))
    text = F.coalesce(content, F.lit(""))
    verilog = text.contains("Verilog") | text.contains("verilog")
    return F.when(system & verilog, "verilog").when(system & (text.contains("C programming") | text.contains("```c")), "c")
