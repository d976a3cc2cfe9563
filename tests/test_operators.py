import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import mutants as M
from tallyforge.functions import text as T
from tallyforge.operators import dedup, history, quality, runs, seeds
from tallyforge.sources import connectors
from tallyforge.streaming.incremental import LatestRuns, follow


def values(spark, expr, rows, schema="x string"):
    df = spark.createDataFrame(rows, schema).coalesce(1).withColumn("__i", F.monotonically_increasing_id())
    return [r[0] for r in df.orderBy("__i").select(expr).collect()]


def normal(code):
    code = re.sub(r"/\*.*?\*/", "", code, flags=re.DOTALL)
    return re.sub(r"\s+", "", re.sub(r"//.*?$", "", code, flags=re.MULTILINE))


def test_normalisation_matches_python(spark):
    rng = random.Random(1)
    parts = ["/*", "*/", "//", "\n", "\r", " ", "x", '"http://a"', " ", "\x85", "\xa0", "\x0b", "\x1c", "\x1f", "é"]
    codes = ["", "/* /* */ */", "/* open", *("".join(rng.choices(parts, k=12)) for _ in range(300))]
    assert values(spark, T.normalize_code(F.col("x")), [(c,) for c in codes]) == [normal(c) for c in codes]


RUNS = "uuid string, run_index int, f_rate double, s_rate double, n_req long, total_iterations int, end_time string, success boolean, seq long"


def test_pass_at_k(spark):
    rows = [
        ("a", 0, 0.5, 1.0, 2, 1, "t", False, 1), ("a", 1, 1.0, 0.5, 2, 3, "t", True, 2), ("a", 0, 0.25, 0.0, 2, 2, "t", False, 3),  # delivered again
        ("b", 1, 1.0, 1.0, 1, 1, "t", True, 4), ("c", None, 1.0, 1.0, 4, 2, "t", True, 5), ("d", 0, 1.0, 1.0, 4, 0, "t", True, 6), ("e", 0, 1.0, 1.0, 4, 1, None, True, 7), ("f", 0, 0.0, 0.0, 0, 1, "t", False, 8),
    ]
    latest = runs.upsert_latest(spark.createDataFrame(rows, RUNS))
    assert latest.count() == 7
    kept = {r.uuid: r for r in runs.passk_per_seed(runs.valid_runs(latest), 2).collect()}
    assert set(kept) == {"a", "c", "f"}
    assert (kept["a"].actual_k, kept["a"].first_f, kept["a"].best_s, kept["a"].functional_pass, kept["a"].security_pass) == (2, 0.25, 0.5, True, False)
    s = runs.passk_summary(runs.passk_per_seed(runs.valid_runs(latest), 2), 2).first()
    assert (s.total_seeds, s.seeds_with_full_k, s.seeds_degraded) == (3, 1, 2)
    assert s.passk_security == (0.5 * 2 + 1.0 * 4) / 6 and s.pass1_functional == 1 / 3
    none = runs.passk_summary(runs.passk_per_seed(latest.limit(0), 2), 2).first()
    assert none.total_seeds == 0 and none.passk_security == 0.0 and none.avg_actual_k == 0.0


def test_partial_update_keeps_what_is_null(spark):
    base = spark.createDataFrame([(1, "a", True), (2, "b", None)], "k int, s string, p boolean")
    updates = spark.createDataFrame([(1, 1, "x", None), (1, 2, None, False), (1, 3, None, None), (9, 1, "z", True)], "k int, seq int, s string, p boolean")
    assert sorted(runs.partial_update(base, updates, "k", "seq", ["s", "p"]).collect()) == [(1, "x", False), (2, "b", None)]


def test_eligibility_treats_null_validation_as_unchecked(spark):
    rows = [(1, "completed", True, None), (2, "completed", True, True), (3, "completed", True, False), (4, "failed", True, None), (5, "completed", None, None), (6, "completed", True, None)]
    df = spark.createDataFrame(rows, "uuid int, status string, passed boolean, tb_validated boolean")
    assert sorted(r.uuid for r in seeds.eligible(df, spark.range(1, 6).selectExpr("cast(id as int) uuid")).collect()) == [1, 2]


def test_dedup_fans_results_out(spark):
    code = spark.createDataFrame([("a", 0, "int x;"), ("a", 1, "int /* c */ x ;"), ("a", 2, "int y;"), ("b", 0, "int x;"), ("b", 1, "// only")], "uuid string, run_index int, code string")
    h = dedup.hashed(code)
    assert h.count() == 4 and dedup.groups(h).count() == 3 and dedup.groups(h, "global").count() == 2
    s = dedup.stats(dedup.groups(h)).first()
    assert s.unique_codes + s.duplicates == s.total == 4
    results = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 0.5)], "uuid string, run_index int, f_rate double")
    assert [tuple(r) for r in dedup.copied_results(dedup.representatives(h), results).select("uuid", "run_index", "f_rate", "copied_from").collect()] == [("a", 1, 1.0, "a/0")]


def test_upper_median_and_gate(spark):
    df = spark.createDataFrame([(0.4,), (0.1,), (0.3,), (0.2,), (None,)], "v double")
    assert quality.upper_median(df, "v").first().median == 0.3 and quality.upper_median(df.limit(0), "v").first().median == 0.0
    rows = [(0.4, 0.7), (0.4, None), (0.6, 0.7), (0.6, 0.8), (None, 0.1)]
    got = values(spark, quality.gate(F.col("r"), F.col("c")), rows, "r double, c double")
    assert got == ["low_mutation_and_coverage", "low_mutation_rate", "low_coverage", None, "directory_not_found"]


def test_empty_suites_pass_with_rate_zero(spark):
    tasks = spark.createDataFrame([("a",), ("b",)], "uuid string")
    results = spark.createDataFrame([("a", True), ("a", False)], "uuid string, passed boolean")
    assert sorted(map(tuple, quality.suite_rates(tasks, results).collect())) == [("a", 2, 0.5, False), ("b", 0, 0.0, True)]


def test_chat_compression(spark):
    rows = [(1, t, r) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])] + [(2, 0, "user"), (2, 1, "assistant"), (3, 0, "a"), (3, 1, "a"), (3, 2, "a"), (3, 3, "a")]
    got = history.compress_chat(spark.createDataFrame(rows, "conv_id int, turn int, role string"))
    assert sorted((r.conv_id, r.turn) for r in got.collect()) == [(1, 0), (1, 1), (1, 4), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (3, 3)]


@pytest.mark.parametrize(
    "output, language, want",
    [("[test] pass", "verilog", (True, False, "no_marker", True)), ("[TEST] PASS", "verilog", (True, False, "pass", True)), ("[case-2]fail [CASE-1] PASS", "c", (False, False, "no_marker", False)), ("[CASE-1] PASS", "c", (True, True, "no_marker", True)), ("", "c", (False, False, "no_output", False))],
)
def test_verdicts(spark, output, language, want):
    x, lang = F.col("x"), F.col("l")
    df = spark.createDataFrame([(output, language)], "x string, l string")
    assert tuple(df.select(T.verdict_eval(x, lang), T.verdict_c(x), T.verdict_verilog(x, F.lit(False)), T.verdict_substring(x)).first()) == want


def test_replies(spark):
    fence = "```"
    rows = [f"<think>{fence}c no{fence}</think>{fence}c\nint a;\n{fence}", f"{fence}\nplain\n{fence}", f"{fence}c\n{fence} rest {fence}c x{fence}", "say int f(int a) { return a; } ok", " raw "]
    assert values(spark, T.code_block(F.col("x"), "c"), [(r,) for r in rows]) == ["int a;", "plain", "", "int f(int a) { return a; }", "raw"]
    assert values(spark, T.code_block(F.col("x"), "verilog"), [("x module m(a); endmodule y",)]) == ["module m(a); endmodule"]
    rows = ['<think>{"a":1}</think>ok ```json {"verdict": "tb_issue", // why\n "guidance": "g",} ```', "no json: testbench has a bug", "Requirement unclear", "nothing", None]
    assert values(spark, T.decision(F.col("x")), [(r,) for r in rows]) == ["tb_issue", "tb_issue", "problem_issue", "code_issue", "code_issue"]


def test_small_parsers(spark):
    assert values(spark, T.req_index_of_file(F.col("x")), [("tb_functional_req_12_m.c",), ("tb.c",)]) == [12, None]
    assert values(spark, T.req_index_of_test(F.col("x")), [("FUNCTIONAL-REQ-3",), ("SEC-TEST-1",), ("x",)]) == [3, 0, -1]
    assert [tuple(r) for r in values(spark, T.req_id(F.col("x")), [("security-req-2 x",), ("a FUNCTIONAL-REQ-1",)])] == [("security", 2), (None, None)]
    got = values(spark, T.gcov_line(F.col("x")), [("   5:  3:a:b",), ("#####:2:",), ("-:1:",), ("12*:4:",), ("bad",)])
    assert [r and tuple(r) for r in got] == [(3, True), (2, False), None, None, None]
    assert values(spark, T.model_dir(F.col("x")), [("/c/models--A--B",), ("org/m:1",), ("plain",)]) == ["A-B", "m-1", "plain"]
    assert values(spark, T.tested_signals(F.col("x")), [("a = 1; b <= 2; if (cd == ef)",)]) == [["a", "b", "cd", "f"]]
    assert values(spark, T.executable(F.col("x")), [("  x <= y;",), ("module m = 1",), ("// a = b",), ("",), ("else",)]) == [True, False, False, False, True]
    assert values(spark, T.exit_message(F.col("c"), F.col("e")), [(-11, "x"), (3, ""), (0, "warn")], "c int, e string") == ["Process killed by SIGSEGV (code -11). x", "Process exited with code 3", "warn"]


C = "int f(int x) {\n  if (x) return 7 + 0x0f;\n  // 9\n  return a == 3 && b < 4;\n}"
V = "module m;\n  if (!a) r <= 8'hA5;\n  else r <= 8'b0101;\n  if(!b) c = 1;\n  q = a && b;\nendmodule"


def test_mutation_rules():
    kinds = [(i, k) for i, _, k, _ in M.candidates(C, "c")]
    assert kinds == [(1, M.CONSTANT), (1, M.CONSTANT), (1, M.OPERATOR), (1, M.CONDITION), (3, M.CONSTANT), (3, M.OPERATOR), (3, M.OPERATOR), (3, M.OPERATOR)]
    lines = [new for _, new, _, _ in M.candidates(V, "verilog")]
    assert lines == [
        "  if (!a) r <= 8'h5A;", "  if (a) r <= 8'hA5;", "  if (!a) r <= 0;", "  if (!a) r <= ~0;", "  else r <= 8'b1101;", "  else r <= ~0;", "//  else r <= 8'b0101;", "  if(!b) c = 1;", "  q = a || b;",
    ]
    assert len(M.mutants(C, "c", 5)) == 3 and M.mutants("", "c", 5) == [] and M.mutants(C, "rust", 5) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(C.split("\n") + V.split("\n")), max_size=12), st.integers(1, 8), st.sampled_from(["c", "verilog"]))
def test_mutants_change_one_line(lines, n, language):
    code = "\n".join(lines)
    found = M.mutants(code, language, n)
    kinds = {k for _, k, _ in found}
    assert len(found) <= n and all(sum(k == x for _, x, _ in found) <= max(1, n // len(kinds)) for k in kinds)
    for new, _, what in found:
        i = int(re.match(r"Line (\d+):", what)[1]) - 1
        assert [j for j, (a, b) in enumerate(zip(lines, new.split("\n"), strict=True)) if a != b] in ([i], [])


def test_static_coverage(spark):
    golden = spark.createDataFrame([(1, V), (2, "x = 1;")], "seed int, code string")
    benches = spark.createDataFrame([(1, "a = 1;"), (1, "zz <= 2;")], "seed int, code string")
    assert sorted(map(tuple, M.static_coverage(golden, benches).collect())) == [(1, 4, 2), (2, 1, 0)]


def test_stream_upserts_late_and_repeated_deliveries(spark, tmp_path):
    log = [("a", 0, 0.5, 0.5, 1, 1, "t", False, 1), ("a", 1, 1.0, 1.0, 1, 1, "t", True, 2), ("a", 0, 0.75, 0.5, 1, 1, "t", False, 3), ("b", 1, 1.0, 1.0, 1, 1, "t", True, 4)]
    for row in [*log, log[1]]:
        spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    done = []
    state = LatestRuns(spark, f"{tmp_path}/state")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    follow(stream, state, 2, lambda df, i: done.extend(r.uuid for r in df.collect())).awaitTermination()
    want = runs.upsert_latest(spark.createDataFrame(log, RUNS))
    assert sorted(map(str, state.current().collect())) == sorted(map(str, want.select(*state.current().columns).collect()))
    assert done == ["a"]


def test_stream_goes_on_after_a_kill_between_batches(spark, tmp_path):
    """Every batch is handled by a new process; one is handled twice, one dies before its announcement is made."""
    log = [("a", 0, 0.5, 0.5, 1, 1, "t", False, 1), ("b", 0, 0.5, 0.5, 1, 1, "t", False, 2), ("a", 1, 1.0, 1.0, 1, 1, "t", True, 3), ("a", 0, 0.75, 0.5, 1, 1, "t", False, 4), ("b", 1, 1.0, 1.0, 1, 1, "t", True, 5)]
    done = []
    for compact in (2, 16):
        announced = []
        for n, row in enumerate(log):
            batch = spark.createDataFrame([row], RUNS)
            LatestRuns(spark, f"{tmp_path}/state-{compact}", compact=compact).update(batch, n)  # dies here
            state = LatestRuns(spark, f"{tmp_path}/state-{compact}", compact=compact)
            for _ in range(1 + (n == 2)):
                state.update(batch, n)
                new = runs.passk_per_seed(state.completed(batch, n, 2), 2)
                found = [(n, r.uuid, r.actual_k) for r in new.collect()]
            announced += found
        want = runs.upsert_latest(spark.createDataFrame(log, RUNS))
        got = LatestRuns(spark, f"{tmp_path}/state-{compact}").current()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
        assert announced == [(2, "a", 2), (4, "b", 2)]
        done.append(len([x for x in (tmp_path / f"state-{compact}").iterdir() if x.name.startswith("delta")]))
    assert done[0] <= 2 and done[1] == 5  # what a base covers is deleted


def test_stream_is_started_again_on_its_folder(spark, tmp_path):
    row = lambda *x: spark.createDataFrame([x], RUNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    mapping = spark.createDataFrame([("a", 0, "a", 0), ("a", 2, "a", 0)], "uuid string, run_index int, rep_uuid string, rep_run_index int")
    done, rates = [], []
    for k, x in enumerate([("a", 1, 1.0, 1.0, 1, 1, "t", True, 1), ("a", 0, 0.5, 0.5, 1, 1, "t", False, 2), ("b", 0, 0.5, 0.5, 1, 1, "t", False, 3)]):
        row(*x)
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        state = LatestRuns(spark, f"{tmp_path}/state")
        follow(stream, state, 3, lambda df, i: done.extend((r.uuid, r.actual_k) for r in df.collect()), mapping, lambda df, i: rates.append(df.first().total_seeds)).awaitTermination()
    assert done == [("a", 3)] and rates == [0, 1, 2]  # the copy of run 0 completes the seed
    assert {(r.uuid, r.run_index): r.copied_from for r in state.current().collect()} == {("a", 0): None, ("a", 1): None, ("a", 2): "a_run_0", ("b", 0): None}


def test_upper_median_with_outliers(spark):
    from tallyforge.operators import quality

    for values in ([1e12, *range(1001)], [0.0] * 5000 + [1.0, -1e9, 1e300], [float(i * i) for i in range(10_000)], [3.0]):
        row = quality.upper_median(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").first()
        assert row.median == sorted(map(float, values))[len(values) // 2]
    assert tuple(quality.upper_median(spark.createDataFrame([], "v double"), "v").first()) == (0.0, 0.0, 0.0, 0.0)


def test_connectors(spark):
    prompts = spark.createDataFrame([("p",), ("q",)], "prompt string")
    replies = spark.createDataFrame([("p", "r")], "prompt string, reply string")
    assert sorted((r.prompt, r.reply) for r in connectors.replayed(prompts, replies).collect()) == [("p", "r"), ("q", None)]
    with pytest.raises(PermissionError):
        connectors.executed(prompts)
    import shutil

    # Some machines have a driver without its compiler.
    if shutil.which("gcc") and connectors.run_c("int f(int x) { return x; }", "int main() { return 0; }")["compiled"]:
        bench = '#include <stdio.h>\nint f(int); int main() { puts(f(2) == 4 ? "[CASE-1] PASS" : "[CASE-1] FAIL"); return 0; }'
        assert connectors.run_c("int f(int x) { return x * 2; }", bench)["output"].strip() == "[CASE-1] PASS"
        assert connectors.run_c("int f(int x) {", bench)["compiled"] is False
    assert connectors.command(["sleep", "5"], 0.2, "/tmp")[0] is None


def test_lock_state_machine(spark):
    from tallyforge.operators import loop

    schema = "suite string, requirement_index int, passed boolean, output string, locked boolean, expected_output string"
    before = spark.createDataFrame([("f", 0, True, "PASS", True, "PASS"), ("f", 1, True, "PASS a", True, "PASS a"), ("f", 2, False, "FAIL", False, None), ("f", 3, False, "FAIL", False, None), ("f", 4, True, "PASS", True, "PASS")], schema)
    new = spark.createDataFrame([("f", 0, "PASS  again", True), ("f", 1, "FAIL", False), ("f", 2, "PASS b", True), ("f", 3, "?", None)], "suite string, requirement_index int, output string, passed boolean")
    got = {r.requirement_index: tuple(r)[2:] for r in loop.rerun(before, new).collect()}
    assert got == {0: (True, "PASS", True, "PASS"), 1: (False, "FAIL", False, "PASS a"), 2: (True, "PASS b", True, "PASS b"), 3: (False, "?", False, None), 4: (True, "PASS", True, "PASS")}
    kept = {r.requirement_index: r.passed for r in loop.rerun(before, new, verify=False).collect()}
    assert kept[1] is True


def test_revised_requirements(spark):
    from tallyforge.operators import loop

    reqs = spark.createDataFrame([("functional", 0, "old"), ("functional", 1, "same")], "suite string, requirement_index int, requirement string")
    replies = spark.createDataFrame([("functional", 0, '```json {"revised_requirement": "new"} ```'), ("functional", 1, "sorry")], "suite string, requirement_index int, reply string")
    assert sorted(tuple(r)[2:] for r in loop.revised(reqs, replies).collect()) == [("new", True), ("same", False)]


def test_relevant_code_and_intent(spark):
    code = "module m;\nalways @(posedge clk) begin\n  q <= d;\nend\nassign y = a;\nx\n"
    assert values(spark, T.relevant_code(F.col("x")), [(code,), ("plain",)]) == ["always @(posedge clk) begin\n  q <= d;\nend\nassign y = a;", "plain..."]
    got = values(spark, T.intent(F.col("x")), [("a = 1; rst_n = 0; @(posedge clk) @(posedge clk) // Expect y should be high.",)])[0]
    assert got.signals == ["a=1", "rst_n=0"] and got.timing == "2 clock cycles" and got.expected


def test_cli_and_settings(spark, tmp_path, sf_dir):
    from tallyforge import cli

    assert cli.settings({"A": "1", "B": "2", "C": "3"}, '# c\nA="x"\nB = y\nD=z', {"B": "env"}) == {"A": "x", "B": "env", "C": "3", "D": "z"}
    assert cli.main(["query", "language_distribution", sf_dir, "--output", f"{tmp_path}/q"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/q").count() == 2
    spark.createDataFrame([(1, 0.6, None), (2, 0.1, 0.9)], "uuid int, mutation_rate double, coverage double").write.parquet(f"{tmp_path}/rates")
    assert cli.main(["filter", f"{tmp_path}/rates", f"{tmp_path}/out"], spark) == 0
    assert [r.uuid for r in spark.read.json(f"{tmp_path}/out/result_filtered.json").collect()] == [1]


def test_reports_set_the_exit_status(spark, tmp_path):
    from tallyforge import cli

    spark.createDataFrame([(1, 1, 0, True), (1, 2, 0, False), (2, 1, 0, False), (3, 1, 0, False)], "seed int, mutant int, tb int, detected boolean").write.parquet(f"{tmp_path}/runs")
    assert cli.main(["effectiveness", f"{tmp_path}/runs", f"{tmp_path}/e"], spark) == 1
    assert spark.read.json(f"{tmp_path}/e/summary").first().effective == 1
    spark.createDataFrame([("a", True), ("b", False), ("c", None), ("d", True)], "uuid string, passed boolean").write.parquet(f"{tmp_path}/claims")
    spark.createDataFrame([("a", True), ("b", False), ("c", False)], "uuid string, passed boolean").write.parquet(f"{tmp_path}/tests")
    assert cli.main(["verify", f"{tmp_path}/claims", f"{tmp_path}/tests", f"{tmp_path}/v"], spark) == 0
    spark.createDataFrame([("a", False)], "uuid string, passed boolean").write.mode("append").parquet(f"{tmp_path}/tests")
    assert cli.main(["verify", f"{tmp_path}/claims", f"{tmp_path}/tests", f"{tmp_path}/v"], spark) == 1


def test_retries_only_network_faults(spark):
    calls = []

    def flaky(text):
        calls.append(1)
        if len(calls) < 3:
            raise OSError(text)
        return "ok"

    assert connectors.retried(lambda: flaky("HTTP 503"), 3, lambda n: 0) == "ok" and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        connectors.retried(lambda: flaky("bad json"), 3, lambda n: 0)
    prompts = spark.createDataFrame([(1, "a"), (2, None)], "key long, prompt string")
    got = sorted((r.key, r.reply, r.error) for r in connectors.completed(prompts, lambda: lambda p: p.upper(), 1).collect())
    assert got[0] == (1, "A", None) and got[1][1] is None and got[1][2]
