"""Scans over hot keys, the fix-point loop, sweeps, selection and matching against plain Python."""

import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F
from tallyforge.functions import text as T
from tallyforge.operators import fixpoint, history, matching, quality, scan, selection, sweep
from tallyforge.operators.scan import Fold


def made_up(n=600, seed=1):
    rng = random.Random(seed)
    # Most rows are of one key, which lies in several blocks; some keys have one row, one key is null.
    keys = ["hot"] * 8 + ["b", "c", None, "d", "e"]
    return [(rng.choice(keys), i * 3 % n, rng.choice([None, 1, 2, 5, -3])) for i in range(n)]


@pytest.mark.parametrize("blocks", [1, 4, 40])
def test_folds_equal_plain_loops(spark, blocks):
    rows = made_up()
    folds = {
        "total": Fold("sum", F.col("v")), "before": Fold("sum", F.col("v"), before=True), "most": Fold("max", F.col("v")), "least": Fold("min", F.col("v"), before=True),
        "last": Fold("last", F.col("v")), "last_before": Fold("last", F.col("v"), before=True), "tail": Fold("tail", F.col("v"), 3), "tail_before": Fold("tail", F.col("v"), 2, before=True),
    }
    got = scan.scanned(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"], folds, blocks).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        by[r[0]].append(r)
    want = {}
    for k, own in by.items():
        for at, (_, i, _) in enumerate(own):
            before, upto = [v for *_, v in own[:at]], [v for *_, v in own[: at + 1]]
            known, all_ = [v for v in before if v is not None], [v for v in upto if v is not None]
            want[k, i] = (sum(all_), sum(known), max(all_, default=None), min(known, default=None), (all_ or [None])[-1], (known or [None])[-1], upto[-3:], before[-2:])
    assert {(r["k"], r["i"]): tuple(r[c] for c in folds) for r in got} == want


def test_a_hot_key_is_dealt_over_many_tasks(spark):
    rows = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"))
    got = scan.numbered(rows.withColumn("block", F.lit(0)), ["k"], ["i"])
    assert got.where("nth <> i + 1").count() == 0 and got.count() == 40_000
    blocks = scan.scanned(rows, ["k"], ["i"], {"n": Fold("sum", F.lit(1))}, 16)
    assert "Window" in blocks._jdf.queryExecution().toString() and blocks.agg(F.max("n")).first()[0] == 40_000
    # No window is over the key alone, but for the carried rows, of which there is one for each block.
    placed = rows.repartitionByRange(16, "k", "i").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(placed) == 16 and max(r["count"] for r in placed) < 6_000


def test_empty_tables_have_no_rows(spark):
    none = spark.createDataFrame([], "k string, i int, v int")
    assert scan.scanned(none, ["k"], ["i"], {"n": Fold("tail", F.col("v"), 2)}).count() == 0
    lines = spark.createDataFrame([], "doc_id long, n int, line string")
    assert history.block_lines(lines).count() == history.look_back(lines).count() == 0


CODE = [
    "wire a;", "always @(posedge clk) begin", "  if (a) begin", "    q <= d;", "  end", "end", "assign z = a;", "always @(*)", "  x = 1;", "  endcase", "y", "always_ff @(posedge c) begin", "always_comb begin", "n", "end", "tail",
]


def test_block_lines_equal_the_fold_over_a_text(spark):
    rng = random.Random(4)
    docs = [CODE, *([rng.choice(CODE) for _ in range(80)] for _ in range(15))]
    rows = [(d, i + 1, x) for d, own in enumerate(docs) for i, x in enumerate(own)]
    got = {(r["doc_id"], r["n"]): r["depth"] for r in history.block_lines(spark.createDataFrame(rows, "doc_id int, n int, line string")).collect()}
    want = {}
    for d, own in enumerate(docs):
        inside, depth = False, 0
        for i, line in enumerate(own):
            if any(x in line for x in ("always @", "always_ff @", "always_comb")):
                inside, depth = True, 0
            if inside:
                depth += ("begin" in line) - ("end" in line)
                want[d, i + 1] = depth
                inside = not ("end" in line and depth <= 0)
    assert got == want
    # The column function over a whole text keeps the same lines of blocks.
    text = "\n".join(CODE[:6])
    kept = spark.createDataFrame([(text,)], "t string").select(T.relevant_code(F.col("t"))).first()[0]
    assert set(kept.split("\n")) == {CODE[n - 1] for d, n in got if d == 0 and n <= 6}


def plain_replay(rows, most):
    out, by = {}, defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        by[r[0]].append(r)
    for key, own in by.items():
        code = messages = 0
        for nth, (_, it, passed, at) in enumerate(own[:most], 1):
            fine = not passed and at is not None and at <= history.FIX_TRIES
            out[key, it] = (nth, code, messages, not passed and not fine)
            if passed:
                break
            if fine:
                code, messages = nth, messages + 2
    return out


def test_rollback_equals_the_loop(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.random() < 0.01, rng.choice([None, 1, 3, 4, 5, 6])) for i in range(900)]
    frame = spark.createDataFrame(rows, "uuid string, iteration int, passed boolean, compiles_at int")
    for most in (5, 1000):
        got = {(r["uuid"], r["iteration"]): (r["nth"], r["code"], r["messages"], r["rolled_back"]) for r in history.fixed_iterations(frame, most, ["uuid"]).collect()}
        assert got == plain_replay(rows, most)


def plain_fixpoint(log, budget):
    cases, out = defaultdict(lambda: defaultdict(dict)), {}
    for case, suite, req, attempt, passed, verdict, revised in log:
        cases[case][suite, req][attempt] = (bool(passed), verdict, bool(revised))
    for case, tests in cases.items():
        at, total, expert, red, action, iteration = dict.fromkeys(tests, 0), 1, 1, 0, "initial", 1
        while True:
            now = {t: tests[t].get(n) for t, n in at.items()}
            failing = {t: o for t, o in now.items() if o and not o[0]}
            kinds = {t: o[1] if o[1] in ("problem_issue", "tb_issue") else "code_issue" for t, o in failing.items()}
            issues = ",".join(v for v in fixpoint.VERDICTS if v in kinds.values()) or "PASS"
            outcome = "unrecorded" if None in now.values() else "passed" if not failing else "budget" if total >= budget else None
            out[case, iteration] = (action, issues, len(failing), total, expert, red, outcome)
            if outcome:
                break
            affected = {t[0] for t, o in failing.items() if kinds[t] == "problem_issue" and o[2]}
            action = "revise" if affected else "fix_tests" if "tb_issue" in kinds.values() else "fix_code"
            for t in at:
                at[t] += {"revise": t[0] in affected, "fix_tests": kinds.get(t) == "tb_issue", "fix_code": True}[action]
            total, expert, red, iteration = total + 1, expert + (action != "fix_tests"), red + (action == "fix_tests"), iteration + 1
    return out


LOG = "case string, suite string, requirement_index int, attempt int, passed boolean, verdict string, revised boolean"


@pytest.mark.parametrize("budget", [1, 3, 10])
def test_fixpoint_equals_the_loop(spark, budget):
    rng = random.Random(budget)
    verdicts = ["problem_issue", "tb_issue", "code_issue", "unclear", None]
    log = []
    for case in [None, *(f"case-{i}" for i in range(60))]:
        for suite in ("functional", "security"):
            for req in range(rng.randrange(0, 4)):
                for attempt in range(rng.randrange(1, 12)):
                    log.append((case, suite, req, attempt, rng.random() < 0.3 + 0.1 * attempt, rng.choice(verdicts), rng.random() < 0.4))
    got = fixpoint.replayed(spark.createDataFrame([r for r in log], LOG), budget).collect()
    found = {(r["case"], r["iteration"]): tuple(r)[2:] for r in got}
    assert found == plain_fixpoint([r for r in log if r[0]], budget) and len(found) == len(got)


@pytest.mark.parametrize("whole", [0, 3, 10_000])
def test_rounds_by_windows_and_by_tables_equal_the_loop(spark, monkeypatch, whole):
    rng = random.Random(4)
    # Repeated recordings, of which the largest counts, and verdicts around the known ones.
    verdicts = ["problem_issue", "tb_issue", "code_issue", "a", "q", "unclear", None]
    log = [(f"case-{rng.randrange(40)}", rng.choice("fs"), rng.randrange(4), rng.randrange(7), rng.choice([True, False, False, None]), rng.choice(verdicts), rng.choice([True, False, None])) for _ in range(4000)]
    best = {}
    for *test, passed, verdict, revised in log:
        best[tuple(test)] = max(best.get(tuple(test), (False, False, "", False)), (bool(passed), verdict is not None, verdict or "", bool(revised)))
    once = [(*test, passed, verdict if known else None, revised) for test, (passed, known, verdict, revised) in best.items()]
    monkeypatch.setattr(fixpoint, "WHOLE", whole)
    got = fixpoint.replayed(spark.createDataFrame(log, LOG), 5).collect()
    found = {(r["case"], r["iteration"]): tuple(r)[2:] for r in got}
    assert found == plain_fixpoint(once, 5) and len(found) == len(got)


def test_all_rounds_take_one_shuffle(spark, capsys):
    log = [("c", "s", r, a, False, "code_issue", False) for r in range(3) for a in range(5)]
    fixpoint.replayed(spark.createDataFrame(log, LOG), 5).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_fixpoint_of_an_empty_log_and_no_budget(spark):
    assert fixpoint.replayed(spark.createDataFrame([], LOG)).count() == 0
    with pytest.raises(ValueError):
        fixpoint.replayed(spark.createDataFrame([], LOG), 0)


def test_sweep_ends_at_the_first_failure(spark):
    rows = [("a", 0, True), ("a", 1, False), ("a", 1, True), ("a", 2, True), ("b", 0, True), ("b", 2, True), ("c", 0, None), ("c", 1, True), ("d", 0, True), ("d", 1, True), ("d", 2, False)]
    got = sweep.swept(spark.createDataFrame(rows, "key string, level int, ok boolean"), (0, 1, 2)).collect()
    assert {tuple(r) for r in got} == {("a", 0, True, 1), ("a", 1, False, 2), ("b", 0, True, 1), ("c", 0, False, 1), ("d", 0, True, 1), ("d", 1, True, 1), ("d", 2, False, 1)}


@pytest.mark.parametrize("kind", ["distinct", "equal", "few", "outliers", "lumps"])
def test_selection_equals_sorting(spark, kind, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 50)
    rng = random.Random(2)
    n = 3_000
    values = {
        "distinct": [rng.gauss(0, 1) for _ in range(n)], "equal": [2.5] * n, "few": [rng.choice([0.25, 0.5, 1.0]) for _ in range(n)],
        "outliers": [rng.choice([1e300, -1e300, rng.random()]) for _ in range(n)], "lumps": [0.0] * (n // 3) + [rng.random() for _ in range(n // 3)] + [1.0] * (n // 3),
    }[kind]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v double").repartition(6)
    ordered = sorted(values)
    for rank in (0, 1, n // 3, n // 2, n - 1):
        assert selection.nth_value(frame, "v", rank, n) == ordered[rank]
    assert selection.nth_value(frame, "v", n, n) is None and selection.quantile(frame, "v", 0.9) == ordered[int(0.9 * n)] and selection.quantile(frame, "v", 1.0) == ordered[-1]
    assert quality.upper_median(frame, "v").first()["median"] == ordered[n // 2]


def test_matching_equals_contains(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(60)]
    lines = [(rng.choice([1, 2, 3, None]), i, " ".join(rng.choices(words, k=rng.randrange(0, 6))) if rng.random() < 0.95 else None) for i in range(300)]
    patterns = [(1, words[:3]), (2, [*words[:30], None]), (4, words)]
    got = matching.with_hits(spark.createDataFrame(lines, "k int, i int, line string"), spark.createDataFrame(patterns, "k int, patterns array<string>"), "k").collect()
    known = dict(patterns)
    assert {(r["i"], r["hit"]) for r in got} == {(i, x is not None and any(p is not None and p in x for p in known.get(k, ()))) for k, i, x in lines}


def test_matching_of_a_long_line_is_linear():
    import time

    index = matching.Patterns([f"signal{i:05d}" for i in range(5_000)])
    began = time.perf_counter()
    assert not index.found("signa " * 170_000) and index.found("x" * 1_000_000 + "signal04999")
    assert time.perf_counter() - began < 5
