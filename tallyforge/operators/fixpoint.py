"""Replay of the generation loop: rounds of fixes until all tests pass or a shared budget is used up.

The loop of a case is judged, routed and rerun again and again; recorded outcomes tell what each rerun gave. A test is one
row of numbers, with the outcomes of its attempts in order of preference. Tests are dealt by case once, and all rounds are
windows over cases in the tasks where they lie, without a shuffle or a table between; a settled case goes on as one row.

A case of over WHOLE tests isn't held by one task. Such cases go through rounds together, semi-naively, by an aggregation and
a join for each round: a round reads and writes only the cases that no earlier one has settled, and the table of the round
before is deleted. There are at most as many rounds as the budget has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.sources.folders import deleted, shared_folder, written

CASE, TEST = ["case"], ["case", "suite", "requirement_index"]
#: Verdicts in the order in which they are listed; anything else counts as the last.
VERDICTS = ("problem_issue", "tb_issue", "code_issue")
#: Tests of a case whose rounds are windows.
WHOLE = 10_000
_FOLLOWING = ("revise", "fix_tests", "fix_code")


def _code() -> Column:
    """An outcome as a number from 0 that orders like (passed, verdict, revised), as far as that matters: verdicts that count as the
    same issue differ only where another one lies between."""
    v, (problem, tb) = F.col("verdict"), VERDICTS[:2]
    rank = F.when(v.isNull(), 0).when(v < problem, 1).when(v == problem, 2).when(v < tb, 3).when(v == tb, 4).otherwise(5)
    number = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    return (12 * number("passed") + 2 * rank + number("revised")).cast("byte")


def _tests(log: DataFrame, budget: int) -> DataFrame:
    """A row for each test with its recorded outcomes by attempt, o0, o1, ...; no more than the budget can use.

    Of repeated recordings of an attempt the largest counts. Numbers only, which Spark aggregates by hashing before the shuffle.
    """
    rows = log.where(F.col("case").isNotNull() & F.col("attempt").between(0, budget)).select(*TEST, "attempt", _code().alias("code"))
    return rows.groupBy(*TEST).agg(*(F.max(F.when(F.col("attempt") == a, F.col("code"))).alias(f"o{a}") for a in range(budget + 1)))


def _outcome(code: Column) -> Column:
    rank = F.floor(code % 12 / 2)
    verdict = F.when(rank == 2, VERDICTS[0]).when(rank == 4, VERDICTS[1]).otherwise(VERDICTS[2])
    return F.when(code.isNotNull(), F.struct((code >= 12).alias("passed"), verdict.alias("verdict"), (code % 2 == 1).alias("revised")))


def _started(tests: DataFrame, budget: int) -> DataFrame:
    """Tests as rounds by tables have them: every test starts at attempt 0."""
    found = [F.struct(F.lit(a).alias("attempt"), _outcome(F.col(f"o{a}")).alias("o")) for a in range(budget + 1)]
    recorded = F.transform(F.filter(F.array(*found), lambda x: x["o"].isNotNull()), lambda x: F.struct(x["attempt"].alias("attempt"), *(x["o"][c].alias(c) for c in ("passed", "verdict", "revised"))))
    return tests.select(*TEST, recorded.alias("recorded"), F.lit(0).alias("at"), F.lit("initial").alias("action"), F.lit(1).alias("total"), F.lit(1).alias("expert"), F.lit(0).alias("red_team"))


def _by_windows(tests: DataFrame, budget: int) -> DataFrame:
    """The rounds of cases that lie in one task each.

    Of a round its judgement is kept as one number, r1, r2, ...: failing tests, issues, and what follows (0 to 2) or how the case
    ended (3 to 5); null behind the end.
    """
    outcomes = [f"o{a}" for a in range(budget + 1)]
    of_case, of_suite = W.partitionBy("case"), W.partitionBy("case", "suite")
    rows = tests.repartition("case").sortWithinPartitions("case", "suite")
    rows = rows.withColumn("lead", F.row_number().over(of_case.orderBy("suite")) == 1).withColumns({"at": F.lit(0), "total": F.lit(1), "open": F.lit(True)})
    for k in range(1, budget + 1):
        code = F.element_at(F.array(*outcomes), F.col("at") + 1)
        rows = rows.withColumn("now", F.when(F.col("open"), code))
        rank = F.floor(F.col("now") % 12 / 2)
        failing = F.coalesce(F.col("now") < 12, F.lit(False))
        issue = {VERDICTS[0]: failing & (rank == 2), VERDICTS[1]: failing & (rank == 4), VERDICTS[2]: failing & (rank != 2) & (rank != 4)}
        # Suites first, whose order cases share.
        rows = rows.withColumn("affected", F.max(issue[VERDICTS[0]] & (F.col("now") % 2 == 1)).over(of_suite)).withColumns({
            "n": F.count_if(failing).over(of_case), "lacking": F.max(F.col("now").isNull()).over(of_case), "revise": F.max("affected").over(of_case),
            **{v: F.max(x).over(of_case) for v, x in issue.items()},
        })
        end = F.when(F.col("lacking"), 5).when(F.col("n") == 0, 3).when(F.col("total") >= budget, 4)
        step = F.coalesce(end, F.when(F.col("revise"), 0).when(F.col(VERDICTS[1]), 1).otherwise(2))
        issues = sum(F.col(v).cast("long") * (1 << i) for i, v in enumerate(VERDICTS))
        rows = rows.withColumn(f"r{k}", F.when(F.col("open"), F.col("n") * 64 + issues * 8 + step))
        goes_on = F.coalesce(F.col(f"r{k}") % 8 < 3, F.lit(False))
        moves = F.when(step == 0, F.col("affected")).when(step == 1, issue[VERDICTS[1]]).otherwise(F.lit(True))
        rows = rows.where(goes_on | F.col("lead")).select(
            *TEST, *outcomes, "lead", (F.col("at") + moves.cast("int")).alias("at"), (F.col("total") + 1).alias("total"), goes_on.alias("open"), *(f"r{i}" for i in range(1, k + 1))
        )
    return _rounds(rows.where("lead"), budget)


def _rounds(cases: DataFrame, budget: int) -> DataFrame:
    """A row for each case and iteration of rows (case, r1, r2, ...)."""
    judged = F.array(*(F.col(f"r{k}") for k in range(1, budget + 1)))
    steps = F.transform(judged, lambda r: (r % 8).cast("int"))
    rows = cases.select("case", steps.alias("steps"), F.posexplode(F.filter(judged, lambda r: r.isNotNull())).alias("before", "r"))
    name = lambda x: F.element_at(F.array(*map(F.lit, _FOLLOWING)), x + 1)
    # All rounds before the last are steps, and round k has k - 1 before it.
    red = F.size(F.filter(F.slice("steps", F.lit(1), F.col("before")), lambda s: s == 1))
    issues = F.floor(F.col("r") / 8) % 8
    named = F.array_join(F.array_compact(F.array(*(F.when(F.floor(issues / (1 << i)) % 2 == 1, v) for i, v in enumerate(VERDICTS)))), ",")
    n, step = F.floor(F.col("r") / 64), F.col("r") % 8
    return rows.select(
        "case", (F.col("before") + 1).alias("iteration"), F.when(F.col("before") == 0, "initial").otherwise(name(F.get("steps", F.col("before") - 1))).alias("action"),
        F.when(n == 0, "PASS").otherwise(named).alias("issues"), n.alias("n_failing"), (F.col("before") + 1).alias("total"), (F.col("before") + 1 - red).alias("expert"),
        red.alias("red_team"), F.when(step == 3, "passed").when(step == 4, "budget").when(step == 5, "unrecorded").alias("outcome"),
    )


def _now() -> Column:
    return F.get(F.filter("recorded", lambda x: x["attempt"] == F.col("at")), F.lit(0))


def _judged(tests: DataFrame, budget: int) -> DataFrame:
    """A row for each case: what fails, what kinds of issues there are, and what comes next or how it ended."""
    rows = tests.withColumn("now", _now())
    failing = ~F.col("now.passed")
    issue = F.when(F.col("now.verdict").isin(*VERDICTS[:2]), F.col("now.verdict")).otherwise(VERDICTS[-1])
    has = {v: F.coalesce(F.bool_or(failing & (issue == v)), F.lit(False)) for v in VERDICTS}
    revised = failing & (issue == "problem_issue") & F.col("now.revised")
    cases = rows.groupBy("case", "action", "total", "expert", "red_team").agg(
        F.count_if(failing).alias("n_failing"),
        F.bool_or(F.col("now").isNull()).alias("lacking"),
        # Suites are few; a case has no more of them than the log has names.
        F.collect_set(F.when(revised, F.col("suite"))).alias("affected"),
        *(has[v].alias(v) for v in VERDICTS),
    )
    issues = F.array_join(F.array_compact(F.array(*(F.when(F.col(v), F.lit(v)) for v in VERDICTS))), ",")
    outcome = F.when(F.col("lacking"), "unrecorded").when(F.col("n_failing") == 0, "passed").when(F.col("total") >= budget, "budget")
    following = F.when(F.size("affected") > 0, "revise").when(F.col("tb_issue"), "fix_tests").otherwise("fix_code")
    return cases.select(
        "case", "action", "total", "expert", "red_team", "n_failing", "affected",
        F.when(F.col("n_failing") == 0, "PASS").otherwise(issues).alias("issues"), outcome.alias("outcome"), F.when(outcome.isNull(), following).alias("following"),
    )


def _advanced(tests: DataFrame, cases: DataFrame) -> DataFrame:
    """The tests of the cases that go on, behind the next step.

    A revision renews all tests of the suites that it is about, a fix of tests renews those that fail by a fault of the
    test, a fix of the code all tests. Tests are fixed by the red team, everything else is the expert's; both draw on the
    same budget.
    """
    open_ = cases.where("outcome IS NULL").select("case", "following", "affected")
    rows = tests.join(open_, "case").withColumn("now", _now())
    moves = (
        F.when(F.col("following") == "revise", F.array_contains("affected", F.col("suite")))
        .when(F.col("following") == "fix_tests", ~F.col("now.passed") & (F.col("now.verdict") == "tb_issue"))
        .otherwise(F.lit(True))
    )
    by_red = (F.col("following") == "fix_tests").cast("int")
    return rows.select(
        *TEST, "recorded", (F.col("at") + F.coalesce(moves, F.lit(False)).cast("int")).alias("at"), F.col("following").alias("action"),
        (F.col("total") + 1).alias("total"), (F.col("expert") + 1 - by_red).alias("expert"), (F.col("red_team") + by_red).alias("red_team"),
    )


def replayed(log: DataFrame, budget: int = 10) -> DataFrame:
    """(case, iteration, action, issues, n_failing, total, expert, red_team, outcome): a row for each case and iteration.

    log: (case, suite, requirement_index, attempt, passed, verdict, revised), the recorded outcome of each rerun of a test.
    ``action`` led to the iteration, ``issues`` are what its failures were judged to be, outcome is null but for the last:
    passed, budget, or unrecorded where the log doesn't tell what a rerun gave. A case without tests isn't in the log; rows without a case are left out.
    """
    if budget < 1:
        raise ValueError("the first generation takes one of the budget")
    folder = shared_folder(log.sparkSession)
    tests = written(_tests(log, budget), f"{folder}/tests")
    large = written(tests.groupBy("case").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).select("case"), f"{folder}/large")
    if large.isEmpty():
        return _by_windows(tests, budget)
    small = _by_windows(tests.join(large, "case", "left_anti"), budget)
    return small.unionByName(_by_tables(_started(tests.join(large, "case", "left_semi"), budget), budget, folder))


def _by_tables(tests: DataFrame, budget: int, folder: str) -> DataFrame:
    """The rounds of cases whose tests lie in many tasks."""
    spark = tests.sparkSession
    tests = written(tests, f"{folder}/tests-1")
    rounds = []
    for iteration in range(1, budget + 1):
        rounds.append(written(_judged(tests, budget).withColumn("iteration", F.lit(iteration)), f"{folder}/round-{iteration}"))
        if rounds[-1].where("outcome IS NULL").isEmpty():
            break
        tests = written(_advanced(tests, rounds[-1]), f"{folder}/tests-{iteration + 1}")
        deleted(spark, f"{folder}/tests-{iteration}")
    deleted(spark, f"{folder}/tests-{len(rounds)}")
    paths = [f"{folder}/round-{k + 1}" for k in range(len(rounds))]
    found = spark.read.schema(rounds[0].schema).parquet(*paths)
    return found.select("case", "iteration", "action", "issues", "n_failing", "total", "expert", "red_team", "outcome")

