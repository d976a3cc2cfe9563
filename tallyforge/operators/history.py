"""Ordered logs: attempts, chat compression, look-back, flags and block depth over lines, rollback of fixes.

What runs along the rows of a key is a scan (operators/scan.py): a requirement, chat or text of any length is dealt over
several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.scan import Fold, joined_by, numbered, scanned


def repeated_verdicts(attempts: DataFrame) -> DataFrame:
    """The last three verdicts at each attempt, and whether they are the same from the third attempt on."""
    rows = numbered(attempts.select("req", "ts", "seq", "verdict"), ["req"], ["ts", "seq"], last=Fold("tail", F.col("verdict"), 3))
    same = (F.col("nth") >= 3) & (F.size(F.array_distinct("last")) == 1)
    return rows.select("req", "seq", "nth", F.array_join("last", ",").alias("last3"), same.alias("repeated"))


def logged_attempts(attempts: DataFrame) -> DataFrame:
    """The log of attempts: failures always, successes only behind an earlier failure of the requirement.

    So it is everything from the first failure on.
    """
    first = attempts.where("verdict <> 'success'").groupBy("req").agg(F.min(F.struct("ts", "seq")).alias("first"))
    rows = joined_by(attempts, first, ["req"]).where(F.struct("ts", "seq") >= F.col("first"))
    return numbered(rows.select("req", "ts", "seq", "verdict"), ["req"], ["ts", "seq"]).select("req", "seq", "verdict", "nth")


def issue_tags(attempts: DataFrame) -> DataFrame:
    """Per requirement the ordered subset of problem, test-bench and code issues, else PASS; unclear counts as code."""
    has = lambda *names: F.bool_or(F.col("verdict").isin(*names))
    flags = attempts.groupBy("req").agg(has("problem_issue").alias("p"), has("tb_issue").alias("t"), has("code_issue", "unclear").alias("c"))
    tags = F.array_compact(F.array(F.when(F.col("p"), "problem_issue"), F.when(F.col("t"), "tb_issue"), F.when(F.col("c"), "code_issue")))
    return flags.select("req", F.array_join(F.when(F.size(tags) == 0, F.array(F.lit("PASS"))).otherwise(tags), ",").alias("tags"))


def compress_chat(chat: DataFrame, user: str = "user") -> DataFrame:
    """Messages up to the first of the user, and the last; untouched with three or fewer or without one of the user.

    Bounds come from an aggregation that is joined back, so a conversation of any length needs no window of its own.
    """
    bounds = chat.groupBy("conv_id").agg(F.min(F.when(F.col("role") == user, F.col("turn"))).alias("first"), F.max("turn").alias("last"), F.count(F.lit(1)).alias("n"))
    kept = (F.col("n") <= 3) | F.col("first").isNull() | (F.col("turn") <= F.col("first")) | (F.col("turn") == F.col("last"))
    return chat.join(bounds, "conv_id").where(kept).select(*chat.columns)


def rollback_chat(chat: DataFrame, prefix: int, last: int = 2) -> DataFrame:
    """The first ``prefix`` messages and the last ones."""
    sizes = chat.groupBy("conv_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = joined_by(numbered(chat, ["conv_id"], ["turn"], "__up"), sizes, ["conv_id"])
    return rows.where((F.col("__up") <= prefix) | (F.col("__up") > F.col("__n") - last)).select(*chat.columns)


def role_names(chat: DataFrame) -> DataFrame:
    """Roles as message types; null for unknown ones."""
    kind = F.when(F.col("role") == "system", "SystemMessage").when(F.col("role") == "user", "HumanMessage").when(F.col("role") == "assistant", "AIMessage")
    return chat.select("conv_id", "turn", kind.alias("type"))


def look_back(lines: DataFrame, marker: str = "//", width: int = 5) -> DataFrame:
    """For each line the lines with the marker among the preceding ``width``, in order."""
    held = Fold("tail", F.when(F.col("line").contains(marker), F.trim("line")), width, before=True)
    hits = F.array_compact("hits")
    rows = scanned(lines, ["doc_id"], ["n"], {"hits": held})
    return rows.select("doc_id", "n", F.size(hits).alias("n_hits"), F.array_join(hits, "|").alias("hits"))


def section_lines(lines: DataFrame, start: str, stop: str) -> DataFrame:
    """Lines from one that contains ``start`` up to, without, the next that contains ``stop``."""
    at = lambda marker: Fold("max", F.when(F.col("line").contains(marker), F.col("n")))
    rows = scanned(lines, ["doc_id"], ["n"], {"__a": at(start), "__b": at(stop)})
    return rows.where(F.col("__a").isNotNull() & (F.col("__b").isNull() | (F.col("__a") > F.col("__b")))).drop("__a", "__b")


def block_lines(lines: DataFrame, opens: str = r"always @|always_ff @|always_comb") -> DataFrame:
    """Lines of blocks with their depth: (doc_id, n, depth), depth as it is behind the line.

    A line that matches ``opens`` starts a block at depth 0. Inside, a line with ``begin`` goes one deeper and one with
    ``end`` one back; the block closes behind the line with ``end`` that reaches 0 or less. Depth is a running sum since
    the line that opened, so three scans do: the opening line, the sum, and the first line that closes.
    """
    opening = F.col("line").rlike(opens)
    step = F.col("line").contains("begin").cast("int") - F.col("line").contains("end").cast("int")
    rows = lines.select("doc_id", "n", "line", opening.alias("__open"), step.alias("__step"), F.col("line").contains("end").alias("__end"))
    opened = Fold("last", F.when(F.col("__open"), F.col("n")))
    rows = scanned(rows, ["doc_id"], ["n"], {"__sum": Fold("sum", F.col("__step")), "__before": Fold("sum", F.col("__step"), before=True), "__opened": opened})
    base = rows.where("__open").select("doc_id", F.col("n").alias("__opened"), F.col("__before").alias("__base"))
    rows = joined_by(rows.where("__opened IS NOT NULL"), base, ["doc_id", "__opened"]).withColumn("depth", (F.col("__sum") - F.col("__base")).cast("int"))
    closed = rows.where(F.col("__end") & (F.col("depth") <= 0)).groupBy("doc_id", "__opened").agg(F.min("n").alias("__closed"))
    rows = joined_by(rows, closed, ["doc_id", "__opened"], "left").where(F.col("__closed").isNull() | (F.col("n") <= F.col("__closed")))
    return rows.select("doc_id", "n", "depth")


#: Tries to make a fix compile, the first one and the repairs of it.
FIX_TRIES = 4


def fixed_iterations(fixes: DataFrame, most: int, keys=("uuid", "run_index"), order=("iteration",)) -> DataFrame:
    """Replay of an evaluation loop that rolls back what doesn't compile.

    fixes: a row for each recorded iteration, with ``passed`` (all functional tests) and ``compiles_at``: the try at which
    the fix behind it compiled, null for never. The loop ends at the first iteration that passed, which has no fix, or
    after ``most``. A fix that compiles within FIX_TRIES is the code from the next iteration on and leaves two messages in
    the chat; another one is rolled back: the code and the chat are those of before.

    Adds ``nth``, ``code`` (the iteration whose fix the code under test is, 0 for the first code), ``rolled_back`` and
    ``messages`` (in the chat at the start of the iteration, besides those before the loop).
    """
    keys, order = list(keys), list(order)
    fine = F.coalesce(F.col("compiles_at") <= FIX_TRIES, F.lit(False)) & ~F.col("passed")
    counted = numbered(fixes.withColumn("passed", F.coalesce("passed", F.lit(False))), keys, order)
    stop = counted.where("passed").groupBy(*keys).agg(F.min("nth").alias("__stop"))
    rows = joined_by(counted.where(F.col("nth") <= most), stop, keys, "left").where("__stop IS NULL OR nth <= __stop").drop("__stop")
    folds = {
        "code": Fold("last", F.when(fine, F.col("nth")), before=True),
        "messages": Fold("sum", F.when(fine, 2).otherwise(0), before=True),
    }
    rows = scanned(rows, keys, ["nth"], folds)
    return rows.withColumns({"code": F.coalesce("code", F.lit(0)), "messages": F.col("messages").cast("int"), "rolled_back": ~F.col("passed") & ~fine})


def feedback(rows: DataFrame, key: str, order: str, text: str, sep: str = "\n") -> DataFrame:
    """Texts of a key joined in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return rows.groupBy(key).agg(F.array_join(parts, sep).alias("feedback"))
