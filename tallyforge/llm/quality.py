"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a text. The ledger holds the measurements and one long whose bit r is set when rule r
fails. A policy is a versioned set of bits; applying one, or asking what a rule alone costs, is a bitwise operation on
the ledger and reads no text again.

Nulls and edge cases: a null text has no words and fails ``min_words``; so does an empty one. Repeated rows are judged
each for itself. Other columns of the input are carried or ignored as each function says; internal names start with
``__q_`` so that an input may have columns named as the measurements.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACES, computed_once, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "min_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 15 * n_words"),
    Rule(5, "repeated_lines", "2 * n_dup_lines > n_lines"),
)

#: Versioned policies: the names of the rules that reject.
POLICIES = {
    "base": ("min_words", "repeated_windows"),
    "v1": ("min_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines"),
}
DEFAULT_POLICY = "v1"


def mask_of(policy: str) -> int:
    return sum(1 << rule.bit for rule in RULES if rule.name in POLICIES[policy])


def with_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and a struct column ``__q_ledger`` of the measurements and ``failure_bits``.

    Windows are compared by a 64-bit hash of their words within one text. Their positions are sorted only in texts in
    which a window occurs twice.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select("*", words(t).alias("__q_words"))
    rows = rows.select("*", F.transform("__q_words", lambda w: F.xxhash64(w)).alias("__q_hashes"))
    at = lambda i, k: F.get(F.col("__q_hashes"), i + k)
    windows = F.transform(
        F.slice("__q_hashes", F.lit(1), F.greatest(F.size("__q_hashes") - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *(at(i, k) for k in range(1, WINDOW))),
    )
    rows = rows.select("*", windows.alias("__q_windows"))
    located = F.transform("__q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeated = F.size(F.array_distinct("__q_windows")) < F.size("__q_windows")
    rows = rows.select("*", F.when(repeated, F.sort_array(located)).alias("__q_sorted"))
    beside = lambda i: F.get(F.col("__q_sorted"), i)["h"]
    twice = F.filter("__q_sorted", lambda x, i: (x["h"] == beside(i + 1)) | ((i > 0) & (x["h"] == beside(F.greatest(i - 1, F.lit(0))))))
    rows = rows.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("__q_at"))
    covered = F.transform("__q_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__q_at"), i + 1) - p, F.lit(WINDOW))))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = rows.select("*", lines.alias("__q_lines"))
    measures = F.struct(
        F.size("__q_words").cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__q_lines").cast("long").alias("n_lines"),
        (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    rows = rows.select(*(F.col(f"`{c}`") for c in docs.columns), measures.alias("__q_measures"))
    failing = [F.when(_on_measures(rule), F.lit(1 << rule.bit)).otherwise(F.lit(0)) for rule in RULES]
    bits = failing[0]
    for one in failing[1:]:
        bits = bits.bitwiseOR(one)
    fields = [F.col(f"__q_measures.{m}").alias(m) for m in MEASURES]
    ledger = F.struct(*fields, bits.cast("long").alias("failure_bits"))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), computed_once(ledger).alias("__q_ledger"))


def _on_measures(rule: Rule) -> Column:
    sql = rule.fails
    for m in MEASURES:
        sql = sql.replace(m, f"__q_measures.{m}")
    return F.expr(sql)


def passes(policy: str = DEFAULT_POLICY, bits: str = "__q_ledger.failure_bits") -> Column:
    """Whether no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy))) == 0


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: the key, the measurements and the failure bits; no other columns."""
    return with_ledger(docs, text).select(F.col(f"`{key}`"), "__q_ledger.*")


def keep(docs: DataFrame, policy: str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the policy passes."""
    return with_ledger(docs, text).where(passes(policy)).drop("__q_ledger")


def ablation(rows: DataFrame) -> DataFrame:
    """From a ledger: for each policy and rule, the documents rejected, those the rule fails and those it alone rejects.

    The ledger is first counted by its bits, of which there are at most 2^rules combinations. An empty one gives no rows.
    """
    counts = rows.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(mask_of(p)).alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("bit")) for p in POLICIES for r in RULES if r.name in POLICIES[p]]
    each = counts.select("failure_bits", "n", F.inline(F.array(*cases)))
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.expr("if(failure_bits & mask <> 0, n, 0)")).alias("n_rejected"),
        F.sum(F.expr("if(failure_bits & bit <> 0, n, 0)")).alias("n_failing"),
        F.sum(F.expr("if(failure_bits & mask = bit, n, 0)")).alias("n_only_this"),
    )


def query(spark, sf_dir):
    """op7: the ledger of all documents with the verdicts of the base rules and of the default policy."""
    from tallyforge.llm.common import table

    rows = with_ledger(table(spark, sf_dir, "documents"))
    base = passes("base")
    return rows.select(
        "doc_id",
        *(F.col(f"__q_ledger.{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (~base).alias("base_failed"),
        (base & passes()).alias("kept"),
        F.col("__q_ledger.failure_bits").alias("failure_bits"),
    )


#: The measurements and bits of the view ``docs`` in DuckDB; {docs} is replaced by a relation.
LEDGER_SQL = r"""
t AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT row_no, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT row_no, u.i AS i, array_to_string(ws[u.i:u.i + 4], ' ') AS g
        FROM (SELECT row_no, ws FROM w WHERE len(ws) >= 5) s, unnest(range(1, len(ws) - 3)) AS u(i)),
rep AS (SELECT row_no, i FROM win QUALIFY count(*) OVER (PARTITION BY row_no, g) > 1),
cov AS (SELECT row_no, count(DISTINCT i + k) AS n FROM rep, range(0, 5) AS r(k) GROUP BY row_no),
m AS (SELECT w.row_no, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (row_no)),
ledger AS (SELECT *, CAST(if(n_words < 10, 1, 0) + if(100 * n_repeat_words > 20 * n_words, 2, 0) + if(10 * n_symbols > 3 * n_words, 4, 0)
             + if(word_chars < 2 * n_words, 8, 0) + if(word_chars > 15 * n_words, 16, 0) + if(2 * n_dup_lines > n_lines, 32, 0) AS BIGINT) AS failure_bits
           FROM m)
"""

SQL = (
    "WITH "
    + LEDGER_SQL.replace("{docs}", "documents")
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits FROM ledger"""
)


def ablation_query(spark, sf_dir):
    """What each rule of each policy costs, from the ledger of all documents."""
    from tallyforge.llm.common import table

    return ablation(ledger(table(spark, sf_dir, "documents")))


ABLATION_SQL = (
    "WITH "
    + LEDGER_SQL.replace("{docs}", "documents")
    + ", cases(policy, mask, rule, bit) AS (VALUES "
    + ", ".join(f"('{p}', {mask_of(p)}, '{r.name}', {1 << r.bit})" for p in POLICIES for r in RULES if r.name in POLICIES[p])
    + """)
SELECT policy, rule, count(*) AS n_docs, count(*) FILTER (failure_bits & mask <> 0) AS n_rejected, count(*) FILTER (failure_bits & bit <> 0) AS n_failing,
       count(*) FILTER (failure_bits & mask = bit) AS n_only_this FROM ledger, cases GROUP BY policy, rule"""
)
