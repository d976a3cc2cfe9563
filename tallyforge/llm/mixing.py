"""Mixes sources to target weights by hierarchical budgeting.

The tree is root - domain - language - source. Bottom up, a node can give the tokens of its leaves times the number of
epochs allowed. Top down, a node's budget is shared among its children by weight; a child that can't give its share
gives what it has, and the shortage is shared again among its siblings by weight. As a node never gets more than its
subtree can give, a shortage reaches the siblings of an ancestor only when all below that ancestor is used up. Sharing
is closed-form (windows over children ordered by capacity / weight), in whole tokens, rounded down.

A leaf's share A of S tokens is A div S whole epochs and a prefix of A mod S tokens of the next epoch. An epoch is the
order of md5(seed:epoch:id); documents of one hash are taken together. The end of the prefix is found without sorting a
leaf: tokens are summed by leading hex digits of the hash, as many digits as leave about ``PER_BUCKET`` documents in a
bucket, and only documents of the bucket in which the prefix ends are ordered. The texts are read twice, once for their
token counts and once for the result, and never shuffled.

Tokens are words [^\\x20\\x09-\\x0D]+. Nulls and edge cases: a null text has no tokens, and a document without any is taken only within a prefix; a null language or source counts
as empty; rows of one id are taken or left together; weights must not be negative, a node of weight 0 gets nothing; an
empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import table, words, work_dir, written

PER_BUCKET = 1024
_LEVELS = ("__m_domain", "__m_lang", "__m_source")


@dataclass(frozen=True)
class Plan:
    """Target weights of nodes by name (others weigh ``default``), the budget as a share of all tokens in percent."""

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 5, "d1": 3, "d2": 2})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    default: int = 1
    budget_percent: int = 100
    epochs: int = 2
    seed: str = "mix-1"


#: No document twice, most of the corpus kept.
PIPELINE = Plan(budget_percent=80, epochs=1)


def domain_of(source: Column) -> Column:
    """Stands for a domain, which the table lacks: d and the source's trailing number modulo 3 (none: 0)."""
    number = F.expr("try_cast(nullif(regexp_extract(__m_source, '([0-9]+)$', 1), '') as long)")
    return F.concat(F.lit("d"), (F.coalesce(number, F.lit(0)) % 3).cast("string"))


def _weight(column: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _with_leaf(docs: DataFrame, key: str) -> DataFrame:
    rows = docs.withColumns({"__m_id": F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), "__m_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "__m_source": F.coalesce(F.col("source").cast("string"), F.lit(""))})
    return rows.withColumn("__m_domain", domain_of(F.col("__m_source")))


def _shared(nodes: DataFrame, parent: tuple[str, ...], name: str, weight: Column) -> DataFrame:
    """nodes (with ``budget`` of their parent and ``can``) with ``share``."""
    rows = nodes.withColumn("w", weight).withColumn("can_w", F.when(F.col("w") > 0, F.col("can")).otherwise(0))
    rows = rows.withColumn("ratio", F.when(F.col("w") > 0, F.col("can") / F.col("w")).otherwise(F.lit(float("inf"))))
    order = W.partitionBy(*parent).orderBy("ratio", name)
    rows = rows.withColumn("used", F.sum("can_w").over(order.rowsBetween(W.unboundedPreceding, -1))).fillna(0, ["used"])
    rows = rows.withColumn("left_w", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    full = (F.col("w") > 0) & ((F.col("budget") - F.col("used")) * F.col("w") >= F.col("can") * F.col("left_w"))
    rows = rows.withColumn("full", full)
    whole = W.partitionBy(*parent)
    rows = rows.withColumn("spent", F.sum(F.when(F.col("full"), F.col("can")).otherwise(0)).over(whole)).withColumn("open_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole))
    share = F.when(F.col("full"), F.col("can")).when(F.col("w") == 0, F.lit(0)).otherwise(F.expr("((budget - spent) * w) div open_w"))
    return rows.withColumn("share", share.cast("long")).drop("w", "can_w", "ratio", "used", "left_w", "full", "spent", "open_w", "budget")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """(domain, language, source, n_docs, tokens, share) from leaves (…, n_docs, tokens)."""
    d, l, s = _LEVELS
    leaves = leaves.withColumn("can", F.col("tokens") * plan.epochs)
    domains = leaves.groupBy(d).agg(F.sum("can").alias("can"), F.sum("tokens").alias("tokens")).withColumn("__root", F.lit(0))
    root = W.partitionBy("__root")
    domains = domains.withColumns({"tokens": F.sum("tokens").over(root), "most": F.sum("can").over(root)})
    domains = domains.withColumn("budget", F.least(F.expr(f"(tokens * {plan.budget_percent}) div 100"), "most"))
    domains = _shared(domains, ("__root",), d, _weight(d, plan.domains, plan.default)).select(d, F.col("share").alias("budget"))
    langs = leaves.groupBy(d, l).agg(F.sum("can").alias("can")).join(domains, d)
    langs = _shared(langs, (d,), l, _weight(l, plan.languages, plan.default)).select(d, l, F.col("share").alias("budget"))
    return _shared(leaves.join(langs, [d, l]), (d, l), s, _weight(s, plan.sources, plan.default)).drop("can")


def _hash(plan: Plan) -> Column:
    return F.md5(F.concat_ws(":", F.lit(plan.seed), F.col("__m_whole") + 1, F.col("__m_id")))


def cuts(docs: DataFrame, plan: Plan, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each leaf: __m_whole, its whole epochs, and __m_cut, the last hash of the next epoch that is taken ('': none)."""
    slim = written(_with_leaf(docs, key).select(*_LEVELS, "__m_id", F.size(words(F.col(f"`{text}`"))).cast("long").alias("tokens")), folder, "tokens")
    leaves = slim.groupBy(*_LEVELS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("tokens"))
    shares = budgets(leaves, plan)
    digits = F.ceil(F.greatest(F.log2(F.col("n_docs") / PER_BUCKET), F.lit(0.0)) / 4).cast("int")
    plans = written(
        shares.select(*_LEVELS, F.expr("if(tokens > 0, share div tokens, 0)").alias("__m_whole"), F.expr("if(tokens > 0, share % tokens, 0)").alias("__m_rest"), digits.alias("__m_digits")),
        folder,
        "shares",
    )
    rows = slim.join(plans, [*_LEVELS]).withColumn("__m_hash", _hash(plan)).withColumn("bucket", F.expr("substr(__m_hash, 1, __m_digits)"))
    sums = rows.groupBy(*_LEVELS, "__m_rest", "bucket").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(W.partitionBy(*_LEVELS).orderBy("bucket"))
    sums = sums.withColumn("upto", upto)
    last = written(
        sums.groupBy(*_LEVELS).agg(
            F.min(F.expr("if(upto > __m_rest, bucket, null)")).alias("at"),
            F.coalesce(F.max(F.expr("if(upto <= __m_rest, upto, 0)")), F.lit(0)).alias("before"),
            F.coalesce(F.max(F.expr("if(upto <= __m_rest, bucket, null)")), F.lit("")).alias("done"),
        ),
        folder,
        "buckets",
    )
    edge = rows.join(last, [*_LEVELS]).where(F.col("bucket") == F.col("at"))
    edge = edge.withColumn("upto", F.col("before") + F.sum("tokens").over(W.partitionBy(*_LEVELS).orderBy("__m_hash")))
    inside = edge.where("upto <= __m_rest").groupBy(*_LEVELS).agg(F.max("__m_hash").alias("inside"))
    whole = F.when(F.col("__m_rest") == 0, F.lit("")).when(F.col("at").isNull(), F.lit("g")).otherwise(F.coalesce("inside", F.when(F.col("done") != "", F.concat("done", F.lit("g"))), F.lit("")))
    return written(
        plans.join(last, [*_LEVELS]).join(inside, [*_LEVELS], "left").select(*_LEVELS, "__m_whole", whole.alias("__m_cut")), folder, "cuts"
    )


def with_copies(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs and __m_copies, how often the mixture takes each row.

    The table of leaves is written first, so that the planner knows its size: below the session's broadcast threshold it
    is broadcast, beyond it the join is a sort-merge join with adaptive skew handling.
    """
    found = cuts(docs, plan, work_dir(docs.sparkSession), key, text)
    rows = _with_leaf(docs, key).join(found, [*_LEVELS])
    taken = F.col("__m_whole") + (_hash(plan) <= F.col("__m_cut")).cast("long")
    return rows.withColumn("__m_copies", taken).select(*(f"`{c}`" for c in docs.columns), "__m_copies")


def mix(docs: DataFrame, plan: Plan = PIPELINE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mixture: rows of docs, each as often as the plan takes it."""
    rows = with_copies(docs, plan, key, text).where("__m_copies > 0")
    if plan.epochs == 1:
        return rows.drop("__m_copies")
    return rows.withColumn("__m_copy", F.explode(F.sequence(F.lit(1).cast("long"), "__m_copies"))).drop("__m_copies", "__m_copy")


def query(spark, sf_dir):
    """op8: for every document how often the default plan takes it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return with_copies(docs).select("doc_id", "lang", "source", F.col("__m_copies").alias("copies"))


def mix_sql(relation: str, plan: Plan, columns: str) -> str:
    """DuckDB CTEs that end in ``mixed``: {columns} of the relation and ``copies``."""
    case = lambda column, names: "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in names.items()) + f" ELSE {plan.default} END" if names else str(plan.default)

    def share(name: str, source: str, parent: str, node: str, weight: str) -> str:
        return f"""
{name}_0 AS (SELECT *, CAST({weight} AS BIGINT) AS w FROM {source}),
{name}_1 AS (SELECT *, coalesce(sum(can) OVER (PARTITION BY {parent} ORDER BY can / w, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(w) OVER (PARTITION BY {parent} ORDER BY can / w, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM {name}_0),
{name}_2 AS (SELECT *, (budget - used) * w >= can * left_w AS is_full FROM {name}_1),
{name} AS (SELECT * EXCLUDE (budget, used, left_w, w, is_full), CAST(if(is_full, can, ((budget - sum(if(is_full, can, 0)) OVER (PARTITION BY {parent})) * w)
             // nullif(sum(if(is_full, 0, w)) OVER (PARTITION BY {parent}), 0)) AS BIGINT) AS share FROM {name}_2)"""

    return f"""
x0 AS (SELECT row_number() OVER () AS row_no, *, coalesce(lang, '') AS l, coalesce(source, '') AS s,
              'd' || (coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') AS BIGINT), 0) % 3) AS d,
              len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM {relation}),
leaves AS (SELECT d, l, s, CAST(sum(tokens) AS BIGINT) AS tokens, CAST({plan.epochs} * sum(tokens) AS BIGINT) AS can FROM x0 GROUP BY d, l, s),
dn AS (SELECT d, 0 AS root, CAST(sum(can) AS BIGINT) AS can, CAST(least((SELECT sum(tokens) * {plan.budget_percent} // 100 FROM leaves), (SELECT sum(can) FROM leaves)) AS BIGINT) AS budget FROM leaves GROUP BY d),
{share("ds", "dn", "root", "d", case("d", plan.domains))},
ln AS (SELECT d, l, CAST(sum(leaves.can) AS BIGINT) AS can, any_value(ds.share) AS budget FROM leaves JOIN ds USING (d) GROUP BY d, l),
{share("ls", "ln", "d", "l", case("l", plan.languages))},
sn AS (SELECT leaves.*, ls.share AS budget FROM leaves JOIN ls USING (d, l)),
{share("ss", "sn", "d, l", "s", case("s", plan.sources))},
x1 AS (SELECT x0.*, if(ss.tokens > 0, ss.share // ss.tokens, 0) AS whole, if(ss.tokens > 0, ss.share % ss.tokens, 0) AS rest FROM x0 JOIN ss USING (d, l, s)),
x2 AS (SELECT *, md5('{plan.seed}:' || (whole + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM x1),
mixed AS (SELECT {columns}, CAST(whole + if(rest > 0 AND sum(tokens) OVER (PARTITION BY d, l, s ORDER BY h) <= rest, 1, 0) AS BIGINT) AS copies FROM x2)"""


SQL = "WITH " + mix_sql("documents", Plan(), "doc_id, lang, source") + " SELECT * FROM mixed"
