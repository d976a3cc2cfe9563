"""Removes passages that repeat across documents, by overlapping windows of three lines.

Lines with a word are trimmed and hashed with two seeds; each three consecutive ones make a window with a 64-bit hash of
either. A window that
occurs more than once anywhere keeps its first occurrence (smallest doc_id, then position); the lines under all later
ones are removed, overlapping windows merging into one covered set. Blank lines stay.

Within a document later occurrences are found in the row itself, so that globally only the first occurrence in each
document counts: the smallest id of each window is a plain hash aggregation, combined before the shuffle, and the join
back is a sort-merge join whose hot windows adaptive execution splits.

Nulls and edge cases: a null text stays null; texts of fewer than three lines with a word have no window and stay; a
null doc_id counts as the smallest; rows that repeat an id are at the same place, so neither is later than the other;
an empty table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACES, computed_once, table

LINES = 3
_LEAST = -(1 << 63)


def _with_windows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with __l_id, __l_mark (which tell rows apart), __l_windows and __l_repeats.

    __l_windows: (h1, h2, at) of the first occurrence of each window of the row; __l_repeats: positions of the others.
    """
    t = F.col(f"`{text}`")
    rows = docs.select(
        "*",
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LEAST)).alias("__l_id"),
        F.xxhash64(F.lit(3), t).alias("__l_mark"),
        F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "").alias("__l_lines"),
    )
    # Each line has two hashes of different seeds, so that lines which collide in one differ in the other.
    rows = rows.select("*", F.transform("__l_lines", lambda x: F.xxhash64(x)).alias("__l_hashes"), F.transform("__l_lines", lambda x: F.xxhash64(F.lit(7), x)).alias("__l_others")).drop("__l_lines")
    at = lambda i, k: F.get(F.col("__l_hashes"), i + k)
    too = lambda i, k: F.get(F.col("__l_others"), i + k)
    window = lambda x, i: F.struct(F.xxhash64(x, at(i, 1), at(i, 2)).alias("h1"), F.xxhash64(too(i, 0), too(i, 1), too(i, 2)).alias("h2"), i.alias("at"))
    starts = F.slice("__l_hashes", F.lit(1), F.greatest(F.size("__l_hashes") - (LINES - 1), F.lit(0)))
    rows = rows.select("*", F.transform(starts, window).alias("__l_all"))
    # Distinct longs are counted by hash, distinct structs would be compared in pairs.
    twice = F.size(F.array_distinct(F.transform("__l_all", lambda w: w["h1"]))) < F.size("__l_all")
    rows = rows.select("*", F.when(twice, F.sort_array("__l_all")).alias("__l_sorted"))
    before = lambda i: F.get(F.col("__l_sorted"), F.greatest(i - 1, F.lit(0)))
    again = lambda w, i: (i > 0) & (w["h1"] == before(i)["h1"]) & (w["h2"] == before(i)["h2"])
    own = [f"`{c}`" for c in docs.columns]
    return rows.select(
        *own,
        "__l_id",
        "__l_mark",
        computed_once(F.when(F.col("__l_sorted").isNull(), F.col("__l_all")).otherwise(F.filter("__l_sorted", lambda w, i: ~again(w, i)))).alias("__l_windows"),
        F.when(F.col("__l_sorted").isNotNull(), F.transform(F.filter("__l_sorted", again), lambda w: w["at"])).alias("__l_repeats"),
    )


def later_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(__l_id, __l_mark, __l_later): for each row with such, the positions of windows that an earlier document has."""
    rows = _with_windows(docs, key, text).select("__l_id", "__l_mark", F.inline("__l_windows"))
    first = rows.groupBy("h1", "h2").agg(F.min("__l_id").alias("first"), F.max("__l_id").alias("last")).where("last > first").drop("last")
    later = rows.join(first.hint("merge"), ["h1", "h2"]).where(F.col("__l_id") > F.col("first"))
    return later.groupBy("__l_id", "__l_mark").agg(F.collect_set("at").alias("__l_later"))


def with_removals(docs: DataFrame, key: str = "doc_id", text: str = "text", before: str | None = None) -> DataFrame:
    """docs with the cleaned text in its column, and __l_removed, the number of lines removed.

    ``before`` names a column for the text as it was of rows that have lost lines, null for others.
    """
    later = later_windows(docs, key, text)
    rows = _with_windows(docs, key, text).drop("__l_windows").join(later.hint("merge"), ["__l_id", "__l_mark"], "left")
    hit = F.array_union(F.coalesce("__l_later", F.array().cast("array<int>")), F.coalesce("__l_repeats", F.array().cast("array<int>")))
    rows = rows.select("*", hit.alias("__l_hit"))
    covered = F.array_distinct(F.flatten(F.transform("__l_hit", lambda p: F.array(*(p + k for k in range(LINES))))))
    some = F.size("__l_hit") > 0
    t = F.col(f"`{text}`")
    rows = rows.select("*", F.when(some, covered).alias("__l_covered"), F.when(some, F.split(t, "\n")).alias("__l_parts"))
    numbered = F.transform("__l_parts", lambda x, i: F.struct(i.alias("i"), (F.btrim(x, F.lit(SPACES)) != "").alias("full")))
    rows = rows.select("*", F.transform(F.filter(numbered, lambda x: x["full"]), lambda x: x["i"]).alias("__l_full"))
    gone = F.transform("__l_covered", lambda c: F.get(F.col("__l_full"), c))
    rows = rows.select("*", F.array_except(F.sequence(F.lit(0), F.size("__l_parts") - 1), gone).alias("__l_stay"))
    cleaned = F.array_join(F.transform("__l_stay", lambda i: F.get(F.col("__l_parts"), i)), "\n")
    own = [F.when(some, cleaned).otherwise(t).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != before]
    own += [F.when(some, t).alias(before)] if before else []
    return rows.select(*own, computed_once(F.when(some, F.size("__l_covered")).otherwise(F.lit(0)).cast("long")).alias("__l_removed"))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", before: str | None = None) -> DataFrame:
    """docs without later occurrences; rows of which no word is left go. n_chars, if there is one, follows the text.

    ``before`` as for ``with_removals``.
    """
    rows = with_removals(docs, key, text, before)
    rows = rows.where((F.col("__l_removed") == 0) | (F.btrim(F.col(f"`{text}`"), F.lit(SPACES)) != "")).drop("__l_removed")
    if n_chars and n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        rows = rows.select(*(F.length(f"`{text}`").cast(kind).alias(c) if c == n_chars else F.col(f"`{c}`") for c in rows.columns))
    return rows


def query(spark, sf_dir):
    """op6: all documents with their cleaned texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_removals(docs).select("doc_id", "text", F.col("__l_removed").alias("n_removed"))


#: Cleaned texts of the relation {docs} in DuckDB, as relation ``cleaned`` (row_no, its columns, text, n_removed).
CLEAN_SQL = r"""
l0 AS (SELECT row_number() OVER () AS row_no, * FROM {docs}),
l1 AS (SELECT row_no, doc_id, u.i AS i, string_split(text, chr(10))[u.i] AS line
       FROM (SELECT row_no, doc_id, text FROM l0 WHERE text IS NOT NULL) s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
l2 AS (SELECT *, trim(line, E' \t\n\x0b\x0c\r') AS bare FROM l1),
l3 AS (SELECT *, row_number() OVER w AS p, lead(bare, 1) OVER w AS b1, lead(bare, 2) OVER w AS b2 FROM l2 WHERE bare <> '' WINDOW w AS (PARTITION BY row_no ORDER BY i)),
l4 AS (SELECT *, row_number() OVER (PARTITION BY bare, b1, b2 ORDER BY doc_id, p) AS nth FROM l3 WHERE b2 IS NOT NULL),
l5 AS (SELECT DISTINCT row_no, p + k AS p FROM l4, range(0, 3) AS r(k) WHERE nth > 1),
l6 AS (SELECT l2.row_no, coalesce(string_agg(l2.line, chr(10) ORDER BY l2.i) FILTER (l5.p IS NULL), '') AS kept, count(l5.p) AS n_removed
       FROM l2 LEFT JOIN l3 ON l2.row_no = l3.row_no AND l2.i = l3.i LEFT JOIN l5 ON l3.row_no = l5.row_no AND l3.p = l5.p GROUP BY l2.row_no),
cleaned AS (SELECT l0.* REPLACE (l6.kept AS text), coalesce(l6.n_removed, 0) AS n_removed FROM l0 LEFT JOIN l6 USING (row_no))
"""

SQL = "WITH " + CLEAN_SQL.replace("{docs}", "documents") + "SELECT doc_id, text, n_removed FROM cleaned"
