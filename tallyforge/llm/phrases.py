"""Phrase collocations by contiguous pattern growth.

Words are split at white space, pieces at punctuation and line ends. Mining follows PrefixSpan for contiguous patterns:

1. Words are counted by 40-bit hashes, then pairs whose words reach the support, then triples whose pairs do; those that
   reach it are marked in a bitmap of fixed size. A collision or a full bitmap lets more through and never loses a phrase.
2. Every occurrence of a word of a frequent pair is projected to a pointer: the word and the up to three words behind it,
   as far as the bitmaps let the pattern grow. Equal pointers are summed where they are read and again by the shuffle.
3. The pointers are dealt by ranges of (lang, word, word, ...), so that a task owns a run of prefixes and a hot prefix is
   spread over several. In each run patterns grow to the right, depth first; what touches the edge of a run is handed on
   as a partial count, everything else is final and must reach the support to be grown further.

Counts are exact: steps 2 and 3 compare the words themselves.

Nulls and edge cases: a null text is empty, a null language is ``und``; empty texts and tables give no words and no rows.
Repeated rows count each for itself. Ties are broken by the phrase in byte order. Other columns of the input are ignored.
Texts of any length are read whole; a task holds the words of a few MB of text, or of one text if that is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import table, tidy, work_dir, written
from tallyforge.llm.words import RUN, Words, after, mixed, runs

#: Code points that end a piece, and those that end a word; all are single bytes of UTF-8.
BREAKS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
SUPPORT, LONGEST, COVER, TOP = 30, 4, 80, 2000
SCALE = 2_000_000
#: Bits of a bitmap: 16 MB at any size of the corpus.
LOG_BITS = 27
#: Bits of a hash that patterns are counted by. Two that share them are counted together and may both be let through.
_KEPT = np.uint64(-(1 << 24) % (1 << 64))
#: Bytes of text whose pointers are summed together. The shuffle sums again, so that more gains little and takes memory.
POINTED = 1 << 20
#: Rows of a run of sorted pointers.
ROWS = 200_000

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in BLANKS]] = 1
_KIND[[ord(c) for c in BREAKS]] = 2


def _patterns_of(words: Words, bits: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 1, 2, ...: hashes of the k words from each word on, and where all shorter patterns inside are marked.

    bits has the bitmap of each length; the pair behind the last one is that of the first length without.
    """
    beside, hashes, may = words.beside(), words.hashes, np.ones(len(words.hashes), bool)
    for k in range(1, len(bits) + 2):
        yield hashes, may
        if k <= len(bits):
            alive = may & _marked(bits[k - 1], hashes)
            joined = after(beside, k - 1, False)
            may = alive & after(alive, 1, False) & joined
            hashes = mixed(hashes * np.uint64(0xD6E8FEB86659FD93) + after(words.hashes, k, np.uint64(0)))


def _lang_seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


def _runs(batches: Iterator[pa.RecordBatch], size: int = RUN) -> Iterator[tuple[Words, list[str]]]:
    """The words of consecutive texts, with the texts' languages."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        known = {lang: _lang_seed(lang) for lang in set(langs)}
        for words, at, stop in runs(batch.column(1), _KIND, np.array([known[x] for x in langs], np.uint64), size):
            yield words, langs[at:stop]


def _counted(hashes: np.ndarray) -> pa.RecordBatch:
    """Counts by the first 40 bits of the hashes; the rest is 0, which takes a third off what is shuffled."""
    keys, n = np.unique(hashes & _KEPT, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(null, hash, count) of words, and (lang, 0, count) of all words of a language."""
    for words, langs in _runs(batches):
        yield _counted(words.hashes)
        names = sorted(set(langs))
        of = np.array([names.index(x) for x in langs])
        n = np.bincount(of[words.text], minlength=len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.zeros(len(names), np.int64)), pa.array(n)], names=["lang", "h", "n"])


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - LOG_BITS)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _pattern_counts(marks: list):
    """(null, hash, count) of the patterns that are one longer than the longest bitmap has.

    Behind the pairs also (``USED``, hash, 1) of the words that lie in a frequent pair.
    """

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(m.value, np.uint8) for m in marks]
        for words, _ in _runs(batches):
            *_, (shorter, might), (hashes, may) = _patterns_of(words, bits)
            yield _counted(hashes[may])
            if len(bits) == 2:
                pairs = might & _marked(bits[1], shorter)
                pairs[1:] |= pairs[:-1].copy()
                keys = np.unique(words.hashes[pairs])
                yield pa.RecordBatch.from_arrays([pa.array([USED] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(np.ones(len(keys), np.int64))], names=["lang", "h", "n"])

    return work


def _pointers(marks: list, used):
    """Every occurrence of a word of a frequent pair with what may follow it, summed within a run."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(m.value, np.uint8) for m in marks]
        for words, langs in _runs(batches, POINTED):
            # Where a pattern of k words may be frequent; the longest ones by what they hold.
            may = [m & (_marked(bits[k], h) if k < len(bits) else True) for k, (h, m) in enumerate(_patterns_of(words, bits))]
            known = np.flatnonzero(may[0] & _marked(np.frombuffer(used.value, np.uint8), words.hashes))
            if not len(known):
                continue
            coded = words.strings().take(pa.array(known)).dictionary_encode()
            size = len(coded.dictionary) + 1
            ids = np.zeros(len(words.hashes) + LONGEST, np.int64)
            ids[known] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs])[words.text[known]]
            columns = [ids[known], *(np.where(may[k][known], ids[known + k], 0) for k in range(1, LONGEST))]
            # Dense numbers of prefixes: equal ones stay equal, and no product passes 64 bits.
            key = of.astype(np.int64)
            for column in columns:
                _, at, key = np.unique(key * size + column, return_index=True, return_inverse=True)
            n = np.bincount(key, minlength=len(at)).astype(np.int64)
            out = [pa.array([names[i] for i in of[at]], pa.string())]
            for column in columns:
                code = column[at]
                out.append(coded.dictionary.take(pa.array(code - 1, mask=code == 0)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*out, pa.array(n)], names=["lang", *COLUMNS, "n"])

    return work


USED = "used"
COLUMNS = [f"w{k}" for k in range(1, LONGEST + 1)]


def _grown(support: int):
    """Depth-first growth over runs of sorted pointers."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                yield _patterns(pa.Table.from_batches(held), support)
                held, rows = [], 0
        if rows:
            yield _patterns(pa.Table.from_batches(held), support)

    return work


def _patterns(pointers: pa.Table, support: int) -> pa.RecordBatch:
    last = pointers.num_rows
    columns, codes = [], []
    for name in ("lang", *COLUMNS):
        coded = pointers.column(name).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        columns.append(coded.dictionary.to_pylist())
        codes.append(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False))
    sums = np.zeros(last + 1, np.int64)
    np.cumsum(pointers.column("n").to_numpy(), out=sums[1:])
    found: list[tuple[str, str, int, int]] = []

    def grow(lang: str, prefix: str, depth: int, low: int, high: int) -> None:
        """Extends a prefix of depth words, whose pointers are the rows low to high, by each word that follows it."""
        own = codes[depth + 1][low:high]
        cuts = low + 1 + np.flatnonzero(own[1:] != own[:-1])
        lows, highs = np.append(low, cuts), np.append(cuts, high)
        totals = sums[highs] - sums[lows]
        for i in np.flatnonzero((codes[depth + 1][lows] >= 0) & ((totals >= support) | (lows == 0) | (highs == last))):
            word = columns[depth + 1][codes[depth + 1][lows[i]]]
            longer = f"{prefix} {word}" if depth else word
            found.append((lang, longer, depth + 1, int(totals[i])))
            if depth + 1 < LONGEST:
                grow(lang, longer, depth + 1, int(lows[i]), int(highs[i]))

    cuts = 1 + np.flatnonzero(codes[0][1:] != codes[0][:-1])
    for low, high in zip([0, *cuts], [*cuts, last], strict=True):
        grow(columns[0][codes[0][low]], "", 0, int(low), int(high))
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
    values = list(zip(*found, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["lang", "phrase", "k", "f"])


def _bitmap(counts: DataFrame):
    """A broadcast bitmap of 2^LOG_BITS bits with those of the hashes h set; its size doesn't depend on their number."""
    spark, part = counts.sparkSession, 1 << 15
    slot = F.shiftrightunsigned("h", 64 - LOG_BITS)
    parts = counts.select(slot.alias("slot")).groupBy(F.expr(f"slot div {part}").alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % part).alias("bits"))
    bits = bytearray(1 << (LOG_BITS - 3))
    for row in parts.toArrow().to_pylist():  # 2^LOG_BITS bits at most
        bits[row["part"] * (part >> 3) : (row["part"] + 1) * (part >> 3)] = row["bits"]
    return spark.sparkContext.broadcast(bytes(bits))


def frequent(docs: DataFrame, support: int = SUPPORT, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of k = 2 to LONGEST words with f >= support occurrences and of the words in them (k = 1),
    and (lang, n) of all words."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = "lang string, h long, n long"
    counts = rows.mapInArrow(tidy(_word_counts), kind).groupBy("lang", "h").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.col("lang").isNotNull() | (F.col("n") >= support)), folder, "words")
    marks = [_bitmap(counts.where("lang is null"))]
    while len(marks) < LONGEST - 1:
        longer = rows.mapInArrow(_pattern_counts(list(marks)), kind).groupBy("lang", "h").agg(F.sum("n").alias("n"))
        longer = written(longer.where((F.col("n") >= support) | F.col("lang").isNotNull()), folder, f"patterns-{len(marks) + 1}")
        marks.append(_bitmap(longer.where("lang is null")))
    used = _bitmap(longer.where("lang is not null"))
    columns = ["lang", *COLUMNS]
    kind = ", ".join(f"{c} string" for c in columns)
    pointers = rows.mapInArrow(_pointers(marks, used), f"{kind}, n long").groupBy(*columns).agg(F.sum("n").alias("n"))
    pointers = written(pointers, folder, "pointers")
    dealt = pointers.repartitionByRange(*columns).sortWithinPartitions(*columns)
    grown = dealt.mapInArrow(_grown(support), "lang string, phrase string, k int, f long")
    phrases = grown.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= support)
    return written(phrases, folder, "phrases"), counts.where("lang is not null").select("lang", "n")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase whose words lie in a longer candidate that covers COVER percent of its occurrences is dropped. The score is
    that of the weakest cut. The window that ranks is limited before its shuffle to ``top`` rows of each task and language.
    """
    phrases, totals = frequent(docs, support, text, lang)
    words = F.split("phrase", " ")
    joined = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    candidates = phrases.where("k > 1")
    longer = [(k, size, at) for k in range(3, LONGEST + 1) for size in range(2, k) for at in range(1, k - size + 2)]
    inner = F.array_distinct(F.array_compact(F.array(*(F.when(F.col("k") == k, joined(at, size)) for k, size, at in longer))))
    over = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("covered"))
    left = candidates.join(over, ["lang", "phrase"], "left").where(F.expr(f"covered is null or cast(100 as decimal(20,0)) * covered < cast({COVER} as decimal(20,0)) * f"))
    cuts = left.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    cuts = cuts.withColumn("first", joined(F.lit(1), F.col("cut"))).withColumn("rest", joined(F.col("cut") + 1, F.col("k") - F.col("cut")))
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr(f"cast({SCALE} as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.select("lang", "phrase", F.struct(score.alias("score"), "cut", "a", "l", "r").alias("by"))
    best = scored.groupBy("lang", "phrase").agg(F.min("by").alias("by")).select("lang", "phrase", "by.*")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir):
    """op13: the collocations of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS sizes(k)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM g WHERE f >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
inner_parts AS (SELECT lang, a, array_to_string(ws[i:i + s - 1], ' ') AS phrase
      FROM (SELECT lang, a, ws, k, s, unnest(range(1, k - s + 2)) AS i FROM c, (VALUES (2), (3)) AS sizes(s) WHERE s < k)),
kept AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(a) AS covered FROM inner_parts GROUP BY ALL) o USING (lang, phrase)
      WHERE covered IS NULL OR 100 * CAST(covered AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:k], ' ') AS tail
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, cut, CAST((2000000 * CAST(a AS HUGEINT)) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best) JOIN n USING (lang) WHERE rank <= 2000
"""
