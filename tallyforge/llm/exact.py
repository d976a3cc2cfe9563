"""Exact deduplication over a cuckoo-filter index.

A shard of the index has buckets of four slots. A slot holds the 16-bit fingerprint of a live digest and, as its content,
the digest itself, the length and what is known of the text. A lookup reads the two buckets that a digest may be in;
a fingerprint that hits is verified against the content of its slot, so a false hit never joins two texts. Digests can be
inserted and deleted; a slot's content moves with its fingerprint. An insertion that finds no slot within ``MAX_KICKS``
moves resizes the shard to twice the buckets and refills it from the stored digests. Texts are told apart by SHA-256 and
length, not read again.

Work is spread in two levels so that no digest, however common, meets in one task, and memory is bounded in both. Each
map task folds its rows in a shard of ``LIVE`` digests at most; when it is full the oldest digest is deleted and handed on
(it may come again). Then rows are hashed to partitions by digest and ordered by the digest's first two bytes, and a
partition is folded in shards of ``SHARD`` digests and a prefix more, one after the other, each whole.

Nulls and edge cases: a null text counts as empty. Of equal texts the row with the largest id stays; null ids count as
smallest. Rows that repeat an id and its text are one document and share its verdict. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import itertools
import struct
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import table

SLOTS, MAX_KICKS, LIVE, SHARD = 4, 200, 1 << 17, 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CuckooIndex:
    """A cuckoo filter over digests (bytes, 16 at least) whose slots hold fingerprint, digest and value."""

    def __init__(self, buckets: int = 1 << 8):
        self.live = 0
        self._refill(buckets, [])

    def __len__(self) -> int:
        return self.live

    def _refill(self, buckets: int, kept: list[tuple[int, bytes, list]]) -> None:
        while True:
            self.mask = buckets - 1
            self.slots: list[list[tuple[int, bytes, list]]] = [[] for _ in range(buckets)]
            if all(self._place(slot, self._seat(slot[1])[1]) is None for slot in kept):
                return
            buckets *= 2

    def _seat(self, digest: bytes) -> tuple[int, int]:
        a, b = struct.unpack_from("<QI", digest)
        return b % 65535 + 1, a & self.mask

    def _other(self, mark: int, bucket: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 3)) & self.mask

    def _place(self, slot: tuple[int, bytes, list], bucket: int) -> tuple[int, bytes, list] | None:
        """Puts a slot in one of its buckets, moving others on; gives the one left over where there is no room."""
        for at in (bucket, self._other(slot[0], bucket)):
            if len(self.slots[at]) < SLOTS:
                self.slots[at].append(slot)
                return None
        for kick in range(MAX_KICKS):
            here = self.slots[at]
            slot, here[kick % SLOTS] = here[kick % SLOTS], slot
            at = self._other(slot[0], at)
            if len(self.slots[at]) < SLOTS:
                self.slots[at].append(slot)
                return None
        return slot

    def _find(self, digest: bytes) -> tuple[int, int] | None:
        """Bucket and place of a live digest: a fingerprint that hits is verified against the content."""
        mark, first = self._seat(digest)
        for at in (first, self._other(mark, first)):
            for k, slot in enumerate(self.slots[at]):
                if slot[0] == mark and slot[1] == digest:
                    return at, k
        return None

    def may_hold(self, digest: bytes) -> bool:
        """What the fingerprints alone say; false positives are possible."""
        mark, first = self._seat(digest)
        return any(slot[0] == mark for at in (first, self._other(mark, first)) for slot in self.slots[at])

    def get(self, digest: bytes) -> list | None:
        """The value of a live digest or None."""
        spot = self._find(digest)
        return None if spot is None else self.slots[spot[0]][spot[1]][2]

    def insert(self, digest: bytes, value: list) -> None:
        """Adds a digest that isn't live."""
        mark, at = self._seat(digest)
        left = self._place((mark, digest, value), at)
        if left is not None:
            self._refill(2 * len(self.slots), [*(slot for bucket in self.slots for slot in bucket), left])
        self.live += 1

    def delete(self, digest: bytes) -> list | None:
        """Removes a live digest and gives its value; None if it isn't live."""
        spot = self._find(digest)
        if spot is None:
            return None
        self.live -= 1
        return self.slots[spot[0]].pop(spot[1])[2]

    def items(self) -> Iterator[tuple[bytes, list]]:
        return ((slot[1], slot[2]) for bucket in self.slots for slot in bucket)

    def fold(self, digest: bytes, length: int, keep, size: int) -> bool:
        """A text takes its place in the index: a new one is inserted (True), an equal one is merged with the live entry."""
        live = self.get(digest)
        if live is None:
            self.insert(digest, [length, keep, size])
            return True
        if live[0] != length:
            raise ValueError("two texts of different length share a SHA-256 digest")
        live[1] = keep if live[1] is None else live[1] if keep is None else max(live[1], keep)
        live[2] += size
        return False


def _packed(rows: Iterator[tuple[bytes, list]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, 10_000)):
        columns = [[k for k, _ in part], *([v[i] for _, v in part] for i in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(columns)], names=["digest", "length", "keep_id", "group_size"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _with_schema(work):
    """work gets the rows of batches and gives (digest, value) pairs, which become batches of the same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches := iter(batches), None)
        if first is not None:
            yield from _packed(work(_rows(itertools.chain([first], batches))), first.schema)

    return run


def _folded_locally(rows: Iterator[tuple]) -> Iterator[tuple[bytes, list]]:
    """One row for each digest, or more if LIVE others came in between."""
    index, age = CuckooIndex(), deque()
    for digest, *rest in rows:
        if index.fold(digest, *rest):
            age.append(digest)
            if len(index) > LIVE:
                oldest = age.popleft()
                yield oldest, index.delete(oldest)
    yield from index.items()


def _folded(rows: Iterator[tuple]) -> Iterator[tuple[bytes, list]]:
    """One row for each digest of rows that are ordered by a prefix of the digest (their last column).

    A shard ends with the prefix behind which it holds SHARD digests, so that it has that many and a prefix more.
    """
    index, prefix = CuckooIndex(), None
    for *row, own in rows:
        if own != prefix and len(index) >= SHARD:
            yield from index.items()
            index = CuckooIndex()
        prefix = own
        index.fold(*row)
    yield from index.items()


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def groups(rows: DataFrame) -> DataFrame:
    """(digest, length, keep_id, group_size), one row for each digest of rows (digest, length, keep_id, group_size)."""
    kind = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    local = rows.mapInArrow(_with_schema(_folded_locally), kind)
    dealt = local.withColumn("prefix", F.substring("digest", 1, 2)).repartition("digest").sortWithinPartitions("prefix")
    return dealt.mapInArrow(_with_schema(_folded), kind)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: key, keep_id, group_size, kept and text_sha256.

    The join back to the documents is a sort-merge join on the digest, whose skewed partitions adaptive execution
    splits; the side of the groups has one row for each digest.
    """
    whole = normalised(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length(whole).cast("long").alias("length"))
    found = groups(rows.select("digest", "length", F.col("doc").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    joined = rows.select("doc", "digest").join(found.drop("length").hint("merge"), "digest")
    return joined.select(
        F.col("doc").alias(key), "keep_id", "group_size", F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def query(spark, sf_dir):
    """op5: every document with the document that stays for its text."""
    return classes(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
