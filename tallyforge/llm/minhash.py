"""Near-duplicates by BagMinHash signatures, banding and exact verification of multiset overlap.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text is the multiset of its shingles of five words (a shorter text
is one shingle). Its signature comes from Poisson processes: a shingle of count c owns the weight range (0, c], cut in
the dyadic blocks (0, 1], (1, 2], (2, 4], ... A block is one process whose rate is its width; every point has a time, a
uniform component of the signature and a uniform weight inside the block, and counts where that weight is at most c.
A component holds the earliest time that reaches it; two texts agree in a component with the probability of their
weighted Jaccard similarity. Times of a process only grow, so a process stops at the largest component so far.

Texts of one multiset collapse to a node first, by a 128-bit digest; a node's number is given when nodes are written.
Nodes that agree in all rows of a band share a bucket. Each bucket pairs its members with its smallest node; pairs are
verified exactly on the shingles. The rest, members of buckets that still hold several components, meet in blocks of
bounded size: members outside of the component of the smallest node against all members, nearest signature first, verified
exactly inside of the block, where pairs that a link has connected meanwhile are skipped, as are those whose signatures
agree in less than ``LEAST_BYTES`` bytes (a pair of 0.8 does with a probability below 3e-7). Before a bucket of more than
``BLOCK`` members is cut in several blocks, an exact prefix filter takes out who can't have a link: of the units of each
text, ordered by how rare they are among these texts, two texts of 0.8 must share one of the rarest fifth. Only members
that share such a unit with another component are replicated to blocks; for the others the work is in proportion to their
text. So every link between two texts in a bucket is found or joins nodes that are connected already; what is emitted are
links of a spanning forest, never all pairs. Components come from label propagation with pointer
jumping; links found later join the components found before. Every step is an aggregation or a join on tables in the
shared folder.

Nulls and edge cases: a text without words (null too) has no shingles and is a class of its own; of each class the
document with the smallest id stays; rows that repeat an id and its text share its verdict; null ids count as the largest
document; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import deleted, table, tidy, work_dir, written

SHINGLE, SIMILARITY = 5, 0.8
#: At 0.8 a pair misses all bands with a probability of 5e-5.
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: Agreeing signature bytes that a pair of SIMILARITY falls short of at five standard deviations.
LEAST_BYTES = int(SIZE * SIMILARITY - 5 * (SIZE * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
CHUNK = 1 << 20
BLOCK = 512

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
for _c in range(65, 91):
    _TABLE[_c] = _TABLE[_c + 32]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MIX_WORDS = np.random.default_rng(7).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("n", ())) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("n", _BASE), ("i", inverse)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _powers[name] = np.cumprod(powers, dtype=np.uint64)
    return _powers["n"], _powers["i"]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of UTF-8 bytes."""
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    powers, inverses = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers[: len(data)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * inverses[starts])


def text_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length; memory for CHUNK bytes and the result."""
    if len(data) <= CHUNK:
        return _word_hashes(data)[1]
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _IS_SPACE[data[end]]:
            gaps = np.flatnonzero(_IS_SPACE[data[end : end + CHUNK]])
            end = end + int(gaps[0]) if len(gaps) else min(len(data), end + CHUNK)
        out.append(_word_hashes(data[at:end])[1])
        at = end
    return np.concatenate(out)


def shingles(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of documents whose words are words[bounds[i]:bounds[i + 1]]."""
    counts = np.diff(bounds)
    total = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        total += words[k : k + len(total)] * _MIX_WORDS[k]
    n = np.maximum(counts - SHINGLE + 1, 0)
    docs = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    long = mix(total[first])
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if not len(short):
        return docs, long
    parts = []
    for i in short:
        own = words[bounds[i] : bounds[i + 1]]
        parts.append((own * _MIX_WORDS[: len(own)]).sum(dtype=np.uint64) + _U(len(own)))
    docs, all_ = np.concatenate([docs, short]), np.concatenate([long, mix(np.array(parts, np.uint64))])
    return docs, all_


def bags(docs: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), ordered by document, then shingle."""
    order = np.lexsort((items, docs))
    docs, items = docs[order], items[order]
    new = np.ones(len(items), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (items[1:] != items[:-1])
    at = np.flatnonzero(new)
    return docs[at], items[at], np.diff(np.concatenate((at, [len(items)])))


def signatures(n_docs: int, docs: np.ndarray, items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BagMinHash signatures (n_docs x SIZE, times; inf for documents without shingles)."""
    blocks = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(items)), blocks)
    block = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    doc, count = docs[at], counts[at].astype(np.float64)
    width = np.where(block == 0, 1.0, 2.0 ** (block - 1))
    low = np.where(block == 0, 0.0, width)
    seed = mix(items[at] + block.astype(np.uint64) * _U(0xD1B54A32D192ED03))
    out = np.full(n_docs * SIZE, np.inf)
    limit, time, step = np.full(n_docs, np.inf), np.zeros(len(at)), 0
    while len(seed):
        step += 1
        h = mix(seed + _U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        live = time < limit[doc]
        if not live.all():
            seed, doc, count, width, low, time, h = (x[live] for x in (seed, doc, count, width, low, time, h))
        g = mix(h ^ _U(0x5851F42D4C957F2D))
        where = doc * SIZE + (g % _U(SIZE)).astype(np.int64)
        fits = (low == 0) | (low + width * ((g >> _U(32)).astype(np.float64) * 2.0**-32) < count)
        if fits.all():
            np.minimum.at(out, where, time)
        else:
            np.minimum.at(out, where[fits], time[fits])
        touched = np.unique(doc)
        limit[touched] = out.reshape(n_docs, SIZE)[touched].max(axis=1)
    return out.reshape(n_docs, SIZE)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, words, bounds) of runs of whole texts of about CHUNK bytes."""
    offsets, data = _buffers(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        own = data[offsets[row] : offsets[end]]
        if end == row + 1:
            words = text_words(own)
            bounds = np.array([0, len(words)])
        else:
            cuts = offsets[row : end + 1] - offsets[row]
            # A space between the texts keeps their words apart.
            apart = np.full(len(own) + end - row, 32, np.uint8)
            apart[np.arange(len(own)) + np.repeat(np.arange(end - row), np.diff(cuts))] = own
            starts, words = _word_hashes(apart)
            bounds = np.searchsorted(starts, cuts + np.arange(end - row + 1))
        yield row, end, words, bounds
        row = end


_SIGNED = "doc long, mark long, n1 long, n2 long, bands array<long>, bytes binary"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, mark, text -> the digest (null without shingles), the hash of each band and a byte of each component."""
    for batch in batches:
        for row, end, words, bounds in _chunks(batch.column(2)):
            n = end - row
            docs, items, counts = bags(*shingles(words, bounds))
            sig = signatures(n, docs, items, counts)
            halves = []
            for odd in (3, 0x9FB21C651E98DF25):
                half = np.zeros(n, np.uint64)
                np.add.at(half, docs, mix(mix(items * _U(odd)) + counts.astype(np.uint64)))
                halves.append(mix(half).view(np.int64))
            bits = sig.view(np.uint64)
            keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
            for k in range(ROWS):
                keys = mix(keys * _U(0x9E3779B97F4A7C15) + bits[:, k::ROWS])
            empty = np.isinf(sig[:, 0])
            small = (mix(bits) & _U(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, n),
                    batch.column(1).slice(row, n),
                    *(pa.array(x, pa.int64(), mask=empty) for x in halves),
                    pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), keys.view(np.int64).ravel()),
                    pa.array([x.tobytes() for x in small], pa.binary()),
                ],
                names=["doc", "mark", "n1", "n2", "bands", "bytes"],
            )


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node and its units (hashes of shingle and occurrence, ordered), 8 bytes each."""
    for batch in batches:
        for row, end, words, bounds in _chunks(batch.column(1)):
            docs, items, counts = bags(*shingles(words, bounds))
            at = np.repeat(np.arange(len(items)), counts)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            units, docs = mix(items[at] + nth.astype(np.uint64) * _U(0xD1B54A32D192ED03)), docs[at]
            order = np.lexsort((units, docs))
            units, cuts = units[order], np.searchsorted(docs, np.arange(end - row + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, end - row), pa.array([units[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["node", "units"]
            )


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, units -> a row for each unit, with the number of the node's."""
    for batch in batches:
        for i in range(batch.num_rows):
            units = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
            for at in range(0, len(units), CHUNK >> 4):
                part = units[at : at + (CHUNK >> 4)]
                same = lambda x, kind: pa.array(np.full(len(part), x), kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([same(batch.column(0)[i].as_py(), pa.int64()), same(len(units), pa.int64()), pa.array(part)], names=["node", "size", "unit"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, units of a, units of b -> the pairs that are similar enough."""
    percent = round(SIMILARITY * 100)
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


class _Side:
    """Members of a block: nodes, components, signature bytes, bands and units."""

    def __init__(self, rows: list):
        nodes, labels, sigs, bands, units = zip(*rows, strict=True)
        self.nodes, self.labels = np.array(nodes), np.array(labels)
        self.sigs = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, SIZE)
        self.bands = np.array(bands)
        self.units = [np.frombuffer(u, np.uint64) for u in units]
        self.sizes = np.array([len(u) for u in self.units])


def _verified(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the others are similar to x."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    both = np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= round(SIMILARITY * 100) * (len(x) + sizes - both)


def _block_links(bucket: int, left: _Side, right: _Side) -> Iterator[tuple[int, int]]:
    """Links between components of two sides of a bucket, of pairs whose first common band this bucket is."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    percent = round(SIMILARITY * 100)
    for i in range(len(left.nodes)):
        own = left.sizes[i]
        score = (right.sigs == left.sigs[i]).sum(axis=1)
        fits = (score >= LEAST_BYTES) & (100 * np.minimum(own, right.sizes) >= percent * np.maximum(own, right.sizes))
        spots = np.flatnonzero(fits & (right.labels != left.labels[i]))
        if not len(spots):
            continue
        same = right.bands[spots] == left.bands[i]
        spots = spots[right.bands[spots, same.argmax(axis=1)] == bucket]
        spots = spots[np.argsort(-score[spots], kind="stable")]
        label = int(left.labels[i])
        for low in range(0, len(spots), 32):
            part = [k for k in spots[low : low + 32] if find(int(right.labels[k])) != find(label)]
            if not part:
                continue
            for k, good in zip(part, _verified(left.units[i], [right.units[k] for k in part]), strict=True):
                other = find(int(right.labels[k]))
                if good and other != find(label):
                    parent[find(label)] = other
                    yield int(min(left.nodes[i], right.nodes[k])), int(max(left.nodes[i], right.nodes[k]))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks (bucket, i, j, side, then those of _Side), a block's together -> links.

    A block has about BLOCK rows of either side.
    """
    now, sides = None, ([], [])

    def packed():
        found = list(_block_links(now[0], *map(_Side, sides))) if all(sides) else []
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for bucket, i, j, side, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (bucket, i, j):
                if now is not None:
                    yield packed()
                now, sides = (bucket, i, j), ([], [])
            sides[side].append(rest)
    if now is not None:
        yield packed()


class _Job:
    """One run over docs; tables between its steps lie in one shared folder.

    ``before`` has other texts of the same documents: what these are near to, the document is.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, before: DataFrame | None = None):
        self.spark, self.folder, self.versions = docs.sparkSession, work_dir(docs.sparkSession), before is not None
        self.rows = self._rows(docs, key, text)
        if before is not None:
            old, now = self._rows(before, key, text), self.rows.select("doc", "mark")
            # Only texts that are others than now; these are few, and read again when pairs are verified.
            changed = old.select("doc", "mark").join(now.where("doc is not null").select("doc", F.col("mark").alias("now")), "doc").where("mark <> now").select("doc", "mark").distinct()
            old = old.join(written(changed, self.folder, "changed"), ["doc", "mark"], "left_semi")
            self.rows = self.rows.unionByName(written(old, self.folder, "before"))

    @staticmethod
    def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
        return docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.xxhash64(F.lit(11), f"`{text}`").alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            deleted(self.spark, f"{self.folder}/{name}")

    def signed(self) -> DataFrame:
        return written(self.rows.mapInArrow(tidy(_signed), _SIGNED), self.folder, "signed")

    def nodes(self, signed: DataFrame) -> DataFrame:
        """One row for each digest: its number, the document that stands for it, its bands and bytes."""
        one = F.min_by(F.struct("doc", "mark", "bands", "bytes"), F.struct(F.col("doc").isNull(), "doc", "mark"))
        rows = signed.where("n1 is not null").groupBy("n1", "n2").agg(one.alias("x"), F.count(F.lit(1)).alias("size"))
        return written(rows.select("n1", "n2", F.monotonically_increasing_id().alias("node"), "size", "x.*"), self.folder, "nodes")

    def members(self, nodes: DataFrame) -> DataFrame:
        """(bucket, node, lead) of buckets with several nodes."""
        spots = nodes.select("node", F.explode("bands").alias("bucket"))
        leads = spots.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").drop("last")
        return written(spots.join(leads.hint("merge"), "bucket"), self.folder, "members")

    def units(self, wanted: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """(node, units) of the wanted nodes, from the texts that stand for them."""
        least = F.lit(-(1 << 63))
        stands = wanted.join(nodes.select("node", F.coalesce("doc", least).alias("doc"), "mark"), "node")
        texts = self.rows.withColumn("doc", F.coalesce("doc", least)).join(stands, ["doc", "mark"])
        # Rows that repeat an id and its text give a node's units again.
        found = texts.select("node", "text").mapInArrow(tidy(_contents), "node long, units binary")
        return written(found.groupBy("node").agg(F.first("units").alias("units")), self.folder, f"{name}-units")

    def links(self, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose texts are similar, by their whole shingle multisets."""
        pairs = written(pairs, self.folder, f"{name}-pairs")
        units = self.units(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, name)
        both = pairs.join(units.withColumnsRenamed({"node": "b", "units": "ub"}), "b").join(units.withColumnsRenamed({"node": "a", "units": "ua"}), "a")
        links = written(both.select("a", "b", "ua", "ub").mapInArrow(tidy(_linked), "a long, b long").distinct(), self.folder, f"{name}-links")
        self.drop(f"{name}-pairs", f"{name}-units")
        return links

    def same(self, signed: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links between the texts of one document."""
        of = signed.where("doc is not null and n1 is not null").select("doc", "n1", "n2").join(nodes.select("n1", "n2", "node"), ["n1", "n2"])
        least = of.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").drop("last")
        return of.join(least, "doc").where("node <> a").select("a", F.col("node").alias("b")).distinct()

    def labels(self, links: DataFrame, name: str) -> DataFrame:
        """(node, label): the smallest node of each component, for nodes with links."""
        ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = written(ends, self.folder, f"{name}-ends")
        now = written(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), self.folder, f"{name}-labels-0")
        step = 0
        while True:
            step += 1
            heard = ends.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
            new = now.join(heard, "node").select("node", "label", F.least("label", "heard").alias("least"))
            ahead = now.select(F.col("node").alias("least"), F.col("label").alias("ahead"))
            new = new.join(ahead, "least").select("node", F.least("least", "ahead").alias("label"), (F.least("least", "ahead") < F.col("label")).alias("changed"))
            new = written(new, self.folder, f"{name}-labels-{step}")
            self.drop(f"{name}-labels-{step - 1}")
            if new.where("changed").limit(1).count() == 0:
                self.drop(f"{name}-ends")
                return new.drop("changed")
            now = new.drop("changed")

    def rest(self, members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links between members of one bucket that lie in different components."""
        whole = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        heads = whole.where("node = lead").select("bucket", F.col("label").alias("lead_label"))
        open_ = whole.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
        # A bucket of two was compared when its members were paired with the lead.
        open_ = open_.where("n > 2").join(heads, "bucket").select("bucket", "lead_label", "n")
        rows = written(whole.join(open_, "bucket").select("bucket", "node", "label", (F.col("label") != F.col("lead_label")).alias("outside"), "n"), self.folder, "open")
        if not rows.limit(1).count():
            return rows.select(F.col("node").alias("a"), F.col("node").alias("b"))
        units = self.units(rows.select("node").distinct(), nodes, "open")
        small, large = rows.where(f"n <= {BLOCK}").drop("n"), rows.where(f"n > {BLOCK}").drop("n")
        own = written(large.select("node", "label").distinct(), self.folder, "large")
        if own.limit(1).count():
            small = small.unionByName(large.join(self.sharing_rare_units(own, units), "node", "left_semi"))
        blocks = small.groupBy("bucket").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks"))
        rows = small.join(blocks, "bucket").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        rows = rows.join(nodes.select("node", "bytes", "bands"), "node").join(units, "node")
        every, kept = F.sequence(F.lit(0), F.col("blocks") - 1), ["node", "label", "bytes", "bands", "units"]
        left = rows.where("outside").select("bucket", F.col("own").alias("i"), F.explode(every).alias("j"), F.lit(0).alias("side"), *kept)
        right = rows.select("bucket", F.explode(every).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), *kept)
        dealt = left.unionByName(right).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
        return dealt.mapInArrow(tidy(_compared), "a long, b long").distinct()

    def sharing_rare_units(self, large: DataFrame, units: DataFrame) -> DataFrame:
        """The nodes of large (node, label) that may be similar to one of another label, by an exact prefix filter."""
        percent = round(SIMILARITY * 100)
        single = written(units.join(large.select("node"), "node", "left_semi").mapInArrow(tidy(_single), "node long, size long, unit long"), self.folder, "single")
        shared = single.groupBy("unit").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
        own = single.join(shared.hint("merge"), "unit").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("often", "unit"))).alias("own"))
        # Units that no other text has come first in the order and can't be shared.
        first = F.expr(f"size(own) - cast(ceil(size * {percent} / 100) as int) + 1")
        own = own.join(large, "node").withColumn("first", first).where("first > 0")
        spots = own.select("node", "label", F.explode(F.slice("own", F.lit(1), F.least("first", F.size("own")))).alias("x"))
        spots = written(spots.select("node", "label", F.col("x.unit").alias("unit")), self.folder, "rare")
        between = spots.groupBy("unit").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("unit")
        return written(spots.join(between.hint("merge"), "unit").select("node").distinct(), self.folder, "sharing")

    def joined(self, labels: DataFrame, more: DataFrame) -> DataFrame:
        """labels with the links of more between them: these are few, so labels are propagated between components only."""
        of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
        ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        ends = ends.where("a <> b").distinct()
        outer = self.labels(ends, "all").select(F.col("node").alias("label"), F.col("label").alias("least"))
        single = outer.select(F.col("label").alias("node"), F.col("least").alias("label")).join(labels, "node", "left_anti")
        return labels.join(outer, "label", "left").select("node", F.coalesce("least", "label").alias("label")).unionByName(single)

    def classes(self) -> DataFrame:
        """(doc, mark, class_id, class_size) for each row."""
        signed = self.signed()
        nodes = self.nodes(signed)
        members = self.members(nodes)
        stars = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
        links = self.links(stars, nodes, "star")
        labels = self.labels(links.unionByName(self.same(signed, nodes)) if self.versions else links, "star")
        more = written(self.rest(members, labels, nodes), self.folder, "rest")
        self.drop("members", "open", "open-units", "large", "single", "rare", "sharing", "star-links")
        if more.limit(1).count():
            labels = self.joined(labels, more)
        roots = nodes.select("node", "n1", "n2", "doc", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        groups = roots.groupBy("label").agg(F.min("doc").alias("class_id"), F.sum("size").alias("class_size"))
        found = roots.select("n1", "n2", "label").join(groups, "label").select("n1", "n2", "class_id", "class_size")
        rows = signed.select("doc", "mark", "n1", "n2")
        joined = rows.where("n1 is not null").join(found.hint("merge"), ["n1", "n2"]).select("doc", "mark", "class_id", "class_size")
        return joined.unionByName(rows.where("n1 is null").select("doc", "mark", F.col("doc").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: key, class_id (smallest id of its class), class_size (rows) and kept."""
    found = _Job(docs, key, text).classes()
    return found.select(F.col("doc").alias(key), "class_id", "class_size", F.col("doc").eqNullSafe(F.col("class_id")).alias("kept"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", before: DataFrame | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose document stays for its class.

    Of a class only rows that repeat the id and the text of the one that stays are kept beside it. ``before`` has the
    texts as an earlier step found them (key, text): documents that were near-duplicates then are so still, also where
    that step has cut from one of them what they share. Rows of it whose id isn't in docs don't matter.
    """
    job = _Job(docs, key, text, before)
    dropped = job.classes().where("class_id is not null and (doc is null or doc <> class_id)").select("doc", "mark").distinct()
    dropped = written(dropped.withColumnsRenamed({"doc": "__n_doc", "mark": "__n_mark"}), job.folder, "dropped")
    rows = docs.withColumn("__n_mark", F.xxhash64(F.lit(11), f"`{text}`"))
    same = rows["__n_mark"].eqNullSafe(dropped["__n_mark"]) & F.col(f"`{key}`").cast("long").eqNullSafe(dropped["__n_doc"])
    return rows.join(dropped, same, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def query(spark, sf_dir):
    """op4: every document with its near-duplicate class."""
    return classes(table(spark, sf_dir, "documents"))
