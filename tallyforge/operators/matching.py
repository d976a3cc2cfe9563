"""Lines that hold any of many patterns, read once however many there are."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a pattern that its index goes by; shorter ones, and sets of FEW patterns, are looked for one by one.
GRAM, FEW = 4, 8
_SEPARATOR = "\0"


class Patterns:
    """Plain strings, found by their first GRAM characters and then verified by their lengths."""

    def __init__(self, patterns: Sequence[str]):
        long = {p for p in patterns if len(p) >= GRAM}
        self.single = {p for p in patterns if len(p) < GRAM} if len(long) > FEW else set(patterns)
        self.index: dict[str, dict[int, set[str]]] = {}
        for p in long - self.single:
            self.index.setdefault(p[:GRAM], {}).setdefault(len(p), set()).add(p)

    def found(self, line: str) -> bool:
        if any(p in line for p in self.single):
            return True
        for i in range(len(line) - GRAM + 1) if self.index else ():
            if sizes := self.index.get(line[i : i + GRAM]):
                if any(line[i : i + n] in own for n, own in sizes.items()):
                    return True
        return False


def with_hits(lines: DataFrame, patterns: DataFrame, key: str, line: str = "line", name: str = "hit") -> DataFrame:
    """lines and whether the line holds a pattern of its key; patterns: (key, patterns array<string>), one row for a key.

    A key without patterns, and null lines and patterns, have no hit; the empty pattern is in every line. Patterns hold no
    NUL character. The index of a key is built once for neighbouring lines.
    """
    known = F.filter("patterns", lambda p: p.isNotNull())
    joined = F.when(F.size(known) > 0, F.concat(F.lit(_SEPARATOR), F.array_join(known, _SEPARATOR)))
    rows = lines.join(patterns.select(key, joined.alias("__patterns")), key, "left")
    schema = rows.drop("__patterns").withColumn(name, F.lit(False)).schema
    at = rows.columns.index(line)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            hits = []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if own != last:
                    last, index = own, Patterns(own[1:].split(_SEPARATOR)) if own is not None else None
                hits.append(index is not None and text is not None and index.found(text))
            columns = [*batch.columns[:-1], pa.array(hits, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], name])

    return rows.mapInArrow(work, schema)
