"""Table functions for SQL: ``SELECT d.key, m.* FROM code d, LATERAL mutants(d.code, d.language, 5) m``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tallyforge.functions import mutants as M

DEFAULT = 5


class Mutants:
    """mutants(code, language [, n [, whole]]): up to n mutants of a code.

    Columns are nth, line (1-based), type and description, and the mutated code; with ``whole => false`` the changed line
    instead, from which and from the code the mutant can be made. n and whole are constants, whole decides the columns.
    """

    @staticmethod
    def analyze(code: AnalyzeArgument, language: AnalyzeArgument, n: AnalyzeArgument | None = None, whole: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, argument in (("code", code), ("language", language)):
            if not isinstance(argument.dataType, StringType):
                raise ValueError(f"{name} must be a string")
        if n is not None and (not n.isConstantExpression or not isinstance(n.value, int) or n.value < 0):
            raise ValueError("n must be a constant, 0 or more")
        if whole is not None and (not whole.isConstantExpression or not isinstance(whole.dataType, BooleanType)):
            raise ValueError("whole must be true or false")
        last = "mutant" if whole is None or whole.value else "changed"
        schema = StructType().add("nth", IntegerType()).add("line", IntegerType()).add("type", StringType()).add("description", StringType()).add(last, StringType())
        return AnalyzeResult(schema)

    def eval(self, code: str | None, language: str | None, n: int = DEFAULT, whole: bool = True) -> Iterator[tuple]:
        text = code or ""
        for nth, (i, new, kind, what) in enumerate(M.picked(text, language or "", n)):
            yield nth, i + 1, kind, f"Line {i + 1}: {what}", M.with_line(text, i, new) if whole else new


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL in this session."""
    spark.udtf.register("mutants", udtf(Mutants))
