"""Mutants of C and Verilog code, and static coverage of Verilog by test benches.

A rule maps a line to (mutated line, type, description) or None. Rules run over the lines in order up to five times the
wanted number; of each type, in order of first appearance, an equal share is taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators.matching import with_hits

Rule = Callable[[str], tuple[str, str, str] | None]

# Types and descriptions of mutants.
CONSTANT = "constant_change"
OPERATOR = "operator_swap"
CONDITION = "condition_negate"
STUCK = "signal_stuck"
REMOVED = "assignment_remove"
SAY_CHANGED = "Changed {} to {}"
SAY_FLIPPED = "Flipped bit in {}"
SAY_NEGATED = "Negated condition '{}'"
SAY_UNNEGATED = "Removed negation from '!{}'"
SAY_STUCK = "Stuck {} at {}"
SAY_NO_ELSE = "Commented out else branch"


def _swap(old: str, new: str, unless: str | None = None) -> Rule:
    def rule(line: str):
        if old in line and not (unless and unless in line):
            return line.replace(old, new, 1), OPERATOR, SAY_CHANGED.format(f"'{old.strip()}'", f"'{new.strip()}'")
        return None

    return rule


def _condition(negated: bool, guarded: bool) -> Rule:
    bang, other = ("!", "") if negated else ("", "!")
    pattern = re.compile(rf"if\s*\(\s*{bang}(\w+)\s*\)")

    def rule(line: str):
        if not (m := pattern.search(line)):
            return None
        out = line.replace(f"if ({bang}{m[1]})", f"if ({other}{m[1]})")
        # Other spacing than "if (x)" stays as it is; only the plain condition skips such a mutant.
        return None if guarded and out == line else (out, CONDITION, (SAY_UNNEGATED if negated else SAY_NEGATED).format(m[1]))

    return rule


def _sized_hex(line: str):
    if not (m := re.search(r"(\d+'h)([0-9A-Fa-f]+)", line)):
        return None
    new = f"{int(m[2], 16) ^ 0xFF:X}"  # 0xFF always changes the value
    return line.replace(m[0], m[1] + new), CONSTANT, SAY_CHANGED.format(m[0], m[1] + new)


def _sized_binary(line: str):
    if not (m := re.search(r"(\d+'b)([01])([01]*)", line)):
        return None
    return line.replace(m[0], m[1] + "10"[int(m[2])] + m[3]), CONSTANT, SAY_FLIPPED.format(m[0])


def _stuck(value: str, label: str, idle: Callable[[str], bool]) -> Rule:
    pattern = re.compile(r"(\w+)\s*<=\s*[^;]+;")

    def rule(line: str):
        m = pattern.search(line)
        if not m or idle(line):
            return None
        return pattern.sub(f"{m[1]} <= {value};", line), STUCK, SAY_STUCK.format(m[1], label)

    return rule


def _no_else(line: str):
    bare = line.strip()
    return ("//" + line, REMOVED, SAY_NO_ELSE) if bare.startswith("else") and "if" not in bare else None


def _decimal(line: str):
    m = re.search(r"(?<![0-9a-fA-FxX])(\d+)(?![0-9a-fA-FxX])", line)
    if not m or not (value := int(m[1])):
        return None
    return f"{line[: m.start(1)]}{value ^ 0xFF}{line[m.end(1) :]}", CONSTANT, SAY_CHANGED.format(value, value ^ 0xFF)


def _hex(line: str):
    if not (m := re.search(r"0x([0-9A-Fa-f]+)", line)):
        return None
    new = f"0x{int(m[1], 16) ^ 0xFF:x}"
    return line.replace(m[0], new), CONSTANT, SAY_CHANGED.format(m[0], new)


_LOGIC = (_swap("&&", "||"), _swap("||", "&&", unless="&&"))
RULES: dict[str, tuple[Rule, ...]] = {
    "verilog": (
        _sized_hex,
        _sized_binary,
        _condition(False, True),
        _condition(True, False),
        *_LOGIC,
        _stuck("0", "0", lambda x: any(s in x for s in ("'h0", "'b0", "= 0"))),
        # The upper-cased line never holds the lower-case h of this marker, so it never stops the rule.
        _stuck("~0", "all 1s", lambda x: "'hF" in x.upper() or "= 1" in x),
        _no_else,
    ),
    "c": (
        _decimal,
        _hex,
        _swap("==", "!="),
        _swap("!=", "==", unless="=="),
        _swap(" + ", " - "),
        _condition(False, True),
        *_LOGIC,
        _swap(" < ", " <= ", unless="<="),
        _swap(" > ", " >= ", unless=">="),
    ),
}


def candidates(code: str, language: str) -> Iterator[tuple[int, str, str, str]]:
    """(line index, mutated line, type, description) in order."""
    for i, line in enumerate(code.split("\n")):
        bare = line.strip()
        if bare and not bare.startswith(("//", "/*")):
            for rule in RULES.get(language, ()):
                if made := rule(line):
                    yield i, *made


def picked(code: str, language: str, n: int) -> list[tuple[int, str, str, str]]:
    """(line index, mutated line, type, description) of up to n mutants."""
    found: dict[str, list[tuple[int, str, str, str]]] = {}
    seen = 0
    for one in candidates(code, language):
        if seen == 5 * n:
            break
        seen += 1
        found.setdefault(one[2], []).append(one)
    share = max(1, n // max(1, len(found)))
    return [one for ones in found.values() for one in ones[:share]][:n]


def with_line(code: str, i: int, new: str) -> str:
    """The code with line i replaced."""
    lines = code.split("\n")
    lines[i] = new
    return "\n".join(lines)


def mutants(code: str, language: str, n: int) -> list[tuple[str, str, str]]:
    """Up to n mutants (code, type, description) of whole code."""
    return [(with_line(code, i, new), kind, f"Line {i + 1}: {what}") for i, new, kind, what in picked(code, language, n)]


#: Characters of mutants that a batch of the output holds.
BATCH = 8 << 20


def mutated(code: DataFrame, n: int = 5) -> DataFrame:
    """code (key, language, code) with a row for each mutant: key, nth, type, description, mutant."""
    schema = pa.schema([("key", pa.int64()), ("nth", pa.int32()), ("type", pa.string()), ("description", pa.string()), ("mutant", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for key, language, source in zip(*batch.columns, strict=True):
                text = source.as_py() or ""
                for nth, (new, kind, what) in enumerate(mutants(text, language.as_py() or "", n)):
                    rows.append((key.as_py(), nth, kind, what, new))
                    size += len(new)
                if size > BATCH:
                    yield _packed(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _packed(rows, schema)

    return code.select("key", "language", "code").mapInArrow(run, "key long, nth int, type string, description string, mutant string")


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def static_coverage(golden: DataFrame, benches: DataFrame) -> DataFrame:
    """golden (seed, code) and benches (seed, code): executable lines and those that mention a tested signal.

    Signals of a seed are few and stay beside its lines; an index of them reads each line once.
    """
    lines = golden.select("seed", F.posexplode(F.split("code", "\n")).alias("n", "line")).where(T.executable(F.col("line")))
    signals = benches.groupBy("seed").agg(F.array_distinct(F.flatten(F.collect_list(T.tested_signals(F.col("code"))))).alias("patterns"))
    rows = with_hits(lines, signals, "seed")
    return rows.groupBy("seed").agg(F.count(F.lit(1)).alias("lines_total"), F.count_if("hit").alias("lines_covered"))
