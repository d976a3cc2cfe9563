"""Table functions, the code file writer, and text functions of loops."""

import os

import pytest

from pyspark.sql import Row
from pyspark.sql import functions as F
from tallyforge.functions import mutants as M
from tallyforge.functions import tables
from tallyforge.functions import text as T
from tallyforge.sources import code_files

C_CODE = "int f(int x) {\n  if (x == 3 && x < 9) return 0x1f + 5;\n  return x + 1;\n}"
CODES = [(1, "c", C_CODE), (2, "verilog", "module m;\n  if (!a) r <= 8'hA5;\n  else r <= 0;\nendmodule"), (3, "c", ""), (4, None, "x == 1"), (5, "c", None)]


@pytest.fixture
def code(spark):
    frame = spark.createDataFrame(CODES, "key long, language string, code string")
    frame.createOrReplaceTempView("code")
    tables.register(spark)
    return frame


def test_lateral_mutants_equal_mutated(spark, code):
    got = spark.sql("SELECT key, m.nth, m.type, m.description, m.mutant FROM code, LATERAL mutants(code, language, 4) m")
    want = M.mutated(code, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_changed_lines_make_the_mutants(spark, code):
    got = spark.sql("SELECT key, code, m.line, m.changed, m.nth FROM code, LATERAL mutants(code, language, n => 3, whole => false) m").collect()
    made = {(r["key"], r["nth"]): M.with_line(r["code"], r["line"] - 1, r["changed"]) for r in got}
    assert made == {(r["key"], r["nth"]): r["mutant"] for r in M.mutated(code, 3).collect()}


@pytest.mark.parametrize("call", ["mutants(key, language)", "mutants(code, language, -1)", "mutants(code, language, key)", "mutants(code, language, 2, 3)"])
def test_wrong_arguments_are_refused(spark, code, call):
    with pytest.raises(Exception, match="must be"):
        spark.sql(f"SELECT m.* FROM code, LATERAL {call} m").collect()


ROWS = [("CWE-1", "u1", 0, 1, "c", "int a;\n"), ("CWE-1", "u1", 1, 2, "verilog", "module é; endmodule"), ("CWE-2", "u2", None, None, None, None)]


def files_below(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(folder) for f in names}


def test_code_files_lie_in_their_folders(spark, tmp_path):
    spark.dataSource.register(code_files.CodeFiles)
    target = str(tmp_path / "code")
    frame = spark.createDataFrame(ROWS, code_files.SCHEMA)
    frame.repartition(3).write.format("code_files").mode("append").save(target)
    want = {"CWE-1/u1/run_0/code_iter1.c": "int a;\n", "CWE-1/u1/run_1/code_iter2.v": "module é; endmodule", "CWE-2/u2/run_0/code_iter0.c": ""}
    assert files_below(target) == want
    spark.createDataFrame([("CWE-1", "u1", 0, 1, "c", "new")], code_files.SCHEMA).write.format("code_files").mode("append").save(target)
    assert files_below(target) == want | {"CWE-1/u1/run_0/code_iter1.c": "new"}
    frame.limit(1).write.format("code_files").mode("overwrite").save(target)
    assert set(files_below(target)) == {"CWE-1/u1/run_0/code_iter1.c"} and not [n for n in os.listdir(target) if n.startswith("_")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(code_files.CodeFiles)
    target = str(tmp_path / "code")
    rows = [("CWE-1", f"u{i}", 0, 1, "c", "x") for i in range(20)] + [("..", "u", 0, 1, "c", "x")]
    with pytest.raises(Exception, match="no folder name"):
        spark.createDataFrame(rows, code_files.SCHEMA).repartition(4).write.format("code_files").mode("append").save(target)
    assert files_below(target) == {}


def test_only_accepted_tasks_are_moved(tmp_path):
    writer = code_files.CodeFileWriter(str(tmp_path), False)
    row = Row(cwe_id="CWE-1", uuid="u", run_index=0, iteration=1, language="c", code="kept")
    lost = writer.write(iter([row]))
    kept = writer.write(iter([row, Row(**row.asDict() | {"uuid": "v"})]))
    assert lost.folder != kept.folder
    writer.commit([None, kept])
    assert set(files_below(tmp_path)) == {"CWE-1/u/run_0/code_iter1.c", "CWE-1/v/run_0/code_iter1.c"}
    other = code_files.CodeFileWriter(str(tmp_path), False)
    other.write(iter([Row(**row.asDict() | {"code": "gone"})]))
    other.abort([None])
    assert set(files_below(tmp_path).values()) == {"kept"}


def test_change_list_and_inferred_language(spark):
    kind = "struct<title:string, reqs:array<string>>"
    rows = [(("a", ["x", "y"]), ("b", ["x", "z", "w"])), (("a", None), ("a", None)), ((None, ["x"]), ("a", []))]
    frame = spark.createDataFrame(rows, f"o {kind}, n {kind}")
    got = [r[0] for r in frame.select(T.change_list(F.col("o"), F.col("n"), ["title"], ["reqs"])).collect()]
    assert got == [["title: a -> b", "reqs[1]: y -> z", "reqs[2]: (none) -> w"], [], ["title: (none) -> a", "reqs[0]: x -> (none)"]]
    chats = [("SystemMessage", "You write Verilog"), ("SystemMessage", "C programming and verilog"), ("SystemMessage", "use ```c"), ("HumanMessage", "Verilog"), ("SystemMessage", None), (None, "verilog")]
    frame = spark.createDataFrame(chats, "k string, t string")
    assert [r[0] for r in frame.select(T.inferred_language(F.col("k"), F.col("t"))).collect()] == ["verilog", "verilog", "c", None, None, None]


def test_leakage_replies(spark):
    replies = ['x {"has_leakage": true, "leakages": [{"req_id": "F-1"}], "suggestions": ["s"]} y', '{"has_leakage": false}', "none", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in replies], "r string").select(T.checked_requirements(F.col("r"), "leakages")).collect()]
    assert [(r["found"], r["items"], r["suggestions"], r["failed"]) for r in got[:1]] == [(True, [{"req_id": "F-1"}], ["s"], False)]
    assert [r["found"] for r in got] == [True, False, False, False] and [r["failed"] for r in got] == [False, False, True, True]
