import json

import pytest

from tallyforge.operators import runs
from tallyforge.sources import documents, sinks


def seed(uuid, **more):
    return {
        "seed_uuid": uuid, "task_id": f"TASK-{uuid}", "language": "c", "status": "completed", "passed": True, "function_requirements": ["f0", "f1"], "security_requirements": ["s0"],
        "iterations": {"1": ["initial"], "2": ["PASS"]}, "functional_test_files": {"tb_functional_req_1_m.c": "why", "tb_functional_req_7_m.c": "beyond", "tb_m.c": "none"}, "security_test_files": {"tb_security_req_0_m.c": "s"},
    } | more


@pytest.fixture
def folder(tmp_path):
    every = {"cwes": {"CWE-1": {"cwe_name": "n", "seeds": [seed("u1"), seed("u2", tb_validated=False), seed("u3", status="failed")]}, "CWE-2": {"cwe_name": "m", "seeds": []}}}
    (tmp_path / "result.json").write_text(json.dumps(every, indent=2))
    report = {"seed_details": [{"seed_uuid": "u1", "is_effective": True}, {"seed_uuid": "u2", "is_effective": False}]}
    (tmp_path / "filter_report.json").write_text(json.dumps(report))
    return str(tmp_path)


def test_result_documents(spark, folder, tmp_path):
    assert sorted((r.seed_uuid, r.cwe_id) for r in documents.seeds(spark, f"{folder}/result.json").collect()) == [("u1", "CWE-1"), ("u2", "CWE-1"), ("u3", "CWE-1")]
    assert sorted(map(tuple, documents.cwe_info(spark, f"{folder}/result.json").collect())) == [("CWE-1", "n", ""), ("CWE-2", "m", "")]
    cases = documents.test_cases(spark, folder)
    assert [r.seed_uuid for r in cases.collect()] == ["u1"]
    assert [r.seed_uuid for r in documents.test_cases(spark, folder, f"{folder}/filter_report.json").collect()] == ["u1"]
    bound = sorted((r.suite, r.requirement_index, r.requirement, r.file) for r in documents.test_files(cases).collect())
    assert bound == [("functional", 1, "f1", "tb_functional_req_1_m.c"), ("security", 0, "s0", "tb_security_req_0_m.c")]
    (tmp_path / "result_filtered.json").write_text(json.dumps({"batch_info": {"cwe_id": "CWE-9"}, "seeds": [seed("v1")]}, indent=1))
    assert documents.result_path(spark, folder).endswith("result_filtered.json")
    assert [(r.seed_uuid, r.cwe_id) for r in documents.test_cases(spark, folder).collect()] == [("v1", "CWE-9")]
    with pytest.raises(FileNotFoundError):
        documents.result_path(spark, f"{folder}/none")


def test_catalogue_demands_its_columns(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"cwe_id": "CWE-1", "name": "n", "description": "d", "other": 1}]))
    (tmp_path / "b.json").write_text(json.dumps([{"cwe_id": "CWE-1", "name": "n"}]))
    assert documents.cwe_catalogue(spark, f"{tmp_path}/a.json").first().notes is None
    with pytest.raises(Exception, match="lacks"):
        documents.cwe_catalogue(spark, f"{tmp_path}/b.json").collect()


def test_files_and_chats(spark, tmp_path):
    one, two = tmp_path / "cwe-1" / "u1", tmp_path / "cwe-1" / "u2"
    one.mkdir(parents=True), two.mkdir()
    (one / "tb_functional_req_0_m.c").write_text("a\nb\r\nc")
    (one / "m.c").write_text("x\n")
    (one / "initial_context.json").write_text(json.dumps([{"type": "SystemMessage", "content": "s"}, {"type": "HumanMessage", "content": "h"}]))
    (two / "initial_context.json").write_text("{broken")
    got = {r.file: (r.kind, r.lines, r.bytes, r.folder) for r in documents.bench_files(spark, str(tmp_path)).collect()}
    assert got == {"tb_functional_req_0_m.c": ("bench", 3, 6, "u1"), "m.c": ("golden", 1, 2, "u1")}
    chats = sorted((r.folder, -1 if r.turn is None else r.turn, r.content or "") for r in documents.chat_contexts(spark, str(tmp_path)).collect())
    assert chats == [("u1", 0, "s"), ("u1", 1, "h"), ("u2", -1, "")]


def test_results_and_sinks(spark, tmp_path):
    last = {"iteration_number": 1, "security_results": [{"requirement_index": 0, "passed": True}] * 3}
    (tmp_path / "eval_result.json").write_text(json.dumps({"results": [{"uuid": "u", "run_index": None, "iterations": [last], "success": True}, {"uuid": "v", "run_index": 1, "iterations": []}]}))
    assert sorted((r.uuid, r.run_index, r.n_req) for r in documents.eval_results(spark, f"{tmp_path}/eval_result.json").collect()) == [("u", None, 3), ("v", 1, 0)]
    schema = "uuid string, run_index int, f_rate double, s_rate double, n_req long, total_iterations int, end_time string, success boolean"
    valid = spark.createDataFrame([("é", 0, 1.0, 1.0, 2, 1, "t", True)], schema)
    sinks.write_passk(valid, 2, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/eval_result_pass_at_2.json/summary").first().total_seeds == 1
    seeds = runs.passk_per_seed(valid, 2)
    sinks.single_document(runs.passk_summary(seeds, 2), seeds, f"{tmp_path}/one")
    whole = json.loads("".join(r[0] + "\n" for r in spark.read.text(f"{tmp_path}/one", wholetext=True).collect()))
    assert whole["results"][0]["uuid"] == "é" and whole["summary"]["seeds_degraded"] == 1
    assert sinks.write_filtered(valid, valid, f"{tmp_path}/f", dry_run=True) is False and not (tmp_path / "f").exists()
    assert sinks.write_filtered(valid, valid, f"{tmp_path}/f", "x") and (tmp_path / "f" / "result_filtered_x.json").exists()
    chat = spark.createDataFrame([(1, 1, "AIMessage", "b"), (1, 0, "HumanMessage", "a")], "conv_id int, turn int, type string, content string")
    sinks.write_chat(chat, f"{tmp_path}/chat")
    assert [m.content for m in spark.read.json(f"{tmp_path}/chat").first().messages] == ["a", "b"]
    sinks.write_code(spark.createDataFrame([("c1", "c", "u", 0, 1, "int x;")], "cwe_id string, language string, uuid string, run_index int, iteration int, code string"), f"{tmp_path}/code")
    assert spark.read.parquet(f"{tmp_path}/code").where("cwe_id = 'c1'").first().code == "int x;"
    sinks.append_seeds(spark.createDataFrame([("u", None)], "uuid string, status string"), f"{tmp_path}/seeds")
    assert spark.read.parquet(f"{tmp_path}/seeds").first().status == "in_progress"


def test_named_files_tell_what_is_missing(spark, tmp_path):
    (tmp_path / "a.c").write_text("int é;\r\nx\n", encoding="utf-8")
    (tmp_path / "b.v").write_text("")
    paths = [str(tmp_path / n) for n in ("a.c", "b.v", "gone.c", "a.c")] + [str(tmp_path)]
    with pytest.warns(UserWarning, match="no such file") as told:
        got = {r["path"]: tuple(r)[1:] for r in documents.named_files(spark, paths).collect()}
    assert {str(w.message).split()[-1] for w in told if w.category is UserWarning} == {paths[2], paths[4]} and len(got) == 4
    assert got[paths[0]] == (True, 11, 2, "int é;\r\nx\n") and got[paths[1]] == (True, 0, 0, "")
    assert got[paths[2]] == got[paths[4]] == (False, None, None, None)
    assert documents.code_of(spark, paths[0]).first()["code"].startswith("int")
    with pytest.raises(FileNotFoundError):
        documents.code_of(spark, paths[2])
    with pytest.warns(UserWarning):
        assert documents.named_files(spark, [paths[2]]).count() == 1
