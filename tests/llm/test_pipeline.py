import importlib
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from tallyforge.llm import minhash, pieces
from tests.llm.test_minhash_mixing_pieces import brute_classes
from tests.llm.test_quality_exact_lines import brute_clean, measures

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fails = lambda m: m[0] < 10 or 100 * m[5] > 20 * m[0] or 10 * m[2] > 3 * m[0] or m[1] < 2 * m[0] or m[1] > 15 * m[0] or 2 * m[4] > m[3]
    kept = [(r.doc_id, r.text) for r in docs.collect() if not fails(measures(r.text))]
    first = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert sorted((r.doc_id, r.text) for r in first.collect()) == sorted(kept)
    cleaned = [(d, t) for (d, _), t in zip(kept, brute_clean(kept), strict=True) if t.strip()]
    second = corpus_pipeline.line_dedup(spark, first, sf_dir)
    assert sorted((r.doc_id, r.text) for r in second.collect()) == sorted(cleaned)
    # Near-duplicates by the texts as they are now, or as the table has them.
    whole = dict(kept)
    group_of = {d: {d} for d, _ in cleaned}
    for group in brute_classes([*cleaned, *((d, whole[d]) for d, t in cleaned if t != whole[d])]).values():
        every = set().union(*(group_of[d] for d, _ in group))
        for d in every:
            group_of[d] = every
    stay = sorted(k for k in cleaned if k[0] == min(group_of[k[0]]))
    third = corpus_pipeline.near_dedup(spark, second, sf_dir)
    assert sorted((r.doc_id, r.text) for r in third.collect()) == stay
    assert first.columns == second.columns == third.columns == COLUMNS


def test_near_copies_are_found_though_line_dedup_cuts_them(spark, tmp_path):
    lines = [" ".join(f"w{g}x{i}y{k}" for k in range(9)) for g in range(3) for i in range(24)]
    text = lambda g, edits: "\n".join(f"edited line {g} {i} of the text has words of its own" if i in edits else lines[24 * g + i] for i in range(24))
    rows = [(10 * g + k, text(g, edits), "en", "s1", 0) for g in range(3) for k, edits in enumerate(((), (5,), (0,)))]
    rows += [(50, "\n".join(lines[:4] + lines[24:28] + lines[48:52]), "en", "s1", 0)]  # of passages of others, and near none
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cut = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert {r.doc_id for r in minhash.representatives(cut).collect()} == {r.doc_id for r in cut.collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, cut, str(tmp_path)).collect()}
    assert kept == {r.doc_id for r in cut.collect()} - {10 * g + k for g in range(3) for k in (1, 2)}


def test_run_encodes_what_the_mixture_takes(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.where("not round_trip").count() == 0 and out.where("sample = 0").count() > 50
    assert len(corpus_pipeline.STAGES) == 5 and set(out.columns) >= {"doc_id", "sample", "ids"}
    folder = Path(out.inputFiles()[0].removeprefix("file:")).parent
    assert [x.name for x in folder.parent.iterdir()] == ["stage-4"]


def test_edge_cases_pass_every_stage(spark, nasty, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        assert stage(spark, nasty, "").count() > 0, name


def test_entry_lives_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['tallyforge.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    root = importlib.import_module("tallyforge").__path__[0].rsplit("/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
    assert pieces.MODEL


def test_stages_run_without_the_documents_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        # The folder has no documents table, as once the first stage has written its result.
        stage(spark, docs, str(tmp_path / "tables")).write.parquet(str(tmp_path / f"stage-{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        if k in (0, 2, 3):
            assert docs.columns == COLUMNS
        if k == 1:
            cut = docs.select(COLUMNS)
        if k == 2:
            want = corpus_pipeline.near_dedup(spark, cut, sf_dir)
            assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, want.collect()))
    assert docs.count() > 50


def test_near_copies_are_found_by_the_texts_handed_on(spark, tmp_path):
    lines = [" ".join(f"w{g}x{i}y{k}" for k in range(9)) for g in range(3) for i in range(24)]
    text = lambda g, edits: "\n".join(f"edited line {g} {i} of the text has words of its own" if i in edits else lines[24 * g + i] for i in range(24))
    rows = [(10 * g + k, text(g, edits), "en", "s1", 0) for g in range(3) for k, edits in enumerate(((), (5,), (0,)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (_, line_dedup), (_, near_dedup) = corpus_pipeline.STAGES[1:3]
    cut = line_dedup(spark, docs, str(tmp_path))
    assert cut.where("text_before is not null").count() == 6
    assert {r.doc_id for r in near_dedup(spark, cut, str(tmp_path)).collect()} == {0, 10, 20}
