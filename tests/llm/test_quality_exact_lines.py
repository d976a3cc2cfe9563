import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyforge.llm import exact, lines, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(full), len(full) - len(set(full)), len(covered)


def test_ledger_matches_brute_force(nasty):
    got = nasty.select("doc_id", "text").withColumn("x", F.lit(1))
    out = quality.with_ledger(got).select("text", "__q_ledger.*").collect()
    assert len(out) == nasty.count()
    for r in out:
        assert tuple(r[m] for m in quality.MEASURES) == measures(r.text), r.text and r.text[:50]


def test_ledger_ignores_clashing_columns_and_empty_tables(nasty, empty):
    assert quality.ledger(nasty).columns == ["doc_id", *quality.MEASURES, "failure_bits"]
    assert quality.keep(nasty).columns == nasty.columns
    assert quality.ledger(empty).count() == 0 and quality.keep(empty).count() == 0


def test_policies_and_ablation(nasty):
    ledger = quality.ledger(nasty)
    bits = [r.failure_bits for r in ledger.collect()]
    for r in quality.ablation(ledger).collect():
        mask, bit = quality.mask_of(r.policy), next(1 << x.bit for x in quality.RULES if x.name == r.rule)
        assert (r.n_docs, r.n_rejected) == (len(bits), sum(b & mask != 0 for b in bits))
        assert (r.n_failing, r.n_only_this) == (sum(b & bit != 0 for b in bits), sum(b & mask == bit for b in bits))


def test_plans_have_no_python(nasty):
    for df in (quality.keep(nasty), lines.clean(nasty)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|MapInArrow", plan)


def test_exact_classes(nasty, empty):
    groups = defaultdict(list)
    for r in nasty.collect():
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        groups[text].append(r.doc_id)
    want = sorted(
        str((d, max((x for x in ids if x is not None), default=None), len(ids), d == max((x for x in ids if x is not None), default=None), hashlib.sha256(t.encode()).hexdigest()))
        for t, ids in groups.items()
        for d in ids
    )
    assert sorted(str(tuple(r)) for r in exact.classes(nasty).collect()) == want
    assert exact.classes(empty).count() == 0


def test_exact_classes_keep_every_row_of_many_in_a_partition(spark):
    """More texts than one record batch holds, in one partition on both levels."""
    docs = spark.range(45_000, numPartitions=1).selectExpr("id AS doc_id", "concat('text ', id % 40000) AS text")
    got = exact.classes(docs).agg(F.count("*"), F.countDistinct("doc_id"), F.count_if("kept"), F.sum("group_size")).first()
    assert tuple(got) == (45_000, 45_000, 40_000, 35_000 + 5_000 * 4)
    packed = exact._packed(iter([(b"%016d" % i, [1, i, 1]) for i in range(30_005)]), docs.selectExpr("cast(text AS binary) AS d", "1L AS l", "doc_id AS k", "1L AS n").limit(1).toArrow().schema)
    assert [b.num_rows for b in packed] == [10_000, 10_000, 10_000, 5]


def test_cuckoo_index_inserts_deletes_and_resizes():
    index = exact.CuckooIndex(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        index.fold(k, i, i, 1)
    assert len(index) == 5000 and all(index.get(k)[1] == i for i, k in enumerate(keys)) and len(index.slots) >= 1250
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert all(index.get(k) is None for k in keys[::2]) and all(index.get(k) for k in keys[1::2])
    index.fold(keys[1], 1, 9, 2)
    assert index.get(keys[1]) == [1, 9, 3] and len(index) == 2500 and dict(index.items()).keys() == set(keys[1::2])
    # A digest that shares fingerprint and bucket with a live one isn't taken for it.
    index, twin = exact.CuckooIndex(4), keys[0][:12] + keys[1][12:]
    index.fold(keys[0], 1, 1, 1)
    assert index.may_hold(twin) and index.get(twin) is None and index.delete(twin) is None
    index.fold(twin, 2, 2, 1)
    assert index.delete(keys[0]) == [1, 1, 1] and index.get(twin) == [2, 2, 1]


def test_full_shards_hand_on_their_oldest_digests(spark, monkeypatch):
    monkeypatch.setattr(exact, "LIVE", 7)
    keys = [hashlib.sha256(str(i % 40).encode()).digest() for i in range(400)]
    out = list(exact._folded_locally((k, 1, i, 1) for i, k in enumerate(keys)))
    assert len(out) > 40 and sum(v[2] for _, v in out) == 400 and len({k for k, _ in out}) == 40
    rows = sorted(((k, *v, k[:2]) for k, v in out), key=lambda r: r[-1])
    assert sorted((k, *v) for k, v in exact._folded(iter(rows))) == sorted((k, 1, 360 + i, 10) for i, k in enumerate(keys[:40]))


def test_shards_hold_many_digests_and_resize(monkeypatch):
    made = []

    class Kept(exact.CuckooIndex):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(exact, "CuckooIndex", Kept)
    monkeypatch.setattr(exact, "SHARD", 3_000)
    keys = sorted(hashlib.sha256(str(i).encode()).digest() for i in range(10_000))
    out = dict(exact._folded((k, 1, i, 1, k[:2]) for k in keys for i in (1, 2)))
    assert len(out) == 10_000 and {tuple(v) for v in out.values()} == {(1, 2, 2)}
    assert [len(x) >= 3_000 for x in made] == [True] * (len(made) - 1) + [False] and len(made) == 4
    assert all(len(x.slots) > 1 << 8 for x in made)  # more buckets than at first: overflow has resized them
    strangers = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(40_000)]
    false = [k for k in strangers if made[0].may_hold(k)]
    assert false and all(made[0].get(k) is None for k in false)


def brute_clean(rows):
    """rows (doc_id, text) in any order -> cleaned texts in that order."""
    seen, out = {}, {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    windows = {}
    for k in order:
        full = [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate((rows[k][1] or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
        windows[k] = full, [(tuple(x for _, x in full[p : p + 3])) for p in range(len(full) - 2)]
    for k in order:
        for p, w in enumerate(windows[k][1]):
            seen.setdefault(w, (rows[k][0], p))
    for k in order:
        full, own = windows[k]
        gone = {full[q][0] for p, w in enumerate(own) if seen[w] != (rows[k][0], p) for q in range(p, p + 3)}
        out[k] = rows[k][1] if not gone else "\n".join(x for i, x in enumerate(rows[k][1].split("\n")) if i not in gone)
    return [out[k] for k in range(len(rows))]


def test_line_windows_match_brute_force(spark):
    a = "\n".join(f"alpha {i}" for i in range(6))
    rows = [(1, a), (2, "intro\n" + a + "\n\noutro"), (3, "alpha 1\nalpha 2\nalpha 3"), (4, None), (5, ""), (6, "r\ns\nt\nr\ns\nt\nr\ns\nt"), (7, "alpha 0 \n\n alpha 1\nother"), (None, "alpha 3\nalpha 4\nalpha 5"), (8, a), (8, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__x", F.lit("kept"))
    got = lines.with_removals(df)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, zip([r[0] for r in rows], brute_clean(rows), strict=True)))
    assert got.columns == ["doc_id", "text", "__x", "__l_removed"]


def test_clean_drops_emptied_documents_only(nasty, empty):
    got = lines.clean(nasty)
    assert got.columns == nasty.columns and lines.clean(empty).count() == 0
    texts = [(r.doc_id, r.text) for r in got.collect()]
    assert (0, None) in texts and (1, "") in texts and all(r.n_chars == len(r.text) for r in got.where("text is not null").collect())
    assert sum(t == dict(texts)[None] for d, t in texts if d is None and t) <= 1
