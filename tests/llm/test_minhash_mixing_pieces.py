import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import minhash, mixing, pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def brute_classes(rows):
    """{(doc_id, text): set of (doc_id, text) of its class}, rows without words apart."""
    keys = list(dict.fromkeys(rows))
    bags, parent = [bag(t) for _, t in keys], list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            both, all_ = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if all_ and 100 * both >= 80 * all_:
                parent[find(i)] = find(j)
    groups = defaultdict(set)
    for i, k in enumerate(keys):
        groups[find(i)].add(k)
    return {k: groups[find(i)] for i, k in enumerate(keys)}


def signatures(texts):
    out = []
    for row, end, words, bounds in minhash._chunks(pa.array(texts, pa.string())):
        out.append(minhash.signatures(end - row, *minhash.bags(*minhash.shingles(words, bounds))))
    return np.concatenate(out)


def test_signatures_estimate_weighted_jaccard():
    rng, errors = random.Random(5), []
    for n in (8, 60, 600):
        for _ in range(25):
            a = [f"w{rng.randrange(30 if rng.random() < 0.5 else 5000)}" for _ in range(n)]
            b = list(a)
            for _ in range(max(1, n // 40)):
                b[rng.randrange(n)] = "z"
            b += b[: rng.randrange(n // 2)]
            x, y = bag(" ".join(a)), bag(" ".join(b))
            s = signatures([" ".join(a), " ".join(b)])
            errors.append((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_long_texts_are_read_in_parts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)) + " " + "x" * 500
    whole = minhash.text_words(np.frombuffer(text.encode(), np.uint8))
    monkeypatch.setattr(minhash, "CHUNK", 200)
    assert np.array_equal(minhash.text_words(np.frombuffer(text.encode(), np.uint8)), whole) and len(whole) == 3001


def check_classes(spark, rows, df=None):
    df = df or spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash._Job(df, "doc_id", "text").classes()
    texts = df.selectExpr("doc_id AS doc", "xxhash64(11, text) AS mark", "text").distinct()
    same = texts.doc.eqNullSafe(found.doc) & (texts.mark == found.mark)
    got = {(r.doc, r.text): r.class_id for r in found.join(texts, same).select(found.doc, "text", "class_id").collect()}
    want = brute_classes(rows)
    assert got.keys() == want.keys()
    for k, group in want.items():
        assert got[k] == min((d for d, _ in group if d is not None), default=None), k[0]


@pytest.mark.parametrize("block", [minhash.BLOCK, 3])
def test_classes_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # 3: nearly all open buckets are large ones
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice((4, 12, 80, 200)))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = f"e{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    # A chain of edits: a large group whose ends aren't similar, in which stars alone don't reach everyone.
    now = [f"c{rng.randrange(10**6)}" for _ in range(150)]
    for _ in range(60):
        now = list(now)
        now[rng.randrange(150)] = f"c{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(now)))
    check_classes(spark, rows)


def test_a_large_bucket_of_different_texts_is_not_replicated(spark):
    """20,000 texts that share a passage and so may share a bucket: work is in proportion to their number."""
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.range(20_000).selectExpr("id AS doc_id", f"concat('{passage} ', array_join(transform(sequence(1, 20), x -> concat('d', id, 'w', x)), ' ')) AS text")
    job = minhash._Job(docs, "doc_id", "text")
    nodes = job.nodes(job.signed())
    large = nodes.selectExpr("node", "node AS label").where("doc < 20000")
    assert job.sharing_rare_units(large, job.units(large.select("node"), nodes, "open")).count() == 0
    assert spark.read.parquet(f"{job.folder}/rare").count() == 0 and spark.read.parquet(f"{job.folder}/single").count() == 20_000 * 56


def test_links_found_later_join_components(spark):
    job = minhash._Job(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (7, 7), (8, 7)], "node long, label long")
    more = spark.createDataFrame([(2, 4), (5, 8), (5, 6), (1, 2)], "a long, b long")
    got = {r.node: r.label for r in job.joined(labels, more).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 5}
    assert {r.node: r.label for r in job.joined(labels, more.where("a = 1")).collect()} == {r.node: r.label for r in labels.collect()}


def test_rare_units_keep_all_similar_texts(spark):
    rng = random.Random(8)
    pool = [[f"s{k}w{i}" for i in range(30)] for k in range(6)]
    texts = [" ".join(w for k in rng.sample(range(6), rng.choice((3, 4, 5))) for w in pool[k][: rng.choice((26, 28, 30))]) for _ in range(150)]
    texts += [f"{' '.join(pool[k])} {' '.join(f'o{k}x{i}' for i in range(25))}" for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    job = minhash._Job(docs, "doc_id", "text")
    nodes = job.nodes(job.signed())
    large = nodes.selectExpr("node", "node AS label")
    of = {r.node: r.doc for r in nodes.collect()}
    got = {of[r.node] for r in job.sharing_rare_units(large, job.units(large.select("node"), nodes, "open")).collect()}
    bags = {i: bag(texts[i]) for i in of.values()}
    similar = lambda x, y: 100 * (x & y).total() >= 80 * (x | y).total()
    want = {i for i in bags for j in bags if i != j and similar(bags[i], bags[j])}
    assert want and want <= got and not got & set(range(150, 156))


def test_classes_of_edge_cases(spark, nasty, empty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    check_classes(spark, rows, nasty)
    kept = minhash.representatives(nasty)
    assert kept.columns == nasty.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["0", "1", "2", "3", "4", "5", "5", "5", "9", "10", "None"])
    assert minhash.classes(empty).count() == 0 and minhash.representatives(empty).count() == 0


def allocate(tree, weights, budget):
    """Shares of children by repeated sharing, for comparison: {name: (weight, capacity)}."""
    shares, open_ = dict.fromkeys(tree, 0), {k for k in tree if weights[k] > 0}
    while open_:
        left, total = budget - sum(shares.values()), sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] >= tree[k] * total}
        if not full:
            return shares | {k: left * weights[k] // total for k in open_}
        for k in full:
            shares[k] = tree[k]
        open_ -= full
    return shares


def test_budgets_go_to_siblings_first(spark):
    rng = random.Random(2)
    leaves = [(f"d{rng.randrange(3)}", rng.choice(("en", "de", "fr", "xx")), f"s{i}", rng.randrange(1, 20), rng.randrange(0, 500)) for i in range(40)]
    plan = mixing.Plan(sources={"s1": 7, "s2": 0}, budget_percent=70, epochs=2)
    df = spark.createDataFrame(leaves, "__m_domain string, __m_lang string, __m_source string, n_docs long, tokens long")
    got = {tuple(r)[:3]: r.share for r in mixing.budgets(df, plan).select("__m_domain", "__m_lang", "__m_source", "share").collect()}
    can = {x[:3]: 2 * x[4] for x in leaves}
    names = {0: plan.domains, 1: plan.languages, 2: plan.sources}

    def down(prefix, budget):
        level = len(prefix)
        if level == 3:
            assert got[prefix] == budget, prefix
            return
        tree = Counter()
        for k, c in can.items():
            if k[:level] == prefix:
                tree[k[level]] += c
        shares = allocate(tree, {k: names[level].get(k, plan.default) for k in tree}, budget)
        for k, share in shares.items():
            down((*prefix, k), share)

    down((), min(sum(x[4] for x in leaves) * 70 // 100, sum(can.values())))


def test_mixture_matches_sql_at_every_bucket_size(spark, sf_dir, monkeypatch):
    docs = f"(SELECT doc_id, text, lang, source FROM '{sf_dir}/documents.parquet')"
    for plan, per in ((mixing.Plan(), 1024), (mixing.Plan(), 1), (mixing.PIPELINE, 4), (mixing.Plan(epochs=3, budget_percent=250), 2)):
        monkeypatch.setattr(mixing, "PER_BUCKET", per)
        got = mixing.with_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), plan)
        want = duckdb.sql("WITH " + mixing.mix_sql(docs, plan, "doc_id") + " SELECT doc_id, copies FROM mixed").fetchall()
        assert sorted((r.doc_id, r["__m_copies"]) for r in got.collect()) == sorted(want)


def test_mixture_of_edge_cases(spark, nasty, empty):
    got = mixing.mix(nasty)
    assert got.columns == nasty.columns and got.count() <= nasty.count() and mixing.mix(empty).count() == 0
    twice = mixing.mix(nasty, mixing.Plan(epochs=2, budget_percent=200))
    assert twice.columns == nasty.columns and twice.count() > got.count()


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path(pieces.MODEL)


def encode(texts, keys, model, k, alpha=1.0):
    vocab, out = pieces.vocabulary(model, alpha), defaultdict(list)
    for batch in pieces.encode(texts, keys, vocab, k):
        for r in batch.to_pylist():
            out[r["key"]].append(r)
    return out


def paths(text, model, alpha):
    """All segmentations with their log-probabilities."""
    import sentencepiece

    sp, vocab, out = sentencepiece.SentencePieceProcessor(model_file=model), pieces.vocabulary(model, alpha), {}
    whole = "▁" + text.replace(" ", "▁")

    def extend(at, path, log):
        if at == len(whole):
            out[path] = log
        for end in range(at + 1, min(len(whole), at + 16) + 1):
            i = sp.piece_to_id(whole[at:end])
            if i:
                extend(end, (*path, i), log + vocab.weights[i])

    extend(0, (), 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {p: x - z for p, x in out.items()}


def test_samples_follow_the_distribution_without_replacement(model):
    text, n = "tion in", 6000
    logs = paths(text, model, 0.3)
    got = encode([text] * n, list(range(n)), model, 3, 0.3)
    first, second, estimate = Counter(), Counter(), Counter()
    for rows in got.values():
        ids = [tuple(r["ids"]) for r in rows]
        assert len(set(ids)) == 3 and all(abs(r["log_prob"] - logs[i]) < 1e-9 for r, i in zip(rows, ids, strict=True))
        first[ids[0]] += 1
        second[ids[1]] += 1
        for r, i in zip(rows, ids, strict=True):
            estimate[i] += math.exp(r["log_prob"]) / r["inclusion"]
    p = {x: math.exp(v) for x, v in logs.items()}
    for x in sorted(p, key=p.get)[-5:]:
        want = sum(p[y] * p[x] / (1 - p[y]) for y in p if y != x)
        assert abs(first[x] / n - p[x]) < 0.03 and abs(second[x] / n - want) < 0.03
        assert abs(estimate[x] / n - p[x]) < 0.05  # inverse inclusion scores give back the probability


def test_every_segmentation_comes_when_k_is_large(model):
    logs = paths("a in", model, 1.0)
    got = encode(["a in"], [1], model, len(logs) + 5)[1]
    assert {tuple(r["ids"]) for r in got} == set(logs) and all(r["inclusion"] == 1.0 for r in got)


def test_decoding_gives_back_every_text(spark, model, nasty, empty):
    texts = ["", " ", "▁", " ▁ x", "\n\n", "日本🎉é\x00", "a" * 300, "Hello  World ", "%E2", "▁▁a"]
    rows = encode(texts, list(range(len(texts))), model, 2)
    vocab = pieces.vocabulary(model, 1.0)
    for i, t in enumerate(texts):
        assert rows[i] and all(r["round_trip"] and vocab.decode(np.array(r["ids"], np.int64)).decode() == t for r in rows[i])
    out = pieces.encoded(nasty, model)
    assert out.where("not round_trip").count() == 0 and pieces.encoded(empty, model).count() == 0
    back = pieces.decoded(out.select("doc_id", "sample", "ids"), model)
    want = Counter((r.doc_id, r.text or "") for r in nasty.collect())
    assert Counter((r.doc_id, r.text) for r in back.where("sample = 0").collect()) == want


def test_a_row_gives_the_same_samples_anywhere(model):
    texts = ["the onhe tion", "and thored ntly", "é ouvi"]
    one, other = encode(texts, [1, 2, 3], model, 2), encode(texts[::-1] + ["more"], [3, 2, 1, 4], model, 2)
    assert all([r["ids"] for r in one[k]] == [r["ids"] for r in other[k]] for k in (1, 2, 3))


def test_real_texts_give_the_same_bytes_alone_and_together(spark, sf_dir, model):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()][:1000]
    every = encode([t for _, t in rows], [d for d, _ in rows], model, 2)
    assert len(every) == 1000 and all(encode([t], [d], model, 2)[d] == every[d] for d, t in rows)
    back = encode([t for _, t in rows[::-3]], [d for d, _ in rows[::-3]], model, 2)
    assert all(back[d] == every[d] for d in back)
    assert all(r["log_inclusion"] > -math.inf and (r["inclusion"] > 0) == (r["log_inclusion"] > -745.2) for found in every.values() for r in found)
    alone = pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), model, alpha=1.0).collect()
    assert len(alone) == sum(map(len, every.values()))
    assert all(r.asDict() | {"key": r.doc_id} == next(x for x in every[r.doc_id] if x["sample"] == r.sample) | {"doc_id": r.doc_id} for r in alone)


def test_texts_that_do_not_come_back_are_encoded_again(model, monkeypatch):
    """Segments that share a hash are taken for each other in a run; such texts are encoded by themselves."""
    right = pieces.Store.slots

    def slots(self, vocab, chars, keys, starts, ends):
        first, sizes = right(self, vocab, chars, keys, starts, ends), ends - starts
        if len(keys) > 6:
            a, b = next((i, j) for i in range(len(keys)) for j in range(i) if sizes[i] == sizes[j])
            first[a] = first[b]
        return first

    texts = ["the onhe tion", "and thored ntly", "é ouvi", "plain words"]
    want = encode(texts, [1, 2, 3, 4], model, 2)
    monkeypatch.setattr(pieces.Store, "slots", slots)
    got = encode(texts, [1, 2, 3, 4], model, 2)
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for found in got.values() for r in found)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
