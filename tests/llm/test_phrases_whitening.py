"""op12 and op13 against brute force."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import phrases, whitening, words

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_pieces(text):
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
        yield re.findall("[^ \t]+", piece)


def plain_collocations(rows, support, top):
    """rows of (text, lang); the contract, read literally."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for ws in plain_pieces(text):
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    dropped = set()
    for (lang, ws), a in candidates.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                if 100 * a >= 80 * f[lang, ws[i : i + k]]:
                    dropped.add((lang, ws[i : i + k]))
    scored = []
    for (lang, ws), a in candidates.items():
        if (lang, ws) not in dropped:
            score, _, l, r = min((2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
            scored.append((lang, -score, -a, " ".join(ws).encode(), l, r))
    out, rank = set(), Counter()
    for lang, score, a, phrase, l, r in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= top:
            out.add((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


def made_up(seed, texts=300):
    rng = random.Random(seed)
    words = ["the", "of", "The", "naïve", "日本", "a", "b", "c", "Ä", "ä", "x" * 40] + [f"w{i}" for i in range(30)]
    fixed = ["alpha beta gamma delta epsilon", "red green blue", "to be or not", "x x x x x"]
    rows = []
    for _ in range(texts):
        parts = [rng.choice(fixed) if rng.random() < 0.15 else rng.choice(words) for _ in range(rng.randrange(40))]
        text = "".join(p + rng.choice([" "] * 8 + [", ", ".", "\n", "\t", "  ", ";\r", "\xa0"]) for p in parts)
        rows.append((text, rng.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", None), (" .,;", "xx"), *[("Bee bop. bee bop", "en")] * 4]


@pytest.mark.parametrize("support, top", [(2, 50), (5, 2000)])
def test_collocations_equal_brute_force(spark, support, top):
    rows = made_up(support)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, phrase string, n long").repartition(5)
    got = {tuple(r) for r in phrases.collocations(docs, support, top).collect()}
    assert got == plain_collocations(rows, support, top) and got


def test_collocations_of_edge_cases(spark, nasty, empty):
    assert phrases.collocations(empty).count() == 0
    rows = [(r["text"], r["lang"]) for r in nasty.collect()]
    assert {tuple(r) for r in phrases.collocations(nasty).collect()} == plain_collocations(rows, 30, 2000)
    assert phrases.collocations(nasty).dtypes == [(c, "string" if c in ("lang", "phrase") else "bigint") for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]


def test_words_over_the_borders_of_steps_and_texts(monkeypatch):
    texts = ["Ab cd", "ef", "", "gh. ij\tkl" + "m" * 500 + " x", " ", "end"]
    whole = words.Words(*_bytes(texts))
    monkeypatch.setattr(words, "STEP", 7)
    stepped = words.Words(*_bytes(texts))
    assert (whole.hashes == stepped.hashes).all()
    want = [w for t in texts for p in plain_pieces(t) for w in p]
    assert whole.strings().to_pylist() == want and len(set(whole.hashes.tolist())) == len(want)
    assert whole.beside().tolist() == [True, False, False, False, True, True, False, False]
    # The same word has the same hash wherever it stands, and another one in another language.
    again = words.Words(*_bytes(["zz ab", "ab"]))
    assert again.hashes[1] == again.hashes[2] == whole.hashes[0]
    assert words.Words(*_bytes(["ab"], seed=5)).hashes[0] != whole.hashes[0]


def _bytes(texts, seed=0):
    parts = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), offsets, np.full(len(texts), seed, np.uint64), phrases._KIND


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_growth_does_not_depend_on_the_runs(size):
    rng = random.Random(size)
    rows = Counter(("en", *(list(rng.choices("abc", k=k)) + [None] * (4 - k))) for k in rng.choices([1, 2, 3, 4], k=600))
    rows = sorted(rows.items(), key=lambda r: [x or "" for x in r[0]])
    schema = pa.schema([("lang", pa.string()), *((c, pa.string()) for c in phrases.COLUMNS), ("n", pa.int64())])
    found = Counter()
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        table = pa.table([*([k[i] for k, _ in part] for i in range(5)), [n for _, n in part]], schema=schema)
        for r in phrases._patterns(table, 8).to_pylist():
            found[r["lang"], r["phrase"]] += r["f"]
    want = Counter()
    for (lang, *ws), n in rows:
        for k in range(1, 5):
            if ws[k - 1]:
                want[lang, " ".join(ws[:k])] += n
    assert {k: v for k, v in found.items() if v >= 8} == {k: v for k, v in want.items() if v >= 8}


VECTORS = "vec_id long, embedding array<float>, n string, component string"


def checked_whitening(spark, vectors):
    rows = spark.createDataFrame([(i, v, "clash", "clash") for i, v in enumerate(vectors)], VECTORS)
    got = whitening.whiten(rows)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return got.toPandas()


def plain_whitening(vectors):
    """n, exact deviations by row, variances in falling order and unit eigenvectors."""
    fine = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    size = max(map(len, fine.values()))
    fine = {i: v + (0,) * (size - len(v)) for i, v in fine.items()}
    distinct = sorted(set(fine.values()))
    n, sums = len(distinct), [sum(column) for column in zip(*distinct, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in distinct])
    variances, axes = np.linalg.eigh(centred.T @ centred / n)
    deviations = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in fine.items()}
    rows = {i: np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)]) for i, v in fine.items()}
    return n, deviations, rows, variances[::-1], axes[:, ::-1]


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(6, 6))
    vectors = [[float(c) for c in row] for row in rng.normal(size=(400, 6)) @ mixing + 1000]
    vectors += [None, [], [1.0, None, 2.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] * 6, vectors[0], vectors[0], [-0.0] * 6, [0.0] * 6, [5.5, 1.25]]
    got = checked_whitening(spark, vectors)
    n, deviations, rows, variances, axes = plain_whitening(vectors)
    assert sorted(got.vec_id.unique()) == sorted(rows) and len(got) == 4 * len(rows) and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    for k in range(4):
        own = got[got.component == k + 1].set_index("vec_id")
        assert {i: int(d) for i, d in own.deviation.items()} == deviations == {i: int(d) for i, d in own.deviation_digits.items()}
        want = np.array([rows[i] @ axes[:, k] / math.sqrt(variances[k]) for i in own.index])
        assert min(abs(want - own.whitened).max(), abs(want + own.whitened).max()) < 1e-8
        assert own.explained.iloc[0] == pytest.approx(variances[k] / variances.sum(), rel=1e-9)


def test_whitening_of_edge_cases(spark):
    assert not len(checked_whitening(spark, []))
    assert not len(checked_whitening(spark, [None, [], [None]]))
    one = checked_whitening(spark, [[1.0, 2.0], [1.0, 2.0]])
    assert len(one) == 4 and set(one.whitened) == {0.0} and set(one.deviation) == {0} and set(one.explained) == {0.0} and set(one.identity_error) == {0.0}
    flat = checked_whitening(spark, [[float(i), 3.0, 2.0 * i] for i in range(10)])
    assert flat.identity_error.max() < 1e-9 and (flat[flat.component > 1].whitened == 0).all()
    assert flat[flat.component == 1].explained.iloc[0] == pytest.approx(1.0)
    huge = checked_whitening(spark, [[3e30, 1.0], [1.0, -3e30], [2.0, 5.0]])
    assert huge.deviation.isna().all() and huge.deviation_digits.str.fullmatch(r"\d{30,}").all()


def test_whitening_keeps_null_and_large_keys(spark):
    rows = spark.createDataFrame([(None, [1.0, 2.0]), ((1 << 60) + 1, [2.0, 1.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")
    assert sorted({r["vec_id"] or 0 for r in whitening.whiten(rows).collect()}) == [0, 3, (1 << 60) + 1]
