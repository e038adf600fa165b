"""Language identification and the quality classifier: held-out accuracy, and odd documents."""

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from odd import by_row, odd_docs, odd_rows

from commonloom.llm import lang_id, quality_gam

DATA = "/root/testdata/sf0.01"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = lang_id.op1(docs).collect()
    assert len(found) == len(truth)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert np.mean(right) > 0.97


def test_odd_documents_have_a_language(spark):
    rows = odd_rows()
    found = lang_id.op1(odd_docs(spark))
    assert found.count() == len(rows)
    lettered = {i: any(c.isalpha() for c in t or "") for i, t in rows}
    for r in found.collect():
        if r["doc_id"] is not None:
            assert (r["lang_pred"] != "und") == lettered[r["doc_id"]]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert lang_id.op1(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in lang_id.op1(unlabelled).collect()] == [("und", 0.0)]


def test_forward_sums_all_segmentations():
    vocabulary = lang_id.Vocabulary(["a", "ab", "abc", "b", "bc", "c", "▁a", "▁"])
    assert [int(x) for x in vocabulary.find(np.zeros(1, dtype=np.uint64))] == [-1]
    rng = np.random.default_rng(0)
    chance = np.append(rng.random(vocabulary.size + 1), 0)
    number = dict(zip(["a", "ab", "abc", "b", "bc", "c", "▁a", "▁"], range(1, 9), strict=True))
    words = ["abc", "aabcb", "zab"]
    got = np.zeros(len(words))
    for at, letters in lang_id._by_length(words):
        got[at] = np.exp(lang_id._forward(letters, vocabulary, chance[:, None])[:, 0])
    for w, g in zip(words, got, strict=True):
        text, total = "▁" + w, 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
            parts = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            p = 1.0
            for part in parts:
                p *= chance[number[part]] if part in number else (chance[0] if len(part) == 1 else 0.0)
            total += p
        assert g == pytest.approx(total)


def test_long_words_are_summed_whole(monkeypatch):
    """Against sums of exact fractions, without cuts or floors, whatever the block."""
    from fractions import Fraction

    names = ["a", "ab", "abcabcabcabc", "b", "bca", "c", "▁a", "▁"]
    vocabulary = lang_id.Vocabulary(names)
    rng = np.random.default_rng(3)
    chance = np.append(rng.random(vocabulary.size + 1) * 1e-5, 0)
    number = dict(zip(names, range(1, 9), strict=True))
    word = ("abc" * 40 + "zab") * 3
    text = "▁" + word
    sums = [Fraction(1)]
    for end in range(1, len(text) + 1):
        parts = [(k, text[end - k : end]) for k in range(1, min(12, end) + 1)]
        sums.append(sum(sums[end - k] * Fraction(chance[number[p] if p in number else 0]) for k, p in parts if p in number or k == 1))
    top = sums[-1]
    want = math.log(top.numerator) - math.log(top.denominator)
    for block in (5, 1024):
        monkeypatch.setattr(lang_id, "BLOCK", block)
        ((_, letters),) = lang_id._by_length([word])
        ahead = lang_id._forward(letters, vocabulary, chance[:, None], every=True)
        behind = lang_id._forward(letters, vocabulary, chance[:, None], every=True, back=True)
        assert lang_id._forward(letters, vocabulary, chance[:, None])[0, 0] == pytest.approx(want) == ahead[-1, 0, 0] == pytest.approx(behind[-1, 0, 0])


def test_expected_uses_add_up():
    """Brute force over all segmentations, weighted by their probability."""
    names = ["a", "ab", "abc", "b", "bc", "c", "▁a", "▁"]
    vocabulary = lang_id.Vocabulary(names)
    rng = np.random.default_rng(5)
    chance = np.append(rng.random(vocabulary.size + 1), 0)
    number, words, times = dict(zip(names, range(1, 9), strict=True)), ["abc", "aabcb", "zab"], np.array([2.0, 1.0, 5.0])
    want = np.zeros(len(chance))
    for w, t in zip(words, times, strict=True):
        text, uses, total = "▁" + w, np.zeros(len(chance)), 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
            parts = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            if all(p in number or len(p) == 1 for p in parts):
                found = [number.get(p, 0) for p in parts]
                p = np.prod(chance[found])
                total += p
                np.add.at(uses, found, p)
        want += t * uses / total
    assert lang_id._expect(words, times, vocabulary, chance[:, None]) == pytest.approx(want)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in quality_gam.op4(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in found.items())
    assert np.mean([found[i]["predicted"] == q for i, q in truth.items() if held(i)]) > 0.95


def test_quality_of_odd_documents(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(7, 1, 0), (14, 0, 0), (14, 0, 1), (None, 1, 0), (21, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_gam.score_quality(docs, quality_gam.learn(docs, labels))
    assert out.columns == [*docs.columns, "quality_score"]
    assert out.count() == len(odd_rows())
    none = quality_gam.op4(docs, labels.limit(0))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert quality_gam.op4(docs.limit(0), labels).count() == 0


def test_gam_learns_what_needs_a_pair():
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[3000:]) >= 0.5) == y[3000:]) > 0.9


def _gain(parts, grad, hess, ridge):
    return sum(sum(grad[k] for k in p) ** 2 / (sum(hess[k] for k in p) + ridge) for p in parts)


def test_trees_take_the_best_cuts():
    """Against trying all cuts one by one."""
    rng = np.random.default_rng(7)
    for bins in (1, 2, 3, 9):
        grad, hess = rng.normal(size=bins), rng.random(bins) + 0.1
        parts = [list(range(bins))]
        for _ in range(2):
            options = [[*parts[:p], part[:c], part[c:], *parts[p + 1 :]] for p, part in enumerate(parts) for c in range(1, len(part))]
            parts = max([parts, *options], key=lambda o: _gain(o, grad, hess, 1.0))  # no cut where none gains
        value, gain = quality_gam._tree(grad, hess, 3, 1.0)
        assert gain == pytest.approx(_gain(parts, grad, hess, 1.0) - _gain([range(bins)], grad, hess, 1.0))
        for p in parts:
            assert value[p] == pytest.approx(sum(grad[p]) / (sum(hess[p]) + 1.0))


def test_pairs_are_cut_best():
    rng = np.random.default_rng(8)
    for shape in ((2, 2), (3, 5), (6, 2)):
        grad, hess = rng.normal(size=shape), rng.random(shape) + 0.1
        cells = [(i, j) for i in range(shape[0]) for j in range(shape[1])]
        best = (-1.0, None)
        for a in range(1, shape[0]):
            for b in range(1, shape[1]):
                parts = [[c for c in cells if (c[0] >= a, c[1] >= b) == q] for q in itertools.product([False, True], repeat=2)]
                best = max(best, (_gain(parts, grad, hess, 1.0), parts), key=lambda x: x[0])
        value, gain = quality_gam._cross(grad, hess, 1.0)
        assert gain == pytest.approx(best[0] - _gain([cells], grad, hess, 1.0))
        for part in best[1]:
            want = sum(grad[c] for c in part) / (sum(hess[c] for c in part) + 1.0)
            assert all(value[c] == pytest.approx(want) for c in part)


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(9)
    x = np.round(rng.random((600, len(quality_gam.FEATURES))), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.7).astype(float)
    model = quality_gam.fit(x, y, rounds=8, pair_rounds=4)
    assert model.pairs
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        b = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total = model.start + sum(t[k] for t, k in zip(model.tables, b, strict=True))
        total += sum(t[b[i] // 4, b[j] // 4] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


def test_features_do_not_depend_on_neighbours():
    texts = [t for _, t in odd_rows() if t is None or len(t) < 5000]
    together = quality_gam.text_features(pa.array(texts, pa.string()))
    alone = np.concatenate([quality_gam.text_features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone)
    assert not together[0].any() or texts[0] is not None


def test_same_model_each_time(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    a, b = (by_row(quality_gam.op4(d, labels), "doc_id", "score") for d in (docs, docs.repartition(7)))
    assert {k[0]: k[1] for k in a} == pytest.approx({k[0]: k[1] for k in b})
