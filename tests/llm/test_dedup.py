"""Line, exact and substring dedup and the Jaccard join against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd import LOWER, WHITE, by_row, lower, odd_docs, odd_rows, removed_by_windows, sha, shingles
from pyspark.sql import functions as F

from commonloom.llm import bpe, common, exact_dedup, line_dedup, ngram_join, quality_rules, substring_dedup


def line_key(line):
    return line.strip(WHITE).encode().translate(LOWER).decode()


def expected_lines(rows):
    holders = defaultdict(set)
    ranked = [(-(2**63) if i is None else i, t) for i, t in rows]
    for i, t in ranked:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 40:
                holders[line_key(line)].add(i)
    out = []
    for (i, t), (rank, _) in zip(rows, ranked, strict=True):
        lines = (t or "").split("\n")
        left = [x for x in lines if len(line_key(x)) < 40 or len(holders[line_key(x)]) < 5 or rank == max(holders[line_key(x)])]
        out.append((i, len(lines), len(lines) - len(left), sha("\n".join(left))))
    return Counter(out)


@pytest.mark.parametrize(("small", "hot"), [(1_000_000, 100_000), (0, 100_000), (1, 3), (2, 3)])
def test_joins_give_what_plain_joins_give(spark, monkeypatch, small, hot):
    """Broadcast, by a bitmap of keys, and with hot keys apart."""
    monkeypatch.setattr(common, "SMALL", small)
    monkeypatch.setattr(common, "HOT", hot)
    large = spark.createDataFrame([(n % 7, n % 3, f"text {n}") for n in range(60)] + [(None, 1, "null")], "a long, b long, t string").repartition(4)
    keyed = common.checkpointed(large.where("a < 4 AND t < 'text 4'").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.max("t").alias("most")))
    on, rows = ["a", "b"], lambda df: by_row(df, "a", "b", "t")
    assert rows(common.semi_keyed(large, keyed, on)) == rows(large.join(keyed, on, "left_semi"))
    wide = keyed.select("a", "b", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    assert by_row(common.join_wide(large, wide, on), "t", "k") == by_row(large.join(wide, on), "t", "k")
    assert by_row(common.attach_keyed(large, keyed, on), "t", "most") == by_row(large.join(keyed, on, "left"), "t", "most")
    assert by_row(common.mark_keyed(large, keyed, on), "t", "most") == by_row(large.join(keyed, on, "left"), "t", "most")
    for how in ("inner", "left"):
        for wide in (False, True):
            out = common.join_hot(large, keyed, on, "times", how, wide)
            assert "times" not in out.columns
            assert by_row(out, "t", "most") == by_row(large.join(keyed, on, how), "t", "most")


def test_only_texts_with_a_partner_are_shuffled(spark, monkeypatch):
    """The rows without one pass in the stage that reads them."""
    docs = odd_docs(spark)
    rows = docs.select(*common.row_key("doc_id", "text"), F.col("text").alias("_text"))
    keyed = common.checkpointed(rows.where("_text LIKE 'spam%'").select("_k1", "_k2", F.lit(1).alias("x")))
    for small in (0, 1_000_000):
        monkeypatch.setattr(common, "SMALL", small)
        alone = common.attach_keyed(rows, keyed, ["_k1", "_k2"]).where("x IS NULL")
        plan = alone._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Union") == 1
    assert common.semi_keyed(rows, keyed, ["_k1", "_k2"]).count() == keyed.count()
    assert common._may_have(rows, keyed, ["_k1", "_k2"]).where("_may").count() <= keyed.count() + 2


def test_empty_tables(spark):
    docs = odd_docs(spark).limit(0)
    for op in (ngram_join.op2, line_dedup.op5, exact_dedup.op6, bpe.op7, substring_dedup.op8, quality_rules.op10):
        out = op(docs)
        assert out.count() == 0 and "doc_id" in out.columns


def test_tables_without_anything_to_find(spark):
    """Nulls, empty texts and texts that share nothing."""
    rows = [(1, None), (2, ""), (3, "alone here"), (None, None), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(ngram_join.op2(docs), "doc_id", "component_id") == Counter([(1, 1), (2, 2), (3, 3), (None, None), (None, None)])
    assert {r["n_dropped"] for r in line_dedup.op5(docs).collect()} == {0} == {r["n_removed"] for r in substring_dedup.op8(docs).collect()}
    assert sorted(r["group_size"] for r in exact_dedup.op6(docs).collect()) == [1, 1, 3, 3, 3]


@pytest.mark.parametrize("small", [0, common.SMALL])
def test_line_dedup(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL", small)
    got = by_row(line_dedup.op5(odd_docs(spark)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == expected_lines(odd_rows())
    assert any(r[2] for r in got)


def test_line_dedup_keeps_all_columns_and_stays_native(spark):
    docs = odd_docs(spark)
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped", "keep_words", "kept_text"]
    plan = line_dedup.op5(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_keep_bitmaps_of_long_documents(spark):
    common_line = "this line is in very many of the documents here"
    texts = ["\n".join(common_line if (n + d) % 3 == 0 else f"own {d} {n}" for n in range(200)) for d in range(6)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(line_dedup.op5(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == expected_lines(rows)
    assert max(len(r["keep_words"] or {}) for r in line_dedup.line_bitmaps(docs).collect()) == 4


@pytest.mark.parametrize("small", [0, common.SMALL])
def test_exact_dedup(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL", small)
    rows = odd_rows()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = Counter()
    for i, t in rows:
        ids = groups[lower(t)]
        best = max((x for x in ids if x is not None), default=None)
        want[i, best, len(ids), i == best, sha(lower(t))] += 1
    assert by_row(exact_dedup.op6(odd_docs(spark)), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_golomb_codes():
    rng = np.random.default_rng(3)
    for n in (1, 2, 500):
        for span in (n, 10 * n, 1 << 47):
            values = np.unique(rng.integers(0, span + 1, n)) + 1234
            k, unary, rest = exact_dedup.golomb_encode(values, 1234)
            assert (exact_dedup.golomb_decode(len(values), k, unary, rest, 1234) == values).all()
    values = np.sort(rng.choice(1 << 40, 5000, replace=False))
    k, unary, rest = exact_dedup.golomb_encode(values, 0)
    assert len(unary) + len(rest) < 5000 * 4


def expected_groups(rows, percent=90, n=3):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t, n))
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                a0, b0 = top(a), top(b)
                parent[max(a0, b0)] = min(a0, b0)
    return Counter((i, len(shingles(t, n)), None if i is None else top(i)) for i, t in rows)


def test_jaccard_groups(spark):
    got = by_row(ngram_join.op2(odd_docs(spark)), "doc_id", "n_shingles", "component_id")
    assert got == expected_groups(odd_rows())
    assert any(i != c for i, _, c in got if i is not None)
    got = by_row(ngram_join.jaccard_groups(odd_docs(spark)), "doc_id", "n_shingles", "component_id")
    assert got == expected_groups(odd_rows(), 80, 5)


@pytest.mark.parametrize(("tile", "percent"), [(8, 90), (4096, 90), (4096, 80)])
def test_jaccard_groups_of_many_near_copies(spark, monkeypatch, tile, percent):
    """A large group around the threshold, in one tile and in many."""
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((i * 3, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(4, 25)))) for i in range(60)]
    monkeypatch.setattr(ngram_join, "TILE", tile)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert by_row(ngram_join.jaccard_groups(docs, percent, 3), "doc_id", "n_shingles", "component_id") == expected_groups(rows, percent)
    with pytest.raises(ValueError):
        ngram_join.jaccard_groups(docs, percent=40)


@pytest.mark.parametrize(("gathered", "hot"), [(8, 100_000), (8, 20), (4096, 20)])
def test_jaccard_groups_of_hot_blocks(spark, monkeypatch, gathered, hot):
    """Blocks with many rows, gathered in pieces and dealt by broadcast; with copies, repeated ids and sets on the threshold."""
    import random

    rng = random.Random(9)
    base = [f"w{n}" for n in range(60)]
    rows = [(i, " ".join([*base[: rng.randrange(50, 61)], *(f"y{rng.randrange(4)}" for _ in range(rng.randrange(4)))])) for i in range(70)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(30)] + [(5, "another text of the same document, and quite another one")]
    monkeypatch.setattr(ngram_join, "GATHERED", gathered)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert by_row(ngram_join.jaccard_groups(docs, 90, 3), "doc_id", "n_shingles", "component_id") == expected_groups(rows, 90)


def test_bounds_lose_no_pair():
    """Similar sets always share a block, and the bound never rules them out."""
    rng = np.random.default_rng(1)
    for n, percent in [(n, p) for n in (3, 5, 9, 10, 11, 15, 16, 23, 40, 300) for p in (80, 90)]:
        for _ in range(40):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            most = n * (100 - percent) // percent
            grow = int(rng.integers(0, most + 1))
            drop = int(rng.integers(0, max(1, most - grow + 1)))
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, grow).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if (100 + percent) * both < percent * (len(a) + len(b)) or (len(a) == len(b) == both):
                continue
            value, doc = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            sizes = np.array([len(a), len(b)])
            order = np.lexsort((value, doc))
            value = value[order]
            often = np.sort(rng.choice(value, len(value) // 2, replace=False))
            for known, level in ((often[:0], often[:0]), (often, rng.integers(1, 4, len(often)))):
                any_size, larger, _ = ngram_join.leading(value, doc, sizes, percent, known, level)
                small, large = np.argsort(sizes, kind="stable").tolist()
                assert set(value[larger & (doc == small)].tolist()) & set(value[any_size & (doc == large)].tolist())
            node, raw = np.array([7, 3]), ngram_join.points_of(value, doc, sizes)
            counts = ngram_join.same_length(raw, sizes)
            assert counts.sum(axis=1).tolist() == sizes.tolist()
            assert [len(x) for x in ngram_join.leaf_pairs(raw, sizes, node, np.array([2]), percent)] == [1, 1]
            for side in (None, np.array([1, 2])):
                assert ngram_join.connected(ngram_join.Points(counts, sizes, percent, node, side), node) == ([7], [3])
            assert ngram_join.connected(ngram_join.Points(counts, sizes, percent, np.array([1, 1]), None), node) == ([], [])
            assert ngram_join.connected(ngram_join.Points(counts, sizes, percent, node, np.array([1, 1])), node) == ([], [])


@pytest.mark.parametrize("sided", [False, True])
def test_tree_connects_what_brute_force_does(sided):
    """Groups around the threshold in one unit, with repeats among the groups' counts; on exact sets and on coarse points."""
    rng = np.random.default_rng(11)
    for round_ in range(12):
        bases = [rng.integers(0, 2**63, int(rng.integers(10, 80))).astype(np.uint64) * np.uint64(2) for _ in range(4)]
        sets = []
        for _ in range(int(rng.integers(2, 150))):
            base = bases[rng.integers(4)]
            stay = rng.random(len(base)) > rng.random() * 0.3
            stay[0] = True
            sets.append(np.unique(np.concatenate([base[stay], rng.integers(0, 2**63, int(rng.integers(0, 5))).astype(np.uint64)])))
        node = rng.permutation(len(sets)) + 5
        side = rng.integers(1, 3, len(sets)) if sided else np.zeros(len(sets), dtype=int)
        parent = {int(x): int(x) for x in node}

        def top(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        n = np.array([len(x) for x in sets])
        raw = ngram_join.points_of(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), n)
        counts = ngram_join.same_length(raw, n)
        trees = ngram_join.Sets(sets, 90, node, side if sided else None), ngram_join.Points(counts, n, 90, node, side if sided else None)
        for whole, tree in zip((True, False), trees, strict=True):
            for i, a in enumerate(sets):
                for j in range(i):
                    both = len(np.intersect1d(a, sets[j])) if whole else np.minimum(counts[i], counts[j]).sum()
                    if not (sided and side[i] == side[j]) and 190 * both >= 90 * (len(a) + len(sets[j])):
                        x, y = top(int(node[i])), top(int(node[j]))
                        parent[max(x, y)] = min(x, y)
            left, right = ngram_join.connected(tree, node)
            assert dict(zip(left, right, strict=True)) == {x: top(x) for x in parent if top(x) != x}, round_


def test_shingles_of_many_words_have_places():
    """The same words in another order are another shingle, also beyond the eighth."""
    a, b = "a b c d e f g h i", "i b c d e f g h a"
    value, doc, n = ngram_join.shingle_sets(pa.array([a, b, a.upper()]), 9)
    assert n.tolist() == [1, 1, 1] and value[0] != value[1] and value[0] == value[2]


def test_many_alike_but_unlinked_texts(spark, monkeypatch):
    """A template's shingles come last in the order, so that texts that share no more than it never meet."""
    template = [f"t{n}" for n in range(34)]
    rows = [(i, " ".join([*template, *(f"o{i}x{n}" for n in range(5))])) for i in range(20_000)]
    rows += [(50_000 + i, rows[i * 7][1].upper()) for i in range(50)] + [(60_000, rows[3][1] + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    searched = []
    monkeypatch.setattr(ngram_join, "_verified", lambda source, classes, *rest, real=ngram_join._verified: searched.append(classes.count()) or real(source, classes, *rest))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_groups(docs, 80, 3).collect()}
    assert {i: c for i, c in got.items() if i != c} == {50_000 + i: i * 7 for i in range(50)} | {60_000: 3}
    assert searched == [1]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (21, 20), (30, 30)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(tuple(r) for r in common.components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {2: 1, 3: 1, 6: 5, 7: 5, 8: 5, 9: 5, 21: 20} | {101 + i: 100 for i in range(40)}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_substring_dedup(spark, monkeypatch, small):
    """With the ways of joining for few and for many keys."""
    monkeypatch.setattr(common, "SMALL", small)
    rows = odd_rows()
    want = Counter()
    for (i, _), (w, gone) in zip(rows, removed_by_windows([t for _, t in rows]), strict=True):
        want[i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    got = by_row(substring_dedup.op8(odd_docs(spark)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == want
    assert any(r[2] for r in got)


@pytest.mark.parametrize("window", [3, 5, 16])
def test_substring_dedup_of_short_windows(spark, window):
    import random

    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(6)] + [(50, "a b " * 90)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=window)
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in out.collect()}
    for (i, _), (w, gone) in zip(rows, removed_by_windows([t for _, t in rows], window), strict=True):
        assert got[i] == (sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))


@pytest.mark.parametrize("small", [0, common.SMALL])
def test_substring_dedup_of_a_phrase_in_many_documents(spark, monkeypatch, small):
    """No phrase brings more than a bounded number of distinct passages to a shard, and the results stay the same."""
    monkeypatch.setattr(common, "SMALL", small)
    monkeypatch.setattr(substring_dedup, "CROWD", 10)
    line = " ".join(f"line{n}" for n in range(20))
    rows = [(i, " ".join([*(f"a{i}x{n}" for n in range(20)), line, *(f"b{i}x{n}" for n in range(20))])) for i in range(80)]
    rows += [(i, " ".join([*(f"c{i // 2}x{n}" for n in range(12 + i % 2)), line, *(f"d{i // 2}x{n}" for n in range(9))])) for i in range(200, 220)]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (None, rows[3][1]), (301, None), (302, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter()
    for (i, _), (w, gone) in zip(rows, removed_by_windows([t for _, t in rows]), strict=True):
        want[i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    assert by_row(substring_dedup.op8(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    source = docs.select(*common.row_key("doc_id", "text"), F.col("text").alias("_text")).where("_text IS NOT NULL")
    places, copied = substring_dedup.filed_passages(source, 35)
    assert copied.groupBy("_phrase").agg(F.countDistinct("_hash").alias("n")).agg(F.max("n")).first()[0] <= 10
    assert places.count() >= copied.count() > 0


def test_substring_dedup_keeps_all_columns(spark):
    docs = odd_docs(spark)
    out = substring_dedup.substring_dedup(docs)
    assert out.columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    assert by_row(out, *(F.col(f"`{c}`") for c in docs.columns)) == by_row(docs, *(F.col(f"`{c}`") for c in docs.columns))
