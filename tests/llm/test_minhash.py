import random
from collections import Counter

import numpy as np
import pyarrow as pa

from factorloom.llm import minhash, shingles
from factorloom.llm.common import text_bytes
from factorloom.llm.components import connected_components


def plain_shingles(text):
    words = (text or "").split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_similarity(a, b):
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def plain_classes(rows):
    parts = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0] or (rows[i][1] or "") == (rows[j][1] or "")
            if same or plain_similarity(parts[i], parts[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=70):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of an rain stone für éa of Quelle wind lake far cold sun".split()) + str(rng.randrange(40))
    rows = [(10 * i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 8, 60, 200])))) for i in range(n)]
    for k in range(40):
        words = rows[rng.randrange(6, 14)][1].split(" ")
        for _ in range(rng.randrange(0, max(2, len(words) // 40))):
            words[rng.randrange(len(words))] = word()
        rows.append((3 + 10 * k, rng.choice([" ", "\n"]).join(words)))
    line = " ".join(word() for _ in range(9))
    rows += [(5000, "\n".join([line] * 30)), (5001, "\n".join([line] * 31)), (5002, None), (5003, ""), (5004, " \n"), (5005, rows[3][1]), (40, rows[4][1]), (40, rows[4][1])]
    return rows


def test_shingles_and_similarity():
    rows = corpus(1)
    column = pa.array([t or "" for _, t in rows])
    text, shingle, weight = shingles.weighted_shingles(*text_bytes(column))
    at = np.searchsorted(text, np.arange(len(rows) + 1))
    plain = [plain_shingles(t) for _, t in rows]
    for k, want in enumerate(plain):
        assert sorted(weight[at[k] : at[k + 1]]) == sorted(want.values())
    rng = random.Random(2)
    for _ in range(400):
        i, j = rng.randrange(len(rows)), rng.randrange(len(rows))
        got = shingles.probability_jaccard(shingle[at[i] : at[i + 1]], weight[at[i] : at[i + 1]], shingle[at[j] : at[j + 1]], weight[at[j] : at[j + 1]])
        assert abs(got - plain_similarity(plain[i], plain[j])) < 1e-9


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    registers = 4000
    for _ in range(4):
        union = np.sort(rng.integers(0, 1 << 52, 30, dtype=np.uint64))
        wa, wb = rng.integers(0, 5, 30), rng.integers(0, 5, 30)
        a, b = union[wa > 0], union[wb > 0]
        text = np.repeat([0, 1], [len(a), len(b)])
        winner = shingles.prob_minhash(text, np.concatenate([a, b]), np.concatenate([wa[wa > 0], wb[wb > 0]]), 3, registers)
        exact = shingles.probability_jaccard(a, wa[wa > 0], b, wb[wb > 0])
        assert abs((winner[0] == winner[1]).mean() - exact) < 5 * np.sqrt(0.25 / registers)
        assert not winner[2].any()
        # arrivals are spread by weight
        share = Counter(winner[0].tolist())
        assert abs(share[int(a[0])] / registers - wa[wa > 0][0] / wa.sum()) < 0.05


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_against_brute_force(spark):
    rows = corpus(7)
    docs = spark.createDataFrame([(d, t, 0, b"x") for d, t in rows], "doc_id long, text string, bands int, n_bytes binary").repartition(3)
    want = plain_classes(rows)
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicate_classes(docs).collect())
    assert got == want
    small_blocks = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicate_classes(docs, block=3).collect())
    assert small_blocks == want
    assert sorted((r.doc_id, r.class_id) for r in minhash.near_duplicate_classes(docs, block_bytes=2000).collect()) == want
    kept = minhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in want}) and kept[0].bands == 0


def test_repeated_id_keeps_the_text_that_no_lesser_id_has(spark):
    one, two = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    docs = spark.createDataFrame([(3, one), (5, one), (5, two), (8, two), (9, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in minhash.keep_one(docs).collect()) == [(3, one), (5, two), (9, None)]


def test_large_groups_of_copies_and_a_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MANY_COPIES", 5)
    one, two = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = [(i, one) for i in range(40)] + [(100, f"{two} {i} {i * i} {i + 9} {i * 7} x{i}") for i in range(30)] + [(100, one)] * 3 + [(200 + i % 3, two) for i in range(12)]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, place int").repartition(4)
    got = sorted((r.doc_id, r.class_id, r.copy_of) for r in minhash.near_duplicate_classes(docs).collect())
    first = {}
    for d, t in rows:
        first[t] = min(d, first.get(t, d))
    assert [g[0] for g in got] == sorted(d for d, _ in rows) and sorted((g[0], g[2]) for g in got) == sorted((d, first[t]) for d, t in rows)
    kept = minhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == [0, 100, 200]


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, None), (1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(str, minhash.near_duplicate_classes(docs).select("doc_id", "class_id").collect())) == sorted(map(str, docs.sparkSession.createDataFrame([(None, None), (None, None), (1, 1), (2, 1)], "doc_id long, class_id long").collect()))
    assert minhash.near_duplicate_classes(docs.limit(0)).count() == 0
    assert minhash.keep_one(docs).count() == 3


def test_no_link_of_the_documents_is_lost(spark):
    """Recall over all pairs at the threshold in the whole smallest table, held against plain code."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(docs).collect()}
    assert sorted(got.items()) == plain_classes(rows)


def test_planted_near_copies_are_caught(spark):
    """Texts with some words replaced: those still at the threshold are caught, all of them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    rows, planted = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randrange(60, 400))]
        rows.append((2 * i, " ".join(words)))
        for _ in range(max(1, len(words) // rng.choice([60, 90, 150]))):
            words[rng.randrange(len(words))] = word()
        rows.append((2 * i + 1, " ".join(words)))
        if plain_similarity(plain_shingles(rows[-2][1]), plain_shingles(rows[-1][1])) >= 0.8:
            planted.append(i)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(planted) > 200 and all(got[2 * i + 1] == 2 * i for i in planted)
    assert sum(got[2 * i + 1] == 2 * i for i in range(300)) == len(planted)


def test_very_long_and_empty_texts(spark):
    rng = random.Random(12)
    words = [str(rng.randrange(10**6)) for _ in range(300_000)]
    long = " ".join(words)
    words[1000] = "other"
    rows = [(1, long), (2, " ".join(words)), (3, "x" * 3_000_000), (4, "\n" * 100_000), (5, ""), (6, None)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
