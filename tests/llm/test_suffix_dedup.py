import hashlib
import random

import pytest

from factorloom.llm.suffix_dedup import remove_repeats, repeat_digests
from factorloom.llm.suffix_groups import lyndon_groups, suffix_array


def test_suffix_array_against_sorting():
    rng = random.Random(3)
    for _ in range(1500):
        text = [rng.randrange(rng.randrange(1, 6)) for _ in range(rng.randrange(0, 45))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array([7] * 5000) == list(range(4999, -1, -1))


def test_groups_are_longest_lyndon_prefixes():
    rng = random.Random(4)
    for _ in range(300):
        text = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 25))] + [0]
        _, group, descending = lyndon_groups(text)

        def lyndon(i, text=text):
            best = [text[i]]
            for j in range(i + 1, len(text) + 1):
                w = text[i:j]
                if all(w < w[k:] for k in range(1, len(w))):
                    best = w
            return best

        words = [lyndon(g[0]) for g in descending]
        assert words == sorted(words, reverse=True)
        assert all(lyndon(i) == w for g, w in zip(descending, words, strict=True) for i in g)
        assert len(set(group)) == len(descending)


def brute(rows, length=100, turn=None):
    """Every string of every text, in order, by hash set."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, turn[rows[i][1] or ""] if turn else 0, (rows[i][1] or "").encode()))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = [True] * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((rows[i][0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "an", "für", "éa", "stone", "river", "x", "Quelle", "de", "wandering"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(n))
    passages = [prose(rng.randrange(10, 80)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(1, 60)) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            cut = rng.randrange(0, len(p) // 2)
            parts.insert(rng.randrange(len(parts) + 1), p[cut:] if rng.random() < 0.5 else p)
        rows.append((i * 3, " ".join(parts)))
    near = rows[5][1].split(" ")
    for k in range(8):
        near[rng.randrange(len(near))] = "edit"
        rows.append((1000 + k, " ".join(near)))
    rows += [(7, rows[2][1]), (7, rows[2][1]), (1, None), (2, ""), (4, "short"), (5, "short"), (None, rows[9][1])]
    rows += [(2000, "ab" * 400), (2001, "ba" * 300), (2002, "a" * 99), (2003, "a" * 100), (2004, "a" * 350), (2005, "De " * 200), (2006, "é" * 150)]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 1 << 20), (2, 2)])
def test_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, block int, payload string").repartition(5)
    got = sorted((tuple(r) for r in repeat_digests(docs, hot=hot, blocks=7, shards=5).collect()), key=str)
    assert got == brute(rows)


def test_texts_and_carried_columns(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    out = remove_repeats(docs, carry=("lang",), blocks=3, shards=3).collect()
    assert len(out) == len(rows) and {r.lang for r in out} == {"en"}
    want = {(d, n) for d, _, n, _, _ in brute(rows)}
    assert {(r.doc_id, r.n_removed) for r in out} == want
    assert repeat_digests(docs.limit(0), blocks=2, shards=2).count() == 0


def test_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r) for r in repeat_digests(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("hot", [1 << 13, 3])
def test_null_and_repeated_ids_are_dealt_over_blocks(spark, hot):
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else d, t) for i, (d, t) in enumerate(corpus(8))]
    docs = spark.createDataFrame([(i, t, 3, 4) for i, t in rows], "doc_id long, text string, turn int, block int").repartition(5)
    turn = {r[0]: r[1] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "shiftrightunsigned(xxhash64(t), 33)").collect()}
    want = brute(rows, turn=turn)
    assert sorted((tuple(r) for r in repeat_digests(docs, hot=hot, blocks=7, shards=5).collect()), key=str) == want
    out = remove_repeats(docs, carry=("turn", "block"), hot=hot, blocks=7, shards=5).collect()
    assert sorted(str((r.doc_id, r.n_removed)) for r in out) == sorted(str((d, n)) for d, _, n, _, _ in want) and {(r.turn, r.block) for r in out} == {(3, 4)}


def test_one_anchor_with_very_many_contexts(spark):
    """Contexts of one gram, more than are sorted together, a few of them equal."""
    import numpy as np

    from factorloom.llm import suffix_dedup

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    sea = "".join(rng.choice(letters) for _ in range(400_000))
    at = int(np.argmin(suffix_dedup.gram_hashes(sea.encode()) >> np.uint64(20)))
    gram = sea[at : at + 32]
    side = lambda: "".join(rng.choice(letters) for _ in range(60))
    rows = [(i, side() + gram + side()) for i in range(12_000)]
    rows += [(20_000 + i, "x" + rows[rng.randrange(9000)][1][1:]) for i in range(40)] + [(30_000 + i, rows[50][1]) for i in range(20)]
    assert len(rows) > suffix_dedup.HOT
    got = sorted((tuple(r) for r in repeat_digests(spark.createDataFrame(rows, "doc_id long, text string"), blocks=3, shards=2).collect()), key=str)
    assert got == brute(rows)


def test_very_long_texts(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, long), (2, long[1_000_000:1_500_000]), (3, "é" * 400_000)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (0, 0) and got[2] == (500_000, 1) and got[3][0] == 800_000 - 2 and got[3][1] == 1
