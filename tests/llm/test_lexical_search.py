import math
import random
import re

import numpy as np
import pytest

from factorloom.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=10):
    split = [(i, plain_terms(t)) for i, t in docs]
    split = [(i, ts) for i, ts in split if ts]
    n_docs, total = len(split), sum(len(ts) for _, ts in split)
    out = {}
    for item, text in items:
        scores = []
        wanted = set(plain_terms(text))
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in ts for _, ts in split) + 1))) for t in wanted}
        for i, ts in split:
            m = 10 + (90 * len(ts) * n_docs) // total
            score = sum(weights[t] * (10**9 * ts.count(t) // (1000 * ts.count(t) + 8 * m)) for t in wanted)
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out[item] = [(r + 1, i if given else None, -s) for r, (s, given, i) in enumerate(sorted(scores)[:top])]
    return {k: v for k, v in out.items() if v}


def found(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Ünï", "ünï", "x_y", "A1", " b", "ﬁ", "漢字"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)] + [(None, docs[3][1]), (None, None), (7, "..."), (7, docs[5][1])]
    items = [(i, ", ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(25)] + [(90, None), (91, "!"), (92, docs[3][1]), (93, "unheard")]
    return docs, items


@pytest.mark.parametrize("step,cells", [(1, 1 << 20), (32, 2000), (5, 1)])
def test_against_plain_scores(spark, monkeypatch, step, cells):
    monkeypatch.setattr(ls, "BLOCK_CELLS", cells)
    docs, items = corpus(step)
    made = ls.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"), step=step)
    assert found(made) == plain(docs, items)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ls, "ITEM_BYTES", 60)
    docs, items = corpus(9)
    made = ls.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:6] + items[:2], "item_id long, text string"))
    assert found(made) == plain(docs, items[:6])


def test_the_search_stops_before_it_has_seen_all():
    rng = np.random.default_rng(0)
    n = 5000
    impact = np.sort(rng.pareto(1.0, size=(n, 2)) * 1000, axis=0)[::-1].astype(np.int64) + 1
    document = np.repeat(np.arange(n), 2)
    block = ls.Block(np.arange(n), np.zeros(n, bool), document, np.tile([0, 1], n), impact.reshape(-1), 2)
    best = ls.Best(10)
    assert block.search(np.array([0, 1]), best, step=1) < 50
    assert best.ids.tolist() == list(range(10)) and best.scores.tolist() == impact.sum(axis=1)[:10].tolist()


def test_ties_at_the_threshold_are_all_seen():
    n = 100
    block = ls.Block(np.arange(n)[::-1].copy(), np.zeros(n, bool), np.arange(n), np.zeros(n, int), np.full(n, 7), 1)
    best = ls.Best(10)
    assert block.search(np.array([0]), best, step=1) == n and best.ids.tolist() == list(range(10))


def test_empty_tables_extra_columns_and_long_texts(spark):
    items = spark.createDataFrame([(1, "needle", 5)], "item_id long, text string, score int")
    docs = spark.createDataFrame([(1, "hay " * 500_000 + "needle", 1), (2, "x" * 2_000_000, 2), (3, "Needle", 3)], "doc_id long, text string, rank int")
    assert found(ls.search(docs, items)) == plain([(r.doc_id, r.text) for r in docs.collect()], [(1, "needle")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (spark.createDataFrame([(1, None)], "doc_id long, text string"), items)):
        empty = ls.search(d, i)
        assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
