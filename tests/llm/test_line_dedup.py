import random
import uuid
from hashlib import blake2b, sha256

import numpy as np
import pytest

from factorloom.llm import line_dedup
from factorloom.llm.common import shared_checkpoint_dir
from factorloom.llm.cuckoo import CuckooFilter, pairs

WHITE = " \t\n\v\f\r"


def keyed(numbers):
    return pairs(b"".join(blake2b(str(i).encode(), digest_size=16).digest() for i in numbers))


def test_filter_finds_what_is_in_it_and_little_else():
    held = CuckooFilter.built(keyed(range(20_000)))
    assert held.contains(keyed(range(20_000))).all() and len(held) == 20_000
    assert held.contains(keyed(range(20_000, 120_000))).sum() == 0
    held.remove(keyed(range(0, 20_000, 2)))
    assert held.contains(keyed(range(1, 20_000, 2))).all() and not held.contains(keyed(range(0, 20_000, 2))).any()
    assert held.add(keyed(range(0, 20_000, 2))) and held.contains(keyed(range(20_000))).all()
    again = CuckooFilter.stored(held.raw())
    assert again.contains(keyed(range(20_000))).all()


def test_a_full_filter_says_so():
    held = CuckooFilter.sized(10)
    assert not held.add(keyed(range(100)))
    assert not CuckooFilter.built(keyed([])).contains(keyed(range(5))).any()


def test_exact_keys_with_equal_halves():
    keys = np.array([[1, 2], [1, 5], [1, 9], [3, 1]], np.uint64)
    held = line_dedup._Keys(keys[[2, 0, 3]].tobytes())
    assert held.contains(keys).tolist() == [True, False, True, True]


def plain(texts, min_docs, min_chars=1):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    count = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or count[key(x)] < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["Shared", "shared ", "\tSHARED\r", "é", "É", "", " ", "x", "footer \v", "Menü", " x", "😀"]
    texts = ["\n".join(rng.choice([*words, f"own {i} {j}"]) for j in range(rng.randrange(9))) for i in range(n)]
    return [*texts, None, "", "\n", "everywhere"] + ["everywhere\nand more"] * 40


def folder(spark):
    return f"{shared_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, n_lines string").repartition(5)


@pytest.mark.parametrize("exact_keys", [1000, 3, 1])
@pytest.mark.parametrize("filter_bytes", [1 << 20, 0])
def test_against_plain_counts(spark, exact_keys, filter_bytes, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", filter_bytes)
    texts = corpus(1)
    docs = table(spark, texts)
    store = line_dedup.LineStore(spark, folder(spark), min_docs=7, exact_keys=exact_keys)
    store.insert(docs)
    rows = {r.doc_id: (r.text, r[2], r.n_dropped) for r in store.deduplicate(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == plain(texts, 7)
    digests = line_dedup.dedup_digests(docs, folder(spark), min_docs=7, exact_keys=exact_keys).collect()
    assert {(r.doc_id, r.kept_sha256) for r in digests} == {(i, sha256(t[0].encode()).hexdigest()) for i, t in enumerate(plain(texts, 7))}


def test_insertions_and_deletions_are_reversible(spark):
    texts, more = corpus(2), corpus(3)
    first, second = table(spark, texts), table(spark, more)
    place = folder(spark)
    store = line_dedup.LineStore(spark, place, min_docs=7)
    store.insert(first)
    before = (sorted(map(tuple, store.counts().collect())), sorted((r.shard, r.n_keys) for r in store.filters().collect() if r.n_keys))
    store.insert(second)
    together = plain(texts + more, 7)
    rows = {r.doc_id: r.text for r in line_dedup.LineStore(spark, place, min_docs=7).deduplicate(first).collect()}
    assert [rows[i] for i in range(len(texts))] == [t for t, _, _ in together[: len(texts)]]
    store.delete(second)
    after = (sorted(map(tuple, store.counts().collect())), sorted((r.shard, r.n_keys) for r in store.filters().collect() if r.n_keys))
    assert after == before
    rows = {r.doc_id: r.text for r in store.deduplicate(first).collect()}
    assert [rows[i] for i in range(len(texts))] == [t for t, _, _ in plain(texts, 7)]
    with pytest.raises(ValueError, match="not inserted"):
        store.delete(spark.createDataFrame([(1, "never seen")], "doc_id long, text string"))
    assert sorted(map(tuple, store.counts().collect())) == before[0]
    store.revert()
    rows = {r.doc_id: r.text for r in store.deduplicate(second).collect()}
    assert [rows[i] for i in range(len(more))] == [t for t, _, _ in together[len(texts) :]]
    store.revert()
    store.revert()
    assert not store.counts().count() and {r.n_dropped for r in store.deduplicate(first).collect()} == {0}
    with pytest.raises(ValueError):
        store.revert()
    with pytest.raises(ValueError):
        line_dedup.LineStore(spark, place, min_docs=8)


def test_empty_tables_nulls_and_clashing_columns(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_digests(nothing, folder(spark)).count() == 0
    docs = spark.createDataFrame([(None, "a\nA \nb", 1)] * 3 + [(None, None, 2)], "doc_id long, text string, n_lines int")
    store = line_dedup.LineStore(spark, folder(spark), min_docs=3, min_chars=1)
    store.insert(docs)
    assert sorted(map(tuple, store.deduplicate(docs, carry=("n_lines", "text")).collect()), key=str) == [(None, "", 1, 0, 2, None)] + [(None, "", 3, 3, 1, "a\nA \nb")] * 3
    longer = line_dedup.LineStore(spark, folder(spark), min_docs=3, min_chars=2)
    longer.insert(docs)
    assert {r.n_dropped for r in longer.deduplicate(docs).collect()} == {0}


def test_very_long_texts(spark):
    texts = ["\n" * 500_000, "x" * 2_000_000, "😀\n" * 200_000] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_digests(docs, folder(spark), min_docs=3).collect()}
    assert [rows[i] for i in range(3)] == [(500_001, 0), (1, 1), (200_001, 200_000)]
