import random

import pytest
from pyspark.sql import functions as F

from factorloom.llm import packing, token_counts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def check(rows, capacities):
    bins, docs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        if r.length:
            bins.setdefault(r.bin, []).append(r)
        else:
            assert r.bin is None and r.bin_offset is None
    for parts in bins.values():
        parts.sort(key=lambda r: r.bin_offset)
        end = 0
        for r in parts:
            assert r.bin_offset == end
            end += r.length
        assert {r.capacity for r in parts} == {min(c for c in capacities if c >= end)} and {r.bin_used for r in parts} == {end}
    return bins, docs


def plain_best_fit(lengths, capacities, overhead, attention):
    """The same rule with linear searches."""
    bins, out = [], []
    for i, n in enumerate(lengths):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0], b[1]))
        else:
            offered = sum(b[0] for b in bins)

            def per_token(c):
                filling = max(0, sum(x for x in lengths[i + 1 :] if x <= c - n) - offered)
                return (c + c * c / attention + overhead) / (n + min(c - n, filling)), c

            b = [min((c for c in capacities if c >= n), key=per_token), len(bins), 0]
            bins.append(b)
        out.append((b[1], b[2]))
        b[0] -= n
        b[2] += n
    return out, [min(c for c in capacities if c >= b[2]) for b in bins]


@pytest.mark.parametrize("overhead", [0, 64, 5000])
def test_against_plain_best_fit(overhead):
    rng = random.Random(overhead)
    for _ in range(60):
        lengths = sorted((rng.randrange(1, 1001) for _ in range(rng.randrange(1, 60))), reverse=True)
        at, offset, final = packing.pack(lengths, (100, 300, 1000), overhead, 3000)
        assert (list(zip(at, offset, strict=True)), final) == plain_best_fit(lengths, (100, 300, 1000), overhead, 3000)


def test_several_lengths_cost_less_than_any_one_that_holds_the_longest_piece():
    rng = random.Random(1)
    lengths = sorted((min(16384, int(rng.lognormvariate(6, 1.5)) + 1) for _ in range(5000)), reverse=True)
    final = packing.pack(lengths, packing.CAPACITIES)[2]
    assert sum(final) < 1.02 * sum(lengths) and len(set(final)) == 4
    total = sum(map(packing.cost, final))
    for smaller in (2048, 4096, 8192):
        assert total < sum(map(packing.cost, packing.pack(lengths, (smaller, 16384))[2]))
    assert total < 0.92 * sum(map(packing.cost, packing.pack(lengths, (16384,))[2]))


def token_lengths(texts):
    encoder = token_counts.make_encoder(token_counts.read_vocabulary(VOCABULARY))
    return [len(token_counts.encode(encoder, t or "")) for t in texts]


def test_columns(spark):
    rng = random.Random(2)
    rows = [(i, "é ok" * rng.randrange(0, 100), "s") for i in range(200)] + [(500, None, "s"), (None, "abc", "s"), (3, "dup", "s"), (3, "dup", "s"), (600, "x1 " * 5000, "s"), (None, " " * 1_000_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin string").repartition(3)
    sizes = (100, 250, 400)
    out = packing.best_fit_packing(docs, VOCABULARY, sizes).collect()
    _, by = check(out, sizes)
    want = {}
    for (d, _, _), n in zip(rows, token_lengths([t for _, t, _ in rows]), strict=True):
        want[d] = want.get(d, 0) + n
    assert {d: sum(r.length for r in parts) for d, parts in by.items()} == want
    assert sorted(r.start for r in by[600]) == list(range(0, want[600], 400))
    assert packing.best_fit_packing(docs.limit(0), VOCABULARY, sizes).count() == 0
    with pytest.raises(ValueError):
        packing.best_fit_packing(docs, VOCABULARY, ())


def test_shards_are_counted_and_bins_dont_depend_on_storage(spark):
    """One repeated row and one repeated id, each a third of the rows, are dealt over the shards."""
    rows = [(None, 5, 40)] * 300 + [(7, i, 30) for i in range(300)] + [(i, i, 1 + i % 90) for i in range(300)]
    lengths = spark.createDataFrame(rows, "doc_id long, text_hash long, n long")
    one = packing.pack_lengths(lengths, (64, 128), shard_tokens=3000).collect()
    two = packing.pack_lengths(spark.sparkContext.parallelize(rows, 11).toDF("doc_id long, text_hash long, n long"), (64, 128), shard_tokens=3000).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    check(one, (64, 128))
    by_shard = {}
    for r in one:
        by_shard.setdefault(r.bin.split("-")[0], []).append(r)
    for rows_of in by_shard.values():  # each shard is the plain algorithm's, up to the order of equal lengths
        lengths_of = sorted((r.length for r in rows_of), reverse=True)
        at, final = plain_best_fit(lengths_of, (64, 128), packing.OVERHEAD, packing.ATTENTION)
        want = {}
        for (b, o), n in zip(at, lengths_of, strict=True):
            want.setdefault(b, []).append((o, n))
        got = {}
        for r in rows_of:
            got.setdefault(r.bin, (r.capacity, []))[1].append((r.bin_offset, r.length))
        assert sorted((c, sorted(x)) for c, x in got.values()) == sorted((final[b], sorted(x)) for b, x in want.items())
    shards = spark.createDataFrame(one).groupBy(F.split("bin", "-")[0].alias("shard"))
    sizes = {r.shard: (r.nulls, r.sevens) for r in shards.agg(F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"), F.count(F.when(F.col("doc_id") == 7, 1)).alias("sevens")).collect()}
    assert len(sizes) == -(-sum(r[2] for r in rows) // 3000) and max(map(max, sizes.values())) < 60
