import random
import re

from factorloom.llm import token_counts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_every_limit_against_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["stone", "für", "ea", "\n", "2024", "😀"]) for _ in range(rng.choice([0, 1, 3, 40, 2500]))) for _ in range(120)] + [None, "", "x" * 30000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, "a b", 1)], "doc_id long, text string, n_docs long").repartition(3)
    encode = token_counts.make_encoder(token_counts.read_vocabulary(VOCABULARY)).encode_ordinary
    lengths = [len(encode(t or "")) for t in [*texts, texts[0], "a b"]]
    table = token_counts.token_counts(docs, VOCABULARY).cache()
    rows = table.collect()
    assert {r.n_tokens: r.n_docs for r in rows} == {n: lengths.count(n) for n in lengths}
    for r in rows:
        assert r.docs_at_least == sum(n >= r.n_tokens for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= r.n_tokens)
        assert r.truncated_tokens == sum(min(n, r.n_tokens) for n in lengths)
        assert r.docs_truncated == sum(n > r.n_tokens for n in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
        assert abs(r.quantile - sum(n <= r.n_tokens for n in lengths) / len(lengths)) < 1e-12
    limits = [0, 1, 2, 5, 7, 100, 2048, 10**6]
    for r in token_counts.at_limits(table, limits).collect():
        assert r.truncated_tokens == sum(min(n, r.context_limit) for n in lengths)
        assert r.docs_truncated == sum(n > r.context_limit for n in lengths)
    ordered = sorted(lengths)
    for r in token_counts.quantiles(table, [0.01, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == next(x for x in ordered if sum(n <= x for n in lengths) / len(lengths) >= r.probability - 1e-12)
    assert token_counts.token_counts(docs.limit(0), VOCABULARY).count() == 0


def test_long_runs_of_white_space(spark, monkeypatch):
    encoder = token_counts.make_encoder(token_counts.read_vocabulary(VOCABULARY))
    texts = [" " * 2_000_000, "a" + "\n" * 2_000_000 + " b", "é " + "\t " * 700_000 + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {r.doc_id: r.n_tokens for r in token_counts.encoded_lengths(docs, VOCABULARY).collect()}
    for k, text in enumerate(texts):
        ids = token_counts.encode(encoder, text)
        assert encoder.decode(ids) == text and counts[k] == len(ids)
    # the same ids as the library's, where a run is long from three characters on
    monkeypatch.setattr(token_counts, "LONG_RUN", 3)
    monkeypatch.setattr(token_counts, "_LONG_RUN", re.compile(token_counts._LONG_RUN.pattern.replace("{4096,}", "{3,}")))
    rng = random.Random(2)
    parts = [" ", "   ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\u200b", "a", "Bé", "1", "!", "'s", "😀", "\r\n", "\x85"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        assert token_counts.encode(encoder, text) == encoder.encode_ordinary(text)
