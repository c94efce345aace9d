import hashlib

import corpus_pipeline
from factorloom.llm import minhash, packing, pii, quality, suffix_dedup, token_counts
from factorloom.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input, held against a plain version of its decision."""
    from test_minhash import plain_classes
    from test_pii import plain_base
    from test_suffix_dedup import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        place = str(tmp_path / str(number))
        stage(spark, docs, SF).write.parquet(place)
        out = spark.read.parquet(place)
        before, after = docs.collect(), out.collect()
        seen[name] = before, after
        if name != "packing":
            assert out.columns == columns
            assert all(r.n_chars == len(r.text) for r in after)
        docs = out

    before, after = seen["quality"]
    scored = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in scored if r.keep) and len(after) < len(before)
    before, after = seen["near duplicates"]
    classes = plain_classes([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in classes})
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in after)
    before, after = seen["repeats"]
    want = {d: h for d, _, _, _, h in brute([(r.doc_id, r.text) for r in before])}
    kept = {r.doc_id: r.text for r in after}
    assert kept.keys() == want.keys()
    exact = sum(hashlib.sha256(t.encode()).hexdigest() == want[d] for d, t in kept.items())
    assert exact >= 0.95 * len(kept)  # the rest had a character cut in half
    before, after = seen["personal data"]
    assert len(before) == len(after) and not any(plain_base(r.text) for r in after)
    before, after = seen["packing"]
    encoder = token_counts.make_encoder(token_counts.read_vocabulary(VOCABULARY))
    total = {r.doc_id: len(token_counts.encode(encoder, r.text)) for r in before}
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == total


def test_run_is_registered_and_gives_the_last_stage(spark):
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is corpus_pipeline.run
    assert [f.name for f in corpus_pipeline.run(spark, SF).schema] == [x.split()[0] for x in packing.SCHEMA.split(", ")]
    assert minhash and pii and suffix_dedup


def stages(spark, docs, folder):
    seen = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{folder}/{number}")
        seen.append(spark.read.parquet(f"{folder}/{number}"))
    return seen


def test_nulls_repeated_ids_clashing_columns_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    good = docs.where("n_chars > 200").first().text
    odd = spark.createDataFrame(
        [(None, None), (None, good), (None, good), (5000, good), (5000, good), (5000, "a quite different text of its own, with some words more than the others."), (5001, None), (5002, ""), (5003, good + " x" * 400_000)],
        "doc_id long, text string",
    )
    table = docs.unionByName(odd, allowMissingColumns=True)
    for c in ("host", "digest", "n", "block", "bands", "class_id", "shard", "turn"):
        table = table.withColumn(c, table.doc_id + 1)
    seen = stages(spark, table, str(tmp_path / "odd"))
    for step in seen[1:-1]:
        assert step.columns == table.columns
    rows = seen[2].collect()
    assert len([r for r in rows if r.doc_id is None]) == seen[1].where("doc_id is null").count()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids))
    assert seen[3].where("text is null").count() == 0 and seen[5].count() >= seen[4].count()
    empty = stages(spark, table.limit(0), str(tmp_path / "empty"))
    assert all(s.count() == 0 for s in empty) and empty[-1].columns == seen[-1].columns
