import random

import numpy as np
from pyspark.sql import functions as F
import pyarrow as pa

from factorloom.llm import quality
from factorloom.llm.common import text_bytes


def corpus(n=900):
    rng = random.Random(3)
    word = lambda: rng.choice("the stone of river für éa and wandering quelle in cold".split())
    rows, labels = [], []
    for i in range(n):
        host = rng.choice(["good.example", "good.example", "bad.example", f"tiny{i % 40}.example"])
        bad = rng.random() < {"good.example": 0.05, "bad.example": 0.7}.get(host, 0.2)
        words = [word() for _ in range(rng.randrange(20, 80))]
        if bad:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + "###" for w in words]
        rows.append((i, " ".join(words), host, f"/p{i % 3}", 7))
        if i % 3:
            labels.append((i, int(not bad)))
    return rows, labels


def frames(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, p long").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int"), rows


def test_surface_does_not_depend_on_neighbours():
    texts = ["One two.\nOne two.\nThree", "", "ALL CAPS!! 12", " \n\n", "für éa 😀", "x" * 70000]
    together = quality.surface(*text_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        assert np.allclose(together[k], quality.surface(*text_bytes(pa.array([t])))[0])
    assert together.shape[1] == quality.N_FEATURES
    assert np.isclose(together[0][13], 1 / 3) and np.isclose(together[0][11], 3 / 5)


def plain_posteriors(rows):
    """The two-level shrinkage in plain Python."""
    total = lambda part: (len(part), sum(r["p"] for r in part))
    by_host, by_path = {}, {}
    for r in rows:
        by_host.setdefault(r["host"], []).append(r)
        by_path.setdefault((r["host"], r["path"]), []).append(r)
    n, mean = len(rows), sum(r["p"] for r in rows) / len(rows)
    within = sum(sum((r["p"] - total(g)[1] / len(g)) ** 2 for r in g) for g in by_path.values()) / (n - len(by_path))
    sites = lambda groups, parent: sum(len(g) * (total(g)[1] / len(g) - parent(k)) ** 2 for k, g in groups.items())
    host_between = sites(by_host, lambda k: mean)
    path_between = sites(by_path, lambda k: total(by_host[k[0]])[1] / len(by_host[k[0]]))
    host_var = (host_between - (len(by_host) - 1) * within) / (n - sum(len(g) ** 2 for g in by_host.values()) / n)
    path_var = (path_between - (len(by_path) - len(by_host)) * within) / (n - sum(len(g) ** 2 / len(by_host[k[0]]) for k, g in by_path.items()))
    kh = within / host_var if host_var > within * 1e-6 else 1e6
    kp = within / path_var if path_var > within * 1e-6 else 1e6
    odds = lambda p: np.log(p / (1 - p))
    out = {}
    for r in rows:
        hn, hs = total(by_host[r["host"]])
        pn, ps = total(by_path[r["host"], r["path"]])
        ph = (hs - r["p"] + kh * mean) / (hn - 1 + kh)
        pp = (ps - r["p"] + kp * ph) / (pn - 1 + kp)
        out[r["doc_id"]] = (ph, pp, 1 / (1 + np.exp(-(odds(r["p"]) + odds(pp) - odds(mean)))))
    return out


def test_posteriors_against_plain_python(spark):
    rng = np.random.default_rng(1)
    rows = [{"doc_id": i, "host": f"h{min(i % 17, 5)}", "path": f"/{i % 4}", "p": float(np.clip(rng.beta(2, 2) * (0.4 + 0.1 * (i % 5)), 0.01, 0.99))} for i in range(400)]
    evidence = spark.createDataFrame(rows, "doc_id long, host string, path string, p double")
    sites, priors = quality.site_table(evidence)
    want = plain_posteriors(rows)
    for r in quality.posteriors(evidence, sites, priors).collect():
        assert np.allclose((r.p_host, r.p_path, r.p_posterior), want[r.doc_id], atol=1e-9)


def test_held_out_accuracy_and_shrinkage(spark):
    docs, labels, rows = frames(spark)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    good = lambda text: text == text.lower() and "#" not in text
    assert sum(got[d].keep == good(t) for d, t, *_ in held) >= 0.97 * len(held)
    hosts = {r[2]: got[r[0]].p_host for r in rows}
    assert hosts["bad.example"] < hosts["tiny1.example"] < hosts["good.example"]
    kept = quality.keep_good(docs, labels).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, r in got.items() if r.keep)
    assert kept[0].asDict().keys() == {"doc_id", "text", "source", "lang", "p"} and kept[0].p == 7


def test_few_labels_of_both_classes_are_fitted(spark):
    docs, labels, rows = frames(spark)
    few = labels.where("quality = 1").orderBy("doc_id").limit(2).unionByName(labels.where("quality = 0").orderBy("doc_id").limit(2))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [(r.p_document, r.keep, truth[r.doc_id]) for r in quality.classify(docs, few).collect() if r.doc_id in truth]
    assert np.mean([p for p, _, good in got if good]) > np.mean([p for p, _, good in got if not good]) + 0.1
    assert np.mean([keep == bool(good) for _, keep, good in got]) > 0.8


def test_nulls_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "a b", "h", None), (2, "", "h", "x"), (2, "", "h", "x")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 4 and all(r.keep and r.p_document == 0.5 for r in got)
    assert quality.keep_good(docs, none).count() == 4
    assert quality.classify(docs.limit(0), none).count() == 0 and quality.keep_good(docs.limit(0), none).count() == 0


def test_many_sites_give_the_same_rows(spark, monkeypatch):
    docs, labels, rows = frames(spark)
    more = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    want = sorted(map(str, quality.keep_good(more, labels).collect()))
    scored = sorted((str(r.doc_id), round(r.p_posterior, 9)) for r in quality.classify(more, labels).collect())
    monkeypatch.setattr(quality, "BROADCAST_SITES", 0)
    assert sorted(map(str, quality.keep_good(more, labels).collect())) == want
    assert sorted((str(r.doc_id), round(r.p_posterior, 9)) for r in quality.classify(more, labels).collect()) == scored


def test_very_long_text(spark):
    docs, labels, _ = frames(spark)
    long = docs.limit(1).withColumn("text", F.repeat(F.lit("word and more. "), 300_000)).withColumn("doc_id", F.lit(10**9))
    got = quality.classify(docs.unionByName(long), labels).where(f"doc_id = {10**9}").collect()
    assert len(got) == 1 and 0 < got[0].p_document < 1


def test_query_against_plain_posteriors(spark):
    """Every row's posteriors and verdict on the whole table, from the documents' own probabilities."""
    from factorloom.llm import queries

    sf = "/root/testdata/sf0.001"
    sites = {r.doc_id: (r.source, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    scored = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    rows = [{"doc_id": r.doc_id, "host": sites[r.doc_id][0], "path": sites[r.doc_id][1], "p": r.p_document} for r in scored]
    want = plain_posteriors(rows)
    for r in scored:
        assert np.allclose((r.p_host, r.p_path, r.p_posterior), want[r.doc_id], atol=1e-9) and r.keep == (r.p_posterior >= 0.5)
    got = {r.doc_id: r.keep for r in queries.op5_quality(spark, sf).collect()}
    assert got == {r.doc_id: r.keep for r in scored}


def test_held_out_labels_of_the_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("pmod(xxhash64(doc_id), 3) = 0")
    got = quality.classify(docs, labels.join(held.select("doc_id"), "doc_id", "left_anti")).join(held.select("doc_id", "quality"), "doc_id").collect()
    assert len(got) > 50 and sum(r.keep == bool(r.quality) for r in got) >= 0.9 * len(got)
