import hashlib
import math
import random
import re
import string

from pyspark.sql import functions as F

from factorloom.llm import secrets


def base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def written(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def rows():
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    keys = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    texts = [
        "", None, "nothing here", f"😀é token = \"{hexes(40)}\" and", "secret=token: abcdef1", "token=abc token=abcdef", "API_KEY : 'x.y=zz-1' apikey=12345",
        "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + "x", "AKIAKIA" + "Z" * 16, hexes(23), hexes(24) + "g" + hexes(60), "password=" + "a" * 5000, "Password\"  =  " + "q9" * 4,
        "é" * 50 + hexes(30) + "é" + hexes(30), f"x {keys(44)} y", "token=abcdef " * 400, "=:" * 50, "ABCDEF" * 10, "passwd=secret=token=abcdefgh", "tokenſ=abcdefgh ſecret=abcdefgh",
    ]
    texts += [f"key {keys(48)} end" for _ in range(30)]
    texts += [f"word {'_'.join(rng.choice(['the', 'value', 'of', 'name', 'this', 'is']) for _ in range(12))} end" for _ in range(60)]
    return list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]


def test_base_spans(spark):
    table = rows()
    docs = spark.createDataFrame([(d, t, "c") for d, t in table], "doc_id long, text string, base string").repartition(3)
    got = secrets.secret_digests(docs).collect()
    want = []
    for d, t in table:
        b = base(t)
        want.append((d, *(sum(k == x for _, k, _ in b) for x in range(3)), hashlib.sha256(written(b).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got)
    for r in got:
        kept = [x for x in r.spans.split(",") if x and not x.startswith("random")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r.base_sha256
    assert secrets.secret_digests(docs.limit(0)).count() == 0


def test_random_keys_are_reported_and_names_cleared(spark):
    table = rows()
    docs = spark.createDataFrame(table, "doc_id long, text string")
    by = {r.doc_id: r.spans for r in secrets.secret_digests(docs).collect() if r.doc_id is not None}
    keys = [d for d, t in table if d is not None and t and t.startswith("key ")]
    names = [d for d, t in table if d is not None and t and t.startswith("word ")]
    assert sum("random" in by[d] for d in keys) >= 0.9 * len(keys)
    assert not any("random" in by[d] for d in names)


def test_p_values_are_even_for_random_tokens(spark):
    rng = random.Random(9)
    for alphabet, n in ((string.digits + "abcdef", 64), (string.ascii_letters + string.digits + "+/", 64), (string.ascii_letters + string.digits, 22), (string.ascii_lowercase + string.digits, 30)):
        tokens = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(2500)]
        frame = spark.createDataFrame([(t,) for t in tokens], "t string")
        p = sorted(r[0] for r in frame.select(secrets.randomness(F.col("t"), F.lit(alphabet), F.lit(len(alphabet)))).collect())
        assert all(abs(p[int(q * len(p))] - q) < 0.1 for q in (0.1, 0.3, 0.5, 0.7)), (n, [p[int(q * len(p))] for q in (0.1, 0.3, 0.5, 0.7)])
        assert sum(x < 0.01 for x in p) < 90
    one_side = spark.range(1).select(secrets.randomness(F.lit("abcdefabcdefabcdefabcdef"), F.lit(string.ascii_letters), F.lit(52))).first()[0]
    assert one_side < 1e-6


def test_tails_are_exact(spark):
    cases = [(x / 4, k) for x in range(0, 600, 7) for k in (1, 2, 3, 9, 15, 25, 31, 51, 61, 63, 64)]
    frame = spark.createDataFrame(cases, "x double, k int")
    rows = frame.select("x", "k", secrets.chi_squared_tail(F.col("x"), F.col("k")).alias("p"), secrets.erfc(F.col("x") / 20 - 3).alias("e")).collect()
    for r in rows:
        assert math.isclose(r.e, math.erfc(r.x / 20 - 3), rel_tol=3e-7)
        # the regularised upper gamma function by steps of a from 1/2 or 1
        y, a = r.x / 2, 0.5 if r.k % 2 else 1.0
        want = math.erfc(math.sqrt(y)) if r.k % 2 else math.exp(-y)
        while a < r.k / 2:
            want += math.exp(a * math.log(y) - y - math.lgamma(a + 1)) if y else 0.0
            a += 1
        assert math.isclose(r.p, want, rel_tol=1e-6, abs_tol=1e-300)


def test_planted_keys_of_every_length_and_few_words_among_the_reported(spark):
    rng = random.Random(10)
    words = "the value of name this is path config handler module test server index update main data user service request response".split()
    rows, planted = [], {}
    for n in range(20, 65):
        for alphabet in (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567"):
            for _ in range(6):
                key = "".join(rng.choice(alphabet) for _ in range(n))
                planted[len(rows)] = key
                rows.append((len(rows), f"key {key} end"))
    n_keys = len(rows)
    for _ in range(3000):
        sep = rng.choice(["_", "-", "/"])
        rows.append((len(rows), "see " + sep.join(rng.choice(words) for _ in range(rng.randrange(4, 9))) + " there"))
    out = {r.doc_id: r for r in secrets.secret_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(out[d].n_random for d in range(n_keys))
    false = sum(out[d].n_random for d in range(n_keys, len(rows)))
    for low, high in ((20, 24), (24, 32), (32, 65)):
        some = [d for d, k in planted.items() if low <= len(k) < high]
        assert sum("random" in out[d].spans for d in some) >= 0.9 * len(some), (low, high)
    assert false <= 0.05 * (hits + false)
    texts = spark.createDataFrame([(1, "token=" + "a1B2" * 9), (2, "f00d" * 8), (3, "AKIA" + "Z9" * 9), (4, "x" * 30)], "doc_id long, text string")
    by = {r.doc_id: r for r in secrets.secret_digests(texts).collect()}
    assert all("random" not in by[d].spans for d in (1, 2, 3)) and by[4].n_untested == 1


def test_prefix_sums_and_plan(spark):
    frame = spark.createDataFrame([(list(range(n)),) for n in (1, 5, 128, 129, 1000)], "v array<int>")
    for r in frame.select("v", secrets.prefix_sums(F.col("v")).alias("s")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))]
    plan = secrets.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
