import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factorloom.llm import fingerprints


def rows():
    rng = random.Random(4)
    word = lambda: rng.choice(["stone", "für", "éa", "😀", "river.", "Quelle", "what?", "x"])
    out = []
    for i in range(60):
        out.append((i * 37, rng.choice([" ", "\n", "\n\n"]).join(word() for _ in range(rng.randrange(0, 60)))))
    out += [(5, "z" * 1000), (7, None), (8, ""), (9, "a"), (37, out[1][1]), (None, "null id."), (100_000, "end\n"), (-4, "minus one. two")]
    return out


def next_of(table):
    order = sorted(table, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    return [(d, t or "", order[(k + 1) % len(order)][1] or "") for k, (d, t) in enumerate(order)]


def edit(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def plain_branches(print_):
    """Sections as (hash, paragraph hashes), and the set of leaves."""
    sections, leaves = [], set()
    for s in print_.split("/")[1:]:
        own, *paragraphs = s.split("|")
        sections.append((own, [p.split(":")[0] for p in paragraphs]))
        leaves |= {x for p in paragraphs for x in p.split(":")[1].split(",")}
    return sections, leaves


def plain_likeness(a, b):
    x, y = plain_branches(a)[1], plain_branches(b)[1]
    return 1.0 if a[:64] == b[:64] else min(2 * len(x & y) / (len(x) + len(y)), 0.999999)


def plain_places(a, b):
    x, y, out = plain_branches(a)[0], plain_branches(b)[0], []
    for i in range(max(len(x), len(y))):
        p, q = (z[i] if i < len(z) else ("", []) for z in (x, y))
        if p[0] != q[0]:
            out += [f"{i}.{j}" for j in range(max(len(p[1]), len(q[1]))) if (p[1][j : j + 1] != q[1][j : j + 1])]
    return ",".join(out)


@pytest.mark.parametrize("block", [40, 500, 10**9])
def test_edited_text_and_likeness(spark, block):
    table = rows()
    docs = spark.createDataFrame([(d, t, "q") for d, t in table], "doc_id long, text string, block string").repartition(3)
    got = fingerprints.edited_prints(docs, block_bytes=block).collect()
    want = sorted((d, len(t), hashlib.sha256(edit(t, n).encode()).hexdigest()) for d, t, n in next_of(table) if d is not None)
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == want
    assert len(got) == len(table)
    prints = {t or "": p for t, p in spark.createDataFrame([(t or "",) for _, t in table], "t string").select("t", fingerprints.fingerprint(F.col("t"))).collect()}
    after = {d: n for d, t, n in next_of(table)}
    for r in got:
        assert abs(r.near_edited - plain_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert r.edited_places == plain_places(r.fingerprint, r.edited_fingerprint)
        if r.doc_id != 37:
            assert abs(r.near_next - plain_likeness(r.fingerprint, prints[after[r.doc_id]])) < 1e-12
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)


def test_tree_against_plain_python(spark):
    import regex

    def plain(text):
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()
        cut = lambda pattern, s: regex.split(pattern, s, flags=regex.V1)
        sections = []
        for s in cut(r"(?<=\n)(?=\n|#)", text):
            paragraphs = []
            for p in cut(r"(?<=\n)", s):
                leaves, start = [], 0
                for i in range(1, len(p) + 1):
                    ends = i < len(p) and ((p[i - 1] in ".!?" and p[i] == " ") or i - start == 160)
                    if ends or i == len(p):
                        leaves.append(p[start:i])
                        start = i
                hashes = [h(x) for x in leaves or [""]]
                own = h("paragraph " + ",".join(hashes))
                paragraphs.append((own, own[:16] + ":" + ",".join(x[:16] for x in hashes)))
            own = h("section " + ",".join(p[0] for p in paragraphs))
            sections.append((own, own[:16] + "|" + "|".join(p[1] for p in paragraphs)))
        return h("document " + ",".join(s[0] for s in sections)) + "/" + "/".join(s[1] for s in sections)

    texts = sorted({t for _, t in rows() if t}) + ["", "# a\ntext one. two\n\n# b\nmore", "\n\n\n", "y" * 321, "y" * 320, "😀" * 500, "é😀" * 80 + ". x"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in docs.select("text", fingerprints.fingerprint(F.col("text")).alias("p")).collect():
        assert r.p == plain(r.text), r.text


def test_differing_branches_locate_an_edit(spark):
    lines = [f"line {i} has words. And more of them" for i in range(30)]
    other = list(lines)
    other[17] = "line 17 was changed. And more of them"
    pair = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    prints = pair.select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    row = prints.select(
        fingerprints.differing(F.col("a"), F.col("b")).alias("p"),
        fingerprints.differing(F.col("a"), F.col("a")).alias("none"),
        fingerprints.likeness(F.col("a"), F.col("b")).alias("like"),
        fingerprints.likeness(F.col("a"), F.col("a")).alias("same"),
    ).first()
    assert row.p == ["0.17"] and row.none == [] and row.same == 1
    assert 0.9 < row.like < 1


def test_null_and_repeated_ids_and_scattered_ids_are_dealt_over_blocks(spark):
    rng = random.Random(6)
    table = [(None, f"null {i}") for i in range(200)] + [(77, f"same id {i}") for i in range(200)] + [(rng.randrange(-(1 << 63), 1 << 63), f"far {i}") for i in range(200)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    for size in (150, 10**9):
        got = fingerprints.with_next(docs, size).collect()
        assert len(got) == 600 and sorted(r.text for r in got) == sorted(r.next_text for r in got)  # one cycle or more
        step = {r.text: r.next_text for r in got}
        at, seen = "null 0", []
        for _ in range(600):
            seen.append(at)
            at = step[at]
        assert at == "null 0" and len(set(seen)) == 600
        ids = dict((t, d) for d, t in table)
        start = seen.index(max((t for t in seen if ids[t] is not None), key=lambda t: ids[t]))
        order = [ids[t] for t in seen[start:] + seen[:start]]
        kept = [d for d in order if d is not None]
        assert kept == sorted(kept, reverse=True) and order[-200:] == [None] * 200
    blocks = fingerprints._bounds(docs.select(F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("place"), "text"), 150, 1 << 16)
    assert len(blocks) > 20 and blocks.count(~77) > 5 and blocks.count((1 << 63) - 1) > 5


def test_no_python_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b. c")], "doc_id long, text string")
    out = fingerprints.edited_prints(docs)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    only = out.first()
    assert only.edited_sha256 == hashlib.sha256(edit("a b. c", "a b. c").encode()).hexdigest() and only.near_next == 1
    assert fingerprints.edited_prints(docs.limit(0)).count() == 0
