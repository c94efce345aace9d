import hashlib
import random
import re

import numpy as np

from factorloom.llm import boosting, pii


def plain_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def texts():
    rng = random.Random(5)
    out = ["", None, "😀 a@b.c@d.e f@@g.h x@y x.y@z-.q é@b.de", "1.2.3.4.5.6.7.8 999.1.1.1.1 0001.002.03.4", "4111 1111 1111 1111 4111-1111-1111-1112 " + "4" * 40, "+1 (437) 555-0689 +49 30 1234 5678 9012 345 ++1..2 +1+2 3 4 5 6 7 8 9"]
    out += ["x" * 3000 + "@" + "y.z" * 500, "7" * 20000, "+1" + " " * 4000, "the end. " * 2000 + "a.b%c@mail.example.com"]
    for _ in range(3000):
        out.append("".join(rng.choice(["@", ".", "a", "B-", "1", "22", "255", "256", " ", "-", "+", "(", ")", "é", "4111111111111111", "x_y"]) for _ in range(rng.randrange(1, 40))))
    return out


def test_base_spans_against_plain_patterns():
    for t in texts():
        assert pii.base_spans(t or "") == plain_base(t), t


def test_trees_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -1)).astype(float)
    model = boosting.calibrate(boosting.fit(x[:2000], y[:2000], trees=60), x[2000:2500], y[2000:2500])
    p = model.probability(x[2500:])
    assert ((p > 0.5) == y[2500:]).mean() > 0.93
    assert abs(p.mean() - y[2500:].mean()) < 0.05
    assert boosting.threshold_for(np.array([0.9, 0.8, 0.7]), np.array([1.0, 1.0, 0.0]), 1.0) == 0.8
    assert boosting.threshold_for(np.array([0.9]), np.array([0.0]), 0.9) > 1
    assert np.isfinite(boosting.fit(x, np.zeros(3000), trees=2).margin(x)).all()


def test_held_out_precision_and_recall():
    model, thresholds = pii.fitted()
    x, y = pii.training_rows(seed=77, rows=2000)
    kind = x[:, : len(pii.MORE_KINDS)].argmax(axis=1)
    chosen = model.probability(x) >= np.array(thresholds)[kind]
    assert y[chosen].mean() > 0.95 and chosen[y == 1].mean() > 0.9


def test_spans_overlap_rules_and_redaction():
    model, thresholds = pii.fitted()
    samples = ["contact jörg.müller@firma.de now", "call 030 555 1234 or", "born 12.03.1961 in", "version 12.03.14 of", "mail ana [at] web [dot] org", "the a@b.co of"]
    found = pii.find_spans(samples, model, thresholds)
    picked = [[pii.KINDS[k] for _, k, _ in all_] for _, all_ in found]
    assert "number" in picked[1] and "birth" in picked[2] and not picked[3] and "address" in picked[4] and picked[5] == ["email"]
    for (own, all_), text in zip(found, samples, strict=True):
        assert set(own) <= set(all_)
        extra = [s for s in all_ if s not in own]
        assert not any(a[0] < b[2] and b[0] < a[2] for a in extra for b in all_ if a != b)
        assert "@" not in pii.redacted(text, all_) or "müller" in text
    assert pii.redacted("a b@c.de d", [(2, 0, 8)]) == "a <EMAIL> d"
    assert pii.redacted("0123456789", [(1, 0, 5), (3, 1, 7)]) == "0<EMAIL>789"


def test_columns(spark):
    rows = [(i, t, "k") for i, t in enumerate(texts()[:60])] + [(3, texts()[3], "k"), (None, "a@b.cd", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.pii_digests(docs).collect()
    want = []
    for d, t, _ in rows:
        b = plain_base(t)
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in b).encode()).hexdigest()
        want.append((d, *(sum(k == x for _, k, _ in b) for x in range(4)), digest))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in got)
    clean = pii.redact(docs).collect()
    assert len(clean) == len(rows) and all(not plain_base(r.text) or "<" in r.text for r in clean) and clean[0].spans == "k"
    assert pii.pii_digests(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0
