"""Personal data: overlapping candidate spans, boosted trees, calibrated thresholds.

Base spans have fixed forms (email, ip, card, phone) and always stay.  High-recall
generators propose more, overlapping each other and the base: obfuscated and
international addresses, local and spaced phone numbers, numbers near-missing the card
check, IPv6, IBAN-like codes, identity numbers, dates of birth and labelled identifiers.
Each proposal is described by its format and by the words around it, boosted trees give
a probability, and a calibrated threshold for each kind selects.  Where selected
proposals overlap each other, the likeliest stays; one that overlaps a base span is
dropped, since that text is already selected.

The trees are fitted here, on synthetic sentences made by a seeded rule: true values in
the forms people write them, and look-alikes (versions, prices, sizes, dates, hashes,
references) in the places where those occur.  ``TRAINING_ROWS`` bounds that set.

Defined results
* null texts are empty and have no spans; equal texts have equal spans;
* repeated rows stay repeated rows; an empty table gives no rows;
* only the id and text are read (and, for redaction, the carried columns);
* places count code points, ends are exclusive, texts are scanned whole.

Scale: map-only; the model is a few kilobytes in the task's closure.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting
from .common import documents, ship_package, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds of proposals, listed after the base.
MORE_KINDS = ("address", "number", "identity", "birth", "ipv6", "iban")
KINDS = BASE_KINDS + MORE_KINDS
TRAINING_ROWS = 6000
PRECISION = 0.98

# The base forms.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

#: Generators of further proposals, each needing the character named before scanning.
GENERATORS = (
    ("address", "@", re.compile(r"(?<![^\s@<>()\[\],;:\"])[^\s@<>()\[\],;:\"]+@[^\s@<>()\[\],;:\"]{2,}")),
    ("address", " ", re.compile(r"(?<![\w.+-])[A-Za-z0-9._+-]+\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z0-9-]{2,})+", re.I)),
    ("number", "0", re.compile(r"(?<![\w.+])\(?[0-9]{2,4}\)?(?:[\x20./-]?[0-9]{2,5}){1,4}(?![\w])")),
    ("identity", "0", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("identity", "0", re.compile(r"(?<!\w)[A-Z]{1,2}[0-9]{6,9}[A-Z]?(?!\w)")),
    ("birth", "0", re.compile(r"(?<![\w/.-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![\w/-])")),
    ("ipv6", ":", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("iban", "0", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")),
)
#: Words that speak for or against each kind of personal data nearby.
_CUES = {
    "contact": "mail email e-mail contact write reply reach courriel correo kontakt adresse".split(),
    "call": "call phone tel telephone mobile cell fax ring dial tél teléfono telefon handy rufnummer".split(),
    "person": "ssn social security passport licence license id national identity born birth dob birthday geboren née nacido geburtsdatum".split(),
    "money": "iban account bank transfer konto compte cuenta payee".split(),
    "address": "ip host address client server peer login from".split(),
    "thing": "version release build isbn issn order invoice page pages price total ref reference section table figure room model size score chapter vol".split(),
}
_WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the leftmost non-overlapping matches of each base form, in order."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain and at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                out.append((start, 0, end))
        at = text.find("@", at + 1)
    # Each match of these forms begins with the first digit of a run of digits.
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all generators' matches; they may overlap."""
    digits = any(d in text for d in "0123456789")
    has = {"@": "@" in text, ":": ":" in text, " ": "[" in text or "(" in text, "0": digits}
    return sorted({(m.start(), KINDS.index(kind), m.end()) for kind, need, form in GENERATORS if has[need] for m in form.finditer(text)})


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context of a proposal."""
    start, kind, end = span
    token = text[start:end]
    digits = _NO_DIGIT.sub("", token)
    before, after = text[max(0, start - 60) : start], text[end : end + 30]
    near = [w.lower() for w in _WORD.findall(before)[-4:]]
    behind = [w.lower() for w in _WORD.findall(after)[:2]]
    groups = [len(g) for g in re.findall("[0-9]+", token)]
    row = [float(kind == KINDS.index(k)) for k in MORE_KINDS]
    row += [
        len(token),
        len(digits),
        len(digits) / len(token),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        sum(c in "-. /" for c in token),
        token.count("."),
        token.count("-"),
        token.count(":"),
        float("(" in token),
        float("@" in token),
        sum(c.isalpha() for c in token),
        sum(c.isupper() for c in token),
        float(luhn(digits) if digits else 0),
        float(digits[:1] == "0"),
        int(digits[-4:] or 0) if len(digits) == 8 else 0,
        float(_iban_rest(token) == 1),
        float(before.rstrip()[-1:] in (":", "=", "#")),
        float(before.rstrip()[-1:] in ("$", "€", "£", "v", "§")),
        float(after.lstrip()[:1] in ("%", "€")),
        len(set(digits)),
    ]
    for cues in _CUES.values():
        row.append(max((k + 1 for k, w in enumerate(near) if w in cues), default=0))
        row.append(float(any(w in cues for w in behind)))
    return row


def _iban_rest(token: str) -> int:
    code = token.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}", code):
        return -1
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _training_texts(rng: random.Random, n: int) -> Iterator[tuple[str, str, str]]:
    """(sentence with a value, the value or "" if the sentence has none to select, its kind)."""
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: rng.choice(["ana", "li", "tom", "marie", "jörg", "sam", "ruiz", "kim"]) + rng.choice(["", ".", "_", "-"]) + rng.choice(["lee", "smith", "müller", "roy", number(2)])
    site = lambda: rng.choice(["mail", "post", "web", "firma", "lycee"]) + rng.choice(["", number(1)]) + rng.choice([".com", ".org", ".de", ".fr", ".example", ".co.uk"])

    def iban(good: bool) -> str:
        country, account = rng.choice(["DE", "FR", "ES", "GB"]), number(rng.choice([18, 20, 22]))
        check = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
        code = country + f"{check if good else (check + rng.randrange(1, 90)) % 97:02d}" + account
        return " ".join(code[i : i + 4] for i in range(0, len(code), 4)) if rng.random() < 0.5 else code

    date = lambda: rng.choice([f"{rng.randrange(1, 29):02d}/{rng.randrange(1, 13):02d}/{rng.randrange(1930, 2012)}", f"{rng.randrange(1930, 2012)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.{rng.randrange(1930, 2012)}"])
    local = lambda: rng.choice([f"({number(3)}) {number(3)}-{number(4)}", f"0{number(2)} {number(3)} {number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"0{number(3)}/{number(6)}"])
    v6 = lambda: ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8))
    true = [
        ("address", lambda: f"{name()}@{site()}", ["write to {}", "email: {}", "contact {} today", "{}", "reply to {} or"]),
        ("address", lambda: f"{name()} [at] {site().replace('.', ' [dot] ')}", ["mail {}", "contact: {}", "reach me at {}"]),
        ("number", local, ["call {}", "tel: {}", "phone {} now", "mobile {}", "fax {}", "téléfono: {}", "Handy {}"]),
        ("identity", lambda: f"{number(3)}-{number(2)}-{number(4)}", ["ssn {}", "social security {}", "id: {}", "her number is {}"]),
        ("identity", lambda: rng.choice("ABCX") + number(rng.choice([7, 8])), ["passport {}", "licence {}", "identity: {}"]),
        ("birth", date, ["born {}", "date of birth {}", "dob: {}", "née {}", "geboren {}"]),
        ("ipv6", v6, ["from {}", "client {}", "host {} login", "{}"]),
        ("iban", lambda: iban(True), ["iban {}", "account: {}", "transfer to {}", "Konto {}"]),
    ]
    false = [
        ("", lambda: f"{number(3)}-{number(3)}-{number(4)}", ["order {}", "isbn {}", "invoice {}", "ref {}", "model {}"]),
        ("", lambda: f"{number(4)} {number(4)}", ["total {}", "page {}", "score {}", "pages {} of", "the {} and"]),
        ("", lambda: f"{number(2)}.{number(2)}.{number(2)}", ["version {}", "release {}", "section {}", "build {}"]),
        ("", lambda: f"{number(rng.choice([4, 6, 8, 12, 16]))}", ["the {} of", "total {}", "order {}", "room {}", "price {}", "year {} was", "{}"]),
        ("", lambda: f"{number(2)}/{number(2)}", ["score {}", "page {}", "size {}"]),
        ("", date, ["released {}", "on {} the", "version {}", "updated {}", "page of {}", "since {} it"]),
        ("", lambda: rng.choice("ABCX") + number(7), ["order {}", "model {}", "part {}", "ref {}"]),
        ("", lambda: f"{number(2)}:{number(2)}:{number(2)}", ["at {}", "time {}", "until {}"]),
        ("", lambda: iban(False), ["ref {}", "code {}", "model {}"]),
        ("", lambda: f"@{name()}", ["see {}@", "thanks {} @ all", "x {}"]),
        ("", lambda: f"{number(1)}@{number(2)}.", ["price {}", "score {}"]),
    ]
    filler = "the of on and river une der casa la stone et in thou ing".split()
    for i in range(n):
        kind, make, frames = rng.choice(true if i % 2 else false)
        value = make()
        words = lambda: " ".join(rng.choice(filler) for _ in range(rng.randrange(0, 6)))
        yield f"{words()} {rng.choice(frames).format(value)} {words()}", value if i % 2 else "", kind


def training_rows(seed: int = 11, rows: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features of all proposals in synthetic sentences, and whether each is the true value and of its kind."""
    x, y = [], []
    for text, value, kind in _training_texts(random.Random(seed), rows):
        at = text.find(value) if value else -1
        for span in proposals(text):
            x.append(features(text, span))
            y.append(float(span == (at, KINDS.index(kind), at + len(value)) if value else False))
    return np.array(x), np.array(y)


@lru_cache(maxsize=2)
def fitted(seed: int = 11, rows: int = TRAINING_ROWS, precision: float = PRECISION) -> tuple[boosting.Model, tuple[float, ...]]:
    """The calibrated trees and the threshold of each kind, by held-out precision."""
    x, y = training_rows(seed, rows)
    part = np.arange(len(y)) % 4
    model = boosting.calibrate(boosting.fit(x[part < 2], y[part < 2]), x[part == 2], y[part == 2])
    held, want = x[part == 3], y[part == 3]
    p = model.probability(held)
    thresholds = tuple(boosting.threshold_for(p[held[:, k] == 1], want[held[:, k] == 1], precision) for k in range(len(MORE_KINDS)))
    return model, thresholds


def find_spans(texts: list[str], model: boosting.Model, thresholds: tuple[float, ...]) -> list[tuple[list, list]]:
    """For each text its base spans, and all its selected spans."""
    base = [base_spans(t) for t in texts]
    more = [proposals(t) for t in texts]
    rows = [features(t, s) for t, spans in zip(texts, more, strict=True) for s in spans]
    p = model.probability(np.array(rows)).tolist() if rows else []
    out, at = [], 0
    for own, spans in zip(base, more, strict=True):
        likely = sorted(((-q, s) for s, q in zip(spans, p[at : at + len(spans)], strict=True) if q >= thresholds[s[1] - len(BASE_KINDS)]))
        at += len(spans)
        out.append((own, sorted(own + _without_overlaps(own, [s for _, s in likely]))))
    return out


def _without_overlaps(taken: list[tuple[int, int, int]], wanted: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those wanted, in order of preference, that overlap neither the taken spans nor a preferred one."""
    from bisect import bisect_left, insort

    edges: list[tuple[int, int]] = []  # disjoint taken ranges
    for a, _, b in sorted(taken):
        if edges and a < edges[-1][1]:
            edges[-1] = (edges[-1][0], max(b, edges[-1][1]))
        else:
            edges.append((a, b))
    kept = []
    for span in wanted:
        a, _, b = span
        k = bisect_left(edges, (a, 0))
        if (k == 0 or edges[k - 1][1] <= a) and (k == len(edges) or edges[k][0] >= b):
            insort(edges, (a, b))
            kept.append(span)
    return kept


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each selected stretch replaced by the kind of its first span."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def pii_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of each document's base spans, and all its selected spans written out."""
    ship_package(docs.sparkSession)
    model, thresholds = fitted()
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            found = find_spans(batch.column(1).to_pylist(), model, thresholds)
            columns = [pa.array([sum(s[1] == k for s in own) for own, _ in found], pa.int64()) for k in range(4)]
            digest = pa.array([hashlib.sha256(written(own).encode()).hexdigest() for own, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, digest, pa.array([written(s) for _, s in found], pa.string())], names)

    return documents(docs, id_col, text_col).mapInArrow(run, DIGEST)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with selected spans replaced by their kind; null texts become empty."""
    ship_package(docs.sparkSession)
    model, thresholds = fitted()
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, place):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            clean = [redacted(t, s) for t, (_, s) in zip(texts, find_spans(texts, model, thresholds), strict=True)]
            yield batch.set_column(place, text_col, pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)
