"""Precision and recall by kind on prose that the training rule didn't make."""

from factorloom.llm import pii

#: Sentence, with the personal value between braces and its kind; sentences without braces have none.
PROSE = [
    ("address", "Please send the signed form to {zoë.fraser@länder.museum} before Friday."),
    ("address", "You can reach the editor at {h.okafor [at] gazette [dot] news} during the week."),
    ("address", "Questions? Our volunteer answers mail under {kim-li(at)harbour.org}."),
    ("address", "Bitte schreiben Sie an {jürgen@bücherei.de}, wir antworten schnell."),
    ("number", "If nobody opens, wait; otherwise phone {0171 555 2368} in the evening."),
    ("number", "Or call {(415) 555-0143} and leave a message."),
    ("number", "Her mobile is {020 7946 0958}, but she rarely answers."),
    ("number", "Tel: {01 42 68 53 00} (accueil), du lundi au vendredi."),
    ("number", "Ring {555-867-5309} after six and ask for the nurse."),
    ("number", "Fax {030/123456} is still connected, the line is not."),
    ("identity", "The applicant gave her social security number as {536-22-9147} at the desk."),
    ("identity", "His passport {C4839275} was found on the platform."),
    ("identity", "National id: {X20394857}, issued in the capital."),
    ("birth", "The singer was born {17/09/1984} in a small town by the river."),
    ("birth", "Date of birth {1979-03-22}; place of birth unknown."),
    ("birth", "Er ist {4.11.1958} geboren und lebt in Bremen."),
    ("ipv6", "The login came from {2001:0db8:85a3:0000:0000:8a2e:0370:7334} shortly after noon."),
    ("ipv6", "Blocked client {fe80:1:2:3:4:5:6:7} twice."),
    ("iban", "Rent goes to account {DE89 3704 0044 0532 0130 00} on the first of the month."),
    ("iban", "IBAN: {GB29NWBK60161331926819} (branch in Leeds)."),
    ("iban", "Transfer to {FR1420041010050500013M02606} was refused."),
    ("", "The ship carried 4500 tons of grain and 120 men in the spring of 1847."),
    ("", "See chapter 12, pages 230-245, and table 3.2 for the whole list."),
    ("", "Version 10.4.11 fixes the crash that came with release 10.4.10."),
    ("", "The match ended 3-2 after extra time; 48213 people watched."),
    ("", "The library opens 09:30:00 and closes 18:00:00 on weekdays."),
    ("", "Order 7781-223-9904 was shipped, invoice 2023-118-4456 follows."),
    ("", "On 12/06/2003 the bridge was reopened to traffic."),
    ("", "Released 2011-04-08, the record sold 250 000 copies."),
    ("", "ISBN 978-3-16-148410-0 is out of print, the price was 24.99."),
    ("", "He paid 1 200 000 for the house and 35 000 for the garden."),
    ("", "Thanks @maria and @tom for the pictures @ the lake."),
    ("", "The model A1234567 replaces the older part B7654321."),
    ("", "At 51.5074 north the days are short; at 0.1278 west the sun sets at 15:53:20."),
    ("", "The ratio was 3:4:5 in every triangle they measured."),
    ("", "Figure 14.2.1 shows 1024 by 768 points."),
    ("", "Call number 823.912 is on the second floor."),
    ("", "The reference ABCD 1234 5678 was printed on the order."),
]


def test_precision_and_recall_on_prose():
    model, thresholds = pii.fitted()
    texts = [s.replace("{", "").replace("}", "") for _, s in PROSE]
    found = pii.find_spans(texts, model, thresholds)
    hit = {k: 0 for k in pii.MORE_KINDS}
    planted = {k: 0 for k in pii.MORE_KINDS}
    false = []
    for (kind, marked), text, (base, spans) in zip(PROSE, texts, found, strict=True):
        start = marked.find("{")
        value = (start, marked.find("}") - 1)
        if kind:
            planted[kind] += 1
            # found under its kind, or covered by any selected span
            hit[kind] += any(a < value[1] and b > value[0] for a, _, b in spans)
        false += [(text[a:b], pii.KINDS[k]) for a, k, b in spans if (a, k, b) not in base and not (kind and a < value[1] and b > value[0])]
    total, caught = sum(planted.values()), sum(hit.values())
    print(hit, planted, false)
    assert caught >= 0.85 * total, (hit, planted)
    assert caught / (caught + len(false)) >= 0.85, false


def test_clean_documents_are_left_alone():
    import pyarrow.parquet as pq

    model, thresholds = pii.fitted()
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    found = pii.find_spans(texts, model, thresholds)
    assert sum(len(spans) - len(base) for base, spans in found) <= 0.01 * len(texts)


def test_generators_are_linear_in_long_texts():
    import time

    model, thresholds = pii.fitted()
    texts = ["a.b-" * 250_000, "x" * 1_000_000, "(at" * 300_000, "1-" * 500_000, "AB12 " * 100_000, "@a" * 300_000, "a:" * 500_000]
    began = time.time()
    pii.find_spans(texts, model, thresholds)
    assert time.time() - began < 60
