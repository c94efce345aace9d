import itertools
import random
import re
import zlib
from hashlib import sha256

import pytest

from factorloom.llm import conversations
from factorloom.llm.transducers import Composition, Edits, Grammar, Symbol

FORM = re.compile("(s?(ua)+)?")


def brute(symbols):
    """All strings of edits up to a cost, by exhaustive search over places with up to three insertions each."""
    best = None
    n = len(symbols)

    def walk(i, cost, audit, form):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == n and FORM.fullmatch(form):
            best = min(best or (cost, audit), (cost, audit))
        if cost + 5 <= limit and audit[-3:] != "III":
            for c in "ua":
                walk(i, cost + 5, audit + "I", form + c)
        if i < n:
            s = symbols[i]
            walk(i + 1, cost + 2, audit + "D", form)
            if not s.must_go:
                walk(i + 1, cost + 5 * s.faulty, audit + "K", form + s.label)
                for c in "ua":
                    walk(i + 1, cost + 1 + 5 * s.faulty, audit + "R", form + c)

    limit = 2 * n
    walk(0, 0, "", "")
    return best


def test_shortest_paths_against_exhaustive_search():
    rng = random.Random(0)
    machine = Composition(conversations.GRAMMAR)
    kinds = [Symbol(c, faulty=f) for c in "suax" for f in (False, False, True)] + [Symbol("u", must_go=True)]
    for n in range(6):
        for symbols in itertools.islice((tuple(rng.choice(kinds) for _ in range(n)) for _ in itertools.count()), 1 if n == 0 else 60):
            assert machine.shortest(symbols) == brute(symbols), symbols


def test_cheap_insertions_and_unreachable_grammars():
    machine = Composition(conversations.GRAMMAR, Edits(relabel=9, delete=9, insert=1))
    assert machine.shortest([Symbol("u"), Symbol("u")]) == (2, "KIKI")
    assert machine.shortest([Symbol("s")]) == (2, "KII")
    never = Composition(Grammar(({"u": 1}, {"u": 1}), frozenset()))
    with pytest.raises(ValueError):
        never.shortest([Symbol("u")])


def test_long_inputs_keep_few_kinds():
    rng = random.Random(1)
    machine = Composition(conversations.GRAMMAR)
    cost, audit = machine.shortest([Symbol(rng.choice("ua"), faulty=rng.random() < 0.1) for _ in range(200_000)])
    assert len(audit) >= 200_000 and cost > 0 and len(machine._kinds) < 2000


def plain(rows, damage=True):
    """Reports and repaired texts by the definition, one conversation after another."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20 if damage else 19
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], __import__("hashlib").md5(r[2].encode()).hexdigest()))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, symbols, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            symbols.append(Symbol(role[:1] or "?", must_go=fault in ("blank", "duplicate"), faulty=fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = brute(symbols) if len(symbols) < 7 else Composition(conversations.GRAMMAR).shortest(symbols)
        lines, rest = [], iter(kept)
        for letter in audit:
            want = "user" if not lines or lines[-1].split(":")[0][:1] in "sa" else "assistant"
            if letter == "I":
                lines.append(f"{want}:")
            else:
                _, role, text = next(rest)
                if letter in "KR":
                    lines.append(f"{role if letter == 'K' else want}:{text}")
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()), lines
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def sample(seed, n=150):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    texts = ["Hello there.", "What?", "cut off", " \t\n", "", None, "ends. ", "naïve 😀!", "a:b\nc."]
    rows = []
    for conv in [*range(n), None]:
        turns = [*range(rng.randrange(7)), *rng.choices([None, 0, 2, 40], k=rng.randrange(2))] or [1]
        rows += [(conv, t, rng.choice(roles), f"{rng.choice(texts)}" if rng.random() < 0.5 else f"own {conv} {t}.") for t in turns]
    rows = [(c, t, r, None if x == "None" else x) for c, t, r, x in rows]
    return rows + rng.choices(rows, k=20)


@pytest.mark.parametrize("seed", range(2))
def test_against_the_definition(spark, seed):
    rows = sample(seed)
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, audit int").repartition(7)
    made = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in conversations.repair_digests(table, conversations.damaged(table)).collect()}
    expected = {c: v for c, (v, _) in plain(rows).items()}
    assert made == expected


def test_messages_are_the_repaired_conversations(spark):
    rows = sample(7)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = {}
    for r in conversations.repaired_messages(table).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {c: x for c, (_, x) in plain(rows, damage=False).items() if x}


def test_everything_dropped_and_empty_tables(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:3".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 3, "user", "Yes.")], "conv_id long, turn long, role string, text string")
    [row] = conversations.repair_digests(table, conversations.damaged(table)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    assert conversations.repair_digests(table.limit(0), conversations.damaged(table.limit(0))).count() == 0


def test_one_long_conversation_with_long_texts_and_text_ids(spark):
    rows = [("one", i, "user" if i % 2 else "assistant", "x" * 3000 + f" {i}.") for i in range(3000)] + [("one", 5, "user", "again.")] * 5000
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    made = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in conversations.repair_digests(table).collect()}
    assert made == {c: v for c, (v, _) in plain(rows, damage=False).items()}
