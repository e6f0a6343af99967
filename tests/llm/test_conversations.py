"""Conversation repair and chat formatting against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import chat, repair

ROWS = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes?"), (1, 1, "assistant", "Yes?"), (1, 3, "user", "no end"), (1, None, "system", "Be nice."), (2, 5, None, None), (2, 5, "tool", "x!"),
    (None, 0, "user", "a."), (None, 0, "user", "a."), (3, 0, "assistant", ""), (4, 7, "", "Ok."), (4, 8, "system", "Ok.\n \t"), (4, 8, "system", "日本。"), (5, None, "user", "A."), (5, None, "assistant", "B!"), (6, 2**40, "user", "x" * 5000 + "."),
]


def search(sig):
    """Cheapest edits of a signature, by uniform-cost search over all of them."""
    fits, start = re.compile(r"(s?(ua)+)?$"), re.compile(r"(s?(ua)*u?)?$")
    heap, found = [(0, "", 0, "")], None
    while heap:
        cost, edits, i, out = heapq.heappop(heap)
        if found and cost > found[0]:
            return found
        if i == len(sig) and fits.match(out) and (found is None or (cost, edits) < found):
            found = cost, edits, out
        ways = [(3, "I", 0, r) for r in "ua"]
        if i < len(sig):
            c = sig[i]
            ways.append((4, "D", 1, ""))
            if c.lower() in "suax":
                ways += [(3 * c.isupper(), "K", 1, c.lower()), *((3 + 3 * c.isupper(), "R", 1, r) for r in "ua")]
        for more, e, n, r in ways:
            if start.match(out + r) and len(out) < 2 * len(sig) + 3:
                heapq.heappush(heap, (cost + more, edits + e, i + n, out + r))


def plain(rows, ids):
    out = set()
    for c in ids:
        own = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for cc, t, r, x in rows if cc == c))
        seen, sig = set(), ""
        for _, _, r, x in own:
            k = "suax".index(r[:1]) if r[:1] and r[:1] in "sua" else 3
            end = x.rstrip(" \t\n\x0b\x0c\r")
            sig += ("0123" if not end else "4567" if (r, x) in seen else "suax" if end[-1] in ".!?" else "SUAX")[k]
            seen.add((r, x))
        turns = [t for known, t, *_ in own if known]
        cost, edits, roles = search(sig)
        texts, at, place = [], 0, 0
        for e in edits:
            if e in "KRI":
                role = {"s": "system", "u": "user", "a": "assistant"}[roles[place]] if e != "K" else own[at][2]
                texts.append(f"{role}:{own[at][3] if e != 'I' else ''}")
                place += 1
            at += e != "I"
        initials = [r[2][:1] for r in own]
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        count = lambda s: sum(map(sig.count, s))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.add((c, gaps, count("0123"), count("4567"), count("SUAX"), pairs, cost, edits, hashlib.sha256("\n".join(texts).encode()).hexdigest()))
    return out


def reported(spark, rows, ids=None):
    df = spark.createDataFrame(rows, ROWS).withColumns({"at": F.lit(1), "edit": F.lit("x"), "symbol": F.lit(None).cast("int")})
    return {tuple(r) for r in repair.report(df, spark.createDataFrame([(i,) for i in ids], "conv_id long") if ids else df).collect()}


def test_repair_of_odd_rows(spark):
    assert reported(spark, ODD) == plain(ODD, {r[0] for r in ODD})
    assert reported(spark, ODD[:1], [1, 9]) == plain(ODD[:1], [1, 9])
    assert reported(spark, []) == set()


def test_repair_against_search(spark, monkeypatch):
    monkeypatch.setattr(repair, "RUN", 2)  # plans are cut into runs
    r = random.Random(2)
    rows = [(c, r.randrange(9), r.choice(["user", "assistant", "assistant", "system", "tool"]), r.choice(["A.", "B!", "", "open", f"{c}?"])) for c in range(150) for _ in range(r.randrange(1, 7))]
    assert reported(spark, rows) == plain(rows, {c for c, *_ in rows})


def test_layers_of_shared_starts_are_made_once():
    trie = repair.Trie()
    for s in sorted(["ua", "uau", "uaua", "uauA", "usa", "x" * 9]):
        cost, edits, plan = trie.solve(s)
        assert (cost, edits) == search(s)[:2] and len(plan) == len(s) + 1
    assert trie.made == len("uaua") + len("A") + len("sa") + 9


def test_long_conversation_is_repaired(spark):
    n = 3000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(n)]
    own = repair.ordered(spark.createDataFrame(rows, ROWS))
    each = repair.solved(own)
    got = each.first()
    assert (got.cost, got.audit) == (0, "K" * n) and len(got.runs) >= n // repair.RUN
    back = repair.repaired(own, each).orderBy("at", "place").collect()
    assert [(b.role, b.text) for b in back] == [r[2:] for r in rows]


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    got = sorted(map(tuple, repair.damaged(spark.createDataFrame(rows, ROWS)).collect()), key=str)
    want = []
    for c, t, r, x in rows:
        r, x = r or " ", x or " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [] if k == 0 else [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (1 + (k == 3))
    assert got == sorted(want, key=str)


TEXTS = ["", "Hi there", chat.PROBE, "### User:### User:</turn>\\", "\\\\", "<|endoftext|> é ß\n日本語\t ", " \x00  ", "### Role:tool</role>x", "\\" * 7 + "</turn>", "long " * 4000, "Ω" * 9000]


def test_turns_come_back(spark):
    rows = [(i % 3 if i % 5 else None, i % 4 if i % 7 else None, r, x) for i, (r, x) in enumerate((r, x) for r in ("user", "assistant", "system", "tool", "### User:", "Assistant", "", None) for x in (*TEXTS, None))]
    df = spark.createDataFrame(rows, ROWS).withColumn("ids", F.lit(1)).withColumn("formatted", F.lit("x"))
    made = chat.format_turns(df)
    first = chat.opened(chat.vocabulary_path(chat.VOCABULARY))[1]
    key = lambda r: tuple((x is not None, x or 0) for x in r[:2]) + r[2:4]
    got = sorted((tuple(r) for r in chat.read_back(made).collect()), key=key)
    plain = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=key)
    assert [r[:4] for r in got] == plain
    assert all(g[4] == (g[3] or None if g[2] == "assistant" else None) for g in got)
    for r in made.collect():
        assert sum(i >= first for i in r.ids) == (2 if r.role in chat.HEADS else 3) and len(r.ids) == len(r.loss_mask)
        inner = re.sub(r"\\.", "", r.formatted, flags=re.S)
        assert sum(inner.count(x) for x in chat.CONTROLS) == (2 if r.role in chat.HEADS else 3)
    starts = {}
    for r in sorted(made.collect(), key=lambda r: (key(r), r.start)):
        assert r.start == starts.get(r.conv_id, 0)
        starts[r.conv_id] = r.start + len(r.ids)


@pytest.mark.parametrize("rows", [ODD, [], [(1, 0, "user", "x")]])
def test_chat_summary(spark, rows):
    got = {tuple(r) for r in chat.summary(spark.createDataFrame(rows, ROWS)).collect()}
    want = set()
    for c in {r[0] for r in rows}:
        own = sorted((t is not None, t or 0, r or "", x or "") for cc, t, r, x in rows if cc == c)
        mark = lambda x: re.sub(chat._MARKED, lambda m: "\\" + m[0], x)
        shown = "".join((chat.HEADS.get(r) or f"### Role:{mark(r)}</role>") + mark(x) + "</turn>" for *_, r, x in own)
        loss = "".join(x for *_, r, x in own if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.add((c, len(own), digest("".join(f"{r}\n{x}\n" for *_, r, x in own)), digest(loss), len(loss), len(shown)))
    assert got == want
