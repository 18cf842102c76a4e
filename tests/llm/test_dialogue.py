import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chronofact.llm import dialogue, role_grammar

LEGAL = re.compile("(s?(ua)+)?")
CODES = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", " ", ""]), st.sampled_from(["", "", "b", "d", "t"])), max_size=4)


def brute(rows, inserts=2):
    """Every choice of edits, with up to two insertions at each place; the least (cost, audit)."""
    best = None
    gaps = [("I" * n, roles) for n in range(inserts + 1) for roles in itertools.product("ua", repeat=n)]
    choices = []
    for initial, fault in rows:
        held = [] if fault in ("b", "d") else [("K", initial, 0), ("R", "u", 1), ("R", "a", 1)]
        choices.append([("D", "", 2), *[(e, r, c + (5 if fault == "t" else 0)) for e, r, c in held]])
    for picked in itertools.product(*choices):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            shown = "".join("".join(g[1]) + (p[1] or ("?" if p[0] == "K" else "")) for g, p in zip(between, picked, strict=False)) + "".join(between[-1][1])
            if LEGAL.fullmatch(shown):
                cost = sum(p[2] for p in picked) + 5 * sum(len(g[0]) for g in between)
                audit = "".join(g[0] + p[0] for g, p in zip(between, picked, strict=False)) + between[-1][0]
                best = min(best or (cost, audit), (cost, audit))
    return best


@settings(max_examples=60, deadline=None)
@given(CODES.filter(lambda rows: len(rows) <= 3))
def test_least_edits_equal_brute_force(rows):
    assert dialogue.whole_path(tuple(rows))[:2] == brute(rows)


def test_tables_accept_the_role_pattern():
    stacks = role_grammar.Stacks(role_grammar.Grammar())
    for n in range(8):
        for roles in itertools.product("sua", repeat=n):
            front = {0}
            for role in roles:
                front = {t for f in front for t in stacks.advance(f, role)}
            accepted = any(stacks.advance(f, role_grammar.END) for f in front)
            assert accepted == bool(LEGAL.fullmatch("".join(roles)))


def test_ambiguous_grammars_keep_all_parses():
    """Both readings of a turn stay on the stack until the end decides."""
    stacks = role_grammar.Stacks(role_grammar.Grammar((("C", ("A", "x")), ("C", ("B", "y")), ("A", ("u",)), ("B", ("u",)))))
    for last in "xy":
        front = {t for f in stacks.advance(0, "u") for t in stacks.advance(f, last)}
        assert any(stacks.advance(f, role_grammar.END) for f in front)
    both = role_grammar.Stacks(role_grammar.Grammar((("C", ("A",)), ("C", ("B",)), ("A", ("u",)), ("B", ("u",)))))
    assert all(both.advance(f, role_grammar.END) for f in both.advance(0, "u"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x"]), st.sampled_from(["", "", "", "b", "d", "t"])), max_size=60))
def test_parsing_as_rows_come_equals_parsing_whole(rows):
    out = []
    for whole, agree in ((1_000, 1_000), (1, 3), (5, 7)):
        dialogue.WHOLE, dialogue.AGREE, emitted = whole, agree, []
        one = dialogue.Conversation(1, emitted)
        for n, (initial, fault) in enumerate(rows):
            one.add(n, initial, f"t{n}", initial, fault)
        out.append((one.finish(), emitted))
    dialogue.WHOLE, dialogue.AGREE = 64, 128
    assert out[0] == out[1] == out[2]


def test_long_conversations_hold_little(monkeypatch):
    rng, held = random.Random(1), []
    one = dialogue.Conversation(1, None)
    for n in range(40_000):
        role = rng.choice(["user", "assistant", "assistant", "tool"])
        one.add(n, role, "text", role[0], rng.choice(["", "", "b", "d", "t"]))
        held.append(len(one.rows))
    assert max(held) < 1_000
    found = one.finish()
    assert len(found[7]) >= 40_000 and found[6] > 0


def plain(rows):
    """Summary and repaired turns of one conversation's rows (turn, role, text), by the contract's words."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        codes.append((role[:1], fault))
    cost, audit, roles = dialogue.whole_path(tuple(codes))
    at, shown = 0, []
    for edit, initial in zip(audit, roles, strict=True):
        _, role, text = (None, "", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit != "D":
            role = role if edit == "K" else {"u": "user", "a": "assistant"}[initial]
            shown.append(f"{role}:{text}")
    assert LEGAL.fullmatch("".join(s[:1] for s in shown))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults = [sum(f == x for _, f in codes) for x in "bdt"]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(codes))
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(shown).encode()).hexdigest()), shown


ODD = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 1, "user", "Hi?"), (1, None, "assistant", "First."), (1, 9, None, "no role."),
       (2, 0, "user", None), (2, 1, "user", " \t\n"), (3, None, None, None), (None, 0, "user", "A?"), (None, 1, "assistant", "B"), (None, 1, "user", "C."),
       (4, 5, "user", "word " * 200_000 + "end."), (4, 7, "assistant", "Fine."), (5, 0, "", "empty role."), (6, 2, "user", "Ends. \n"),
       *[(7, n, ("user", "assistant")[n % 2], f"turn {n % 50}.") for n in range(400)]]


def test_odd_rows_equal_plain_code(spark):
    random.Random(3).shuffle(ODD)
    turns = spark.createDataFrame([(*r, "x", 1) for r in ODD], "conv_id int, turn int, role string, text string, audit string, _seen int")
    got = {r["conv_id"]: tuple(r)[1:] for r in dialogue.summarise(turns).collect()}
    want = {c: plain([(t, " " if r is None else r, " " if x is None else x) for k, t, r, x in ODD if k == c]) for c in {r[0] for r in ODD}}
    assert got == {c: w[0] for c, w in want.items()}
    repaired = dialogue.repaired_turns(turns).collect()
    for c, (_, shown) in want.items():
        assert [f"{r['role']}:{r['text']}" for r in sorted((r for r in repaired if r["conv_id"] == c), key=lambda r: r["place"])] == shown
    assert dialogue.summarise(turns.limit(0)).count() == dialogue.repaired_turns(turns.limit(0)).count() == 0


def test_damage_and_lost_conversations(spark):
    rows = [(k, t, ("user", "assistant")[t % 2], f"Text {t}! ok.") for k in range(60) for t in range(3)] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    got = {r["conv_id"]: tuple(r)[1:] for r in dialogue.summarise(dialogue.damage(turns), times=F.col("times")).collect()}
    assert got == {c: plain(r)[0] for c, r in kept.items()}
    gone = dialogue.summarise(turns.where("conv_id < 2").withColumn("n", F.lit(0)), times=F.col("n")).collect()
    assert [tuple(r)[1:] for r in gone] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 2


@pytest.mark.parametrize("rows", [3_000])
def test_one_conversation_owns_a_third(spark, rows):
    turns = [(0 if n % 3 == 0 else n, n, ("user", "assistant")[n // 3 % 2], f"t{n}.") for n in range(rows)]
    found = {r["conv_id"]: r for r in dialogue.summarise(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert len(found) == 1 + rows - len(range(0, rows, 3))
    assert (found[0]["cost"], found[0]["audit"]) == (0, "K" * 1_000)
