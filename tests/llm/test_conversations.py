import hashlib
import itertools
import random
import re
import zlib

import pytest
from helpers_llm import duck, rows, saved
from pyspark.sql import functions as F

from quillon.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def every_edit(symbols):
    """The least (cost, audit) of all strings of edits with up to three insertions, by trying each."""
    best = None
    for inserts in range(4):
        n = len(symbols) + inserts
        for places in itertools.combinations(range(n), inserts):
            for own in itertools.product("DKR", repeat=len(symbols)):
                audit, k = "", iter(own)
                for p in range(n):
                    audit += "I" if p in places else next(k)
                # what is put in or takes another role may be u or a, so all readings are tried
                for roles in itertools.product("ua", repeat=audit.count("I") + audit.count("R")):
                    out, cost, row, free = "", 0, iter(symbols), iter(roles)
                    for e in audit:
                        if e == "I":
                            out, cost = out + next(free), cost + 3
                            continue
                        s = next(row)
                        if e == "D":
                            cost += 4
                        elif s == "x":
                            cost += 10**6
                        else:
                            out += next(free) if e == "R" else s.lower()
                            cost += 3 * (e == "R") + 3 * s.isupper()
                    if GRAMMAR.fullmatch(out) and (best is None or (cost, audit) < best):
                        best = cost, audit
    return best


@pytest.mark.parametrize("symbols", ["", "u", "a", "s", "x", "o", "ua", "au", "suA", "uu", "ss", "sa", "aU", "xo", "uxa", "sso", "Uau", "aaa", "oxS", "uuaa"])
def test_least_edits_of_short_conversations(symbols):
    assert C.repaired(symbols) == every_edit(symbols)


def by_places(symbols):
    """The least (cost, audit) by a search over (row, what was said last); a second way for long conversations."""
    best = {"": (0, "")}

    def put(d, k, w):
        if k not in d or w < d[k]:
            d[k] = w

    def filled(d):
        for a, b in (("", "u"), ("s", "u"), ("a", "u"), ("u", "a"), ("a", "u")):
            if a in d:
                put(d, b, (d[a][0] + 3, d[a][1] + "I"))
        return d

    best = filled(best)
    for s in symbols:
        after = {}
        for k, (c, a) in best.items():
            put(after, k, (c + 4, a + "D"))
            if s != "x":
                for to in ("s", "u", "a"):
                    if {"s": k == "", "u": k in ("", "s", "a"), "a": k == "u"}[to]:
                        more = 3 * s.isupper()
                        if s.lower() == to:
                            put(after, to, (c + more, a + "K"))
                        elif to != "s":
                            put(after, to, (c + 3 + more, a + "R"))
        best = filled(after)
    return min(best[k] for k in ("", "a") if k in best)


def test_random_conversations_and_blocks():
    rng = random.Random(5)
    for n in [*range(1, 60), 300]:
        for _ in range(8 if n < 100 else 2):
            symbols = "".join(rng.choice("suaoxUAS" if n % 2 else "uauaux") for _ in range(n))
            want = by_places(symbols)
            assert C.repaired(symbols) == want
            for size in (1, 3, 17):
                cut = [symbols[k : k + size] for k in range(0, n, size)]
                assert C.composed([C.ways(b, k == 0) for k, b in enumerate(cut)]) == want


def brute(made):
    """The report of each conversation, row by row."""
    out = []
    shown = lambda v: " " if v is None else str(v)
    for conv in {r[0] for r in made}:
        own = []
        for _, turn, role, text in (r for r in made if r[0] == conv):
            role, text = shown(role), shown(text)
            kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        n, symbols = {"blank": 0, "duplicate": 0, "truncated": 0}, ""
        for k, (_, role, text) in enumerate(own):
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in [r[1:] for r in own[:k]] else "truncated" if solid[-1] not in ".!?" else None
            if fault:
                n[fault] += 1
            s = "x" if fault in ("blank", "duplicate") else role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += s.upper() if fault == "truncated" else s
        turns = {r[0] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = by_places(symbols)
        said, k = [], 0
        for e in audit:
            want = "user" if not said or said[-1][0][:1] != "u" else "assistant"
            if e == "I":
                said.append((want, ""))
                continue
            if e != "D":
                said.append((own[k][1] if e == "K" else want, own[k][2]))
            k += 1
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest()
        out.append((audit, n["blank"], conv, cost, n["duplicate"], gaps, illegal, digest, n["truncated"]))
    return sorted(out, key=repr)


def talk(conv, n, seed=0):
    rng = random.Random(conv * 97 + seed)
    roles = ["system"] * (conv % 3 == 0) + ["user", "assistant"] * n
    return [(conv, k, roles[k] if rng.random() < 0.8 else rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No! ", "cut off", "Why?\n", "x."]) + (str(k) if rng.random() < 0.5 else "") + rng.choice([".", "", "."])) for k in range(n)]


ODD = [
    (1, None, "user", "Null turn."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Same turn."), (1, 3, None, "No role."), (1, 5, "assistant", None), (1, 5, "assistant", None),
    (2, None, None, None), (None, 1, "user", "Whose?"), (None, None, "assistant", "Mine."), (None, 2, "user", "é😀."), (3, 1, "s", " \t\n"), (4, 7, "Über", "\x00 "),
]
MADE = [*ODD, *[r for c in range(10, 60) for r in talk(c, c % 9)], *talk(70, 90), *talk(71, 64), *[(72, k, "user", "Same.") for k in range(70)]]


@pytest.mark.parametrize("limits", [{}, {"long_rows": 8, "block": 5}, {"long_bytes": 100, "block": 1024}, {"long_rows": 0, "block": 1}])
def test_reports_of_short_and_long_conversations(spark, limits):
    df = spark.createDataFrame(MADE, SCHEMA).withColumns({"at": F.lit(1), "block": F.lit("x"), "gone": F.lit(1), "_conv": F.lit(2)})
    assert rows(C.repair(C.damaged(df), **limits)) == brute(MADE)


def test_query_against_sql(spark, tmp_path):
    df = spark.createDataFrame(MADE, SCHEMA)
    assert rows(C.op12_conversations(spark, saved(df, tmp_path, "conversations"))) == duck(C.SQL, conversations=df)


def test_empty_table_and_very_long_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damaged(none)).collect() == [] and C.repair(C.damaged(none), 0).collect() == []
    made = [(1, k, "user" if k % 2 == 0 else "assistant", "word " * 200_000 + "end.") for k in range(6)]
    for limits in ({}, {"long_bytes": 10**9}):
        assert rows(C.repair(C.damaged(spark.createDataFrame(made, SCHEMA)), **limits)) == brute(made)


def test_a_conversation_with_all_rows(spark):
    """30,000 rows of one conversation go through blocks, not through one task's list."""
    made = [(9, k, ("user", "assistant", "system")[k % 2 if k % 50 else 2], f"Row {k}." if k % 7 else "again.") for k in range(30_000)]
    got = C.repair(C.damaged(spark.createDataFrame(made, SCHEMA))).collect()
    assert len(got) == 1 and len(got[0].audit) > 29_000 and got[0].duplicate > 4_000
