"""Repair and prefix trie of conversations against plain loops, with odd rows and long conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from eddyline.llm import repair, trie
from tests.conftest import DATA

SCHEMA = "conv_id long, turn long, role string, text string"
CONVERSATIONS = f"{DATA}/sf0.001/conversations.parquet"


def digest(*parts):
    return hashlib.md5("".join(parts).encode()).digest()


def plain_repair(rows):
    """gaps, faults, illegal, cost, audit and hash of damaged rows (turn, role, text) in order: every state's best after each row."""
    seen, facts, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.strip(" \t\n\r\x0b\x0c")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        facts.append((role[:1], fault))
        if fault:
            counts[fault] += 1
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
    turns = [t for t, *_ in rows if t is not None]
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    full = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        for _ in range(6):
            for state, r in [(s, r) for s in list(best) for r in "ua" if (s, r) in step]:
                cost, audit, lines = best[state]
                keep(best, step[state, r], (cost + 3, audit + "I", (*lines, (full[r], ""))))
        return best

    def keep(best, state, found):
        if state not in best or found[:2] < best[state][:2]:
            best[state] = found

    best = with_inserts({0: (0, "", ())})
    for (initial, fault), (_, role, text) in zip(facts, rows, strict=True):
        new = {}
        for state, (cost, audit, lines) in best.items():
            keep(new, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            if (state, initial) in step:
                keep(new, step[state, initial], (cost + more, audit + "K", (*lines, (role, text))))
            for r in "ua":
                if (state, r) in step:
                    keep(new, step[state, r], (cost + 3 + more, audit + "R", (*lines, (full[r], text))))
        best = with_inserts(new)
    cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()


def plainly_repaired(rows):
    by_id = defaultdict(list)
    for c, t, r, x in rows:
        mine = by_id[c]
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        if code:
            x = "" if code == 1 else re.sub(r"[.!?]", "", x) if code == 2 else x
            mine += [(t, "user" if code == 4 else r, x)] * (2 if code == 3 else 1)
    order = lambda c: lambda z: (z[0] is not None, z[0] or 0, z[1], digest(f"{' ' if c is None else c}:{len(z[1])}:{z[1]}:{z[2]}"))
    return {c: plain_repair(sorted(mine, key=order(c))) for c, mine in by_id.items()}


def odd_rows(seed=1, ids=60):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!", "no", "what?", " ", "", None, "a b c.", "A \t", "long text. ok? ", "é" * 9, "x" * 100_000 + "!"]
    return [(c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for c in [*range(ids), None] for t in range(rng.randint(1, 9))]


def repaired(spark, rows, shares=None):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("copies", "digest", "kind")})
    got = repair.repaired(df, repair.damaged(df), shares).collect()
    assert len(got) == len({r[0] for r in got})
    return {r[0]: tuple(r[1:]) for r in got}


@pytest.mark.parametrize("shares", [None, 5])
def test_repairs_are_the_cheapest(spark, shares):
    rows = odd_rows()
    assert repaired(spark, rows, shares) == plainly_repaired(rows)


@pytest.mark.parametrize("shares", [1, 6])
def test_a_long_conversation_is_repaired_in_stretches(spark, monkeypatch, shares):
    monkeypatch.setattr(repair, "STRETCH", 37)
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"x{rng.randint(0, 400)}.", f"y{t}", "same."])) for t in range(1500)] + odd_rows(9, 5)
    rows += [(8, 1, "user", "Again and again.")] * 700
    assert repaired(spark, rows, shares) == plainly_repaired(rows)


def test_stretches_join_to_the_whole():
    rng = random.Random(3)
    facts = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(60)]
    whole = repair.lightest(facts, repair.START, repair.ENDS)
    for cut in (1, 17, 59):
        left = repair.lightest(facts[:cut], repair.START, repair.NEXT)
        right = {s: repair.lightest(facts[cut:], s, repair.NEXT) for s in repair.NEXT}
        both = repair.joined(left, right)
        assert {e: both[e] for e in repair.ENDS} == whole


def test_small_cases_of_repair():
    fine = repair.lightest([("s", False, False), ("u", False, False), ("a", False, False)], repair.START, repair.ENDS)
    assert min(fine.values()) == (0, "KKK")
    assert min(repair.lightest([("u", False, False)], repair.START, repair.ENDS).values()) == (3, "KI")
    assert min(repair.lightest([("u", True, False)], repair.START, repair.ENDS).values()) == (4, "D")
    assert min(repair.lightest([], repair.START, repair.ENDS).values()) == (0, "")
    assert min(repair.lightest([("u", False, True)], repair.START, repair.ENDS).values()) == (4, "D")


def test_repair_query_and_empty_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(CONVERSATIONS).select("conv_id", "turn", "role", "text").collect()]
    got = repair.op12_repair(spark, f"{DATA}/sf0.001")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == plainly_repaired(rows)
    assert repaired(spark, []) == {}
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, r, digest(f"{len(r)}:{r}{x}"), x))
    own = {c: [(z[2], z[4]) for z in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = (*own.get(c - c % 20, [])[:h], *mine[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        mine, below = members[p], children[p]
        own_tokens = (len(mine) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        sums[p] = (sum(sums[k][0] for k in below) if below else 1, own_tokens + sum(sums[k][1] for k in below))
        ids = ",".join(str(c) for c in sorted(mine) if len(full[c]) == len(p))
        out.append((min(mine), len(p), min(members[p[:-1]]) if p else None, len(mine), len(below), *sums[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def grown(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("pos", "n", "depth", "t0")})
    return sorted((tuple(r) for r in trie.trie(df).collect()), key=str)


def test_prefixes_of_odd_rows(spark):
    rows = odd_rows(2, 70)
    assert grown(spark, rows) == plain_trie(rows)
    assert grown(spark, []) == []


def test_prefixes_of_long_conversations_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "GROUP", 2)  # read where plans are made
    deep = [(100 + c, t, "user", f"t{t}" if t < 150 - c else f"u{c} {t}") for c in range(30) for t in range(120 - 3 * c)]
    copies = [(1000 + c, t, "user", f"same {t}") for c in range(60) for t in range(3)]
    rows = deep + copies + [(5, 1, "user", "again")] * 50
    assert grown(spark, rows) == plain_trie(rows)


def test_a_nodes_ids_come_in_pieces(spark):
    rows = [(c, 0, "user", "hello") for c in range(20, 9000)]
    assert grown(spark, rows) == plain_trie(rows)


def test_trie_query_and_its_sql(spark):
    got = sorted((tuple(r) for r in trie.op13_trie(spark, f"{DATA}/sf0.001").collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(CONVERSATIONS).select("conv_id", "turn", "role", "text").collect()]
    assert got == plain_trie(rows)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{CONVERSATIONS}'")
        assert sorted(con.execute(trie.SQL).fetchall(), key=str) == got
