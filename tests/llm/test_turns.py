"""Conversation repair against brute force, across tasks, and its edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

ROWS = "conv_id long, turn long, role string, text string, said string, slice int"


def harmed(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield conv, turn, "user" if kind == 4 else role, text, (0 if kind == 0 else 2 if kind == 3 else 1)


def judged(conv, rows):
    """[(role, text, fault)] in order, and the counts, without any matrix."""
    said = lambda r, x: hashlib.md5(f"{' ' if conv is None else conv}:{len(r)}:{r}{x}".encode()).digest()
    rows = sorted(rows, key=lambda r: ((0, 0) if r[0] is None else (1, r[0]), r[1].encode(), said(r[1], r[2])))
    seen, out = set(), []
    for _, role, text in rows:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append((role, text, "blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else ""))
        seen.add((role, text))
    first = [r[:1] for r, _, _ in out]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda k: sum(f == k for _, _, f in out)
    return out, (gaps, count("blank"), count("duplicate"), count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first)))


def cheapest(turns):
    """Dijkstra-like closure over whole audits: (cost, audit, repaired)."""
    after = lambda s, c: {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((c, s))

    def grown(ways):
        todo = list(ways)
        while todo:
            s = todo.pop()
            for role in ("user", "assistant"):
                to, (cost, audit, out) = after(s, role[0]), ways[s]
                if to is not None and (to not in ways or (cost + 5, audit + "I") < ways[to][:2]):
                    ways[to] = (cost + 5, audit + "I", [*out, f"{role}:"])
                    todo.append(to)
        return ways

    ways = grown({0: (0, "", [])})
    for role, text, fault in turns:
        new = {}

        def put(s, found, new=new):
            if s is not None and (s not in new or found[:2] < new[s][:2]):
                new[s] = found

        for s, (cost, audit, out) in ways.items():
            put(s, (cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                put(after(s, role[:1]), (cost + more, audit + "K", [*out, f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    put(after(s, other[0]), (cost + more + 1, audit + "R", [*out, f"{other}:{text}"]))
        ways = grown(new)
    return min((ways[s] for s in (0, 3) if s in ways), key=lambda x: x[:2])


def slow(rows):
    own = defaultdict(list)
    for conv, turn, role, text, copies in harmed(rows):
        own[conv] += [(turn, role, text)] * copies
    out = {}
    for conv, turns in own.items():
        told, counts = judged(conv, turns)
        cost, audit, lines = cheapest(told)
        out[conv] = (*counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def corpus(seed=4):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ugly"]
    texts = ["Yes.", "no", "Ok!", " \t", "", None, "été ?\n", "a. b", "…", "x" * 5000 + "."]
    rows = [(c, t if r.random() < 0.9 else None, r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"{c} {t} {r.random()}.") for c in range(60) for t in r.sample(range(40), r.randrange(1, 12))]
    rows += [(None, t, r.choice(roles), f"n{t % 5}.") for t in range(30)] + [(60, None, "user", "same.")] * 9 + [(61, t, "user", "again.") for t in range(50)]
    # One conversation has most of all rows, so that it spans many tasks.
    return rows + [(1000, t, r.choice(roles[:5]), r.choice(texts) if r.random() < 0.2 else f"turn {t}{r.choice('.?,')}") for t in range(2500)]


def report(spark, rows, monkeypatch=None):
    from plexgraph.llm import turns as m
    from plexgraph.llm._shared import stage

    bad = m.damaged(spark.createDataFrame([(*x, "", 0) for x in rows], ROWS).repartition(7))
    found = stage(m.reports(bad), "test-reports")
    return m, bad, found


@pytest.mark.parametrize("parts", [1, 23])
def test_every_conversation_equals_brute_force(spark, tmp_path, monkeypatch, parts):
    from plexgraph.llm import turns as m

    rows = corpus()
    spark.createDataFrame([(*x, "", 0) for x in rows], ROWS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(m, "CHUNK", 200)
    had = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r[0]: tuple(r)[1:] for r in m.op11_turns(spark, str(tmp_path)).collect()}
        if parts > 4:
            assert m.reports(m.damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet"))).where("conv_id = 1000 and size(pieces) > 3").count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", had[1])
    want = slow(rows)
    assert len(got) == len(want)
    for conv, row in want.items():
        assert got[conv] == row, conv


def test_repaired_turns_follow_the_pattern(spark):
    m, bad, found = report(spark, corpus(seed=9)[:400])
    own = defaultdict(list)
    for r in m.repaired(bad, found).collect():
        own[r.conv_id].append((r.nth, r.role, r.text, r.edit))
    audits = {r.conv_id: r.audit for r in found.collect()}
    for conv, turns in own.items():
        turns.sort()
        assert [t[0] for t in turns] == list(range(len(turns))) and re.fullmatch("s?(ua)+", "".join(t[1][:1] for t in turns))
        assert "".join(t[3] for t in turns) == audits[conv].replace("D", "") and all(t[2] == "" for t in turns if t[3] == "I")


def test_audits_are_least_among_all_that_repair():
    """Every audit of bounded length is tried on short conversations."""
    from plexgraph.llm.turns import finished, move, scanned

    def tried(kinds):
        best = None
        for inserts in itertools.product(range(4), repeat=len(kinds) + 1):
            for edits in itertools.product("DKR", repeat=len(kinds)):
                if any(g and e != "D" for (_, _, g), e in zip(kinds, edits, strict=True)):
                    continue
                slots = []
                for i, (initial, _, _) in enumerate(kinds):
                    slots += ["ua"] * inserts[i] + ([] if edits[i] == "D" else [initial] if edits[i] == "K" else ["ua"])
                slots += ["ua"] * inserts[-1]
                fits = any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in itertools.product(*slots)) if all(slots) else False
                if fits:
                    cost = 5 * sum(inserts) + sum({"D": 2, "K": 0, "R": 1}[e] + (5 if c and e != "D" else 0) for (_, c, _), e in zip(kinds, edits, strict=True))
                    audit = "".join("I" * inserts[i] + edits[i] for i in range(len(kinds))) + "I" * inserts[-1]
                    best = min(best or (cost, audit), (cost, audit))
        return best

    kinds = [("u", False, False), ("a", False, False), ("s", False, False), ("u", True, False), ("", False, False), ("", False, True)]
    for n in (1, 2, 3):
        for some in itertools.product(kinds, repeat=n):
            if n < 3 or zlib.crc32(repr(some).encode()) % 9 == 0:
                assert finished(scanned([move(*k) for k in some])) == tried(some), some


def test_products_are_associative_and_powers_equal_repetition():
    from plexgraph.llm.turns import IDENTITY, move, power, product, scanned

    r = random.Random(1)
    for _ in range(40):
        moves = [move(r.choice(["s", "u", "a", "t"]), r.random() < 0.3, r.random() < 0.2) for _ in range(r.randrange(1, 90))]
        cut = r.randrange(len(moves) + 1)
        line = IDENTITY
        for x in moves:
            line = product(line, x)
        assert line == scanned(moves) == product(scanned(moves[:cut]), scanned(moves[cut:]))
    gone = move("", False, True)
    assert power(gone, 37) == scanned([gone] * 37) and power(gone, 0) == IDENTITY


def test_small_tables(spark, tmp_path):
    from plexgraph.llm.turns import op11_turns

    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op11_turns(spark, f"{tmp_path}/none").collect() == []
    turn = next(t for t in range(500) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    spark.createDataFrame([(7, turn, "user", "x", "", 0)], ROWS).write.parquet(f"{tmp_path}/gone/conversations.parquet")
    assert [tuple(r) for r in op11_turns(spark, f"{tmp_path}/gone").collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
