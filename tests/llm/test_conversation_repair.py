"""Conversation repair against a search through all edit sequences."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from bridgerec.llm import conversation_repair as cr
from bridgerec.llm.queries import op12_conversation_repair, table
from bridgerec.llm.staging import Stage, ship_package

LEGAL = re.compile(r"(s?(ua)+)?")
DDL = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        kept += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        tail = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not tail:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if tail[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found, most=3):
    """(cost, audit) by trying all edits of each row and up to ``most`` inserts anywhere."""
    n, best = len(rows), None
    choices = []
    for (_, role, _), f in zip(rows, found, strict=True):
        own = [("D", 2, "")]
        if f not in ("blank", "duplicate"):
            extra = 5 if f == "truncated" else 0
            own += [("K", extra, role[:1] or "?"), ("R", 1 + extra, "u"), ("R", 1 + extra, "a")]
        choices.append(own)
    for many in range(most + 1):
        for places in itertools.combinations_with_replacement(range(n + 1), many):
            for roles in itertools.product("ua", repeat=many):
                for picks in itertools.product(*choices):
                    letters = result = ""
                    cost = 5 * many + sum(p[1] for p in picks)
                    if best is not None and cost > best[0]:
                        continue
                    for at in range(n + 1):
                        for place, role in zip(places, roles, strict=True):
                            if place == at:
                                letters, result = letters + "I", result + role
                        if at < n:
                            letters, result = letters + picks[at][0], result + picks[at][2]
                    if LEGAL.fullmatch(result) and (best is None or (cost, letters) < best):
                        best = (cost, letters)
    return best


def repaired(rows, audit):
    state, out, rows = "", [], iter(rows)
    for letter in audit:
        if letter == "D":
            next(rows)
            continue
        _, role, text = (None, "", "") if letter == "I" else next(rows)
        if letter != "K":
            role = "assistant" if state == "u" else "user"
        state = role[0]
        out.append(f"{role}:{text}")
    return out


def expected(conv, rows, solve=cheapest):
    found = faults(rows)
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    cost, audit = solve(rows, found)
    return (
        conv,
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        cost,
        audit,
        hashlib.sha256("\n".join(repaired(rows, audit)).encode()).hexdigest(),
    )


def key(r):
    return tuple((x is not None, x) for x in r)


def run(spark, rows):
    ship_package(spark)
    frame = spark.createDataFrame(rows, DDL)
    return sorted(map(tuple, cr.conversation_repair(cr.damaged(frame), Stage(spark, "t")).collect()), key=key)


@pytest.mark.parametrize("seed", range(2))
def test_all_edits_of_short_conversations(spark, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    texts = ["Hi.", "Yes!", "no end", "", None, " \t", "Why? ", "Hi.", "more."]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 3 if conv % 3 else 4)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None, 1]), rng.choice(roles), rng.choice(texts)))
    want = sorted((expected(c, r) for c, r in damage(rows).items()), key=key)
    assert run(spark, rows) == want


def dynamic(rows, found):
    """(cost, audit) by carrying the best (cost, audit) of every prefix and state."""
    start = {"": (0, "")}
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserts(now):
        for _ in range(3):
            for s, (c, x) in list(now.items()):
                t, new = step[s], (c + 5, x + "I")
                now[t] = min(now.get(t, new), new)
        return now

    now = inserts(start)
    for (_, role, _), f in zip(rows, found, strict=True):
        new = {}
        for s, (c, x) in now.items():
            ways = [(s, c + 2, x + "D")]
            if f not in ("blank", "duplicate"):
                extra = 5 if f == "truncated" else 0
                if role[:1] == step[s] or (s, role[:1]) == ("", "s"):
                    ways.append((role[0], c + extra, x + "K"))
                ways.append((step[s], c + 1 + extra, x + "R"))
            for t, cost, letters in ways:
                new[t] = min(new.get(t, (cost, letters)), (cost, letters))
        now = inserts(new)
    return min(v for s, v in now.items() if s in ("", "a"))


def test_long_runs_of_one_symbol(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(6):
        turn = 0
        while turn < 900:
            role, many = rng.choice(["user", "assistant", "system"]), rng.choice([1, 2, 700])
            for _ in range(many):
                rows.append((conv, turn, role, f"text {turn}."))
                turn += 1
    want = sorted((expected(c, r, dynamic) for c, r in damage(rows).items()), key=key)
    assert run(spark, rows) == want


def test_powers_and_halves_agree_with_single_rows():
    for symbol in range(9):
        for length in (1, 2, 3, 700):
            once, twice = cr.audit_of([[symbol, length]]), cr.audit_of([[symbol, 1]] * length)
            assert once == twice


def test_texts_over_the_bound_are_streamed(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"w{t} " * 40 + ".") for c in (1, 2, None) for t in range(30)]
    rows += [(8, 0, "user", "a."), (9, 0, "user", "b." * 9000)]
    want = sorted((expected(c, r, dynamic) for c, r in damage(rows).items()), key=key)
    ship_package(spark)
    marked, stage = cr.damaged(spark.createDataFrame(rows, DDL)), Stage(spark, "t")
    assert sorted(map(tuple, cr.conversation_repair(marked, stage, held=2000).collect()), key=key) == want
    assert spark.read.parquet(stage.path("found")).filter("repaired_sha256 is null").count() == 4
    assert run(spark, rows) == want


def test_repaired_rows_are_what_is_hashed(spark):
    rows = [(c, t, random.Random(c * 50 + t).choice(["user", "assistant", "system"]), f"t{t}" + "." * (t % 3)) for c in range(20) for t in range(12)]
    ship_package(spark)
    marked = cr.damaged(spark.createDataFrame(rows, DDL))
    found = Stage(spark, "t").write(cr.conversation_repair(marked, Stage(spark, "t")), "found")
    lines = {}
    for r in sorted(cr.repaired_rows(marked, found).collect(), key=lambda r: (r.conv_id, r.position)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_defined_cases(spark):
    assert run(spark, []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, [(gone, 0, "user", "x.")]) == [empty]
    nulls = [(None, None, None, None), (None, None, "user", None), (3, None, None, "x.")]
    assert run(spark, nulls) == sorted((expected(c, r) for c, r in damage(nulls).items()), key=key)
    more = spark.createDataFrame([(1, 1, "user", "x.", "c", 3, True)], DDL + ", audit string, copy int, dropped boolean")
    assert cr.conversation_repair(cr.damaged(more), Stage(spark, "t")).collect()[0].audit in ("KI", "D", "DD")


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    ship_package(spark)
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = sorted((expected(c, r, dynamic) for c, r in damage(rows).items()), key=key)
    assert sorted(map(tuple, op12_conversation_repair(spark, folder).collect()), key=key) == want
