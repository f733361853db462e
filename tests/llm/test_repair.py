import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from payerlens.llm import repair

SCHEMA = "conv_id bigint, turn int, role string, text string, place int, cost string, own_id int, fault string"
LANGUAGE = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
        out.append(
            "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Every way of edits in order of (cost, audit), without the grammar or its states."""
    heap = [(0, "", 0, ())]
    done = set()
    while True:
        cost, audit, i, turns = heapq.heappop(heap)
        roles = "".join(r[:1] or "-" for r, _ in turns)
        if i == len(rows) and LANGUAGE.fullmatch(roles):
            return cost, audit, turns
        if not re.match("(s?(ua)*u?)$", roles) or (i, roles) in done:
            continue
        done.add((i, roles))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*turns, (role, ""))))
        if i < len(rows):
            (role, text), mark = rows[i], marks[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, turns))
            if mark not in ("blank", "duplicate"):
                more = 3 if mark == "truncated" else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*turns, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, (*turns, (other, text))))


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [t for _, t, _, _ in own if t is not None]
        pairs = [r[2:] for r in own]
        marks = faults(pairs)
        initials = [r[:1] for r, _ in pairs]
        cost, audit, kept = cheapest(pairs, marks)
        out.append(
            (
                conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                *(marks.count(k) for k in ("blank", "duplicate", "truncated")),
                sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
                cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
            )
        )
    return out


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256")


def made(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(parts)


def got(df, **sizes):
    found = repair.report(df, *repair.repair(repair.damaged(df), **sizes))
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in found.collect())


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "What?", "cut off", "", " \n", None, "ends. \t", "é.", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "Sys", "used"]
    rows = []
    for conv in [None, *range(60)]:
        turn = rng.choice([0, 0, 3, -2])
        for _ in range(rng.randint(1, 9)):
            clean = rng.random() < 0.6
            role = ["user", "assistant"][turn % 2] if clean else rng.choice(roles)
            text = f"Turn {rng.randrange(10**6)}." if clean else rng.choice(texts)
            rows.append((conv, None if rng.random() < 0.05 else turn, role, text))
            turn += rng.choice([1, 1, 1, 1, 0, 3])
    return rows + rows[40:44]  # repeated rows


@pytest.mark.parametrize("sizes", [{}, {"span": 1, "fan": 1}])
def test_against_all_edits(spark, chats, sizes):
    assert got(made(spark, chats), **sizes) == sorted(map(repr, expected(chats)))


def test_long_conversation_over_partitions(spark):
    rng = random.Random(9)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice([f"t {i}.", f"t {i}", "again."])) for i in range(700)]
    rows += [(c, 0, "user", "Hi.") for c in range(40)]
    df = made(spark, rows, 5)
    assert got(df) == got(df, span=3, fan=2)
    edited = repair.repaired(*repair.repair(repair.damaged(df), span=3, fan=2)).where("conv_id = 7").collect()
    order = sorted(edited, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(order)))
    assert LANGUAGE.fullmatch("".join(r.role[0] for r in order))


def test_empty_table(spark):
    assert got(made(spark, [])) == []


def test_only_dropped_rows(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256().hexdigest()
    assert got(made(spark, [(dropped, 0, "user", "Hi.")])) == [repr((dropped, 0, 0, 0, 0, 0, 0, "", empty))]


def every_split(codes):
    """Plain CYK: every span by every split."""
    n = len(codes)
    chart = {(i, i + 1): repair.row_cells(c) for i, c in enumerate(codes)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best = [None] * 16
            for k in range(i + 1, i + length):
                both = repair.combined(chart[i, k], chart[k, i + length])
                best = [repair._least(x, y) for x, y in zip(best, both)]
            chart[i, i + length] = tuple(best)
    return chart[0, n]


@settings(max_examples=80, deadline=None)
@given(st.text("suaoSUAO0123", min_size=1, max_size=9))
def test_one_cut_is_every_cut(codes):
    assert repair.span_cells(codes) == every_split(codes)
