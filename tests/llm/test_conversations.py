"""Repaired conversations against a plain table of least costs, and blocks of every size."""

import hashlib
import random
import re
import zlib

import pytest

from postmill.llm import conversations
from postmill.llm.conversations import conversation_audits, repair_conversations, repaired_turns
from postmill.llm.queries import repaired

SCHEMA = "conv_id long, turn long, role string, text string, turn_ int, role_ string, n int, part int, key_ string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        fate, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def least(turns):
    """(cost, audit, lines) by a table over (turns left, state), every edit tried."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    after: dict = {q: (0, "", ()) if q in ("", "a") else None for q in ("", "s", "u", "a")}
    for i in range(len(turns), -1, -1):
        table = dict(after) if i == len(turns) else {}
        if i < len(turns):
            role, text, must, cut = turns[i]
            for q in ("", "s", "u", "a"):
                options = []
                if after[q]:
                    options.append((after[q][0] + 4, "D" + after[q][1], after[q][2]))
                if not must:
                    for cost, letter, name in ((0, "K", role), (3, "R", "user"), (3, "R", "assistant")):
                        to = moves.get((q, name[:1]))
                        if to is not None and after[to]:
                            options.append((cost + 3 * cut + after[to][0], letter + after[to][1], (f"{name}:{text}", *after[to][2])))
                table[q] = min(options) if options else None
        for _ in range(3):
            for q in ("", "s", "u", "a"):
                for name in ("user", "assistant"):
                    to = moves.get((q, name[0]))
                    if to is not None and table.get(to):
                        found = (3 + table[to][0], "I" + table[to][1], (f"{name}:", *table[to][2]))
                        table[q] = found if not table.get(q) else min(table[q], found)
        after = table
    return after[""]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = damage([r for r in rows if r[0] == conv])
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
        seen, faults, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [x[0] for x in turns if x[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, lines = least(marked)
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, conversations_, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "Well?", "So!", "a b c", "é漢.", None]
    rows = []
    for conv in range(conversations_):
        turn = 0
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "under", "User"])
            rows.append((conv if conv else None, turn if rng.random() > 0.05 else None, role, rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}."))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [512, 4, 1])
def test_repairs_equal_a_table_of_least_costs(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "TURNS", block)
    rows = random_rows(block, 60, 14)
    rows += [(900, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(300)] + [(901, 1, "user", "Same.")] * 40 + [(902, i, "user", "Same.") for i in range(40)]
    rows += [(903, 1, "user", "word " * 30_000 + "."), (903, 2, "assistant", "long " * 30_000)]
    want = expected(rows)
    got = {r.conv_id: tuple(r)[1:] for r in repaired(frame(spark, rows)).collect()}
    assert got == want


def test_a_conversation_with_a_third_of_all_turns_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "TURNS", 64)
    rows = [(7, i, ("user", "assistant")[i % 2] if i % 11 else "tool", f"Turn {i}." if i % 5 else "again") for i in range(3000)] + random_rows(2, 500, 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pieces = repair_conversations(frame(spark, rows))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = pieces.where("conv_id = 7")
    assert hot.selectExpr("count(distinct part)").first()[0] > 1
    assert max(len(r.roles) for r in hot.collect()) <= 2 * 64 + 2
    turns = [(r.role, r.text) for r in repaired_turns(hot).orderBy("part", "no", "place").collect()]
    assert [r[0] for r in turns] == ["user", "assistant"] * (len(turns) // 2)
    audit = conversation_audits(hot).first()
    assert audit.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()


def test_conversations_without_turns(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "Hello.")]
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in repaired(frame(spark, rows)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert repaired(frame(spark, []).where("false")).collect() == []
