"""Conversation repair against plain searches, and on nulls, ties, repeats, long conversations and empty tables."""

import hashlib
import heapq
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, repair
from lodestone.llm.common import table

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")


def all_repairs(turns, faults):
    """The cheapest edits by trying all of them: a queue of (cost, edits) until one spells the form. Turns are (role, text)."""
    queue, most = [(0, "", (), 0)], 2 * len(turns)
    best = None
    while queue:
        cost, edits, roles, i = heapq.heappop(queue)
        if best is not None and cost > best[0]:
            break
        initials = "".join(r[:1] or "-" for r, _ in roles)
        if i == len(turns) and FORM.fullmatch(initials) and (best is None or (cost, edits) < best[:2]):
            best = cost, edits, "\n".join(f"{r}:{t}" for r, t in roles)
        if not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        for role in ("user", "assistant"):
            if cost + 5 <= most:
                heapq.heappush(queue, (cost + 5, edits + "I", (*roles, (role, "")), i))
        if i < len(turns):
            role, text = turns[i]
            heapq.heappush(queue, (cost + 2, edits + "D", roles, i + 1))
            if faults[i] != "must":
                more = 5 * (faults[i] == "cut")
                heapq.heappush(queue, (cost + more, edits + "K", (*roles, (role, text)), i + 1))
                for to in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 1 + more, edits + "R", (*roles, (to, text)), i + 1))
    return best


def plain_faults(turns):
    out, seen = [], set()
    for role, text in turns:
        words = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation, in any order."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    turns = [(r, x) for _, r, x in rows]
    faults, numbers = plain_faults(turns), [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, edits, text = all_repairs(turns, ["must" if f in ("blank", "duplicate") else "cut" if f else "" for f in faults])
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, text


def plain_damage(rows):
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.text) for r in df.collect()}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    by = {r[0]: [] for r in rows}
    for c, t, role, text in plain_damage(rows):
        by[c].append((t, role, text))
    want = {c: plain_repair(x) for c, x in by.items()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in queries.QUERIES["op12_repair"](spark, SF).collect()}
    assert got == {c: (*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest()) for c, x in want.items()}


def random_turns(rng, n):
    texts = ["Yes.", "No!", "well", "", " \n", "Ok?\t", "é", "Yes."]
    return [(rng.choice([None, 0, 1, 2, 3, 5]), rng.choice(["user", "assistant", "system", "tool", "u", "", None, "user", "assistant"]), rng.choice([None, *texts])) for _ in range(n)]


def test_repairs_equal_all_edits_tried(spark):
    rng = random.Random(3)
    convs = {c: random_turns(rng, rng.randrange(1, 8)) for c in range(300)}
    convs[None] = [(None, None, None), (None, "user", "Hi."), (None, "user", "Hi.")]
    df = spark.createDataFrame([(c, *t) for c, x in convs.items() for t in x], TURNS)
    df = df.repartition(5).withColumn("lost", F.lit("no")).withColumn("cost", F.lit(1)).withColumn("kind_", F.lit(2))
    assert found(repair.repair(df)) == {c: plain_repair(x) for c, x in convs.items()}
    # damaged, with all null columns and clashing names
    got = [(r.conv_id, r.turn, r.role, r.text) for r in repair.damage(df).where("not lost").collect()]
    want = list(plain_damage([(c, *t) for c, x in convs.items() for t in x]))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_conversations_without_turns_and_empty_tables(spark):
    assert repair.repair(spark.createDataFrame([], TURNS)).count() == 0
    assert repair.damage(spark.createDataFrame([], TURNS)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, None, None, None), (2, 5, "user", "Hi.")], TURNS).withColumn("gone", F.col("conv_id") == 1)
    assert found(repair.repair(df, lost_col="gone")) == {1: (0, 0, 0, 0, 0, 0, "", ""), 2: (0, 0, 0, 0, 0, 2, "D", "")}


def plain_costs(codes):
    """Forwards over all turns at once: (cost, edits) for each state."""
    best = {0: (0, "")}

    def better(into, q, way):
        if q not in into or way < into[q]:
            into[q] = way

    for code in [*codes, None]:
        for _ in range(2):
            for q, (c, e) in list(best.items()):
                better(best, repair.GOES_ON[q], (c + 5, e + "I"))
        if code is None:
            return min(best[q] for q in (0, 3) if q in best)
        after = {}
        for q, (c, e) in best.items():
            for edit, cost, to in repair.AHEAD[code][q]:
                better(after, to, (c + cost, e + edit))
        best = after


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
def test_blocks_do_not_matter(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for n in [*range(12)] * 12:
        codes = bytes(rng.choice([0, 1, 1, 1, 2, 2, 2, 3, 4, 5, 6, 7, 9]) for _ in range(n))
        assert repair.cheapest(codes) == plain_costs(codes)


def test_long_conversations_take_linear_time(spark):
    rng, took = random.Random(1), {}
    for n in (20_000, 80_000):
        codes = bytes(rng.choice([0, 1, 2, 2, 5, 9]) for _ in range(n))
        began = time.process_time()
        cost, edits = repair.cheapest(codes)
        took[n] = time.process_time() - began
        assert len(edits.replace("I", "")) == n and 0 < cost < 2 * n
    assert took[80_000] < 8 * took[20_000]
    # one conversation of 40,000 turns, dealt over many tasks, and some very long texts
    df = spark.range(0, 40_000, 1, 8).select(F.lit(1).alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.when(F.col("id") % 10_000 == 0, F.repeat(F.lit("x "), 500_000)).otherwise(""), F.lit(".")).alias("text"))
    r = repair.repair(df, turn_col="id").first()
    assert (r.cost, r.gaps, r.audit, len(r.text.split("\n"))) == (0, 0, "K" * 40_000, 40_000)
