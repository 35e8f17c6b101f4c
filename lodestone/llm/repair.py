"""Repair of conversation structure by shortest paths over small integer costs (Dial's buckets)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, fresh, importable, trimmed

#: Fixed by the contract. Roles that an edit can give, marks that end a text, and the costs of the edits, named by their
#: initials: Delete, Insert, Keep, Rerole. A truncated turn that stays costs TRUNCATED more.
USER, ASSISTANT, ENDS = "user", "assistant", ".!?"
COSTS = {"D": 2, "I": 5, "K": 0, "R": 1}
TRUNCATED = 5

#: What role initials (s?(ua)+)? have been read: nothing, s, ... u, ... ua. The first and the last may end.
START, SYSTEM, ASKED, ANSWERED = range(4)
#: From every state one of user and assistant goes on, and leads here.
GOES_ON = (ASKED, ASKED, ANSWERED, ASKED)
#: States by initial, where that initial may be read.
READS = ({"s": SYSTEM, "u": ASKED}, {"u": ASKED}, {"a": ANSWERED}, {"u": ASKED})
#: What is still to pay behind the last turn: insertions up to a state that may end.
TERMINAL = (0, 2 * COSTS["I"], COSTS["I"], 0)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

#: A turn is one byte: its initial (the index in INITIALS) + 4 * its fault (0 none, 1 truncated, 2 it must go).
INITIALS = "sua-"
#: Rows of a block: a conversation's distances are held for one block at a time.
BLOCK = 4096
#: A power of two above the largest difference of distances that wait at the same time.
RING = 16


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """The arcs over a turn: (edit, its cost, from state, to state)."""
    initial, fault = INITIALS[code % 4], code // 4
    out = [("D", COSTS["D"], q, q) for q in range(4)]
    if fault < 2:
        more = TRUNCATED * fault
        out += [("K", COSTS["K"] + more, q, READS[q][initial]) for q in range(4) if initial in READS[q]]
        out += [("R", COSTS["R"] + more, q, GOES_ON[q]) for q in range(4)]
    return out


ARCS = [_arcs(code) for code in range(12)]
BACK = [[[(p, c) for _, c, p, to in arcs if to == q] for q in range(4)] for arcs in ARCS]
AHEAD = [[[(edit, c, to) for edit, c, p, to in arcs if p == q] for q in range(4)] for arcs in ARCS]
INSERTED = [[p for p in range(4) if GOES_ON[p] == q] for q in range(4)]


def distances(codes: bytes, lo: int, hi: int, ends: tuple[int, ...]) -> list[int]:
    """For turns lo to hi of a conversation: what is still to pay from each (turn, state), four a turn, given that from
    the states behind turn hi - 1. Dial's algorithm backwards from there: nodes wait in a ring of buckets, one a
    distance, so the least one is found without a heap."""
    n, cost = 4 * (hi - lo), COSTS["I"]
    dist = [1 << 60] * n + list(ends)
    ring: list[list[int]] = [[] for _ in range(RING)]
    for q, d in enumerate(ends):
        ring[d % RING].append(n + q)
    at, waiting = min(ends), 4
    while waiting:
        bucket = ring[at % RING]
        while bucket:  # arcs that cost nothing add to it meanwhile
            v = bucket.pop()
            waiting -= 1
            if dist[v] != at:
                continue  # it was reached for less
            i, q = v >> 2, v & 3
            if i:
                for p, c in BACK[codes[lo + i - 1]][q]:
                    u = (i - 1) * 4 + p
                    if at + c < dist[u]:
                        dist[u] = at + c
                        ring[(at + c) % RING].append(u)
                        waiting += 1
            if v < n:
                for p in INSERTED[q]:
                    u = i * 4 + p
                    if at + cost < dist[u]:
                        dist[u] = at + cost
                        ring[(at + cost) % RING].append(u)
                        waiting += 1
        at += 1
    return dist


def cheapest(codes: bytes) -> tuple[int, str]:
    """The least cost of a conversation's turns and the ASCII-least string of edits that costs it.

    Distances are recorded backwards; then the walk takes at each (turn, state) the first edit in ASCII order whose arc
    is tight, that is, whose cost makes up the difference of the distances. An arc's letter and state name the next
    state, so the walk needs no second look. Of a long conversation, only the distances between blocks are recorded, and
    those inside a block are found again when the walk comes there: time is linear in the turns, and memory is a byte or
    two a turn.
    """
    cuts = list(range(0, len(codes), BLOCK)) + [len(codes)]
    ends = [TERMINAL]  # behind the last block, ..., behind the first one
    dist = list(TERMINAL)
    for lo, hi in zip(cuts[-2::-1], cuts[:0:-1]):
        dist = distances(codes, lo, hi, ends[-1])
        ends.append(tuple(dist[:4]))
    total, q, out = ends[-1][START], START, []
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if k:
            dist = distances(codes, lo, hi, ends[-2 - k])
        i = lo
        while i < hi:
            here, behind = (i - lo) * 4, (i + 1 - lo) * 4
            left = dist[here + q]
            # an insertion, like any other tight arc; D, I, K, R in this order
            tight = [(e, to) for e, c, to in AHEAD[codes[i]][q] if c + dist[behind + to] == left]
            if COSTS["I"] + dist[here + GOES_ON[q]] == left:
                tight.append(("I", GOES_ON[q]))
            edit, q = min(tight)
            out.append(edit)
            i += edit != "I"
    while TERMINAL[q]:
        out.append("I")
        q = GOES_ON[q]
    return total, "".join(out)


class _Known(dict):
    """Answers for short conversations, as most are alike; at most ``most`` of them."""

    def __init__(self, longest: int = 24, most: int = 50_000):
        super().__init__()
        self.longest, self.most = longest, most

    def of(self, codes: bytes) -> tuple[int, str]:
        found = self.get(codes)
        if found is None:
            found = cheapest(codes)
            if len(codes) <= self.longest and len(self) < self.most:
                self[codes] = found
        return found


class Conversation:
    """The turns of one conversation, as they come in order. Texts of turns that must go are not held."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.held, self.seen = conv_id, bytearray(), [], set()
        self.least = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and (self.last is None or turn != self.last):
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        initial = role[:1]
        if self.before is not None and (self.before, initial) not in LEGAL:
            self.illegal += 1
        self.before = initial
        words, fault = text.strip(WS_CHARS), 0
        if not words:
            self.blank, fault = self.blank + 1, 2
        elif (role, text) in self.seen:
            self.duplicate, fault = self.duplicate + 1, 2
        else:
            self.seen.add((role, text))
            self.held.append((role, text))
            if words[-1] not in ENDS:
                self.truncated, fault = self.truncated + 1, 1
        self.codes.append((INITIALS.index(initial) if initial and initial in "sua" else 3) + 4 * fault)

    def repaired(self, audit: str) -> str:
        out, q, i, held = [], START, 0, iter(self.held)
        for edit in audit:
            role = USER if GOES_ON[q] == ASKED else ASSISTANT
            if edit == "I":
                out.append(f"{role}:")
                q = GOES_ON[q]
                continue
            code = self.codes[i]
            own, text = next(held) if code < 8 else ("", "")
            i += 1
            if edit == "K":
                out.append(f"{own}:{text}")
                q = READS[q][own[:1]]
            elif edit == "R":
                out.append(f"{role}:{text}")
                q = GOES_ON[q]
        return "\n".join(out)

    def row(self, known: _Known) -> tuple:
        cost, audit = known.of(bytes(self.codes))
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return self.conv_id, min(gaps, (1 << 63) - 1), self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, self.repaired(audit)


SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, text string"
_TYPES = pa.schema([pa.field(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SCHEMA.split(", ")])


def _repaired(batches):
    """Rows (conv_id, turn, role, text, lost), sorted by these, into one row a conversation."""
    known, now, done, size = _Known(), None, [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*done), _TYPES)], schema=_TYPES)

    for b in batches:
        for conv_id, turn, role, text, lost in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.row(known))
                    size += len(done[-1][-1])
                    if size > 4_000_000 or len(done) >= 2000:
                        yield batch()
                        done, size = [], 0
                now = Conversation(conv_id)
            if not lost:
                now.add(turn, role, text)
    if now is not None:
        done.append(now.row(known))
        yield batch()


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", lost_col: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, its gaps, faults and illegal pairs, the cost of the cheapest edits that give its
    roles the form (s?(ua)+)?, those edits (audit) and the repaired conversation (text: ``role:text`` lines).

    Turns come in the order of their number, those without one first; turns with the same number in the order of their
    role, then of their text (code points). Rows where ``lost_col`` is true are taken as lost: they are no turns, but
    their conversation has its row. A null role or text is one space. Rows without an id are one conversation. A role
    whose initial isn't s, u or a can be rewritten or deleted, not kept. Repeated rows are duplicates. Extra columns are
    ignored; an empty table gives an empty one.

    Turns are shuffled once, by conversation, and sorted there, where Spark can spill; a task reads them as a stream and
    holds one conversation: its distinct texts and a byte a turn. That is about what its row in the result holds, so
    the longest conversation that can be repaired is the longest one that a row can hold.
    """
    importable(turns.sparkSession)
    lost = F.coalesce(F.col(lost_col).cast("boolean"), F.lit(False)) if lost_col else F.lit(False)
    text = lambda c: F.when(lost, F.lit("")).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), lost.alias("lost"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(trimmed(_repaired), SCHEMA)


def damage(turns: DataFrame) -> DataFrame:
    """Damages conversations as the contract says, by the checksum of ``conv_id:turn``: a twentieth of the turns each is
    lost (a row with ``lost`` true), emptied, robbed of its stops, repeated, or given to the user. Extra columns go."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind, spare = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20, fresh("kind_", turns)
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.cast("int").alias(spare))
    k = F.col(spare)
    text = F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace("text", f"[{ENDS}]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(k == 4, F.lit(USER)).otherwise(F.col("role")).alias("role"), text.alias("text"), (k == 0).alias("lost"), spare)
    return rows.withColumn(spare, F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop(spare)


def _state(name: str, *ways: str) -> str:
    return f"list_min([{', '.join(ways)}]) AS {name}" if len(ways) > 1 else f"{ways[0]} AS {name}"


def _oracle() -> str:
    """The same by dynamic programming forwards: for each state the least (cost, edits, text) so far."""
    none = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    put = lambda s, cost, edit, line="''": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {s}.t || {line}}}"
    insert = lambda s, role: put(s, 5, "I", f"chr(10) || '{role}:'")
    gone = lambda s: put(s, 2, "D")
    keep = lambda s, initial: f"CASE WHEN NOT must AND left(role, 1) = '{initial}' THEN {put(s, '5 * cut', 'K', 'chr(10) || role || chr(58) || text')} ELSE {none} END"
    rerole = lambda s, role: f"CASE WHEN NOT must THEN {put(s, '1 + 5 * cut', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} ELSE {none} END"
    asked = _state("n2", "s2", *(insert(s, "user") for s in ("s0", "s1", "s3")))
    answered = _state("n3", "s3", insert("n2", "assistant"))
    step = ", ".join([
        _state("s0", gone("s0")), _state("s1", gone("s1"), keep("s0", "s")),
        _state("s2", gone("n2"), *(f(s, x) for s in ("s0", "s1", "n3") for f, x in ((keep, "u"), (rerole, "user")))),
        _state("s3", gone("n3"), keep("n2", "a"), rerole("n2", "assistant")),
    ])
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS MATERIALIZED (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, crc),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM h, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (kind = 3 OR copy = 1)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
             left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM p),
t AS MATERIALIZED (SELECT *, blank OR again AS must, (NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$'))::BIGINT AS cut FROM f),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank, sum((again AND NOT blank)::INT)::BIGINT AS duplicate,
             sum(cut)::BIGINT AS truncated, sum((before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal FROM t GROUP BY conv_id),
w AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM n
  UNION ALL
  SELECT conv_id, pos, {step} FROM (SELECT *, {answered} FROM (SELECT w.conv_id, t.pos, s0, s1, s2, s3, role, text, must, cut, {asked} FROM w JOIN t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.pos = w.pos + 1))),
e AS (SELECT n.*, list_min([s0, s3, {insert("s2", "assistant")}]) AS best FROM w JOIN n ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.pos = n.n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE = _oracle()
