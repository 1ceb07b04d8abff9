"""Conversation structure repair: the cheapest edits that make a conversation's roles follow a grammar.

A conversation's turns should be an optional system turn and then pairs of user and assistant, or nothing. Nodes of the edit
lattice are (turns read, grammar state); edges keep, re-role or delete the next turn or insert an empty one. Dijkstra's algorithm
walks it without building it: the priority is (cost, audit), an audit being the initials of the edits so far, and it stops at
the first accepting end that it takes from the heap. An audit is a node of a tree with links to its parent and to a
far ancestor, so that long audits are neither copied nor compared letter by letter.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.common import short_batches, table

#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (BEGIN, ASSISTANT)
#: States by initial of the role: (from, to).
FOLLOWS = {"s": {BEGIN: SYSTEM}, "u": {BEGIN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The one role that a re-roled or inserted turn can have in each state, and the state after it.
MADE = {BEGIN: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Costs of edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_SPACE, _STOPS = " \t\n\x0b\x0c\r", (".", "!", "?")
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


class Audit:
    """Initials of edits, as a path from the root of a tree; one audit is one node, as it fixes all turns and states."""

    __slots__ = ("depth", "far", "letter", "parent")

    def __init__(self, parent: Audit | None, letter: str):
        self.parent, self.letter = parent, letter
        self.depth = parent.depth + 1 if parent else 0
        # far ancestors lie as the digits of a skew binary number say: any ancestor is a logarithmic number of links away
        if parent and parent.far and parent.depth - parent.far.depth == parent.far.depth - (parent.far.far.depth if parent.far.far else 0):
            self.far = parent.far.far or parent.far
        else:
            self.far = parent

    def at(self, depth: int) -> Audit:
        """The first ``depth`` letters."""
        x = self
        while x.depth > depth:
            x = x.far if x.far.depth >= depth else x.parent
        return x

    def __lt__(self, other: Audit) -> bool:
        depth = min(self.depth, other.depth)
        a, b = self.at(depth), other.at(depth)
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.far, b.far) if a.far is not b.far else (a.parent, b.parent)
        return a.letter < b.letter

    def __str__(self) -> str:
        letters, x = [], self
        while x.parent:
            letters.append(x.letter)
            x = x.parent
        return "".join(reversed(letters))


def cheapest(turns: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and audit of the repair of (initial, fault) turns, the fault being "", "blank", "duplicate" or "truncated"."""
    heap = [(0, Audit(None, ""), 0, BEGIN)]
    done = set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in ENDS:
            return cost, str(audit)
        made = MADE[state][1]
        steps = [(INSERT, "I", i, made)]
        if i < len(turns):
            initial, fault = turns[i]
            steps.append((DELETE, "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                stays = TRUNCATED if fault else 0
                steps.append((REROLE + stays, "R", i + 1, made))
                kept = FOLLOWS.get(initial, {}).get(state)
                if kept is not None:
                    steps.append((KEEP + stays, "K", i + 1, kept))
        for more, letter, *node in steps:
            if tuple(node) not in done:
                heapq.heappush(heap, (cost + more, Audit(audit, letter), *node))


def edited(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The (role, text) turns after the edits of an audit."""
    out, state, left = [], BEGIN, iter(turns)
    for letter in audit:
        role, text = (MADE[state][0], "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter == "R":
            role = MADE[state][0]
        state = FOLLOWS[role[0]][state]
        out.append((role, text))
    return out


def fault(role: str, text: str, seen: set[tuple[str, str]]) -> str:
    """The first fault of a turn, which is then one of those ``seen``."""
    known = (role, text) in seen
    seen.add((role, text))
    if not _WORD.search(text):
        return "blank"
    if known:
        return "duplicate"
    return "" if text.rstrip(_SPACE).endswith(_STOPS) else "truncated"


def repaired(turns: list[tuple[int | None, str, str]]) -> tuple[tuple, list[tuple[str, str]]]:
    """Report and repaired (role, text) turns of a conversation, given as (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    faults = [fault(role, text, seen) for _, role, text in turns]
    initials = [role[:1] for _, role, _ in turns]
    numbers = {n for n, _, _ in turns if n is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True))
    cost, audit = cheapest(list(zip(initials, faults, strict=True)))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit), edited([t[1:] for t in turns], audit)


def repair_conversations(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: its id (a number), gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired turns as an
    array of (role, text), given columns turn, role and text.

    Rows are dealt out by conversation, sorted by turn (null first), role and text, and stream through the tasks; a task holds
    one conversation, which as one row of the result has to fit it, and as one path through one lattice is one task's work. A
    null role or text is one blank. Rows without an id are one conversation. Ties of the turn number go by role and text, and
    repeated rows count as duplicates. Texts of any length are used whole; a re-roled turn keeps its text, an inserted one has
    none. Other columns are ignored, whatever their names; an empty table gives no rows.
    """

    def run(batches):
        held, key, rows = [], None, []

        def done():
            ids, reports, turns = zip(*((k, *repaired(r)) for k, r in held), strict=True)
            report = [pa.array(c, kind) for c, kind in zip(zip(*reports, strict=True), [*[pa.int64()] * 6, pa.string()], strict=True)]
            texts = pa.array([[{"role": role, "text": text} for role, text in t] for t in turns], _TURNS)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *report, texts], names=names)

        for batch in batches:
            for conversation, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is None or key[0] != conversation:
                    if key is not None:
                        held.append((key[0], rows))
                    key, rows = (conversation,), []
                rows.append(row)
            if held:
                yield done()
                held = []
        if key is not None:
            held.append((key[0], rows))
            yield done()

    schema = f"{id_col} long, {_REPORT}, turns array<struct<role:string,text:string>>"
    names = [id_col, *(c.split()[0] for c in _REPORT.split(", ")), "turns"]
    blank = F.lit(" ")
    c = conversations.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    return short_batches(c.repartition("id").sortWithinPartitions("id", "turn", "role", "text")).mapInArrow(run, schema)


# ---- the query ----------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that are left after damage by the checksum of ``conv_id:turn``; a null is one blank."""
    blank = F.lit(" ")
    c = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    c = c.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    c = c.withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return c.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults, cheapest repair and digest of what it makes of the damaged turns."""
    conversations = table(spark, sf_dir, "conversations")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    counts = [c.split()[0] for c in _REPORT.split(", ")][:-1]
    made = repair_conversations(damaged(conversations)).select("conv_id", *counts, "audit", F.sha2(said, 256).alias("repaired_sha256"))
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = every.join(made, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias("conv_id"), *[F.coalesce(c, zero).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same by dynamic programming in layers: after each turn the least (cost, audit) of each grammar state."""
    # checksum of ASCII strings, bit by bit in a table of 256
    crc_table = "list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END))"
    step = "lambda c, b: xor(t[1 + xor(c % 256, b)], c // 256)"
    # from state to state by no, one or two inserted turns: (from, to, letters, cost)
    inserts = "(0,0,'',0),(1,1,'',0),(2,2,'',0),(3,3,'',0),(0,2,'I',3),(1,2,'I',3),(2,3,'I',3),(3,2,'I',3),(0,3,'II',6),(1,3,'II',6),(2,2,'II',6),(3,3,'II',6)"
    return rf"""
WITH RECURSIVE crc AS (SELECT {crc_table} AS t),
i AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
c AS (SELECT conv_id, turn, role, text,
        xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), {step})) % 20 AS kind
      FROM i, crc),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS n, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER w AS before,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS same,
        regexp_extract_all(text, '[^\x20\x09-\x0D]') AS chars
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT conv_id, turn, role, text, n, ini, before,
        CASE WHEN len(chars) = 0 THEN 'blank' WHEN same > 1 THEN 'duplicate' WHEN chars[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
ins(a, b, letters, price) AS (VALUES {inserts}),
grammar(ini, b, e) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edits AS (
  SELECT conv_id, n, a.b, a.b AS e, 'D' AS letter, 4 AS price FROM f, (VALUES (0), (1), (2), (3)) a(b)
  UNION ALL SELECT conv_id, n, a.b, a.e, 'R', 3 + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END
  FROM f, (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) a(b, e) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, n, g.b, g.e, 'K', CASE fault WHEN 'truncated' THEN 3 ELSE 0 END
  FROM f JOIN grammar g USING (ini) WHERE fault IN ('', 'truncated')),
steps AS (
  SELECT conv_id, n, ins.a AS b, e, letters || letter AS letters, ins.price + edits.price AS price FROM edits JOIN ins ON ins.b = edits.b),
best AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS p FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT s.conv_id, s.n, s.e, min({{'cost': best.p.cost + s.price, 'audit': best.p.audit || s.letters}})
  FROM best JOIN steps s ON s.conv_id IS NOT DISTINCT FROM best.conv_id AND s.n = best.n + 1 AND s.b = best.state GROUP BY s.conv_id, s.n, s.e),
last AS (SELECT conv_id, max(n) AS n FROM f GROUP BY conv_id),
fin AS (
  SELECT last.conv_id, min({{'cost': best.p.cost + ins.price, 'audit': best.p.audit || ins.letters}}) AS p
  FROM last JOIN best ON last.conv_id IS NOT DISTINCT FROM best.conv_id AND last.n = best.n JOIN ins ON ins.a = best.state
  WHERE ins.b IN (0, 3) GROUP BY last.conv_id),
letters AS (
  SELECT conv_id, unnest(string_split(p.audit, '')) AS letter, unnest(range(1, 1 + length(p.audit))) AS spot FROM fin WHERE p.audit <> ''),
placed AS (SELECT *, CASE WHEN letter <> 'I' THEN count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY spot) END AS n FROM letters),
kept AS (SELECT p.conv_id, p.spot, p.letter, f.role, coalesce(f.text, '') AS text FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n WHERE letter <> 'D'),
nth AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY spot)
    - CASE WHEN first_value(letter || substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY spot) = 'Ks' THEN 1 ELSE 0 END AS k FROM kept),
said AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY spot) AS x FROM nth GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(fin.p.cost, 0) AS cost, coalesce(fin.p.audit, '') AS audit, sha256(coalesce(said.x, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM e.conv_id
"""


QUERIES = {"op12_chat_repair": op12_chat_repair}
SQL = {"op12_chat_repair": _sql()}
