"""Repair of conversations by a square-root checkpointed shortest path.

A conversation's rows are read against the role pattern ``(s?(ua)+)?`` (system,
user, assistant). The cheapest edits that make it fit come from costs to the end
in each of the pattern's four states. Reading a conversation of n rows backwards,
only every sqrt(n)-th vector of costs is kept; walking forwards, the vectors of
one block at a time are computed again from the checkpoint at its end, and the
ASCII-least edit that keeps to the least cost is taken at each step.

Spark numbers a conversation's rows, finds repeated ones, and sorts each row twice
into its task: first as two flags, last row first, then whole, in order. So one
conversation is a stream, of which a task holds about 2 sqrt(n) rows; the audit and
the digest, one value each for a conversation, are the only things as long as it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelhour.llm.common import ship

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 60
MOST = (1 << 63) - 1
#: States: nothing yet; after s; after u; after a. The pattern may end in the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
END = [0, NEVER, NEVER, 0]
#: The only state that a user or assistant row, real or put in, can lead to.
NEXT = [USER, USER, ASSISTANT, USER]
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row of some initial leads.
KEPT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: Faults by number.
FINE, BLANK, DUPLICATE, CUT_SHORT = range(4)

SOME = r"[^\x20\x09-\x0D]"


def with_inserts(costs: list[int]) -> list[int]:
    """Costs from each state, before which rows may be put in; two suffice to reach every state."""
    costs = list(costs)
    for _ in range(3):
        costs = [min(c, costs[NEXT[s]] + INSERT) for s, c in enumerate(costs)]
    return costs


def before_row(after: list[int], initial: str, fault: int) -> list[int]:
    """Costs before a row, from those after it."""
    out = []
    for s in range(4):
        best = DELETE + after[s]
        if fault in (FINE, CUT_SHORT):
            extra = TRUNCATED if fault == CUT_SHORT else 0
            best = min(best, REROLE + extra + after[NEXT[s]])
            if initial in KEPT[s]:
                best = min(best, KEEP + extra + after[KEPT[s][initial]])
        out.append(best)
    return with_inserts(out)


def edits(state: int, initial: str, fault: int, here: list[int], after: list[int]) -> Iterator[tuple[str, int]]:
    """(letter, next state) of the ASCII-least tight edits up to and with this row's own."""
    extra = TRUNCATED if fault == CUT_SHORT else 0
    while True:
        cost, to = here[state], NEXT[state]
        if DELETE + after[state] == cost:
            yield "D", state
            return
        if INSERT + here[to] == cost:
            yield "I", to
            state = to
            continue
        kept = KEPT[state].get(initial)
        if fault in (FINE, CUT_SHORT) and kept is not None and KEEP + extra + after[kept] == cost:
            yield "K", kept
        else:
            yield "R", to
        return


class _Conversation:
    """One conversation as its rows come: flags from the last row on, then whole rows from the first on."""

    def __init__(self, key, rows: int) -> None:
        self.key, self.rows = key, rows
        self.every = max(1, isqrt(rows))
        self.costs = with_inserts(END)
        self.checkpoints = {rows: self.costs}
        self.counts = [0, 0, 0, 0]
        self.illegal = self.seen = 0
        self.last_initial: str | None = None
        self.turns: list = [None, None, 0]  # least, greatest, distinct
        self.total = None
        self.state = NOTHING
        self.audit: list[str] = []
        self.digest, self.first_line = hashlib.sha256(), True
        self.block: list[tuple] = []

    def back(self, place: int, initial: str, fault: int) -> None:
        self.costs = before_row(self.costs, initial, fault)
        if place % self.every == 0:
            self.checkpoints[place] = self.costs
        self.counts[fault] += 1

    def forth(self, place: int, turn, role: str, text: str, initial: str, fault: int) -> None:
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        self.block.append((role, text, initial, fault))
        if (place + 1) % self.every == 0 or place + 1 == self.rows:
            self._walk(place + 1)

    def _line(self, role: str, text: str) -> None:
        self.digest.update(("" if self.first_line else "\n").encode() + f"{role}:{text}".encode())
        self.first_line = False

    def _walk(self, end: int) -> None:
        costs = [self.checkpoints[end]]
        for _, _, initial, fault in reversed(self.block):
            costs.append(before_row(costs[-1], initial, fault))
        costs.reverse()
        for (role, text, initial, fault), here, after in zip(self.block, costs[:-1], costs[1:], strict=True):
            for letter, self.state in edits(self.state, initial, fault, here, after):
                self.audit.append(letter)
                if letter == "K":
                    self._line(role, text)
                elif letter != "D":
                    self._line(ROLES[self.state], text if letter == "R" else "")
        self.audit = ["".join(self.audit)]
        self.block = []

    def result(self) -> dict:
        if self.rows:
            while self.state not in (NOTHING, ASSISTANT):
                self.state = NEXT[self.state]
                self.audit.append("I")
                self._line(ROLES[self.state], "")
        low, high, distinct = self.turns
        return {
            "conv_id": self.key, "gaps": min(high - low + 1 - distinct, MOST) if distinct else 0,
            "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[CUT_SHORT],
            "illegal": self.illegal, "cost": self.costs[NOTHING], "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest(),
        }


RESULT = pa.schema([
    *[(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()), ("repaired_sha256", pa.string()),
])


def _stream(batches):
    now: _Conversation | None = None
    for batch in batches:
        done = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "whole", "rows", "place", "turn", "role", "text", "initial", "fault"))
        for key, whole, rows, place, turn, role, text, initial, fault in zip(*columns, strict=True):
            if now is None or now.key != key:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(key, rows)
            if not rows:
                continue
            if whole:
                now.forth(place, turn, role, text, initial, fault)
            else:
                now.back(place, initial, fault)
        if done:
            yield pa.RecordBatch.from_pylist(done, RESULT)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.result()], RESULT)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of every row, nulls in role and text a space, after the damage of
    crc32(``conv_id:turn``, nulls a space) modulo 20: 0 drops it, 1 empties its text, 2 removes ``.!?``,
    3 repeats it, 4 makes it a user's."""
    space = F.lit(" ")
    text = F.coalesce("text", space)
    case = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    return rows.withColumn("_case", case).filter("_case <> 0").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(F.col("_case") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("_case") == 3, 2).otherwise(1).alias("_copies"),
    ).withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies")


def _fault(again: Column) -> Column:
    text = F.col("text")
    return (
        F.when(~text.rlike(SOME), BLANK).when(again, DUPLICATE)
        .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT_SHORT).otherwise(FINE)
    )


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """For every distinct conv_id of ``conversations``: what is wrong with its rows, and the cheapest repair.

    ``rows`` (conv_id, turn, role, text) are a conversation's by turn, nulls first;
    rows of one turn go by role, then text. A null conv_id is a conversation like any
    other, a null role or text is a space; an empty role fits no place of the pattern. A row's first fault counts:
    blank (nothing but white space), duplicate (role and text of an earlier row),
    truncated (does not end in ``.``, ``!`` or ``?``). Edits: Keep 0, Rerole to
    user or assistant 3, Delete 4 (the only one for blank and duplicate rows),
    Insert an empty user or assistant row 3; a truncated row that stays adds 3.
    Returns conv_id, gaps (missing turns between the least and the greatest, nulls
    left out), blank, duplicate, truncated, illegal (neighbours other than su, ua
    and au), cost, audit (the initials of the cheapest edits, ASCII-least) and
    repaired_sha256 (of the repaired ``role:text`` lines). A conversation without
    rows has zeros, an empty audit and the digest of nothing; an empty table gives
    no row.
    """
    ship(rows.sparkSession)
    inside = Window.partitionBy("conv_id")
    alike = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    # The empty row of each conversation keeps those in the result that lost all others.
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    stubs = every.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("stub"))
    all_rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(False).alias("stub"),
    ).unionByName(stubs)
    placed = (
        all_rows.withColumn("place", F.row_number().over(inside.orderBy(F.col("stub").desc(), F.col("turn").asc_nulls_first(), "role", "text")).cast("long") - 2)
        .withColumn("rows", F.count(F.lit(1)).over(inside) - 1)
        .filter("not stub or rows = 0")
        .withColumn("fault", _fault(F.row_number().over(alike) > 1))
        .withColumn("initial", F.substring("role", 1, 1))
    )
    passes = placed.withColumn("whole", F.explode(F.array(F.lit(False), F.lit(True)))).select(
        "conv_id", "whole", "rows", "place", "fault", "initial",
        *[F.when(F.col("whole"), F.col(c)).alias(c) for c in ("turn", "role", "text")],
    )
    streams = passes.repartition("conv_id").sortWithinPartitions("conv_id", "whole", F.when(F.col("whole"), F.col("place")).otherwise(-F.col("place")))
    return streams.mapInArrow(_stream, RESULT_DDL)


RESULT_DDL = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in RESULT)


def op11_conversations(spark, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    return repair(damaged(rows), rows)


#: The damage, then the path backwards: best edits and lines from each row and state, cheapest and then ASCII-least.
OP11_SQL = """
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS fate
  FROM conversations),
after_damage AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM source WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, substr(role, 1, 1) AS initial
  FROM after_damage),
judged AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id) AS n,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
inserts(state, middle, price, letters, added) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']),
  (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
keeps(middle, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edges AS (
  SELECT conv_id, pos, middle, middle AS after, 4 AS price, 'D' AS letter, []::VARCHAR[] AS line FROM judged, range(4) AS t(middle)
  UNION ALL
  SELECT conv_id, pos, middle, after, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', [role || ':' || text]
  FROM judged JOIN keeps USING (initial) WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, pos, middle, CASE middle WHEN 2 THEN 3 ELSE 2 END, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R',
    [CASE middle WHEN 2 THEN 'assistant:' ELSE 'user:' END || text]
  FROM judged, range(4) AS t(middle) WHERE fault IN ('', 'truncated')),
steps AS (
  SELECT e.conv_id, e.pos, i.state, e.after, i.price + e.price AS price, i.letters || e.letter AS letters, list_concat(i.added, e.line) AS lines
  FROM edges e JOIN inserts i USING (middle)),
best AS (
  SELECT DISTINCT conv_id, n + 1 AS pos, state, price AS cost, letters AS audit, added AS lines
  FROM judged, inserts WHERE (state, middle) IN ((0, 0), (1, 3), (2, 3), (3, 3))
  UNION ALL
  SELECT conv_id, pos, state, cost, audit, lines FROM (
    SELECT s.conv_id, s.pos, s.state, s.price + b.cost AS cost, s.letters || b.audit AS audit, list_concat(s.lines, b.lines) AS lines
    FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.pos = b.pos - 1 AND s.after = b.state)
  QUALIFY row_number() OVER (PARTITION BY conv_id, pos, state ORDER BY cost, audit) = 1),
summed AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM judged GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN summed s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM best WHERE pos = 1 AND state = 0) b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
