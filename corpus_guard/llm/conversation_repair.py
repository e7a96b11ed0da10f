"""Conversation structure repair by a secondary-sorted stream.

1. Rows are repartitioned by conversation, numbered within equal (role, text), and sorted by
   turn, so that each task streams whole conversations in order (``mapInPandas``).
2. A dynamic program over the four states of ``(s?(ua)+)?`` (nothing yet, after s, after u,
   after a) is carried from row to row and from Arrow batch to Arrow batch. It keeps the cheapest edits to each
   state, and of equally cheap ones the least string: all strings end in the edit of the same row,
   so none begins another, and their order is a rank among at most four.
3. Costs relative to the cheapest state and ranks take few values, so a step is one lookup in a table that
   fills itself; the backpointer of a row is the 4-byte number of the table entry.
4. At the end of a conversation the backpointers are read backwards and the repaired turns forwards. Beyond
   ``SPILL`` bytes backpointers and turns of a conversation lie in unlinked scratch files of the task.

A digest over all turns of a conversation in order is sequential by nature, so one conversation is one
stream; memory is one byte a row (its audit) besides the bounded buffers.

Defined results: rows of one turn are taken by role, then text, in byte order, null turns first; null
conv_ids make one conversation; null roles and texts count as one space; a role counts by its first character, an
empty one has none and is never kept; repeated rows are duplicates; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a conversation's turns, and of its backpointers, that stay in memory.
SPILL = 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_ROLE = {USER: "user", ASSISTANT: "assistant"}


def _next(q: int) -> int:
    """The state after the turn that may be inserted, or given a new role, at q."""
    return ASSISTANT if q == USER else USER


def _kept(q: int, initial: str) -> int | None:
    if initial == "s" and q == START:
        return SYSTEM
    if initial in ("u", "a") and _next(q) == (USER if initial == "u" else ASSISTANT):
        return _next(q)
    return None


class Machine:
    """The dynamic program as a table that fills itself: entry = (states after, cost added, moves)."""

    def __init__(self):
        self.entries: list[tuple] = []
        self.known: dict[tuple, int] = {}

    def step(self, states: tuple, kind: tuple) -> int:
        """states: ((state, cost above the cheapest), ...) by rank; kind: (must go, initial, truncated). Returns the entry's number."""
        found = self.known.get((states, kind))
        if found is not None:
            return found
        must_go, initial, truncated = kind
        extra = TRUNCATED if truncated else 0
        best: dict[int, tuple] = {}
        for rank, (came, cost) in enumerate(states):
            q = came
            for inserts in range(3):
                options = [("D", q, DELETE)]
                if not must_go:
                    options.append(("R", _next(q), REROLE + extra))
                    if (to := _kept(q, initial)) is not None:
                        options.append(("K", to, KEEP + extra))
                for edit, to, price in options:
                    way = (cost + INSERT * inserts + price, rank, "I" * inserts + edit, came)
                    if to not in best or way < best[to]:
                        best[to] = way
                q = _next(q)
        least = min(w[0] for w in best.values())
        ranked = sorted(best.items(), key=lambda x: x[1][1:3])
        after = tuple((q, w[0] - least) for q, w in ranked)
        self.known[states, kind] = number = len(self.entries)
        self.entries.append((after, least, {q: (w[3], w[2]) for q, w in ranked}))
        return number

    @staticmethod
    def end(states: tuple) -> tuple[int, int, int]:
        """(cost added, state before the last inserts, last inserts) of the best end."""
        best = None
        for rank, (came, cost) in enumerate(states):
            q = came
            for inserts in range(3):
                if q in (START, ASSISTANT):
                    way = (cost + INSERT * inserts, rank, inserts, came)
                    best = way if best is None or way < best else best
                q = _next(q)
        return best[0], best[3], best[2]


class Conversation:
    """One conversation's rows in order; memory beyond SPILL goes to scratch files."""

    def __init__(self, machine: Machine, spill: int):
        self.machine, self.spill = machine, spill
        self.turns = tempfile.SpooledTemporaryFile(spill)
        self.back = tempfile.SpooledTemporaryFile(spill)
        self.pending = array("I")
        self.states, self.cost, self.n = ((START, 0),), 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.last_turn = None
        self.distinct = 0
        self.last = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.last_turn
            self.high = self.last_turn = turn
        initial = role[:1]
        if self.n:
            self.illegal += (self.last, initial) not in _LEGAL
        self.last = initial
        self.n += 1
        if blank:
            self.blank += 1
        elif duplicate:
            self.duplicate += 1
        elif truncated:
            self.truncated += 1
        must_go = blank or duplicate
        kind = (must_go, initial if initial in ("s", "u", "a") and not must_go else "", truncated and not must_go)
        entry = self.machine.step(self.states, kind)
        self.states, more, _ = self.machine.entries[entry]
        self.cost += more
        self.pending.append(entry)
        if len(self.pending) >= 1 << 14:
            self._flush()
        a, b = role.encode("utf-8", "replace"), text.encode("utf-8", "replace")
        self.turns.write(b"%d %d\n%b%b" % (len(a), len(b), a, b))

    def _flush(self) -> None:
        self.back.write(self.pending.tobytes())
        self.pending = array("I")

    def decisions(self) -> tuple[int, list[str], bytearray, int]:
        """(cost, the distinct edit strings, their number for each row in order, inserts at the end)."""
        self._flush()
        added, q, last = self.machine.end(self.states)
        names, number = [], {}
        chosen = bytearray(self.n)
        row = self.n
        while row:
            first = max(0, row - (1 << 14))
            self.back.seek(4 * first)
            entries = array("I")
            entries.frombytes(self.back.read(4 * (row - first)))
            for i in range(row - 1, first - 1, -1):
                q, edits = self.machine.entries[entries[i - first]][2][q]
                if edits not in number:
                    number[edits] = len(names)
                    names.append(edits)
                chosen[i] = number[edits]
            row = first
        return self.cost + added, names, chosen, last

    def repaired(self, names: list[str], chosen: bytearray, last: int):
        """(role, text, edit) of the repaired turns in order, as bytes."""
        q = START
        self.turns.seek(0)
        for number in chosen:
            a, b = map(int, self.turns.readline().split())
            role, text = self.turns.read(a), self.turns.read(b)
            for edit in names[number]:
                if edit == "D":
                    continue
                if edit == "K":
                    q = _kept(q, role[:1].decode("latin-1"))
                    yield role, text, edit
                else:
                    q = _next(q)
                    yield _ROLE[q].encode(), b"" if edit == "I" else text, edit
        for _ in range(last):
            q = _next(q)
            yield _ROLE[q].encode(), b"", "I"

    def close(self) -> None:
        self.turns.close()
        self.back.close()


_SUMMARY = ["conv", "no_conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_TURN = ["conv", "no_conv", "place", "role", "text", "edit"]


def _summary(name, talk: Conversation):
    cost, names, chosen, last = talk.decisions()
    audit = "".join([names[c] for c in chosen]) + "I" * last
    sha, first = hashlib.sha256(), True
    for role, text, _ in talk.repaired(names, chosen, last):
        sha.update((b"" if first else b"\n") + role + b":" + text)
        first = False
    gaps = 0 if talk.low is None else min(talk.high - talk.low + 1 - talk.distinct, (1 << 63) - 1)
    yield (*name, gaps, talk.blank, talk.duplicate, talk.truncated, talk.illegal, cost, audit, sha.hexdigest())


def _turns(name, talk: Conversation):
    _, names, chosen, last = talk.decisions()
    for place, (role, text, edit) in enumerate(talk.repaired(names, chosen, last)):
        yield (*name, place, role.decode(), text.decode(), edit)


def _stream(report, columns: list[str], spill: int, bound: int = 1 << 22):
    """mapInPandas function: rows sorted by conversation and turn to the rows that ``report`` gives of each conversation."""

    def work(batches):
        machine, name, talk = Machine(), None, None
        out, weight = [], 0

        def done():
            nonlocal out, weight
            for row in report(name, talk):
                out.append(row)
                weight += 64 + sum(len(x) for x in row if isinstance(x, str))
                if weight >= bound:
                    yield pd.DataFrame(out, columns=columns)
                    out, weight = [], 0
            talk.close()

        for batch in batches:
            for conv, no_conv, gone, turn, no_turn, role, text, blank, duplicate, truncated in zip(*(batch[c].tolist() for c in batch.columns)):
                if (conv, no_conv) != name:
                    if talk is not None:
                        yield from done()
                    name, talk = (conv, no_conv), Conversation(machine, spill)
                if not gone:
                    talk.add(None if no_turn else turn, role, text, blank, duplicate, truncated)
        if talk is not None:
            yield from done()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return work


def in_order(rows: DataFrame, gone=None) -> DataFrame:
    """Conversations' rows by conversation, then turn, with their faults; rows where ``gone`` holds only name their conversation."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    named = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), F.isnull("conv_id").alias("no_conv"), (F.lit(False) if gone is None else gone).alias("gone"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.isnull("turn").alias("no_turn"), role.alias("role"), text.alias("text"),
    )
    named = named.repartition("conv", "no_conv")
    same = Window.partitionBy("conv", "no_conv", "gone", "role", "text").orderBy(F.desc("no_turn"), "turn")
    flagged = named.withColumn("nth", F.row_number().over(same))
    flagged = flagged.sortWithinPartitions("conv", "no_conv", F.desc("no_turn"), "turn", "role", "text", "nth")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return flagged.select("conv", "no_conv", "gone", "turn", "no_turn", "role", "text", blank.alias("blank"), (F.col("nth") > 1).alias("duplicate"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"))


def _named(rows: DataFrame, out: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    rest = [c for c in out.columns if c not in ("conv", "no_conv")]
    return out.select(F.when(~F.col("no_conv"), F.col("conv").cast(kind)).alias("conv_id"), *rest)


def audit_conversations(rows: DataFrame, gone=None, spill: int = SPILL) -> DataFrame:
    """(conv_id, turn, role, text) to one row per conversation: faults, cost of the cheapest repair, its edits, and the digest of its turns."""
    kinds = ["string", "boolean", *["long"] * 6, "string", "string"]
    out = in_order(rows, gone).mapInPandas(_stream(_summary, _SUMMARY, spill), ", ".join(f"{c} {k}" for c, k in zip(_SUMMARY, kinds)))
    return _named(rows, out)


def repair_conversations(rows: DataFrame, gone=None, spill: int = SPILL) -> DataFrame:
    """(conv_id, turn, role, text) to the turns of the repaired conversations: conv_id, place, role, text, edit (K, R or I)."""
    kinds = ["string", "boolean", "long", "string", "string", "string"]
    out = in_order(rows, gone).mapInPandas(_stream(_turns, _TURN, spill), ", ".join(f"{c} {k}" for c, k in zip(_TURN, kinds)))
    return _named(rows, out)


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults by the CRC-32 of ``conv_id:turn``; ``gone`` marks the rows that are dropped."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20).alias("fault")
    role, text = text_of("role"), text_of("text")
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return marked.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return audit_conversations(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), F.col("gone"))


ORACLE = r"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS fault
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
o AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS truncated,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM n),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND duplicate) AS duplicate,
         count(*) FILTER (NOT blank AND NOT duplicate AND truncated) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows_left
  FROM o GROUP BY conv_id),
ins(q, j, q1, added) AS (VALUES
  (0, 0, 0, ''), (0, 1, 2, E'\nuser:'), (0, 2, 3, E'\nuser:\nassistant:'), (1, 0, 1, ''), (1, 1, 2, E'\nuser:'), (1, 2, 3, E'\nuser:\nassistant:'),
  (2, 0, 2, ''), (2, 1, 3, E'\nassistant:'), (2, 2, 2, E'\nassistant:\nuser:'), (3, 0, 3, ''), (3, 1, 2, E'\nuser:'), (3, 2, 3, E'\nuser:\nassistant:')),
step AS (
  SELECT q, j, q1, added, e.edit, i.initial,
         CASE edit WHEN 'D' THEN q1 WHEN 'R' THEN CASE q1 WHEN 2 THEN 3 ELSE 2 END
           ELSE CASE WHEN i.initial = 's' AND q1 = 0 THEN 1 WHEN i.initial = 'u' AND q1 <> 2 THEN 2 WHEN i.initial = 'a' AND q1 = 2 THEN 3 END END AS q2
  FROM ins, (VALUES ('D'), ('K'), ('R')) e(edit), (VALUES ('s'), ('u'), ('a'), ('-')) i(initial)),
st AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'c': 0::BIGINT, 'a': '', 'r': ''} AS w FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT st.conv_id, o.i, step.q2, min({'c': st.w.c + 5 * step.j + CASE step.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN step.edit <> 'D' AND o.truncated THEN 5 ELSE 0 END,
    'a': st.w.a || repeat('I', step.j) || step.edit,
    'r': st.w.r || step.added || CASE step.edit WHEN 'D' THEN '' WHEN 'K' THEN E'\n' || o.role || ':' || o.text ELSE E'\n' || CASE step.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || o.text END})
  FROM st JOIN o ON o.conv_id IS NOT DISTINCT FROM st.conv_id AND o.i = st.i + 1
  JOIN step ON step.q = st.q AND step.q2 IS NOT NULL AND step.initial = CASE WHEN o.initial IN ('s', 'u', 'a') THEN o.initial ELSE '-' END AND (step.edit = 'D' OR NOT (o.blank OR o.duplicate))
  GROUP BY st.conv_id, o.i, step.q2),
ends AS (
  SELECT st.conv_id, min({'c': st.w.c + 5 * ins.j, 'a': st.w.a || repeat('I', ins.j), 'r': st.w.r || ins.added}) AS w
  FROM st LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM st.conv_id JOIN ins ON ins.q = st.q AND ins.q1 IN (0, 3) WHERE st.i = coalesce(f.rows_left, 0) GROUP BY st.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       e.w.c AS cost, e.w.a AS audit, sha256(substr(e.w.r, 2)) AS repaired_sha256
FROM ends e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""
