"""Conversation structure repair: generalised LR parsing of role sequences with weighted edits.

The grammar of role initials is given as productions, from which an SLR table is built. A conversation is read turn by
turn into a graph-structured stack: the tops live at a turn share the stacks below them. At each turn a top may insert
a user or assistant turn (in front), delete the turn, keep it if its initial can be shifted, or rerole it; tops of one
state are merged to the one of least (cost, audit), where the audit is the edits' initials in order. Two paths of one
cost that read the same turns are never one the other's prefix (the longer has inserted more), so that comparing
prefixes is comparing whole audits. That states stand for their stacks is checked when the table is built: stacks with
one top must accept the same continuations, which holds for left-recursive grammars of regular languages.

On Spark, turns are cut into ranges of (conversation, turn, role, text) and each range is sorted and read once, so that
a conversation of any length spreads over tasks. A segment, at most SEGMENT turns of one conversation in one range,
gives for each state it may be entered in the best way to each state it can be left in; the segments of a conversation
are then put together in order. A conversation in one segment, the common case, is entered in the start state alone.
Whether a text came earlier is known from the first turn of each (conversation, role, text) that occurs twice.

Faults: blank (nothing but white space), duplicate (role and text seen earlier), truncated (the last character that
isn't white space is none of `.!?`), the first that applies. Blanks and duplicates are always deleted; a truncated turn
that stays costs more.

Edge cases: a null role or text is one space, so a null text is blank. Rows with a null conv_id are one conversation.
Turns are ordered with nulls first, ties by role and text; repeated rows are duplicates. The initial of an empty role
can't be shifted, nor can any initial outside the grammar: such turns are reroled or deleted. Texts of any length are
read whole. Extra columns are ignored. An empty table gives empty results. What a task keeps of a conversation is a
letter or two a turn (audit and initials), never its texts; an audit, being one string, is held to 2^31 letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import CRC_TABLE, crc_sql, spread_join, stored

# The grammar, the edits' costs, and what damage a remainder does.
GRAMMAR = (("D", ""), ("D", "sP"), ("D", "P"), ("P", "ua"), ("P", "Pua"))
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
MARKS = ".!?"
BLANKS = " \t\n\x0b\x0c\r"
#: Turns of a conversation that are repaired in one piece.
SEGMENT = 1000
#: Characters of a text by which ranges are cut; sorting reads it whole.
HEAD = 64
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3

Stack = tuple[int, "Stack | None"]
Top = tuple[int, str, Stack]


class Grammar:
    """SLR table of productions (left, right), the first left side being the start symbol; upper case is not terminal."""

    def __init__(self, productions: tuple[tuple[str, str], ...] = GRAMMAR):
        self.rules = (("", productions[0][0]), *productions)
        lefts = {left for left, _ in productions}
        self.terminals = sorted({c for _, right in productions for c in right} - lefts)
        self.states: list[frozenset[tuple[int, int]]] = [self._closed({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for at, items in enumerate(self.states):  # grows on the way
            for symbol in sorted({self.rules[r][1][k] for r, k in items if k < len(self.rules[r][1])}):
                new = self._closed({(r, k + 1) for r, k in items if self.rules[r][1][k : k + 1] == symbol})
                if new not in self.states:
                    self.states.append(new)
                self.goto[at, symbol] = self.states.index(new)
        start = productions[0][0]
        #: State: the production that is complete there and needs no look-ahead; and those that stand at the end.
        self.reduce = {s: r for s, items in enumerate(self.states) for r, k in items if len(items) == 1 and k == len(self.rules[r][1]) and self.rules[r][0] not in ("", start)}
        self.final = {s: r for s, items in enumerate(self.states) for r, k in items if k == len(self.rules[r][1]) and self.rules[r][0] == start}
        self.seeds = self._stacks()

    def _closed(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        found = set(items)
        while new := {(n, 0) for r, k in found for n, (left, _) in enumerate(self.rules) if n and self.rules[r][1][k : k + 1] == left} - found:
            found |= new
        return frozenset(found)

    def _reduced(self, stack: Stack, rule: int) -> Stack:
        left, right = self.rules[rule]
        for _ in right:
            stack = stack[1]
        return self.goto[stack[0], left], stack

    def shift(self, stack: Stack, symbol: str) -> Stack:
        """The stack after a terminal that its state can shift, and the reductions that follow."""
        stack = self.goto[stack[0], symbol], stack
        while stack[0] in self.reduce:
            stack = self._reduced(stack, self.reduce[stack[0]])
        return stack

    def accepts(self, stack: Stack) -> bool:
        return stack[0] in self.final

    def _stacks(self, most: int = 1000) -> dict[int, Stack]:
        """A stack for each top state. Raises if there are more than `most` stacks, or two of one top that don't accept
        the same."""
        found: list[Stack] = [(0, None)]
        for stack in found:
            for t in self.terminals:
                if (stack[0], t) in self.goto and (new := self.shift(stack, t)) not in found:
                    found.append(new)
            if len(found) > most:
                raise ValueError("the grammar's stacks grow without bound; write it left-recursive")
        steps = {s: [self.shift(s, t) if (s[0], t) in self.goto else None for t in self.terminals] for s in found}
        kinds = {s: int(self.accepts(s)) for s in found} | {None: -1}
        while True:
            signs = {s: (kinds[s], *(kinds[x] for x in steps[s])) for s in found}
            order = {sign: n for n, sign in enumerate(sorted(set(signs.values())))}
            finer = {s: order[signs[s]] for s in found} | {None: -1}
            if len(set(finer.values())) == len(set(kinds.values())):
                break
            kinds = finer
        tops: dict[int, Stack] = {}
        for s in found:
            if kinds[tops.setdefault(s[0], s)] != kinds[s]:
                raise ValueError("stacks with one top state accept different continuations")
        return tops


def offer(tops: dict[int, Top], stack: Stack, cost: int, audit: str) -> bool:
    """Merges a stack with the one of its top state, if it is the lesser."""
    old = tops.get(stack[0])
    if old is None or (cost, audit) < old[:2]:
        tops[stack[0]] = cost, audit, stack
        return True
    return False


def with_inserts(g: Grammar, tops: dict[int, Top]) -> dict[int, Top]:
    """The tops, and those that inserted turns lead to."""
    tops = dict(tops)
    work = list(tops)
    while work:
        cost, audit, stack = tops[work.pop()]
        for t in ROLES:
            if (stack[0], t) in g.goto:
                new = g.shift(stack, t)
                if offer(tops, new, cost + INSERT, audit + "I"):
                    work.append(new[0])
    return tops


def read_turn(g: Grammar, tops: dict[int, Top], initial: str, fault: int) -> dict[int, Top]:
    out: dict[int, Top] = {}
    more = TRUNCATED if fault == CUT else 0
    for cost, audit, stack in with_inserts(g, tops).values():
        offer(out, stack, cost + DELETE, audit + "D")
        if fault in (BLANK, DUPLICATE):
            continue
        if (stack[0], initial) in g.goto:
            offer(out, g.shift(stack, initial), cost + more, audit + "K")
        for t in ROLES:
            if (stack[0], t) in g.goto:
                offer(out, g.shift(stack, t), cost + REROLE + more, audit + "R")
    return out


def edits(g: Grammar, stack: Stack, audit: str, initials: str) -> tuple[list[tuple[int | None, str, str | None]], Stack]:
    """(turn's place or None, edit, new role or None) for each edit, and the stack behind them."""
    found, at = [], 0
    for edit in audit:
        role, place = None, None
        if edit != "I":
            place, initial = at, initials[at]
            at += 1
        if edit == "K":
            stack = g.shift(stack, initial)
        elif edit != "D":
            letter = next(t for t in ROLES if (stack[0], t) in g.goto)
            role, stack = ROLES[letter], g.shift(stack, letter)
        found.append((place, edit, role))
    return found, stack


def rows_of(found: list[tuple], made: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), made.types)], schema=made)


def _first(c: Column) -> Column:
    return F.min(F.struct(c.isNotNull().alias("some"), c.alias("turn")))


def flagged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault, later, twin): the fault but for duplicates; whether (role, text) has a lesser
    turn; and whether it occurs twice at all, so that the row may repeat the one in front of it."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    whole = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.withColumn("__lf_same", F.sha2(whole, 256))
    same = rows.groupBy("__lf_same").agg(F.count(F.lit(1)).alias("n"), _first(F.col("turn")).alias("first")).where("n > 1")
    same = stored(same.select("__lf_same", "n", F.col("first.turn").alias("__lf_first"), F.lit(True).alias("__lf_twin")), "said-twice")
    rows = spread_join(rows, same.drop("n"), "__lf_same", same.select("__lf_same", "n"), "left")
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", BLANK).when(F.instr(F.lit(MARKS), last) == 0, CUT).otherwise(NONE)
    twin = F.coalesce("__lf_twin", F.lit(False))
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), (twin & ~F.col("turn").eqNullSafe(F.col("__lf_first"))).alias("later"), twin.alias("twin"))


PATH = "array<struct<enter:int,leave:int,cost:long,audit:string>>"
COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long"


def segmented(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows of turns (with their segment and place in it) and, where place is null, of segments (counts, initials and
    ways through)."""
    conv = turns.schema["conv_id"].dataType
    key = ["conv_id", "turn", "role"]
    ordered = flagged(turns).withColumn("turn", F.col("turn").cast("long"))
    ordered = ordered.repartitionByRange(*key, F.substring("text", 1, HEAD)).sortWithinPartitions(*key, "text")
    own = T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string("segment long, place int, turn long, role string, text string")])
    schema = T.StructType([*own, *T._parse_datatype_string(f"{COUNTS}, initials string, ways {PATH}")])
    made = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, number = Grammar(), TaskContext.get().partitionId() << 32
        last: tuple | None = None  # conv_id, turn, role, text of the row in front
        where = number
        counts, initials, tops, size, seen = [], "", {}, 0, False

        def entered(first: bool) -> dict[int, dict[int, Top]]:
            return {s: {s: (0, "", stack)} for s, stack in ([(0, (0, None))] if first else g.seeds.items())}

        def closed(conv_id: object) -> tuple:
            ways = [{"enter": e, "leave": s, "cost": c, "audit": a} for e, t in tops.items() for s, (c, a, _) in t.items()]
            return (conv_id, where, None, None, None, None, *counts, initials, ways)

        for batch in batches:
            done, segments, places = [], [], []
            for row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault", "later", "twin"))):
                conv_id, turn, role, text, fault, later, twin = row
                other = last is None or last[0] != conv_id
                if other or size >= segment:
                    if last is not None:
                        done.append(closed(last[0]))
                        where = number = number + 1
                    # the first conversation of a range may go on from the range before
                    tops, size, initials, counts = entered(other and seen), 0, "", [0, 0, 0, 0, 0, None, None]
                    seen = True
                if fault != BLANK and (later or twin and last == row[:4]):
                    fault = DUPLICATE
                initial = role[:1] or "\0"
                if fault:
                    counts[fault - 1] += 1
                if initials and initials[-1] + initial not in LEGAL:
                    counts[3] += 1
                if turn is not None:
                    counts[4] += turn != counts[6]
                    counts[5:] = [turn if counts[5] is None else counts[5], turn]
                segments.append(where)
                places.append(size)
                tops = {e: read_turn(g, t, initial, fault) for e, t in tops.items()}
                initials, size, last = initials + initial, size + 1, row[:4]
            n = batch.num_rows
            columns = [batch.column("conv_id"), pa.array(segments, pa.int64()), pa.array(places, pa.int32()), *(batch.column(x) for x in ("turn", "role", "text"))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, t) for t in made.types[6:])], schema=made)
            if done:
                yield rows_of(done, made)
        if last is not None:
            yield rows_of([closed(last[0])], made)

    return stored(ordered.mapInArrow(read, schema), "segments")


def repair(turns: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """A report of each conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and its edits
    (conv_id, segment, n, edit, turn, role, text) in the order of (segment, n): the repaired turns are those whose edit
    isn't D, with the roles and texts they have after repair. turn is null where a turn was inserted."""
    parts = segmented(turns, segment)
    spans = parts.where("place IS NULL").drop("place", "turn", "role", "text")
    spans = spans.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    conv = turns.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, segment long, n long, place int, edit string, role string")])
    made = to_arrow_schema(schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, out = Grammar(), []
        for conv_id, group in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["conv_id"]):
            ways: dict[int, tuple[int, str]] = {0: (0, "")}
            counts, distinct, low, high, initials = [0] * 4, 0, None, None, []
            for r in group:
                new: dict[int, tuple[int, str]] = {}
                for w in r["ways"]:
                    if w["enter"] in ways:
                        cost, audit = ways[w["enter"]]
                        way = cost + w["cost"], audit + w["audit"]
                        new[w["leave"]] = min(new.get(w["leave"], way), way)
                ways = new
                counts = [a + r[n] for a, n in zip(counts, ("blank", "duplicate", "truncated", "illegal"))]
                counts[3] += bool(initials) and initials[-1][1][-1] + r["initials"][0] not in LEGAL
                distinct += r["turns"] - (r["first_turn"] is not None and r["first_turn"] == high)
                low, high = (r["first_turn"] if low is None else low), (r["last_turn"] if r["last_turn"] is not None else high)
                initials.append((r["segment"], r["initials"]))
            ends = with_inserts(g, {s: (c, a, g.seeds[s]) for s, (c, a) in ways.items()})
            cost, audit = min((c, a) for c, a, stack in ends.values() if g.accepts(stack))
            out.append((conv_id, 0 if low is None else high - low + 1 - distinct, *counts, cost, audit, *[None] * 5))
            stack, at = (0, None), 0
            for k, (where, letters) in enumerate(initials):
                to, left = at, len(letters)
                while left:
                    left -= audit[to] != "I"
                    to += 1
                to = len(audit) if k == len(initials) - 1 else to
                found, stack = edits(g, stack, audit[at:to], letters)
                at = to
                out += [(conv_id, *[None] * 7, where, n, place, edit, role) for n, (place, edit, role) in enumerate(found)]
                if len(out) >= 10_000:
                    yield rows_of(out, made)
                    out = []
        if out:
            yield rows_of(out, made)

    found = stored(spans.mapInArrow(joined, schema), "repairs")
    report = found.where("segment IS NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    own = parts.where("place IS NOT NULL").select("segment", "place", "turn", F.col("role").alias("__lf_role"), "text")
    steps = found.where("segment IS NOT NULL").select("conv_id", "segment", "n", "place", "edit", "role").join(own, ["segment", "place"], "left")
    return report, steps.select("conv_id", "segment", "n", "edit", "turn", F.coalesce("role", "__lf_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations that have turns left. A hash is read in order, so a conversation
    streams through one task, which holds one batch."""
    conv = repaired.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", conv), T.StructField("repaired_sha256", T.StringType())])
    made = to_arrow_schema(schema)
    rows = repaired.where("edit != 'D'").select("conv_id", "segment", "n", F.concat("role", F.lit(":"), "text").alias("line"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hasher, found = None, None, []
        for batch in batches:
            for conv_id, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").cast(pa.binary()).to_pylist()):
                if hasher is None or conv_id != last:
                    if hasher is not None:
                        found.append((last, hasher.hexdigest()))
                    last, hasher = conv_id, hashlib.sha256(line)
                else:
                    hasher.update(b"\n" + line)
            if len(found) >= 10_000:
                yield rows_of(found, made)
                found = []
        if hasher is not None:
            found.append((last, hasher.hexdigest()))
            yield rows_of(found, made)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "n").mapInArrow(hashed, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with faults put in by the remainder of crc32(`conv_id:turn`) by 20: 0 drops the
    row, 1 empties its text, 2 takes its marks away, 3 repeats it, 4 gives it to the user. Nulls are one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % 20
    rows = turns.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.expr("CASE WHEN kind = 3 THEN array(1, 2) ELSE array(1) END")).alias("copy"))
    return rows.drop("copy")


def of_all(turns: DataFrame, report: DataFrame, repaired: DataFrame) -> DataFrame:
    """The report with the hash of each repaired conversation, for each conversation of turns; zeros, an empty audit and
    the empty string's hash where nothing is left of one."""
    found = turns.select("conv_id").distinct().alias("c").join(report.alias("r"), F.expr("c.conv_id <=> r.conv_id"), "left")
    found = found.join(digests(repaired).alias("d"), F.expr("c.conv_id <=> d.conv_id"), "left")
    zero = lambda n: F.coalesce(f"r.{n}", F.lit(0)).cast("long").alias(n)
    counts = [zero(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("c.conv_id", *counts, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def sql() -> str:
    """The query over the damaged turns in DuckDB's SQL: the grammar as four states, and the least (cost, audit) of each
    state after each turn by recursion."""
    some = lambda c: f"coalesce({c}::VARCHAR, ' ')"
    return f"""
WITH RECURSIVE {CRC_TABLE},
marked AS (SELECT conv_id, turn, {some("role")} AS role, {some("text")} AS text, {crc_sql(f"{some('conv_id')} || ':' || {some('turn')}")} % 20 AS kind FROM conversations, crc_table),
made AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '{MARKS}', '') ELSE text END AS text,
  unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM marked WHERE kind != 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, left(role, 1) AS initial FROM made),
rows AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN instr('{MARKS}', last) = 0 THEN 't' ELSE '' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM ordered),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (k > 1 AND pair NOT IN {LEGAL}) AS illegal FROM rows GROUP BY conv_id),
-- states: E (nothing yet), S, U, A behind such a turn; what inserted turns lead from s to x
ins(s, x, n, more) AS (VALUES ('E', 'E', 0, ''), ('S', 'S', 0, ''), ('U', 'U', 0, ''), ('A', 'A', 0, ''), ('E', 'U', 1, chr(10) || 'user:'), ('S', 'U', 1, chr(10) || 'user:'), ('A', 'U', 1, chr(10) || 'user:'),
  ('U', 'A', 1, chr(10) || 'assistant:'), ('E', 'A', 2, chr(10) || 'user:' || chr(10) || 'assistant:'), ('S', 'A', 2, chr(10) || 'user:' || chr(10) || 'assistant:')),
acts(x, initial, y, name) AS (VALUES ('E', 's', 'S', NULL::VARCHAR), ('E', 'u', 'U', 'user'), ('S', 'u', 'U', 'user'), ('A', 'u', 'U', 'user'), ('U', 'a', 'A', 'assistant')),
moves AS (SELECT s, x AS y, NULL::VARCHAR AS initial, NULL::VARCHAR AS name, {DELETE} + {INSERT} * n AS cost, repeat('I', n) || 'D' AS audit, more FROM ins
  UNION ALL SELECT s, y, initial, NULL, {INSERT} * n, repeat('I', n) || 'K', more FROM ins JOIN acts USING (x)
  UNION ALL SELECT s, y, NULL, name, {REROLE} + {INSERT} * n, repeat('I', n) || 'R', more FROM ins JOIN acts USING (x) WHERE name IS NOT NULL),
p AS (SELECT conv_id, 0::BIGINT AS k, 'E' AS s, {{'cost': 0, 'audit': '', 'text': ''}} AS best FROM facts
  UNION ALL SELECT p.conv_id, p.k + 1, y, min({{'cost': best.cost + m.cost + CASE WHEN fault = 't' AND right(m.audit, 1) != 'D' THEN {TRUNCATED} ELSE 0 END, 'audit': best.audit || m.audit,
    'text': best.text || more || CASE right(m.audit, 1) WHEN 'D' THEN '' ELSE chr(10) || coalesce(m.name, r.role) || ':' || r.text END}})
  FROM p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k + 1 JOIN moves m ON m.s = p.s AND (m.initial IS NULL OR m.initial = r.initial) AND (fault NOT IN ('b', 'd') OR right(m.audit, 1) = 'D')
  GROUP BY p.conv_id, p.k, y),
done AS (SELECT f.conv_id, min({{'cost': best.cost + {INSERT} * n.n, 'audit': best.audit || repeat('I', n.n), 'text': best.text || more}}) AS best
  FROM facts f JOIN p ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.k = f.n JOIN ins n ON n.s = p.s AND n.x IN ('E', 'A') GROUP BY f.conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.text[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM i.conv_id"""
