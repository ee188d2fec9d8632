"""Repair of conversations' turn structure at least cost, with an audit of the edits.

Rows are the symbols of a weighted automaton whose states say what may come next
in `(s?(ua)+)?`, the role initials of a well-formed conversation. Edits: keep a
row (K, 0), give it the role user or assistant (R, 3), delete it (D, 4; the only
edit of a blank or duplicate row), insert an empty user or assistant row anywhere
(I, 3); a truncated row that stays costs 3 more.

The automaton is made deterministic lazily: the vector of what each state still
has to pay, less its least entry, is one state of the deterministic automaton,
and the step from it by a symbol is computed once and cached in a table. A scan
of a conversation's symbols over that table, from the last to the first, gives
the cost. The audit is traced against the scan's direction along tight arcs, over
the set of states that the ASCII-least edits so far lead to; these steps are
cached as well. Edits with equal initials give equal rows: the number of rows
that stay says whether there is a system row, and so every row's role.

Rows of a conversation pass one task, in order, as Spark has sorted them; a byte
a row is kept until the conversation ends, and texts are never kept. A hash and
an audit of a whole conversation can't be had of parts.

Defined results: conversations are ordered by turn (null first), then role and
text in byte order; null role, text, or conv_id and turn in the key of damage()
is one space; an empty role has no initial and fits no place; a conversation
without rows costs nothing, has an empty audit and the hash of nothing; null
conv_id is one conversation; an empty table gives an empty result. Repeated rows
are duplicates after the first.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import materialize, small_batches

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs of edits, and what an undeleted truncated row adds.
RETURN, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INITIALS = "sua"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: What may follow in each state; a conversation may end in 0 and 3.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
START = 0
#: A symbol is the place of a row's initial in INITIALS (3: none of them) and four times its fault.
SOUND, CUT, GONE = range(3)
_NEVER = 1 << 40


class Repairer:
    """The deterministic automaton as far as rows have asked for it."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.steps: list[dict[int, tuple[int, int]]] = []
        self.moves: dict[tuple[int, int, frozenset[int]], tuple[str, frozenset[int]]] = {}
        self.end, _ = self._state([0 if q in ACCEPTING else _NEVER for q in range(len(NEXT))])

    @staticmethod
    def _with_inserts(cost: list[int]) -> list[int]:
        """What each state has to pay if rows may be inserted first."""
        cost = list(cost)
        for _ in NEXT:  # a chain of inserts passes each state once
            for q, after in enumerate(NEXT):
                cost[q] = min([cost[q], *(INSERT + cost[after[r]] for r in "ua" if r in after)])
        return cost

    def _state(self, cost: list[int]) -> tuple[int, int]:
        cost = self._with_inserts(cost)
        least = min(cost)
        vector = tuple(c - least for c in cost)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.steps.append({})
        return self.ids[vector], least

    @staticmethod
    def _arcs(q: int, symbol: int) -> list[tuple[str, int, int]]:
        """Edits of a row in a state: initial, cost, next state."""
        fault, role = divmod(symbol, 4)
        out = [("D", DELETE, q)]
        if fault != GONE:
            more = TRUNCATED if fault == CUT else 0
            initial = INITIALS[role] if role < 3 else ""
            if initial in NEXT[q]:
                out.append(("K", more, NEXT[q][initial]))
            out += [("R", RETURN + more, NEXT[q][r]) for r in "ua" if r in NEXT[q] and r != initial]
        return out

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state before a row, from the one after it, and the cost that leaves the vector."""
        found = self.steps[state].get(symbol)
        if found is None:
            after = self.vectors[state]
            found = self.steps[state][symbol] = self._state([min(c + after[to] for _, c, to in self._arcs(q, symbol)) for q in range(len(NEXT))])
        return found

    def _move(self, state: int, symbol: int, where: frozenset[int]) -> tuple[str, frozenset[int]]:
        """The ASCII-least edits up to and with a row, after which `state` holds, from each of some equally good states."""
        after = self.vectors[state]
        arcs = {q: [(e, c + after[to], to) for e, c, to in self._arcs(q, symbol)] for q in range(len(NEXT))}
        cost = self._with_inserts([min(c for _, c, _ in arcs[q]) for q in range(len(NEXT))])
        said = ""
        while True:
            tight = {(e, to) for q in where for e, c, to in arcs[q] if c == cost[q]}
            tight |= {("I", NEXT[q][r]) for q in where for r in "ua" if r in NEXT[q] and INSERT + cost[NEXT[q][r]] == cost[q]}
            edit = min(e for e, _ in tight)
            said, where = said + edit, frozenset(to for e, to in tight if e == edit)
            if edit != "I":
                return said, where

    def repair(self, symbols: bytes | array) -> tuple[int, str]:
        """The least cost of a conversation's symbols, and the edits' initials."""
        states, cost = array("I", [self.end]), 0
        state, steps = self.end, self.steps
        for symbol in reversed(symbols):
            state, least = steps[state].get(symbol) or self.step(state, symbol)
            cost += least
            states.append(state)
        cost += self.vectors[state][START]
        said, where, moves = [], frozenset([START]), self.moves
        for i, symbol in enumerate(symbols):
            key = (states[len(symbols) - 1 - i], symbol, where)
            found = moves.get(key)
            if found is None:
                found = moves[key] = self._move(*key)
            said.append(found[0])
            where = found[1]
        last = self.vectors[self.end]
        while any(last[q] for q in where):
            said.append("I")
            where = frozenset(NEXT[q][r] for q in where for r in "ua" if r in NEXT[q] and INSERT + last[NEXT[q][r]] == last[q])
        return cost, "".join(said)


def roles_of(audit: str) -> Iterator[str]:
    """The role initials of the rows that an audit leaves, in order: a system row first if their number is odd."""
    n = len(audit) - audit.count("D")
    if n % 2:
        yield "s"
    for _ in range(n // 2):
        yield from "ua"


# ---- rows and their symbols -----------------------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the faults that crc32(conv_id:turn) modulo 20 asks for: 0 drops the row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes the user say it."""

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(known("text"), ENDS, "")).otherwise(known("text"))
    role = F.when(fault == 4, "user").otherwise(known("role"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return turns.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, again (0 for the first row of a role and text), symbol. Rows are told to be equal by their texts' digests, each digest's rows in one place, whatever the conversation's size."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    same = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when((last == "") | (F.col("again") > 0), GONE).when(~last.isin(*ENDS), CUT).otherwise(SOUND)
    told = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    told = told.withColumn("again", F.least(F.row_number().over(same) - 1, F.lit(1)))
    return told.select("*", (place + 4 * fault).alias("symbol"), (last == "").alias("blank"))


def _in_order(df: DataFrame, *before: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *before, F.col("turn").asc_nulls_first(), "role", "text", "again")


def repair_plans(marked: DataFrame) -> DataFrame:
    """Of rows with symbols: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([marked.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in names), T.StructField("audit", T.StringType())])

    def plan(batches):
        repairer, now, own = Repairer(), None, []
        held: bytearray = bytearray()
        legal = {(INITIALS.index(a), INITIALS.index(b)) for a, b in ("su", "ua", "au")}
        blank = distinct = 0
        low = high = None

        def told():
            gaps = 0 if low is None else high - low + 1 - distinct
            faults = [s // 4 for s in held]
            illegal = sum((a % 4, b % 4) not in legal for a, b in zip(held, held[1:]))
            cost, audit = repairer.repair(bytes(held))
            return [own[0], gaps, blank, faults.count(GONE) - blank, faults.count(CUT), illegal, cost, audit]

        for batch in batches:
            out = []
            for key, turn, symbol, no_text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "symbol", "blank")], strict=True):
                if not own or key != now:
                    if own:
                        out.append(told())
                    now, own = key, [key]
                    held, blank, distinct, low, high = bytearray(), 0, 0, None, None
                held.append(symbol)
                blank += no_text
                if turn is not None and turn != high:
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
            yield _batch(out, types)
        if own:
            yield _batch([told()], types)

    types = _types(schema)
    return _in_order(marked).select("conv_id", "turn", "symbol", "blank").mapInArrow(plan, schema)


def _types(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def repaired_rows(marked: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: the rows that stay or are inserted, in order within each partition, a conversation in one of them."""
    schema = T.StructType([marked.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    heads = plans.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(marked.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("again"))
    rows = marked.select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", "again")

    def apply(batches):
        conv, edits, wanted, place = None, iter(()), iter(()), 0

        def until_row():
            """Inserted rows, then the edit of the next row, if there is one."""
            nonlocal place
            for edit in edits:
                if edit != "I":
                    return edit
                out.append([conv, place, "I", ROLES[next(wanted)], ""])
                place += 1

        for batch in batches:
            out: list = []
            for key, part, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text")], strict=True):
                if part == 0:
                    until_row()
                    conv, edits, wanted, place = key, iter(text), roles_of(text), 0
                    continue
                edit = until_row()
                if edit != "D":
                    initial = next(wanted)
                    out.append([conv, place, edit, role if edit == "K" else ROLES[initial], text])
                    place += 1
            yield _batch(out, types)
        out = []
        until_row()
        yield _batch(out, types)

    types = _types(schema)
    return _in_order(heads.unionByName(rows), "part").select("conv_id", "part", "role", "text").mapInArrow(apply, schema)


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """Of rows as repaired_rows() gives them: conv_id, repaired_sha256 of `role:text` lines."""
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def digest(batches):
        conv, now = None, None
        for batch in batches:
            out = []
            for key, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")], strict=True):
                if place == 0:
                    if now:
                        out.append([conv, now.hexdigest()])
                    conv, now = key, hashlib.sha256()
                now.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield _batch(out, types)
        if now:
            yield _batch([[conv, now.hexdigest()]], types)

    types = _types(schema)
    return repaired.mapInArrow(digest, schema)


def repair_summaries(original: DataFrame, rows: DataFrame) -> DataFrame:
    """For each conv_id of `original`, what is wrong with its `rows`, the cheapest repair and its digest."""
    spark = rows.sparkSession
    small_batches(spark)
    marked = materialize(symbols(rows), "turns")
    plans = materialize(repair_plans(marked), "repairs")
    digests = repaired_digests(repaired_rows(marked, plans))
    of = original.select("conv_id").distinct().alias("o")
    found = of.join(plans.alias("p"), F.expr("o.conv_id <=> p.conv_id"), "left").join(digests.alias("d"), F.expr("o.conv_id <=> d.conv_id"), "left")
    numbers = [F.coalesce(f"p.{c}", F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("o.conv_id", *numbers, F.coalesce("p.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_summaries(turns, damage(turns))


def _least(q: int, ways: list[tuple[str, int]]) -> str:
    """The cheapest edit of a row in state q, by ways to keep it: (initial, next state)."""
    arcs = [f"{{'c': {DELETE} + h{q}.c, 'a': 'D' || h{q}.a}}"]
    arcs += [f"{{'c': CASE WHEN fault < {GONE} AND initial = '{r}' THEN h{to}.c + CASE fault WHEN {CUT} THEN {TRUNCATED} ELSE 0 END ELSE 1000000000 END, 'a': 'K' || h{to}.a}}" for r, to in ways]
    arcs += [f"{{'c': CASE WHEN fault < {GONE} THEN {RETURN} + h{to}.c + CASE fault WHEN {CUT} THEN {TRUNCATED} ELSE 0 END ELSE 1000000000 END, 'a': 'R' || h{to}.a}}" for r, to in ways if r != "s"]
    return f"list_sort([{', '.join(arcs)}])[1] AS g{q}"


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP12_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ord(k[i]) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS d FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM summed WHERE d <> 0
), seen AS (
  SELECT *, right(rtrim(text, {_BLANK}), 1) AS last, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM damaged
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM seen
), marked AS (
  SELECT *, CASE WHEN last = '' OR again > 1 THEN {GONE} WHEN last NOT IN ('.', '!', '?') THEN {CUT} ELSE {SOUND} END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (last = '') AS blank, count(*) FILTER (fault = {GONE} AND last <> '') AS duplicate, count(*) FILTER (fault = {CUT}) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), scan AS (
  SELECT conv_id, n AS i, {{'c': 0, 'a': ''}} AS h0, {{'c': {2 * INSERT}, 'a': 'II'}} AS h1, {{'c': {INSERT}, 'a': 'I'}} AS h2, {{'c': 0, 'a': ''}} AS h3 FROM (SELECT DISTINCT conv_id, n FROM marked)
  UNION ALL
  SELECT conv_id, i, list_sort([g0, {{'c': {INSERT} + h2.c, 'a': 'I' || h2.a}}])[1], list_sort([g1, {{'c': {INSERT} + h2.c, 'a': 'I' || h2.a}}])[1], h2, h3
  FROM (SELECT *, list_sort([g2, {{'c': {INSERT} + g3.c, 'a': 'I' || g3.a}}])[1] AS h2, list_sort([g3, {{'c': {INSERT} + g2.c, 'a': 'I' || g2.a}}])[1] AS h3
    FROM (SELECT s.conv_id, s.i - 1 AS i, {_least(0, [("s", 1), ("u", 2)])}, {_least(1, [("u", 2)])}, {_least(2, [("a", 3)])}, {_least(3, [("u", 2)])}
      FROM scan s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.i = s.i))
), plans AS (
  SELECT conv_id, h0.c AS cost, h0.a AS audit, length(replace(h0.a, 'D', '')) AS stay FROM scan WHERE i = 0
), edits AS (
  SELECT conv_id, stay, e, p, sum(CASE e WHEN 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE e WHEN 'D' THEN 0 ELSE 1 END) OVER w AS place
  FROM (SELECT conv_id, stay, audit[p] AS e, p FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM plans)) WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), lines AS (
  SELECT e.conv_id, p, CASE WHEN e = 'K' THEN m.role WHEN (place - stay) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE e WHEN 'I' THEN '' ELSE m.text END AS line
  FROM edits e LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.i = e.i WHERE e <> 'D'
), digests AS (
  SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS repaired_sha256 FROM lines GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
