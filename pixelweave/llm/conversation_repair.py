"""Cheapest repair of conversations to ``(s?(ua)+)?`` by depth-first branch and bound.

A conversation's rows stream through one task in their order, so a task holds a
few bytes a row: the row's letter, its fault and a digest against repeats. The
search walks nodes (rows consumed, what the output ends with) with an explicit
stack. Lower bounds of all suffixes come from one sweep from the back; a branch
ends where its cost and the bound exceed the incumbent (cost, audit), or where
its node was reached before at no higher cost: the least bound is followed
first, in ASCII order among equals, so what came first also has the lesser
audit, and the bounds being tight, the first leaf proves itself. A second pass streams the rows
again, led by the audit, into the digest of the repaired text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Costs of the edits Delete, Insert, Keep and Rerole, and of a truncated row that stays.
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED = 1
#: The output so far ends with nothing, a system, a user or an assistant turn; what must follow; where that leads.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEEDS, LEADS = "uuau", (USER, USER, ASSISTANT, USER)
ROLES = {"u": "user", "a": "assistant"}
_SPACE = r"\x20\x09-\x0D"
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def edits(rows: list[tuple[str, bool, bool]], i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, rows consumed, state) of each edit at a node, in ASCII order; a row is (initial, must go, truncated)."""
    if i < len(rows):
        initial, gone, cut = rows[i]
        yield "D", COST["D"], i + 1, state
    yield "I", COST["I"], i, LEADS[state]
    if i < len(rows) and not gone:
        if initial == NEEDS[state]:
            yield "K", COST["K"] + TRUNCATED * cut, i + 1, LEADS[state]
        else:
            if initial == "s" and state == NOTHING:
                yield "K", COST["K"] + TRUNCATED * cut, i + 1, SYSTEM
            yield "R", COST["R"] + TRUNCATED * cut, i + 1, LEADS[state]


def bounds(rows: list[tuple[str, bool, bool]]) -> array:
    """At 4 i + state: the least that rows i and on can cost from there, whatever the audit."""
    n, never = len(rows), 2**30
    out = array("i", bytes(16 * (n + 1)))
    for i in range(n, -1, -1):
        if i == n:
            own = [0, never, never, 0]
        else:
            own = [min(c + out[4 * (i + 1) + s] for letter, c, _, s in edits(rows, i, state) if letter != "I") for state in range(4)]
        once = [COST["I"] + own[LEADS[s]] for s in range(4)]
        twice = [2 * COST["I"] + own[LEADS[LEADS[s]]] for s in range(4)]  # a third insertion leads back
        for s in range(4):
            out[4 * i + s] = min(own[s], once[s], twice[s])
    return out


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair, the ASCII-least among equals."""
    n, least = len(rows), bounds(rows)
    best, audit = 5 * n + 1, None  # deleting all rows costs less
    reached: dict[int, int] = {}  # node -> least cost it was reached at
    stack = [(0, 0, NOTHING, None)]  # cost, rows consumed, state, edits so far as (edits before, letter)
    while stack:
        cost, i, state, path = stack.pop()
        # what comes later at an equal cost has the greater audit
        if cost + least[4 * i + state] >= best or reached.get(4 * i + state, best) <= cost:
            continue
        reached[4 * i + state] = cost
        if i == n and state in (NOTHING, ASSISTANT):
            best, audit = cost, path
            continue
        found = [(cost + c, j, s, (path, letter)) for letter, c, j, s in edits(rows, i, state)]
        stack += sorted(reversed(found), key=lambda x: -x[0] - least[4 * x[1] + x[2]])  # the least bound on top, ASCII order among equals
    letters = []
    while audit is not None:
        audit, letter = audit
        letters.append(letter)
    return best, "".join(reversed(letters))


@lru_cache(maxsize=50_000)
def _short(code: bytes) -> tuple[int, str]:
    return cheapest(_decoded(code))


def _decoded(code: bytes) -> list[tuple[str, bool, bool]]:
    return [("-sua"[c & 3], bool(c & 4), bool(c & 8)) for c in code]


def solved(code: bytes) -> tuple[int, str]:
    """``cheapest`` of rows as bytes: initial in two bits, must go, truncated; short ones are remembered."""
    return _short(code) if len(code) <= 64 else cheapest(_decoded(code))


class _Conversation:
    """What is known of the rows so far."""

    def __init__(self) -> None:
        self.code, self.seen, self.last = bytearray(), set(), None
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, blank: bool, cut: bool, digest: bytes) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        again, cut = not blank and digest in self.seen, cut and not blank
        self.seen.add(digest)
        cut = cut and not again
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + cut
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.code.append(max("-sua".find(initial), 0) if initial else 0)
        self.code[-1] |= 4 * (blank or again) | 8 * cut

    def figures(self) -> list:
        cost, audit = solved(bytes(self.code))
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list]]:
    """(whether a conversation begins, the row) of sorted batches whose first column is its key."""
    before = object()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[0] != before, row
            before = row[0]


def _written(rows: Iterator[list], schema: pa.Schema, at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[list] = []
    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _audits(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[list]:
        key, own = None, None
        for begins, (conv, turn, initial, blank, cut, digest) in _runs(batches):
            if begins:
                if own:
                    yield [key, *own.figures()]
                key, own = conv, _Conversation()
            own.add(turn, initial, blank, cut, digest)
        if own:
            yield [key, *own.figures()]

    return _written(each(), schema)


class _Repaired:
    """Digest of ``role:text`` lines as rows pass by."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sha, self.lines = audit, 0, NOTHING, hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
        self.lines += 1

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.line(ROLES[NEEDS[self.state]], "")
            self.state, self.at = LEADS[self.state], self.at + 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            system = edit == "K" and self.state == NOTHING and role[:1] == "s"
            self.line(role if edit == "K" else ROLES[NEEDS[self.state]], text)
            self.state = SYSTEM if system else LEADS[self.state]

    def digest(self) -> str:
        self.inserted()
        return self.sha.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[list]:
        head, own = None, None
        for begins, (conv, role, text, *figures) in _runs(batches):
            if begins:  # the row that leads a conversation holds its figures and audit
                if own:
                    yield [*head, own.digest()]
                head, own = [conv, *figures], _Repaired(figures[-1])
            else:
                own.row(role, text)
        if own:
            yield [*head, own.digest()]

    return _written(each(), schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``conv``, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows go by (turn, role, text), nulls first, so ties of a turn have one
    order; a null role or text counts as one space. A null ``conv`` is a
    conversation of its own. Other columns are not read, whatever their names.
    A conversation without a row is none; an empty table gives no rows. A hot
    conversation is one task, as its audit and digest are sequences, but its
    texts pass through and only about a hundred bytes a row are held.
    """
    kind, none = rows.schema[conv].dataType, lambda c, t: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(t))
    own = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), none(role, " ").alias("role"), none(text, " ").alias("text"))
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    codes = own.repartition("conv").sortWithinPartitions(*order).select("conv", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"), digest.alias("digest"))
    key = pa.string() if kind.simpleString() == "string" else pa.int32() if kind.simpleString() == "int" else pa.int64()
    shape = pa.schema([("conv", key), *((c, pa.int64()) for c in FIGURES), ("audit", pa.string())])
    ddl = f"conv {kind.simpleString()}, {', '.join(f'{c} long' for c in FIGURES)}, audit string"
    audits = codes.mapInArrow(lambda b: _audits(b, shape), ddl)
    lead = audits.select("conv", F.lit(0).alias("body"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), *FIGURES, "audit")
    body = own.select("conv", F.lit(1).alias("body"), "turn", "role", "text", *(F.lit(None).cast("long").alias(c) for c in FIGURES), F.lit(None).cast("string").alias("audit"))
    both = lead.unionByName(body).repartition("conv").sortWithinPartitions(order[0], "body", *order[1:]).select("conv", "role", "text", *FIGURES, "audit")
    full = shape.append(pa.field("repaired_sha256", pa.string()))
    return both.mapInArrow(lambda b: _digests(b, full), f"{ddl}, repaired_sha256 string").withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the contract's damage by crc32 of ``conv_id:turn``; a null is one space, in that key too."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate: Column = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(fate == 4, "user").otherwise(spaced("role"))
    copies = F.when(fate == 0, F.array().cast("array<int>")).when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    every, done = rows.select("conv_id").distinct(), repair(damaged(rows)).withColumnRenamed("conv_id", "of")
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in FIGURES), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
#: Bitwise CRC; then one step a row: the least ``cost || audit`` of each of the four states, letters to rows by counting, and the digest.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({k}, ''), lambda c: ascii(c)::UBIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), list_transform(range(8), lambda j: j::UBIGINT)), lambda r, j: xor(r >> 1, 3988292384::UBIGINT * (r & 1::UBIGINT)))), 4294967295::UBIGINT)"
_ADD = "(lpad((left({0}, 9)::INT + {1})::VARCHAR, 9, '0') || substr({0}, 10) || '{2}')"


def _grown(state: str, cost: str, letters: str) -> str:
    return _ADD.format(state, cost, letters)


SQL = {
    "op13_conversation_repair": f"""WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(k="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations),
d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM d),
k AS (SELECT *, cut = '' AS bl, cut <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS du, left(role, 1) AS c,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM o),
r AS (SELECT *, NOT bl AND NOT du AND right(cut, 1) NOT IN ('.', '!', '?') AS tr FROM k),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (bl) AS blank, count(*) FILTER (du) AS duplicate,
    count(*) FILTER (tr) AS truncated, count(*) FILTER (was IS NOT NULL AND was || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
step AS (
  SELECT conv_id, 0::BIGINT AS i, n, '000000000' AS e, '900000000' AS s, '900000000' AS u, '900000000' AS a FROM f
  UNION ALL
  SELECT p.conv_id, p.i + 1, p.n, {_grown('e', '3', 'D')},
    CASE WHEN NOT gone AND c = 's' THEN least({_grown('s', '3', 'D')}, {_grown('e', 'tr::INT', 'K')}) ELSE {_grown('s', '3', 'D')} END,
    CASE WHEN gone THEN {_grown('u', '3', 'D')} WHEN c = 'u' THEN least({_grown('u', '3', 'D')}, {_grown('least(e, s, a)', 'tr::INT', 'K')})
      ELSE least({_grown('u', '3', 'D')}, {_grown('least(e, s, a)', '2 + tr::INT', 'R')}) END,
    CASE WHEN gone THEN {_grown('a', '3', 'D')} WHEN c = 'a' THEN least({_grown('a', '3', 'D')}, {_grown('u', 'tr::INT', 'K')})
      ELSE least({_grown('a', '3', 'D')}, {_grown('u', '2 + tr::INT', 'R')}) END
  FROM (SELECT conv_id, i, n, e, s, least(u, {_grown('least(e, s, a)', '2', 'I')}) AS u, least(a, {_grown('u', '2', 'I')}, {_grown('least(e, s)', '4', 'II')}) AS a FROM step WHERE i < n) p
  JOIN (SELECT conv_id, i, c, tr, bl OR du AS gone FROM r) q ON q.conv_id IS NOT DISTINCT FROM p.conv_id AND q.i = p.i + 1),
best AS (SELECT conv_id, least(e, a, {_grown('u', '2', 'I')}, {_grown('s', '4', 'II')}) AS x FROM step WHERE i = n),
l AS (SELECT conv_id, p, x[p] AS letter, sum((x[p] <> 'I')::INT) OVER w AS i, sum((x[p] <> 'D')::INT) OVER w AS q
  FROM (SELECT conv_id, substr(x, 10) AS x, unnest(range(1, length(x) - 8)) AS p FROM best) WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
m AS (SELECT l.conv_id, p, letter, q, r.role, r.text,
    max((letter = 'K' AND r.role[1] = 's')::INT) OVER (PARTITION BY l.conv_id) AS has_s
  FROM l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.letter <> 'I' WHERE letter <> 'D'),
t AS (SELECT conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (q - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END END
    || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM m GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(x, 9)::BIGINT, 0) AS cost, coalesce(substr(x, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) z LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id
  LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM z.conv_id"""
}
