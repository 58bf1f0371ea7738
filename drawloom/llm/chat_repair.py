"""Conversation structure repair by Knuth's lightest derivation.

A conversation's rows, in the order of their turns (nulls first; equal turns by role, then by SHA-256 of the text), are
edited so that the role initials read ``(s?(ua)+)?``. Keep costs nothing, Rerole (to user or assistant) 3, Delete 4,
Insert (an empty user or assistant text) 3, and a truncated row that is not deleted 3 more. Blank rows and duplicates
must be deleted. Of the cheapest edits those whose initials (K, R, D, I, in order) are least in ASCII are taken.

**Deductions.** An item (rank, state) says that the first ``rank`` rows are repaired and what may follow; an edit of the
next row, or an insertion, derives another item. An item weighs (cost, rank, audit). Each deduction adds a cost above
nothing or a rank, so it is superior: no item weighs less than what it is derived from. It is monotone too: two audits
of the same rows and cost never begin with one another, as what the longer one has more would be insertions. So an
agenda that pops the lightest item finalises each item once, and the first goal popped is the answer (``lightest``).

**Long conversations** are cut into parts of ``PART`` rows. Each part is solved apart from and to every state; the
parts' results, which hold one letter a row, are put together in order, and the texts follow their part's edits. Rows
are numbered over sorted ranges, so no conversation is sorted or gathered whole; texts pass through memory part by part,
also into the hash of the whole conversation, which one task must read in order. Duplicates are found by grouping on
(conversation, role, SHA-256 of the text) and an ordinary join.

Nulls: a null conv_id is a conversation of its own; a null turn comes first; null role and text are one space. Roles
count by their first letter: s, u and a as they are, any other (or none, for an empty role) cannot be kept. Repeated rows
are kept apart and become duplicates. Other columns are not used. A conversation of which no row is left has zeros,
an empty audit and the hash of the empty string.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.llm.common import spread_rows, stored
from drawloom.llm.source_mix import numbered

PART = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What may follow: anything, u after s, a after u, u or the end after a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (START, ASSISTANT)
BLANK, DUPLICATE, CUT, SOUND = "bdt-"
_TEXT = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def steps(state: int, code: str) -> list[tuple[int, str, int]]:
    """Edits of one row, given as initial and fault: (cost, letter, next state)."""
    initial, fault = code
    out = [(DELETE, "D", state)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED if fault == CUT else 0
    if (state, initial) in NEXT:
        out.append((more, "K", NEXT[state, initial]))
    return out + [(REROLE + more, "R", NEXT[state, x]) for x in "ua" if (state, x) in NEXT]


def lightest(codes: str, start: int = START, goals: tuple[int, ...] | None = ACCEPTING) -> dict[int, tuple[int, str]]:
    """The lightest derivation of the goal as {end: (cost, audit)}; with ``goals`` None, of every end there is."""
    n = len(codes) // 2
    agenda, final, ends = [(0, 0, "", start)], set(), {}
    while agenda:
        cost, rank, audit, state = heapq.heappop(agenda)
        if (rank, state) in final:
            continue
        final.add((rank, state))
        if rank == n and (goals is None or state in goals):
            ends[state] = (cost, audit)
            if goals is not None:
                break
        for x in "ua":
            if (to := NEXT.get((state, x))) is not None and (rank, to) not in final:
                heapq.heappush(agenda, (cost + INSERT, rank, audit + "I", to))
        if rank < n:
            for more, letter, to in steps(state, codes[2 * rank : 2 * rank + 2]):
                if (rank + 1, to) not in final:
                    heapq.heappush(agenda, (cost + more, rank + 1, audit + letter, to))
    return ends


def repaired(lines: list[dict], audit: str, state: int = START) -> list[str]:
    """The lines that the edits leave, as role:text."""
    out, rows = [], iter(lines)
    for letter in audit:
        row = next(rows) if letter != "I" else {"role": "", "text": ""}
        if letter == "D":
            continue
        initial = row["role"][:1] if letter == "K" else "a" if state == USER else "u"
        role = row["role"] if letter == "K" else {"u": "user", "a": "assistant"}[initial]
        out.append(f"{role}:{row['text']}")
        state = NEXT[state, initial]
    return out


def illegal(initials: str) -> int:
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def joined(parts: list[dict]) -> tuple[int, str, list[tuple[int, int, str]]]:
    """Parts in order, each with its ways (start, end, cost, audit): the cost, the audit and (part, start, audit) of each."""
    best = {START: (0, "", None)}
    for part in parts:
        after: dict[int, tuple] = {}
        for way in part["ways"]:
            if way["start"] not in best:
                continue
            cost, audit, _ = best[way["start"]]
            cost += way["cost"]
            held = after.get(way["end"])
            if held is None or cost < held[0] or cost == held[0] and audit + way["audit"] < held[1]:
                after[way["end"]] = (cost, audit + way["audit"], (best[way["start"]][2], part["part"], way["start"], way["audit"]))
        best = after
    cost, audit, trail = min((best[q] for q in ACCEPTING if q in best), key=lambda b: b[:2])
    pieces = []
    while trail is not None:
        trail, *piece = trail
        pieces.append(tuple(piece))
    return cost, audit, pieces[::-1]


def _mapped(df: DataFrame, one: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows to rows, in the order of the partition; ``one`` gets a row as a dict."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = [out for row in batch.slice(at, 16).to_pylist() for out in one(row)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=types)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by the checksum of ``conv_id:turn`` modulo 20."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return conversations.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def conversation_key(conv_id: Column) -> Column:
    """Never null, so that it meets itself in joins."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with their key, a row number (salt), the digest of the text and what the text alone says of its fault."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    rows = rows.select(conversation_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    own = F.when(~F.col("text").rlike(_TEXT), BLANK).when(~F.col("text").rlike(_ENDED), CUT).otherwise(SOUND)
    return stored(rows.withColumns({"digest": F.sha2("text", 256), "salt": F.monotonically_increasing_id(), "own": own}))


def judged(rows: DataFrame) -> DataFrame:
    """Without texts: the place of each row in the order of all conversations, and its code: role initial and first fault."""
    slim = rows.drop("text")
    first = slim.groupBy("key", "role", "digest").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("turn", "salt"))["salt"].alias("first"))
    found = slim.join(first.filter("times > 1").drop("times"), ["key", "role", "digest"], "left")
    again = F.col("first").isNotNull() & (F.col("first") != F.col("salt"))
    fault = F.when(again & (F.col("own") != BLANK), DUPLICATE).otherwise(F.col("own"))
    initial = F.substring("role", 1, 1)
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault)
    found = found.select("key", "turn", "role", "digest", "salt", code.alias("code"))
    return stored(numbered(found, [F.col(c) for c in ("key", "turn", "role", "digest", "salt")], "place").drop("role", "digest"))


def repair(rows: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Repairs every conversation of ``rows`` (conv_id, turn, role, text).

    Returns one row per conversation (key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) and
    the repaired texts by part (key, part, repaired: lines role:text).
    """
    texts = keyed(rows)
    rows = judged(texts)
    fault = F.substring("code", 2, 1)
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": CUT}
    totals = rows.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"), F.coalesce(turns, F.lit(0)).alias("gaps"), *(F.count_if(fault == f).alias(c) for c, f in counts.items()))
    totals = stored(totals)
    at = F.col("place") - F.col("first")
    placed = rows.join(totals.select("key", "first", "rows"), "key").select("key", "salt", F.floor(at / part).alias("part"), F.ceil(F.col("rows") / part).alias("parts"), at.alias("at"), "code")
    placed = placed.join(texts.select("salt", "role", "text"), "salt").select("key", "part", "parts", F.struct("at", "code", "role", "text").alias("line"))
    lines = F.array_sort(F.collect_list("line"))
    parts = placed.groupBy("key", "part").agg(F.max("parts").alias("parts"), lines.alias("lines"))
    parts = stored(parts.select("key", "part", "parts", F.array_join("lines.code", "").alias("codes"), F.transform("lines", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("lines")))

    def whole(row: dict) -> Iterator[tuple]:
        ((cost, audit),) = lightest(row["codes"]).values()
        text = "\n".join(repaired(row["lines"], audit))
        yield row["key"], illegal(row["codes"][::2]), cost, audit, 0, text, hashlib.sha256(text.encode()).hexdigest()

    short = stored(_mapped(parts.filter("parts = 1"), whole, "key string, illegal long, cost long, audit string, part long, repaired string, repaired_sha256 string"))

    def ways(row: dict) -> Iterator[tuple]:
        found = [(q, end, *best) for q in range(4) for end, best in lightest(row["codes"], q, None).items()]
        initials = row["codes"][::2]
        yield row["key"], row["part"], illegal(initials), initials[0] + initials[-1], [dict(zip(("start", "end", "cost", "audit"), w, strict=True)) for w in found]

    kind = "array<struct<start:int,end:int,cost:long,audit:string>>"
    solved = _mapped(spread_rows(parts.filter("parts > 1").select("key", "part", "codes")), ways, f"key string, part long, illegal long, edge string, ways {kind}")
    solved = solved.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "illegal", "edge", "ways"))).alias("parts"))

    def fold(row: dict) -> Iterator[tuple]:
        cost, audit, pieces = joined(row["parts"])
        edges = [p["edge"] for p in row["parts"]]
        bad = sum(p["illegal"] for p in row["parts"]) + sum(illegal(a[1] + b[0]) for a, b in zip(edges, edges[1:], strict=False))
        yield row["key"], bad, cost, audit, [dict(zip(("part", "start", "audit"), p, strict=True)) for p in pieces]

    long = stored(_mapped(solved, fold, "key string, illegal long, cost long, audit string, pieces array<struct<part:long,start:int,audit:string>>"))
    pieces = long.select("key", F.explode("pieces").alias("p")).select("key", "p.*").withColumnRenamed("audit", "edits")
    work = parts.filter("parts > 1").select("key", "part", "lines").join(pieces, ["key", "part"])
    edited = stored(_mapped(work, lambda row: [(row["key"], row["part"], "\n".join(repaired(row["lines"], row["edits"], row["start"])))], "key string, part long, repaired string"))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, first = None, None, True
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                if k.as_py() != key:
                    if digest is not None:
                        yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [digest.hexdigest()]})
                    key, digest, first = k.as_py(), hashlib.sha256(), True
                if text.as_py():
                    digest.update((("" if first else "\n") + text.as_py()).encode())
                    first = False
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [digest.hexdigest()]})

    digests = edited.repartition("key").sortWithinPartitions("key", "part").select("key", "repaired").mapInArrow(hashed, "key string, repaired_sha256 string")
    columns = ["key", "illegal", "cost", "audit", "repaired_sha256"]
    all_ = short.select(columns).unionByName(long.join(digests, "key").select(columns))
    return totals.drop("first", "rows").join(all_, "key"), short.select("key", "part", "repaired").unionByName(edited)


def report(conversations: DataFrame, damage: bool = False, part: int = PART) -> DataFrame:
    """One row per conv_id of ``conversations``: its faults and its cheapest repair. ``damage`` damages the rows first."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    found, _ = repair(damaged(rows) if damage else rows, part)
    out = rows.select("conv_id").distinct().withColumn("key", conversation_key(F.col("conv_id"))).join(found, "key", "left")
    zeros = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select("conv_id", *(v.alias(c) for c, v in zeros.items()), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same for DuckDB over the table ``conversations``: best repairs of the first i rows, i by i, with up to two insertions.
REPAIR_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b, 0 AS k, b AS c FROM (SELECT unnest(range(256)) AS b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
      lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM named WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged
), rows AS MATERIALIZED (
  SELECT conv_id, i, turn, role, text, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS x,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault FROM placed
), next(q, x, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts AS (
  SELECT q, q AS r, 0 AS cost, '' AS audit, '' AS lines FROM (VALUES (0), (1), (2), (3)) v(q)
  UNION ALL SELECT q, r, 3, 'I', CASE r WHEN 2 THEN 'user:' ELSE 'assistant:' END || chr(10) FROM next WHERE x <> 's'
  UNION ALL SELECT a.q, b.r, 6, 'II', CASE a.r WHEN 2 THEN 'user:' ELSE 'assistant:' END || chr(10) || CASE b.r WHEN 2 THEN 'user:' ELSE 'assistant:' END || chr(10)
    FROM next a JOIN next b ON a.r = b.q WHERE a.x <> 's' AND b.x <> 's'
), edits AS MATERIALIZED (
  SELECT conv_id, i, q, q AS r, 4 AS cost, 'D' AS audit, '' AS lines FROM rows, (VALUES (0), (1), (2), (3)) v(q)
  UNION ALL SELECT conv_id, i, q, r, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', role || ':' || text || chr(10) FROM rows JOIN next USING (x) WHERE fault IN ('t', '-')
  UNION ALL SELECT conv_id, i, q, r, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', CASE r WHEN 2 THEN 'user:' ELSE 'assistant:' END || text || chr(10)
    FROM rows, next WHERE fault IN ('t', '-') AND next.x <> 's'
), best AS (
  SELECT conv_id, 0::BIGINT AS i, s.r AS q, {'cost': s.cost, 'audit': s.audit, 'lines': s.lines} AS b FROM (SELECT DISTINCT conv_id FROM rows), inserts s WHERE s.q = 0
  UNION ALL
  SELECT b.conv_id, b.i + 1, s.r, min({'cost': b.b.cost + e.cost + s.cost, 'audit': b.b.audit || e.audit || s.audit, 'lines': b.b.lines || e.lines || s.lines})
  FROM best b JOIN edits e ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = b.i + 1 AND e.q = b.q JOIN inserts s ON s.q = e.r GROUP BY ALL
), ends AS (
  SELECT b.conv_id, min(b.b) AS b FROM best b JOIN (SELECT conv_id, max(i) AS n FROM rows GROUP BY ALL) m
    ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND b.i = m.n WHERE q IN (0, 3) GROUP BY ALL
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate,
    count_if(fault = 't') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM rows) GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
  coalesce(b.audit, '') AS audit, sha256(coalesce(left(b.lines, length(b.lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
