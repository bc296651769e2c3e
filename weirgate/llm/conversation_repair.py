"""Operator 13: conversation structure repair.

A conversation is well formed if its role initials are nothing, or turns `ua` one after another with at most one `s` before them. Four states
read that: 0 before all, 1 after s, 2 after u, 3 after a; 0 and 3 may end. Each row is kept, given another role or deleted, rows
are inserted before it, and the cheapest way is looked for; of equally cheap ones, that whose audit (a letter an edit) is least.

Hirschberg's way: costs of reaching each state go forward to the middle of the conversation, costs of ending go backward to it, and
the state in which the cheapest way crosses splits the task in two. The forward vector also ranks the states by the audits that lead
there, so of several cheapest crossings the audit-least is known without any audit being held: audits of the same rows
that lead to different states differ before either ends. A task holds two vectors of four states a level, and a byte a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, table

# Fixed values of the contract.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
ROLES = {2: "user", 3: "assistant"}
#: What an inserted or renamed row can be in each state, and so the state after it.
NEXT = (2, 2, 3, 2)
#: State after a row kept, by state and initial (s, u, a).
KEPT = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}
#: Cost and audit of ending from each state.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
#: A row as a byte: its initial (s, u, a as 1, 2, 3, others 0), 4 if it is cut off; FORCED: blank or duplicate.
CUT_OFF, FORCED = 4, 8
NEVER = 1 << 60


def _steps(row: int) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """By state before and state after: cost and audit of the best way over one row, with what is inserted before it."""
    best: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        state = start
        for inserted in range(3):
            ways = [(state, DELETE, "D")]
            if row != FORCED:
                stays = CUT if row & CUT_OFF else 0
                ways.append((NEXT[state], REROLE + stays, "R"))
                if (state, row & 3) in KEPT:
                    ways.append((KEPT[state, row & 3], stays, "K"))
            for after, cost, edit in ways:
                way = (cost + inserted * INSERT, "I" * inserted + edit)
                best[start][after] = min(best[start][after] or way, way)
            state = NEXT[state]
    return tuple(map(tuple, best))


STEPS = {row: _steps(row) for row in range(FORCED + 1)}


def _forward(rows: bytes, state: int) -> tuple[list[int], list[int]]:
    """Costs of being in each state after the rows, and the states' ranks by their least audits."""
    cost, rank = [NEVER] * 4, [0] * 4
    cost[state] = 0
    for row in rows:
        steps, reached = STEPS[row], [(NEVER, 0, "")] * 4
        for p in range(4):
            if cost[p] < NEVER:
                for after, way in enumerate(steps[p]):
                    if way:
                        reached[after] = min(reached[after], (cost[p] + way[0], rank[p], way[1]))
        order = sorted(x[1:] for x in reached)
        cost, rank = [x[0] for x in reached], [order.index(x[1:]) for x in reached]
    return cost, rank


def _backward(rows: bytes, state: int) -> list[int]:
    """Costs of getting from each state over the rows into the given one."""
    cost = [NEVER] * 4
    cost[state] = 0
    for row in reversed(rows):
        cost = [min(NEVER, *(w[0] + c for w, c in zip(ways, cost, strict=True) if w)) for ways in STEPS[row]]
    return cost


def _between(rows: bytes, before: int, after: int) -> str:
    """The audit of the best way over the rows (one at least) from state to state."""
    if len(rows) == 1:
        return STEPS[rows[0]][before][after][1]
    middle = len(rows) // 2
    first, second = rows[:middle], rows[middle:]
    (reach, rank), rest = _forward(first, before), _backward(second, after)
    crossing = min(range(4), key=lambda s: (reach[s] + rest[s], rank[s]))
    return _between(first, before, crossing) + _between(second, crossing, after)


@lru_cache(maxsize=1 << 16)
def _short(rows: bytes) -> tuple[int, str]:
    return best_edits(rows)


def best_edits(rows: bytes) -> tuple[int, str]:
    """Cost and audit of the best repair of rows, a byte each."""
    if not rows:
        return 0, ""
    cost, rank = _forward(rows, 0)
    last = min(range(4), key=lambda s: (cost[s] + ENDS[s][0], rank[s]))
    return cost[last] + ENDS[last][0], _between(rows, 0, last) + ENDS[last][1]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows after the contract's faults, which follow from crc32 of `conv_id:turn`; nulls in role and text, and in
    that key, are one space."""
    as_text = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    x = rows.select("conv_id", rows["turn"].cast("long").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    x = x.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))
    return x.drop("times")


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _audited(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row a conversation, of rows in order: a header (kind 0), then its rows (row: a byte, what: 1 blank, 2 duplicate, 3 truncated)."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    held: dict | None = None

    def closed() -> tuple:
        rows = b"".join(held["rows"])
        initials = np.frombuffer(b"".join(held["initials"]), np.uint8)
        pairs = initials[:-1] * 4 + initials[1:]
        known = [t for t in (held["first"], held["last"]) if t is not None]
        gaps = held["last"] - held["first"] + 1 - held["distinct"] if known else 0
        cost, audit = _short(rows) if len(rows) <= 64 else best_edits(rows)
        return (held["id"], gaps, *held["counts"].tolist(), int((~np.isin(pairs, (6, 11, 14))).sum()), cost, audit)

    for batch in batches:
        out: list[tuple] = []
        heads = np.flatnonzero(np.asarray(batch.column("kind")) == 0).tolist()
        row, what, initial = (np.asarray(batch.column(c)).astype(np.uint8) for c in ("row", "what", "initial"))
        turn = batch.column("turn")
        for a, b in zip([-1, *heads], [*heads, batch.num_rows], strict=True):
            if a >= 0:
                if held:
                    out.append(closed())
                held = {"id": batch.column("conv_id")[a].as_py(), "rows": [], "initials": [], "counts": np.zeros(3, np.int64), "first": None, "last": None, "distinct": 0}
            part = slice(a + 1, b)
            if a + 1 < b:
                held["rows"].append(row[part].tobytes())
                held["initials"].append(initial[part].tobytes())
                held["counts"] += np.bincount(what[part], minlength=4)[1:]
                own = np.asarray(turn.slice(a + 1, b - a - 1).drop_null())
                if len(own):
                    held["distinct"] += int((own[1:] != own[:-1]).sum()) + (held["last"] is None or int(own[0]) != held["last"])
                    held["first"] = int(own[0]) if held["first"] is None else held["first"]
                    held["last"] = int(own[-1])
        if out:
            yield _table(out, names, kind)
    if held:
        yield _table([closed()], names, kind)


def _table(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    kinds = {"conv_id": kind, "audit": pa.string(), "repaired_sha256": pa.string()}
    return pa.RecordBatch.from_pydict({n: pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)})


def _repaired(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """conv_id and repaired_sha256 of rows in order: a header with the audit (kind 0), then the conversation's rows. Texts pass through one by one."""
    conv, edits, state, digest, lines = None, None, 0, None, 0

    def put(line: str) -> None:
        nonlocal lines
        digest.update(("\n" if lines else "").encode() + line.encode())
        lines += 1

    def insert(until_end: bool = False) -> str:
        """Inserts rows up to the next edit of another kind, which is returned."""
        nonlocal state
        for edit in edits:
            if edit != "I":
                return edit
            state = NEXT[state]
            put(f"{ROLES[state]}:")
        return ""

    for batch in batches:
        out = []
        for k, i, role, text in zip(*(batch.column(c).to_pylist() for c in ("kind", "conv_id", "role", "text")), strict=True):
            if k == 0:
                if digest:
                    insert()
                    out.append((conv, digest.hexdigest()))
                conv, edits, state, digest, lines = i, iter(text), 0, hashlib.sha256(), 0
                continue
            edit = insert()
            if edit == "R":
                state = NEXT[state]
                put(f"{ROLES[state]}:{text}")
            elif edit == "K":
                state = KEPT[state, "_sua".index(role[0])]
                put(f"{role}:{text}")
        if out:
            yield _table(out, ["conv_id", "repaired_sha256"], kind)
    if digest:
        insert()
        yield _table([(conv, digest.hexdigest())], ["conv_id", "repaired_sha256"], kind)


def repair_conversations(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows (conv_id, turn, role, text)
    and of conversations (conv_id), as in the contract of the query; one without rows has zeros and an empty audit.

    A conversation's rows stand by turn (nulls first); rows of one turn by role and then by the SHA-256 of the text. A null role or text is one
    space. A role that begins with no s, u or a can't be kept. A null conv_id is a conversation like others. Repeated rows are rows
    of their own: duplicates. Other columns aren't read.

    First without texts: a row is a byte, and each conversation's audit is found in the task to which its rows go. Then texts pass by
    their audits into a hash, in order. Neither step holds more of a conversation than its audit, which is one value of the result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "conversation-repair")
    kind = rows.schema["conv_id"].dataType
    arrow, ddl = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()], kind.simpleString()
    rows = rows.select("conv_id", rows["turn"].cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest"]
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.when(F.col("role") == "", 0).otherwise(F.instr(F.lit("sua"), F.substring("role", 1, 1)))
    light = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest("text").alias("digest"), initial.alias("initial"), (bare == "").alias("is_blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("is_cut"))
    heads = (rows if conversations is None else conversations).select("conv_id").distinct().withColumn("kind", F.lit(0))
    both = light.unionByName(heads, allowMissingColumns=True).repartition("conv_id")
    # partitions by conversation serve the window as well, which reads equal rows one after the other
    earlier = F.row_number().over(Window.partitionBy("conv_id", "kind", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    what = F.when(F.col("kind") == 0, 0).when(F.col("is_blank"), 1).when(F.col("again"), 2).when(F.col("is_cut"), 3).otherwise(0)
    both = both.withColumn("again", earlier).withColumn("what", what)
    row = F.when(F.col("what").isin(1, 2), FORCED).otherwise(F.coalesce("initial", F.lit(0)) + F.when(F.col("what") == 3, CUT_OFF).otherwise(0))
    both = both.sortWithinPartitions(*order).select("conv_id", "kind", "turn", row.alias("row"), "what", F.coalesce("initial", F.lit(0)).alias("initial"))
    audits = scratch.put(both.mapInArrow(lambda b: _audited(b, arrow), f"conv_id {ddl}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest("text").alias("digest"), "text")
    texts = texts.unionByName(audits.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text")), allowMissingColumns=True)
    texts = texts.repartition("conv_id").sortWithinPartitions(*order).select("kind", "conv_id", "role", "text")
    hashes = scratch.put(texts.mapInArrow(lambda b: _repaired(b, arrow), f"conv_id {ddl}, repaired_sha256 string"))
    hashes = hashes.withColumnRenamed("conv_id", "h_conv")
    return audits.join(hashes, audits["conv_id"].eqNullSafe(hashes["h_conv"])).drop("h_conv")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_conversations(damage(rows), rows)


OP13_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
c AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM o, tab),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS n FROM c WHERE f <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), n) AS i, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS bare FROM d),
w AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS ini,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM e),
ids AS (SELECT DISTINCT conv_id FROM conversations),
ins(p, k, q, lines) AS (VALUES (0, 0, 0, []), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
      (2, 0, 2, []), (2, 1, 3, ['assistant:']), (3, 0, 3, []), (3, 1, 2, ['user:'])),
ed(q, ch, ini, z) AS (VALUES (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2),
      (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3)),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])} AS b FROM ids
      UNION ALL
      SELECT r.conv_id, w.i, ed.z, min({'c': r.b.c + 5 * ins.k + CASE ed.ch WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN ed.ch <> 'D' AND w.fault = 'truncated' THEN 5 ELSE 0 END,
        'a': concat(r.b.a, repeat('I', ins.k), ed.ch),
        't': list_concat(list_concat(r.b.t, ins.lines), CASE ed.ch WHEN 'D' THEN [] WHEN 'K' THEN [concat(w.role, ':', w.text)] ELSE [concat(CASE ed.z WHEN 2 THEN 'user:' ELSE 'assistant:' END, w.text)] END)})
      FROM r JOIN w ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.i = r.i + 1 JOIN ins ON ins.p = r.st JOIN ed ON ed.q = ins.q AND (ed.ini IS NULL OR ed.ini = w.ini) AND (ed.ch = 'D' OR w.fault NOT IN ('blank', 'duplicate'))
      GROUP BY r.conv_id, w.i, ed.z),
n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
      count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE prev IS NOT NULL AND concat(prev, ini) NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY conv_id),
z AS (SELECT r.conv_id, min({'c': b.c + CASE st WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'a': concat(b.a, CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END),
      't': list_concat(b.t, CASE st WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}) AS b FROM r LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id WHERE r.i = coalesce(n.rows, 0) GROUP BY r.conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(z.b.c AS BIGINT) AS cost, z.b.a AS audit, sha256(array_to_string(z.b.t, chr(10))) AS repaired_sha256
FROM z LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id
"""
