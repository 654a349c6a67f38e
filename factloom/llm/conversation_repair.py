"""Conversation structure repair: the cheapest edits that turn a conversation's roles into ``(s?(ua)+)?``, by checkpointed dynamic programming.

A row of a conversation is kept, given another role, deleted, or a turn without text is inserted before it. The states are
what the roles so far end in: nothing, s, u or a. A row is a small min-plus matrix over them.

1. Rows, equal ones of a turn counted as one, are range-sorted over (conversation, turn, role, digest), so a long conversation lies
   over many tasks. Each task cuts its part of a conversation into blocks that grow as the square root of what it has seen, and
   notes for each block its rows as numbers and their product.
2. A block's product is all that the way back needs: one pass over the blocks of a conversation, the last first, gives the vector of
   costs to the end at each block's end. Only these checkpoints are stored, as many as the square root of the rows.
3. On the way forward each block's vectors are computed again from its checkpoint, and each row takes the least of D, I, K
   and R that is tight, which gives the ASCII-least of the cheapest edits. Rows stream by; what is held is one block's numbers.

The third pass reads a conversation in one task, in order, as its result is a hash over all its text; it holds no more of it for that.

Edge cases: nulls of role and text count as one space, a null turn comes first, a null conversation id is an id. Rows of a turn
stand in the order of role and SHA-256 of their text. Repeated rows are duplicates. A conversation without rows
has a result without edits. An empty table gives an empty table. Other columns are not read. Texts may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import Scratch, table

# The costs of edits, and of a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing yet, after s, after u, after a; what an inserted or rerolled turn leads to, and its role.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_INITIALS = "sua?"
_FAR = 1 << 60
_END = (0, 2 * INSERT, INSERT, 0)
FAULTS = ("", "blank", "duplicate", "truncated")

Vector = tuple[int, int, int, int]


def damage(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) damaged by crc32('conv_id:turn') % 20: 0 dropped, 1 emptied, 2 without sentence ends, 3 repeated, 4 said by the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    r = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), code.alias("code")).where("code != 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return r.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows(conv, turn, role, text) -> distinct rows with ``n`` copies, ``digest`` and the first copy's ``fault`` (number in FAULTS); further copies of a row that isn't blank are duplicates."""
    one = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256))
    at = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    one = Scratch(rows.sparkSession, "conversations").save(one, "distinct")
    first = one.groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min(at).alias("_first"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", 1).when(F.col("_first") < at, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return one.join(first, same).select("conv", "turn", "role", "digest", "text", "n", fault.alias("fault"))


def _number(role: str, fault: int) -> int:
    """What edits a row allows: 0 none but deletion, else by role and truncation."""
    if fault in (1, 2):
        return 0
    k = _INITIALS.find(role[:1]) if role else 3
    return 1 + 2 * (k if k >= 0 else 3) + (fault == 3)


def _edits(number: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of a row's own edits, by initial."""
    out = [("D", DELETE, state)]
    if number:
        k, cut = divmod(number - 1, 2)
        to = _KEEP.get(_INITIALS[k], {}).get(state)
        if to is not None:
            out.append(("K", TRUNCATED * cut, to))
        out.append(("R", REROLE + TRUNCATED * cut, _NEXT[state]))
    return out


_EDITS = [[_edits(number, q) for q in range(4)] for number in range(9)]


def _back(number: int, copies: int, after: Vector) -> Vector:
    """Costs from before a row and its copies, given those after; insertions before the row included."""
    g = [min(cost + after[to] for _, cost, to in _EDITS[number][q]) for q in range(4)]
    for _ in range(2):
        g = [min(g[q], INSERT + g[_NEXT[q]]) for q in range(4)]
    more = DELETE * (copies - 1)
    return g[0] + more, g[1] + more, g[2] + more, g[3] + more


_UNIT = tuple(tuple(0 if q == p else _FAR for q in range(4)) for p in range(4))


def _product(rows: list[tuple[int, int]]) -> list[int]:
    """16 costs: from each state before the rows to each after them. Column p is the way back from the unit vector p."""
    columns = []
    for p in range(4):
        v = _UNIT[p]
        for number, copies in reversed(rows):
            v = tuple(min(x, _FAR) for x in _back(number, copies, v))
        columns.append(v)
    return [columns[p][q] for q in range(4) for p in range(4)]


def _vectors(rows: list[tuple[int, int]], after: Vector) -> list[Vector]:
    """The vectors before each row of a block, and the checkpoint after the last."""
    out = [after]
    for number, copies in reversed(rows):
        out.append(_back(number, copies, out[-1]))
    return out[::-1]


def _walk(rows: list[tuple[int, int]], k: int, state: int, vectors: list[Vector], last: bool) -> tuple[str, int]:
    """The edits up to and with row ``k`` of a block (or to the conversation's end, ``last``), the ASCII-least of the cheapest ones; and the state after."""
    said, here = "", vectors[k]
    while True:
        if last:
            if here[state] == 0 and state in (0, 3):
                return said, state
        else:
            after = vectors[k + 1]
            cost = {e: (c + DELETE * (rows[k][1] - 1) + after[to], to) for e, c, to in _EDITS[rows[k][0]][state]}
            if cost["D"][0] == here[state]:
                return said + "D", state
        if INSERT + here[_NEXT[state]] == here[state]:
            said, state = said + "I", _NEXT[state]
            continue
        e, to = next((e, cost[e][1]) for e in "KR" if e in cost and cost[e][0] == here[state])
        return said + e, to


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``faults`` in order, with their place (part, block, at), and each block's own row (at -1) with its rows' numbers and product."""
    kind = rows.schema["conv"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("numbers", pa.binary()), ("copies", pa.list_(pa.int64())), ("product", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, seen, held = TaskContext.get().partitionId(), 0, 0, []
        conv: list = []

        def closed() -> dict:
            nonlocal block, held
            out = {"conv": conv[0], "part": part, "block": block, "at": -1, "numbers": bytes(n for n, _ in held), "copies": [c for _, c in held], "product": _product(held)}
            block, held = block + 1, []
            return out

        full = None
        for b in batches:
            full = full or pa.schema([*b.schema, *schema])
            out = []
            for r in b.to_pylist():
                if not conv or conv[0] != r["conv"]:
                    if held:
                        out.append(closed())
                    conv, seen = [r["conv"]], 0
                elif held and isqrt(seen) ** 2 == seen:
                    out.append(closed())
                out.append(r | {"part": part, "block": block, "at": len(held)})
                held.append((_number(r["role"], r["fault"]), r["n"]))
                seen += 1
            yield pa.RecordBatch.from_pylist(out, full)
        if held:
            yield pa.RecordBatch.from_pylist([closed()], full)

    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "digest"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.mapInArrow(run, f"conv {kind}, turn {turn}, role string, digest string, text string, n long, fault int, part int, block long, at long, numbers binary, copies array<long>, product array<long>")


def checkpoints(cut: DataFrame) -> DataFrame:
    """(conv, part, block, after): for each block the vector of costs after its last row."""
    kind = cut.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: list = []
        after = _END
        for b in batches:
            vectors = []
            for name, m in zip(b.column("conv").to_pylist(), b.column("product").to_pylist(), strict=True):
                if not conv or conv[0] != name:
                    conv, after = [name], _END
                vectors.append(list(after))
                after = tuple(min(m[4 * q + p] + after[p] for p in range(4)) for q in range(4))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "part", "block")), pa.array(vectors, pa.list_(pa.int64()))], ["conv", "part", "block", "after"])

    own = cut.where("at = -1").select("conv", "part", "block", "product")
    order = [F.asc_nulls_first("conv"), F.desc("part"), F.desc("block")]
    return own.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, f"conv {kind}, part int, block long, after array<long>")


def repair(rows: DataFrame, conversations: DataFrame | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits of every conversation of rows(conv, turn, role, text): (conv, edit, n, fault, turn, was, role, text), in the order of the
    edits within a partition, all of a conversation in one.

    ``edit`` is K, R, D or I; a row and its copies are one entry, whose ``n`` - 1 further copies are deleted as duplicates, or as blank ones; ``role`` is what
    the turn has after it (null if deleted), ``was`` what it had. A conversation starts with an entry without an edit, also one
    of ``conversations`` that has no rows.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    given = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(x) for c, x in ((role, "role"), (text, "text"))))
    cut = scratch.save(blocks(faults(given)), "rows")
    marks = scratch.save(checkpoints(cut), "checkpoints")
    kind, when = (cut.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    names = (rows if conversations is None else conversations).select(F.col(conv).alias("conv")).distinct().select("conv", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("block"), F.lit(-3).cast("long").alias("at"))
    own = cut.where("at = -1").drop("product")
    both = own.unionByName(cut.where("at >= 0").drop("product")).unionByName(marks.withColumn("at", F.lit(-2).cast("long")), allowMissingColumns=True).unionByName(names, allowMissingColumns=True)
    order = [F.asc_nulls_first("conv"), "part", "block", "at"]
    schema = f"conv {kind}, edit string, n long, fault int, turn {when}, was string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, numbers, vectors, conv, made, types = 0, [], [], None, [], None

        def entry(edit: str | None, state: int = 0, r: dict | None = None, role: str | None = None) -> dict:
            if edit == "I":
                return {"conv": conv, "edit": "I", "n": 1, "role": role, "text": ""}
            return {"conv": conv, "edit": edit, **({x: r[x] for x in ("n", "fault", "turn", "text")} | {"was": r["role"], "role": role} if r else {})}

        def ended() -> Iterator[dict]:
            nonlocal state
            for _ in _walk([], 0, state, [_END], True)[0]:
                yield entry("I", role=_ROLE[state])
                state = _NEXT[state]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, pa.schema([("conv", types[0]), ("edit", pa.string()), ("n", pa.int64()), ("fault", pa.int32()), ("turn", types[1]), ("was", pa.string()), ("role", pa.string()), ("text", pa.string())]))

        begun = False
        for b in batches:
            types = types or (b.schema.field("conv").type, b.schema.field("turn").type)
            for r in b.to_pylist():
                if r["at"] == -3:
                    if begun:
                        made.extend(ended())
                    conv, state, begun = r["conv"], 0, True
                    made.append(entry(None))
                elif r["at"] == -2:
                    after = tuple(r["after"])
                elif r["at"] == -1:
                    numbers = list(zip(r["numbers"], r["copies"], strict=True))
                    vectors = _vectors(numbers, after)
                else:
                    said, _ = _walk(numbers, r["at"], state, vectors, False)
                    for e in said:
                        if e == "I":
                            made.append(entry("I", role=_ROLE[state]))
                            state = _NEXT[state]
                        else:
                            made.append(entry(e, r=r, role=r["role"] if e == "K" else _ROLE[state] if e == "R" else None))
                            state = next(to for x, _, to in _EDITS[numbers[r["at"]][0]][state] if x == e)
            yield batch(made)
            made = []
        if begun:
            yield batch(list(ended()))

    columns = ["conv", "part", "block", "at", "after", "numbers", "copies", "turn", "role", "text", "n", "fault"]
    return both.select(*columns).repartition("conv").sortWithinPartitions(*order).mapInArrow(run, schema)


def digest(edits: DataFrame) -> DataFrame:
    """What ``repair`` did, a row a conversation: gaps, counts of faults, illegal neighbours, cost, audit (the edits' initials) and the hash of the repaired rows."""
    kind = edits.schema["conv"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    names = ["conv", *counts, "audit", "repaired_sha256"]

    class Open:
        def __init__(self, conv: object):
            self.conv, self.n, self.audit, self.sha, self.some = conv, dict.fromkeys(counts, 0), bytearray(), hashlib.sha256(), False
            self.low = self.high = self.initial = None
            self.turns = 0

        def add(self, r: dict) -> None:
            n, copies = self.n, r["n"]
            self.audit += (r["edit"] + "D" * (copies - 1)).encode()
            if r["edit"] == "I":
                n["cost"] += INSERT
            else:
                fault = FAULTS[r["fault"]]
                if fault:
                    n[fault] += 1
                n["blank" if fault == "blank" else "duplicate"] += copies - 1
                n["cost"] += DELETE * (copies - 1) + {"D": DELETE, "K": 0, "R": REROLE}[r["edit"]] + TRUNCATED * (fault == "truncated" and r["edit"] != "D")
                initial = r["was"][:1]
                n["illegal"] += (self.initial is not None and self.initial + initial not in ("su", "ua", "au")) + copies - 1
                self.initial = initial
                if r["turn"] is not None:
                    self.turns += r["turn"] != self.high
                    self.low, self.high = r["turn"] if self.low is None else self.low, r["turn"]
            if r["edit"] != "D":
                if self.some:
                    self.sha.update(b"\n")
                self.some = True
                self.sha.update(f"{r['role']}:".encode("utf-8", "surrogatepass"))
                self.sha.update(r["text"].encode("utf-8", "surrogatepass"))

        def row(self) -> dict:
            if self.low is not None:
                self.n["gaps"] = int(self.high - self.low) + 1 - self.turns
            return {"conv": self.conv, **self.n, "audit": self.audit.decode(), "repaired_sha256": self.sha.hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema = None, None
        for b in batches:
            schema = schema or pa.schema([("conv", b.schema.field("conv").type), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = []
            for r in b.to_pylist():
                if r["edit"] is None:
                    if now:
                        out.append(now.row())
                    now = Open(r["conv"])
                else:
                    now.add(r)
            yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    return edits.mapInArrow(run, ", ".join([f"conv {kind}", *(f"{c} long" for c in counts), "audit string", "repaired_sha256 string"])).select(*names)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return digest(repair(damage(rows), rows)).withColumnRenamed("conv", "conv_id")


def oracle() -> str:
    """The same in SQL, one row or edit a step, without checkpoints."""
    back = lambda q, keeps: f"least({DELETE} + v[{q + 1}], CASE WHEN kind = 0 THEN {_FAR} ELSE {REROLE} + {TRUNCATED} * cut + v[{_NEXT[q] + 1}] END, " + (f"CASE WHEN kind > 0 AND ({keeps}) THEN {TRUNCATED} * cut + CASE ini " + " ".join(f"WHEN '{i}' THEN v[{m[q] + 1}]" for i, m in _KEEP.items() if q in m) + f" END ELSE {_FAR} END)")
    g = ", ".join(f"{back(q, ' OR '.join(f'ini = {chr(39)}{i}{chr(39)}' for i, m in _KEEP.items() if q in m))} AS g{q}" for q in range(4))
    succ = "CASE q WHEN 2 THEN 3 ELSE 2 END"
    kept = "CASE WHEN ini = 's' AND q = 0 THEN 1 WHEN ini = 'u' AND q IN (0, 1, 3) THEN 2 WHEN ini = 'a' AND q = 2 THEN 3 END"
    new = "CASE q WHEN 2 THEN 'assistant' ELSE 'user' END"
    return rf"""
    WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
    given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    coded AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS code FROM given, tab),
    hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) FROM coded WHERE code != 0)),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS i FROM hurt),
    f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS ini
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM r)),
    row AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 0 ELSE 1 END AS kind, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM f),
    n AS (SELECT conv_id, count(*) AS n FROM row GROUP BY conv_id),
    cost AS (SELECT conv_id, n AS i, [CAST({_END[0]} AS BIGINT), {_END[1]}, {_END[2]}, {_END[3]}] AS v FROM n
      UNION ALL SELECT conv_id, i, [least(g0, 5 + g2, 10 + g3), least(g1, 5 + g2, 10 + g3), least(g2, 5 + g3), least(g3, 5 + g2)]
      FROM (SELECT c.conv_id, c.i - 1 AS i, {g} FROM cost c JOIN row x ON x.conv_id IS NOT DISTINCT FROM c.conv_id AND x.i = c.i - 1)),
    step AS (SELECT a.conv_id, a.i, a.v, b.v AS w, x.role, x.text, x.ini, x.kind, x.cut FROM cost a LEFT JOIN cost b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = a.i + 1 LEFT JOIN row x ON x.conv_id IS NOT DISTINCT FROM a.conv_id AND x.i = a.i),
    walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS said, false AS done FROM n
      UNION ALL SELECT conv_id, CASE WHEN e IN ('D', 'K', 'R') THEN i + 1 ELSE i END, CASE e WHEN 'K' THEN kept WHEN 'D' THEN q WHEN '.' THEN q ELSE {succ} END, audit || CASE WHEN e = '.' THEN '' ELSE e END,
        CASE e WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'R' THEN list_append(said, {new} || ':' || text) WHEN 'I' THEN list_append(said, {new} || ':') ELSE said END, e = '.'
      FROM (SELECT *, CASE WHEN w IS NULL AND q IN (0, 3) THEN '.' WHEN {DELETE} + w[q + 1] = v[q + 1] THEN 'D' WHEN {INSERT} + v[{succ} + 1] = v[q + 1] THEN 'I' WHEN kind > 0 AND {TRUNCATED} * cut + w[kept + 1] = v[q + 1] THEN 'K' ELSE 'R' END AS e
        FROM (SELECT walk.*, s.v, s.w, s.role, s.text, s.kind, s.cut, {kept} AS kept FROM walk JOIN step s ON s.conv_id IS NOT DISTINCT FROM walk.conv_id AND s.i = walk.i WHERE NOT done))),
    ended AS (SELECT * FROM walk WHERE done),
    pairs AS (SELECT conv_id, ini, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM row),
    bad AS (SELECT conv_id, count(*) AS illegal FROM pairs WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
    c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM row GROUP BY conv_id),
    ids AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
      CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
    FROM ids LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN bad ON bad.conv_id IS NOT DISTINCT FROM ids.conv_id
      LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN cost ON cost.conv_id IS NOT DISTINCT FROM ids.conv_id AND cost.i = 0"""
