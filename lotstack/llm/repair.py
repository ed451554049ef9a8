"""Conversation structure repair by a min-plus matrix scan.

The initials of a repaired conversation's roles read `(s?(ua)+)?`. Four states say what stands so far: nothing, a system
turn, a user turn, an assistant turn. A turn is a 4x4 matrix over (cost, audit): how its edits lead from one state to
another, followed by the closure of inserted turns. Matrices are multiplied by adding costs and joining audits, and the
least (cost, audit) counts. Two audits of the same turns with equal costs never begin one another (they differ by more than
inserted turns, which cost), so the least stays the least whatever is joined to it: the product is associative.

Turns are sorted over the whole cluster, not conversation by conversation. Each partition multiplies runs of at most
`RUN_ROWS` turns. A conversation that lies within one run is settled there; the others' runs are multiplied by a tree of
`FAN` runs a node, and the states chosen at the top are handed down again, so no task holds a long conversation's turns.
The audit of a conversation is one string, and so is as long as its turns, and its digest is made by one task, which
streams the repaired turns: SHA-256 can't be cut into parts.

Defined results: null roles and texts count as one space; null turn numbers come first; equal turn numbers are ordered by
role, then text, and repeated rows are rows; rows with a null id form a conversation of their own; a role without an
initial, or with another one than s, u or a, can't be kept. An empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotstack.llm.common import discard, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Turns of a run and bytes of their texts, at most about; runs of a node of the tree.
RUN_ROWS, RUN_BYTES, FAN = 1024, 8 << 20, 64
#: States, and where a role's initial leads from them.
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {(_NONE, "s"): _SYSTEM, (_NONE, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_ACCEPTED = (_NONE, _ASSISTANT)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
FINE, BLANK, DUPLICATE, CUT = range(4)

#: Row i, column j at 4 * i + j: (cost, audit), or None if there is no way.
Matrix = tuple


def _matrix(ways: Iterable[tuple[int, int, int, str]]) -> Matrix:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for i, j, cost, audit in ways:
        best[i, j] = min(best.get((i, j), (cost, audit)), (cost, audit))
    return tuple(best.get((i, j)) for i in range(4) for j in range(4))


def times(a: Matrix, b: Matrix) -> Matrix:
    """First the edits of `a`, then those of `b`."""
    out: list = [None] * 16
    for i in range(4):
        for k in range(4):
            if (x := a[4 * i + k]) is None:
                continue
            for j in range(4):
                if (y := b[4 * k + j]) is None:
                    continue
                have, cost = out[4 * i + j], x[0] + y[0]
                if have is None or cost < have[0]:
                    out[4 * i + j] = (cost, x[1] + y[1])
                elif cost == have[0]:
                    out[4 * i + j] = min(have, (cost, x[1] + y[1]))
    return tuple(out)


def product(matrices: list[Matrix]) -> Matrix:
    """The product in order, by halves."""
    while len(matrices) > 1:
        paired = [times(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)]
        matrices = paired + matrices[2 * len(paired) :]
    return matrices[0] if matrices else UNIT


UNIT = _matrix((i, i, 0, "") for i in range(4))
_ONE = _matrix((i, j, INSERT, "I") for (i, initial), j in _NEXT.items() if initial != "s")
#: Any number of inserted turns; more than two never pay.
CLOSURE = _matrix((n // 4, n % 4, *way) for m in (UNIT, _ONE, times(_ONE, _ONE)) for n, way in enumerate(m) if way)


@cache
def turn_matrix(initial: str, fault: int) -> Matrix:
    """One turn's edits, and the turns inserted after it."""
    ways = [(i, i, DELETE, "D") for i in range(4)]
    if fault in (FINE, CUT):
        extra = TRUNCATED if fault == CUT else 0
        ways += [(i, j, KEEP + extra, "K") for (i, x), j in _NEXT.items() if x == initial]
        ways += [(i, j, REROLE + extra, "R") for (i, x), j in _NEXT.items() if x != "s"]
    return times(_matrix(ways), CLOSURE)


@lru_cache(maxsize=64)
def deletions(n: int) -> Matrix:
    """`n` turns that must go, and the turns inserted after them."""
    return times(_matrix((i, i, DELETE * n, "D" * n) for i in range(4)), CLOSURE)


def replay(audit: str, state: int, turns: list[tuple[str, int]]) -> tuple[list[tuple[list[str], str, str | None]], list[str]]:
    """What `audit` does from `state` on with turns (role, copies): for each (roles inserted before, edit, new role), and the roles after.

    Copies after a turn's first are deleted: their letters follow its own.
    """
    out, at, added = [], 0, []

    def inserted() -> None:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state = _USER if state != _USER else _ASSISTANT
            added.append(_ROLE[state])
            at += 1

    for role, copies in turns:
        inserted()
        edit, new, before = audit[at], None, added
        added = []
        if edit == "K":
            state, new = _NEXT[state, role[:1]], role
        elif edit == "R":
            state = _USER if state != _USER else _ASSISTANT
            new = _ROLE[state]
        at += 1
        for _ in range(copies - 1):
            inserted()
            at += 1
        out.append((before, edit, new))
    inserted()
    return out, added


def _faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault): equal rows of a turn once, with their number; `fault` is the first one's."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    said = F.concat_ws(":", F.length("role"), "role", "text")
    rows = rows.withColumn("said", F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("/"), said), 256))
    order = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    # only what is said at several turns is looked up again
    again = rows.groupBy("said").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = rows.join(again, "said", "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(order > F.col("first"), DUPLICATE).when(~whole, CUT).otherwise(FINE)
    return met.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


_ELEMENT = (
    "n long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
    "first_turn long, last_turn long, turns long, costs array<long>, audits array<string>"
)
_EDITS = "before array<string>, edit string, new_role string, after array<string>"
_SCANNED = f"conv_id long, part int, run long, place int, role string, text string, copies long, closed boolean, digest string, {_EDITS}, {_ELEMENT}"


def _measure(turns: list[tuple]) -> dict:
    """The element of turns (turn, role, text, copies, fault)."""
    count = [0, 0, 0, 0]
    illegal, last, steps = 0, None, []
    for _, role, _, copies, fault in turns:
        count[fault] += copies if fault == BLANK else 1
        count[DUPLICATE] += copies - 1 if fault != BLANK else 0
        initial = role[:1]
        illegal += (last is not None and last + initial not in ("su", "ua", "au")) + (copies - 1)  # equal initials never follow each other
        last = initial
        steps.append(turn_matrix(initial, fault))
        if copies > 1:
            steps.append(deletions(copies - 1))
    numbers = [t[0] for t in turns if t[0] is not None]
    ways = product(steps)
    return {
        "n": sum(t[3] for t in turns),
        "blank": count[BLANK],
        "duplicate": count[DUPLICATE],
        "truncated": count[CUT],
        "illegal": illegal,
        "first_initial": turns[0][1][:1],
        "last_initial": last,
        "first_turn": numbers[0] if numbers else None,
        "last_turn": numbers[-1] if numbers else None,
        "turns": len(set(numbers)),
        "costs": [way and way[0] for way in ways],
        "audits": [way and way[1] for way in ways],
    }


def _ways(element: dict) -> Matrix:
    return tuple(None if cost is None else (cost, audit) for cost, audit in zip(element["costs"], element["audits"]))


def _joined(a: dict, b: dict) -> dict:
    """The element of `a`'s turns followed by `b`'s, without the matrix."""
    both = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated", "turns")}
    both["illegal"] = a["illegal"] + b["illegal"] + (a["last_initial"] + b["first_initial"] not in ("su", "ua", "au"))
    both["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    first = a["first_turn"] if a["first_turn"] is not None else b["first_turn"]
    last = b["last_turn"] if b["last_turn"] is not None else a["last_turn"]
    return both | {"first_initial": a["first_initial"], "last_initial": b["last_initial"], "first_turn": first, "last_turn": last}


def _end(ways: Matrix) -> int:
    """The state in which the best repair of a whole conversation ends."""
    return min((w for w in _ACCEPTED if ways[w]), key=lambda w: ways[w])


def _lines(edits: list, after: list[str], texts: Iterable[str]) -> Iterator[str]:
    for (before, _, role), text in zip(edits, texts):
        yield from (f"{r}:" for r in before)
        if role is not None:
            yield f"{role}:{text}"
    yield from (f"{r}:" for r in after)


def _scan(batches: Iterator[pa.RecordBatch], run_rows: int, run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition in runs: settled where a conversation lies within one, else with the run's element on its first row."""
    schema = None
    held: list[tuple] = []
    size, run, conv, cut, part = 0, 0, None, True, None
    out: list[dict] = []

    def close(ends: bool) -> None:
        nonlocal held, size, run
        element = _measure(held)
        whole = ends and not cut
        digest, edits, after = None, [([], None, None)] * len(held), []
        if whole:
            ways = times(CLOSURE, _ways(element))
            end = _end(ways)
            edits, after = replay(ways[end][1], _NONE, [(t[1], t[3]) for t in held])
            digest = hashlib.sha256("\n".join(_lines(edits, after, (t[2] for t in held))).encode()).hexdigest()
            element |= {"costs": [ways[end][0]], "audits": [ways[end][1]]}
        for place, (t, (before, edit, new)) in enumerate(zip(held, edits)):
            row = {"conv_id": conv, "part": part, "run": run, "place": place, "role": t[1], "text": t[2], "copies": t[3], "closed": whole}
            row |= {"before": before, "edit": edit, "new_role": new, "after": after if place == len(held) - 1 else []}
            out.append(row | ({"digest": digest} | element if not place else {}))
        held, size, run = [], 0, run + 1

    for batch in batches:
        columns = batch.to_pydict()
        for at, turn in enumerate(zip(*(columns[c] for c in ("turn", "role", "text", "copies", "fault")))):
            if part is None:
                part, conv = columns["part"][at], columns["conv_id"][at]
            if held and (columns["conv_id"][at] != conv or len(held) >= run_rows or size >= run_bytes):
                ends = columns["conv_id"][at] != conv
                close(ends)
                cut = not ends
            conv = columns["conv_id"][at]
            held.append(turn)
            size += len(turn[2])
        if out:
            schema = schema or _arrow_schema(batch)
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if held:
        close(False)
        yield pa.RecordBatch.from_pylist(out, schema or _arrow_schema(batch))


def _arrow_schema(batch: pa.RecordBatch) -> pa.Schema:
    long, strings = pa.int64(), pa.list_(pa.string())
    kinds = {"long": long, "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(long), "array<string>": strings}
    fields = [f.strip().split(" ") for f in _SCANNED.split(",")]
    return pa.schema([(name, batch.schema.field("conv_id").type if name == "conv_id" else kinds[kind]) for name, kind in fields])


def _element_rows(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["at"])


def _typed(schema: str, conv_type: str) -> str:
    return schema.replace("conv_id long", f"conv_id {conv_type}")


def repair(turns: DataFrame, run_rows: int = RUN_ROWS, run_bytes: int = RUN_BYTES, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of turns (conv_id, turn, role, text): each conversation's faults and best repair, and what it makes of each turn.

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. turns: conv_id, part,
    run, place (their order), role, text, copies, before (roles inserted before it), edit, new_role (null: deleted), after.
    """
    spark = turns.sparkSession
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    # a prefix of role and text keeps the sample that sets the bounds small, and is in the same order
    bounds = [*order, F.left("role", F.lit(64)), F.left("text", F.lit(64))]
    rows = _faults(turns).repartitionByRange(partitions, *bounds).sortWithinPartitions(*order, "role", "text")
    rows = rows.withColumn("part", F.spark_partition_id())
    scanned = materialize(rows.mapInArrow(lambda batches: _scan(batches, run_rows, run_bytes), _typed(_SCANNED, conv_type)), "turns")
    elements = [f.strip().split(" ")[0] for f in _ELEMENT.split(",")]
    closed = scanned.where("closed and place = 0").select("conv_id", *elements, "digest")

    # runs of the other conversations, numbered in order: a partition's begin behind those of the partitions before it
    runs = scanned.where("not closed and place = 0").select("conv_id", "part", "run", *elements)
    before = runs.groupBy("part").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("run")) - 1
    level = materialize(runs.withColumn("at", place).join(before, "part").withColumn("at", F.col("at") + F.col("before")).drop("here", "before"), "runs")
    runs, levels = level, [level]
    element_schema = _typed(f"conv_id long, at long, {_ELEMENT}", conv_type)

    def up(table: pa.Table) -> pa.Table:
        rows = _element_rows(table)
        out = rows[0]
        for row in rows[1:]:
            out = {"conv_id": out["conv_id"], **_joined(out, row)}
        ways = product([_ways(r) for r in rows])
        out |= {"conv_id": rows[0]["conv_id"], "at": rows[0]["at"] // fan, "costs": [w and w[0] for w in ways], "audits": [w and w[1] for w in ways]}
        fields = [f for f in table.schema if f.name in out]
        return pa.Table.from_pylist([out], pa.schema(fields)).select(["conv_id", "at", *elements])

    while (level.agg(F.max("at")).first()[0] or 0) > 0:
        grouped = level.select("conv_id", "at", *elements).groupBy("conv_id", (F.col("at") / fan).cast("long"))
        level = materialize(grouped.applyInArrow(up, element_schema), "tree")
        levels.append(level)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ways = times(CLOSURE, _ways(row))
                end = _end(ways)
                # the turns inserted before the first one lead to the state in which the runs begin
                begin = min((i for i in range(4) if CLOSURE[i] and row["costs"][4 * i + end] is not None), key=lambda i: (CLOSURE[i][0] + row["costs"][4 * i + end], CLOSURE[i][1] + row["audits"][4 * i + end]))
                out.append(row | {"costs": [ways[end][0]], "audits": [ways[end][1]], "begin": begin, "end": end})
            if out:
                fields = [*(batch.schema.field(i) for i in range(len(batch.schema))), pa.field("begin", pa.int32()), pa.field("end", pa.int32())]
                yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    tops = materialize(level.select("conv_id", "at", *elements).mapInArrow(top, f"{element_schema}, begin int, end int"), "tops")

    def down(table: pa.Table) -> pa.Table:
        """The states between which each child's edits lead, from those of its node."""
        rows = _element_rows(table)
        reached: list[dict] = [{rows[0]["begin"]: (0, "", None)}]
        for row in rows:
            ways, after = _ways(row), {}
            for i, (cost, audit, _) in reached[-1].items():
                for j in range(4):
                    if way := ways[4 * i + j]:
                        after[j] = min(after.get(j, (cost + way[0], audit + way[1], i)), (cost + way[0], audit + way[1], i))
            reached.append(after)
        ends = [rows[0]["end"]]
        for after in reversed(reached[1:]):
            ends.append(after[ends[-1]][2])
        ends.reverse()
        out = [{"conv_id": r["conv_id"], "at": r["at"], "begin": i, "end": j} for r, i, j in zip(rows, ends, ends[1:])]
        return pa.Table.from_pylist(out, pa.schema([table.schema.field("conv_id"), ("at", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())]))

    chosen = tops.select("conv_id", "at", "begin", "end")
    for level in reversed(levels[:-1]):
        parents = chosen.select(F.col("conv_id").alias("parent"), F.col("at").alias("node"), "begin", "end")
        node = (F.col("at") / fan).cast("long")
        children = level.select("conv_id", "at", "costs", "audits")
        met = children.join(parents, children["conv_id"].eqNullSafe(parents["parent"]) & (node == parents["node"]))
        chosen = materialize(met.drop("parent").groupBy("conv_id", "node").applyInArrow(down, _typed("conv_id long, at long, begin int, end int", conv_type)), "chosen")
    steps = runs.select("at", "part", "run", "audits").join(chosen.drop("conv_id"), "at")
    segments = steps.select("part", "run", "begin", F.get("audits", 4 * F.col("begin") + F.col("end")).alias("segment"))
    firsts = runs.groupBy("conv_id").agg(F.min("at").alias("at")).select("at").join(runs.select("at", "part", "run"), "at").select("part", "run", F.lit(True).alias("leads"))
    segments = segments.join(firsts, ["part", "run"], "left")
    kept = ["conv_id", "part", "run", "place", "role", "text", "copies", "before", "edit", "new_role", "after"]

    def settle(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        lead, begin = rows[0]["leads"], rows[0]["begin"]
        audit = (CLOSURE[begin][1] if lead else "") + rows[0]["segment"]
        edits, after = replay(audit, _NONE if lead else begin, [(r["role"], r["copies"]) for r in rows])
        for r, (before, edit, new) in zip(rows, edits):
            r |= {"before": before, "edit": edit, "new_role": new, "after": []}
        rows[-1]["after"] = after
        return pa.Table.from_pylist(rows, pa.schema([table.schema.field(c) for c in kept]))

    schema = _typed(", ".join(f.strip() for f in _SCANNED.split(",") if f.strip().split(" ")[0] in kept), conv_type)
    opened = scanned.where("not closed").select(*kept).join(segments, ["part", "run"])
    opened = materialize(opened.groupBy("part", "run").applyInArrow(settle, schema), "opened")
    digests = _digests(opened, conv_type)
    whole = closed.unionByName(tops.drop("at", "begin", "end").join(digests.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of"))
    gaps = F.coalesce(F.col("last_turn").cast("decimal(38,0)") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    gaps = F.least(gaps, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("gaps")
    conversations = whole.select(
        "conv_id", gaps, "blank", "duplicate", "truncated", "illegal", F.get("costs", F.lit(0)).alias("cost"), F.get("audits", F.lit(0)).alias("audit"), F.col("digest").alias("repaired_sha256")
    )
    discard(*levels[1:-1])
    return conversations, scanned.where("closed").select(*kept).unionByName(opened)


def _digests(rows: DataFrame, conv_type: str) -> DataFrame:
    """(conv_id, digest) of repaired turns: sorted, and streamed through the hash."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, begun, kind = None, None, False, None
        done: list[dict] = []
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if digest is None or r["conv_id"] != conv:
                    if digest is not None:
                        done.append({"conv_id": conv, "digest": digest.hexdigest()})
                    conv, digest, begun = r["conv_id"], hashlib.sha256(), False
                for line in _lines([(r["before"], None, r["new_role"])], r["after"], [r["text"]]):
                    digest.update(("\n" * begun + line).encode())
                    begun = True
        if digest is not None:
            done.append({"conv_id": conv, "digest": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(done, pa.schema([("conv_id", kind), ("digest", pa.string())]))

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "run", "place")
    return ordered.select("conv_id", "before", "new_role", "after", "text").mapInArrow(stream, _typed("conv_id long, digest string", conv_type))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, part, run, place, step, role, text): the turns of the repaired conversations, in this order, from the second table of `repair`."""
    made = lambda r: F.struct(r.alias("role"), F.lit("").alias("text"))
    own = F.when(F.col("new_role").isNotNull(), F.array(F.struct(F.col("new_role").alias("role"), "text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    all_of = F.concat(F.transform("before", made), own, F.transform("after", made))
    return turns.select("conv_id", "part", "run", "place", F.posexplode(all_of).alias("step", "t")).select("conv_id", "part", "run", "place", "step", "t.role", "t.text")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by the checksum of conversation and turn: dropped, emptied, cut, repeated or given to the user."""
    space = F.lit(" ")
    kind = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))), F.lit(20))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


def op12_minplus_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after planted damage, and its cheapest repair."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found, _ = repair(damaged(turns))
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    met = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_EMPTY_TURN = "{{'c': {0}.c + 2, 'a': {0}.a || 'I', 'o': {0}.o || '{1}:' || chr(10)}}"


def _sql_closed(s: list[str]) -> list[str]:
    """SQL of the four states with inserted turns, from SQL of the states without."""
    add = lambda x, role: f"CASE WHEN {x} IS NOT NULL THEN {_EMPTY_TURN.format(x, role)} END"
    user = f"list_min([{s[2]}, {add(s[0], 'user')}, {add(s[1], 'user')}])"
    return [s[0], s[1], f"list_min([{user}, {add(s[3], 'user')}])", f"list_min([{s[3]}, {add(f'({user})', 'assistant')}])"]


def _sql_edit(state: str, cost: str, letter: str, role: str, keeps: str) -> str:
    made = f"{state}.o || {role} || ':' || r.text || chr(10)" if role else f"{state}.o"
    return f"CASE WHEN {state} IS NOT NULL AND {keeps} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {made}}} END"


def _sql_turn() -> list[str]:
    cut = "(r.fault = 'truncated')::INT"
    stays, whose = "r.fault NOT IN ('blank', 'duplicate')", "left(r.role, 1)"
    out = []
    for j in range(4):
        ways = [_sql_edit(f"d.s{j}", "3", "D", "", "true")]
        for (i, initial), to in _NEXT.items():
            if to == j:
                ways.append(_sql_edit(f"d.s{i}", cut, "K", "r.role", f"{stays} AND {whose} = '{initial}'"))
                if initial != "s":
                    ways.append(_sql_edit(f"d.s{i}", f"(2 + {cut})", "R", f"'{_ROLE[to]}'", stays))
        out.append(f"list_min([{', '.join(ways)}])")
    return out


_STATE = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"
_START = _sql_closed([f"{{'c': 0::BIGINT, 'a': '', 'o': ''}}::{_STATE}", *[f"NULL::{_STATE}"] * 3])
REPAIR_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM conversations, crc
), dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM dam
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM n
), d AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, {", ".join(f"{x} AS s{i}" for i, x in enumerate(_START))} FROM conversations
  UNION ALL
  SELECT conv_id, pos, {", ".join(f"{x} AS s{i}" for i, x in enumerate(_sql_closed(["n0", "n1", "n2", "n3"])))} FROM (
    SELECT d.conv_id, r.pos, {", ".join(f"{x} AS n{i}" for i, x in enumerate(_sql_turn()))}
    FROM d JOIN f r ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = d.pos + 1)
), last AS (
  SELECT conv_id, arg_max(list_min([s0, s3]), pos) AS best FROM d GROUP BY conv_id
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM f GROUP BY conv_id
)
SELECT last.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.o[:-2]) AS repaired_sha256
FROM last LEFT JOIN g ON last.conv_id IS NOT DISTINCT FROM g.conv_id
"""
