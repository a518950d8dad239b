"""Repair of the turn structure of conversations at least cost.

Kept roles must read: nothing, or perhaps one system turn and then pairs of user and
assistant turns.  A turn is kept, given another role or deleted, and empty turns may be
put in anywhere.  The cheapest edits come from a fold over the sorted turns that carries
four (cost, audit) structs, one for each thing that may stand last: nothing, system,
user, assistant.  ``least`` of two structs takes the cheaper, and of equals the audit that
is first in ASCII; what follows is added to both alike, so the choice stays right.

No array holds a whole conversation's turns.  Turns are ordered by ranges, cut into
segments, and each segment is folded from each of the four states; a conversation then
folds its segments' tables.  Turns alike in conversation, turn, role and text are one row with
a count: all but the first are duplicates.  Texts travel as digests until the end, where
they are put in order once and edited as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.expressions import same_text, without
from quillspark.scratch import Scratch

RETYPE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5  # costs; the last is of a truncated turn that stays
_NEVER = 1 << 40
_STATES = "esua"  # what stands last: nothing, system, user, assistant
_LEGAL = ("su", "ua", "au")
SEGMENT = 512


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) of ``rows``, some of them damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 leaves none (n = 0), 1 empties the text, 2 takes its ends of sentences, 3 repeats the
    turn (n = 2), 4 makes its role user. Nulls of role and text, and in the hash, are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(k == 1, "").when(k == 2, without(space("text"), ".!?")).otherwise(space("text"))
    role = F.when(k == 4, "user").otherwise(space("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("n"))


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def _turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, kind) of different turns; kind: Blank, Duplicate, Truncated or Good.

    A turn is a duplicate if its role and text stand at an earlier turn. The kind is that of the
    first of the ``n``; the others are blank as it is, or duplicates."""
    solid = without(F.col("text"), "\t\n\x0b\x0c\r ")
    kind = F.when(solid == "", "B").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "T").otherwise("G")
    each = rows.where("n > 0").select("conv_id", "turn", "role", same_text(F.col("text")).alias("digest"), kind.alias("kind"), "n")
    each = each.groupBy("conv_id", "turn", "role", "digest").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))
    key = ["conv_id", "role", "digest"]
    place = F.struct(F.col("turn").isNotNull(), "turn")  # nulls first
    first = each.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    found = each.alias("x").join(first.alias("y"), reduce(lambda a, b: a & b, (F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in key)), "left")
    later = F.col("first").isNotNull() & (place_of("x") != F.col("first"))
    return found.select("x.conv_id", "x.turn", "x.role", "x.digest", "x.n", F.when((F.col("kind") != "B") & later, "D").otherwise(F.col("kind")).alias("kind"))


def place_of(side: str) -> Column:
    return F.struct(F.col(f"{side}.turn").isNotNull(), F.col(f"{side}.turn"))


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(state: Column, cost: Column | int, edit: Column | str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], F.lit(edit) if isinstance(edit, str) else edit))


def _all(states: dict[str, Column]) -> Column:
    return F.struct(*(states[x].alias(x) for x in _STATES))


def _inserted(s: Column) -> Column:
    """The states when empty turns may follow: a user turn after all but a user's, an assistant's after that."""
    user = F.least(s["u"], *(_then(s[x], INSERT, "I") for x in "esa"))
    return _all({"e": s["e"], "s": s["s"], "u": user, "a": F.least(s["a"], _then(user, INSERT, "I"))})


def _step(s: Column, row: Column) -> Column:
    """The states after one different turn and its ``n`` - 1 repeats, which are all deleted."""
    more, initial, bad = row["n"] - 1, row["initial"], row["kind"].isin("B", "D")
    stays = F.when(row["kind"] == "T", UNFINISHED).otherwise(0)
    gone = {x: _then(s[x], DELETE, "D") for x in _STATES}

    def into(state: Column, role: str) -> Column:
        same = initial == role
        return _then(state, stays + F.when(same, 0).otherwise(RETYPE), F.when(same, "K").otherwise("R"))

    never = _state(F.lit(_NEVER), F.lit(""))
    stay = {
        "e": never,
        "s": F.when(initial == "s", _then(s["e"], stays, "K")).otherwise(never),
        "u": into(F.least(s["e"], s["s"], s["a"]), "u"),
        "a": into(s["u"], "a"),
    }
    best = {x: F.when(bad, gone[x]).otherwise(F.least(gone[x], stay[x])) for x in _STATES}
    repeats = F.when(more > 0, F.repeat(F.lit("D"), more.cast("int"))).otherwise("")
    return _all({x: _then(best[x], DELETE * more, repeats) for x in _STATES})


def _folded(turns: Column) -> Column:
    """For each state before a segment, the states after it."""
    start = lambda k: _all({x: _state(F.when(k == i, 0).otherwise(_NEVER), F.lit("")) for i, x in enumerate(_STATES)})
    return F.transform(F.array(*(F.lit(i) for i in range(4))), lambda k: F.aggregate(turns, start(k), lambda s, row: _inserted(_step(s, row))))


def _joined(s: Column, table: Column) -> Column:
    """The states after a segment whose table is given."""
    step = lambda x: F.least(*(_then(s[y], F.get(table, F.lit(i))[x]["cost"], F.get(table, F.lit(i))[x]["audit"]) for i, y in enumerate(_STATES)))
    return _all({x: step(x) for x in _STATES})


def edits(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of conversations that have turns.

    ``rows`` as :func:`damaged` gives them. Turns stand by number, nulls first, equal ones by
    role and then by the digest of their text.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    turns = _turns(rows).withColumn("initial", F.left("role", F.lit(1)))
    ranged = turns.repartitionByRange("conv_id", *_order()).withColumn("part", F.spark_partition_id())
    ranged = scratch.save(ranged, "ranged")
    within = Window.partitionBy("part", "conv_id").orderBy(*_order())
    before, last = F.lag("initial").over(within), F.lag("turn").over(within)
    row = F.row_number().over(within)
    broken = F.col("n") - 1 + F.when(before.isNotNull() & ~F.concat(before, "initial").isin(*_LEGAL), 1).otherwise(0)
    new = F.when(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(last), 1).otherwise(0)
    counted = ranged.withColumns({"row": row, "broken": broken, "new": new})
    counted = counted.withColumn("segment", F.floor((F.col("row") - 1) / segment))
    of = lambda k, n: F.sum(F.when(F.col("kind") == k, n).otherwise(0))
    more = F.col("n") - 1
    pieces = counted.groupBy("conv_id", "part", "segment").agg(
        F.sort_array(F.collect_list(F.struct("row", "initial", "kind", "n"))).alias("turns"),
        of("B", F.col("n")).alias("blank"),
        (of("D", F.col("n")) + of("T", more) + of("G", more)).alias("duplicate"),
        of("T", F.lit(1)).alias("truncated"),
        F.sum("broken").alias("illegal"),
        F.sum("new").alias("different"),
        F.min("turn").alias("least"),
        F.max("turn").alias("most"),
        F.min_by("initial", "row").alias("head"),
        F.max_by("initial", "row").alias("tail"),
        F.min_by("turn", "row").alias("head_turn"),
        F.max_by("turn", "row").alias("tail_turn"),
    )
    pieces = scratch.save(pieces.withColumn("table", _folded(F.col("turns"))).drop("turns"), "segments")
    sums = ("blank", "duplicate", "truncated", "illegal", "different")
    whole = pieces.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "segment", "table", "head", "tail", "head_turn", "tail_turn"))).alias("pieces"),
        *(F.sum(c).alias(c) for c in sums), F.min("least").alias("least"), F.max("most").alias("most"),
    )
    # where a conversation passes from one range to the next, the turns at the border meet only here
    meets = lambda i: F.when((i > 0) & (F.get("pieces", i)["segment"] == 0), 1).otherwise(0)
    pair = lambda i: F.concat(F.get("pieces", i - 1)["tail"], F.get("pieces", i)["head"])
    borders = F.sequence(F.lit(0), F.size("pieces") - 1)
    total = lambda f: F.aggregate(F.transform(borders, f), F.lit(0), lambda a, b: a + b)
    illegal = F.col("illegal") + total(lambda i: meets(i) * F.when(pair(i).isin(*_LEGAL), 0).otherwise(1))
    again = total(lambda i: meets(i) * F.when(F.coalesce(F.get("pieces", i)["head_turn"] == F.get("pieces", i - 1)["tail_turn"], F.lit(False)), 1).otherwise(0))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - (F.col("different") - again), F.lit(0))
    none = _state(F.lit(0), F.lit(""))
    start = _all({"e": none, "s": _state(F.lit(_NEVER), F.lit("")), "u": _state(F.lit(INSERT), F.lit("I")), "a": _state(F.lit(2 * INSERT), F.lit("II"))})
    best = F.aggregate("pieces", start, lambda s, p: _joined(s, p["table"]), lambda s: F.least(s["e"], s["a"]))
    found = whole.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"), best.alias("best"))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's edits and then its turns, in order, all in one task.

    A conversation's text is sorted, with spill, and then passes by; no task holds it."""
    texts = rows.withColumns({"digest": same_text(F.col("text")), "kind": F.lit(1)})
    heads = found.withColumn("kind", F.lit(0))
    both = heads.unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order()).select("conv_id", "kind", "role", "text", "n", "audit", *_COUNTS)


_ROLES = {"u": "user", "a": "assistant"}


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("begin", conv_id, counts, audit), then ("turn", edit, role, text) of each edit, for each conversation."""
    now, audit, at, last = object(), "", 0, ""  # ``last``: initial of the last turn that stays

    def added() -> tuple:
        return ("turn", "I", "assistant" if last == "u" else "user", "")

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0 or row["conv_id"] != now:
                now, audit, at, last = row["conv_id"], row["audit"] or "", 0, ""
                yield ("begin", now, [row[c] or 0 for c in _COUNTS], audit)
                while audit[at : at + 1] == "I":
                    yield (x := added())
                    at, last = at + 1, x[2][0]
            for _ in range(row["n"] if row["kind"] else 0):
                edit, at = audit[at], at + 1
                role = row["role"] if edit != "R" else "assistant" if last == "u" else "user"
                yield ("turn", edit, role, row["text"])
                last = last if edit == "D" else role[:1]
                while audit[at : at + 1] == "I":
                    yield (x := added())
                    at, last = at + 1, x[2][0]


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns that stay, from 1, with the edit that each had."""
    out = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, place, size = [], None, 0, 0
        for what, *x in _edited(batches):
            if what == "begin":
                now, place = x[0], 0
            elif x[0] != "D":
                place, size = place + 1, size + len(x[2])
                held.append((now, place, *x))
                if size > 4_000_000 or len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)

    return _in_order(rows, found).mapInArrow(stay, "conv_id long, position long, edit string, role string, text string")


def summary(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each conversation, those without turns too: counts, cost, audit and the SHA-256 of the
    repaired ``role:text`` lines, hashed as they pass."""
    out = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head, lines, digest = [], None, 0, None
        for what, *x in _edited(batches):
            if what == "begin":
                if head:
                    held.append((*head, digest.hexdigest()))
                head, lines, digest = (x[0], *x[1], x[2]), 0, hashlib.sha256()
                if len(held) >= 10_000:
                    yield batch(held)
                    held = []
            elif x[0] != "D":
                digest.update(f"{chr(10) if lines else ''}{x[1]}:{x[2]}".encode())
                lines += 1
        if head:
            held.append((*head, digest.hexdigest()))
            yield batch(held)

    return _in_order(rows, found).mapInArrow(hashed, f"conv_id long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")
