"""Deletion through a declared graph of foreign keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """Rows of ``child`` whose ``column`` names a row of ``parent`` (by its primary key) go with it,
    or stay without it where ``detach``."""

    child: str
    column: str
    parent: str
    detach: bool = False


PRIMARY = {"documents": "document_id", "jobs": "job_id", "bases": "kb", "sessions": "session_id"}
#: What belongs to a document: eight tables with itself.
DOCUMENT_KEYS = (
    Key("citations", "document_id", "documents"), Key("jobs", "document_id", "documents"), Key("receipts", "job_id", "jobs"), Key("pages", "document_id", "documents"),
    Key("chunks", "document_id", "documents"), Key("assets", "document_id", "documents"), Key("results", "document_id", "documents"),
)
#: What belongs to a base besides; sessions outlive it.
BASE_KEYS = (Key("documents", "kb", "bases"), Key("permissions", "kb", "bases"), Key("chunks", "kb", "bases"), Key("citations", "kb", "bases"), Key("sessions", "kb", "bases", detach=True), *DOCUMENT_KEYS)


def order_of(keys: Sequence[Key]) -> list[str]:
    """Tables with parents before their children."""
    left, out = {k.child for k in keys} | {k.parent for k in keys}, []
    while left:
        free = sorted(t for t in left if not any(k.child == t and k.parent in left for k in keys))
        if not free:
            raise ValueError("foreign keys form a circle")
        out += free
        left -= set(free)
    return out


def cascade(tables: dict[str, DataFrame], root: str, ids: DataFrame, keys: Sequence[Key] = DOCUMENT_KEYS) -> dict[str, DataFrame]:
    """``tables`` without the rows ``ids`` (the primary key of ``root``) and all that hangs on them.

    Keys to tables that are not given are left out, but a child of a child goes by the
    gone rows of its own parent alone. A null reference names nothing."""
    known = [k for k in keys if k.child in tables and (k.parent in tables or k.parent == root)]
    gone: dict[str, DataFrame] = {root: ids.select(PRIMARY[root]).distinct()}
    out = dict(tables)
    for name in order_of(known) if known else [root]:
        if name not in tables:
            continue
        rows, own = tables[name], [k for k in known if k.child == name and k.parent in gone]
        if name == root:
            out[name] = rows.join(gone[root], PRIMARY[root], "left_anti")
        for k in own:
            dead = gone[k.parent].withColumnRenamed(PRIMARY[k.parent], k.column)
            if k.detach:
                marked = out[name].join(dead.withColumn("__gone", F.lit(True)), k.column, "left")
                out[name] = marked.withColumn(k.column, F.when(F.col("__gone").isNull(), F.col(k.column))).select(*rows.columns)
            else:
                out[name] = out[name].join(dead, k.column, "left_anti")
        if name != root and name in PRIMARY and any(k.parent == name for k in known):
            parts = [rows.join(gone[k.parent].withColumnRenamed(PRIMARY[k.parent], k.column), k.column, "left_semi").select(PRIMARY[name]) for k in own if not k.detach]
            for p in parts:
                gone[name] = p if name not in gone else gone[name].union(p)
            if name in gone:
                gone[name] = gone[name].distinct()
    return out


def deleted_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(name, kept, deleted) of each table."""
    out = None
    for name, rows in before.items():
        part = rows.agg(F.count("*").alias("n")).crossJoin(after[name].agg(F.count("*").alias("kept")))  # one row each
        part = part.select(F.lit(name).alias("name"), "kept", (F.col("n") - F.col("kept")).alias("deleted"))
        out = part if out is None else out.unionByName(part)
    return out
