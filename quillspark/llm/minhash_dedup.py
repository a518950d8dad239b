"""Near duplicates by a chosen-path set similarity join.

A document is the set of its word shingles.  Equal texts are first folded into
one representative, whatever their number.  Each independent tree then branches
the representatives: a node picks some minwise coordinates, by a hash of its own
path, and every document goes to the child named by its own value there.  Similar
documents share values, so they stay together.

* A node with one document ends.
* A small node is compared exhaustively, by minhash estimate with a wide margin and
  by set sizes; each candidate is then confirmed on the full shingle sets.
* In a large node of the first trees every document is compared with the node's
  smallest one, in the same two steps.  Where that leaves more than one component, and more than a few
  documents outside the largest, the node branches on, two children a document.
  The next branchings are wide, so that no pair at the threshold is lost on the way;
  later ones are narrow, so that documents below it become fewer with every level.
* Where those outside the largest component make a few blocks at most, a node is
  compared on the full sets: those outside with each other and with blocks of the
  largest component, whose members need not be compared among themselves.  That
  returns what hangs together, one row a document, so a group of near copies never
  becomes all its pairs.

Components are found on representatives, one row each, before memberships are
exploded; no join returns more rows than there are memberships.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.components import components
from quillspark.llm.text import U64, mix, pieces, shingle_sets, small_batches, unused, words
from quillspark.scratch import Scratch


@dataclass(frozen=True)
class DedupParams:
    """``words``: words of a shingle. ``percent``: similarity from which documents link.
    ``trees``: independent trees. A pair at 0.8 follows a first branching of ``extra`` more
    children with chance 0.84, and ``wide`` later ones, of two children each, with 0.94
    for all levels together, in 6.5 nodes on average, so all trees miss it with a chance
    of 7e-5 at most. Narrow ones after that, 1.25 children each, keep one such node with
    0.3 for ten levels, and the pair with 0.9. ``slots``: minwise coordinates. ``small``: documents of a node that is compared by its pairs.
    ``leader_trees``: trees whose large nodes are compared with their smallest document
    first; that only saves later work.
    ``block`` and ``block_shingles``: documents and shingles of a block; ``rest``: documents
    outside the largest component of a node that is compared on full sets, a few blocks,
    as branching on would copy each document as often. ``levels``: branchings at most. ``broadcast_ids``: ids up to which a filter
    is sent to all tasks (24 bytes each)."""

    words: int = 5
    percent: int = 80
    trees: int = 6
    slots: int = 64
    small: int = 50
    leader_trees: int = 3
    rest: int = 3_000
    block: int = 1_000
    block_shingles: int = 1_000_000
    wide: int = 4
    levels: int = 24
    extra: float = 0.25
    broadcast_ids: int = 500_000


def sketch(docs: DataFrame, params: DedupParams) -> DataFrame:
    """(doc_id, text_hash, rep, n_shingles, sig) of each row: a hash of its text, one of its
    words in order, the size of its set, and the minwise values, 4 bytes a slot.

    rep stands for all texts with these words; two of n different ones share it with a
    chance of about ``n * n / 2 ** 65``, as their words do."""
    seeds = mix(np.arange(1, params.slots + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
    size = params.words
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("rep", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashed = batch.column(0), batch.column(2)
            for start, part in pieces(batch.column(1)):
                found = words(part)
                sets, counts = shingle_sets(found, size), found.counts
                ends = found.ends
                rep = np.zeros(len(part), np.int64)
                if len(found.hashes):
                    place = np.arange(len(found.hashes)) - np.repeat(ends - counts, counts)
                    some = np.flatnonzero(counts)
                    keyed = np.add.reduceat(mix(found.hashes ^ mix(place.astype(U64))), (ends - counts)[some])
                    rep[some] = mix(keyed).view(np.int64)
                full = [i for i, s in enumerate(sets) if len(s)]
                least = np.zeros((len(full), params.slots), np.uint32)
                if full:
                    flat = np.concatenate([sets[i] for i in full])
                    begins = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
                    for k, seed in enumerate(seeds):
                        value = (flat ^ seed) * U64(0x9FB21C651E98DF25)
                        least[:, k] = np.minimum.reduceat((value ^ (value >> U64(29))) >> U64(20) & U64(0xFFFFFFFF), begins)
                row_of = {i: j for j, i in enumerate(full)}
                sigs = [least[row_of[i]].tobytes() if i in row_of else None for i in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, len(part)), hashed.slice(start, len(part)), pa.array(rep), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())],
                    schema=schema,
                )

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, rep long, n_shingles long, sig binary")


def _branch(rows: DataFrame, params: DedupParams, level: int) -> DataFrame:
    """Children of each row's node: one coordinate, and a second one with chance ``extra``,
    always at the ``wide`` levels after the first, chosen by the node alone, so that all its
    documents choose alike."""
    extra = 1.0 if 1 <= level <= params.wide else params.extra
    first = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(params.slots)).cast("int")
    second = F.pmod(F.xxhash64("node", F.lit(level), F.lit(1)), F.lit(params.slots)).cast("int")
    more = F.pmod(F.xxhash64("node", F.lit(level), F.lit(2)), F.lit(1000)) < int(1000 * extra)
    chosen = F.when(more & (first != second), F.array(first, second)).otherwise(F.array(first))
    out = rows.withColumn("__slot", F.explode(chosen))
    return out.withColumn("node", F.xxhash64("node", "__slot", F.expr("substring(sig, 4 * __slot + 1, 4)"))).drop("__slot")


def _least_equal(params: DedupParams) -> float:
    """Equal slots of a candidate at least: five standard deviations below the threshold's mean."""
    share = params.percent / 100
    return params.slots * share - 5 * (params.slots * share * (1 - share)) ** 0.5


def _by_run(rows: DataFrame, keys: list[str], columns: list[str], compare: Callable[[dict[str, pa.ChunkedArray | np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b) of ``compare`` over every group of equal ``keys``.

    Groups are runs of sorted rows; a task reads one after the other and holds one at
    a time, which is much cheaper than a grouped function call for each small group.
    """

    def found(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        flat = {c: table.column(c) if pa.types.is_binary(table.schema.field(c).type) else table.column(c).to_numpy() for c in columns}
        pairs = [compare({c: v[begin:end] if isinstance(v, np.ndarray) else v.slice(begin, end - begin) for c, v in flat.items()}) for begin, end in zip(starts, ends)]
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*pairs) if pairs else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([*held, batch]).combine_chunks()
                key = np.stack([table.column(k).to_numpy() for k in keys])
                starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
                if len(starts) > 1:
                    yield found(table, starts[:-1], starts[1:])
                held = table.slice(starts[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield found(table, np.array([0]), np.array([table.num_rows]))

    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _small_pairs(rows: DataFrame, params: DedupParams) -> DataFrame:
    """Candidates of small nodes: all their pairs that sizes and estimate allow."""
    least, slots, percent = _least_equal(params), params.slots, params.percent

    def compare(group: dict) -> tuple[np.ndarray, np.ndarray]:
        rep, size = group["rep"], group["n_shingles"]
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(-1, slots)
        a, b = np.triu_indices(len(rep), 1)
        fits = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        a, b = a[fits], b[fits]
        near = (sig[a] == sig[b]).sum(axis=1) >= least
        return rep[a[near]], rep[b[near]]

    return _by_run(rows, ["node"], ["rep", "n_shingles", "sig"], compare)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 8_192) -> np.ndarray:
    """Sizes of the intersections of all on the left with all on the right, exactly: products
    of 0/1 columns, ``width`` shingles that both sides have at a time. Where both are one list, those of one
    document alone are left out, so its overlap with itself is too small."""
    if left is right:
        names, held_by = np.unique(np.concatenate(left), return_counts=True)
        names = names[held_by > 1]
    else:
        names = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for sets in (left, right):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.searchsorted(names, flat)
        hit = names[np.minimum(column, len(names) - 1)] == flat if len(names) else np.zeros(len(flat), bool)
        order = np.argsort(column[hit], kind="stable")
        sides.append((len(sets), row[hit][order], column[hit][order]))
    total = np.zeros((len(left), len(right)))
    for begin in range(0, len(names), width):
        held = []
        for n, row, column in sides:
            part = slice(*np.searchsorted(column, [begin, begin + width]))
            held.append(np.zeros((n, min(width, len(names) - begin)), np.float32))
            held[-1][row[part], column[part] - begin] = 1.0
        total += held[0] @ held[1].T
    return total


def _dealt(rows: DataFrame, params: DedupParams) -> DataFrame:
    """Rows of nodes that are compared, once for each group of (node, left, right) that they are in.

    Blocks of the largest component (left < 0) meet every block of the rest, and those meet
    each other. ``side``: 0 left, 1 right, 2 both. So no task holds a whole large node, and
    each document of the largest component is copied as often as the rest has blocks."""
    blocks = lambda n, shingles: F.greatest(F.ceil(F.col(n) / params.block), F.ceil(F.col(shingles) / params.block_shingles)).cast("int")
    cut = rows.withColumn("__most", blocks("n_most", "s_most")).withColumn("__rest", blocks("n_rest", "s_rest"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("rep"), F.when(F.col("most"), F.col("__most")).otherwise(F.col("__rest"))).cast("int"))
    most = "transform(sequence(0, __rest - 1), k -> struct(-1 - part AS left, k AS right, 0 AS side))"
    rest = "transform(sequence(0, __most - 1), i -> struct(-1 - i AS left, part AS right, 1 AS side))"
    each = "transform(sequence(0, __rest - 1), k -> struct(least(part, k) AS left, greatest(part, k) AS right, CASE WHEN k > part THEN 0 WHEN k < part THEN 1 ELSE 2 END AS side))"
    groups = F.explode(F.expr(f"IF(most, {most}, concat({rest}, {each}))"))
    return cut.withColumn("__in", groups).select("node", "__in.*", "rep", "n_shingles", "set")


def _leaf_links(rows: DataFrame, params: DedupParams) -> DataFrame:
    """(a, b): each document of a group with the smallest one that it hangs together with there."""
    percent = params.percent

    def compare(group: dict) -> tuple[np.ndarray, np.ndarray]:
        rep, size, side = group["rep"], group["n_shingles"], group["side"]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return rep[:0], rep[:0]
        sets = [np.frombuffer(x, U64) for x in group["set"].to_pylist()]
        on_left = [sets[i] for i in left]
        on_right = on_left if np.array_equal(left, right) else [sets[i] for i in right]
        both = _overlaps(on_left, on_right)
        u, v = np.nonzero(100 * both >= percent * (size[left][:, None] + size[right][None, :] - both))
        u, v = left[u], right[v]
        order = np.argsort(np.argsort(rep, kind="stable"), kind="stable")  # the smallest rep of a part is its root
        root = order.copy()
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            if (new == root).all():
                break
            root = new
        named = np.sort(rep, kind="stable")[root]
        some = named != rep
        return rep[some], named[some]

    return _by_run(_dealt(rows, params), ["node", "left", "right"], ["rep", "n_shingles", "side", "set"], compare)


def _mixed(members: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """Rows (rep, comp, n_shingles, node) of nodes with more than ``least`` documents and more
    than one component: with ``most``, whether the row is of the node's largest component, and
    numbers and shingles of that and of the rest."""
    each = members.groupBy("node", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    top = F.max(F.struct("n", (-F.col("comp")).alias("c"), "s")).alias("top")
    nodes = each.groupBy("node").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("comps"), top)
    nodes = nodes.where((F.col("n") > least) & (F.col("comps") > 1)).select(
        "node", (-F.col("top.c")).alias("__top"), F.col("top.n").alias("n_most"), F.col("top.s").alias("s_most"), (F.col("n") - F.col("top.n")).alias("n_rest"), (F.col("s") - F.col("top.s")).alias("s_rest")
    )
    rows = members.join(scratch.save(nodes, "nodes"), "node")
    return scratch.save(rows.withColumn("most", F.col("comp") == F.col("__top")).drop("__top"), "mixed")


def _leader_pairs(rows: DataFrame, params: DedupParams, scratch: Scratch) -> DataFrame:
    """Candidates (document, leader of its large node), by the estimate.

    The leader is the node's smallest document.  Leaders are written first: both
    sides of the join are plain tables then, so a hot node's partition can be split.
    """
    least, slots = _least_equal(params), params.slots

    @F.pandas_udf("int")
    def equal(x: pd.Series, y: pd.Series) -> pd.Series:
        left = np.frombuffer(b"".join(x), np.uint32).reshape(len(x), slots)
        right = np.frombuffer(b"".join(y), np.uint32).reshape(len(x), slots)
        return pd.Series((left == right).sum(axis=1).astype("int32"))

    leader = F.min_by(F.struct("rep", "n_shingles", "sig"), "rep").alias("leader")
    leaders = scratch.save(rows.groupBy("node").agg(leader), "leaders")
    joined = rows.join(leaders, "node").where("rep <> leader.rep")
    sizes = F.col("n_shingles"), F.col("leader.n_shingles")
    joined = joined.where(100 * F.least(*sizes) >= params.percent * F.greatest(*sizes))
    joined = joined.where(equal("sig", "leader.sig") >= least)
    return joined.select(F.least("rep", "leader.rep").alias("a"), F.greatest("rep", "leader.rep").alias("b"))


def _sets(docs: DataFrame, wanted: DataFrame, params: DedupParams) -> DataFrame:
    """(rep, set) of the representatives ``wanted`` (rep, doc_id, text_hash): their sorted
    shingles, 8 bytes each. A row that is repeated counts once."""
    small = F.broadcast(wanted) if wanted.count() <= params.broadcast_ids else wanted
    size = params.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in pieces(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(words(part), size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(sets, pa.binary())], names=["rep", "set"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    some = rows.join(small, ["doc_id", "text_hash"]).select("rep", "text").mapInArrow(run, "rep long, set binary")
    return some.groupBy("rep").agg(F.first("set").alias("set"))


def _confirm(pairs: DataFrame, sets: DataFrame, params: DedupParams) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    percent = params.percent

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out, last, left = [], None, None
        for a, b in zip(x, y):
            if a is not last:
                last, left = a, np.frombuffer(a, U64)
            right = np.frombuffer(b, U64)
            both = len(np.intersect1d(left, right, assume_unique=True))
            out.append(100 * both >= percent * (len(left) + len(right) - both))
        return pd.Series(out, dtype=bool)

    first, second = sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), sets.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    return pairs.join(first, "a").join(second, "b").where(linked("x", "y")).select("a", "b")


def _memberships(reps: DataFrame, params: DedupParams, columns: list[str]) -> DataFrame:
    """Rows of ``columns``, tree and node, one for each tree and child of a representative's first branching."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(params.trees - 1)))
    rows = reps.select(*columns, "sig", trees.alias("tree")).withColumn("node", F.xxhash64(F.lit(5), "tree"))
    return _branch(rows, params, 0).select(*columns, "tree", "node")


def _links(docs: DataFrame, reps: DataFrame, params: DedupParams, scratch: Scratch) -> DataFrame | None:
    """(node, component) of the representatives (rep, doc_id, text_hash, n_shingles, sig) that have a link."""
    found = reps.select("rep", "doc_id", "text_hash")
    nodes = _memberships(reps, params, ["rep"])
    sizes = scratch.save(nodes.groupBy("tree", "node").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
    few, led = F.col("n") <= params.small, F.col("tree") < params.leader_trees
    signed = lambda part: scratch.save(part.join(reps.select("rep", "n_shingles", "sig"), "rep"), "rows")
    small = signed(nodes.join(sizes.where(few).select("node"), "node", "left_semi"))
    large = signed(nodes.where(led).join(sizes.where(led & ~few).select("node"), "node", "left_semi"))
    pairs = scratch.save(_small_pairs(small, params).union(_leader_pairs(large, params, scratch)).distinct(), "pairs")
    some = scratch.save(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "some")
    sets = scratch.save(_sets(docs, scratch.save(found.join(some, "rep"), "wanted"), params), "sets")
    links = scratch.save(_confirm(pairs, sets, params), "links")
    known = components(links, scratch)
    scratch.drop(small, large, sets, pairs)
    named = reps.join(known, F.col("rep") == F.col("node"), "left").select("rep", "n_shingles", "sig", F.coalesce("component", "rep").alias("comp"))
    named = scratch.save(named, "named")
    members, leaves = _memberships(named, params, ["rep", "comp", "n_shingles"]).drop("tree"), None
    for level in range(params.levels + 1):
        mixed = _mixed(members, params.small if level == 0 else 1, scratch)
        ready = F.lit(level == params.levels) | (F.col("n_rest") <= params.rest)
        leaves = mixed.where(ready) if leaves is None else leaves.unionByName(mixed.where(ready))
        deep = mixed.where(~ready)
        if deep.isEmpty():
            break
        deep = deep.select("rep", "comp", "n_shingles", "node").join(named.select("rep", "sig"), "rep")
        members = scratch.save(_branch(deep, params, level + 1).select("rep", "comp", "n_shingles", "node"), "children")
    if leaves.isEmpty():
        return known
    some = scratch.save(leaves.select("rep").distinct(), "some")
    sets = scratch.save(_sets(docs, scratch.save(found.join(some, "rep"), "wanted"), params), "sets")
    more = scratch.save(_leaf_links(leaves.join(sets, "rep"), params).distinct(), "links")
    scratch.drop(sets)
    return known if more.isEmpty() else components(links.union(more), scratch)


def _classified(docs: DataFrame, params: DedupParams, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, n_shingles, group, least) of every row: least is the smallest
    (doc_id, text_hash) of its group; both are null where the row links with nothing by rule."""
    sketched = scratch.save(sketch(docs, params), "sketch")
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    reps = usable.groupBy("rep").agg(least, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    reps = scratch.save(reps.select("rep", "least.doc_id", "least.text_hash", "n_shingles", "sig"), "representatives")
    known = _links(docs, reps, params, scratch)
    named = reps.join(known, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("group"), F.struct("doc_id", "text_hash").alias("own"))
    named = scratch.save(named, "grouped")
    least = scratch.save(named.groupBy("group").agg(F.min("own").alias("least")), "least")
    named = scratch.save(named.join(least, "group").select("rep", "group", "least"), "classes")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    rows = sketched.select("doc_id", "text_hash", "n_shingles", F.when(usable, F.col("rep")).alias("rep"))
    return rows.join(named, "rep", "left").drop("rep")


def classes(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links, itself included.  Null
    and wordless texts have no shingles and link with nothing; texts of fewer than
    ``words`` words are one shingle.  Rows that repeat a doc_id are each judged by
    their own text; rows without a doc_id stay alone with a null component.
    """
    rows = _classified(docs.select("doc_id", "text"), params, Scratch(docs.sparkSession, "minhash"))
    return rows.select("doc_id", "text_hash", "n_shingles", F.coalesce("least.doc_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """``docs`` with one row of each group alone, that of the smallest doc_id, all columns kept.

    Rows without words stay, and so do rows without a doc_id.  Of rows that repeat
    both doc_id and text one stays.  What goes is found by (doc_id, hash of the
    text), and sent to all tasks while it is small.
    """
    scratch = Scratch(docs.sparkSession, "deduplicated")
    found = scratch.save(_classified(docs.select("doc_id", "text"), params, scratch).where("group is not null"), "decided")
    own = F.struct("doc_id", "text_hash")
    named = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")]
    gone = scratch.save(found.where(own != F.col("least")).select(*named).distinct(), "gone")
    again = found.where(own == F.col("least")).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    again = scratch.save(again.select(*named), "repeated")
    small = lambda ids: F.broadcast(ids) if ids.count() <= params.broadcast_ids else ids  # noqa: E731  16 bytes each
    own_hash = unused(docs.columns, "__text_hash")
    key, mark = unused(docs.columns, "__id"), unused(docs.columns, "__hash")
    hashed = docs.withColumn(own_hash, F.xxhash64("text"))
    gone, again = gone.toDF(key, mark), again.toDF(key, mark)
    same = lambda ids: (F.col("doc_id") == F.col(key)) & (F.col(own_hash) == F.col(mark))
    kept = hashed.join(small(gone), same(gone), "left_anti")
    if not again.isEmpty():
        once = kept.join(small(again), same(again), "left_semi").dropDuplicates(["doc_id", own_hash])
        kept = kept.join(small(again), same(again), "left_anti").unionByName(once)
    return kept.drop(own_hash)
