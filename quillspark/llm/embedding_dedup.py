"""Near-duplicate vectors through a robust-pruned flat graph.

Equal vectors are folded first.  Every class joins the shards of its nearest
cluster centres, so shards overlap; a shard larger than ``shard`` rows is dealt
into blocks.  A graph is built on each block by robust pruning, and the adjacency
lists of a vector from all its shards are united into one flat graph.  Each
vector then searches all blocks of its shards: greedily from the block's medoid
until nothing nearer turns up, then outwards over all neighbours within range.
What is within range is verified by cosine in double precision.  Centres that are
themselves within range of each other become one, so a dense region is one shard;
its blocks are compared exhaustively.  An audit compares some vectors, drawn whether
or not they have links, with all others by brute force; while the mean recall of
those with links is below ``recall``, shards and search are made again with twice
the overlap and the beam, in the end as one shard that is compared exhaustively.

Per pair only the smallest shard that both share counts it, so a group never
emits its pairs: it returns a count for each vector, and one link of each vector
to the smallest of its part of the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.components import components
from quillspark.scratch import Scratch


@dataclass(frozen=True)
class GraphParams:
    """``cosine``: from which vectors link. ``shard``: rows of a block, about. ``centres``: at
    most, fitted on ``sample`` rows. ``overlap``: shards of a vector. ``degree``: edges that
    pruning keeps, of ``near`` nearest and ``far`` random candidates. ``alpha``: slack of
    pruning. ``beam``: of the greedy search. ``audit``: the audit draws 16 times as many vectors."""

    cosine: float = 0.9
    shard: int = 1_200
    centres: int = 512
    sample: int = 20_000
    overlap: int = 2
    degree: int = 20
    near: int = 48
    far: int = 24
    alpha: float = 1.2
    beam: int = 12
    audit: int = 64
    recall: float = 0.99
    seed: int = 23


def _folded(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All rows with a hash of their vector, and one row of each class of equal vectors."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch["embedding"]:
                x = None if v is None else np.array([np.nan if y is None else y for y in v], np.float64)
                good = x is not None and len(x) and np.isfinite(x).all() and x.any()
                out.append(x.tobytes() if good else None)
            yield pd.DataFrame({"__id": batch["__id"], "vec": out})

    rows = vectors.select(F.col("vec_id").cast("string").alias("__id"), "embedding").mapInPandas(pack, "__id string, vec binary")
    rows = rows.select(F.col("__id").cast("long").alias("vec_id"), "vec", F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit(1)).alias("h2"))
    rows = scratch.save(rows, "vectors")
    good = rows.where("vec is not null and vec_id is not null")
    folded = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    return rows, scratch.save(folded, "classes")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows; scaling by the largest component first keeps squares finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _merged(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, frozenset[int]]:
    """Centres of which none were within ``least`` of another, and those that stand for several."""
    near = np.argmax(x @ c.T, axis=1)
    close, kept, stands = c @ c.T >= least, [], np.full(len(c), -1)
    for i in np.argsort(-np.bincount(near, minlength=len(c)), kind="stable"):
        if stands[i] < 0:
            stands[close[i] & (stands < 0)] = len(kept)
            stands[i] = len(kept)
            kept.append(i)
    sums = np.zeros((len(kept), c.shape[1]))
    np.add.at(sums, stands[near], x)
    full = np.abs(sums).max(axis=1) > 0
    dense = np.flatnonzero(np.bincount(stands, minlength=len(kept)) > 1)
    return _unit(np.where(full[:, None], sums, c[kept])), frozenset(dense.tolist())


def centres(folded: DataFrame, params: GraphParams) -> tuple[dict[int, np.ndarray], frozenset[int]]:
    """Spherical k-means by vector length, on a bounded sample; one centre a ``shard`` rows, about,
    but one alone in a dense region. Also the shards of those regions."""
    sizes = {r["d"]: r["n"] for r in folded.groupBy((F.octet_length("vec") / 8).cast("int").alias("d")).agg(F.count("*").alias("n")).collect()}
    total, out, dense = sum(sizes.values()), {}, set()
    if not total:
        return out, frozenset()
    place = F.pmod(F.xxhash64("h1", F.lit(params.seed)), F.lit(1 << 30))
    sample = folded.where(place < int((1 << 30) * min(1.0, params.sample / total)) + 1).orderBy("h1", "h2").select("vec").toPandas()["vec"]
    for d, n in sizes.items():
        own = [v for v in sample if len(v) == 8 * d]
        if not own:
            continue
        x = _unit(_matrix(pd.Series(own)))
        k = int(min(params.centres, max(1, 2 * n // params.shard), len(x)))
        rng = np.random.default_rng(params.seed)
        c = x[rng.permutation(len(x))[:k]]
        for _ in range(8):
            near = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            full = np.abs(sums).max(axis=1) > 0
            c = np.where(full[:, None], sums, c)
            c = _unit(c)
        out[d], regions = _merged(x, c, params.cosine)
        dense |= {_shard(8 * d, k) for k in regions}
    return out, frozenset(dense)


def _shard(size: int, centre: int) -> int:
    """Number of the shard of a centre of vectors of ``size`` bytes."""
    return int(size) * 1_000_000 + int(centre)


def _members(folded: DataFrame, found: dict[int, np.ndarray], params: GraphParams) -> DataFrame:
    """(id, copies, vec, shards): the nearest centres of each class, in ascending order."""
    shared = folded.sparkSession.sparkContext.broadcast(found)
    overlap = params.overlap

    @F.pandas_udf("array<long>")
    def nearest(column: pd.Series) -> pd.Series:
        out = [None] * len(column)
        lengths = column.map(len).to_numpy()
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            c = shared.value.get(int(size) // 8)
            if c is None:  # a length that the sample missed is one shard
                near = np.zeros((len(at), 1), np.int64)
            else:
                order = np.argsort(-(_unit(_matrix(column.iloc[at])) @ c.T), axis=1, kind="stable")
                near = np.sort(order[:, :overlap], axis=1)
            for i, row in zip(at, near):
                out[i] = [_shard(size, k) for k in row]
        return pd.Series(out)

    return folded.select("id", "copies", "vec", nearest("vec").alias("shards"))


def _prune(x: np.ndarray, params: GraphParams) -> list[np.ndarray]:
    """Robust pruning of each row's nearest and some random candidates, with reverse edges."""
    m = len(x)
    if m == 1:
        return [np.zeros(0, np.int64)]
    dist = np.maximum(0.0, 2.0 - 2.0 * (x @ x.T))
    np.fill_diagonal(dist, np.inf)
    rng = np.random.default_rng(params.seed)
    k = min(params.near, m - 1)
    near = np.argpartition(dist, k - 1, axis=1)[:, :k]
    edges = []
    for i in range(m):
        pool = np.unique(np.concatenate([near[i], rng.integers(0, m, params.far)]))
        pool = pool[pool != i]
        pool = pool[np.argsort(dist[i, pool], kind="stable")]
        kept = []
        while len(pool) and len(kept) < params.degree:
            best = pool[0]
            kept.append(best)
            pool = pool[1:]
            pool = pool[params.alpha * dist[best, pool] > dist[i, pool]]
        edges.append(kept)
    both: list[set[int]] = [set(map(int, e)) for e in edges]
    for i, own in enumerate(edges):
        for j in own:
            both[int(j)].add(i)
    _join_up(both, int(np.argmin(np.where(np.isinf(dist), 0, dist).sum(axis=1))))
    return [np.array(sorted(s), np.int64) for s in both]


def _join_up(both: list[set[int]], medoid: int) -> None:
    """Give the medoid an edge into each part that it doesn't reach."""
    seen, stack, rest = {medoid}, [medoid], iter(range(len(both)))
    while True:
        while stack:
            for j in both[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        missing = next((i for i in rest if i not in seen), None)
        if missing is None:
            return
        both[medoid].add(missing)
        both[missing].add(medoid)
        seen.add(missing)
        stack.append(missing)


def _lists(block: pd.DataFrame, params: GraphParams) -> pd.DataFrame:
    block = block.sort_values("id", kind="stable")
    ids = block["id"].to_numpy()
    return pd.DataFrame({"id": ids, "near": [ids[e].tolist() for e in _prune(_unit(_matrix(block["vec"])), params)]})


def _greedy(x: np.ndarray, table: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all queries side by side: the beam of each, and what it has seen.

    ``table`` holds neighbour lists padded with len(x), a row that nothing is near to."""
    n, m = len(q), len(x)
    padded = np.vstack([x, np.zeros((1, x.shape[1]))])
    seen = np.zeros((n, m + 1), bool)
    seen[:, m] = seen[:, start] = True
    ids = np.full((n, beam), m)
    near = np.full((n, beam), -np.inf)
    ids[:, 0], near[:, 0] = start, q @ x[start]
    open_ = np.zeros((n, beam), bool)
    open_[:, 0] = True
    active = np.arange(n)
    while len(active):
        best = np.argmax(np.where(open_[active], near[active], -np.inf), axis=1)
        open_[active, best] = False
        step = table[ids[active, best]]
        fresh = ~seen[active[:, None], step]
        step = np.where(fresh, step, m)
        seen[active[:, None], step] = True
        score = np.where(step < m, np.einsum("ij,ikj->ik", q[active], padded[step]), -np.inf)
        all_ids, all_near = np.hstack([ids[active], step]), np.hstack([near[active], score])
        all_open = np.hstack([open_[active], step < m])
        top = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        rows = np.arange(len(active))[:, None]
        ids[active], near[active], open_[active] = all_ids[rows, top], all_near[rows, top], all_open[rows, top]
        active = active[open_[active].any(axis=1)]
    return ids, seen


def _compared(x: np.ndarray, q: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, rows of ``x`` within range) of each query that has any, by comparing all."""
    inside = q @ x.T >= least
    for i in np.flatnonzero(inside.any(axis=1)):
        yield int(i), np.flatnonzero(inside[i])


def _walked(x: np.ndarray, ids: np.ndarray, near: pd.Series, q: np.ndarray, params: GraphParams) -> Iterator[tuple[int, np.ndarray]]:
    """(query, rows of ``x`` within range) of each query that has any, along the graph."""
    place = {v: i for i, v in enumerate(ids.tolist())}
    lists = [[place[j] for j in own.tolist() if j in place] for own in near]
    medoid = int(np.argmax(x @ x.sum(axis=0)))
    table = np.full((len(x) + 1, max(1, max(map(len, lists)))), len(x))
    for i, own in enumerate(lists):
        table[i, : len(own)] = own
    beam, seen = _greedy(x, table, medoid, q, params.beam)
    least = params.cosine
    for i in range(len(q)):
        found = beam[i][beam[i] < len(x)]
        found = found[x[found] @ q[i] >= least]
        if not len(found):
            continue
        known = seen[i]
        fresh = np.flatnonzero(known[:-1])  # the beam, and what fell out of it within range
        fresh = fresh[x[fresh] @ q[i] >= least]
        inside = [fresh]
        while len(fresh):
            step = np.unique(table[fresh])
            step = step[(step < len(x)) & ~known[step]]
            known[step] = True
            fresh = step[x[step] @ q[i] >= least]
            inside.append(fresh)
        yield i, np.concatenate(inside)


def _search(block: pd.DataFrame, params: GraphParams, dense: frozenset[int] | None) -> pd.DataFrame:
    """Search one block of a shard with some of the shard's vectors; compare them all in
    a shard of ``dense``, or in any if that is None.

    Returns (id, links, root) rows: how many vectors a query is linked with here, and
    for every vector that has a link here the smallest that it hangs together with."""
    shard = int(block["shard"].iloc[0])
    index = block[block["near"].notna()].sort_values("id", kind="stable").reset_index(drop=True)
    queries = block[block["near"].isna()].sort_values("id", kind="stable").reset_index(drop=True)
    none = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
    if not len(index) or not len(queries):
        return none
    ids, q_ids = index["id"].to_numpy(), queries["id"].to_numpy()
    x, q = _unit(_matrix(index["vec"])), _unit(_matrix(queries["vec"]))
    names = {p: n for n, p in enumerate(dict.fromkeys(tuple(v.tolist()) for v in index["shards"]))}
    pattern = np.array([names[tuple(v.tolist())] for v in index["shards"]])
    whole = dense is None or shard in dense
    hits = _compared(x, q, params.cosine) if whole else _walked(x, ids, index["near"], q, params)
    copies, counted = index["copies"].to_numpy(), {}
    links, left, right = np.zeros(len(q), np.int64), [], []
    for i, hit in hits:
        mine = tuple(queries["shards"].iloc[i].tolist())
        if mine not in counted:
            counted[mine] = np.array([min({*mine} & {*p}) == shard for p in names], bool)
        hit = hit[counted[mine][pattern[hit]] & (ids[hit] != q_ids[i])]
        links[i] = copies[hit].sum()
        left.append(np.full(len(hit), q_ids[i]))
        right.append(ids[hit])
    if not left:
        return none
    a, b = np.concatenate(left), np.concatenate(right)
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    rows = pd.DataFrame({"id": nodes, "links": 0, "root": nodes[root]})
    counted = pd.DataFrame({"id": q_ids, "links": links, "root": q_ids})
    return pd.concat([rows, counted[counted["links"] > 0]])


def _searcher(params: GraphParams, dense: frozenset[int] | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda block: _search(block, params, dense)


def _audit(folded: DataFrame, counts: DataFrame, params: GraphParams) -> float:
    """Mean recall of the links of some classes, against brute force over all classes.

    The audited vectors are a stated number chosen by a hash, sent to all tasks;
    those that brute force finds no link for don't count."""
    place = F.xxhash64("h1", F.lit(params.seed + 1))
    some = folded.select("id", "vec", place.alias("p")).orderBy("p", "id").limit(16 * params.audit).collect()
    if not some:
        return 1.0
    shared = folded.sparkSession.sparkContext.broadcast([(r["id"], bytes(r["vec"])) for r in some])
    least = params.cosine

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["vec"].map(len).to_numpy()
            for size in np.unique(lengths):
                own = batch[lengths == size]
                x, ids, copies = _unit(_matrix(own["vec"])), own["id"].to_numpy(), own["copies"].to_numpy()
                asked = [r for r in shared.value if len(r[1]) == size]
                for begin in range(0, len(asked), 256):
                    part = asked[begin : begin + 256]
                    names = np.array([i for i, _ in part])
                    hit = _unit(_matrix(pd.Series([v for _, v in part]))) @ x.T >= least
                    truth = (hit & (names[:, None] != ids[None, :])) @ copies
                    yield pd.DataFrame({"id": names, "truth": truth})

    truth = folded.select("id", "copies", "vec").mapInPandas(brute, "id long, truth long").groupBy("id").agg(F.sum("truth").alias("truth"))
    share = F.least(F.coalesce("links", F.lit(0)), F.col("truth")) / F.col("truth")
    mean = truth.where("truth > 0").join(counts, "id", "left").agg(F.avg(share)).first()[0]
    return 1.0 if mean is None else mean


def _found(folded: DataFrame, near: dict[int, np.ndarray], dense: frozenset[int] | None, params: GraphParams, scratch: Scratch) -> DataFrame:
    """(id, links, root) rows of all blocks of the shards around ``near``."""
    members = scratch.save(_members(folded, near, params), "members")
    in_shard = members.select("id", "copies", "vec", "shards", F.explode("shards").alias("shard"))
    sizes = in_shard.groupBy("shard").agg(F.ceil(F.count("*") / params.shard).cast("int").alias("blocks"))
    in_shard = in_shard.join(F.broadcast(scratch.save(sizes, "shards")), "shard")  # at most the centres of each length
    in_shard = in_shard.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    in_shard = scratch.save(in_shard, "dealt")
    built = in_shard.select("shard", "block", "id", "vec").groupBy("shard", "block").applyInPandas(lambda b: _lists(b, params), "id long, near array<long>")
    flat = built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # one list a shard of the vector
    flat = scratch.save(flat, "adjacency")
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    columns = ["shard", "block", "chunk", "id", "copies", "vec", "shards", "near"]
    nodes = in_shard.join(flat, "id").withColumn("chunk", every).select(columns)
    asking = in_shard.withColumn("chunk", F.col("block")).withColumn("block", every).withColumn("near", F.lit(None).cast("array<long>")).select(columns)
    groups = nodes.union(asking).groupBy("shard", "block", "chunk")
    return scratch.save(groups.applyInPandas(_searcher(params, dense), "id long, links long, root long"), "found")

def classes(vectors: DataFrame, params: GraphParams = GraphParams()) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of ``vectors`` (vec_id, embedding).

    Null, empty and zero vectors and those with null or non-finite components link
    with nothing, nor do vectors of different lengths.  Rows that repeat a vector are
    linked with each other.  A row without a vec_id stays alone, with null component.
    """
    scratch = Scratch(vectors.sparkSession, "graph")
    rows, folded = _folded(vectors, scratch)
    near, dense = centres(folded, params)
    while True:
        found = _found(folded, near, dense, params, scratch)
        counts = scratch.save(found.groupBy("id").agg(F.sum("links").alias("links")), "counts")
        recall = _audit(folded, counts, params)
        if recall >= params.recall:
            break
        if dense is None:
            raise RuntimeError(f"recall {recall:.3f} after all were compared")
        params = replace(params, beam=2 * params.beam, overlap=2 * params.overlap)
        if params.overlap >= max(map(len, near.values())):  # all would share a shard
            near, dense = {d: c[:1] for d, c in near.items()}, None
    known = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    named = folded.select("h1", "h2", "id", "copies").join(counts, "id", "left").join(known, F.col("id") == F.col("node"), "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("__links"), F.coalesce("component", "id").alias("__component"))
    out = rows.join(scratch.save(named, "named"), ["h1", "h2"], "left")
    alone = F.col("vec").isNull() | F.col("vec_id").isNull()
    return out.select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.col("__links")).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("__component")).alias("component_id"),
    )
