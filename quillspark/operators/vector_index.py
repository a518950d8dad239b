"""Approximate nearest vectors: an inverted file with product-quantised codes, kept as a table.

Unit vectors are dealt into cells by their nearest coarse centre and the residual is coded,
one byte for each run of components.  The table is partitioned by cell, so a search reads
the probed cells alone, and first only ids and codes.  The best codes of each question are
compared again with whole vectors, so scores are exact and only membership is approximate.

Centres and codebooks are fitted on a bounded sample; every vector is indexed.  How many
cells a question must probe depends on the data, so it is measured: the exact nearest of
some indexed vectors are looked up, and the probes that reach nearly all of them are kept
with the index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.operators.retrieval import MOST_QUERIES, best_rows, dense_track, top_k
from quillspark.scratch import Scratch


@dataclass(frozen=True)
class IndexParams:
    """``cells``: coarse centres, 0 for the root of the number of rows, ``most_cells`` at most.
    ``sample``: vectors that centres and codebooks are fitted on, at most. ``runs``: bytes of a code.
    ``file_rows``: rows of one file of a cell, about; a larger cell is written by several tasks.
    ``audit`` vectors are asked for their ``nearest``, and ``reach`` of these must lie in the probed cells."""

    cells: int = 0
    most_cells: int = 4_096
    sample: int = 50_000
    runs: int = 16
    file_rows: int = 1_000_000
    audit: int = 100
    nearest: int = 10
    reach: float = 0.98
    seed: int = 5


def unit(v: Column) -> Column:
    """``v`` in double precision, scaled to length one; null for null, zero and non-finite vectors."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    good = (norm > 0) & (norm < float("inf"))  # a NaN is above all numbers
    return F.when(good, F.transform(d, lambda x: x / norm))


class _Codec:
    """Coarse centres and one codebook for each run of components."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        self.cuts = np.cumsum([0, *(b.shape[1] for b in books)])
        self.half = 0.5 * (centres**2).sum(axis=1)

    def cells(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The ``n`` nearest cells of each row, nearest first."""
        far = self.half - x @ self.centres.T
        near = np.argpartition(far, min(n, far.shape[1]) - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)

    def codes(self, residual: np.ndarray) -> np.ndarray:
        out = np.zeros((len(residual), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            out[:, m] = np.argmin(0.5 * (book**2).sum(axis=1) - part @ book.T, axis=1)
        return out

    def table(self, query: np.ndarray) -> np.ndarray:
        """Inner product of a query with every entry of every codebook."""
        return np.array([np.pad(book @ query[self.cuts[m] : self.cuts[m + 1]], (0, 256 - len(book))) for m, book in enumerate(self.books)])


def _lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """``k`` centres of the rows of one codebook's sample."""
    rng = np.random.default_rng(seed)
    different = np.unique(x, axis=0)
    if len(different) <= k:
        return different
    c = different[np.sort(rng.choice(len(different), k, replace=False))]
    for _ in range(rounds):
        near = np.argmin(0.5 * (c**2).sum(axis=1) - x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, np.stack([np.bincount(near, weights=col, minlength=k) for col in x.T], 1) / np.maximum(n, 1)[:, None], c)
    return c


def _fit(sample: DataFrame, cells: int, p: IndexParams) -> _Codec:
    """Centres by distributed k-means; codebooks side by side, one group each, on residuals of the sample."""
    spark = sample.sparkSession
    model = KMeans(k=max(2, cells), seed=p.seed, maxIter=12, featuresCol="v", predictionCol="cell").fit(sample.select(array_to_vector("unit").alias("v")))
    centres = np.array(model.clusterCenters())[: max(1, cells)] if cells > 1 else np.array(model.clusterCenters()).mean(axis=0, keepdims=True)
    coarse = spark.sparkContext.broadcast(_Codec(centres, []))
    cuts = np.linspace(0, centres.shape[1], min(p.runs, centres.shape[1]) + 1).round().astype(int)

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["unit"].to_numpy())
            x = x - coarse.value.centres[coarse.value.cells(x)[:, 0]]
            for m in range(len(cuts) - 1):
                yield pd.DataFrame({"m": m, "part": list(x[:, cuts[m] : cuts[m + 1]])})

    def book(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["part"].to_numpy())
        return pd.DataFrame({"m": key[0], "centre": list(_lloyd(x[np.lexsort(x.T)], 256, p.seed))})

    rows = sample.select("unit").mapInPandas(split, "m int, part array<double>").groupBy("m").applyInPandas(book, "m int, centre array<double>").collect()
    books = [np.array([r["centre"] for r in rows if r["m"] == m]) for m in range(len(cuts) - 1)]
    return _Codec(centres, books)


def build(vectors: DataFrame, path: str, params: IndexParams = IndexParams()) -> None:
    """Write the index of ``vectors`` (id, vector) to ``path``, in place of what is there.

    Null, zero and non-finite vectors, and those whose length is not the commonest, are
    left out: nothing is near them. Rows alike are each indexed."""
    with Scratch(vectors.sparkSession, "vectors") as scratch:
        _build(vectors, path, params, scratch)


def _build(vectors: DataFrame, path: str, p: IndexParams, scratch: Scratch) -> None:
    spark = vectors.sparkSession
    rows = vectors.select("id", F.col("vector").cast("array<float>").alias("vector"), unit(F.col("vector")).alias("unit")).where("unit is not null")
    rows = scratch.save(rows, "unit")
    sizes = rows.groupBy(F.size("unit").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    rows = rows.where(F.size("unit") == (sizes["size"] if sizes else -1))
    n = sizes["n"] if sizes else 0
    place = F.pmod(F.xxhash64("unit", "id", F.lit(p.seed)), F.lit(1 << 30))
    sample = scratch.save(rows.where(place <= int((1 << 30) * min(1.0, p.sample / max(1, n)))).select("unit").limit(2 * p.sample), "sample")
    cells = p.cells or max(1, min(p.most_cells, int(n**0.5)))
    codec = _fit(sample, min(cells, max(1, sample.distinct().count())), p) if n else _Codec(np.zeros((1, 1)), [np.zeros((1, 1))])
    shared = spark.sparkContext.broadcast(codec)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["unit"].to_numpy())
            cell = shared.value.cells(x)[:, 0]
            yield frame[["id", "vector"]].assign(code=[c.tobytes() for c in shared.value.codes(x - shared.value.centres[cell])], cell=cell.astype(np.int32))

    kind = dict(rows.dtypes)["id"]
    coded = scratch.save(rows.mapInPandas(encode, f"id {kind}, vector array<float>, code binary, cell int"), "coded")
    spread = coded.groupBy("cell").agg(F.ceil(F.count("*") / p.file_rows).alias("files"))  # ``cells`` rows
    dealt = coded.join(F.broadcast(spread), "cell").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
    dealt.repartition("cell", "file").sortWithinPartitions("cell", "id").select("id", "code", "vector", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    books = [json.dumps(b.tolist()) for b in codec.books]
    probes = _probes(rows, coded, codec, p) if n else 1
    row = (json.dumps(codec.centres.tolist()), books, probes, kind, json.dumps(asdict(p)))
    spark.createDataFrame([row], "centres string, books array<string>, probes int, id_type string, params string").coalesce(1).write.mode("overwrite").parquet(f"{path}/codec")


def _probes(rows: DataFrame, coded: DataFrame, codec: _Codec, p: IndexParams) -> int:
    """Cells to probe so that ``reach`` of the exact nearest of some vectors lie in them."""
    asked = rows.orderBy(F.xxhash64("unit", F.lit(p.seed + 1)), "id").limit(p.audit).select(F.col("id").alias("query_id"), F.col("unit").alias("query_vector"))
    asked = asked.collect()  # ``audit`` rows
    questions = rows.sparkSession.createDataFrame([(i, r["query_vector"]) for i, r in enumerate(asked)], "query_id int, query_vector array<double>")
    near = dense_track(questions, rows.select("id", "vector"), p.nearest)
    places = coded.select("id", "cell").join(F.broadcast(near.select("id", "query_id")), "id").collect()
    order = np.argsort(codec.cells(np.array([r["query_vector"] for r in asked]), len(codec.centres)), axis=1)
    ranks = sorted(int(order[r["query_id"], r["cell"]]) for r in places)
    return ranks[min(len(ranks) - 1, int(np.ceil(p.reach * len(ranks))) - 1)] + 1 if ranks else 1


def _codec(spark: SparkSession, path: str) -> tuple[_Codec, int]:
    """The codec and the number of cells to probe."""
    row = spark.read.parquet(f"{path}/codec").first()
    return _Codec(np.array(json.loads(row["centres"])), [np.array(json.loads(b)) for b in row["books"]]), row["probes"]


def probed(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    """The rows of some cells; other folders are not read."""
    kind = spark.read.parquet(f"{path}/codec").first()["id_type"]
    table = spark.read.schema(f"id {kind}, code binary, vector array<float>, cell int").parquet(f"{path}/cells")
    return table.where(F.col("cell").isin([int(c) for c in cells]))


def search(queries: DataFrame, path: str, k: int, probes: int | None = None, refine: int = 20) -> DataFrame:
    """(query_id, id, score, rank) of about the ``k`` nearest to each of ``queries`` (query_id, query_vector).

    Each question looks into its ``probes`` nearest cells (those that the index has measured), and its best ``refine`` times ``k`` codes
    are compared as vectors: cosines above 0, rounded, ties to the smaller id. The number
    of questions is checked, so what is sent to tasks is bounded."""
    spark = queries.sparkSession
    asked = queries.select("query_id", unit(F.col("query_vector")).alias("v")).where("v is not null").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"a batch holds {MOST_QUERIES} queries at most")
    codec, measured = _codec(spark, path)
    asked = [(r["query_id"], np.array(r["v"])) for r in asked if len(r["v"]) == codec.centres.shape[1]]
    near = codec.cells(np.stack([v for _, v in asked]), min(probes or measured, len(codec.centres))) if asked else np.zeros((0, 1), int)
    by_cell: dict[int, list[int]] = {}
    for q, own in enumerate(near):
        for c in own:
            by_cell.setdefault(int(c), []).append(q)
    shared = spark.sparkContext.broadcast((codec, asked, by_cell, k * refine))

    def rough(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, asked, by_cell, most = shared.value
        tables: dict[int, np.ndarray] = {}
        for frame in frames:
            found = []
            for cell, part in frame.groupby("cell", sort=False):
                code = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1).astype(np.int64)
                order = part["id"].rank(method="first").to_numpy()
                for q in by_cell[cell]:
                    if q not in tables:
                        tables[q] = codec.table(asked[q][1])
                    score = codec.centres[cell] @ asked[q][1] + tables[q][np.arange(code.shape[1]), code].sum(axis=1)
                    good = best_rows(score + 4.0, order, most)  # estimates may be below 0
                    found.append(pd.DataFrame({"q": q, "cell": cell, "id": part["id"].to_numpy()[good], "rough": score[good]}))
            if found:
                yield pd.concat(found)

    table = probed(spark, path, sorted(by_cell))
    kind = dict(table.dtypes)["id"]
    candidates = table.select("id", "code", "cell").mapInPandas(rough, f"q int, cell int, id {kind}, rough double")
    candidates = Scratch(spark, "candidates").save(top_k(candidates, k * refine, ["q"], [F.desc("rough"), F.asc("id")]).select("q", "cell", "id"), "rough")

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = shared.value[1]
        for frame in frames:
            x = np.stack(frame["vector"].to_numpy()).astype(np.float64)
            q = np.stack([asked[i][1] for i in frame["q"]])
            score = np.round((x * q).sum(axis=1) / np.linalg.norm(x, axis=1), 6)
            yield pd.DataFrame({"query_id": [asked[i][0] for i in frame["q"]], "id": frame["id"], "score": score})

    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), table.schema["id"], StructField("score", DoubleType())])
    # ``k * refine`` rows a question at most; an id that stands in the table twice is compared twice
    scored = table.select("cell", "id", "vector").join(F.broadcast(candidates.distinct()), ["cell", "id"]).select("q", "id", "vector").mapInPandas(exact, schema)
    return top_k(scored.where("score > 0"), k, ["query_id"], [F.desc("score"), F.asc("id")])


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Part of the exact hits that were found; 1 without any."""
    row = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r")).first()
    return 1.0 if row["r"] is None else row["r"]
