"""Nearest neighbours by additive quantisation.

A vector is coded as the sum of one codeword from each of ``books`` full-dimensional codebooks.
Codebooks are fitted one after another on residuals of a bounded sample; encoding keeps a beam of partial
sums. The largest inner product needs no norm; the squared norm of each coded vector is stored
beside its codes all the same, for Euclidean nearness. A query's inner products with all codewords
form its lookup table; the sum of a row's table entries is its approximate nearness. The best rows of each
block are reranked with the original vectors in double precision.

Equal vectors are searched once: a class of equal vectors keeps its ``k + 1`` smallest ids, which is all
that a list of k can hold of it. The blocks of queries meet the blocks of rows pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildtrail.llm.session import checkpointed
from buildtrail.ship import ship

BEAM, PASSES = 4, 8


class Codebooks:
    """Additive codebooks (books, words, dim) with what encoding and scoring need of them."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)
        self.norms = (self.books**2).sum(2)

    @cached_property
    def cross(self) -> np.ndarray:
        """Inner products between codewords, bounded by (books x words)^2; only encoding asks for them."""
        flat = self.books.reshape(-1, self.books.shape[2])
        return flat @ flat.T

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row, by beam search over partial sums, and the squared norm of the sum."""
        m, words, _ = self.books.shape
        n = len(x)
        dots = x.astype(np.float32) @ self.books.reshape(m * words, -1).T
        cost = np.zeros((n, 1), np.float32)  # |sum|^2 - 2 <x, sum>
        codes = np.zeros((n, 1, 0), np.int64)
        for b in range(m):
            step = (self.norms[b] - 2 * dots[:, b * words : (b + 1) * words])[:, None, :] + cost[:, :, None]
            for a in range(b):
                step = step + 2 * self.cross[codes[:, :, a] + a * words, b * words : (b + 1) * words]
            wide = step.reshape(n, -1)
            keep = min(beam, wide.shape[1])
            best = np.argpartition(wide, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(wide, best, 1)
            parent, word = best // words, best % words
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], 2)
        pick = cost.argmin(1)
        rows = np.arange(n)
        codes, cost = codes[rows, pick], cost[rows, pick]
        dot = np.take_along_axis(dots.reshape(n, m, words), codes[:, :, None], 2)[:, :, 0].sum(1)
        return codes.astype(np.uint8), cost + 2 * dot

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(books, words, queries): inner products of all codewords with each query."""
        m, words, _ = self.books.shape
        return (self.books.reshape(m * words, -1) @ queries.astype(np.float32).T).reshape(m, words, -1)


def fit(sample: np.ndarray, books: int, words: int, seed: int = 5) -> Codebooks:
    """Residual k-means, one codebook after another."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32).copy()
    out = []
    words = max(1, min(words, len(rest)))
    for _ in range(books):
        centres = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(PASSES):
            near = ((centres**2).sum(1) - 2 * (rest @ centres.T)).argmin(1)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(centres)
            np.add.at(total, near, rest)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        near = ((centres**2).sum(1) - 2 * (rest @ centres.T)).argmin(1)
        rest -= centres[near]
        out.append(centres)
    return Codebooks(np.array(out))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>): rows with an id, a vector without null or non-finite components, and not zero.

    Vectors of another length than the most common one (the greater length on ties) take no part either.
    """
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(ok)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return rows.join(F.broadcast(width.select("n")), F.size("v") == F.col("n")).drop("n")


def search(vectors: DataFrame, query_filter: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", books: int = 16, words: int = 256, sample: int = 8192, block: int = 8192, rerank: int = 256) -> DataFrame:
    """The k nearest other rows of each row that query_filter (over ``id``) names: query_id, rank, id_col, score.

    Nearness is the inner product in double precision, ties go to smaller ids. All rows are indexed; ``sample``
    bounds the rows that codebooks are fitted on, in hash order. ``rerank`` rows of each block of ``block`` rows are
    reranked for each query. Rows that ``usable`` leaves out take no part; a repeated id with one vector counts once.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col).distinct()
    picked = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).select("v").toPandas()["v"]  # at most ``sample`` rows
    if not len(picked):
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    shared = spark.sparkContext.broadcast(fit(np.array(picked.tolist(), np.float64), books, words).books)

    vector_key = F.xxhash64("v")
    first = Window.partitionBy("h", "v").orderBy("id")
    nth = rows.withColumn("h", vector_key).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    classes = nth.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books_ = Codebooks(shared.value)
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                codes, norm = books_.encode(x)
                yield pa.RecordBatch.from_pydict({"h": part.column(0), "vector": pa.array([r.tobytes() for r in x], pa.binary()), "ids": part.column(2), "codes": pa.array([r.tobytes() for r in codes], pa.binary()), "norm": pa.array(norm, pa.float32())})

    indexed = checkpointed(classes.select("h", "v", "ids").mapInArrow(encode, "h long, vector binary, ids array<long>, codes binary, norm float"))
    n_blocks = max(1, -(-indexed.count() // block))
    queries = rows.filter(query_filter)
    asked = checkpointed(queries.groupBy("v").agg(F.min("id").alias("q")))
    q_blocks = max(1, -(-asked.count() // 512))
    left = indexed.withColumn("block", F.pmod("h", F.lit(n_blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(q_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        empty = {"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not ours.num_rows or not theirs.num_rows:
            return pa.table(empty)
        books_ = Codebooks(shared.value)
        codes = np.frombuffer(b"".join(ours.column("codes").to_pylist()), np.uint8).reshape(ours.num_rows, -1).astype(np.int64)
        x = np.frombuffer(b"".join(ours.column("vector").to_pylist()), np.float64).reshape(ours.num_rows, -1)
        ids = ours.column("ids").to_pylist()
        smallest = np.array([i[0] for i in ids])
        names, q = theirs.column("q").to_pylist(), np.array(theirs.column("v").to_pylist(), np.float64)
        out_q, out_id, out_s = [], [], []
        order = np.argsort(smallest, kind="stable")
        for s in range(0, len(q), 32):
            some = q[s : s + 32]
            tables = books_.tables(some)
            near = np.zeros((len(x), len(some)), np.float32)
            for b in range(codes.shape[1]):
                near += tables[b][codes[:, b]]
            for i in range(len(some)):
                take = order[np.argsort(-near[order, i], kind="stable")[:rerank]] if len(x) > rerank else order
                exact = x[take] @ some[i]
                best = take[np.lexsort((smallest[take], -exact))[: k + 1]]
                for r, score in zip(best, x[best] @ some[i], strict=True):
                    out_q.extend([names[s + i]] * len(ids[r]))
                    out_id.extend(ids[r])
                    out_s.extend([score] * len(ids[r]))
        return pa.table({"q": pa.array(out_q, pa.int64()), "id": pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "q long, id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    each = queries.join(asked, "v").select(F.col("id").alias("query_id"), "q").distinct()
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    hits = each.join(found.select("q", "id", "score"), "q").filter("id <> query_id").withColumn("rank", F.row_number().over(place))
    return hits.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 20 = 0")
