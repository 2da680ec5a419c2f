"""Operator 8, approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, LongType, StructField, StructType

from . import common

#: Neighbours that the graph keeps for each vector.
DEGREE = 30
#: Neighbours from either side that a vector introduces to each other in one round.
INTRODUCED = 16
#: Rounds of neighbours of neighbours; it ends earlier when under DONE of all edges are new.
ROUNDS, DONE = 6, 0.02
#: The first graph: in so many random partitions of about LEAF vectors each, every vector's FIRST nearest.
TREES, LEAF, FIRST = 6, 800, 12
#: Vectors that a search holds for each query, and how many of them it follows in one hop, the nearest first.
BEAM, FOLLOWED = 224, 112
#: Rows from which the centre of the random partitions is taken.
SAMPLE = 4096

_EDGES = ArrayType(StructType([StructField("id", LongType()), StructField("nbr", LongType()), StructField("d", FloatType())]))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double), times: the rows that take part; equal rows are one, counted.

    Null vectors, zero vectors, those with null or non-finite components, and rows without an id take no part.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    v = vectors.where("vec_id is not null and embedding is not null").where(~bad & F.exists(x, lambda v: v != 0))
    return v.groupBy(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).agg(F.count("*").alias("times"))


def _packed(scale: float):
    """Floats after division by ``scale``: what the graph's distances are taken from."""

    @F.pandas_udf(BinaryType())
    def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([(np.asarray(x, np.float64) / scale).astype(np.float32).tobytes() for x in part])

    return packed


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), -1).astype(np.float64)


def _distances(x: np.ndarray) -> np.ndarray:
    """Squares of distances, from a centre among the vectors, in doubles: near copies stay apart."""
    x = x - x.mean(axis=0)
    norm = (x * x).sum(axis=1)
    return np.maximum(norm[:, None] + norm[None, :] - 2.0 * (x @ x.T), 0.0)


@F.pandas_udf(_EDGES)
def _nearest_in_leaf(leaves: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in leaves:
        out = []
        for leaf in part:
            ids = np.array([r["id"] for r in leaf])
            edges: list[dict] = []
            if len(ids) > 1:
                d = _distances(_matrix([r["vec"] for r in leaf]))
                np.fill_diagonal(d, np.inf)
                k = min(FIRST, len(ids) - 1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                edges = [{"id": int(ids[i]), "nbr": int(ids[j]), "d": float(d[i, j])} for i in range(len(ids)) for j in near[i]]
            out.append(edges)
        yield pd.Series(out)


@F.pandas_udf(_EDGES)
def _introduce(groups: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Pairs of a vector's neighbours, one of them new, that are nearer than the worst neighbour either has."""
    for part in groups:
        out = []
        for group in part:
            edges: list[dict] = []
            if len(group) > 1:
                ids = np.array([r["id"] for r in group])
                fresh = np.array([r["fresh"] for r in group], bool)
                worst = np.array([r["worst"] for r in group], np.float32)
                d = _distances(_matrix([r["vec"] for r in group]))
                good = (fresh[:, None] | fresh[None, :]) & (d < worst[:, None]) & (ids[:, None] != ids[None, :])
                edges = [{"id": int(ids[i]), "nbr": int(ids[j]), "d": float(d[i, j])} for i, j in zip(*np.nonzero(good), strict=True)]
            out.append(edges)
        yield pd.Series(out)


@F.pandas_udf(FloatType())
def _between(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series(((_matrix(list(a)) - _matrix(list(b))) ** 2).sum(axis=1) if len(a) else [], dtype="float32")


def _best(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each ``key``; Spark limits groups before it shuffles them."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__k") <= most).drop("__k")


def _first_graph(v: DataFrame, n: int, dim: int, centre: np.ndarray) -> DataFrame:
    """Edges inside the cells of TREES random partitions; cells that are too large are dealt by hash."""
    bits = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    rng = np.random.default_rng(42)
    planes = rng.standard_normal((TREES, max(bits, 1), dim)).astype(np.float32)

    @F.pandas_udf(ArrayType(LongType()))
    def cells(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = _matrix(list(part)) - centre if len(part) else np.zeros((0, dim))
            codes = [((x @ p.T > 0) @ (1 << np.arange(p.shape[0]))) if bits else np.zeros(len(x), np.int64) for p in planes]
            yield pd.Series(list(np.stack(codes, axis=1).astype(np.int64))) if len(part) else pd.Series([], dtype=object)

    dealt = v.select("id", "vec", F.posexplode(cells("vec")).alias("tree", "cell"))
    dealt = common.cut(dealt)
    sizes = dealt.groupBy("tree", "cell").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / (2 * LEAF)).cast("int")
    dealt = dealt.join(sizes, ["tree", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", "tree"), blocks))
    leaves = dealt.groupBy("tree", "cell", "block").agg(F.collect_list(F.struct("id", "vec")).alias("leaf"))
    edges = leaves.select(F.explode(_nearest_in_leaf("leaf")).alias("e")).select("e.*")
    edges = edges.groupBy("id", "nbr").agg(F.min("d").alias("d"))
    return _best(edges, "id", [F.col("d"), F.col("nbr")], DEGREE).withColumn("fresh", F.lit(True))


def graph(v: DataFrame, n: int, dim: int, centre: np.ndarray) -> DataFrame:
    """Edges (id, nbr, d, fresh) to about the DEGREE nearest vectors of each, by NN-descent (Dong et al. 2011).

    In each round every vector introduces its neighbours, from both sides and a bounded number of each,
    to each other; pairs that beat the worst neighbour of either become edges. A hub's callers are
    limited before the shuffle, by a hash that changes with the round.
    """
    g = common.cut(_first_graph(v, n, dim, centre))
    old: list[DataFrame] = []
    for turn in range(ROUNDS):
        salt = F.xxhash64("u", "w", F.lit(turn))
        out = g.select(F.col("id").alias("u"), F.col("nbr").alias("w"), "fresh")
        into = g.select(F.col("nbr").alias("u"), F.col("id").alias("w"), "fresh")
        met = _best(out, "u", [F.desc("fresh"), salt], INTRODUCED).unionByName(_best(into, "u", [F.desc("fresh"), salt], INTRODUCED))
        met = met.groupBy("u", "w").agg(F.max("fresh").alias("fresh"))
        worst = g.groupBy("id").agg(F.max("d").alias("d"), F.count("*").alias("k"))
        worst = worst.select(F.col("id").alias("w"), F.when(F.col("k") >= DEGREE, F.col("d")).otherwise(float("inf")).cast("float").alias("worst"))
        known = v.select(F.col("id").alias("w"), "vec").join(worst, "w", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf")).cast("float")))
        rows = met.join(known, "w").groupBy("u").agg(F.collect_list(F.struct(F.col("w").alias("id"), "fresh", "worst", "vec")).alias("group"))
        found = rows.select(F.explode(_introduce("group")).alias("e")).select("e.*")
        found = _best(found.groupBy("id", "nbr").agg(F.min("d").alias("d")), "id", [F.col("d"), F.col("nbr")], DEGREE)
        both = g.select("id", "nbr", "d", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True)))
        both = both.groupBy("id", "nbr").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
        nxt = common.cut(_best(both, "id", [F.col("d"), F.col("nbr")], DEGREE))
        common.forget(*old)
        old, g = [g], nxt
        edges, new = g.agg(F.count("*"), F.count_if("fresh")).first()
        if new < DONE * edges:
            break
    return g


def search(v: DataFrame, g: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, node): the BEAM nearest vectors that a greedy walk of the graph finds for each query (q, its own node).

    A walk starts at the query's own edges, both ways. Each hop follows the edges of the FOLLOWED nearest
    vectors of the beam that haven't been followed, measures what they lead to and keeps the nearest
    BEAM. It ends when all of the beam have been followed.
    """
    edges = common.cut(g.select("id", "nbr").unionByName(_best(g.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "d"), "id", [F.col("d"), F.col("nbr")], DEGREE).drop("d")).distinct())
    own = common.cut(queries.join(v, F.col("q") == F.col("id")).select("q", F.col("vec").alias("qvec")))
    beam = own.select("q", F.col("q").alias("node"), F.lit(0.0).cast("float").alias("d"), F.lit(False).alias("done"))
    old: list[DataFrame] = []
    while True:
        follow = _best(beam.where("not done"), "q", [F.col("d"), F.col("node")], FOLLOWED).select("q", "node")
        ahead = follow.join(edges, F.col("node") == F.col("id")).select("q", F.col("nbr").alias("node")).distinct()
        ahead = ahead.join(beam.select("q", "node"), ["q", "node"], "left_anti")
        ahead = ahead.join(v, F.col("node") == F.col("id")).join(own, "q")
        ahead = ahead.select("q", "node", _between("vec", "qvec").alias("d"), F.lit(False).alias("done"))
        walked = follow.select("q", "node", F.lit(True).alias("__walked"))
        both = beam.join(walked, ["q", "node"], "left").select("q", "node", "d", (F.col("done") | F.col("__walked").isNotNull()).alias("done"))
        nxt = common.cut(_best(both.unionByName(ahead), "q", [F.col("d"), F.col("node")], BEAM))
        common.forget(*old)
        old, beam = [nxt], nxt
        if beam.where("not done").isEmpty():
            break
    common.forget(edges, own)
    return beam.select("q", "node")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest vectors found for each row where ``is_query`` holds.

    Every usable row is a candidate for every other one of its length, also rows with one id; only
    vectors of the same length have a distance. Equal vectors are one vector of the graph. Of a group
    of copies only the k + 1 smallest ids can be among k nearest other rows, ties going to the smaller
    id, so only those are put back: nothing is lost, and a group of copies of any size costs k + 1 rows.
    A row that occurs twice is a query twice, each the other's candidate. Scores are Euclidean distances
    of the original vectors in double precision; the graph's own are of floats. See usable() for rows
    that take no part; queries among them have no rows. Empty tables give empty results.
    """
    u = common.cut(usable(vectors))
    sizes = sorted(r["n"] for r in u.select(F.size("embedding").alias("n")).distinct().collect())
    shape = StructType([StructField("query_id", LongType()), StructField("rank", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])
    out = None
    for dim in sizes:
        part = _nearest_of(u if len(sizes) == 1 else u.where(F.size("embedding") == dim), dim, is_query, k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], shape).withColumn("rank", F.col("rank").cast("int"))


def _nearest_of(u: DataFrame, dim: int, is_query: Column, k: int) -> DataFrame:
    reps = common.cut(u.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.max(F.abs(F.array_max(F.transform("embedding", lambda x: F.abs(x))))).alias("most")))
    # an id can stand for several vectors, so nodes of the graph have numbers of their own
    reps = common.cut(reps.select("embedding", "most", F.xxhash64("id", "embedding").alias("id")))
    members = u.join(reps.drop("most"), "embedding").select("vec_id", "id", "times")
    queries = members.where(is_query)
    copies = _best(members.select("id", "vec_id", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k + 1)).cast("int"))).alias("copy")), "id", [F.col("vec_id"), F.col("copy")], k + 1)
    n, scale = reps.agg(F.count("*"), F.max("most")).first()
    sample = np.array([r["embedding"] for r in reps.orderBy("id").limit(SAMPLE).select("embedding").collect()])
    centre = (sample / scale).mean(axis=0)
    v = common.cut(reps.select("id", _packed(scale)("embedding").alias("vec")))
    g = graph(v, n, dim, centre)
    found = common.cut(search(v, g, queries.select(F.col("id").alias("q")).distinct()))
    common.forget(g, v)
    near = queries.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn")).join(found, "q")
    # the query's own row is its copy of number 1
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("node") == F.col("q")) & (F.col("copy") == 1)
    near = near.join(copies.select(F.col("id").alias("node"), "vec_id", "copy"), "node").where(~own)
    vector = reps.select("id", "embedding")
    near = near.join(vector.select(F.col("id").alias("node"), F.col("embedding").alias("a")), "node")
    near = near.join(vector.select(F.col("id").alias("q"), F.col("embedding").alias("b")), "q")
    squares = F.zip_with("a", "b", lambda a, b: (a - b) * (a - b))
    score = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, y: s + y))
    near = near.select("query_id", "q", "turn", "vec_id", "copy", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "q", "turn").orderBy("score", "vec_id", "copy"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
