"""Exact top-k inner products by dual-tree cover-tree search.

The upper level of the tree is a net of centres, chosen far apart from a bounded sample: every vector belongs to the
nearest centre's cell, and cells are cut into blocks of bounded size. Each query block first meets one block of its own
cell, which gives each of its queries a k-th score. A query block then meets only those data blocks whose ball may hold
a product as large as the worst of these scores. In each meeting a cover tree of the queries and one of the data are
searched together: a pair of nodes is pruned when the largest inner product that their covering radii allow is
below the worst k-th score of the query node's queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import bound_batches, sampled, stage

#: Rows that centres are chosen from (about; by a hash of the id), and centres, at most.
SAMPLE, MOST_CELLS = 4096, 256
#: Data blocks whose balls are held against one query block at a time.
CHUNK = 1 << 15
DATA_BLOCK, QUERY_BLOCK = 8192, 2048
LEAF_DATA, LEAF_QUERIES = 256, 64
#: Relative slack of bounds against rounding.
SLACK = 1e-9


@dataclass
class Node:
    """A ball: centre, radius that covers all its points, their row numbers, children."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray, leaf: int) -> Node:
    """Cover tree of ``points[rows]``: children's centres are points at least half the node's radius apart, and each
    point belongs to the nearest of them, so radii about halve from level to level. Equal points end in one leaf."""
    centre = points[rows[0]]
    dist = np.sqrt(((points[rows] - centre) ** 2).sum(1))
    node = Node(centre, float(dist.max()), rows)
    if len(rows) <= leaf or node.radius == 0:
        return node
    near, own = dist.copy(), np.zeros(len(rows), np.int64)
    centres = 1
    while centres < 32:
        far = int(near.argmax())
        if near[far] <= node.radius / 2:
            break
        d = np.sqrt(((points[rows] - points[rows[far]]) ** 2).sum(1))
        closer = d < near
        near[closer], own[closer] = d[closer], centres
        centres += 1
    node.children = [cover_tree(points, rows[own == c], leaf) for c in range(centres)]
    return node


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, prune: bool = True, least: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, data id, score) of each query's k best rows of ``data`` with another id; ties to the smaller id.

    ``least`` names a score for each query that k other rows are known to reach: rows below it are left out. Vectors hold
    integers. Products below 2**53 are exact in float64; larger ones are computed in 64-bit integers, and those that do not
    fit into these are refused."""
    n = len(queries)
    size = float(np.sqrt((queries**2).sum(1).max(initial=0)) * np.sqrt((data**2).sum(1).max(initial=0)))
    if size >= 2.0**63:
        raise ValueError("inner products do not fit into 64 bits")
    whole = size >= 2.0**53
    kind = np.int64 if whole else np.float64
    none = np.iinfo(np.int64).min if whole else -np.inf
    best = np.full((n, k), none, kind)
    floor = np.full(n, none, kind) if least is None else np.where(np.isnan(least), float(none), least).astype(kind)
    ids = np.full((n, k), np.iinfo(np.int64).max)
    left, right = queries.astype(kind), data.astype(kind)
    order = np.argsort(data_ids, kind="stable")
    data, right, data_ids = data[order], right[order], data_ids[order]

    def base(q: Node, p: Node) -> None:
        rows = q.rows
        s = left[rows] @ right[p.rows].T
        s[query_ids[rows][:, None] == data_ids[p.rows][None, :]] = none
        enough = np.maximum(best[rows, -1], floor[rows])[:, None]
        good = (s >= enough) & (s > none)
        for i in np.flatnonzero(good.any(1)):
            r, ok = rows[i], np.flatnonzero(good[i])
            score, name = np.append(best[r], s[i, ok]), np.append(ids[r], data_ids[p.rows[ok]])
            top = np.lexsort((name, -score if not whole else ~score))[:k]
            best[r], ids[r] = score[top], name[top]

    def bound(q: Node, p: Node) -> float:
        a, b = float(np.sqrt(q.centre @ q.centre)), float(np.sqrt(p.centre @ p.centre))
        x = float(q.centre @ p.centre) + q.radius * b + p.radius * a + q.radius * p.radius
        return x + SLACK * (a + q.radius) * (b + p.radius)

    def visit(q: Node, p: Node, most: float) -> None:
        if prune and most < float(np.maximum(best[q.rows, -1], floor[q.rows]).min()):
            return
        if not q.children and not p.children:
            base(q, p)
        elif p.children and (not q.children or p.radius >= q.radius):
            for most, i in sorted(((bound(q, c), i) for i, c in enumerate(p.children)), reverse=True):
                visit(q, p.children[i], most)
        else:
            for c in q.children:
                visit(c, p, bound(c, p))

    if n and len(data):
        q, p = cover_tree(queries, np.arange(n), LEAF_QUERIES), cover_tree(data, np.arange(len(data)), LEAF_DATA)
        visit(q, p, bound(q, p))
    return [(int(query_ids[i]), int(ids[i, j]), int(best[i, j])) for i in range(n) for j in range(k) if best[i, j] > none]


def _matrix(column: pd.Series) -> np.ndarray:
    width = max(map(len, column), default=0)
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def net(points: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the points, each the farthest from those before it."""
    if not len(points):
        return points
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(most, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _wide(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, max(0, width - vectors.shape[1]))))


def _celled(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds cell (the nearest centre) and dist (to it) to rows (vec_id, x, copies). Vectors and centres are continued with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pandas())
            width = max(x.shape[1], centres.shape[1])
            x, c = _wide(x, width), _wide(centres, width)
            cell, dist = np.zeros(len(x), np.int32), np.zeros(len(x))
            for a in range(0, len(x), 1024):
                near = ((x[a : a + 1024] ** 2).sum(1)[:, None] - 2 * x[a : a + 1024] @ c.T + (c**2).sum(1)).argmin(1)
                cell[a : a + 1024] = near
                dist[a : a + 1024] = np.sqrt(((x[a : a + 1024] - c[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)], [*batch.schema.names, "cell", "dist"])

    return rows.mapInArrow(run, "vec_id long, x array<double>, copies int, cell int, dist double")


def _blocked(rows: DataFrame, size: int, name: str, *by: str) -> DataFrame:
    """Adds the number of each row's block: cells are cut by a hash into blocks of about ``size`` rows."""
    per = sorted((r["cell"], -(-r["n"] // size)) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect())  # a row a cell
    first, table = 0, []
    for cell, n in per:
        table.append((cell, first, n))
        first += n
    starts = rows.sparkSession.createDataFrame(table, "cell int, first long, n long")
    part = F.col("first") + F.pmod(F.xxhash64(F.lit("block"), *by), F.col("n"))
    return rows.join(F.broadcast(starts), "cell").withColumn(name, part).drop("first", "n")


def _pairs(queries: DataFrame, data: DataFrame, centres: np.ndarray) -> DataFrame:
    """Blocks (qb, db) that must meet: the largest product that their balls allow is not below the worst k-th score of the
    query block (least; null: unknown)."""
    length, dots = np.sqrt((centres**2).sum(1)), centres @ centres.T
    d = data.groupBy("db").agg(F.first("cell").alias("dcell"), F.max("dist").alias("dr")).withColumn("chunk", F.floor(F.col("db") / CHUNK))
    d = d.groupBy("chunk").agg(F.collect_list(F.struct("db", "dcell", "dr")).alias("balls"))  # CHUNK of them at most
    q = queries.groupBy("qb").agg(F.first("cell").alias("qcell"), F.max("dist").alias("qr"), F.when(F.count("least") == F.count("*"), F.min("least")).alias("least"))
    chunks = d.count()
    both = q.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, chunks - 1)).cast("long")))).join(d, "chunk").select("qb", "qcell", "qr", "least", "balls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qb, cell, qr, least = (batch.column(c)[i].as_py() for c in range(4))
                balls = batch.column(4)[i].values
                db, dcell, dr = (balls.field(f).to_numpy(zero_copy_only=False) for f in ("db", "dcell", "dr"))
                most = dots[cell][dcell] + qr * length[dcell] + dr * length[cell] + qr * dr + SLACK * (length[cell] + qr) * (length[dcell] + dr)
                ok = db if least is None else db[most >= least]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ok), qb)), pa.array(ok)], ["qb", "db"])

    return both.mapInArrow(run, "qb long, db long")


def search(vectors: DataFrame, is_query: Callable, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows with the largest integer inner products of floor(scale * x) for each
    row of ``vectors`` (vec_id, embedding) whose id meets ``is_query``.

    Fewer rows if there are fewer candidates; ties go to the smaller vec_id. Rows with a null id or vector, or with a
    null or non-finite component, take no part; all rows with the query's id count as its own; an id that is
    repeated stands for one query (with its vector that sorts first), and its copies are candidates each. Shorter
    vectors are continued with zeros; an empty table gives no rows. Other columns are ignored. Scores are exact;
    products beyond 64 bits stop the job.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null").where(good)
    rows = rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("x"))
    # of equal rows no more than k can be among a query's best
    rows = stage(rows.groupBy("vec_id", "x").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies")), "vectors")
    wanted = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("x").alias("x"), F.lit(1).alias("copies"))
    cells = min(MOST_CELLS, max(1, -(-rows.count() // DATA_BLOCK)))
    # as few query blocks as their size allows, since each of them may need every data block; the first centres are a net, too
    fewer = min(cells, max(1, -(-wanted.count() // QUERY_BLOCK)))
    centres = net(_matrix(sampled(rows, SAMPLE, "vec_id", "x").limit(2 * SAMPLE).toPandas()["x"]), cells)
    if not len(centres):
        centres = np.zeros((1, 1))
    data = stage(_blocked(stage(_celled(rows, centres), "cells"), DATA_BLOCK, "db", "vec_id", "x"), "data")
    queries = stage(_blocked(stage(_celled(wanted, centres[:fewer]), "cells"), QUERY_BLOCK, "qb", "vec_id"), "queries")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        b = b.loc[b.index.repeat(b["copies"])]
        both = _matrix(pd.concat([a["x"], b["x"]], ignore_index=True))
        found = dual_search(both[: len(a)], a["vec_id"].to_numpy(), both[len(a) :], b["vec_id"].to_numpy(), k, least=a["least"].to_numpy(float))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    def met(queries: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        left, right = queries.join(pairs, "qb").select("qb", "db", "vec_id", "x", "least"), data.join(pairs, "db").select("qb", "db", "vec_id", "x", "copies")
        return stage(left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInPandas(meet, "query_id long, vec_id long, score long"), name)

    # each query block and one data block of its own cell
    near = queries.groupBy("qb").agg(F.first("cell").alias("cell")).join(data.groupBy("cell").agg(F.min("db").alias("lo"), F.max("db").alias("hi")), "cell")
    near = stage(near.select("qb", (F.col("lo") + F.pmod("qb", F.col("hi") - F.col("lo") + 1)).alias("db")), "near")
    first = met(queries.withColumn("least", F.lit(None).cast("double")), near, "first")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least")).withColumnRenamed("query_id", "vec_id")
    known = stage(queries.join(kth, "vec_id", "left"), "known")
    pairs = stage(_pairs(known, data, centres).join(near, ["qb", "db"], "left_anti"), "pairs")
    found = first.union(met(known, pairs, "rest"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
