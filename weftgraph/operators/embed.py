"""Spectral embeddings and nearest nodes."""

from __future__ import annotations

import numpy as np
from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import KERNEL_EDGES, Graph
from weftgraph.plans.shared import materialize


def _normalised(graph: Graph) -> DataFrame:
    """(u, v, x): entries of the weighted adjacency over the roots of both strengths."""
    d = graph.degrees.select("node", F.when(F.col("strength") > 0, 1 / F.sqrt("strength")).otherwise(0.0).alias("r"))
    e = graph.both.join(d.withColumnsRenamed({"node": "u", "r": "ru"}), "u").join(d.withColumnsRenamed({"node": "v", "r": "rv"}), "v")
    return e.select("u", "v", (F.col("weight") * F.col("ru") * F.col("rv")).alias("x"))


def spectral_embedding(graph: Graph, dimensions: int = 8, seed: int = 42, sweeps: int = 12) -> DataFrame:
    """(node, embedding_1..k): U * Sigma of the truncated SVD of the normalised adjacency, k = min(dimensions, n - 1).

    Randomised subspace iteration (Halko et al. 2011): a sweep is a sparse product with a block of vectors. Up to a
    checked size it runs on arrays; beyond it as a distributed matrix. Each column's largest entry in size is positive.
    """
    n = graph.n
    if n < 2:
        return graph.degrees.select("node")
    k = max(1, min(dimensions, n - 1))
    names = [f"embedding_{i + 1}" for i in range(k)]
    if graph.m <= KERNEL_EDGES:
        g = graph.local("spectral_embedding")
        strength = np.bincount(np.concatenate([g.a, g.b]), weights=np.tile(g.weight, 2), minlength=n)
        root = np.where(strength > 0, 1 / np.sqrt(np.maximum(strength, 1e-300)), 0.0)
        x = g.weight * root[g.a] * root[g.b]
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, k + 10))))[0]
        for _ in range(sweeps):
            q = np.linalg.qr(g.multiply_columns(x, q))[0]
        small = q.T @ g.multiply_columns(x, q)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")[:k]
        u = (q @ vectors[:, order]) * np.abs(values[order])
        u *= np.where(u[np.abs(u).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
        return graph.table(**{c: u[:, i] for i, c in enumerate(names)}).orderBy("node")
    ids = materialize(graph.degrees.select("node").rdd.map(lambda r: r[0]).zipWithIndex().toDF("node string, id long"), "ids")
    e = _normalised(graph).join(ids.withColumnsRenamed({"node": "u", "id": "i"}), "u").join(ids.withColumnsRenamed({"node": "v", "id": "j"}), "v").select("i", "j", "x")
    matrix = CoordinateMatrix(e.rdd.map(lambda r: MatrixEntry(r[0], r[1], r[2])), n, n).toIndexedRowMatrix()
    svd = matrix.computeSVD(k, computeU=True)
    sigma = svd.s.toArray()
    u = svd.U.rows.map(lambda r: (r.index, [float(a * b) for a, b in zip(r.vector.toArray(), sigma, strict=True)])).toDF("id long, x array<double>")
    most = u.agg(*[F.max_by(F.col("x")[i], F.abs(F.col("x")[i])).alias(f"m{i}") for i in range(k)])
    signed = u.join(F.broadcast(most)).select("id", *[(F.col("x")[i] * F.when(F.col(f"m{i}") < 0, -1.0).otherwise(1.0)).alias(c) for i, c in enumerate(names)])
    return ids.join(signed, "id").select("node", *names).orderBy("node")


def embedding_with_communities(embedding: DataFrame, communities: DataFrame) -> DataFrame:
    """``embedding`` with the community of every node, null where it has none; both are keyed by node, so neither side is broadcast."""
    return embedding.join(communities.select("node", "community"), "node", "left")


def nearest_nodes(embedding: DataFrame, query: str, top_n: int = 5, id_col: str = "node", vector_col: str | None = None) -> DataFrame:
    """(node, similarity): cosine with every other row, the largest first. One row is broadcast, the rest is a scan."""
    parts = F.col(vector_col) if vector_col else F.array(*[c for c in embedding.columns if c.startswith("embedding_")])
    rows = embedding.select(F.col(id_col).alias("node"), F.transform(parts, lambda x: x.cast("double")).alias("x"))
    if rows.filter(F.col("node") == query).isEmpty():
        raise KeyError(query)
    one = rows.filter(F.col("node") == query).limit(1).select(F.col("x").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)
    x, q = F.col("x"), F.col("q")
    cosine = F.coalesce(F.try_divide(dot(x, q), F.sqrt(dot(x, x)) * F.sqrt(dot(q, q))), F.lit(0.0))
    return rows.filter(F.col("node") != query).join(F.broadcast(one)).select("node", cosine.alias("similarity")).orderBy(F.desc("similarity"), "node").limit(top_n)
