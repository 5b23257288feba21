"""The graph: a canonical edge table, and the tables every operator derives from it, made once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import GraphTooLarge
from weftgraph.operators.components import connected_components
from weftgraph.plans.shared import materialize

#: Edges up to which sequential kernels get the graph as arrays in a broadcast (about 24 bytes an edge and direction).
KERNEL_EDGES = 2_000_000


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, and ``otherwise`` where b is zero or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise))


@dataclass
class Graph:
    """Edges (src, dst, weight): simple, without loops; ``src < dst`` if undirected. ``group`` names a key column of many graphs.

    ``isolated`` holds nodes without edges, which only operators that remove edges make.
    """

    edges: DataFrame
    directed: bool = False
    group: str | None = None
    isolated: DataFrame | None = None
    _made: dict = field(default_factory=dict, repr=False)

    @property
    def keys(self) -> list[str]:
        return [self.group] if self.group else []

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def spark(self):
        return self.edges.sparkSession

    @property
    def arcs(self) -> DataFrame:
        """The edges as they were given, written once."""
        return self._once("arcs", lambda: materialize(self.edges, "edges"))

    @property
    def links(self) -> DataFrame:
        """Undirected edges with src < dst. Of two opposite arcs the one whose source comes later in code-point order gives the weight."""
        if not self.directed:
            return self.arcs
        pair = self.arcs.groupBy(*self.keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max_by("weight", "src").alias("weight"))
        return self._once("links", lambda: materialize(pair.select(*self.keys, F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), "links"))

    @property
    def both(self) -> DataFrame:
        """Each undirected edge seen from both ends: (u, v, weight)."""
        e = self.links
        return e.select(*self.keys, F.col("src").alias("u"), F.col("dst").alias("v"), "weight").unionByName(e.select(*self.keys, F.col("dst").alias("u"), F.col("src").alias("v"), "weight"))

    @property
    def degrees(self) -> DataFrame:
        """(node, degree, strength) of the undirected projection."""

        def make() -> DataFrame:
            d = self.both.groupBy(*self.keys, F.col("u").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
            if self.isolated is not None:
                alone = self.isolated.select(*self.keys, "node").join(d, [*self.keys, "node"], "left_anti").select(*self.keys, "node", F.lit(0).cast("long").alias("degree"), F.lit(0.0).alias("strength"))
                d = d.unionByName(alone)
            return materialize(d, "degrees")

        return self._once("degrees", make)

    @property
    def components(self) -> DataFrame:
        """(node, component): the smallest node of its component."""

        def make() -> DataFrame:
            if not self.group and self.fits:
                g = self.local()
                part = g.parts()
                first = np.full(part.max(initial=-1) + 1, g.n)
                np.minimum.at(first, part, np.arange(g.n))
                return self.table(component=[g.names[i] for i in first[part]])
            found = connected_components(self.links, group=self.group)
            return found if self.isolated is None else self.degrees.select(*self.keys, "node").join(found, [*self.keys, "node"], "left").select(*self.keys, "node", F.coalesce("component", "node").alias("component"))

        return self._once("components", make)

    @property
    def n(self) -> int:
        return self._once("n", lambda: self.degrees.count())

    @property
    def m(self) -> int:
        return self._once("m", lambda: self.links.count())

    @property
    def fits(self) -> bool:
        """Whether kernels on arrays may be used: the size is counted, not guessed."""
        return self.m <= KERNEL_EDGES

    def table(self, **columns) -> DataFrame:
        """One row a node from arrays in the local graph's order."""
        g = self.local()
        kinds = {np.dtype(float): "double", np.dtype(np.int64): "long"}
        schema = ", ".join(["node string", *[f"{c} {kinds.get(getattr(v, 'dtype', None), 'string')}" for c, v in columns.items()]])
        return self.spark.createDataFrame(pd.DataFrame({"node": g.names, **columns}), schema)

    def local(self, what: str = "this kernel") -> LocalGraph:
        """The undirected projection as arrays, for kernels that can't be joins; its size is checked first."""
        if self.m > KERNEL_EDGES:
            raise GraphTooLarge(f"{what} takes up to {KERNEL_EDGES} edges; this graph has {self.m}.")

        def make() -> LocalGraph:
            names = self.degrees.select("node").toArrow()["node"].combine_chunks()
            names = names.take(pc.sort_indices(names))
            e = self.links.select("src", "dst", "weight").toArrow()
            a, b = (pc.index_in(e[c], value_set=names).to_numpy().astype(np.int64) for c in ("src", "dst"))
            order = np.lexsort((b, a))
            return LocalGraph(names.to_pylist(), a[order], b[order], e["weight"].to_numpy().astype(float)[order])

        return self._once("local", make)

    def without_edges(self, gone: DataFrame) -> Graph:
        """The graph without the edges (src, dst) in ``gone``; its nodes stay."""
        return Graph(self.links.join(gone.select("src", "dst"), ["src", "dst"], "left_anti"), isolated=self.degrees.select("node"))


@dataclass
class LocalGraph:
    """Nodes in text order, edges as index pairs, and adjacency in compressed rows."""

    names: list[str]
    a: np.ndarray
    b: np.ndarray
    weight: np.ndarray

    def __post_init__(self) -> None:
        self.n = len(self.names)
        u, v = np.concatenate([self.a, self.b]), np.concatenate([self.b, self.a])
        edge = np.tile(np.arange(self.a.size), 2)
        order = np.lexsort((v, u))
        self.neighbours, self.edge = v[order], edge[order]
        self.start = np.searchsorted(u[order], np.arange(self.n + 1))

    def expand(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of ``nodes``, its neighbour, the edge) for all edges at ``nodes``."""
        counts = self.start[nodes + 1] - self.start[nodes]
        which = np.repeat(np.arange(nodes.size), counts)
        at = np.arange(which.size) - np.repeat(np.cumsum(counts) - counts, counts) + self.start[nodes][which]
        return which, self.neighbours[at], self.edge[at]

    def bfs(self, source: int, alive: np.ndarray | None = None, closed: int = -1) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Hops from a node (-1: unreachable), numbers of shortest paths, and the nodes level by level.

        ``alive`` masks nodes, ``closed`` leaves out one edge.
        """
        dist, paths = np.full(self.n, -1), np.zeros(self.n)
        dist[source], paths[source] = 0, 1.0
        levels = [np.array([source])]
        while levels[-1].size:
            which, to, edge = self.expand(levels[-1])
            ok = dist[to] < 0
            if alive is not None:
                ok &= alive[to]
            if closed >= 0:
                ok &= edge != closed
            which, to = which[ok], to[ok]
            np.add.at(paths, to, paths[levels[-1]][which])
            dist[to] = len(levels)
            levels.append(np.unique(to))
        return dist, paths, levels[:-1]

    def multiply(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The symmetric matrix with edge values ``x``, times a vector."""
        return np.bincount(self.a, weights=x * y[self.b], minlength=self.n) + np.bincount(self.b, weights=x * y[self.a], minlength=self.n)

    def multiply_columns(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The same, times the columns of ``y``: runs of neighbours are summed, nothing is scattered."""
        out, value = np.zeros_like(y), x[self.edge]
        some = np.flatnonzero(np.diff(self.start))
        for c in range(y.shape[1] if some.size else 0):
            out[some, c] = np.add.reduceat(value * np.ascontiguousarray(y[:, c])[self.neighbours], self.start[some])
        return out

    def strength(self) -> np.ndarray:
        return self.multiply(self.weight, np.ones(self.n))

    def cores(self) -> np.ndarray:
        """Core numbers by peeling: take away all nodes of the smallest degree, level by level."""
        degree = np.diff(self.start).astype(np.int64)
        core, left = np.zeros(self.n, dtype=np.int64), np.ones(self.n, dtype=bool)
        k = 0
        while left.any():
            k = max(k, int(degree[left].min()))
            while (gone := np.flatnonzero(left & (degree <= k))).size:
                core[gone] = k
                left[gone] = False
                _, to, _ = self.expand(gone)
                np.subtract.at(degree, to, 1)
        return core

    def parts(self, alive: np.ndarray | None = None, closed: int = -1) -> np.ndarray:
        """Component numbers, -1 for nodes that aren't alive; the first node in order has component 0."""
        a, b = self._open(alive, closed)
        label = np.arange(self.n)
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for at in (a, b, label[a], label[b]):
                np.minimum.at(new, at, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        out = np.full(self.n, -1)
        there = np.arange(self.n) if alive is None else np.flatnonzero(alive)
        out[there] = np.unique(label[there], return_inverse=True)[1]
        return out

    def _open(self, alive: np.ndarray | None, closed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the edges between living nodes, without the closed one."""
        ok = np.ones(self.a.size, dtype=bool) if alive is None else alive[self.a] & alive[self.b]
        if closed >= 0:
            ok[closed] = False
        return self.a[ok], self.b[ok]

    def efficiency(self, alive: np.ndarray | None = None, closed: int = -1) -> float:
        """Mean of 1 / hops over ordered pairs of living nodes; 0 for fewer than two."""
        count = self.n if alive is None else int(alive.sum())
        if count < 2:
            return 0.0
        a, b = self._open(alive, closed)
        packed = Packed(self.n, a, b)
        total = sum(float((c / hop).sum()) for block in packed.blocks(64 * WORDS) for _, hop, _, c in packed.hop_counts(*block))
        return total / (count * (count - 1))


#: Sources walked together: words of 64 in bits, and most columns of path counts.
WORDS, COLUMNS = 16, 64
#: Places whose neighbours are gathered at once, and the fewest that are worked on side by side.
TOGETHER, HUBS = 2048, 16


class Packed:
    """Adjacency with the nodes of a component side by side, so that many sources are walked at once inside their components.

    ``node`` gives a place its node; nodes without an edge have no place.
    """

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray):
        part = LocalGraph(range(n), a, b, np.empty(0)).parts() if a.size else np.zeros(n, dtype=np.int64)
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        order = np.argsort(part, kind="stable")
        self.node = order[degree[order] > 0]
        place = np.full(n, -1)
        place[self.node] = np.arange(self.node.size)
        self.a, self.b = place[a], place[b]
        u, v = np.concatenate([self.a, self.b]), np.concatenate([self.b, self.a])
        self.neighbours = v[np.lexsort((v, u))]
        self.degree = degree[self.node]
        self.start = np.concatenate([[0], np.cumsum(self.degree)])
        #: First place of each component.
        self.first = np.concatenate([[0], np.flatnonzero(np.diff(part[self.node])) + 1, [self.node.size]]) if self.node.size else np.zeros(1, dtype=np.int64)

    def blocks(self, width: int) -> list[tuple[int, int, int, int]]:
        """(from, to) of whole components of at least ``width`` places together, if there are as many, and in it (from, to) of the sources, at most ``width``."""
        out = []
        lo = 0
        for hi in self.first[1:].tolist():
            if hi - lo >= width or hi == self.node.size:
                out += [(lo, hi, s, min(s + width, hi)) for s in range(lo, hi, width)]
                lo = hi
        return out

    def width(self, most: int) -> int:
        """Columns at once: a table of numbers has 16 MB at most, or eight columns."""
        largest = int(np.diff(self.first).max(initial=1))
        return int(np.clip((1 << 21) // max(largest, 1), min(8, most), most))

    def near(self, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Places next to the places ``at``, which lie from ``lo`` to ``hi``."""
        if 4 * at.size > hi - lo:
            return np.arange(lo, hi)
        seen = np.zeros(hi - lo, dtype=bool)
        seen[self.neighbours[self._arcs(at)[0]] - lo] = True
        return np.flatnonzero(seen) + lo

    def _arcs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.degree[at]
        first = np.cumsum(counts) - counts
        return np.arange(int(counts.sum())) + np.repeat(self.start[at] - first, counts), first

    def pull(self, values: np.ndarray, at: np.ndarray, lo: int, join: np.ufunc) -> np.ndarray:
        """``values`` (a row for each place from ``lo``) joined over the neighbours of each of ``at``: the j-th neighbours of all places at once while many have one, then the rest of the hubs."""
        order = np.argsort(-self.degree[at], kind="stable")
        rows = at[order]
        degree, start = self.degree[rows], self.start[rows]
        many = np.searchsorted(-degree, -np.arange(1, int(degree.max(initial=0)) + 2), side="right")
        out = values.take(self.neighbours[start] - lo, axis=0)
        j = 1
        while j < many.size and (k := int(many[j])) >= HUBS:
            for i in range(0, k, TOGETHER):
                end = min(i + TOGETHER, k)
                part = out[i:end]
                join(part, values.take(self.neighbours[start[i:end] + j] - lo, axis=0), out=part)
            j += 1
        for i in range(int(many[j]) if j < many.size else 0):
            for f in range(int(start[i]) + j, int(start[i] + degree[i]), TOGETHER):
                out[i] = join(out[i], join.reduce(values.take(self.neighbours[f : min(f + TOGETHER, start[i] + degree[i])] - lo, axis=0), axis=0))
        back = np.empty_like(out)
        back[order] = out
        return back

    def hop_counts(self, lo: int, hi: int, s: int, e: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(lo, hop, places, how many of the sources ``s`` to ``e`` are so many hops away), from one hop on; sources are bits of words."""
        words = (e - s + 63) // 64
        seen = np.zeros((hi - lo, words), dtype=np.uint64)
        i = np.arange(e - s)
        seen[s - lo + i, i // 64] = np.uint64(1) << (i % 64).astype(np.uint64)
        front, act, hop = seen.copy(), np.arange(s, e), 0
        while act.size:
            hop += 1
            rows = self.near(act, lo, hi)
            step = self.pull(front, rows, lo, np.bitwise_or) & ~seen[rows - lo]
            front[act - lo] = 0
            some = step.any(axis=1)
            act, step = rows[some], step[some]
            seen[act - lo] |= step
            front[act - lo] = step
            if act.size:
                yield lo, hop, act, np.bitwise_count(step).sum(axis=1, dtype=np.int64)

    def walks(self, lo: int, hi: int, s: int, e: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """``walks_from`` the places ``s`` to ``e``."""
        return self.walks_from(lo, hi, np.arange(s, e))

    def walks_from(self, lo: int, hi: int, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Hops (-1: unreachable) and numbers of shortest paths from the sources (columns) to the places from ``lo`` (rows), and the places reached at each hop."""
        dist, paths = np.full((hi - lo, sources.size), -1, dtype=np.int32), np.zeros((hi - lo, sources.size))
        i = np.arange(sources.size)
        dist[sources - lo, i], paths[sources - lo, i] = 0, 1.0
        front, levels = paths.copy(), [np.unique(sources)]
        while True:
            rows = self.near(levels[-1], lo, hi)
            step = self.pull(front, rows, lo, np.add)
            front[levels[-1] - lo] = 0
            own = dist[rows - lo]
            new = (step > 0) & (own < 0)
            some = new.any(axis=1)
            rows, step, new, own = rows[some], step[some], new[some], own[some]
            if not rows.size:
                return dist, paths, levels
            step *= new
            own[new] = len(levels)
            dist[rows - lo] = own
            front[rows - lo] = step
            paths[rows - lo] += step
            levels.append(rows)

    def handed_back(self, lo: int, dist: np.ndarray, paths: np.ndarray, levels: list[np.ndarray], weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What passes through each place for each source, and the inverse numbers of paths. ``weight`` tells how much goes to each place, 1 if not given."""
        inverse = np.divide(1.0, paths, out=np.zeros_like(paths), where=paths > 0)
        delta, share = np.zeros_like(paths), np.zeros_like(paths)
        for d in range(len(levels) - 1, 1, -1):
            down, up = levels[d] - lo, levels[d - 1] - lo
            share[down] = (dist[down] == d) * ((1 if weight is None else weight[down]) + delta[down]) * inverse[down]
            delta[up] += (dist[up] == d - 1) * paths[up] * self.pull(share, up + lo, lo, np.add)
            share[down] = 0
        return delta, inverse

    def passed(self, lo: int, hi: int, s: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hops and path counts as ``walks``, what passes through each place for each source, and what each place hands to a path before it."""
        dist, paths, levels = self.walks(lo, hi, s, e)
        delta, inverse = self.handed_back(lo, dist, paths, levels)
        return dist, paths, delta, (1 + delta) * inverse
