"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Outputs are the end mark, the most frequent training words, and groups of all other words by how they end. Contexts are the end
mark, the most frequent of those words, and the same groups. With context u (one before) and v (two before), output w
has the score ``(C1*Q[u] + C2*Q[v]) . R[w] + b[w]``. The normalisers of all pairs of contexts are one batched matrix product
over all outputs, Z = exp(A1 + b) exp(A2)^T, so every token gets its exact, normalised log-probability.
A word of a group has its add-one share of what training saw of that group, one share being unseen words'.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.text import small_parts, text_or_empty
from weftgraph.plans.shared import materialize

END = b" "  # no word holds a space
FLUSH = 150_000  # distinct words that a task counts before it sends them on
LONGEST = 64  # bytes of a word; a longer one goes by its digest
GROUPS = 512  # groups of words by their ending
_MARKS = b".,;:!?()[]{}'\"|"
NAMED = 512  # words that are contexts of their own
EXACT_COUNTS = 1024  # larger counts are binned to find the head
_F = np.float32


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, then one end. A word of over LONGEST bytes is a space and its SHA-256."""
    out = text.lower().split()
    if len(text) > LONGEST and max(map(len, out), default=0) > LONGEST:
        out = [w if len(w) <= LONGEST else END + hashlib.sha256(w).digest() for w in out]
    out.append(END)
    return out


def group_of(word: bytes) -> int:
    """The group of a word: by its last three bytes without punctuation."""
    return zlib.crc32(word.strip(_MARKS)[-3:]) % GROUPS


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, c) over all of one binary column; tasks sum what they can hold, Spark sums the rest."""
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        sums: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                sums.update(tokens(x.as_py()))
                if len(sums) > FLUSH:
                    common = dict(sums.most_common(FLUSH // 10))
                    yield batch_of(Counter({k: v for k, v in sums.items() if k not in common}))
                    sums = Counter(common)
        if sums:
            yield batch_of(sums)

    return texts.mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, head: int) -> pa.Table:
    """The end mark and the words from the least count up that leaves at most ``head`` of them, most frequent first.

    A table of how many words have each count (binned above EXACT_COUNTS, 64 bins for each power of two) gives that count, so a
    plain filter selects them: what reaches the driver doesn't depend on the number of partitions.
    """
    level = F.when(F.col("c") <= EXACT_COUNTS, F.col("c").cast("double")).otherwise(EXACT_COUNTS + F.floor(64 * F.log2(F.col("c") / EXACT_COUNTS)) + 1.0)
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).toPandas().sort_values("level", ascending=False)
    inside = levels["level"][levels["n"].cumsum() <= head]
    least = float(inside.iloc[-1]) if len(inside) else float("inf")
    found = counts.filter((level >= least) | (F.col("word") == F.lit(END))).select("word", "c").toArrow()
    return found.sort_by([("c", "descending"), ("word", "ascending")])


def group_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each group, of all words."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, GROUPS))
        for b in batches:
            at = np.fromiter(map(group_of, b.column(0).to_pylist()), dtype=np.int64, count=b.num_rows)
            total[0] += np.bincount(at, weights=b.column(1).to_numpy(), minlength=GROUPS)
            total[1] += np.bincount(at, minlength=GROUPS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS, dtype=np.int32)), pa.array(total[0].astype(np.int64)), pa.array(total[1].astype(np.int64))], names=["g", "n", "v"])

    rows = counts.filter(F.col("word") != F.lit(END)).select("word", "c").mapInArrow(sums, "g int, n long, v long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in rows:
        n[r["g"]], v[r["g"]] = r["n"], r["v"]
    return n, v


class Vocabulary:
    """Frequent training words, their counts and outputs, and what training saw of each group of all other words.

    Output 0 is the end, then come ``named`` words, then the groups. ``context`` gives the context of an output.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, n: np.ndarray, v: np.ndarray, outputs: int):
        self.number = {w: i for i, w in enumerate(words)}
        self.log_counts = np.append(np.log10(counts + 1.0), 0.0)
        picked = [i for i, w in enumerate(words) if w != END][:outputs]
        groups = np.fromiter(map(group_of, words), dtype=np.int64, count=len(words))
        self.groups_at = 1 + len(picked)
        self.size = self.groups_at + GROUPS
        self.output = np.append(self.groups_at + groups, 0).astype(np.int32)  # the last entry is never read
        self.output[picked] = 1 + np.arange(len(picked))
        if END in self.number:
            self.output[self.number[END]] = 0
        named = min(NAMED, len(picked))
        self.contexts = 1 + named + GROUPS
        self.context = np.concatenate([[0], 1 + np.arange(named), 1 + named + groups[picked[named:]], 1 + named + np.arange(GROUPS)]).astype(np.int32)
        rest_n, rest_v = n - np.bincount(groups[picked], weights=counts[picked], minlength=GROUPS), v - np.bincount(groups[picked], minlength=GROUPS)
        self.log_share = np.log10(rest_n + rest_v + 1)
        self.seen = np.concatenate([[counts[self.number[END]] if END in self.number else 0], counts[picked], rest_n])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words; -1 for a rare one."""
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))


@dataclass
class Parameters:
    q: np.ndarray
    r: np.ndarray
    b: np.ndarray
    c: np.ndarray  # C1 and C2

    def arrays(self) -> list[np.ndarray]:
        return [self.q, self.r, self.b, self.c]

    @staticmethod
    def start(frequency: np.ndarray, contexts: int, dim: int, seed: int) -> Parameters:
        rng = np.random.default_rng(seed)
        q, r = rng.normal(0, 0.3, (contexts, dim)), rng.normal(0, 0.1, (frequency.size, dim))
        return Parameters(q.astype(_F), r.astype(_F), np.log(frequency).astype(_F), np.array([np.ones(dim), np.full(dim, 0.7)], dtype=_F))

    def copy(self) -> Parameters:
        return Parameters(*(a.copy() for a in self.arrays()))

    def hidden(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        return self.q[u] * self.c[0] + self.q[v] * self.c[1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Adagrad, one rate for each row, on the NCE loss; a batch shares its noise words, each weighing noise / their number."""

    def __init__(self, p: Parameters, frequency: np.ndarray, rate: float, noise: int, seed: int, shared: int = 64):
        self.p, self.rate, self.noise, self.shared = p, rate, noise, shared
        self.log_noise = np.log(noise * frequency).astype(_F)
        self.edges, self.rng = np.cumsum(frequency), np.random.default_rng(seed)
        self.sums = [np.full(a.shape[0], 1e-3, dtype=_F) for a in p.arrays()]
        self.touched = [np.zeros(a.shape[0]) for a in p.arrays()]

    def _rows(self, which: int, index: np.ndarray, grad: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(index, kind="stable")
        sorted_ = index[order]
        first = np.flatnonzero(np.diff(sorted_, prepend=-1))
        rows, g = sorted_[first], np.add.reduceat(grad[order], first, axis=0)
        self.sums[which][rows] += (g * g).mean(axis=1) if g.ndim > 1 else g * g
        step = self.rate / np.sqrt(self.sums[which][rows])
        self.p.arrays()[which][rows] -= g * (step[:, None] if g.ndim > 1 else step)
        self.touched[which][rows] += np.add.reduceat(weight[order], first)

    def step(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> None:
        p, n = self.p, w.size
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(self.shared)), self.edges.size - 1)
        qu, qv, rw, rn = p.q[u], p.q[v], p.r[w], p.r[noise]
        h = qu * p.c[0] + qv * p.c[1]
        e = _sigmoid(np.einsum("ij,ij->i", h, rw) + p.b[w] - self.log_noise[w]) - 1
        f = _sigmoid(h @ rn.T + p.b[noise] - self.log_noise[noise]) * _F(self.noise / self.shared)
        gh = e[:, None] * rw + f @ rn
        both, heavy = np.concatenate([w, noise]), np.concatenate([np.ones(n), np.full(self.shared, n * self.noise / self.shared)])
        gr, gb = np.concatenate([e[:, None] * h, f.T @ h]), np.concatenate([e, f.sum(axis=0)])
        gc = np.stack([(gh * qu).mean(axis=0), (gh * qv).mean(axis=0)])
        self._rows(0, np.concatenate([u, v]), np.concatenate([gh * p.c[0], gh * p.c[1]]), np.ones(2 * n))
        self._rows(1, both, gr, heavy)
        self._rows(2, both, gb, heavy)
        self._rows(3, np.arange(2), gc, np.full(2, float(n)))


def contexts_of(outputs: np.ndarray, starts: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context two and one before each token; before a text stands the end mark."""
    c = context[outputs]
    u = np.concatenate([np.zeros(1, dtype=c.dtype), c[:-1]])
    u[starts] = 0
    v = np.concatenate([np.zeros(1, dtype=c.dtype), u[:-1]])
    v[starts] = 0
    return v, u


def lists_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the lists (none is empty), one after the other, and where each list starts."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    return values, np.cumsum(sizes) - sizes


def learn_texts(t: Trainer, parts: Iterator[tuple[np.ndarray, np.ndarray]], context: np.ndarray, batch: int) -> int:
    """Learn from parts (outputs, starts of texts); a step takes ``batch`` tokens in the texts' order."""
    total = 0
    for w, starts in parts:
        v, u = contexts_of(w, starts, context)
        for a in range(0, w.size, batch):
            t.step(v[a : a + batch], u[a : a + batch], w[a : a + batch])
        total += w.size
    return total


PART = 256  # rows of the parameters that travel together
SUMS = "which int, part int, rows binary, sums binary, weights binary"


def sums_of(t: Trainer) -> Iterator[pa.RecordBatch]:
    """What a shard learned, weighed by how much it saw: only the rows that it touched, so a small shard sends little."""
    for which, (a, weights) in enumerate(zip(t.p.arrays(), t.touched, strict=True)):
        rows = np.flatnonzero(weights)
        flat = a.reshape(a.shape[0], -1)
        cuts = np.flatnonzero(np.diff(rows // PART, prepend=-1))
        parts = [(rows[x:y], which, int(rows[x] // PART)) for x, y in zip(cuts, [*cuts[1:], rows.size], strict=True)]
        if parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.int32()), pa.array([(r % PART).astype(np.uint8).tobytes() for r, *_ in parts], pa.binary()), pa.array([(flat[r] * weights[r, None]).astype(_F).tobytes() for r, *_ in parts], pa.binary()), pa.array([weights[r].astype(_F).tobytes() for r, *_ in parts], pa.binary())], names=["which", "part", "rows", "sums", "weights"])


def average(rows: DataFrame, p: Parameters) -> Parameters:
    """The mean over shards of each row of the parameters, weighed by how much the shard saw of it; ``rows`` are those of ``sums_of``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for which, part, own, sums, weights in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, w = np.frombuffer(own, dtype=np.uint8), np.frombuffer(weights, dtype=_F)
                x = np.frombuffer(sums, dtype=_F).reshape(at.size, -1)
                total = held.setdefault((which, part), (np.zeros((PART, x.shape[1])), np.zeros(PART)))
                total[0][at] += x
                total[1][at] += w
        for (which, part), (sums, weights) in held.items():
            some = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([part], pa.int32()), pa.array([some.astype(np.uint8).tobytes()], pa.binary()), pa.array([(sums[some] / weights[some, None]).astype(_F).tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["which", "part", "rows", "sums", "weights"])

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = p.copy()
    for which, part, own, means, _ in rows.repartition(spread, "which", "part").mapInArrow(add, SUMS).collect():
        a = out.arrays()[which]
        at = part * PART + np.frombuffer(own, dtype=np.uint8).astype(np.int64)
        a[at] = np.frombuffer(means, dtype=_F).reshape(at.size, *a.shape[1:])
    return out


def train(codes: DataFrame, vocabulary, frequency: np.ndarray, n: int, dim: int, rate: float, noise: int, batch: int, rounds: int, shard_tokens: int, least_shards: int, seed: int) -> Parameters:
    """Every training text is learned from once, in one of ``rounds`` by a hash of its id and digest. In a round, fixed shards, also by this hash, start from the
    same parameters and learn from their texts in its order; Spark averages what they learned. Neither the partitions of the input nor
    the number of cores changes the result; the number of shards grows with the tokens."""
    spark = codes.sparkSession
    context, contexts = vocabulary.value.context, vocabulary.value.contexts
    p = Parameters.start(frequency, contexts, dim, seed)
    shards = max(least_shards, -(-n // (shard_tokens * rounds)))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((p, frequency))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, k: int = k) -> Iterator[pa.RecordBatch]:
            start, own = shared.value
            t = Trainer(start.copy(), own, rate / np.sqrt(k + 1), noise, seed + k)
            if not learn_texts(t, (lists_of(part.column(0)) for b in batches for part in byte_parts(b, 0)), context, batch):
                return
            yield from sums_of(t)

        # The id goes with the digest: copies of one text are dealt over rounds and shards like any others.
        own = codes.select("outputs", F.xxhash64("__id", "digest").alias("key")).filter(F.pmod("key", F.lit(rounds)) == k)
        dealt = own.repartition(shards, F.expr(f"key div {rounds}")).sortWithinPartitions("key").select("outputs")
        p = average(dealt.mapInArrow(learn, SUMS), p)
        shared.unpersist()
    return p


def byte_parts(batch: pa.RecordBatch, lists: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose list column holds about ``most`` values each."""
    ends = batch.column(lists).offsets.to_numpy()
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def log_normalisers(spark: SparkSession, p: Parameters, block: int = 64, chunk: int = 2048) -> np.ndarray:
    """log Z of each pair of contexts (u, v): products of ``block`` contexts u with all contexts v, over all outputs."""
    shared = spark.sparkContext.broadcast(p)
    contexts = p.q.shape[0]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        q1, q2 = m.q * m.c[0], m.q * m.c[1]
        parts = [slice(i, i + chunk) for i in range(0, m.b.size, chunk)]
        todo = [i for b in batches for i in b.column(0).to_pylist()]
        top2 = np.max([(q2 @ m.r[s].T).max(axis=1) for s in parts], axis=0)
        for at in todo:
            own = q1[at * block : (at + 1) * block]
            top1 = np.max([(own @ m.r[s].T + m.b[s]).max(axis=1) for s in parts], axis=0)
            total = np.zeros((own.shape[0], contexts))
            for s in parts:
                total += np.exp(own @ m.r[s].T + m.b[s] - top1[:, None]) @ np.exp(q2 @ m.r[s].T - top2[:, None]).T
            z = np.log(total) + top1[:, None] + top2
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([z.astype(_F).tobytes()], pa.binary())], names=["at", "z"])

    blocks = -(-contexts // block)
    out = np.empty((contexts, contexts), dtype=_F)
    for at, z in spark.range(0, blocks, 1, blocks).mapInArrow(rows, "at long, z binary").collect():
        out[at * block : (at + 1) * block] = np.frombuffer(z, dtype=_F).reshape(-1, contexts)
    return out


def log10_tokens(p: Parameters, z: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """log10 probabilities of outputs after their contexts."""
    out = np.empty(w.size)
    for a in range(0, w.size, 1 << 16):
        s = slice(a, a + (1 << 16))
        out[s] = (np.einsum("ij,ij->i", p.hidden(v[s], u[s]), p.r[w[s]]) + p.b[w[s]] - z[u[s], v[s]]) / np.log(10)
    return out


def encode(rows: DataFrame, vocabulary) -> DataFrame:
    """(__id, held_out, digest, outputs, known, base, other, rare, times): every text as numbers of outputs, once for training and scoring.

    base and other are sums of log10(c + 1) over frequent words, other only over words of groups and less their groups' totals.
    """
    schema = T.StructType([rows.schema["__id"], T.StructField("held_out", T.BooleanType()), T.StructField("digest", T.BinaryType()), T.StructField("outputs", T.ArrayType(T.IntegerType())), T.StructField("known", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("base", "other")], T.StructField("rare", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc: Vocabulary = vocabulary.value
        for b in batches:
            for first, texts in small_parts(b.column(3)):
                got: list[list] = [[] for _ in range(6)]
                for x in texts:
                    words = tokens(x)
                    number = voc.numbers(words)
                    out = voc.output[number]
                    out[-1] = 0
                    number[-1] = voc.number.get(END, -1)
                    missing = np.flatnonzero(number < 0)
                    rare = [words[i] for i in missing]
                    if rare and rare[-1] == END:
                        rare.pop()
                        missing = missing[:-1]
                    out[missing] = [voc.groups_at + group_of(w) for w in rare]
                    counted = Counter(rare)
                    logs, grouped = voc.log_counts[number], out >= voc.groups_at
                    values = (out, int((number >= 0).sum()), float(logs.sum()), float(logs[grouped].sum() - voc.log_share[out[grouped] - voc.groups_at].sum()), list(counted.keys()), list(counted.values()))
                    for place, value in zip(got, values, strict=True):
                        place.append(value)
                ends = np.cumsum([0, *map(len, got[0])], dtype=np.int32)
                part = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got[0]))), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64()), pa.array(got[3], pa.float64()), pa.array(got[4], pa.list_(pa.binary())), pa.array(got[5], pa.list_(pa.int32()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Column | None = None, head: int = 1 << 18, outputs: int = 1 << 14, dim: int = 32, rate: float = 0.05, noise: int = 8, batch: int = 2048, rounds: int = 4, shard_tokens: int = 25_000_000, least_shards: int = 12, seed: int = 1
) -> DataFrame:
    """Each row of ``docs`` as id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows where ``training`` holds (by default those outside the held-out fold). Counts of about the ``head``
    most frequent words travel to the texts; rarer words travel to the counts, in a join on the word, whose keys
    are rare by construction. The ``outputs`` most frequent are the model's own, all others are told by group and count, so every
    token's probability depends on its context. Defined cases: a null text is empty, one end token; without training tokens all
    words are unseen and the score equals the base score; a null id is passed on and counts as training; repeated rows are each scored; an empty table gives no rows;
    other columns are ignored; texts and words of any length are taken whole.
    """
    spark: SparkSession = docs.sparkSession
    out_fold = held_out(id_col) if training is None else ~F.coalesce(training, F.lit(False))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("__id"), out_fold.alias("held_out"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.cast("binary").alias("text"))
    counts = materialize(count_tokens(rows.filter(~F.col("held_out")).select("text")), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = frequent(counts, head)
    voc = Vocabulary(top.column("word").to_pylist(), top.column("c").to_numpy().astype(np.int64), *group_counts(counts), outputs)
    frequency = (voc.seen + 1) / (voc.seen + 1).sum()
    shared = spark.sparkContext.broadcast(voc)
    codes = materialize(encode(rows, shared), "codes")
    p = train(codes.filter(~F.col("held_out")), shared, frequency, n, dim, rate, noise, batch, rounds, shard_tokens, least_shards, seed) if n else Parameters.start(frequency, voc.contexts, dim, seed)
    model = spark.sparkContext.broadcast((p, log_normalisers(spark, p), voc.context))
    schema = T.StructType([codes.schema["__id"], *[codes.schema[c] for c in ("held_out", "digest", "known", "base", "other")], T.StructField("n_tokens", T.LongType()), T.StructField("lm", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, z, context = model.value
        for b in batches:
            for part in byte_parts(b, 6):
                w, starts = lists_of(part.column(6))
                lm = np.add.reduceat(log10_tokens(own, z, *contexts_of(w, starts, context), w), starts)
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(np.diff(np.append(starts, w.size))), pa.array(lm)], names=schema.names)

    scored = codes.select("__id", "held_out", "digest", "known", "base", "other", "outputs").mapInArrow(score, schema)
    rare = codes.select("__id", "digest", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("__id", "digest", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word").select("__id", "digest", (F.col("times") * F.log10(F.col("c") + 1.0)).alias("tail"), F.col("times").cast("long").alias("tail_known"))
    facts = ["held_out", "known", "base", "other", "n_tokens", "lm"]
    marked = scored.select("__id", "digest", F.lit(0.0).alias("tail"), F.lit(0).cast("long").alias("tail_known"), F.lit(1).cast("long").alias("copies"), *facts)
    # Each copy of a repeated row sends its rare words: their sums are shared out among the copies.
    by_doc = found.unionByName(marked, allowMissingColumns=True).groupBy("__id", "digest").agg(F.sum("tail").alias("tail"), F.sum("tail_known").alias("tail_known"), F.sum("copies").alias("copies"), *[F.max(c).alias(c) for c in facts])
    by_doc = by_doc.withColumn("__nth", F.explode(F.expr("sequence(1L, copies)"))).withColumn("tail", F.col("tail") / F.col("copies"))
    base = F.col("base") + F.col("tail") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    known = F.col("known") + F.expr("tail_known div copies")
    full = F.col("lm") + F.col("other") + F.col("tail")
    return by_doc.select(F.col("__id").alias(id_col), "held_out", "n_tokens", known.alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), (full if n else base).alias("score"))


