"""N-gram Jaccard join with signature trees.

Documents whose sets may overlap enough meet in groups: two sets with Jaccard t or more share one of the first
n - ceil(t n) + 1 elements of each, in any fixed order of all shingles (here: by hash, shingles that a bounded sample
found to be common last). A group's sets become leaves of a tree whose nodes hold the OR of the token bitmaps below
them, the range of their set sizes and the least number of bits of one of them. A dual traversal compares node
pairs and leaves out those whose largest possible overlap can't reach the threshold. What it leaves is verified on
the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.text import small_parts, text_or_empty
from weftgraph.operators.components import connected_components
from weftgraph.plans.shared import materialize, salted_join

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 62, 256, dtype=np.uint64) * _U(2) + _U(1)
LEAF, FAN = 16, 8  # sets in a leaf, children of a node
TILE = 2000  # members of a group that are compared in one task
MEMBERS_AT_ONCE = 1 << 20
SLOTS = 1 << 22
LINK = "src long, dst long"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z in lower case: polynomials over byte codes, from prefix sums."""
    raw = np.frombuffer(text.lower(), dtype=np.uint8)
    if not raw.size:
        return np.zeros(0, dtype=np.uint64)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not starts.size:
        return np.zeros(0, dtype=np.uint64)
    powers, inverse = _powers(raw.size + 1)
    sums = np.zeros(raw.size + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * powers[: raw.size], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int, most: int = 1 << 18) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse; those of at most ``most`` places stay in memory, longer texts make their own."""
    if _POWERS[0].size >= n:
        return _POWERS
    size = 1 << (n - 1).bit_length()
    made = []
    for x in (int(_ODD), pow(int(_ODD), -1, 1 << 64)):
        p = np.full(size, x, dtype=np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size <= most:
        _POWERS[:] = made
    return made


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of all words together if there are fewer."""
    w = word_hashes(text)
    if not w.size:
        return w
    k = min(size, w.size)
    h = w[: w.size - k + 1].copy()
    for i in range(1, k):
        h = mix(h * _U(31) + w[i : w.size - k + 1 + i])
    if w.size < size:
        h = mix(h + _U(w.size))
    return np.unique(h)


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The overlap without which a set of n elements can't reach the threshold with any other."""
    return (percent * n + 99) // 100


def bitmap(h: np.ndarray, room: int = 2) -> np.ndarray:
    """A bit for each element, in ``room`` times the power of two that isn't below their number (64 bits at least)."""
    bits = max(64, room << (int(h.size) - 1).bit_length())
    at = (h >> _U(20)) & _U(bits - 1)
    out = np.zeros(bits, dtype=np.uint8)
    out[at.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray) -> np.ndarray:
    """Half the bits, each the OR of two: the bitmap of the same set at half the size."""
    half = bits.shape[-1] // 2
    return bits[..., :half] | bits[..., half:]


class Forest:
    """Union-find over the members of one group, as an array of labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)


def compare_tree(bits: np.ndarray, sizes: np.ndarray, percent: int, check: Callable[[np.ndarray, np.ndarray, np.ndarray], None], forest: Forest) -> None:
    """Dual traversal over sets sorted by size. ``check`` gets the member numbers of two leaves and the pairs left."""
    m = sizes.size
    slack = sizes - needed(sizes, percent)  # elements that a set may have outside its partner
    ones = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    levels = [(bits, sizes, sizes, ones, slack)]
    width = LEAF
    while levels[-1][1].size > 1:
        b, low, high, one, s = levels[-1]
        cut = np.arange(0, low.size, width)
        levels.append((np.bitwise_or.reduceat(b, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.minimum.reduceat(one, cut), np.maximum.reduceat(s, cut)))
        width = FAN
    if len(levels) == 1:
        return
    spans = [1, LEAF]
    while len(spans) < len(levels):
        spans.append(spans[-1] * FAN)
    stack = [(len(levels) - 1, 0, 0)]
    while stack:
        k, x, y = stack.pop()
        b, low, high, one, s = levels[k]
        if percent * low[y] > 100 * high[x]:  # sizes ascend: all of y are too large for all of x
            continue
        if x != y:
            common = int(np.bitwise_count(b[x] & b[y]).sum())
            if common < one[x] - s[x] or common < one[y] - s[y]:
                continue
            own = forest.label[x * spans[k] : (x + 1) * spans[k]]
            if (own == own[0]).all() and (forest.label[y * spans[k] : (y + 1) * spans[k]] == own[0]).all():
                continue
        if k > 1:
            cx = range(x * FAN, min((x + 1) * FAN, levels[k - 1][1].size))
            cy = range(y * FAN, min((y + 1) * FAN, levels[k - 1][1].size))
            stack += [(k - 1, i, j) for i in cx for j in cy if i <= j]
            continue
        i, j = np.arange(x * LEAF, min((x + 1) * LEAF, m)), np.arange(y * LEAF, min((y + 1) * LEAF, m))
        both = np.bitwise_count(bits[i][:, None, :] & bits[j][None, :, :]).sum(axis=2).astype(np.int64)
        si, sj = sizes[i][:, None], sizes[j][None, :]
        # The overlap that this pair of sizes needs; a bit of one that the other lacks is an element outside.
        least = (percent * (si + sj) + 99 + percent) // (100 + percent)
        fit = (both >= ones[i][:, None] - si + least) & (both >= ones[j][None, :] - sj + least)
        fit &= percent * np.maximum(si, sj) <= 100 * np.minimum(si, sj)
        fit &= i[:, None] < j[None, :]
        if fit.any():
            check(i, j, fit)


def by_size_class(bits: list[np.ndarray], sizes: np.ndarray, percent: int, check: Callable[[np.ndarray, np.ndarray, np.ndarray], None], forest: Forest) -> None:
    """Traverse each class of bitmap sizes together with the next, folded; sets farther apart can't be partners."""
    words = np.array([b.size for b in bits])
    for w in np.unique(words):
        own = np.flatnonzero((words == w) | (words == 2 * w))
        own = own[np.argsort(sizes[own], kind="stable")]
        if own.size < 2:
            continue
        stacked = np.stack([bits[k] if words[k] == w else fold(bits[k]) for k in own])
        view = Forest(own.size)
        view.label = np.unique(forest.label[own], return_inverse=True)[1].astype(np.int64)

        def translated(i: np.ndarray, j: np.ndarray, fit: np.ndarray, own: np.ndarray = own, view: Forest = view) -> None:
            check(own[i], own[j], fit)
            view.label = forest.label[own]

        compare_tree(stacked, sizes[own], percent, translated, view)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal first columns in sorted batches, across batch boundaries."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), batch.num_rows]
        if waiting and waiting[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _signature(keys: np.ndarray) -> int:
    total = mix(keys.view(np.uint64)).sum(dtype=np.uint64, keepdims=True) + _U(keys.size)
    return int(mix(total).view(np.int64)[0])


def in_rounds(groups: DataFrame, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links of ``solve``, which compares all members of each group (g, id), for groups (g, id, m) of any size m.

    Groups over TILE members are dealt into tiles, each compared in itself. One member of each class of two or more is dealt and
    compared again, which joins the tiles' classes, while that halves their number. Who is then in his group's largest class needs no more comparison with others of it; all that
    aren't are compared with every tile. So a group of near copies costs its size, not its square, and no link between classes is lost.
    """
    big = groups.filter(F.col("m") > TILE)
    small = groups.filter(F.col("m") <= TILE).select("g", "id")
    if big.isEmpty():
        return solve(small)
    dealt = lambda n: F.expr(f"({n} + {TILE - 1}) div {TILE}")
    big = materialize(big.select("g", "id", F.pmod(F.xxhash64("id"), dealt("m")).alias("tile"), dealt("m").alias("tiles")), "groups")
    first = materialize(solve(small.unionByName(big.select(F.xxhash64("g", "tile").alias("g"), "id"))), "links")

    def labelled(links: DataFrame) -> DataFrame:
        return big.join(connected_components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")

    links, before = first, None
    while True:
        heads = materialize(labelled(links).groupBy("g", "label").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n > 1").drop("n"), "heads")
        counts = heads.groupBy("g").agg(F.count("*").alias("r")).filter("r > 1")
        most, total = counts.agg(F.coalesce(F.max("r"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
        if not total or (before is not None and 2 * total > before):  # most classes are joined, or can't be by this
            break
        met = solve(heads.join(counts, "g").select(F.xxhash64("g", F.pmod(F.xxhash64("id", F.lit(total)), dealt("r")), F.lit(1)).alias("g"), "id"))
        links, before = materialize(links.unionByName(met), "links"), total
        if most <= TILE:
            break
    now = materialize(labelled(links), "groups")
    most = now.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    rest = now.join(most, "g").filter("label != most").drop("most", "label")
    left = rest.groupBy("g").agg(dealt("count(1)").alias("lefts"))
    if left.isEmpty():
        return links
    one = rest.join(left, "g").withColumn("left", F.pmod(F.xxhash64("id", F.lit(2)), F.col("lefts"))).withColumn("tile", F.explode(F.expr("sequence(0L, tiles - 1)")))
    other = now.join(left, "g").withColumn("left", F.explode(F.expr("sequence(0L, lefts - 1)")))
    pairs = one.select("g", "left", "tile", "id").unionByName(other.select("g", "left", "tile", "id")).select(F.xxhash64("g", "left", "tile", F.lit(2)).alias("g"), "id").distinct()
    return links.unionByName(solve(pairs))


def _stars(ids: np.ndarray, forest: Forest) -> pa.RecordBatch | None:
    """Links (src, dst) from the smallest id of each joined class to its others."""
    order = np.lexsort((ids, forest.label))
    label, own = forest.label[order], ids[order]
    head = np.maximum.accumulate(np.where(np.diff(label, prepend=-1) != 0, np.arange(label.size), 0))
    some = own[head] != own
    return pa.RecordBatch.from_arrays([pa.array(own[head][some]), pa.array(own[some])], names=["src", "dst"]) if some.any() else None


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85, sample_docs: int = 4000, common_in: int = 8, common_most: int = 1 << 16) -> DataFrame:
    """Each row of ``docs`` as id, n_shingles, component_id: the smallest id reachable over links.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of distinct shingles. Defined cases:
    a null text, or one without a word, has an empty set and links with nothing; fewer words than a shingle are one shingle; rows with an id in common
    are one document, with the links of all its texts; a null id is a document of its own kind (its component_id is null if it links with nothing);
    an empty table gives no rows; other columns are ignored. ids are integers.

    Equal sets collapse into their smallest id first, so copies cost one row each. ``sample_docs`` bounds the sample that finds
    common shingles; it only decides an order and how groups are made, no result depends on it. Pairs that the trees leave tie documents to clusters; each
    cluster is verified on whole sets. Groups and clusters over TILE members are compared in rounds (``in_rounds``). A common shingle's group never
    meets in one task: such groups, at most ``common_most``, are told apart by sums and dealt at once.
    """
    spark = docs.sparkSession
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).cast("binary").alias("__text"))
    sample = rows.select("__id").distinct().orderBy(F.xxhash64("__id")).limit(sample_docs)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x, shingle).view(np.int64))], names=["h"])

    sampled = rows.join(F.broadcast(sample), "__id", "left_semi").select("__text")
    common = sampled.mapInArrow(hashes, "h long").groupBy("h").count().filter(F.col("count") >= common_in).orderBy(F.desc("count"), "h").limit(common_most).toPandas()["h"]
    late = spark.sparkContext.broadcast(np.sort(common.to_numpy(dtype=np.int64).view(np.uint64)))

    sig_schema = "id long, n long, k1 long, k2 long, prefix array<long>, hot array<long>, bits binary"

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = late.value
        for b in batches:
            for a, part_texts in small_parts(b.column(1)):
                part = b.slice(a, len(part_texts))
                n, k1, k2, prefix, hot, bits = [], [], [], [], [], []
                for x in part_texts:
                    h = shingle_set(x, shingle)
                    n.append(h.size)
                    m = mix(h ^ _ODD)
                    k1.append(m.sum(dtype=np.uint64))
                    k2.append(np.bitwise_xor.reduce(mix(m)) if h.size else 0)
                    known = last[np.minimum(np.searchsorted(last, h), last.size - 1)] == h if last.size else np.zeros(h.size, dtype=bool)
                    own, late_own = h[~known].view(np.int64), h[known].view(np.int64)
                    room = h.size - needed(h.size, percent) + 1 if h.size else 0
                    prefix.append(own[:room])
                    hot.append(late_own[: max(0, room - own.size)])
                    bits.append(bitmap(h).tobytes() if h.size else b"")
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)], dtype=np.int32)), pa.array(np.concatenate(x))) for x in (prefix, hot)]
                signed = [pa.array(np.array(k, dtype=np.uint64).view(np.int64)) for k in (k1, k2)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *signed, *lists, pa.array(bits, pa.binary())], names=["id", "n", "k1", "k2", "prefix", "hot", "bits"])

    sigs = materialize(rows.mapInArrow(signatures, sig_schema), "sets")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "prefix", "hot", "bits")))
    chosen = materialize(sigs.filter("n > 0").groupBy("n", "k1", "k2").agg(first.alias("r")).select("n", "k1", "k2", F.col("r.id").alias("rep"), F.col("r.prefix").alias("prefix"), F.col("r.hot").alias("hot"), F.col("r.bits").alias("bits")), "chosen")
    reps = chosen.select("n", "k1", "k2", "rep")
    own = chosen.filter("rep is not null").withColumnRenamed("rep", "id")

    # Groups: documents with a prefix element in common, once for each different set of members.
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for g in groups_of(batches):
            if g.num_rows > 1:
                ids = np.unique(g.column(1).to_numpy())
                if ids.size > 1 and (s := _signature(ids)) not in done:
                    if len(done) < MEMBERS_AT_ONCE:
                        done.add(s)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(ids.size, s)), pa.array(ids), pa.array(np.full(ids.size, ids.size))], names=["g", "id", "m"])

    heads = own.select(F.explode("prefix").alias("h"), "id").repartition(int(parts), "h").sortWithinPartitions("h")
    grouped = heads.mapInArrow(_packed(meet), "g long, id long, m long").distinct()
    # Groups of the common shingles: their number is bounded, so sums of their members tell equal groups apart, and the first of these is picked.
    hot = own.select(F.explode("hot").alias("h"), "id").distinct()
    sums = hot.groupBy("h").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).bitwiseAND(F.lit(0xFFFFFF))).alias("y"))
    picked = sums.filter("m > 1").groupBy("m", "x", "y").agg(F.min("h").alias("h")).select("h", "m")
    grouped = materialize(grouped.unionByName(hot.join(F.broadcast(picked), "h").select(F.xxhash64("h", F.lit(0)).alias("g"), "id", "m")), "groups")
    signed = own.select("id", "n", "bits")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches):
            ids, sizes = g.column(1).to_numpy(), g.column(2).to_numpy()
            forest = Forest(ids.size)

            def check(i: np.ndarray, j: np.ndarray, fit: np.ndarray, forest: Forest = forest) -> None:
                while (open_ := fit & (forest.label[i][:, None] != forest.label[j][None, :])).any():
                    a, b = np.unravel_index(open_.argmax(), open_.shape)
                    forest.join(int(i[a]), int(j[b]))

            by_size_class([np.frombuffer(b, dtype=np.uint64) for b in g.column(3).to_pylist()], sizes, percent, check, forest)
            found = _stars(ids, forest)
            if found is not None:
                yield found

    def alike(members: DataFrame) -> DataFrame:
        rows = members.join(signed, "id").select("g", "id", "n", "bits")
        return rows.repartition(int(parts), "g").sortWithinPartitions("g").mapInArrow(_packed(candidates), LINK).distinct()

    likely = materialize(in_rounds(grouped, alike), "likely")
    clusters = connected_components(likely)
    size = clusters.groupBy("component").agg(F.count("*").alias("m"))
    clusters = materialize(clusters.join(size, "component").select(F.xxhash64("component").alias("g"), F.col("node").alias("id"), "m"), "clusters")

    # Verification on whole sets, which are made again for the documents that are left. A bitmap of fixed size tells them: a chance hit costs a set.
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int")
    marks = clusters.select(slot.alias("slot")).distinct().toPandas()["slot"].to_numpy()
    flags = np.zeros(SLOTS, dtype=np.uint8)
    flags[marks] = 1
    wanted = spark.sparkContext.broadcast(np.packbits(flags))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted.value)
        for b in batches:
            hit = b.filter(pa.array(bits[b.column(1).to_numpy()] == 1))
            for a in range(0, hit.num_rows, 256):
                part = hit.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(x, shingle).tobytes() for x in part.column(2).to_pylist()], pa.binary())], names=["id", "hashes"])

    texts = rows.filter("__id is not null").select(F.col("__id").alias("id"), "__text").select("id", slot.alias("slot"), "__text")
    sets = materialize(texts.mapInArrow(whole, "id long, hashes binary"), "whole")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches):
            ids = g.column(1).to_numpy()
            hashes = [np.frombuffer(x, dtype=np.uint64) for x in g.column(2).to_pylist()]
            sizes, forest = np.array([h.size for h in hashes]), Forest(ids.size)
            ones = [i for i in range(ids.size) if sizes[i]]
            for a, b in zip(ones[:-1], ones[1:], strict=True):
                if ids[a] == ids[b]:
                    forest.join(a, b)

            def check(i: np.ndarray, j: np.ndarray, fit: np.ndarray, forest: Forest = forest, hashes: list = hashes, sizes: np.ndarray = sizes) -> None:
                for a, b in zip(*np.nonzero(fit), strict=True):
                    x, y = int(i[a]), int(j[b])
                    if forest.label[x] != forest.label[y]:
                        small, large = (hashes[x], hashes[y]) if sizes[x] <= sizes[y] else (hashes[y], hashes[x])
                        both = int((large[np.minimum(np.searchsorted(large, small), large.size - 1)] == small).sum())
                        if 100 * both >= percent * (small.size + large.size - both):
                            forest.join(x, y)

            by_size_class([bitmap(h, 8) for h in hashes], sizes, percent, check, forest)
            found = _stars(ids, forest)
            if found is not None:
                yield found

    def verified(members: DataFrame) -> DataFrame:
        rows = sets.join(members, "id").select("g", "id", "hashes")
        return rows.repartition(int(parts), "g").sortWithinPartitions("g", "id").mapInArrow(_packed(verify), LINK).distinct()

    links = materialize(in_rounds(clusters, verified), "pairs")
    # A document whose rows hold several sets ties their classes together.
    ties = sigs.filter("n > 0").select("id", "n", "k1", "k2").distinct().groupBy("id").agg(F.count("*").alias("c")).filter("c > 1 and id is not null").select("id")
    tied = salted_join(sigs.filter("n > 0").join(ties, "id", "left_semi").select("id", "n", "k1", "k2"), reps, ["n", "k1", "k2"], ["id"]).filter("id != rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    labels = connected_components(links.unionByName(tied))
    classes = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    some = salted_join(sigs.filter("n > 0").select("id", "n", "k1", "k2"), classes, ["n", "k1", "k2"], ["id"])
    none = sigs.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = some.select("id", "n", "component_id").unionByName(none)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _packed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 20_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` with its many small batches put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in f(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run
