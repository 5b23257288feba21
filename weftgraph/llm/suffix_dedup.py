"""Suffix-array dedup: remove every byte inside a ``length``-byte string that also starts somewhere else.

A sparse suffix array is enough. Every window of ``length`` bytes has an anchor, the position with the smallest hash of
``gram`` bytes inside it; equal windows have equal anchors at equal offsets. So only anchored suffixes are sorted, one for about
``length / 2`` bytes, each with the bytes of all windows that it anchors, and only those whose gram occurs twice.

Splitters that Spark samples range-partition the anchored suffixes by their leading bytes, ties by what is
left of the anchor, then by document, so that no group of copies has to fit one task. Each bucket sorts its suffixes, and its reversed left
contexts, by multikey quicksort on 8-byte words. A window at offset o is a left context of o bytes and a suffix of
``length - o``: two windows are equal when both neighbourhoods are, which the LCP arrays tell. Classes that touch the
first or last suffix of a bucket may go on beyond it; their hashes are compared across all boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shingle_join import _BYTES, _ODD, _U, _packed, _powers, mix
from weftgraph.llm.text import text_or_empty
from weftgraph.plans.shared import materialize, null_safe_join

BUCKET = 20_000  # anchored suffixes that a bucket is planned for


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(raw.size + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * _powers(raw.size + 1)[0][: raw.size], out=sums[1:])
    return sums


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """For each start the smallest key of the ``width`` keys from there, by prefix and suffix minima of blocks."""
    n = keys.size - width + 1
    padded = np.full(-(-keys.size // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: keys.size] = keys
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[:n], after[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram's hash, first window, last window) of each anchor, in order."""
    if len(text) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint64), none, none
    raw = np.frombuffer(text, dtype=np.uint8)
    sums = prefix_sums(raw)
    h = mix((sums[gram:] - sums[:-gram]) * _powers(raw.size + 1)[1][: raw.size - gram + 1])
    keys = (h & _U(0xFFFFFFFF00000000)) | np.arange(h.size, dtype=np.uint64)
    at = (sliding_argmin(keys, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], at.size) - 1
    return at[first], h[at[first]], first, last


def words_of(parts: list[bytes]) -> np.ndarray:
    """Strings as rows of big-endian 8-byte words, filled up with zeros; words compare like the bytes do."""
    width = max(8, -(-max(map(len, parts), default=0) // 8) * 8)
    flat = b"".join(p.ljust(width, b"\0") for p in parts)
    return np.frombuffer(flat, dtype=">u8").reshape(-1, width // 8).astype(np.uint64)


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Multikey quicksort, breadth first: at each word all groups of still equal strings are partitioned at once."""
    m = words.shape[0]
    order, group = np.arange(m), np.zeros(m, dtype=np.int64)
    active = np.arange(m)  # places in the order whose group has other members
    for d in range(words.shape[1]):
        if active.size < 2:
            break
        values = words[order[active], d]
        way = np.lexsort((values, group[active]))
        order[active] = order[active][way]
        values, own = values[way], group[active]
        new = np.ones(active.size, dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (values[1:] != values[:-1])
        start = np.maximum.accumulate(np.where(new, active, 0))
        group[active] = start
        alone = new.copy()
        alone[:-1] &= new[1:]
        active = active[~alone]
    return order


def common_prefixes(words: np.ndarray) -> np.ndarray:
    """Bytes that each sorted string shares with the one before it (0 for the first), of the zero-filled strings."""
    out = np.zeros(words.shape[0], dtype=np.int64)
    if out.size > 1:
        differs = words[1:] != words[:-1]
        at = np.where(differs.any(axis=1), differs.argmax(axis=1), words.shape[1])
        inside = np.minimum(at, words.shape[1] - 1)
        rows = np.arange(out.size - 1)
        x = words[1:][rows, inside] ^ words[:-1][rows, inside]
        same = np.zeros(x.size, dtype=np.int64)
        for k in range(1, 8):
            same += (x >> _U(64 - 8 * k)) == 0
        out[1:] = np.where(at == words.shape[1], 8 * words.shape[1], 8 * at + same)
    return out


def solve_bucket(left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Least and largest repeated offset of each anchor (-1: none), and the windows to compare across boundaries.

    ``left`` is reversed; an anchor has the windows of offsets length - len(right) to len(left). Boundary windows are
    (anchor, offset, hash, times), one for each class of equal windows.
    """
    m = len(left)
    lw, rw = words_of(left), words_of(right)
    l_order, r_order = multikey_sort(lw), multikey_sort(rw)
    l_lcp, r_lcp = common_prefixes(lw[l_order]), common_prefixes(rw[r_order])
    low, high = length - np.array([len(x) for x in right]), np.array([len(x) for x in left])
    # Bytes shared with the bucket's first and last suffix: classes up to that depth may cross its boundaries.
    reach = np.zeros(m, dtype=np.int64)
    if m:
        down = np.minimum.accumulate(np.append(10**9, r_lcp[1:]))
        up = np.minimum.accumulate(np.append(10**9, r_lcp[1:][::-1]))[::-1]
        reach[r_order] = np.maximum(down, up)
    least, most = np.full(m, -1), np.full(m, -1)
    edge: list[tuple[np.ndarray, int, np.ndarray]] = []
    l_class, r_class = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for o in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if not own.size:
            continue
        l_class[l_order] = np.cumsum(l_lcp < o)
        r_class[r_order] = np.cumsum(r_lcp < length - o)
        key = l_class[own] * (m + 1) + r_class[own]
        way = np.argsort(key, kind="stable")
        k = key[way]
        new = np.ones(k.size, dtype=bool)
        new[1:] = k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        times = np.diff(np.append(starts, k.size))
        again = own[way][np.repeat(times > 1, times)]
        least[again] = np.where(least[again] < 0, o, least[again])
        most[again] = o
        heads = own[way][starts]
        touching = reach[heads] >= length - o
        if touching.any():
            edge.append((heads[touching], o, times[touching]))
    who = np.concatenate([e[0] for e in edge]) if edge else np.zeros(0, dtype=np.int64)
    offset = np.concatenate([np.full(e[0].size, e[1]) for e in edge]) if edge else who
    times = np.concatenate([e[2] for e in edge]) if edge else who
    hashes = np.zeros(who.size, dtype=np.uint64)
    order = np.argsort(who, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(who[order])) + 1) if who.size else []:
        i = who[own[0]]
        raw = np.frombuffer(left[i][::-1] + right[i], dtype=np.uint8)
        sums, start = prefix_sums(raw), len(left[i]) - offset[own]
        h = (sums[start + length] - sums[start]) * _powers(raw.size + 1)[1][start]
        hashes[own] = mix(h ^ mix(offset[own].astype(np.uint64) + _ODD))
    return least, most, (who, offset, hashes, times)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 32, slots: int = 1 << 24) -> DataFrame:
    """Each row of ``docs`` as id, kept binary (its UTF-8 bytes without the removed ones), n_bytes, n_removed, n_spans, spans.

    A byte goes when a ``length``-byte string that covers it starts at another place too, of the same row or another.
    Strings are judged on the input. Defined cases: a null text is empty; texts under ``length`` bytes stay whole; repeated rows are
    repeats of each other; a null id is passed on; an empty table gives no rows; other columns are ignored. A text may be of any
    length; one that repeats itself in periods of few bytes has an anchor for each period.

    Grams that occur twice are marked in a bitmap of ``slots`` bits, of fixed size: a chance hit costs a row, none is lost.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).cast("binary").alias("__text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(x, length, gram)[1] for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))] if found else [pa.array([], pa.int64())], names=["f"])

    twice = rows.select("__text").mapInArrow(grams, "f long").groupBy("f").count().filter("count > 1")
    marks = twice.select(F.expr(f"cast(pmod(f, {slots}) div 8 as int)").alias("byte"), F.expr("shiftleft(1, cast(pmod(f, 8) as int))").alias("bit")).groupBy("byte").agg(F.bit_or("bit").cast("int").alias("bits")).toPandas()
    bitmap = np.zeros(slots // 8, dtype=np.uint8)
    bitmap[marks["byte"].to_numpy(dtype=np.int64)] = marks["bits"].to_numpy(dtype=np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)
    id_type = rows.schema["__id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            ids, hs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, text in enumerate(b.column(2).to_pylist()):
                at, f, first, last = anchors(text, length, gram)
                place = (f.view(np.int64) % slots).astype(np.int64)
                live = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                if live.size:
                    k = live.size
                    lefts = [text[s:p][::-1] for s, p in zip(first[live], at[live], strict=True)]
                    rights = [text[p : e + length] for p, e in zip(at[live], last[live], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * k, b.column(0).type), pa.array([hs[i]] * k, pa.int64()), pa.array(at[live]), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], names=["__id", "h", "at", "l", "r"])

    block_rows = materialize(rows.select("__id", F.xxhash64("__text").alias("h"), "__text").mapInArrow(_packed(blocks, 2000), f"__id {id_type}, h long, at long, l binary, r binary"), "suffixes")
    buckets = max(parts, block_rows.count() // BUCKET + 1)
    ranged = block_rows.repartitionByRange(buckets, "r", "l", "__id", "at")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        ids, h, at = t.column(0), t.column(1), t.column(2).to_numpy()
        least, most, (who, offset, hashes, times) = solve_bucket(t.column(3).to_pylist(), t.column(4).to_pylist(), length)
        hit = np.flatnonzero(most >= 0)
        for pick, start, end, key, n in ((hit, at[hit] - most[hit], at[hit] - least[hit] + length, None, None), (who, at[who] - offset, at[who] - offset + length, hashes, times)):
            for a in range(0, pick.size, 50_000):
                z = slice(a, a + 50_000)
                p = pa.array(pick[z])
                size = len(p)
                keys = pa.nulls(size, pa.int64()) if key is None else pa.array(key[z].view(np.int64))
                yield pa.Table.from_arrays([ids.take(p), h.take(p), pa.array(start[z]), pa.array(end[z]), keys, pa.nulls(size, pa.int64()) if n is None else pa.array(n[z])], names=["__id", "h", "start", "end", "key", "times"]).combine_chunks().to_batches()[0]

    found = materialize(ranged.mapInArrow(solve, f"__id {id_type}, h long, start long, end long, key long, times long"), "repeats")
    edge = found.filter("key is not null")
    crossing = edge.groupBy("key").agg(F.sum("times").alias("all"), F.count("*").alias("buckets")).filter("buckets > 1").select("key")
    spans = found.filter("key is null").unionByName(edge.filter("times = 1").join(crossing, "key", "left_semi"), allowMissingColumns=True)
    spans = spans.groupBy("__id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = null_safe_join(rows.select("__id", F.xxhash64("__text").alias("h"), "__text"), spans, ["__id", "h"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                kept, total, gone, spans_out = [], [], [], []
                for text, found_spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    merged: list[list[int]] = []
                    for s in sorted((s["start"], s["end"]) for s in found_spans or ()):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                    at, pieces = 0, []
                    for s, e in merged:
                        pieces.append(text[at:s])
                        at = e
                    kept.append(b"".join([*pieces, text[at:]]))
                    total.append(len(text))
                    gone.append(len(text) - len(kept[-1]))
                    spans_out.append(merged)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) for s in spans_out], pa.int64()), pa.array(spans_out, pa.list_(pa.list_(pa.int64())))], names=["__id", "kept", "n_bytes", "n_removed", "n_spans", "spans"])

    out = whole.select("__id", "__text", "spans").mapInArrow(cut, f"__id {id_type}, kept binary, n_bytes long, n_removed long, n_spans long, spans array<array<long>>")
    return out.withColumnRenamed("__id", id_col)
