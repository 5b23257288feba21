"""Language ID: scripts narrow the candidates, a Viterbi over word scores labels spans of mixed text.

A word's score for a language is the log-probability of its byte trigrams there. A path over the words of
a text pays a penalty whenever it changes language; the best path gives the spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.text import small_parts, text_or_empty

UNDETERMINED = "und"
#: Hash slots of trigrams, script classes, and bytes that are scored together.
SLOTS, SCRIPTS, TOGETHER = 1 << 16, 32, 1 << 18


# First code points of the ranges of Unicode that are told apart, and their class; 0 is no letter, or a letter of no script.
_RANGES = (
    (0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x2B0, 0),  # Latin
    (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 7), (0x750, 6), (0x780, 7), (0x870, 6),  # Greek, Cyrillic, Armenian, Hebrew, Arabic, Syriac and others
    (0x900, 8), (0x980, 9), (0xA00, 10), (0xA80, 11), (0xB00, 12), (0xB80, 13), (0xC00, 14), (0xC80, 15), (0xD00, 16), (0xD80, 17), (0xE00, 18), (0xE80, 19), (0xF00, 20), (0x1000, 21),  # Devanagari to Tibetan, Myanmar
    (0x10A0, 22), (0x1100, 23), (0x1200, 24), (0x13A0, 25), (0x1780, 26), (0x1800, 27), (0x18B0, 25), (0x1C80, 3), (0x1C90, 22), (0x1CC0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),  # Georgian, Hangul, Ethiopic, Khmer, Mongolian, more Latin and Greek
    (0x2C60, 1), (0x2C80, 0), (0x2DE0, 3), (0x2E00, 0), (0x3040, 28), (0x30A0, 29), (0x3100, 0), (0x3130, 23), (0x3190, 0), (0x3400, 30), (0x4DC0, 0), (0x4E00, 30), (0xA000, 25), (0xA640, 3), (0xA6A0, 25),  # Kana, Han, Yi
    (0xA720, 1), (0xA800, 25), (0xAC00, 23), (0xD800, 0), (0xF900, 30), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFEFF, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 29), (0xFFA0, 23), (0xFFE0, 0),
    (0x10000, 31), (0x1D000, 0), (0x20000, 30), (0x32000, 0),  # old scripts, marks and pictures, rare Han
)
_FROM = np.array([x for x, _ in _RANGES])
_CLASS = np.array([c for _, c in _RANGES], dtype=np.uint8)
#: Class of each character that UTF-8 writes with one or two bytes, by its code point.
_NEAR = _CLASS[np.searchsorted(_FROM, np.arange(0x800), side="right") - 1]


def scripts_of(raw: np.ndarray) -> np.ndarray:
    """The script class of the character that begins at each byte of UTF-8 texts; 0 at other bytes and for characters of no script, such as pictures."""
    out = np.where(raw < 0x80, _NEAR[raw & 0x7F], 0).astype(np.uint8)
    for lead, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        at = np.flatnonzero((raw >= lead) & (raw < (0xE0, 0xF0, 0xF8)[more - 1]))
        at = at[at + more < raw.size]
        code = (raw[at] & mask).astype(np.int64)
        for k in range(1, more + 1):
            code = code << 6 | (raw[at + k] & 0x3F)
        out[at] = _CLASS[np.searchsorted(_FROM, code, side="right") - 1]
    return out


_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Words:
    """Words of some texts, one after the other; slots and counted are for each byte."""

    slots: np.ndarray
    counted: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    scripts: np.ndarray
    first: np.ndarray
    code_points: np.ndarray
    offsets: np.ndarray


def split_words(texts: list[bytes]) -> Words:
    """Fold letters, find words and hash the trigrams that end at each of their bytes and right after them."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    x = _FOLD[raw]
    x[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)] += 0x20
    scripts = scripts_of(raw)
    lead = np.flatnonzero((raw >= 0xC2) & (scripts == 0) & (raw != 0xCC) & (raw != 0xCD))  # those two lead accents, which belong to their words
    for k in range(4):  # pictures and marks stand between words, as ASCII ones do
        own = lead[raw[lead] >= (0, 0, 0xE0, 0xF0)[k]] + k
        x[own[own < x.size]] = 32
    letter = x != 32
    before = np.zeros_like(letter)
    before[1:] = letter[:-1]
    starts = np.flatnonzero(letter & ~before)
    x1 = np.full(x.size, 32, dtype=np.uint32)
    x1[1:] = x[:-1]
    x2 = np.full(x.size, 32, dtype=np.uint32)
    x2[2:] = x[:-2]
    x2[~before] = 32
    slots = ((x2 << np.uint32(16) | x1 << np.uint32(8) | x) * np.uint32(2654435761)) >> np.uint32(16)
    code_points = np.cumsum((raw & 0xC0) != 0x80)
    if starts.size:
        sizes = np.add.reduceat(letter, starts, dtype=np.int64)
        scripts = main_scripts(scripts, starts)
    else:
        sizes, scripts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    return Words(slots, letter | before, starts, sizes, scripts, np.searchsorted(starts, offsets), code_points, offsets)


def main_scripts(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of most characters of each word, the first class of equals; 0 if it has characters of no script only."""
    at = np.flatnonzero(classes)
    word = np.searchsorted(starts, at, side="right") - 1
    key, n = np.unique(word * SCRIPTS + classes[at], return_counts=True)
    order = np.lexsort((key, -n, key // SCRIPTS))
    key = key[order]
    first = np.flatnonzero(np.diff(key // SCRIPTS, prepend=-1))
    out = np.zeros(starts.size, dtype=np.uint8)
    out[key[first] // SCRIPTS] = key[first] % SCRIPTS
    return out


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # languages x slots
    allowed: np.ndarray  # scripts x languages
    usual: int = 0  # the language that most was learned of


def pieces_of(text: bytes) -> list[bytes]:
    """A text in pieces of about TOGETHER bytes, cut before a blank; a longer word is cut between characters."""
    out, a = [], 0
    while len(text) - a > TOGETHER:
        b = max(text.rfind(x, a + 1, a + TOGETHER) for x in (b" ", b"\n"))
        if b < 0:
            b = a + TOGETHER
            while text[b] & 0xC0 == 0x80:
                b -= 1
        out.append(text[a:b])
        a = b
    out.append(text[a:] if a else text)
    return out


def _parts(pieces: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of pieces that are worked on together: what this takes doesn't grow with texts or batches."""
    a = size = 0
    for b, t in enumerate(pieces):
        if size and size + len(t) > TOGETHER:
            yield a, b
            a, size = b, 0
        size += len(t)
    if pieces:
        yield a, len(pieces)


def learn(labelled: DataFrame, lang_col: str, text_col: str, alpha: float = 0.5, least_share: float = 0.005) -> Model:
    """Count trigrams and scripts of every labelled text; each task sums its own and Spark sums the tasks'.

    What reaches the driver is one row for each language and slot, whatever the number of texts.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for first, texts in small_parts(batch.column(1)):
                langs = np.array(batch.column(0).slice(first, len(texts)).to_pylist(), dtype=object)
                for lang in set(langs):
                    own = [p for i in np.flatnonzero(langs == lang) for p in pieces_of(texts[i])]
                    total = sums.setdefault(lang, np.zeros(SLOTS + SCRIPTS, dtype=np.int64))
                    for a, b in _parts(own):
                        w = split_words(own[a:b])
                        total[:SLOTS] += np.bincount(w.slots[w.counted], minlength=SLOTS)
                        total[SLOTS:] += np.bincount(w.scripts, minlength=SCRIPTS)
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * some.size, pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], names=schema.names)

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(count, schema).groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), SLOTS + SCRIPTS))
    counts[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int), found["slot"].to_numpy()] = found["n"].to_numpy()
    grams, scripts = counts[:, :SLOTS] + alpha, counts[:, SLOTS:]
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
    allowed = (scripts >= least_share * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T
    allowed[~allowed.any(axis=1)] = True  # a script nobody writes rules nobody out
    allowed[0] = True  # nor do characters of no script
    return Model(langs, logp, allowed, int(grams.sum(axis=1).argmax()) if langs else 0)


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word (rows) on the path with the best sum of scores less penalties."""
    n, k = scores.shape
    top = int(scores.sum(axis=0).argmax())
    # If no stretch gains more than half a penalty in any other language, no change pays: a path of m stretches,
    # even one that never has the top language, gains at most m / 2 penalties and pays m - 1.
    gain = np.zeros((n + 1, k))
    np.cumsum(scores - scores[:, top : top + 1], axis=0, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(n, top)
    back = np.empty((n, k), dtype=np.int16)
    value, own = scores[0].astype(float), np.arange(k)
    for i in range(1, n):
        lead = int(value.argmax())
        moved = value[lead] - penalty
        change = value < moved
        back[i] = np.where(change, lead, own)
        value = np.where(change, moved, value) + scores[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = value.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def scored_texts(model: Model, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each text the scores, sizes and first code points of its words, and its code points."""
    k = len(model.langs)
    pieces = [(i, p) for i, t in enumerate(texts) for p in pieces_of(t)]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    length = 0
    for a, b in _parts([p for _, p in pieces]):
        w = split_words([p for _, p in pieces[a:b]])
        scores = np.empty((w.starts.size, k), dtype=np.float32)
        for j in range(k):
            if w.starts.size:
                scores[:, j] = np.add.reduceat(np.where(w.counted, model.logp[j][w.slots], np.float32(0)), w.starts)
        if not model.allowed.all():
            scores[~model.allowed[w.scripts]] -= 1e4
        for n in range(b - a):
            lo, hi = w.first[n], w.first[n + 1]
            origin = w.code_points[w.offsets[n]] - 1
            held.append((scores[lo:hi], w.sizes[lo:hi], w.code_points[w.starts[lo:hi]] - 1 - origin + length))
            length += int(w.code_points[w.offsets[n + 1] - 1] - 1 - origin)
            i = pieces[a + n][0]
            if a + n + 1 == len(pieces) or pieces[a + n + 1][0] != i:
                yield *(held[0] if len(held) == 1 else (np.concatenate(x) for x in zip(*held, strict=True))), length
                held, length = [], 0


def label(model: Model, texts: list[bytes], penalty: float) -> Iterator[tuple[int, float, list[tuple[int, int, int]], float]]:
    """For each text the language's number (-1: none), its score, its spans (start, end, language) in code points, and how
    certain these are: the mean of each span's probability in its own language, by letters."""
    k = len(model.langs)
    for text, (own, sizes, starts, length) in zip(texts, scored_texts(model, texts), strict=True):
        if not k or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            yield -1, 0.0, [], 0.0
            continue
        if not sizes.size:  # letters of no script that is told apart
            yield model.usual, 1 / k, [(0, length, model.usual)], 1 / k
            continue
        path = best_path(own, penalty)
        weight = np.bincount(path, weights=sizes, minlength=k)
        lang = int(weight.argmax())
        total = own[path == lang].sum(axis=0, dtype=float)
        sure = 1 / np.exp(np.minimum(total - total[lang], 700)).sum()
        cuts = np.flatnonzero(np.diff(path)) + 1
        at = [0, *(int(starts[c]) for c in cuts), length]
        spans = [(at[c], at[c + 1], int(path[x])) for c, x in enumerate([0, *cuts])]
        certain = sure
        if cuts.size:
            firsts = np.array([0, *cuts])
            totals = np.add.reduceat(own, firsts, axis=0, dtype=float)
            told = totals[np.arange(firsts.size), path[firsts]]
            certain = (np.add.reduceat(sizes, firsts) / np.exp(np.minimum(totals - told[:, None], 700)).sum(axis=1)).sum() / weight.sum()
        yield lang, float(min(1.0, sure * weight[lang] / weight.sum())), spans, float(certain)


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 15.0) -> DataFrame:
    """Each row of ``docs`` as id, lang_pred, score, spans array<struct<start, end, lang>> (code points, end exclusive).

    lang_pred has most letters of the best path, score is its share of them times its probability there. Defined cases: a
    null text, or one without a letter, is ``und`` with score 0 and no spans; so is every text if no language
    was learned; a script that no language was learned in leaves all languages; repeated rows are each labelled; ties go
    to the language that sorts first; a text whose letters are all of scripts that aren't told apart gets the language most was learned of, with score 1 / languages;
    very long texts are scored piece by piece and labelled whole; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).cast("binary").alias("__text"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([rows.schema["__id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = [*m.langs, UNDETERMINED]
        for batch in batches:
            found = [f for _, texts in small_parts(batch.column(1)) for f in label(m, texts, penalty)]
            spans = [[{"start": s, "end": e, "lang": names[x]} for s, e, x in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[f[0]] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, arrow_span)], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def learn_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all labelled documents outside the held-out fold."""
    return learn(docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)), lang_col, text_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang", least_score: float = 0.3, penalty: float = 15.0) -> DataFrame:
    """The rows of ``docs``, with its columns, whose spans are told with at least ``least_score``, whatever share a language has; a null ``lang_col`` gets that of most letters.

    Rows are filtered where they are read, nothing is shuffled. A text without a letter goes. Null ids, repeated rows and other
    columns, whatever their names, pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [f for _, texts in small_parts(pc.fill_null(batch.column(at), "").cast(pa.binary())) for f in label(m, texts, penalty)]
            columns = batch.columns
            if lang_col:
                columns[lang_at] = pa.array([old if old is not None or f[0] < 0 else m.langs[f[0]] for old, f in zip(batch.column(lang_at).to_pylist(), found, strict=True)], pa.string()).cast(batch.column(lang_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([f[0] >= 0 and f[3] >= least_score for f in found], pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots can't pass
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
