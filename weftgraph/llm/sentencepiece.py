"""SentencePiece encoding and decoding by a streaming Viterbi with a bounded window.

For every character boundary the lattice keeps the surviving path that ends there. Only the next
``longest piece`` boundaries can hold survivors, so the window is a ring of that size: a boundary leaves it once it has been extended, and
what it knew lives on only as the backpointers of survivors. When the ways of all survivors pass through one boundary the
ids before that boundary are final and are committed. Text is read character by character, a stretch at a time.

A unigram model's survivor is the path with the best sum of scores. A BPE model's survivor is
the one whose last two pieces merging itself would leave apart: a piece sequence is the model's encoding exactly when
each neighbouring pair is, so every boundary has one valid last piece, and the path ids equal the library's.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as pb

from weftgraph.llm.text import small_parts, text_or_empty

SPACE = "▁"
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]*")
#: What a worker keeps: words and parts of words in two halves each, of which a full one replaces the older; pairs and growths, which start anew. A bound on memory, not on results.
MEMO_WORDS, MEMO_PARTS, MEMO_PAIRS, MEMO_GROWTH = 60_000, 150_000, 200_000, 60_000
#: Groups of characters that are told apart where a word is cut; more are taken as one.
MEMO_KINDS = 32
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
DONE = float("-inf")


class Recent(dict):
    """Ids by text, of the texts that were asked for last: between ``most`` and twice as many."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make, self.older = most, make, {}

    def __missing__(self, text: str) -> bytes:
        known = self.older.get(text)
        if known is None:
            known = self.make(text)
        if len(text) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[text] = known
        return known


def cuts(names: Iterable[str]) -> re.Pattern:
    """Finds the parts of a word between which no piece reaches: neighbours in a piece are of one kind, and characters of two kinds never are neighbours in one."""
    kind: dict[str, str] = {}

    def top(c: str) -> str:
        while kind.setdefault(c, c) != c:
            kind[c] = c = kind[kind[c]]
        return c

    for name in names:
        own = name.lstrip(SPACE)
        for a, b in zip(own, own[1:], strict=False):
            kind[top(a)] = top(b)
    groups: dict[str, list[str]] = {}
    for c in sorted(kind):
        groups.setdefault(top(c), []).append(c)
    sets = sorted(("".join(map(re.escape, g)) for g in groups.values()), key=len, reverse=True)
    sets = [*sets[:MEMO_KINDS], *(["".join(sets[MEMO_KINDS:])] if sets[MEMO_KINDS:] else [])]
    return re.compile("|".join([*(f"[{s}]+" for s in sets), "."]), re.DOTALL)


class Model:
    """Pieces of a model file, read from its bytes."""

    def __init__(self, data: bytes):
        proto = pb.ModelProto()
        proto.ParseFromString(data)
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with identity normalisation that keep white space are supported")
        self.bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.names = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
        self.scores = [p.score for p in proto.pieces]
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.longest = max(map(len, self.ids))
        self.worst = min(self.scores) - 10.0
        #: What a piece can start with, and the piece's id if it is one itself, else -1.
        self.heads: dict[str, int] = {}
        for name in self.ids:
            for k in range(1, len(name)):
                self.heads.setdefault(name[:k], -1)
            self.heads[name] = self.ids[name]
        #: Piece id (else -1) and what may follow, by character.
        self.tree: dict[str, tuple[int, dict]] = {}
        for name, k in sorted(self.heads.items()):
            at = self.tree
            for c in name[:-1]:
                at = at[c][1]
            at[name[-1]] = (k, {})
        #: A piece with a space mark after another character would let words run into each other.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.lengths = list(map(len, self.names))
        self.none = -1  # as if a character without a piece stood before the text
        self.surface = [bytes([int(n[3:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == 3 else n.encode() for n, k in zip(self.names, self.kinds, strict=True)]
        self.cuts = cuts(self.ids)
        self.words, self.parts = Recent(MEMO_WORDS, self.word), Recent(MEMO_PARTS, lambda part: encode_stretch(self, part))
        self.pairs: dict[int, bool] = {}
        self.grown: dict[int, tuple[list[float], list[str], list[str]]] = {}

    def word(self, w: str) -> bytes:
        """Ids of a word after a space mark. A BPE model merges nothing across a cut, so each part is encoded by itself."""
        if not self.bpe:
            return encode_stretch(self, SPACE + w)
        first, *rest = self.cuts.findall(w)
        parts = self.parts
        return b"".join([parts[SPACE + first], *[parts[x] for x in rest]])

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces ``a`` and ``b``, side by side, as they are.

        Each grows by itself, merge by merge, until a merge across their border would come first.
        """
        if (known := self.pairs.get(a << 32 | b)) is not None:
            return known
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        (own, ends, _), (other, _, begins) = self.growth(a), self.growth(b)
        i = j = 0
        while True:
            here, there = own[i], other[j]
            k = self.ids.get(ends[i] + begins[j])
            if k is not None and self.scores[k] > here and self.scores[k] >= there:
                known = False
                break
            if here == there == DONE:
                known = True
                break
            if here >= there:
                i += 1
            else:
                j += 1
        self.pairs[a << 32 | b] = known
        return known

    def growth(self, k: int) -> tuple[list[float], list[str], list[str]]:
        """How a piece comes about from its characters: the score of each next merge (DONE after the last), and the
        piece at its right and at its left end before it. The best merge comes first, of equals the leftmost."""
        if (known := self.grown.get(k)) is None:
            parts = list(self.names[k])
            merges, ends, begins = [], [parts[-1]], [parts[0]]
            while True:
                best, at = DONE, -1
                for i in range(len(parts) - 1):
                    if (m := self.ids.get(parts[i] + parts[i + 1])) is not None and self.scores[m] > best:
                        best, at = self.scores[m], i
                merges.append(best)
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                ends.append(parts[-1])
                begins.append(parts[0])
            if len(self.grown) >= MEMO_GROWTH:
                self.grown.clear()
            known = self.grown[k] = (merges, ends, begins)
        return known


Way = tuple  # (last piece, the way before it or None)


def ids_of(way: Way | None) -> list[int]:
    out = []
    while way is not None:
        out.append(way[0])
        way = way[1]
    return out[::-1]


def common_way(ways: list[Way]) -> Way | None:
    """The longest way that all of ``ways`` go on from."""
    shared: dict[int, Way] = {}
    way: Way | None = ways[0]
    while way is not None:
        shared[id(way)] = way
        way = way[1]
    for way in ways[1:]:
        met = set()
        while way is not None:
            met.add(id(way))
            way = way[1]
        shared = {k: w for k, w in shared.items() if k in met}
    return next(iter(shared.values()), None)  # they come from the latest to the first


def stream(model: Model, text: str) -> Iterator[int]:
    """Piece ids of ``text`` (-1 - code point for a character without a piece), committed as soon as all survivors agree.

    ``ring`` holds the survivors of the next ``longest`` boundaries, the window; at each boundary where no survivor jumps ahead, its way is the only one and is
    committed. Where that doesn't happen for long, the survivors' common way is.
    """
    n, ids, heads, longest, bpe, scores, worst = len(text), model.ids, model.heads, model.longest, model.bpe, model.scores, model.worst
    pairs = model.pairs if bpe else {}
    size = longest + 1
    ring: list[Way | None] = [None] * size
    best = [0.0] * size
    before, way, value = model.none, None, 0.0  # the survivor at the boundary that is extended
    far = start = 0  # the farthest boundary with a survivor; the one committed last
    for s in range(n):
        if s:
            way = ring[s % size]
            if way is None:
                continue
            ring[s % size] = None
            before, value = way[0], best[s % size]
            if far == s:  # all survivors meet here
                yield from ids_of(way)
                start, way = s, None
            elif s - start > 4 * longest:
                ways = [w for w in (way, *ring) if w is not None]
                shared = common_way(ways)
                if shared is not None:
                    done = ids_of(shared)
                    yield from done
                    cut: dict[int, Way | None] = {id(shared): None}
                    way, ring = _after(way, cut), [w and _after(w, cut) for w in ring]
                start = s
        for e in range(s + 1, min(n, s + longest) + 1):
            if (k := heads.get(text[s:e])) is None:
                break
            if k < 0:
                continue
            at = e % size
            if bpe:
                if ring[at] is None:
                    if before >= 0 and (ok := pairs.get(before << 32 | k)) is not True and (ok is False or not model.apart(before, k)):
                        continue
                    ring[at] = (k, way)
                    far = e if e > far else far
            elif ring[at] is None or value + scores[k] > best[at]:
                ring[at], best[at] = (k, way), value + scores[k]
                far = e if e > far else far
        at = (s + 1) % size
        if text[s] not in ids and (ring[at] is None or not bpe and value + worst > best[at]):
            ring[at], best[at] = (-1 - ord(text[s]), way), value + worst
            far = s + 1 if s + 1 > far else far
    if n:
        yield from ids_of(ring[n % size])


def window(model: Model, text: str) -> list[int]:
    """What ``stream`` gives for a BPE model and a stretch no longer than its window: no boundary leaves it, so survivors are kept by place instead of in a ring."""
    n, tree, pair = len(text), model.tree, model.pairs.get
    last: list[int | None] = [None] * (n + 1)  # the survivor's last piece at each boundary, and where it starts
    back = [0] * (n + 1)
    before: int | None = model.none
    ids = model.ids
    for s in range(n):
        if s and (before := last[s]) is None:
            continue
        kids, e = tree, s
        for c in text[s:]:
            if c not in kids:
                break
            k, kids = kids[c]
            e += 1
            if k >= 0 and last[e] is None and (before < 0 or (ok := pair(before << 32 | k)) or ok is None and model.apart(before, k)):
                last[e], back[e] = k, s
        if last[s + 1] is None and text[s] not in ids:
            last[s + 1], back[s + 1] = -1 - ord(text[s]), s
    out = []
    while n:
        out.append(last[n])
        n = back[n]
    return out[::-1]


def _after(way: Way, cut: dict[int, Way | None]) -> Way | None:
    """``way`` without its beginning up to the way in ``cut``; equal ways stay one."""
    todo = []
    at: Way | None = way
    while at is not None and id(at) not in cut:
        todo.append(at)
        at = at[1]
    rest = cut[id(at)] if at is not None else None
    for x in reversed(todo):
        rest = (x[0], rest)
        cut[id(x)] = rest
    return rest


def encode_stretch(model: Model, text: str) -> bytes:
    """Ids of a stretch, as the bytes of 32-bit numbers."""
    out = array("i")
    if model.bpe and len(text) <= model.longest:
        found = window(model, text)
        if found and min(found) >= 0:
            return array("i", found).tobytes()
    else:
        found = stream(model, text)
    for k in found:
        if k >= 0:
            out.append(k)
        elif model.bytes:
            out.extend([model.bytes[b] for b in chr(-1 - k).encode("utf-8", "surrogatepass")])
        else:
            out.append(model.unknown)
    return out.tobytes()


def encode_bytes(model: Model, text: str) -> bytes:
    if not text:
        return b""
    if not model.by_word:
        return encode_stretch(model, (SPACE if model.prefix else "") + text.replace(" ", SPACE))
    # No piece crosses from another character to a space mark: all paths converge there, and equal stretches have equal ids.
    if model.prefix and SPACE not in text and "" not in (words := text.split(" ")):
        return b"".join(map(model.words.__getitem__, words))
    text = (SPACE if model.prefix else "") + text.replace(" ", SPACE)
    return b"".join(encode_stretch(model, x) for x in _STRETCH.findall(text))


def encode(model: Model, text: str) -> list[int]:
    """Ids of a text, as the library gives them."""
    return array("i", encode_bytes(model, text)).tolist()


def decode_stream(model: Model, ids: Iterable[int], at_once: int = 4096) -> Iterator[str]:
    """The text of ``ids``, piece by piece, at most ``at_once`` ids at a time; bytes of a character may come in several parts."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    first, source = model.prefix, iter(ids)
    while part := list(islice(source, at_once)):
        text = reader.decode(b"".join(map(model.surface.__getitem__, part))).replace(SPACE, " ")
        if first and text:
            text, first = text.removeprefix(" "), False
        yield text
    yield reader.decode(b"", True)


def decode(model: Model, ids: Iterable[int]) -> str:
    return "".join(decode_stream(model, ids))


_LOADED: dict[str, Model] = {}


def load(data: bytes) -> Model:
    """One model for each worker process, however many tasks it runs."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Model(data)
    return _LOADED[key]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` as id, ids array<int>, round_trip (whether decoding gives back the text).

    The driver reads the model file; its bytes, of fixed size, go to the workers in a broadcast. Defined cases: a null or
    empty text has no ids; characters without a piece become byte pieces (or the unknown id); a space mark in the text itself decodes as a
    space, so round_trip is false there; very long texts and words pass through the bounded window; repeated rows are each encoded; an empty
    table gives no rows; other columns are ignored.
    """
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    schema = T.StructType([rows.schema["__id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for batch in batches:
            for first, texts in small_parts(batch.column(1)):
                ids, same = [], []
                for text in texts:
                    ids.append(encode_bytes(model, text))
                    same.append(decode(model, array("i", ids[-1])) == text)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lists, pa.array(same, pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
