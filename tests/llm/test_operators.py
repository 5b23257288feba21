"""Each operator on small tables against a plain version of its definition: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftgraph.llm import exact_dedup, language, line_dedup, lm, mixing, pii, quality, sentencepiece, shingle_join, suffix_dedup

WS = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string, size string, h string, target string"
MODEL = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "k", "i", "s", "h", "t") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    line = "This line stands in very many documents."
    base = prose(rng, 120)
    out = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n\x0b\x0c\r ", "en", "a"), (3, "one", None, "b"), (4, "ONE  ", "en", "b"), (5, "a b c", "en", None)]
    out += [(10 + i, base, "en", "a") for i in range(6)]
    out += [(20 + i, base.replace(" ", "\n", i + 1), "en", "a") for i in range(3)]
    words = base.split()
    out += [(30 + i, " ".join([*words[:60], f"x{i}", *words[61:]]), "en", "a") for i in range(4)]
    out += [(40 + i, f"{line}\n{prose(rng, 60)}\n {line.upper()}\t\nend {i}", "en", ["a", "b", None][i % 3]) for i in range(9)]
    out += [(60, prose(rng, 6000), "de", "c"), (61, base + " " + prose(rng, 300), "de", "c"), (62, prose(rng, 90) + base, "de", "c"), (63, "日本語のテキスト 🙂 é", None, "d")]
    out += [(70, "repeated row of some words here", "en", "a")] * 2 + [(None, "no id at all", "en", "a"), (None, base, "en", "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [(0, "", "", "")]).filter("doc_id < 0")


def test_exact_dedup(docs, rows, none):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[WS.sub(" ", t or "")].append(i)
    got = exact_dedup.exact_dedup(docs, digests=True, prefix_chars=8, slots=64).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        own = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(own) and r["keep_id"] == min((x for x in own if x is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0


def line_rule(rows):
    holders = defaultdict(set)
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(-1 if i is None else i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == (-1 if i is None else i)]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def test_line_dedup(docs, rows, none):
    got = [tuple(r) for r in line_dedup.line_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(line_rule(rows), key=str)
    assert line_dedup.line_dedup(none).count() == 0


def test_mixing(spark, docs, rows, none):
    plan, pieces = mixing.mix_sources(docs, block=8, slots=64)
    got = mixing.taken_words(plan, pieces).collect()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len([w for w in WS.split(t or "") if w])
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(size.values())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[s] for s in fixed)
        level = rest / sum(weight[s] for s in order if s not in fixed)
        over = {s for s in order if s not in fixed and level * weight[s] > 2 * size[s]}
        if not over:
            break
        fixed |= over
    want = {s: 2.0 * size[s] if s in fixed else level * weight[s] for s in order}
    plan_rows = plan.collect()
    for r in plan_rows:
        assert r["source_size"] == size[r["__source"]] and r["target"] == pytest.approx(want[r["__source"]])
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken = Counter()
    for r in pieces.collect():
        taken[r["__source"]] += r["word_to"] - r["word_from"]
    assert sum(taken.values()) == pytest.approx(total, rel=0.05)
    again = mixing.taken_words(*mixing.mix_sources(docs, block=8, slots=64)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    texts = mixing.mixed_texts(docs, pieces)
    assert texts.columns == docs.columns
    assert sum(len([w for w in WS.split(r["text"]) if w]) for r in texts.collect()) >= sum(taken.values()) - 2 * 12
    assert mixing.taken_words(*mixing.mix_sources(none)).count() == 0


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), "seed").alias("x")).collect()
        assert sorted(r[0] for r in got) == list(range(n))


def test_pii(spark, docs, rows, none):
    text = "é bob.x@mail.example.com, 1.2.3.4 and 4041 8949 7460 8795 or +1 (988) 555-2485; 1.2.3.999 4041894974608790"
    base = pii.find_spans(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in base] == [("email", "bob.x@mail.example.com"), ("ip", "1.2.3.4"), ("card", "4041 8949 7460 8795"), ("phone", "+1 (988) 555-2485")]
    assert pii.hidden_spans(text, base) == []
    hidden = {
        "write to bob [at] mail [dot] example [dot] com now": "bob [at] mail [dot] example [dot] com",
        "call plus one nine eight eight five five five two four eight five ok": "plus one nine eight eight five five five two four eight five",
        "ip 10[.]2[.]3[.]4": "10[.]2[.]3[.]4",
        "mail bоb@exаmple.com": "bоb@exаmple.com",
        "＋１ (９８８) ５５５-２４８５": "＋１ (９８８) ５５５-２４８５",
        "é ann@e​x.org": "ann@e​x.org",
    }
    for t, want in hidden.items():
        assert [t[a:b] for a, _, b in pii.hidden_spans(t, pii.find_spans(t))] == [want], t
    for clean in ("the cat at home. one two. At last", "seven eight or nine ten", "dot by dot at it"):
        assert not pii.find_spans(clean) and not pii.hidden_spans(clean, [])
    got = pii.find_pii(table(spark, [(1, text, None, None), (2, None, None, None), (3, "", None, None), (1, text, None, None)])).collect()
    assert sorted(len(r["spans"]) for r in got) == [0, 0, 4, 4]
    assert pii.find_pii(docs).count() == len(rows) and pii.find_pii(none).count() == 0


def test_plain_emails_equal_the_pattern():
    rng = random.Random(3)
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    for _ in range(3000):
        t = "".join(rng.choice("ab.@- é%") for _ in range(rng.randint(0, 30)))
        assert [(a, b) for a, k, b in pii.find_spans(t) if k == 0] == [m.span() for m in pattern.finditer(t)], t


def language_rows():
    rng = random.Random(2)
    parts = {"en": ["the", "tion", "ing", "th", "of", "and"], "de": ["sch", "ung", "der", "und", "ein", "ich"], "ru": ["ни", "ство", "ов", "при", "что", "ая"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    return [(i, text(lang, rng.randint(5, 60)), lang, "s") for i in range(240) for lang in [["en", "de", "ru"][i % 3]]], text


def test_language(spark, none):
    rows, text = language_rows()
    docs = table(spark, rows)
    model = language.learn_held_out(docs)
    assert model.langs == ["de", "en", "ru"]
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    out = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in out) >= 0.95 * len(out)
    odd = table(spark, [(1, None, None, None), (2, "", None, None), (3, "123 %% 🙂", None, None), (4, "日本語", None, None), (5, text("en", 40) + "\n" + text("ru", 40) + " é", None, None), (5, "the of", None, None)])
    by = {}
    for r in language.identify(odd, model).collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 for i in (1, 2, 3)) and by[4][0]["lang_pred"] in model.langs and len(by[5]) == 2
    mixed = max(by[5], key=lambda r: len(r["spans"]))
    assert [s["lang"] for s in mixed["spans"]] == ["en", "ru", "en"] and mixed["spans"][0]["start"] == 0
    assert mixed["spans"][-1]["end"] == max(len(r["text"]) for r in odd.filter("doc_id = 5").collect())
    assert all(0 <= r["score"] <= 1 for rs in by.values() for r in rs)
    empty = language.learn_held_out(none)
    assert empty.langs == [] and {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    kept = language.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {4, 5} and kept.filter("lang is null").count() == 0


def test_best_path_equals_trying_all():
    rng = np.random.default_rng(0)
    from itertools import product

    for _ in range(60):
        n, k = int(rng.integers(1, 7)), 3
        s = rng.normal(0, 2, (n, k))
        value = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p[:-1], p[1:], strict=True))
        assert value(language.best_path(s, 1.5)) == pytest.approx(max(map(value, product(range(k), repeat=n))))


def repeats_rule(rows, length):
    count = Counter()
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, x in texts:
        count.update(x[s : s + length] for s in range(len(x) - length + 1))
    out = []
    for i, x in texts:
        gone = np.zeros(len(x) + 1, dtype=bool)
        for s in range(len(x) - length + 1):
            if count[x[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        out.append((i, kept, len(x), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())))
    return out


@pytest.mark.parametrize("bucket", [20_000, 5])
def test_suffix_dedup(spark, rows, none, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = random.Random(5)
    own = [*rows[:60], (80, "ab" * 150, None, None), (81, "q" * 130 + prose(rng, 20), None, None), (82, "q" * 90, None, None)]
    passage = prose(rng, 30)
    own += [(100 + i, prose(rng, rng.randint(0, 20)) + " " + passage[rng.randint(0, 20) :] + " " + prose(rng, 12), None, None) for i in range(25)]
    got = [(r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(table(spark, own), length=60, gram=12).collect()]
    assert sorted(got, key=str) == sorted(repeats_rule(own, 60), key=str)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_multikey_sort():
    rng = random.Random(0)
    parts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    words = suffix_dedup.words_of(parts)
    order = suffix_dedup.multikey_sort(words)
    padded = [p.ljust(32, b"\0") for p in parts]
    assert [padded[i] for i in order] == sorted(padded)
    lcp = suffix_dedup.common_prefixes(words[order])
    for k in range(1, 500):
        assert lcp[k] == len(os.path.commonprefix([padded[order[k - 1]], padded[order[k]]]))


def shingles(t, k):
    w = low(t or "")
    w = [x for x in WS.split(w) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups_rule(rows, k, percent):
    up = {i: i for i, *_ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t, k)) for i, t, *_ in rows if i is not None]
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in up}, sets


@pytest.mark.parametrize("tile", [2000, 8])
def test_jaccard_join(spark, rows, none, monkeypatch, tile):
    monkeypatch.setattr(shingle_join, "TILE", tile)
    rng = random.Random(9)
    near = prose(rng, 80).split()
    own = [*rows, *[(200 + i, " ".join([*near[: 70 - i], *[f"z{j}" for j in range(i)], *near[70:]]), None, None) for i in range(14)]]
    own += [(300 + i, prose(rng, rng.randint(1, 40), 5), None, None) for i in range(40)]
    own += [(400, " ".join(near), None, None), (400, prose(rng, 50), None, None)]
    want, sets = groups_rule(own, 4, 85)
    got = shingle_join.jaccard_components(table(spark, own)).collect()
    assert len(got) == len(own)
    sizes = Counter((i, len(s)) for i, s in sets)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]], r
            assert sizes[r["doc_id"], r["n_shingles"]]
    assert shingle_join.jaccard_components(none).count() == 0


def test_lm(spark, docs, rows, none):
    got = lm.score_documents(docs, head=20, outputs=8, batch=64, rounds=2, least_shards=2).collect()
    assert len(got) == len(rows)
    token = lambda t: [*(x for x in low(t or "").encode().split()), b" "]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in rows if not out(i) for w in token(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        w = token(t)
        want[i, out(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm.score_documents(none).count() == 0
    held = docs.filter("doc_id = 1")
    untrained = lm.score_documents(held, training=held["doc_id"] < 0).first()
    assert untrained["train_tokens"] == 0 and untrained["score"] == untrained["base_score"]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files here")
def test_sentencepiece(docs, rows, none):
    import sentencepiece as library

    model = sentencepiece.Model(open(MODEL, "rb").read())
    plain = library.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    texts = [" ".join([""] * 400 + ["a"]), "thing▁" * 300, "the\u2581" * 5 + "x" * 2000, "".join(rng.choice("thein") for _ in range(3000))]
    texts += ["".join(rng.choice("abcdeest \n\t  thinérñ日本🙂ing▁") for _ in range(rng.randint(0, 80))) for _ in range(600)] + ["x" * 500, "thing" * 90, "1" * 300, " ", "  a"]
    for t in texts:
        ids = sentencepiece.encode(model, t)
        assert ids == plain.encode(t), t
        if "▁" not in t:
            assert sentencepiece.decode(model, ids) == t
    got = sentencepiece.encode_documents(docs, MODEL).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(plain.encode(t or ""))) for i, t, *_ in rows)
    assert sentencepiece.encode_documents(none, MODEL).count() == 0


def test_unigram_stream_equals_whole_search():
    class Toy:
        bpe, longest, none, worst = False, 4, -1, -20.0
        names = ["a", "b", "ab", "ba", "aba", "bb", "abab"]
        ids = {x: i for i, x in enumerate(["a", "b", "ab", "ba", "aba", "bb", "abab"])}
        lengths = list(map(len, names))
        scores = [-1.0, -1.3, -1.9, -2.2, -2.4, -2.0, -3.9]
        heads = {x[:k]: -1 for x in ["a", "b", "ab", "ba", "aba", "bb", "abab"] for k in range(1, len(x) + 1)} | ids

    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        best = [0.0] + [-1e9] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(max(0, e - 4), e):
                if t[s:e] in Toy.ids:
                    best[e] = max(best[e], best[s] + Toy.scores[Toy.ids[t[s:e]]])
            best[e] = max(best[e], best[e - 1] + Toy.worst) if t[e - 1] not in Toy.ids else best[e]
        path = list(sentencepiece.stream(Toy, t))
        assert "".join(Toy.names[k] if k >= 0 else chr(-1 - k) for k in path) == t
        assert sum(Toy.scores[k] if k >= 0 else Toy.worst for k in path) == pytest.approx(best[-1])


def test_quality(docs, rows, none):
    got = quality.quality_rules(docs, line_docs=3, line_share=0.0).collect()
    assert len(got) == len(rows)

    def rule(t):
        t = t or ""
        w = [x for x in WS.split(t) if x]
        again, seen = 0, set()
        for x in t.split("\n"):
            if x.strip(" \t\n\x0b\x0c\r"):
                again += x in seen
                seen.add(x)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), again, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)

    want = Counter((i, *rule(t)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    lost = {r["doc_id"]: (r["lost_words"] > 0, r["kept"]) for r in got if r["doc_id"] is not None}
    assert not lost[10][0] and lost[10][1] and lost[11] == (True, False) and not any(r["kept"] for r in got if r["base_failed"])
    assert quality.quality_rules(none).count() == 0
    rng = random.Random(0)
    for _ in range(200):
        w = [rng.choice("abcd").encode() for _ in range(rng.randint(0, 30))]
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        assert quality.repeated_words(w) == len({i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)})
