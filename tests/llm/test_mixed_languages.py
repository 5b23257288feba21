"""Texts in many languages stay when each span is certain."""

import random

import numpy as np

from weftgraph.llm import language

LETTERS = {"el": "αβγδεζηθικ", "en": "abcdefghij", "he": "אבגדהוזחטי", "ru": "абвгдежзик"}
SCHEMA = "doc_id long, text string, lang string"


def test_a_text_in_four_languages_is_kept(spark):
    rng = random.Random(3)
    text = lambda lang, n: " ".join("".join(rng.choices(LETTERS[lang], k=5)) for _ in range(n))
    model = language.learn(spark.createDataFrame([(i, text(lang, 30), lang) for i, lang in enumerate(sorted(LETTERS) * 20)], SCHEMA), "lang", "text")
    four = "\n".join(text(lang, 40) for lang in sorted(LETTERS))
    docs = spark.createDataFrame([(1, four, None), (2, text("ru", 40), None), (3, "123 %%", None), (4, None, None)], SCHEMA)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert got[1]["score"] < 0.3 and [s["lang"] for s in got[1]["spans"]] == sorted(LETTERS)
    assert {r["doc_id"] for r in language.keep_identified(docs, model).collect()} == {1, 2}
    unsure = language.Model(model.langs, np.zeros_like(model.logp), np.ones_like(model.allowed))  # a quarter for each language
    assert language.keep_identified(docs, unsure).isEmpty()
