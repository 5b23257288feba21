"""Scripts by code point: neutral characters say nothing, Indic scripts and Thai are told apart; long texts go by pieces."""

import random
import unicodedata

import numpy as np
import pytest

from test_operators import table
from weftgraph.llm import language


def test_classes_of_whole_words():
    words = split("the\U0001f600 Дом über 日本 한글 ไทย हिन्दी বাংলা தமிழ் ქართული ά ábc")
    assert words == [1, 3, 1, 30, 23, 18, 8, 9, 13, 22, 2, 1]


def split(text):
    return language.split_words([text.encode()]).scripts.tolist()


def test_every_letter_of_a_named_script_has_one_class():
    names = {"LATIN": 1, "GREEK": 2, "CYRILLIC": 3, "ARMENIAN": 4, "HEBREW": 5, "ARABIC": 6, "DEVANAGARI": 8, "BENGALI": 9, "TAMIL": 13, "THAI": 18, "GEORGIAN": 22, "HIRAGANA": 28, "HANGUL": 23}
    for code in [*range(0x41, 0x3100), *range(0xAC00, 0xD7A4, 97)]:
        if chr(code).isalpha():
            first = unicodedata.name(chr(code), "?").split()[0]
            raw = np.frombuffer((chr(code) + " ").encode(), dtype=np.uint8)
            if first in names and not 0x2000 <= code < 0x2190 and "EXTENDED" not in unicodedata.name(chr(code)) and not 0x1D00 <= code < 0x1E00 and not 0x2B0 <= code < 0x370 and not 0x2C00 <= code < 0x2E00:
                assert language.scripts_of(raw)[0] == names[first], (hex(code), unicodedata.name(chr(code)))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    parts = {"en": ["the", "tion", "ing", "th", "of"], "de": ["sch", "ung", "der", "und", "ein"], "hi": ["नम", "का", "है"], "th": ["กา", "ไท", "ย"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) + ("\U0001f600" if lang == "de" else "")
    return language.learn_held_out(table(spark, [(i, " ".join(word(lang) for _ in range(40)), lang, "s") for i in range(160) for lang in [list(parts)[i % 4]]]))


def told(model, text):
    return next(iter(language.label(model, [text.encode()], 15.0)))


def test_pictures_dont_tell_a_language(model):
    lang, score, spans, _ = told(model, "the\U0001f600 ofthe\U0001f600 tioning\U0001f600 of\U0001f600 thing")
    assert model.langs[lang] == "en" and score > 0.9 and len(spans) == 1
    assert model.langs[told(model, "हैका नम")[0]] == "hi" and model.langs[told(model, "ไทกา ย")[0]] == "th"


def test_letters_of_no_known_script_get_some_language(model):
    lang, score, spans, _ = told(model, "ⲁⲃⲅ")
    assert lang == model.usual and score == 0.25 and spans == [(0, 3, lang)]
    assert told(model, "\U0001f600 12")[0] == -1


def test_pieces_change_nothing(model, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "und😀", "ofthe", "schung", "कानम", "é\n", "12"]) for _ in range(rng.randint(0, 300))).encode() for _ in range(30)]
    whole = list(language.label(model, texts, 15.0))
    monkeypatch.setattr(language, "TOGETHER", 64)
    again = list(language.label(model, texts, 15.0))
    assert [(w[0], w[2]) for w in whole] == [(w[0], w[2]) for w in again] and [w[1] for w in again] == pytest.approx([w[1] for w in whole])
    assert b"".join(language.pieces_of("日本語".encode() * 100)) == "日本語".encode() * 100 and all(x.decode() for x in language.pieces_of("日本語".encode() * 100))
