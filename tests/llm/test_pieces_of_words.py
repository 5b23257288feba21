"""Words are cut where no piece reaches across, and each part is encoded once: ids stay the library's."""

import os
import random

import pytest

from weftgraph.llm import sentencepiece as sp
from weftgraph.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="the tokenizer isn't here")


@pytest.fixture
def model():
    with open(FILE, "rb") as f:
        return sp.Model(f.read())


def test_a_part_is_encoded_once(model, monkeypatch):
    seen, plain = [], sp.encode_stretch
    monkeypatch.setattr(sp, "encode_stretch", lambda m, text: seen.append(text) or plain(m, text))
    sp.encode(model, "word. word, word; word\nword word.\nword")
    assert sorted(x for x in seen if "word" in x) == ["word", sp.SPACE + "word"]


def test_ids_are_those_of_uncut_words(model, monkeypatch):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=FILE)
    monkeypatch.setattr(model.parts, "most", 50)
    monkeypatch.setattr(model.words, "most", 50)
    rng = random.Random(6)
    kinds = ["etaoinshr", "ETH", ".,;:!?-'\"", "$%&*#", "0123456789", "\n\t", "éßñü", "中文字の", "‍🙂", "▁"[:0] + "lmnopqr"]
    for _ in range(1500):
        words = ["".join(rng.choice(rng.choice(kinds)) * rng.choice((1, 1, 1, 2, 5)) for _ in range(rng.randint(1, 24))) for _ in range(rng.randint(1, 6))]
        text = " ".join(words)
        whole = [k for w in words for k in memoryview(sp.encode_stretch(model, sp.SPACE + w)).cast("i")]
        assert sp.encode(model, text) == library.encode(text) == whole
        for w in words:
            if len(w) <= model.longest:
                assert sp.window(model, w) == list(sp.stream(model, w))
    assert len(model.parts) <= 50 and len(model.parts.older) <= 50
