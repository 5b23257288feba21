"""The stages of the pipeline on odd rows: nulls, empties, repeats, clashing names, empty tables."""

import random

import pytest

from test_operators import prose
from weftgraph.llm import stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __k string, `__row` string, `a.b` string, __h string, id string"


def rows():
    rng = random.Random(6)
    text = prose(rng, 120)
    own = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n ", None, None), (4, text, "en", "a"), (5, text.replace(" ", "\n", 3), None, "b"), (5, text.replace(" ", "\n", 3), "en", "b")]
    own += [(6, text + " more", "en", None), (6, text + " more", "en", None), (7, prose(rng, 90), "de", None), (None, prose(rng, 50), None, "b"), (None, prose(rng, 50), "en", "b"), (8, "12 %%", "en", "a")]
    return [(i, t, lang, s, len(t or ""), "k", "r", "x", "h", "i") for i, t, lang, s in own]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.mark.parametrize("name", ["identify_language", "drop_exact_copies", "drop_near_copies", "mix_to_targets", "encode_pieces"])
def test_stage(spark, docs, name):
    stage = getattr(stages, name)
    out = stage(spark, docs, "")
    got = out.collect()
    ids = sorted((r["doc_id"] or 0) for r in got)
    want = {"identify_language": [0, 0, 4, 5, 5, 6, 6, 7], "drop_exact_copies": [0, 0, 1, 3, 4, 6, 7, 8], "drop_near_copies": [0, 0, 1, 2, 3, 4, 7, 8], "encode_pieces": [0, 0, 1, 2, 3, 4, 5, 5, 6, 6, 7, 8]}
    if name in want:
        assert ids == want[name]
    if name == "encode_pieces":
        assert all(r["round_trip"] for r in got)
    else:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert all(r["a.b"] == "x" and r["__row"] == "r" for r in got)
    if name == "identify_language":
        assert all(r["lang"] is not None for r in got)
    if name == "mix_to_targets":
        assert {1, 2, 3}.isdisjoint(ids) and all(r["n_chars"] == len(r["text"]) for r in got)
        words = {r[0]: r[1].split() for r in rows() if r[1]}
        assert all(set(r["text"].split()) <= set(words[r["doc_id"]]) for r in got if r["doc_id"])
    assert stage(spark, docs.filter("doc_id = 99"), "").collect() == []
