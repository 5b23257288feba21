"""The default limits of the quality rules, in a small and in a large host."""

import pytest

from weftgraph.llm import quality

SCHEMA = "doc_id long, text string, source string"
BOILER = " ".join(f"notice{i}" for i in range(60))


def own(i, words):
    return " ".join(f"d{i}w{k}" for k in range(words))


@pytest.mark.parametrize("size", [4, 5000])
def test_defaults_reject_a_depleted_document_and_keep_a_clean_one(spark, size):
    rows = [(i, own(i, 60), "host") for i in range(size - 3)]
    rows += [(size - 3 + k, f"{BOILER}\n{own(size + k, 20)}", "host") for k in range(3)]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0]["lost_words"] == 0 and got[0]["kept"]
    assert got[size - 3]["lost_words"] == 0 and got[size - 3]["kept"]  # the copy that stays
    assert all(got[size - 3 + k]["lost_words"] == 60 and not got[size - 3 + k]["base_failed"] and not got[size - 3 + k]["kept"] for k in (1, 2))


def test_repeated_rows_count_as_one_document(spark):
    rows = [(1, f"{BOILER}\n{own(1, 20)}", "host")] * 21 + [(2, f"{BOILER}\n{own(2, 20)}", "host")]
    got = quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 22 and all(r["lost_words"] == 0 and r["kept"] for r in got)
    thrice = quality.quality_rules(spark.createDataFrame([*rows, (3, BOILER, "host")], SCHEMA)).collect()
    assert {(r["doc_id"], r["lost_words"]) for r in thrice} == {(1, 0), (2, 60), (3, 60)}
