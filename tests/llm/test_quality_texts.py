"""The quality rules give what is left of each text, not only their verdict."""

from weftgraph.llm import quality

SCHEMA = "doc_id long, text string, source string"


def test_removed_lines_are_gone_from_the_texts(spark):
    rows = [(1, "Own one\n  All  RIGHTS reserved \n\n", "a"), (2, "all rights reserved\nOwn  two\nall rights\treserved", "a"), (3, "Own three\nALL RIGHTS RESERVED", "a"), (4, "all rights reserved", "b"), (5, None, None)]
    got = {r["doc_id"]: (r["text"], r["lost_words"]) for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA), texts=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("Own  two", 6), 3: ("Own three", 3), 4: ("all rights reserved", 0), 5: ("", 0)}
    plain = quality.quality_rules(spark.createDataFrame(rows, SCHEMA))
    assert "text" not in plain.columns and plain.count() == 5
