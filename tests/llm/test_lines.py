"""Line dedup and quality rules on long documents and repeated rows."""

import random
import time

from test_operators import line_rule, table
from weftgraph.llm import line_dedup, quality


def test_reassembly_keeps_every_other_line(spark):
    rng = random.Random(7)
    lines = [f"a line that many documents hold, number {i}" for i in range(30)] + ["", " ", "short", "Own line\tof no one else"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 40))), None, None) for i in range(30)]
    rows += [(40, "\n".join(lines[:3]), None, None), (40, "\n".join(lines[5:9]), None, None), (41, "\n".join(lines[:1]), None, None), (None, lines[0], None, None), (None, lines[0], None, None)]
    got = [tuple(r) for r in line_dedup.line_dedup(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(line_rule(rows), key=str)


def test_a_long_document_takes_linear_time(spark):
    body = "\n".join(f"line {i} of a very long document" for i in range(60_000))
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(table(spark, [(i, body, None, None) for i in range(4)])).collect()}
    assert got[0]["n_dropped"] == 60_000 and got[0]["text"] == "" and got[3]["n_dropped"] == 0 and got[3]["text"] == body
    assert time.time() - began < 60


def test_repeated_rows_are_one_document_for_quality_rules(spark):
    text = " ".join(f"w{i}" for i in range(60))
    own = "\nThe same line in two documents only, three times each."
    rows = [(i % 2, f"{text} {i % 2} x{i % 2}" + own, "en", "a") for i in range(6)]
    assert {r["lost_words"] for r in quality.quality_rules(table(spark, rows)).collect()} == {0}
