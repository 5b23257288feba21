"""The two ways of merging communities, held against each other by modularity."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import communities
from weftgraph.sources import edges

#: By how much the modularity of mutual merges may fall below that of the greedy ones.
BOUND = 0.05


@pytest.mark.parametrize(("seed", "blocks", "near", "far"), [(1, 4, 0.5, 0.05), (2, 6, 0.4, 0.02), (3, 1, 0.12, 0.0)])
def test_mutual_merges_reach_the_greedy_modularity(spark, seed, blocks, near, far):
    rng = np.random.default_rng(seed)
    block = np.arange(72) % blocks
    a, b = np.triu_indices(72, 1)
    hit = rng.random(a.size) < np.where(block[a] == block[b], near, far)
    rows = pd.DataFrame({"source": a[hit].astype(str), "target": b[hit].astype(str), "weight": rng.integers(1, 4, hit.sum()).astype(float)})
    g = edges.graph_from_edgelist(spark.createDataFrame(rows))
    best = communities.modularity(g, communities.community_table(g)).first()[0]
    mutual = communities.modularity(g, communities.merge_mutually(g).select("node", F.col("label").alias("community"))).first()[0]
    assert mutual >= best - BOUND
