"""Domains of the rich-club settings, the ranking that stands in for a forest, embeddings beside communities."""

import pytest

from weftgraph.operators import communities, embed, learn, richclub, structure
from weftgraph.sources.edges import graph_from_edgelist

RING = [(str(i), str((i + 1) % 5), 1.0) for i in range(5)]


def make(spark, rows):
    return graph_from_edgelist(spark.createDataFrame(rows, "source string, target string, weight double"))


def test_every_setting_outside_its_domain_is_named(spark):
    with pytest.raises(ValueError) as error:
        richclub.rich_club_curve(make(spark, RING), randomizations=0, swaps_per_edge=-1, min_rich_nodes=1, richness="strength")
    assert all(name in str(error.value) for name in (*richclub.LEAST, "weighted=True"))


def test_weights_of_a_weighted_curve(spark):
    for weight in (-1.0, float("inf")):  # others are no numbers to the scan
        g = make(spark, [*RING[:4], ("4", "0", weight)])
        with pytest.raises(ValueError, match="negative or not finite"):
            richclub.check_graph(g, True)
        richclub.check_graph(g, False)


def test_small_graphs_are_ranked_by_topology(spark):
    kind, best = learn.link_predictions(make(spark, RING[:4]), top_n=3)
    assert kind == "topology" and best.count() == 3


def test_embedding_beside_communities(spark):
    g = make(spark, RING)
    both = embed.embedding_with_communities(embed.spectral_embedding(g, 2), communities.community_table(g).filter("node <> '0'"))
    rows = {r["node"]: r for r in both.collect()}
    assert len(rows) == 5 and rows["0"]["community"] is None and all(rows[n]["community"] is not None for n in "1234")


def test_structural_table_of_a_given_partition(spark):
    g = make(spark, RING)
    own = g.degrees.selectExpr("node", "7 AS community")
    assert {r["community"] for r in structure.structural_node_table(g, own).collect()} == {7}
