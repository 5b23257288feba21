"""Small graphs with values worked out by hand or from the definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.errors import GraphInputError, MLInputError
from weftgraph.operators import centrality, communities, compare, embed, gnn, learn, links, measures, paths, perturb, richclub, scores, structure
from weftgraph.operators import graph as graph_module
from weftgraph.operators.graph import Graph
from weftgraph.sources import edges, generated, report
from weftgraph.streaming.edges import streamed_edges

F1 = [("A", "B", 1), ("B", "C", 1), ("C", "A", 1), ("C", "D", 1)]
F4 = [("A", "B", 2), ("B", "C", 1), ("A", "C", 4), ("C", "D", 3), ("X", "Y", 5)]


def build(spark, rows, **kw):
    return edges.graph_from_edgelist(spark.createDataFrame(rows, "source string, target string, weight double" if len(rows[0]) == 3 else "source string, target string"), **kw)


def make(spark, rows):
    return build(spark, [(a, b, float(w)) for a, b, w in rows])


@pytest.fixture(scope="module")
def f1(spark):
    return make(spark, F1)


@pytest.fixture(scope="module")
def f4(spark):
    return make(spark, F4)


def by(df, key, col):
    return {r[key]: r[col] for r in df.select(key, col).collect()}


def test_loader_sums_duplicates_and_drops_loops(spark):
    g = make(spark, [("A", "B", 1), ("B", "A", 2), ("A", "A", 99)])
    assert [tuple(r) for r in g.edges.collect()] == [("A", "B", 3.0)]


def test_loader_strips_blank_and_null_ends(spark):
    g = build(spark, [(" A\t", "B", 1.0), (None, "C", 1.0), (" ", "C", 1.0)])
    assert [tuple(r) for r in g.edges.collect()] == [("A", "B", 1.0)]
    assert build(spark, [("A", "B"), ("B", "A")]).edges.collect()[0]["weight"] == 2.0


def test_loader_errors(spark):
    with pytest.raises(GraphInputError, match="source, target"):
        edges.graph_from_edgelist(spark.createDataFrame([("A", "B")], "`from` string, `to` string"))
    bad = "source string, target string, weight string"
    with pytest.raises(GraphInputError, match="non-numeric"):
        edges.graph_from_edgelist(spark.createDataFrame([("A", "B", "x")], bad))
    with pytest.raises(GraphInputError, match="non-numeric"):
        edges.graph_from_edgelist(spark.createDataFrame([("A", "B", "1d")], bad))
    with pytest.raises(GraphInputError, match="No valid edges"):
        edges.graph_from_edgelist(spark.createDataFrame([("A", "A", "x1")], "source string, target string, other string"))
    # a bad weight on a row that is dropped anyway is no error
    assert edges.graph_from_edgelist(spark.createDataFrame([("A", "B", "1e1"), ("A", "A", "x")], bad)).edges.collect()[0]["weight"] == 10.0


def test_custom_columns_and_direction(spark):
    frame = spark.createDataFrame([("B", "A", 1.0), ("A", "B", 2.0)], "p string, q string, w double")
    g = edges.graph_from_edgelist(frame, directed=True, source="p", target="q", weight="w")
    assert sorted(tuple(r) for r in g.edges.collect()) == [("A", "B", 2.0), ("B", "A", 1.0)]
    assert [tuple(r) for r in g.links.collect()] == [("A", "B", 1.0)]


def test_quality_control(spark):
    rows = [("A", "B", 1), ("A", "B", 2), ("A", "A", 3), (None, "C", 4), ("C", "D", 5)]
    report_rows = edges.network_qc(spark.createDataFrame(rows, "source string, target string, weight long")).collect()
    got = {r["check"]: (r["status"], r["value"]) for r in report_rows}
    assert got["Missing endpoints"] == ("warning", "1") and got["Self-loops"] == ("warning", "1") and got["Duplicate edges"] == ("warning", "1")
    assert got["Connected components"] == ("warning", "2") and got["Usable network"] == ("pass", "4 nodes / 2 edges")
    assert [r["check"] for r in report_rows][:2] == ["Required columns", "Input rows"]
    missing = edges.network_qc(spark.createDataFrame([("A",)], "source string")).collect()
    assert [r["status"] for r in missing] == ["error", "info"]


def test_summary_f1(f1):
    r = measures.network_summary(f1).first()
    assert (r["nodes"], r["edges"], r["components"]) == (4, 4, 1)
    for name, value in {"density": 0.666667, "transitivity": 0.6, "average_clustering": 0.583333, "degree_assortativity": -0.714286}.items():
        assert r[name] == pytest.approx(value, abs=1e-6)
    assert paths.global_efficiency(f1).first()[0] == pytest.approx(0.833333, abs=1e-6)
    assert tuple(paths.largest_component_paths(f1).first()) == pytest.approx((2, 1.333333), abs=1e-6)
    assert measures.degree_measures(f1).first()["degree_std"] == pytest.approx(0.707107, abs=1e-6)


def test_summary_f4(f4):
    r = measures.network_summary(f4).first()
    assert r["components"] == 2 and r["density"] == pytest.approx(1 / 3) and r["largest_component_fraction"] == pytest.approx(2 / 3)
    assert r["average_clustering"] == pytest.approx(0.155556, abs=1e-6)
    assert paths.global_efficiency(f4).first()[0] == pytest.approx(0.4)
    assert all(math.isnan(r[0]) for r in centrality.eigenvector(f4).select("eigenvector").collect())


def test_node_metrics(f1, f4):
    rows = {r["node"]: r for r in centrality.node_metrics(f1).collect()}
    want = {"A": (2, 0, 0.75, 0.245928, 0.522721), "C": (3, 0.666667, 1, 0.366736, 0.611628), "D": (1, 0, 0.6, 0.141408, 0.281845)}
    for node, (k, b, c, p, e) in want.items():
        r = rows[node]
        assert r["degree"] == k and r["betweenness"] == pytest.approx(b, abs=1e-6) and r["closeness"] == pytest.approx(c, abs=1e-6)
        assert r["pagerank"] == pytest.approx(p, abs=1e-5) and r["eigenvector"] == pytest.approx(e, abs=1e-5)
    assert centrality.node_metrics(f1).first()["node"] == "C"
    rows = {r["node"]: r for r in centrality.node_metrics(f4).collect()}
    assert rows["C"]["strength"] == 8 and rows["C"]["betweenness"] == pytest.approx(0.2) and rows["D"]["closeness"] == pytest.approx(0.36)
    assert rows["X"]["pagerank"] == pytest.approx(0.166667, abs=1e-5) and sum(r["pagerank"] for r in rows.values()) == pytest.approx(1)


def test_core_periphery(f1):
    rows = {r["node"]: (r["core_number"], r["core_score"], r["role"]) for r in structure.core_periphery_table(f1).collect()}
    assert rows["A"] == (2, 1.0, "maximal core") and rows["D"] == (1, 0.5, "inner shell")


def test_bridges(f1, f4):
    nodes, cut = structure.bridge_analysis(f1)
    assert [(r["node"], r["components_after_removal"], r["largest_component_after"]) for r in nodes.collect()] == [("C", 2, 2)]
    assert [(r["source"], r["target"]) for r in cut.collect()] == [("C", "D")]
    nodes, cut = structure.bridge_analysis(f4)
    assert {(r["source"], r["target"], r["components_after_removal"]) for r in cut.collect()} == {("C", "D", 3), ("X", "Y", 3)}


def test_structural_table(f1):
    assert by(structure.structural_node_table(f1), "node", "is_articulation") == {"A": False, "B": False, "C": True, "D": False}


def test_rich_club(f1):
    rows = {r["threshold"]: r for r in richclub.rich_club_phi(f1, richclub.thresholds_of(f1, "degree")).collect()}
    assert [(rows[k]["n_rich_nodes"], rows[k]["n_rich_edges"]) for k in (0.0, 1.0, 2.0)] == [(4, 4), (3, 3), (1, 0)]
    assert rows[0.0]["phi_observed"] == pytest.approx(2 / 3) and rows[1.0]["phi_observed"] == 1 and math.isnan(rows[2.0]["phi_observed"])
    assert [r[0] for r in richclub.rich_club_members(f1, 2).collect()] == ["C"]
    roles = [r["edge_class"] for r in richclub.rich_club_edge_roles(f1, 2).collect()]
    assert sorted(roles) == ["feeder", "feeder", "feeder", "local"]


def test_rich_club_weighted(f4):
    rows = {r["threshold"]: r["phi_observed"] for r in richclub.rich_club_phi(f4, richclub.thresholds_of(f4, "degree"), weighted=True).collect()}
    assert rows[0.0] == pytest.approx(1) and rows[1.0] == pytest.approx(0.583333, abs=1e-6) and math.isnan(rows[2.0])
    strengths = [r[0] for r in richclub.thresholds_of(f4, "strength").orderBy("threshold").collect()]
    assert strengths == [3, 5, 6]
    with pytest.raises(ValueError, match="weighted=True"):
        richclub.rich_club_curve(f4, richness="strength")


def test_rich_club_curve(spark, f1):
    rng = np.random.default_rng(1)
    g = make(spark, [(str(a), str(b), 1 + i % 3) for i, (a, b) in enumerate(generated.preferential_attachment(20, 2, rng))])
    one, two = (richclub.rich_club_curve(g, randomizations=3, seed=5) for _ in range(2))
    assert [tuple(r) for r in one.table.select("threshold", "phi_null_mean", "p_empirical").filter("p_empirical is not null and not isnan(p_empirical)").collect()] == [tuple(r) for r in two.table.select("threshold", "phi_null_mean", "p_empirical").filter("p_empirical is not null and not isnan(p_empirical)").collect()]
    assert one.table.columns == ["threshold", "degree_threshold", "n_rich_nodes", "n_rich_edges", "phi_observed", "phi_null_mean", "phi_null_lower_95", "phi_null_upper_95", "rho", "observed_phi", "null_phi", "normalized_phi", "p_empirical", "q_bh", "reliable_node_count", "exploratory_signal"]
    assert one.parameters["randomizations"] == 3 and one.warnings == [richclub.FEW_NULLS]
    for p in (r[0] for r in one.table.select("p_empirical").collect()):
        assert math.isnan(p) or 0.25 <= p <= 1
    weighted = richclub.rich_club_curve(g, randomizations=2, richness="strength", weighted=True)
    assert richclub.WEIGHTED_NULLS in weighted.warnings
    assert all(math.isnan(r[0]) or 0 <= r[0] <= 1 for r in weighted.table.select("phi_observed").collect())
    assert richclub.peak_enrichment(one.table).count() == 1
    with pytest.raises(ValueError, match="at least three nodes"):
        richclub.rich_club_curve(make(spark, [("A", "B", 1)]))


def test_swaps_keep_degrees():
    rng = np.random.default_rng(0)
    a, b = np.array(generated.preferential_attachment(40, 2, rng)).T
    x, y = richclub.swapped(a, b, 200, 4000, rng)
    assert (np.bincount(np.concatenate([a, b])) == np.bincount(np.concatenate([x, y]))).all()
    pairs = {(min(p, q), max(p, q)) for p, q in zip(x.tolist(), y.tolist(), strict=True)}
    assert len(pairs) == a.size and all(p != q for p, q in pairs) and pairs != {(min(p, q), max(p, q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)}


def test_benjamini_hochberg(spark):
    t = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, float("nan"))], "i int, p_empirical double")
    q = by(richclub.benjamini_hochberg(t), "i", "q_bh")
    assert (q[0], q[1], q[2]) == pytest.approx((0.03, 0.04, 0.04)) and math.isnan(q[3])


def test_compare(spark):
    a, b = make(spark, [("A", "B", 1)]), make(spark, [("A", "B", 1), ("B", "C", 1)])
    overall, nodes = compare.compare_networks(a, b)
    rows = {r["node"]: r for r in nodes.collect()}
    assert rows["C"]["status"] == "gained" and rows["C"]["degree_change"] == 1 and rows["B"]["degree_a"] == 1 and rows["B"]["degree_b"] == 2
    assert by(overall, "metric", "change")["nodes"] == 1


def test_partitions(spark):
    a = spark.createDataFrame([("w", 1), ("x", 1), ("y", 2), ("z", 2)], "node string, community int")
    b = spark.createDataFrame([("w", 1), ("x", 1), ("y", 2), ("z", 3)], "node string, community int")
    summary, rows, flows = compare.compare_partitions(a, b)
    r = summary.first()
    assert (r["adjusted_rand_index"], r["normalized_mutual_information"], r["fraction_reassigned"]) == pytest.approx((0.571429, 0.8, 0.25), abs=1e-6)
    assert sum(x["nodes"] for x in flows.collect()) == 4 and by(rows, "node", "community_b_aligned")["z"] == 3
    none = spark.createDataFrame([("q", 1)], "node string, community int")
    assert math.isnan(compare.compare_partitions(a, none)[0].first()["adjusted_rand_index"])


def test_node_screen(f1, f4):
    rows = {r["node"]: r for r in perturb.perturbation_screen(f1).collect()}
    assert perturb.perturbation_screen(f1).first()["node"] == "C"
    assert (rows["C"]["impact_score"], rows["C"]["efficiency_change"], rows["C"]["largest_component_change"], rows["C"]["components_after"]) == pytest.approx((0.4, -0.5, -1, 2))
    rows = {r["node"]: r for r in perturb.perturbation_screen(f4).collect()}
    assert rows["X"]["largest_component_change"] == 1 and rows["X"]["components_after"] == 2
    assert rows["C"]["impact_score"] == pytest.approx(0.186667, abs=1e-6) and rows["C"]["components_after"] == 3


def test_edge_screen(f1, f4):
    rows = {(r["source"], r["target"]): r for r in perturb.edge_perturbation_screen(f1).collect()}
    assert rows["C", "D"]["is_bridge"] and rows["C", "D"]["impact_score"] == pytest.approx(0.3) and rows["C", "D"]["largest_component_change"] == -0.25
    assert rows["A", "B"]["impact_score"] == pytest.approx(0.05) and not rows["A", "B"]["is_bridge"]
    rows = {(r["source"], r["target"]): r["impact_score"] for r in perturb.edge_perturbation_screen(f4).collect()}
    assert rows["X", "Y"] == pytest.approx(0.04) and rows["C", "D"] == pytest.approx(0.146667, abs=1e-6)


def test_screens_agree_with_plain_walks(f4):
    g = f4.local()
    a, b = perturb.Baseline(g), perturb.Walked(g)
    for v in range(g.n):
        assert a.without_node(v) == pytest.approx(b.without_node(v))
    for e in range(g.a.size):
        assert a.without_edge(e) == pytest.approx(b.without_edge(e))


def test_robustness(f1):
    assert perturb.removal_counts(6, 2) == [0, 2, 5]
    rows = perturb.robustness_curve(f1, steps=3, random_repeats=4).collect()
    hit = [r for r in rows if r["strategy"] == "targeted"]
    assert [r["largest_component_mean"] for r in hit] == [1, 0.5, 0.25, 0.25] and [round(r["efficiency_mean"], 6) for r in hit] == [0.833333, 0.333333, 0, 0]
    assert all(r["largest_component_std"] == 0 for r in hit) and all(0 <= r["efficiency_mean"] <= 1 for r in rows)
    assert perturb.targeted_order(f1.local(), 3) == [2, 1, 3]


def test_communities(spark, f1):
    two = make(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("x", "y", 1), ("y", "z", 1), ("x", "z", 1), ("c", "x", 1)])
    got = by(communities.community_table(two), "node", "community")
    assert got["a"] == got["b"] == got["c"] != got["x"] == got["y"] == got["z"]
    split = lambda rows: spark.createDataFrame(rows, "node string, community int")
    assert communities.modularity(f1, split([("A", 1), ("B", 1), ("C", 2), ("D", 2)])).first()[0] == pytest.approx(0)
    assert communities.modularity(f1, split([("A", 1), ("B", 1), ("C", 1), ("D", 2)])).first()[0] == pytest.approx(-0.03125)
    table = communities.merge_mutually(two)
    assert table.select("label").distinct().count() == 2


def test_joins_agree_with_kernels(spark, f4):
    rng = np.random.default_rng(3)
    g = make(spark, [(str(a), str(b), 1 + i % 4) for i, (a, b) in enumerate(generated.preferential_attachment(24, 2, rng))])
    pr, pr2 = by(centrality.pagerank(g, tolerance=1e-9), "node", "pagerank"), by(centrality._pagerank_by_join(g, tolerance=1e-9), "node", "pagerank")
    assert pr == pytest.approx(pr2, abs=1e-7)
    assert by(structure.core_numbers(g), "node", "core") == by(structure._cores_by_join(g), "node", "core")
    for mine, other, key in zip(paths.path_sums(f4), paths._sums_by_join(f4), ("inverse", "passed", "passed"), strict=True):
        one = {tuple(r[c] for c in mine.columns if c in ("node", "src", "dst")): r[key] for r in mine.collect()}
        two = {tuple(r[c] for c in other.columns if c in ("node", "src", "dst")): r[key] for r in other.collect()}
        assert {k: v for k, v in one.items() if v} == pytest.approx({k: v for k, v in two.items() if v})
    got = by(f4.components, "node", "component")
    assert got["D"] == "A" and got["Y"] == "X"


def test_size_check_switches_plans(spark, f1, monkeypatch):
    monkeypatch.setattr(graph_module, "KERNEL_EDGES", 0)
    g = Graph(f1.edges)
    assert not g.fits and by(g.components, "node", "component") == {x: "A" for x in "ABCD"}
    with pytest.raises(ValueError, match="takes up to"):
        g.local()


def test_links(f1):
    rows = {(r["source"], r["target"]): r for r in links.top_link_predictions(f1).collect()}
    assert set(rows) == {("A", "D"), ("B", "D")}
    r = rows["A", "D"]
    assert (r["common_neighbors"], r["jaccard"]) == (1, 0.5) and r["adamic_adar"] == pytest.approx(0.910239, abs=1e-6) and r["score"] == pytest.approx(2.147228, abs=1e-6)
    pair = links.pair_features(f1, links.non_edges(f1)).filter("source = 'A'").first()
    assert (pair["preferential_attachment"], pair["degree_sum"], pair["degree_difference"]) == (2, 3, 1)


def test_embedding(f1):
    t = embed.spectral_embedding(f1, 8)
    assert t.columns == ["node", "embedding_1", "embedding_2", "embedding_3"] and t.count() == 4
    u = np.array([r[1:] for r in t.collect()])
    g = f1.local()
    a = np.zeros((4, 4))
    a[g.a, g.b] = a[g.b, g.a] = 1
    d = 1 / np.sqrt(a.sum(axis=1))
    s = a * d[:, None] * d
    x, sv, _ = np.linalg.svd(s)
    assert u @ u.T == pytest.approx((x[:, :3] * sv[:3] ** 2) @ x[:, :3].T, abs=1e-6)
    near = embed.nearest_nodes(t, "A", 2).collect()
    cosine = u @ u[0] / np.linalg.norm(u, axis=1) / np.linalg.norm(u[0])
    assert [r["similarity"] for r in near] == pytest.approx(sorted(cosine[1:], reverse=True)[:2])
    with pytest.raises(KeyError):
        embed.nearest_nodes(t, "nobody")


def test_scores(spark):
    t = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, probability double")
    assert tuple(scores.ranking_scores(t).first()) == pytest.approx((0.875, 0.833333), abs=1e-6)
    c = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "label string, predicted_label string")
    assert tuple(scores.class_scores(c).first()) == pytest.approx((0.75, 0.75, (2 / 3 + 0.8) / 2))


@pytest.fixture(scope="module")
def grown(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{a:02d}", f"{b:02d}", 1) for a, b in generated.preferential_attachment(24, 2, rng)]
    labels = spark.createDataFrame([(f"{i:02d}", "low" if i < 12 else "high") for i in range(24)], "node string, label string")
    return make(spark, rows), labels


def test_forests(spark, grown):
    g, labels = grown
    s, rows, importance = learn.node_prediction(g, labels, trees=10)
    r = s.first()
    assert r["cv_folds"] >= 2 and rows.count() == 24 and 0 <= r["accuracy"] <= 1 and importance.count() > 5
    with pytest.raises(MLInputError):
        learn.node_prediction(g, labels.withColumn("label", F.lit("one")), trees=5)
    s, best, _ = learn.learned_link_prediction(g, trees=10, top_n=5)
    assert 0 <= s.first()["roc_auc"] <= 1 and best.count() == 5
    linked = {(r["src"], r["dst"]) for r in g.links.collect()}
    assert not linked & {(r["source"], r["target"]) for r in best.collect()}


def test_networks_that_learn(grown):
    g, labels = grown
    s, rows, history = gnn.neural_node_prediction(g, labels, epochs=20)
    assert s.first()["model"] and rows.count() == 24 and history.count() == 20
    losses = [r["loss"] for r in history.collect()]
    assert all(map(math.isfinite, losses)) and losses[-1] < losses[0]
    s, best, history = gnn.neural_link_prediction(g, epochs=20, top_n=5)
    assert best.count() == 5 and 0 <= s.first()["average_precision"] <= 1


def test_gradients_of_graph_network():
    rng = np.random.default_rng(0)
    p = gnn.Propagation(5, np.array([0, 1, 2, 3]), np.array([1, 2, 3, 4]))
    data = [(p, rng.normal(size=(5, 3))) for _ in range(6)]
    _, losses = gnn.train_graph_gcn(data, np.array([0, 1] * 3), 2, 8, 4, 60, 0.05, 1)
    assert losses[-1] < losses[0]


def test_graph_collections(spark):
    graphs, labels = generated.demo_graph_dataset(spark)
    assert graphs.components.select("graph", "component").distinct().count() == 24
    features = measures.graph_feature_table(graphs)
    assert features.count() == 24 and len(features.columns) == 13
    s, rows, history = gnn.neural_graph_classification(graphs, labels, epochs=5)
    assert rows.count() == 24 and history.count() == 5


def test_files(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.csv").write_text("source,target,weight\nA,B,1\nB,NA,2\nB,C,3\n")
    frame = edges.read_edge_csv(spark, str(tmp_path / "one.csv"))
    assert frame.filter("target is null").count() == 1
    g = edges.graph_from_edgelist(edges.read_graph_directory(spark, str(tmp_path)), group="graph")
    assert {(r["graph"], r["edges"]) for r in measures.counts(g).collect()} == {("one", 2), ("two", 2)}
    out = report.export_table(frame, str(tmp_path), "node_metrics")
    assert spark.read.csv(out, header=True).count() == 3


def test_reports(spark):
    settings = report.run_parameters(randomizations=10)
    assert settings["random_repeats"] == 30
    with pytest.raises(ValueError):
        report.run_parameters(swaps_per_edge=99)
    table = report.manifest(spark, {"nodes": 3, "edges": 2}, settings, primary="a", comparison=None, directed=False, weighted=True)
    assert table.count() == 14
    assert '"edges": 2' in report.settings_json({"nodes": 3, "edges": 2}, settings, source="a", directed=False)
    assert "10 degree-preserving" in report.methods_text({"nodes": 3, "edges": 2}, settings, directed=False)
    rows = {(r["goal"], r["profile"]): (r["supported"], r["missing"]) for r in report.navigator(spark).collect()}
    assert len(rows) == 40 and rows["compare", "one_network"] == (False, "comparison") and rows["organize", "demo"][0]


def test_streamed_edges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("B,A,1\nA,B,2\nA,A,5\n")
    rows = spark.readStream.schema("source string, target string, weight string").csv(str(tmp_path / "in"))
    q = streamed_edges(rows).writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("streamed").collect()] == [("A", "B", 3.0)]
