"""Sinks and the small tables around an analysis: exports, manifest, methods text, settings, and what to run next."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import __version__

#: Names of exported tables (fixed values).
EXPORTS = (
    "network_a_qc", "network_b_qc", "analysis_manifest", "node_metrics", "rich_club_curve", "rich_club_membership", "rich_club_edge_roles", "communities", "core_periphery", "articulation_nodes", "bridge_edges",
    "network_statistics", "differential_nodes", "differential_communities", "differential_rich_club", "node_perturbation_screen", "edge_perturbation_screen", "robustness_curve", "node_embeddings", "node_predictions", "learned_link_predictions", "graph_predictions",
)

#: Goals: (key, question, primary analysis, workspace, required inputs); and data profiles: (key, label, inputs) (fixed values).
GOALS = [
    ("organize", "What organizes this network?", "Community detection", "Explore", ["network"]),
    ("rich_club", "Do highly connected nodes form an unusually dense core?", "Normalized rich-club analysis", "Explore", ["network"]),
    ("compare", "What changed between two networks or conditions?", "Differential hubs and whole-network statistics", "Compare", ["network", "comparison"]),
    ("critical", "Which nodes or connections are structurally critical?", "Node and edge deletion screens", "Perturb", ["network"]),
    ("similar", "Which nodes have similar structural roles?", "Spectral node embeddings", "Predict", ["network"]),
    ("node_prediction", "Can network information predict labels for nodes?", "Class-balanced random forest baseline", "Predict", ["network", "node_labels"]),
    ("link_prediction", "Which connections may be missing?", "Random forest link-prediction baseline", "Predict", ["network"]),
    ("graph_prediction", "Can I classify entire networks?", "Random forest graph-level baseline", "Predict", ["network", "graph_labels"]),
]
PROFILES = [
    ("one_network", "One network", ["network"]),
    ("two_networks", "Two networks or conditions", ["network", "comparison"]),
    ("node_labels", "One network with node labels", ["network", "node_labels"]),
    ("graph_labels", "Multiple networks with graph labels", ["network", "comparison", "graph_labels"]),
    ("demo", "I want to learn with the demo data", ["network", "comparison", "node_labels", "graph_labels"]),
]


def export_table(table: DataFrame, folder: str, name: str, fmt: str = "csv") -> str:
    """Write a result under one of the export names, as headed CSV or Parquet; the path."""
    if name not in EXPORTS:
        raise ValueError(f"unknown export {name!r}")
    path = f"{folder}/{name}"
    writer = table.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
    return path


def navigator(spark: SparkSession) -> DataFrame:
    """(goal, profile, supported, missing, compatible): what each goal lacks under each data profile, and the other goals it allows."""
    goals = spark.createDataFrame(GOALS, "goal string, question string, primary_method string, workspace string, requires array<string>")
    profiles = spark.createDataFrame(PROFILES, "profile string, label string, capabilities array<string>")
    every = goals.select("goal", "question", "requires").withColumn("p", F.explode(F.array(*[F.lit(p[0]) for p in PROFILES]))).join(F.broadcast(profiles), F.col("p") == F.col("profile"))
    missing = F.array_sort(F.array_except("requires", "capabilities"))
    fit = every.withColumn("missing", missing).withColumn("supported", F.size("missing") == 0)
    other = fit.filter("supported").groupBy("profile").agg(F.collect_list(F.struct("goal", "question")).alias("all"))
    out = fit.join(F.broadcast(other), "profile", "left")
    open_ = F.array_sort(F.transform(F.filter("all", lambda x: x["goal"] != F.col("goal")), lambda x: x["question"]))
    return out.select("goal", "profile", "supported", F.array_join("missing", ",").alias("missing"), F.size(open_).alias("compatible"))


def manifest(spark: SparkSession, summary: dict, parameters: dict, *, primary: str, comparison: str | None, directed: bool, weighted: bool) -> DataFrame:
    """(setting, value), fourteen rows: what went in and how it was analysed."""
    rows = [
        ("Software version", __version__),
        ("Reference source", primary),
        ("Comparison source", comparison or "none"),
        ("Graph type", "directed" if directed else "undirected"),
        ("Weight mode", "weighted" if weighted else "unweighted"),
        ("Reference nodes", str(int(summary["nodes"]))),
        ("Reference edges", str(int(summary["edges"]))),
        ("Rich-club null networks", str(parameters.get("randomizations", ""))),
        ("Rich-club richness", str(parameters.get("richness", ""))),
        ("Rich-club coefficient", "weighted" if parameters.get("weighted") else "binary"),
        ("Rich-club swaps per edge", str(parameters.get("swaps_per_edge", ""))),
        ("Minimum rich nodes", str(parameters.get("min_rich_nodes", ""))),
        ("Rich-club random seed", str(parameters.get("seed", ""))),
        ("Robustness repeats", str(parameters.get("random_repeats", ""))),
    ]
    return spark.createDataFrame(rows, "setting string, value string")


def settings_json(summary: dict, parameters: dict, *, source: str, directed: bool) -> str:
    return json.dumps({"software": "weftgraph", "version": __version__, "source": source, "directed_input_projected_to_undirected": directed, "analysis": parameters, "network": summary}, indent=2, sort_keys=True)


def methods_text(summary: dict, parameters: dict, *, directed: bool) -> str:
    """A paragraph that says how a rich-club curve was made."""
    kind = "weighted" if parameters["weighted"] else "binary"
    given = "directed edge list, read as undirected" if directed else "undirected edge list"
    return (
        f"Rich-club organization was computed from a {given} of {int(summary['nodes'])} nodes and {int(summary['edges'])} edges. The {kind} coefficient was taken at every {parameters['richness']} threshold "
        f"and divided by its mean over {parameters['randomizations']} degree-preserving null networks ({parameters['swaps_per_edge']} swaps per edge, seed {parameters['seed']}). Empirical p-values count null values not below the "
        f"observed one, with one added to both counts, and q-values follow Benjamini and Hochberg. Thresholds with fewer than {parameters['min_rich_nodes']} rich nodes were not interpreted. Results are exploratory and do not establish causality."
    )


def run_parameters(**given) -> dict:
    """Checked settings of a run with their defaults (fixed values)."""
    out = {"randomizations": 100, "swaps_per_edge": 10, "min_rich_nodes": 5, "seed": 42, "random_repeats": 30, "richness": "degree", "weighted": False} | given
    domains = {"randomizations": {10, 25, 50, 100, 250, 500, 1000}, "swaps_per_edge": range(1, 26), "min_rich_nodes": range(3, 21), "random_repeats": range(10, 101), "richness": {"degree", "strength"}, "weighted": {True, False}}
    for name, domain in domains.items():
        if out[name] not in domain:
            raise ValueError(f"{name}={out[name]!r} is outside its domain")
    if out["seed"] < 0:
        raise ValueError("seed must not be negative")
    if out["richness"] == "strength" and not out["weighted"]:
        raise ValueError("richness='strength' goes with weighted=True only")
    return out


def melt(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Long form of a curve: (keys, series, value)."""
    return table.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "series", "value")


def head(table: DataFrame, order: list, n: int = 15) -> DataFrame:
    return table.orderBy(*order).limit(n)


def has_negative_weights(frame: DataFrame) -> bool:
    return "weight" in frame.columns and not frame.filter(F.col("weight").cast("string").try_cast("double") < 0).isEmpty()
