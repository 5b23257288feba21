"""Edge lists: scans, quality control, and the canonical graph that every operator starts from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.errors import GraphInputError
from weftgraph.operators.components import connected_components
from weftgraph.operators.graph import Graph
from weftgraph.plans.shared import materialize

#: Cells that a CSV scan takes as missing (fixed values).
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
_NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity)\s*$"


def read_edge_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV as text columns; cells that spell a missing value are null. Types are left to the canonical form."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_graph_directory(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a folder as one edge list with a ``graph`` column, the file's stem. Stems must differ."""
    raw = spark.read.csv(path, header=True, inferSchema=False).withColumn("__file", F.col("_metadata.file_path"))
    stem = F.regexp_replace(F.regexp_extract("__file", r"([^/]+)$", 1), r"\.[^.]*$", "")
    out = raw.select(*[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns if c != "__file"], stem.alias("graph"), "__file")
    if not out.groupBy("graph").agg(F.count_distinct("__file").alias("n")).filter("n > 1").isEmpty():
        raise GraphInputError("Graph file names must be unique.")
    return out.drop("__file")


def stripped(name: str) -> Column:
    """Text without white space at its ends, of any kind; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.col(name).cast("string"), r"^\s+", ""), r"\s+$", "")


def number(name: str) -> Column:
    """A double, or null for what isn't a number."""
    text = F.col(name).cast("string")
    value = F.when(F.lower(text).rlike(_NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def graph_from_edgelist(frame: DataFrame, *, directed: bool = False, source: str = "source", target: str = "target", weight: str = "weight", group: str | None = None) -> Graph:
    """Validate an edge list and build its canonical graph.

    Rows without an endpoint and loops go; a weight that isn't a number on a row that is left is an error; without a
    weight column every edge weighs 1; duplicates are summed, both directions of an undirected edge too.
    The rows are read once: their edges are written, and checked there.
    """
    absent = sorted({source, target} - set(frame.columns))
    if absent:
        raise GraphInputError("Missing required column(s): " + ", ".join(absent))
    keys = [group] if group else []
    exact = weight in frame.columns and isinstance(frame.schema[weight].dataType, (T.DoubleType, T.LongType, T.IntegerType))
    value = F.nanvl(F.col(weight).cast("double"), F.lit(None)) if exact else number(weight) if weight in frame.columns else F.lit(1.0)
    clean = frame.select(*keys, stripped(source).alias("src"), stripped(target).alias("dst"), value.alias("weight"))
    clean = clean.filter("src <> '' and dst <> '' and src <> dst")
    ends = ("src", "dst") if directed else (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    # Sums of a double leave nulls out, so edges tell by a mark whether a row of theirs has none.
    edges = clean.select(*keys, *ends, "weight").groupBy(*keys, "src", "dst").agg(F.sum("weight").alias("weight"), F.bool_or(F.col("weight").isNull()).alias("bad"))
    edges = materialize(edges, "edges")
    rows, bad = edges.agg(F.count("*"), F.count_if("bad")).first()
    if bad:
        raise GraphInputError("The weight column contains non-numeric values.")
    if not rows:
        raise GraphInputError("No valid edges remain after input validation.")
    edges = edges.drop("bad")
    return Graph(edges, directed=directed, group=group, _made={"arcs": edges})


def network_qc(frame: DataFrame, *, directed: bool = False) -> DataFrame:
    """The quality-control report (check, status, value, interpretation), one aggregation over all rows."""
    spark = frame.sparkSession
    absent = sorted({"source", "target"} - set(frame.columns))
    report = [("Required columns", "error" if absent else "pass", ", ".join(absent) if absent else "source, target", "Add the missing columns before analysis." if absent else "Required columns are present.")]
    weighted = "weight" in frame.columns
    ends = [] if absent else [F.coalesce(stripped(c), F.lit("")).alias(k) for c, k in (("source", "s"), ("target", "t"))]
    cells = frame.select(*ends, *([F.col("weight").cast("string").alias("raw"), number("weight").alias("w")] if weighted else []))
    count = F.count("*").alias("rows")
    if absent:
        rows = cells.agg(count).first()["rows"] if cells.columns else frame.count()
        return spark.createDataFrame([*report, ("Input rows", "info", str(rows), "Number of rows in the uploaded edge list.")], "check string, status string, value string, interpretation string")
    blank = (F.col("s") == "").cast("long") + (F.col("t") == "").cast("long")
    sums = [count, F.sum(blank).alias("blank"), F.count_if((F.col("s") == F.col("t")) & (F.col("s") != "")).alias("loops"), F.count_if((F.col("s") != "") & (F.col("t") != "")).alias("pairs")]
    usable = (F.col("s") != "") & (F.col("t") != "") & (F.col("s") != F.col("t"))
    if weighted:
        sums += [F.count_if(F.col("w").isNull()).alias("invalid"), F.count_if(F.col("w") <= 0).alias("low"), F.count_if(usable & F.col("w").isNull()).alias("fatal")]
    facts = cells.agg(*sums).first().asDict()
    pair = ("s", "t") if directed else (F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"))
    pairs = cells.filter("s <> '' and t <> ''").select(*pair).distinct()
    distinct = pairs.count()
    duplicates = facts["pairs"] - distinct
    add = report.append
    add(("Input rows", "info", str(facts["rows"]), "Number of rows in the uploaded edge list."))
    for name, n, some, none in (
        ("Missing endpoints", facts["blank"] or 0, "Rows with missing or blank endpoints are removed.", "No missing endpoints detected."),
        ("Self-loops", facts["loops"], "Self-loops are removed before analysis.", "No self-loops detected."),
        ("Duplicate edges", duplicates, "Duplicate weights are summed.", "No duplicate edges detected."),
    ):
        add((name, "warning" if n else "pass", str(n), some if n else none))
    if weighted:
        n, low = facts["invalid"], facts["low"]
        add(("Numeric weights", "error" if n else "pass", str(n), "Every weight must be numeric and non-missing." if n else "All weights are numeric."))
        add(("Nonpositive weights", "warning" if low else "pass", str(low), "Some algorithms assume positive interaction strength." if low else "All weights are positive."))
    else:
        add(("Edge weights", "info", "unweighted", "All interactions receive weight 1."))
    links = pairs.filter("s <> t")
    edges = links.count()
    if edges and not facts.get("fatal"):
        labels = connected_components(links, "s", "t")
        nodes, parts = labels.agg(F.count("*"), F.count_distinct("component")).first()
        add(("Connected components", "warning" if parts > 1 else "pass", str(parts), "Disconnected components can affect path-based metrics." if parts > 1 else "The network is connected."))
        add(("Usable network", "pass", f"{nodes} nodes / {edges} edges", "Network construction succeeded."))
    return spark.createDataFrame(report, "check string, status string, value string, interpretation string")


def event_edges(spark: SparkSession, sf_dir: str, event_type: str | None = None, before: str | None = None) -> DataFrame:
    """Rows (event_type, day, source, target, weight): who follows whom within an event type and day of ``events``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    conditions = ([F.col("event_type") == event_type] if event_type else []) + ([F.col("ts") < F.lit(before).cast("timestamp")] if before else [])
    rows = events.filter(reduce(lambda a, b: a & b, conditions)) if conditions else events
    order = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    rows = rows.select("event_type", F.to_date("ts").cast("string").alias("day"), F.col("user_id").cast("string").alias("source"), F.lead("user_id").over(order).cast("string").alias("target"), F.col("value").alias("weight"))
    return rows.filter("target is not null")


def event_network(spark: SparkSession, sf_dir: str, event_type: str, before: str | None = None, directed: bool = False) -> Graph:
    return graph_from_edgelist(event_edges(spark, sf_dir, event_type, before), directed=directed)
