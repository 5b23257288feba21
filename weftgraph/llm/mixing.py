"""Mixing sources to target weights, with DataFrame functions only.

Each source's words, document after document, form a stream that is cut into blocks of fixed length.
The mix is a row of output shards of equal numbers of slots. Every shard draws how many of its slots each
source fills: the whole part of its share, and multinomial draws for what is left. The k-th slot of a source
reads block ``permutation(epoch, k mod n)`` of its n blocks, epoch = k div n, so a block is never read twice
before all the others were read once. Blocks and slots meet in a join on (source, block).

All randomness is MD5 of a text that names seed, source and position: reruns agree on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.text import SPACE_RUN, count_words, named, row_key, text_or_empty
from weftgraph.plans.shared import materialize, null_safe_join

#: Bits of a draw, and the rounds of a permutation.
BITS, ROUNDS = 60, 6
#: Prefix sums run in two levels: inside groups, then over at most so many groups.
CHUNKS, SHARDS_TOGETHER = 2048, 1024


def draw(*parts: Column | str) -> Column:
    """A uniform whole number below 2**60 from a text of its parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])), 1, BITS // 4), 16, 10).cast("long")


def permuted(index: Column, n: Column, *names: Column | str) -> Column:
    """Swap-or-not: a permutation of 0..n-1 for any n, one draw for the round's key and one for each pair."""

    def round_of(x: Column, r: Column) -> Column:
        partner = F.pmod(draw(*names, r.cast("string")) - x, n)
        swap = lambda y: F.pmod(draw(*names, r.cast("string"), F.greatest(x, y).cast("string")), F.lit(2)) == 1
        return F.element_at(F.transform(F.array(partner), lambda y: F.when(swap(y), y).otherwise(x)), 1)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, round_of)


def source_targets(sizes: DataFrame, factor: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, block: int = 64) -> DataFrame:
    """One row for each source: __rank, source_size, target, n_blocks, need (slots that reach the target).

    Water level: sources sorted by the level at which each is full; the first whose level isn't
    reached fixes it for all that follow. The window runs over one row a source.
    """
    src = sizes.groupBy("__source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("__source").asc_nulls_last())
    src = src.withColumn("__rank", F.row_number().over(order))
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1))
    src = src.withColumn("full", most * F.col("source_size") / F.col("w"))
    filling = Window.partitionBy(F.lit(1)).orderBy("full", "__rank")
    total = F.lit(factor) * F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    before = F.coalesce(F.sum(most * F.col("source_size")).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", (total - before) / rest)
    src = src.withColumn("nth", F.row_number().over(filling))
    level = F.min_by("level", F.when(F.col("level") <= F.col("full"), F.col("nth"))).over(Window.partitionBy(F.lit(1)))
    src = src.withColumn("target", F.least(most * F.col("source_size"), F.coalesce(level, F.lit(float("inf"))) * F.col("w")).cast("double"))
    n = F.expr(f"(source_size + {block - 1}) div {block}")
    need = F.when(F.col("source_size") > 0, F.try_divide(F.col("target") * n, F.col("source_size"))).otherwise(F.lit(0.0))
    return src.select("__source", "__rank", "source_size", "target", n.alias("n_blocks"), need.alias("need"))


def slot_counts(targets: DataFrame, slots: int = 4096, seed: str = "mix") -> DataFrame:
    """Rows (__rank of the source, shard, start, n): how many slots of a shard a source fills, and its slots before."""
    every = Window.partitionBy(F.lit(1))
    t = targets.withColumn("all", F.round(F.sum("need").over(every)).cast("long")).withColumn("p", F.coalesce(F.try_divide(F.col("need"), F.sum("need").over(every)), F.lit(0.0)))

    def shared(size: Column, tag: str) -> list[Column]:
        whole = F.floor(size * F.col("p"))
        return [whole.cast("long").alias(f"whole{tag}"), (size * F.col("p") - whole).alias(f"part{tag}")]

    last = F.pmod(F.col("all"), F.lit(slots))
    t = t.select("*", *shared(F.lit(float(slots)), "F"), *shared(last.cast("double"), "L"))
    upto = Window.partitionBy(F.lit(1)).orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
    for tag, size in (("F", F.lit(slots).cast("long")), ("L", last)):
        t = t.withColumn(f"rest{tag}", size - F.sum(f"whole{tag}").over(every)).withColumn(f"hi{tag}", F.try_divide(F.sum(f"part{tag}").over(upto), F.sum(f"part{tag}").over(every)))
        t = t.withColumn(f"hi{tag}", F.coalesce(f"hi{tag}", F.lit(0.0))).withColumn(f"lo{tag}", F.coalesce(F.lag(f"hi{tag}").over(Window.partitionBy(F.lit(1)).orderBy("__rank")), F.lit(0.0)))
    t = materialize(t, "shares")
    shards = F.expr(f"(all + {slots - 1}) div {slots}")
    rows = t.filter("all > 0 and n_blocks > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)))
    short = (F.col("shard") == shards - 1) & (last > 0)
    pick = lambda x: F.when(short, F.col(f"{x}L")).otherwise(F.col(f"{x}F"))
    rows = rows.select("__rank", "n_blocks", "shard", *[pick(x).alias(x) for x in ("whole", "rest", "lo", "hi")])
    numbers = F.when(F.col("rest") > 0, F.sequence(F.lit(1).cast("long"), F.col("rest"))).otherwise(F.array().cast("array<long>"))
    drawn = F.transform(numbers, lambda j: draw(seed, "shard", F.col("shard").cast("string"), j.cast("string")) / F.lit(float(1 << BITS)))
    rows = rows.withColumn("n", F.col("whole") + F.size(F.filter(drawn, lambda u: (u >= F.col("lo")) & (u < F.col("hi")))))
    rows = rows.withColumn("g", F.expr(f"shard div {SHARDS_TOGETHER}")).select("__rank", "n_blocks", "shard", "g", "n")
    return _running(rows, ["__rank"], "g", ["shard"], "n")


def _running(rows: DataFrame, keys: list[str], group: str, order: list[str], value: str) -> DataFrame:
    """Adds ``start``: the sum of ``value`` before each row of its keys, by group, then by order."""
    inner = Window.partitionBy(*keys, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*keys, group).agg(F.sum(value).alias("__sum")).withColumn("__before", F.sum("__sum").over(outer) - F.col("__sum")).drop("__sum")
    within = rows.withColumn("__in", F.sum(value).over(inner) - F.col(value))
    return null_safe_join(within, sums, [*keys, group]).withColumn("start", F.col("__in") + F.col("__before")).drop("__in", "__before", group)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", factor: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, block: int = 64, slots: int = 4096, seed: str = "mix"
) -> tuple[DataFrame, DataFrame]:
    """(plan, pieces) of the mix of all words of ``docs``.

    plan has a row for each row of ``docs``: id, __h (key of the row), __source, size, start (its first word
    in its source's stream), source_size, target. pieces has a row for each part of a document that a slot
    reads: id, __h, __source, start, size, epoch, word_from, word_to (end exclusive), shard.

    Sources in code-point order, null last, weigh ``weights``, repeating, and share ``factor`` times all words;
    a target stops at ``most`` times its source's words and the excess goes to the others by weight. No
    word is read more than ``most`` times (a whole number of epochs at 2). Defined cases: a null or empty text has no words and is never
    read; a null source is a source; repeated rows each have words of their own; an empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), count_words(text_or_empty(text_col)).alias("size"), row_key(F.col(id_col), F.col(source_col), F.col(text_col)).alias("__h"))
    sizes = materialize(rows, "sizes")
    targets = materialize(source_targets(sizes, factor, weights, most, block), "targets")  # one row a source
    ranked = null_safe_join(sizes, targets, ["__source"])
    ranked = ranked.withColumn("chunk", F.pmod(draw(seed, "chunk", F.coalesce(F.col("__id").cast("string"), F.lit(""))), F.lit(CHUNKS)))
    plan = _running(ranked, ["__rank"], "chunk", ["__id", "size", "__h"], "size")
    # Dealt out before a row becomes thousands of slots; a fixed number, which adaptive plans don't fold by the size of these few rows.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = slot_counts(targets, slots, seed).filter("n > 0").repartition(tasks, "__rank", "shard")
    picks = counts.withColumn("k", F.explode(F.expr("sequence(start, start + n - 1)"))).filter(F.col("k") < F.lit(int(most)) * F.col("n_blocks"))
    picks = picks.withColumn("epoch", F.expr("k div n_blocks"))
    picks = picks.withColumn("b", permuted(F.pmod("k", "n_blocks"), F.col("n_blocks"), seed, F.col("__rank").cast("string"), F.col("epoch").cast("string"))).select("__rank", "b", "epoch", "shard")
    spread = plan.filter("size > 0").withColumn("b", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    spread = spread.select("__id", "__h", "__source", "__rank", "start", "size", "b", (F.greatest(F.col("start"), F.col("b") * block) - F.col("start")).alias("word_from"), (F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block) - F.col("start")).alias("word_to"))
    # Sizes of both sides are guessed from before their rows were exploded, so that slots would be broadcast by the guess.
    pieces = spread.join(picks.hint("merge"), ["__rank", "b"]).select(F.col("__id").alias(id_col), "__h", "__source", "start", "size", "epoch", "word_from", "word_to", "shard")
    return plan.select(F.col("__id").alias(id_col), "__h", "__source", "size", "start", "source_size", "target"), pieces


def taken_words(plan: DataFrame, pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each row of the plan: id, size, source_size, target, taken."""
    sums = pieces.groupBy("__source", "start").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    some = null_safe_join(plan.filter("size > 0"), sums, ["__source", "start"], "left")
    none = plan.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = some.unionByName(none, allowMissingColumns=True)
    return out.select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row for each document and epoch, its text the words taken.

    A document whose words are all taken in an epoch keeps its text as it is; parts are joined by one space. Defined cases: a null or empty text is never in the mix;
    rows that repeat an id, a source and a text come as often as their words were taken, with one of these rows' other columns, the least as JSON; null ids and
    sources are values; an empty table gives no rows; other columns, whatever their names, pass through.

    Rows meet their parts by one key, so each text is shuffled once.
    """
    own = pieces.select("__h", F.col("start").alias("__start"), F.col("size").alias("__size"), F.col("epoch").alias("__epoch"), "word_from", "word_to")
    parts = own.groupBy("__h", "__start", "__size", "__epoch").agg(F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias("__parts"), F.sum(F.col("word_to") - F.col("word_from")).alias("__n"))
    others = [named(c) for c in docs.columns if c != text_col]
    rows = docs.select(row_key(named(id_col), named(source_col), named(text_col)).alias("__h"), F.to_json(F.struct(*others)).alias("__order"), F.struct(*map(named, docs.columns)).alias("__row"))
    both = rows.join(parts.select("__h").distinct(), "__h", "left_semi").groupBy("__h").agg(F.min_by("__row", "__order").alias("__row")).join(parts, "__h")
    text = F.col("__row").getField(text_col)
    words = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    # The words are bound once; a plain reference inside the inner lambda would split the text for each part.
    cut = lambda w: F.flatten(F.transform("__parts", lambda p: F.slice(w, (p["word_from"] + 1).cast("int"), (p["word_to"] - p["word_from"]).cast("int"))))
    some = F.array_join(F.element_at(F.transform(F.array(words), cut), 1), " ")
    both = both.withColumn("__mixed", F.when(F.col("__n") >= F.col("__size"), text).otherwise(some))
    return both.select(*[F.col("__mixed").alias(c) if c == text_col else F.length("__mixed").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("__row").getField(c).alias(c) for c in docs.columns])
