"""Mixing sources to target weights by capped water-filling.

The sources share the words of the whole corpus by weight. A source whose share exceeds
``MOST_EPOCHS`` times its own words is clamped there and the excess goes to the others in
proportion to their weights, until no share is above its clamp. Each round is one sum over
the table of sources.

A target is met by whole and fractional repetitions: every document is taken
``target // words of the source`` times; the remaining words are filled in the order of a
seeded draw ``u`` of each document, and the document at the cut gives its first words only,
so that a source takes its target to the word. The cut is found without sorting a source:
the words of each of ``DRAWS`` equal ranges of ``u`` are added up before the shuffle, the
range with the cut is found on these sums, and only the documents of that range are put in
order. Rows with the same draw (repeated rows) share the cut evenly.

The document table is only joined with the parameters of the sources, spread over
``SPREAD`` salts so that a source with a third of all rows is no hot key.

Defined results: NULL texts have no words and take none; a NULL source is a source of its
own, last in order; documents without words are taken as often as the whole repetitions
say; an empty table gives no rows.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.llm.store import drop, fresh_name, keep

WORD = r"[^\x20\x09-\x0D]+"
MOST_EPOCHS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SEED = 42
#: Bits of a draw, and of the ranges that are summed up.
DRAW_BITS, RANGE_BITS = 52, 16
SPREAD = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(seed: int, *columns: Column) -> Column:
    """A number below ``2 ** DRAW_BITS`` from the seed and the columns."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def source_key(source: Column) -> Column:
    """Sources as strings that sort by code point with NULL last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank``, the place of the source in order, without one task for all."""
    spark = sources.sparkSession
    rows = sources.orderBy("key").rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    fields = ", ".join(f"{n} {t}" for n, t in sources.dtypes)
    return spark.createDataFrame(rows, f"{fields}, rank bigint")


def water_filled(sources: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to ``key, words, weight``; the targets sum to the words of all."""
    limit = most_epochs * F.col("words")
    whole = sources.agg(F.sum("words").alias("words")).first()["words"] or 0
    numerator, denominator, clamped = None, None, -1
    while True:
        if numerator is None:
            above = F.lit(False)
        else:
            # integers throughout: a clamp is judged without rounding
            above = F.col("weight") * F.lit(numerator).cast("decimal(38,0)") > limit * F.lit(denominator).cast("decimal(38,0)")
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
            F.coalesce(F.sum(above.cast("int")), F.lit(0)).alias("clamped"),
        ).first()
        if row["clamped"] == clamped:
            break
        clamped = row["clamped"]
        if not row["weight"]:
            above = F.lit(True)
            break
        numerator, denominator = whole - row["taken"], row["weight"]
    share = (F.col("weight") * F.lit(numerator or 0)).cast("double") / F.lit(float(denominator or 1))
    return sources.withColumn("target", F.when(above, limit.cast("double")).otherwise(share))


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Repetitions and cut of each source, from ``key, size, u`` of every document.

    ``whole`` repetitions of every document; once more those with a draw below ``cut``; and
    ``part`` words of each document with the draw ``cut``.
    """
    sources = keep(ranked(sizes.groupBy("key").agg(F.sum("size").alias("words"))), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = keep(water_filled(sources.withColumn("weight", weight.cast("bigint")), most_epochs), "targets")
    drop(sources)
    goal = F.floor(F.col("target") + 0.5)
    plan = filled.withColumn("whole", F.when(F.col("words") > 0, F.floor(goal / F.col("words"))).otherwise(0).cast("bigint"))
    plan = plan.withColumn("rest", (goal - F.col("whole") * F.col("words")).cast("bigint"))
    step = 1 << (DRAW_BITS - RANGE_BITS)
    ranges = sizes.groupBy("key", F.floor(F.col("u") / step).alias("range")).agg(F.sum("size").alias("filled"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = ranges.withColumn("upto", F.sum("filled").over(before)).join(plan.select("key", "rest"), "key")
    with_cut = reached.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("filled") <= F.col("rest")))
    at = keep(with_cut.select("key", "range", (F.col("rest") - F.col("upto") + F.col("filled")).alias("left")), "cuts")
    inside = sizes.withColumn("range", F.floor(F.col("u") / step)).join(at, ["key", "range"])
    draws = inside.groupBy("key", "u", "left").agg(F.sum("size").alias("drawn"), F.count(F.lit(1)).alias("rows"))
    ordered = Window.partitionBy("key").orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = draws.withColumn("upto", F.sum("drawn").over(ordered)).where(
        (F.col("upto") > F.col("left")) & (F.col("upto") - F.col("drawn") <= F.col("left"))
    )
    cut = cut.select("key", F.col("u").alias("cut"), F.floor((F.col("left") - F.col("upto") + F.col("drawn")) / F.col("rows")).alias("part"))
    # a source whose rest is nothing has no cut: nothing is taken beyond the whole repetitions
    return keep(plan.join(cut, "key", "left").fillna({"cut": -1, "part": 0}), "plan")


def sized(documents: DataFrame, *keys: str) -> DataFrame:
    return documents.select(
        *keys,
        source_key(F.col("source")).alias("key"),
        word_count(F.col("text").cast("string")).alias("size"),
        draw(SEED, F.col("doc_id"), F.md5(F.col("text").cast("string"))).alias("u"),
    )


def with_source(rows: DataFrame, plan: DataFrame, key: str, salt: str) -> DataFrame:
    """Join the parameters of the sources; ``salt`` names a column that is not taken."""
    spread = plan.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if t in ("bigint", "int")] or [key]), F.lit(SPREAD)).cast("int"))
    return dealt.join(spread, [key, salt]).drop(salt)


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    sizes = keep(sized(documents, "doc_id"), "sizes")
    plan = source_plan(sizes.select("key", "size", "u"), weights, most_epochs)
    joined = with_source(sizes, plan.select("key", F.col("words").alias("source_size"), "target", "whole", "cut", "part"), "key", "salt")
    once_more = F.when(F.col("u") < F.col("cut"), F.col("size")).when(F.col("u") == F.col("cut"), F.least("part", "size")).otherwise(0)
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + once_more).cast("bigint").alias("taken")
    )


def repeated_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns.

    Repetitions are of whole texts; the document at a cut is taken once more if at least
    half of its words are wanted.
    """
    plan = source_plan(keep(sized(documents), "sizes"), weights, most_epochs)
    names = [fresh_name(documents, stem=s) for s in ("key", "size", "u", "salt", "times", "plan")]
    key, size, u, salt, times, held = names
    own = documents.withColumns(
        {
            key: source_key(F.col("source")),
            size: word_count(F.col("text").cast("string")),
            u: draw(SEED, F.col("doc_id"), F.md5(F.col("text").cast("string"))),
        }
    )
    joined = with_source(own, plan.select(F.col("key").alias(key), F.struct("whole", "cut", "part").alias(held)), key, salt)
    whole, cut, part = (F.col(held)[c] for c in ("whole", "cut", "part"))
    more = (F.col(u) < cut) | ((F.col(u) == cut) & (2 * part >= F.col(size)))
    copies = F.array_repeat(F.lit(0), (whole + more.cast("int")).cast("int"))
    return joined.withColumn(times, F.explode(copies)).select(*(F.col(f"`{c}`") for c in documents.columns))
