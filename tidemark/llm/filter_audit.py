"""Filter interaction audit: what each of five filters removes, alone and in every order of application.

A text fails filter E if a smaller doc_id has the same text: a left-semi join on hash, exact text and smaller doc_id. Its ids
are united with those of the other failures, and the failures of a row become one number of five bits. Everything else is
counted from the at most 32 combinations of bits that a part of the table can have.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_SPACE = " \t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _mask(letters: Column) -> Column:
    """The bits of the filters that a text of letters names."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.contains(letters, F.lit(x)), _bit(x)).otherwise(0) for x in FILTERS])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, part, h (hash of the text) and bits, the failures of filters A to D, of every row."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bare", F.btrim("text", F.lit(_SPACE)))
    rows = rows.withColumn("words", F.split("bare", _GAP))
    n = F.when(F.col("bare") == "", 0).otherwise(F.size("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    rows = rows.select(
        "doc_id", "part", F.xxhash64("text").alias("h"), n.cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("different"),
        capitals.cast("long").alias("capitals"), F.length("text").cast("long").alias("chars"), F.col("text").rlike("[#$%&*|]").alias("marked"),
    )
    fails = {"A": F.col("n") < 200, "B": 100 * F.col("different") < 50 * F.col("n"), "C": 100 * F.col("capitals") > 2 * F.col("chars"), "D": F.col("marked")}
    bits = reduce(lambda a, b: a + b, [F.when(c, _bit(x)).otherwise(0) for x, c in fails.items()])
    return rows.select("doc_id", "part", "h", bits.alias("bits"))


def copies(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """doc_id, part, h of the rows of docs whose text a smaller doc_id has too; hashed: features().

    Only texts whose hash two doc_ids share travel. The side that is looked up holds each of them once, with its smallest
    doc_id, which tasks find in part before the shuffle; the other side may hold one text very often, and Spark splits it.
    """
    twice = stored(hashed.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h"))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(rows.withColumn("h", F.xxhash64("text")).join(twice, "h", "left_semi"))
    first = stored(rows.groupBy("h", "text").agg(F.min("doc_id").alias("low")).select(F.col("h").alias("g"), F.col("text").alias("same"), "low"))
    again = (F.col("h") == F.col("g")) & (F.col("text") == F.col("same")) & (F.col("low") < F.col("doc_id"))
    return rows.join(first, again, "left_semi").select("doc_id", "part", "h")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, n, good, toxic: the rows of each part that fail exactly these filters, and how many of them are labelled."""
    each = stored(features(docs))
    failed = each.withColumn("n", F.lit(1)).unionByName(copies(docs, each).withColumns({"bits": F.lit(_bit("E")), "n": F.lit(0)}))
    rows = failed.groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(marks, "doc_id", "left")
    of = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return marked.groupBy("part", "bits").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for every part (source), order of the five filters and step, with what the step's filter does there.

    part, filter_order, step, and as long: kept after the step, removed by it, redundant (fails it, but was removed before),
    unique_fails (fails it alone), good_lost and toxic_lost (removed here and labelled so), shapley (removed by this filter in
    all 120 orders together).

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are not looked at. A null text is empty: it fails
    A, and E if a smaller doc_id has an empty or null text. A null source is the part ''. A row without doc_id never fails E
    and has no labels, but is counted; its text makes no other row fail E. Rows that repeat a doc_id are each counted and do
    not fail E by each other. A doc_id with several labels is good or toxic if one of them says so. Without rows no rows.
    """
    found = combinations(docs, labels).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("found"))
    rows = found.select("part", "found", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, range(1, len(FILTERS) + 1)))).alias("step"))
    rows = rows.withColumns({"own": _mask(F.substring("filter_order", F.col("step"), F.lit(1))), "before": _mask(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    fails = lambda c: c["bits"].bitwiseAND(F.col("own")) != 0
    gone = lambda c: c["bits"].bitwiseAND(F.col("before")) != 0

    def total(where, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("found", where), F.lit(0).cast("long"), lambda s, c: s + value(c))

    removed = lambda c: fails(c) & ~gone(c)
    first = lambda c: c["n"] * F.expr(f"{len(ORDERS)} div 1") / F.bit_count(c["bits"])  # noqa: E731  in so many orders it stands before its others
    return rows.select(
        "part", "filter_order", "step", total(lambda c: ~fails(c) & ~gone(c)).alias("kept"), total(removed).alias("removed"), total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["bits"] == F.col("own")).alias("unique_fails"), total(removed, lambda c: c["good"]).alias("good_lost"), total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: first(c).cast("long")).alias("shapley"),
    )
