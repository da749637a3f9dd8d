"""SimHash fingerprints of whole documents with built-in functions only, and the search for near ones.

Every pair of neighbouring words is a term, weighted by its length, whose hash votes with its weight for or against each
of 64 bits. Two votes are added up in one number, in its lower and its upper half.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import many, stored

#: Part of the fingerprint's definition: a pair of words weighs as many as it has characters, at most so many.
HEAVIEST = 40
#: Documents in a stretch of the id order on average; quantiles of doc_id that are looked up, between which ids are cut evenly.
STRETCH, QUANTILES = 2000, 1024
#: Differing bits of near fingerprints, blocks of the permuted tables, and of how many documents one is asked for (all whose
#: id is a multiple of it).
RADIUS, BLOCKS, ASKED = 3, 6, 50
_SPACE = " \t\n\x0b\f\r"
_PAIR = 1 << 32 | 1


def terms(text: Column) -> Column:
    """Array of (hash, weight): pairs of neighbouring words in lower case, or the only word; empty without words. The weight
    is the number of characters, HEAVIEST at most, so that a long string of no words does not decide alone."""
    words = F.split(F.btrim(F.lower(text), F.lit(_SPACE)), r"[ \t\n\x0B\f\r]+")
    weight = lambda *w: F.least(sum(map(F.char_length, w)), F.lit(HEAVIEST)).cast("long").alias("weight")
    pairs = F.zip_with(
        F.slice(words, 1, F.size(words) - 1),
        F.slice(words, 2, F.size(words) - 1),
        lambda a, b: F.struct(F.xxhash64(a, b).alias("hash"), weight(a, b)),
    )
    one = F.transform(words, lambda a: F.struct(F.xxhash64(a).alias("hash"), weight(a)))
    return F.when(F.size(words) > 1, pairs).when(words[0] != "", one).otherwise(F.slice(one, 1, 0))


def votes() -> list[Column]:
    """Aggregates over exploded terms (columns hash, weight): 32 double sums and the weight of all."""
    each = [F.sum(F.expr(f"weight * ((hash >> {j}) & {_PAIR})")).alias(f"v{j}") for j in range(32)]
    return [*each, F.sum("weight").alias("all")]


def decided() -> Column:
    """Fingerprint from votes(): a bit is set by more than half the weight."""
    low = [F.when(F.expr(f"2 * (v{j} & 4294967295) > all"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(32)]
    high = [F.when(F.expr(f"2 * shiftrightunsigned(v{j}, 32) > all"), F.lit((1 << j + 32) - (1 << 64 if j == 31 else 0))).otherwise(F.lit(0)) for j in range(32)]
    return F.coalesce(reduce(lambda a, b: a.bitwiseOR(b), [c.cast("long") for c in low + high]), F.lit(0).cast("long"))


def fingerprints(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and fp for every distinct value of the keys, from the terms of all its texts (commonly one).

    Null texts and texts without words have fingerprint zero. No Python runs, and where the rows are already dealt by some
    of the keys nothing is shuffled. An empty table gives no rows.
    """
    each = rows.select(*keys, F.explode_outer(terms(F.coalesce(text_col, F.lit("")))).alias("t"))
    each = each.select(*keys, F.col("t.hash").alias("hash"), F.col("t.weight").alias("weight"))
    return each.groupBy(*keys).agg(*votes()).select(*keys, decided().alias("fp"))


def shown(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def with_next(docs: DataFrame) -> DataFrame:
    """stretch, no, doc_id, text, next_text of all rows: the text of the next row by descending doc_id, after the last
    the first. Null ids come last; rows of the same id follow each other by the hash of their text.

    The id order is cut into stretches that are sorted on their own: at approximate quantiles of doc_id, and evenly between
    two of them where there are more documents than QUANTILES stretches hold. Null ids are cut by the leading bits of the
    hash that orders them. The first row of each stretch also closes the stretch before, as a row without a number.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    seen = rows.select(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    cuts = min(QUANTILES, max(1, -(-seen["ids"] // STRETCH)))
    each = max(1, -(-seen["ids"] // (cuts * STRETCH)))
    at = [i / cuts for i in range(1, cuts)]
    marks = rows.agg(F.percentile_approx("doc_id", at, 10_000)).first()[0] if at else []
    edges = [seen["low"] or 0, *sorted(set(marks or [])), seen["high"] or 0]
    known = F.array(*[F.lit(m).cast("long") for m in edges])
    below = F.greatest(F.size(F.filter(F.array(*[F.lit(m).cast("long") for m in edges[1:-1]]), lambda m: m < F.col("doc_id"))), F.lit(0)) if len(edges) > 2 else F.lit(0)
    low, high = F.element_at(known, below + 1).cast("double"), F.element_at(known, below + 2).cast("double")
    share = F.coalesce(F.try_divide(F.col("doc_id") - low, high - low), F.lit(0.0))
    inside = F.least(F.greatest(F.floor(share * each), F.lit(0)), F.lit(each - 1))
    halvings = max(0, (max(1, (seen["n"] - seen["ids"]) // STRETCH)).bit_length() - 1)
    nulls = F.shiftright(F.xxhash64("text"), 63 - halvings) - F.lit(1 << halvings) if halvings else F.lit(-1).cast("long")
    stretch = F.when(F.col("doc_id").isNull(), nulls).otherwise(below.cast("long") * each + inside)
    rows = rows.withColumn("stretch", stretch.cast("long"))
    # the highest stretch comes first; the first row of each also follows the last of the next higher one
    ring = Window.orderBy("stretch")
    heads = rows.groupBy("stretch").agg(F.max(F.struct("doc_id", F.xxhash64("text").alias("hash"))).alias("head"))
    heads = stored(heads.withColumn("to", F.coalesce(F.lead("stretch").over(ring), F.min("stretch").over(ring))))
    rows = rows.join(heads, "stretch")
    own = F.struct("stretch", F.lit(False).alias("copy"))
    again = F.struct(F.col("to").alias("stretch"), F.lit(True).alias("copy"))
    top = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.xxhash64("text") == F.col("head.hash"))
    places = F.when(top, F.array(own, again)).otherwise(F.array(own))
    rows = rows.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.stretch", "at.copy")
    rows = rows.repartition(many(docs.sparkSession), "stretch")
    order = Window.partitionBy("stretch").orderBy("copy", F.desc_nulls_last("doc_id"), F.xxhash64("text").desc())
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "no": F.row_number().over(order)})
    return rows.where("not copy")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text is the text whose last third of code points is replaced by as many from the start of the next
    document (or all it has). Null texts are empty. Null ids come after all others; rows that repeat an id follow each
    other. Other columns are not looked at; an empty table gives no rows.
    """
    third = F.floor(F.char_length("text") / 3).cast("int")
    rows = with_next(docs).withColumn("third", third).select(
        "stretch", "no", "doc_id", F.char_length("text").cast("long").alias("n_chars"), "text",
        F.concat(F.expr("substring(text, 1, char_length(text) - third)"), F.expr("substring(next_text, 1, third)")).alias("changed"),
    )
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"), F.lit("").alias("sha")),
        F.struct(F.lit(1).alias("kind"), F.col("changed").alias("text"), F.sha2("changed", 256).alias("sha")),
    )
    keys = ["stretch", "no", "doc_id", "n_chars"]
    each = rows.select(*keys, F.explode(both).alias("b")).select(*keys, "b.kind", "b.sha", "b.text")
    prints = fingerprints(each, [*keys, "kind", "sha"])
    own = F.max(F.when(F.col("kind") == 0, F.col("fp")))
    new = F.max(F.when(F.col("kind") == 1, F.col("fp")))
    return prints.groupBy(*keys).agg(own.alias("own"), new.alias("new"), F.max("sha").alias("edited_sha256"))


def digests(docs: DataFrame, asked: int = ASKED) -> DataFrame:
    """The rows of edited() with the likeness to the next document's fingerprint, and n_near: for every doc_id divisible by
    `asked` the number of other fingerprints of the table within RADIUS differing bits (see near()), else null.

    Copies of a text are one fingerprint. The heads of stretches, one for about STRETCH documents, are all that is put in
    one order. Cases are as in edited()."""
    rows = stored(edited(docs))
    within, ring = Window.partitionBy("stretch").orderBy("no"), Window.orderBy("stretch")
    heads = rows.where("no = 1").select("stretch", F.col("own").alias("head"))
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = stored(heads.select("stretch", F.coalesce(F.lag("head").over(ring), F.last("head").over(whole)).alias("after")))
    rows = rows.join(after, "stretch").withColumn("next", F.coalesce(F.lead("own").over(within), F.col("after")))
    queried = F.coalesce(F.col("doc_id") % asked == 0, F.lit(False))
    some = rows.where(queried)
    met = near(some.select(F.col("own").alias("fp")), rows.select(F.col("own").alias("fp")), RADIUS, BLOCKS).where("distance > 0")
    counts = met.groupBy(F.col("fp").alias("own")).agg(F.count(F.lit(1)).alias("n_near"))
    some = some.join(counts, "own", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    rows = rows.where(~queried).withColumn("n_near", F.lit(None).cast("long")).unionByName(some)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
        "n_near",
    )


def masks(radius: int, blocks: int) -> list[int]:
    """The kept bits of each permuted table, as signed numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    fields = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    kept = [sum(fields[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def block_tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """One row for each way to keep all but `radius` of the blocks of fp: the table's number and the kept bits.

    Two fingerprints within the radius differ in at most `radius` blocks, so some table has them under one key.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks(radius, blocks))])
    rows = prints.withColumn("t", F.explode(tables))
    return rows.withColumns({"table": F.col("t.table"), "bits": F.col("fp").bitwiseAND(F.col("t.mask"))}).drop("t")


def near(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fp, found, distance: for every distinct fp of the queries all distinct fingerprints within the radius, from 20
    permuted tables of 32 kept bits by default. Copies are one fingerprint; zero is searched like any other. A pair that
    several tables hold comes from the first of them, so no step sorts pairs to tell them apart; null queries find none."""
    asked = block_tables(queries.where("fp is not null").select("fp").distinct(), radius, blocks)
    known = block_tables(prints.where("fp is not null").select("fp").distinct(), radius, blocks).withColumnRenamed("fp", "found")
    pairs = asked.join(known, ["table", "bits"]).withColumn("gap", F.col("fp").bitwiseXOR(F.col("found")))
    pairs = pairs.withColumn("distance", F.bit_count("gap")).where(F.col("distance") <= radius)
    earlier = [F.when(F.col("gap").bitwiseAND(F.lit(m).cast("long")) == 0, i) for i, m in enumerate(masks(radius, blocks))]
    return pairs.where(F.col("table") == F.coalesce(*earlier)).select("fp", "found", "distance")
