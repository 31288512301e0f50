"""Mix sources to target weights: hash-random order, prefix sums of sizes, an exact cut.

Each source's rows get a random key (the digest of their id), which cuts the
source into ranges of equal width. A range holds about the same number of
rows whatever the source, so a hot source is many ranges. Sizes are summed up
per range, and prefix sums of the ranges name the one in which a source's
budget ends. Only the rows of those ranges are sorted, to find the row at the
cut. Every other row is taken or left by comparing its key with the cut, so
neither texts nor sizes are shuffled. A target beyond the source's size takes
all of it once or more and cuts the last epoch.

Defined results: a null or empty text has size zero and nothing is taken of
it; a null source comes last and is a source like any other; null ids share a
key and are ordered by the digest of the row. Of rows that are alike in every
column as many are taken as the budget allows. An empty table gives an empty
one. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.llm.batches import named
from tabloom.session import broadcast_if_small, durable

# Sources by code point weigh this, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2
# Hexadecimal digits of the key that name a range: 4096 ranges for each source.
RANGE_DIGITS = 3


# Everything but blanks is a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    A target is ``least(epochs * size, level * weight)`` with one level for
    all, which is where sharing the excess by weight ends. Each round fixes
    the sources that have reached their limit and shares out the rest; the
    rounds are small sums over the table of sources, which stays a table.
    """
    position = _positions(sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("position"), F.lit(len(weights))) + 1).cast("int"))
    table = durable(position.select("source", "source_size", weight.alias("weight"),
                                    (F.col("source_size") * float(epochs)).alias("limit")), "sources")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("limit") <= F.col("weight") * level
        fixed, open_ = table.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        raised = (share * total - (fixed or 0.0)) / open_ if open_ else level
        if raised <= level:
            break
        level = raised
    return table.select("source", "source_size", F.least("limit", F.col("weight") * level).alias("target"))


def _positions(sizes: DataFrame) -> DataFrame:
    """Number of each source by code point, from zero, null last: offset of a range of sources plus rank in the range."""
    parts = durable(sizes.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source")
                    .withColumn("part", F.spark_partition_id()), "source-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("none", "source"))
    return parts.withColumn("rank", rank).join(offsets.drop("n"), "part").select(
        "source", "source_size", (F.col("offset") + F.col("rank") - 1).alias("position"))


def _order(id_column: str, tie: Column) -> Column:
    """What rows of a source are sorted by; the key leads."""
    return F.struct(_key(id_column).alias("key"), F.coalesce(named(id_column).cast("string"), F.lit("")).alias("id"),
                    tie.alias("tie"))


def _key(id_column: str) -> Column:
    return F.md5(F.coalesce(named(id_column).cast("string"), F.lit("null")))


def _range(order: Column) -> Column:
    return F.substring(order["key"], 1, RANGE_DIGITS)


def cuts(rows: DataFrame, **options) -> DataFrame:
    """Per source: size, target, whole epochs, and the row at which the last epoch ends.

    ``rows`` has ``source``, ``size`` and ``order``. Rows before ``cut`` are
    taken once more; of the rows equal to it ``whole`` are, and one gives
    its first ``part`` words.
    """
    ranges = durable(rows.groupBy("source", _range(F.col("order")).alias("range")).agg(F.sum("size").alias("words")), "ranges")
    targets = durable(source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), **options), "targets")
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = targets.withColumn("epochs", epochs).withColumn("rest", goal - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumnRenamed("source", "of")
    ends = durable(goals.join(starts, F.col("of").eqNullSafe(F.col("source"))).where(
        "rest > 0 AND start < rest AND rest <= start + words").select("of", "range", F.col("rest") - F.col("start")), "ends") \
        .toDF("of", "in_range", "wanted")
    inside = rows.join(broadcast_if_small(ends), F.col("of").eqNullSafe(F.col("source"))
                       & (_range(F.col("order")) == F.col("in_range")))
    alike = inside.groupBy("source", "order", "wanted", "size").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    sums = alike.withColumn("place", F.coalesce(F.sum(F.col("n") * F.col("size")).over(earlier), F.lit(0)))
    left = F.col("wanted") - F.col("place")
    at = durable(sums.where((left > 0) & (left <= F.col("n") * F.col("size"))).select(
        F.col("source").alias("of"), F.col("order").alias("cut"), F.floor(left / F.col("size")).cast("long").alias("whole"),
        F.pmod(left, F.col("size")).alias("part")), "cuts")
    return durable(goals.drop("rest").join(at, F.col("of").eqNullSafe(F.col("source")), "left").drop("of"), "source-cuts") \
        .withColumnRenamed("source", "of")


def _taken(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``again`` (their part in the last epoch: all, or nothing), and those equal to a cut, once each with their number ``n``."""
    placed = rows.join(broadcast_if_small(found), F.col("of").eqNullSafe(F.col("source")), "left")
    equal = F.coalesce(F.col("order") == F.col("cut"), F.lit(False))
    others = placed.where(~equal).withColumn("again", F.coalesce(F.col("order") < F.col("cut"), F.lit(False)))
    at_cut = placed.where(equal).groupBy("of", "order").agg(
        F.count("*").alias("n"), *[F.first(n).alias(n) for n in placed.columns if n not in ("of", "order")])
    return others, at_cut


def assign(df: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``(id, size, source_size, target, taken)`` of every row.

    Over a source ``taken`` adds up to the target, rounded to whole words.
    """
    rows = durable(df.select(
        named(id_column).alias("id"), named(source).alias("source"), word_count(named(text)).alias("size"),
        _order(id_column, F.xxhash64(named(text))).alias("order")), "sizes")
    others, at_cut = _taken(rows, cuts(rows, **options))
    base = F.col("epochs") * F.col("size")
    whole = others.withColumn("taken", base + F.when(F.col("again"), F.col("size")).otherwise(F.lit(0)))
    cut = at_cut.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn(
        "taken", base + F.when(F.col("k") < F.col("whole"), F.col("size"))
        .when(F.col("k") == F.col("whole"), F.col("part")).otherwise(F.lit(0)))
    columns = [F.col("id").alias(id_column), "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return whole.select(*columns).unionByName(cut.select(*columns))


def mix(df: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: the rows that are taken, with all their columns, once per epoch.

    Where the budget ends inside a row, its text is cut behind the last word
    taken. Rows without words are not taken.
    """
    names = df.columns
    inner = df.select(
        *[named(n).alias(f"c{i}") for i, n in enumerate(names)], named(source).alias("source"),
        _order(id_column, F.xxhash64(*[named(n) for n in names])).alias("order"))
    t = f"c{names.index(text)}"
    rows = durable(inner.select("source", "order", word_count(F.col(t)).alias("size")), "sizes")
    others, at_cut = _taken(inner, cuts(rows, **options))
    times = F.col("epochs") + F.col("again").cast("long")
    columns = [f"c{i}" for i in range(len(names))]
    whole = others.where((times > 0) & F.col(t).rlike(WORD)).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    # Of n equal rows, every one is taken ``epochs`` times, ``whole`` of them once more, and one in part.
    copies = at_cut.withColumn("full", F.col("n") * F.col("epochs") + F.col("whole"))
    again = copies.where("full > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("full"))))
    pieces = F.regexp_extract_all(F.col(t), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, 1, F.col("part").cast("int")), "")
    part = copies.where("part > 0").withColumn(t, head)
    out = whole.select(*columns).unionByName(again.select(*columns)).unionByName(part.select(*columns))
    return out.toDF(*names)
