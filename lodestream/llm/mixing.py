"""Mixing sources to target weights by pivotal dependent rounding.

A document's expected copies are its source's target over its source's size.
The whole part is certain; the fractions are rounded by pivotal steps: two
documents' fractional masses are moved from one to the other, at random and so
that each keeps its expectation, until one of the two is 0 or 1.  The other
goes on to the next step.  A step keeps the two documents' words together as
they were.  Documents of a source and a class of like sizes are dealt out to
groups of about ``GROUP``; each group leaves one residual, and residuals meet
in groups again, up to one for each source and class: a reduction tree of
logarithmic depth.  A source's last residuals, one for each class, are settled
together from the largest to the smallest, so that smaller texts make up for
what rounding a larger one left over.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise

GROUP = 64
#: No document is taken more often.
MOST = 3
#: Classes of sizes for each doubling; a source has about 30 classes up to 20,000 words.
CLASSES = 2
_EDGE = 1e-12


def sizes(text: str) -> Column:
    """Words of a text: runs of characters other than space and \\t..\\r; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, most: float = MOST) -> DataFrame:
    """Target of each source: (source, source_size, rows) -> and target.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; targets share the
    sum of all sizes by weight, stop at ``most`` times their source's size, and
    the excess is shared anew by weight among the others until none is above.
    One row for each source: the table is as long as the list of sources.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weighed = totals.withColumn("weight", (F.pmod(rank - 1, F.lit(3)) + 1).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size").cast("double") * most)
    # the level at which source i stops is cap / weight; those below the common level are full
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = weighed.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full_cap"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("full_weight"),
        F.sum("source_size").over(everything).cast("double").alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
    )
    level = (F.col("all_size") - F.col("full_cap")) / (F.col("all_weight") - F.col("full_weight"))
    seen = seen.withColumn("level", level).withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    # the common level is that of the first source that doesn't fill up
    common = F.min(F.when(F.col("open"), F.struct(F.col("full_weight"), F.col("level")))).over(everything)["level"]
    return seen.withColumn("common", common).select(
        "source",
        "source_size",
        "rows",
        F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("common") * F.col("weight"))).alias("target"),
    )


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def _round(items: Column, seed: Column) -> Column:
    """Pivotal steps along an array of (h, doc_id, size, copies, p): the decided items and the residual, if any.

    The residual keeps its fraction p; decided items have p = 0 and their last copy, if they won it, in copies.
    """

    def item(x: Column, p: Column) -> Column:
        return F.struct(x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["copies"].alias("copies"), p.alias("p"))

    def decided(x: Column, won: Column) -> Column:
        return F.struct(
            x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), (x["copies"] + won.cast("long")).alias("copies"), F.lit(0.0).alias("p")
        )

    def step(acc: Column, x: Column) -> Column:
        a, ratio = acc["rest"], x["size"] / acc["rest"]["size"]
        up = F.least(1 - a["p"], x["p"] * ratio)  # what a can gain from x
        down = F.least(a["p"], (1 - x["p"]) * ratio)  # and lose to it
        gain = _uniform(seed, a["h"], x["h"], F.size(acc["done"])) * (up + down) < down
        pa = F.when(gain, a["p"] + up).otherwise(a["p"] - down)
        px = F.when(gain, x["p"] - up / ratio).otherwise(x["p"] + down / ratio)
        a_done = (pa < _EDGE) | (pa > 1 - _EDGE)
        # one of the two is at an end; if it is a, x goes on, however near to an end it is itself
        done = F.when(a_done, decided(a, pa > 0.5)).otherwise(decided(x, px > 0.5))
        rest = F.when(a_done, item(x, F.greatest(F.lit(0.0), F.least(F.lit(1.0), px)))).otherwise(item(a, pa))
        return F.struct(F.array_append(acc["done"], done).alias("done"), rest.alias("rest"))

    kind = "array<struct<h: bigint, doc_id: bigint, size: bigint, copies: bigint, p: double>>"
    first = F.struct(F.array().cast(kind).alias("done"), F.element_at(items, 1).alias("rest"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), first, step)


def _settle(items: Column) -> Column:
    """The last residuals of a source, largest first, each taken once more or not, near the sum of their expected words.

    One is taken if it fits into what is left, or if leaving it out would miss
    by more, as all smaller ones together can't make up for it.
    """

    def words(x: Column) -> Column:
        return x["size"].cast("double")

    def step(acc: Column, x: Column) -> Column:
        smaller = acc["room"] - words(x)
        won = (acc["left"] >= words(x)) | (acc["left"] - smaller > words(x) - acc["left"])
        settled = F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), (x["copies"] + won.cast("long")).alias("copies"))
        return F.struct(
            F.array_append(acc["done"], settled).alias("done"),
            (acc["left"] - F.when(won, words(x)).otherwise(0.0)).alias("left"),
            smaller.alias("room"),
        )

    start = F.struct(
        F.array().cast("array<struct<doc_id: bigint, size: bigint, copies: bigint>>").alias("done"),
        F.aggregate(items, F.lit(0.0), lambda n, x: n + words(x) * x["p"]).alias("left"),
        F.aggregate(items, F.lit(0.0), lambda n, x: n + words(x)).alias("room"),
    )
    return F.aggregate(items, start, step, lambda acc: acc["done"])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs.

    taken = size * copies, at most 3 times the size.  Texts that are null,
    empty or without a word have size 0 and are never taken; a null source is a
    source; a null doc_id stays null; rows that repeat are rounded each for
    itself.  Other columns are ignored.  An empty table gives no rows.  The
    result depends on the rows and the seed alone, not on their order.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), sizes(text).alias("size"))
    base = materialise(base)
    goal = materialise(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))))
    expected = F.least(F.lit(float(MOST)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    # one row for each source: the join's small side, broadcast by the session's threshold or shuffled and split
    rows = base.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("whole", F.floor(expected + _EDGE)).withColumn("part", F.greatest(expected - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("part", F.when((F.col("part") < _EDGE) | (F.col("size") == 0), 0.0).otherwise(F.col("part")))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source"))
    plain = ["doc_id", "source", "size", F.col("whole").cast("long").alias("copies")]
    decided = rows.filter("part = 0").select(*plain)
    kind = F.floor(F.log2(F.col("size").cast("double")) * CLASSES).cast("int")
    open_ = rows.filter("part > 0").select(*plain, F.col("part").alias("p"), "h", kind.alias("class"))
    classes = materialise(open_.groupBy("source", "class").agg(F.count("*").alias("members")))
    keys = classes.select(F.col("source").alias("s"), F.col("class").alias("c"), "members")
    count, level = classes.agg(F.max("members")).first()[0] or 0, 0
    ended = (F.col("p") < _EDGE) | (F.col("p") > 1 - _EDGE)
    while count > 1:
        # a class of n rows has n / GROUP groups at the first level, whatever the others have
        own = F.greatest(F.lit(1), F.ceil(F.col("members") / float(GROUP ** (level + 1)))).cast("long")
        level_rows = open_.join(keys, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
        level_rows = level_rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed + level), "h", "doc_id", "size"), own))
        grouped = level_rows.groupBy("source", "class", "group").agg(F.sort_array(F.collect_list(F.struct("h", "doc_id", "size", "copies", "p"))).alias("items"))
        rounded = grouped.select("source", "class", _round(F.col("items"), F.lit(seed * 1000 + level)).alias("r"))
        items = rounded.select("source", "class", F.explode(F.concat("r.done", F.array("r.rest"))).alias("x")).select("source", "class", "x.*")
        items = materialise(items)
        # a residual that a step happened to bring to an end is decided, too
        decided = decided.unionByName(items.filter(ended).select("doc_id", "source", "size", (F.col("copies") + (F.col("p") > 0.5).cast("long")).alias("copies")))
        open_ = items.filter(~ended)
        count, level = math.ceil(count / GROUP), level + 1
    # one row for each source and class is left at most
    order = F.struct((-F.col("size")).alias("least"), "h", "doc_id", "size", "copies", "p")
    last = open_.groupBy("source").agg(F.sort_array(F.collect_list(order)).alias("items"))
    last = last.select("source", F.explode(_settle(F.col("items"))).alias("x")).select("x.doc_id", "source", "x.size", "x.copies")
    decided = decided.unionByName(last)
    out = decided.join(goal.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return out.select(
        F.col("doc_id").alias(doc_id), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
