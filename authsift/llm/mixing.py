"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in the order (size, md5 of the id, id).  Each
is expected ``target / source_size`` times; the running sum of the expected
copies plus one random offset is taken, and a document is emitted once for
every integer boundary its own step crosses.  Expected copies are at most 3,
so no document is taken more than 3 times.  Large documents (over 1/50 of their
source, so fewer than 50) are sampled first; the others' expected copies are what
is left of the target over what is left of the source.  With the order by size,
the words taken stay within about 1/50 of the source of the target.

The running sum is never computed in one task per source: counts per (source,
size) and per (source, size, first digits of the md5) are summed on the map
side, the running sums are taken over these counts, and only rows of one
(source, size, md5 digits) cell are numbered together.

Edge cases: null text and text without words have size 0 and take 0; a null
source is a source of its own, last in order; a null id has the md5 of the
empty text; repeated rows count as often as they stand, rows that tie in size, md5 and
id are interchangeable; a very long text is one large document; extra columns, also with
clashing names, are ignored or, in ``mixed``, passed on; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authsift.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
MAX_COPIES = 3
LARGE_PART = 50
OFFSET = 0.8254
"""The offset drawn once for the production mix; reruns agree because it is a parameter."""


def n_words(col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame) -> DataFrame:
    """(skey, source_size, target) from (skey, size): one row per source.

    Weights 1, 2, 3 repeat in order.  With a common level x, a source gets
    min(3 * its size, x * its weight); resharing the excess by weight until none
    is above its cap ends at exactly that level, which is found among the sources
    ordered by size / weight.
    """
    per = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", (F.row_number().over(Window.orderBy("skey")) - 1) % 3 + 1)
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "skey")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - MAX_COPIES * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    per = per.withColumn("level", left.cast("double") / F.sum("weight").over(onward).cast("double")) \
        .withColumn("nth", F.row_number().over(by_level)) \
        .withColumn("cap", MAX_COPIES * F.col("source_size").cast("double"))
    # the first source that the level leaves under its cap, and all after it, take level * weight
    under = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))
    per = per.withColumn("level", F.min(under).over(whole)["level"])
    return per.select("skey", "source_size",
                      F.least(F.col("level") * F.col("weight"), F.col("cap")).alias("target"))


def mix(docs: DataFrame, keep: list[str] | None = None, text: str = "text", source: str = "source",
        id_col: str = "doc_id", offset: float = OFFSET, digits: int = 2,
        large_part: int = LARGE_PART) -> DataFrame:
    """``id_col`` (or the ``keep`` columns as struct ``row``) with size, source_size, target, copies, taken.

    ``offset``: the random offset in [0, 1); ``digits``: hex digits of the md5 that
    split a (source, size) group; ``large_part``: a document above 1/large_part of
    its source is large.
    """
    narrow = keep is None
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t"))  # null after every value
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    carried = F.col(id_col) if narrow else F.struct(*keep)
    rows = docs.select(carried.alias("row"), skey.alias("skey"), n_words(text).alias("size"), md5.alias("md5"),
                       F.col(id_col).alias("id")).withColumn("cell", F.substring("md5", 1, digits))
    rows = saved(rows) if narrow else rows
    cells = saved(rows.groupBy("skey", "size", "cell").agg(F.count(F.lit(1)).alias("n")))
    targets = source_targets(cells.select("skey", (F.col("size") * F.col("n")).alias("size")))
    running = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = lambda at: F.floor(at.cast("double") * F.col("words_out") / F.col("words_in").cast("double") + F.lit(offset))
    sizes = cells.groupBy("skey", "size").agg(F.sum("n").alias("n")).join(targets, "skey") \
        .withColumn("large", F.col("size") * large_part > F.col("source_size")) \
        .withColumn("before_size", running(Window.partitionBy("skey", "large").orderBy("size")))
    # what the large documents take, from the counts alone; the others share the rest of the target
    by_source = Window.partitionBy("skey")
    sizes = sizes.withColumn("words_out", F.col("target")).withColumn("words_in", F.col("source_size")) \
        .withColumn("large_taken", F.sum(F.when(F.col("large"), F.col("size") * (
            step(F.col("before_size") + F.col("n")) - step(F.col("before_size"))))).over(by_source)) \
        .withColumn("small_size", F.sum(F.when(~F.col("large"), F.col("size") * F.col("n"))).over(by_source))
    rest = F.greatest(F.col("target") - F.coalesce("large_taken", F.lit(0)), F.lit(0.0))
    sizes = sizes.select("skey", "size", "before_size", "source_size", "target",
                         F.when(F.col("large"), F.col("target")).otherwise(
                             F.least(rest, MAX_COPIES * F.col("small_size").cast("double"))).alias("words_out"),
                         F.when(F.col("large"), F.col("source_size")).otherwise(F.col("small_size")).alias("words_in"))
    plan = cells.withColumn("before_cell", running(Window.partitionBy("skey", "size").orderBy("cell"))) \
        .join(sizes, ["skey", "size"]) \
        .select("skey", "size", "cell", (F.col("before_cell") + F.col("before_size")).alias("before"),
                "source_size", "target", "words_out", "words_in")
    out = rows.withColumn("k", F.row_number().over(Window.partitionBy("skey", "size", "cell").orderBy("md5", "id"))) \
        .join(plan, ["skey", "size", "cell"])
    k = F.col("k") + F.col("before")
    copies = F.when(F.col("size") > 0, F.least(step(k) - step(k - 1), F.lit(MAX_COPIES))).otherwise(0).cast("bigint")
    out = out.withColumn("copies", copies)
    return out.select(F.col("row").alias(id_col if narrow else "row"), "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``."""
    out = mix(docs, keep=list(docs.columns), **options)
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")) \
        .select("row.*")
