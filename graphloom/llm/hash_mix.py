"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, spent, written

#: Bits of the hash that one histogram resolves, and how many histograms refine the boundary bucket in turn.
BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null or blank texts."""
    text = F.coalesce(text, F.lit(""))
    ends = [F.when(F.substring(text, at, 1).rlike(r"[\x20\x09-\x0D]"), 1).otherwise(0) for at in (1, -1)]
    # a text of white space alone splits into two empty parts, an empty text into one
    return (F.size(F.split(text, r"[\x20\x09-\x0D]+")) - ends[0] - ends[1] - F.when(text == "", 1).otherwise(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for one row a source (source, source_size).

    Sources in code-point order, null last, take the weights in turn. share times all sizes is dealt by weight; a target
    stops at most times its source's size, and what it leaves is dealt again until none is above. That end state is
    found in one pass: sources fill up in the order of cap / weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # the first source whose cap is above the level sets it for all that follow
    open_ = F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level"))
    t = t.withColumn("fill", F.first(open_, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    t = t.withColumn("target", F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fill") * F.col("w"))))
    return t.select("source", "source_size", "target")


def _bits():
    """60 bits of a hash of id and text."""
    said = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def _key():
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def plan_mix(docs: DataFrame, weights: list[float], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """(base, plan): a row (doc_id, source, size, bits, key) a document, and a row (key, source_size, target, whole, low,
    tied, deal) a source. A row is taken whole times, and once more where its bits are below low; of the tied rows whose
    bits are low itself, deal ones are.
    """
    # the compact table: one scan of the texts, then only ids, sizes and hashes are read
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _bits().alias("bits"))
    base = written(base.withColumn("key", _key()), "mix")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, list(weights), share, most).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("low", F.lit(0).cast("long"))
    plan = plan.withColumn("key", _key())
    plan = written(plan, "plan")
    for level in range(LEVELS):
        down = 60 - BITS * (level + 1)
        inside = base.select("key", "size", "bits").join(bounded(plan.where("left > 0").select("key", "low", "left"), 64), "key")
        if level:
            inside = inside.where(F.expr(f"shiftrightunsigned(bits, {down + BITS}) = shiftrightunsigned(low, {down + BITS})"))
        counts = inside.groupBy("key", F.expr(f"shiftrightunsigned(bits, {down})").alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("left").alias("left"))
        run = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("bucket")))
        # whole buckets under the budget are taken; the first that crosses it is refined
        cross = run.where("upto > left").groupBy("key").agg(F.min_by(F.struct("bucket", "n", "rows", "upto"), "bucket").alias("c"))
        was, crossed = plan, F.col("c").isNotNull()
        plan = plan.join(cross, "key", "left").select(
            "key", "source_size", "target", "whole",
            F.when(crossed, F.shiftleft("c.bucket", down)).when(F.col("left") > 0, F.lit(1 << 60)).otherwise(F.col("low")).cast("long").alias("low"),
            F.when(crossed, F.greatest(F.col("left") - (F.col("c.upto") - F.col("c.n")), F.lit(0.0)) + F.lit(1e-9)).otherwise(F.least("left", F.lit(0.0))).alias("left"),
            F.coalesce("c.rows", F.lit(0)).alias("tied"), F.coalesce("c.n", F.lit(0)).alias("n"),
        )
        plan = written(plan, "plan")
        spent(was)
    # low is now the first hash not wholly taken; of the rows that share it, as many are taken as come nearest
    deal = F.when(F.col("n") > 0, F.ceil(F.round(F.col("left") * F.col("tied") / F.col("n") - 0.5, 6))).otherwise(F.lit(0))
    return base, plan.select("key", "source_size", "target", "whole", "low", "tied", F.least(F.greatest(deal, F.lit(0)), "tied").cast("long").alias("deal"))


def _dealt(rows: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """rows (key, bits, ...) with the plan's columns and copies, how many times each is taken; rows never taken may go.

    Tied rows are repeats of one id and text. They alone are written down and numbered, within the table's parts first,
    so that a third of all rows may be tied without meeting in one task.
    """
    joined = rows.join(bounded(plan, 96), "key")
    copies = lambda more: F.least(F.col("whole") + F.when(more, 1).otherwise(0), F.lit(int(most)))
    several = plan.where("tied > 1 AND deal > 0 AND deal < tied").limit(1).count()
    tie = F.col("bits") == F.col("low")
    if not several:
        return joined.withColumn("copies", copies((F.col("bits") < F.col("low")) | (tie & (F.col("deal") > 0))))
    cut = (F.col("tied") > 1) & (F.col("deal") > 0) & (F.col("deal") < F.col("tied"))
    plain = joined.where(~(tie & cut)).withColumn("copies", copies((F.col("bits") < F.col("low")) | (tie & (F.col("deal") > 0))))
    tied = written(joined.where(tie & cut).withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()), "tied")
    parts = tied.groupBy("key", "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("key", "_part").orderBy("_n")) + F.col("_base")
    numbered = tied.join(bounded(parts, 96), ["key", "_part"]).withColumn("copies", copies(place <= F.col("deal"))).drop("_part", "_n", "_base")
    return plain.unionByName(numbered.select(plain.columns))


def mix(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs' rows with bits (of its hash), size, source_size, target and taken; text and columns of other names are left behind.

    A row is taken floor(target / source_size) times, and once more where its hash lies under the source's threshold.
    Thresholds nest: a higher budget takes a superset. Tokens are summed by source and hash bucket (at most 4,096 a
    source); the bucket where the running sum crosses the budget is the only one summed again, by the hash's next bits,
    five times in all; then a whole filter decides, and nothing is sorted.

    Null texts have size 0, null sources are a source of their own, empty sources have target 0. Repeated rows (same id
    and text) share a hash: those at the threshold are taken as many times as comes nearest to the target, and it makes
    no difference which. Reruns give the same rows, as the hash is of id and text alone. Extra columns are ignored; an
    empty table gives none.
    """
    base, plan = plan_mix(docs, list(weights), share, most)
    return _dealt(base, plan, most).select("doc_id", "source", "bits", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs' rows, all columns, each as many times as mix() takes it. The thresholds go to the rows; no text is moved.

    Of repeated rows at the threshold that differ in other columns, which ones are taken follows the files' order.
    """
    base, plan = plan_mix(docs, list(weights), share, most)
    rows = docs.select(F.struct("*").alias("row"), _key().alias("key"), _bits().alias("bits"))
    taken = _dealt(rows, written(plan, "plan"), most).where("copies > 0")
    spent(base)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n")).select("row.*")
