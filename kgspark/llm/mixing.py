"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import fresh

#: No source is repeated more often than this.
MAX_EPOCHS = 4
SEED = 20240229
#: Rates are whole numbers of this unit, so every engine and partitioning computes the same ones.
UNIT = 1_000_000
#: Rates of up to so many sources are broadcast; beyond, rows meet their rate in a join.
MAX_BROADCAST_SOURCES = 100_000


def source_rates(docs: DataFrame, weights: dict[str, int] | None = None, *, budget_share: float = 1.0, max_epochs: int = MAX_EPOCHS, text: str = "text", source: str = "source") -> DataFrame:
    """(source, size, weight, rate): rate is how often a source is read, in units of 1/UNIT.

    Sizes are characters over all documents. Water-filling in closed form: ordered by the level at
    which they reach their cap (size x max_epochs / weight), the first sources are clamped and the
    others share what is left in proportion to their weights; the level is feasible at the first
    source that stays below its cap. Without weights, a source's target is the square root of its size.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        sized = sizes.withColumn("weight", F.floor(F.sqrt("size")))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))]
        given = F.create_map(*pairs)[F.col("source")] if pairs else F.lit(None).cast("long")
        sized = sizes.withColumn("weight", F.coalesce(given, F.lit(0).cast("long")))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    live = sized.where("size > 0 and weight > 0")
    level = (F.col("size") * max_epochs).cast("double") / F.col("weight")
    order = W.orderBy(level.asc(), F.col("source").asc())
    filled = (
        live.crossJoin(sized.agg(F.floor(F.coalesce(F.sum("size"), F.lit(0)) * F.lit(float(budget_share))).cast("long").alias("budget")))
        .withColumn("clamped", F.coalesce(F.sum(F.col("size") * max_epochs).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("feasible", (big("budget") - big("clamped")) * big("weight") <= big("size") * F.lit(max_epochs) * big("left_weight"))
    )
    first = filled.where("feasible").agg(F.min(F.struct(level.alias("level"), "source", F.greatest(F.col("budget") - F.col("clamped"), F.lit(0)).alias("rest"), "left_weight")).alias("at"))
    return (
        filled.crossJoin(first)
        .withColumn("below", F.col("at").isNotNull() & ((level > F.col("at.level")) | ((level == F.col("at.level")) & (F.col("source") >= F.col("at.source")))))
        .withColumn("rate", F.when(F.col("below"), F.expr(f"cast(cast(at.rest as decimal(19,0)) * weight * {UNIT} div (cast(size as decimal(19,0)) * at.left_weight) as long)")).otherwise(F.lit(max_epochs * UNIT).cast("long")))
        .select("source", "size", "weight", F.least(F.col("rate"), F.lit(max_epochs * UNIT)).cast("long").alias("rate"))
    )


def draw(key: Column, seed: int) -> Column:
    """A seeded number in 0 … UNIT - 1 for each key: the first 13 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") % UNIT


def mix(
    docs: DataFrame, weights: dict[str, int] | None = None, *, budget_share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED, key: str = "doc_id",
    text: str = "text", source: str = "source", copy: str | None = "copy", max_broadcast_sources: int = MAX_BROADCAST_SOURCES,
) -> DataFrame:
    """docs repeated to the mix: each row as often as its source's whole rate, and once more with the
    probability of its fraction, drawn from the seed and the key. ``copy`` numbers the repetitions.

    Sources with no weight (or of empty texts only) aren't read. A null source is the source "".
    Null or empty text counts as size 0 and follows its source. Null keys draw as the empty string;
    rows that repeat a key draw alike. Empty table: empty result. Names that clash get underscores.
    """
    rates = source_rates(docs, weights, budget_share=budget_share, max_epochs=max_epochs, text=text, source=source)
    src, rate, number = fresh(docs, "_source", "_rate", copy or "_copy")
    rates = rates.select(F.col("source").alias(src), F.col("rate").alias(rate))
    small = docs.select(F.approx_count_distinct(source)).first()[0] <= max_broadcast_sources
    rates = F.broadcast(rates) if small else rates
    n = (F.expr(f"`{rate}` div {UNIT}") + (draw(F.col(key), seed) < F.col(rate) % UNIT).cast("long")).cast("int")
    out = docs.withColumn(src, F.coalesce(F.col(source).cast("string"), F.lit(""))).join(rates, src).withColumn(rate, n).where(F.col(rate) > 0)
    out = out.withColumn(number, F.explode(F.sequence(F.lit(0), F.col(rate) - 1)))
    return out.drop(src, rate) if copy else out.drop(src, rate, number)
