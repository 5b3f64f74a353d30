"""Column functions over vectors (arrays of numbers), computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, guard: float = 1e-9) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(guard))


def normalized(a: Column) -> Column:
    return let(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def last_token(tokens: Column, mask: Column) -> Column:
    """The vector of the last token whose mask is 1, of a text's token vectors; null where there is none."""
    return F.get(tokens, F.array_max(F.transform(mask, lambda m, i: F.when(m == 1, i))))


def info_nce(positive: Column, negatives: Column, temperature: float = 0.1) -> Column:
    """-log of the positive's share among it and the negatives, scores divided by the temperature.

    The negatives are the query's own (paired), or those of all queries alike (unpaired).
    """
    t = F.lit(float(temperature))
    others = F.aggregate(negatives, F.lit(0.0), lambda s, x: s + F.exp(x / t))
    return -F.log(F.exp(positive / t) / (F.exp(positive / t) + others))


def info_nce_in_batch(rows: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(batch, q, loss) of rows (batch, q, v, w): v is the query's vector, w its positive's; the other rows of its batch
    give the negatives. A batch is a training batch, small by nature; batches are joined with themselves only."""
    a = rows.select("batch", "q", normalized(F.col("v")).alias("v"))
    b = rows.select("batch", F.col("q").alias("t"), normalized(F.col("w")).alias("w"))
    s = a.join(b, "batch").select("batch", "q", "t", (dot(F.col("v"), F.col("w")) / F.lit(float(temperature))).alias("s"))
    own = F.max(F.when(F.col("q") == F.col("t"), F.col("s")))
    return s.groupBy("batch", "q").agg((F.log(F.sum(F.exp("s"))) - own).alias("loss"))
