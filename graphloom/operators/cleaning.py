"""Rule cleaning, first-wins deduplication, merging and splitting of triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.sources.work import saved

# The rule stage's word lists.
NUTRIENTS = [
    "protein", "chất béo", "carbohydrate", "chất xơ", "năng lượng", "canxi", "phospho", "sắt", "natri", "kali", "beta caroten", "vitamin b1", "vitamin b2", "vitamin c", "vitamin a", "vitamin d", "vitamin k", "cholesterol", "purin", "đường", "muối", "magie", "kẽm", "đồng", "selen", "iốt", "folate", "axit béo", "axit béo bão hòa", "axit béo trans", "axit béo không bão hòa", "axit béo không bão hòa đa", "axit béo không bão hòa đơn", "mufa", "pufa", "omega-3", "omega-6", "glucose", "fructose", "chất béo bão hòa", "chất béo không bão hòa", "axit uric", "lipid", "tinh bột", "đường tinh luyện", "đường bổ sung", "fiber", "fat", "sugar", "sodium", "calcium", "iron", "potassium",
]
INVERTED = ["giàu", "chứa", "nhiều", "ít"]
ABSTRACT_BEGINNINGS = ["hướng dẫn", "liệu pháp", "mô hình", "đếm", "phương pháp", "chương trình", "kế hoạch", "chiến lược", "can thiệp", "nghiên cứu", "bằng chứng", "khuyến cáo", "hội"]
ABSTRACT = ["hoạt động thể chất", "giảm cân", "liệu pháp ăn kiêng", "liệu pháp dinh dưỡng cá thể hóa", "liệu pháp dinh dưỡng", "carcinogens", "người bệnh", "tình trạng", "bệnh nhân", "người mắc bệnh", "tình trạng bệnh", "sức khỏe"]
GENERIC = ["sức khỏe", "chế độ ăn uống", "chế độ ăn", "chế độ ăn kiêng", "chế độ ăn uống hàng ngày", "chế độ ăn uống lành mạnh", "tiêu thụ protein", "tiêu thụ carbohydrate", "tiêu thụ vitamin", "tiêu thụ khoáng chất", "xác định nồng độ insulin", "duy trì trọng lượng khỏe mạnh", "giảm nguy cơ bệnh tim mạch", "người bệnh", "cơ thể", "thể trạng"]
SYNONYMS = {
    "dkd": "suy thận do tiểu đường", "ckd": "suy thận", "suy thận mãn tính": "suy thận", "bệnh suy thận": "suy thận", "gerd": "trào ngược dạ dày thực quản", "cvd": "bệnh tim mạch", "htn": "tăng huyết áp", "tha": "tăng huyết áp", "bệnh tha": "tăng huyết áp", "người bệnh tha": "tăng huyết áp", "cao huyết áp": "tăng huyết áp", "bệnh tăng huyết áp": "tăng huyết áp", "dm": "tiểu đường", "t2dm": "tiểu đường tuýp 2", "đái tháo đường": "tiểu đường", "bệnh tiểu đường": "tiểu đường", "người bệnh tiểu đường": "tiểu đường", "bệnh béo phì": "béo phì", "người béo phì": "béo phì", "người thừa cân béo phì": "béo phì", "bệnh gút": "gout", "người bệnh gút": "gout", "bệnh gout": "gout", "người bệnh gout": "gout", "kiểm soát bệnh gout": "gout",
}


def mapped(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    """table's value for key, or otherwise."""
    if not table:
        return otherwise
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), otherwise)


def is_abstract(s: Column, exact: list[str] = ABSTRACT, beginnings: list[str] = ABSTRACT_BEGINNINGS) -> Column:
    x = F.lower(strip(s))
    hit = x.isin(exact)
    for b in beginnings:
        hit = hit | x.startswith(b)
    return hit


def is_generic(o: Column, exact: list[str] = GENERIC) -> Column:
    return F.lower(strip(o)).isin(exact)


def is_nutrient(name: Column, nutrients: list[str] = NUTRIENTS) -> Column:
    return F.lower(strip(name)).isin(nutrients)


def synonym(e: Column, table: dict[str, str] = SYNONYMS) -> Column:
    return mapped(F.lower(strip(e)), table, e)


def straightened(triples: DataFrame, inverted: list[str] = INVERTED, nutrients: list[str] = NUTRIENTS) -> DataFrame:
    """Subject and object swapped where the relation is inverted and only the subject is a nutrient."""
    swap = F.lower("r").isin(inverted) & is_nutrient(F.col("s"), nutrients) & ~is_nutrient(F.col("o"), nutrients)
    return triples.withColumns({"s": F.when(swap, F.col("o")).otherwise(F.col("s")), "o": F.when(swap, F.col("s")).otherwise(F.col("o"))})


def first_of_each(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key. min_by in place of a window: it combines before the exchange, so hot keys stay small."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    packed = df.select(*[k.alias(n) for n, k in named.items()], F.struct(*order).alias("_o"), F.struct(*df.columns).alias("_r"))
    return packed.groupBy(*named).agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def rule_clean(triples: DataFrame, order: list[str], synonyms: dict[str, str] = SYNONYMS, abstract: list[str] = ABSTRACT, beginnings: list[str] = ABSTRACT_BEGINNINGS, generic: list[str] = GENERIC, inverted: list[str] = INVERTED, nutrients: list[str] = NUTRIENTS) -> DataFrame:
    """Trim, synonyms, abstract subjects and generic objects dropped, direction, then the first spelling of each triple."""
    t = triples.withColumns({c: strip(F.col(c)) for c in ("s", "r", "o")}).where("s <> '' AND r <> '' AND o <> ''")
    t = t.withColumns({"s": synonym(F.col("s"), synonyms), "o": synonym(F.col("o"), synonyms)})
    t = t.where(~is_abstract(F.col("s"), abstract, beginnings) & ~is_generic(F.col("o"), generic))
    return first_of_each(straightened(t, inverted, nutrients), [F.lower("s"), F.lower("r"), F.lower("o")], order)


def embedding_text(name: Column) -> Column:
    """The form of a name that is embedded: lower case, '_' as a blank."""
    return strip(F.replace(F.lower(name), F.lit("_"), F.lit(" ")))


def rewritten(triples: DataFrame, names: DataFrame, order: list[str]) -> DataFrame:
    """Endpoints replaced by their representatives (name, leader), self-loops dropped, exact duplicates dropped."""
    for c in ("s", "o"):
        to = names.select(F.col("name").alias(c), F.col("leader").alias("_to"))
        triples = triples.join(to, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return first_of_each(triples.where("s <> o"), [F.col("s"), F.col("r"), F.col("o")], order)


def contradictions(triples: DataFrame, avoid: list[str], recommend: list[str]) -> DataFrame:
    """Pairs (s, o) that are both to be avoided and recommended: what merging of opposites leaves behind."""
    kind = F.when(F.lower("r").isin(avoid), "avoid").when(F.lower("r").isin(recommend), "recommend")
    return triples.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("s", "o").agg(F.count_distinct("kind").alias("kinds")).where("kinds = 2").select("s", "o")


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """df with name: each row's place from 0 in the given order (ties in any order).

    The range-sorted table is written once with its part and the place in it, so counts and places are of the same parts;
    only the short list of counts meets in one task.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    # the lower 33 bits of the id are the row's place in its part
    ranged = saved(ranged.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    counts = ranged.groupBy("_p").agg(F.max("_i").alias("_n"))
    base = counts.select("_p", F.coalesce(F.sum(F.col("_n") + 1).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranged.join(base, "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def split_parts(df: DataFrame, order: str, parts: int) -> DataFrame:
    """df with part: rows in order cut into parts of ceil(rows / parts); the last may be short or missing."""
    placed = numbered(df, [order], "_at")
    size = max(1, -(-placed.count() // parts))
    return placed.withColumn("part", F.floor(F.col("_at") / size).cast("bigint")).drop("_at")
