"""Food rows as prose: what they hold, what they are a good source of, and whom they concern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T

# Headings, names and the least amount that makes a food a source of each.
SOURCES = [
    ("Calories (kcal)", "năng lượng", 300.0), ("Protein (g)", "protein", 10.0), ("Fat (g)", "chất béo", 10.0), ("Carbonhydrates (g)", "carbohydrate", 30.0), ("Chất xơ (g)", "chất xơ", 3.0),
    ("Cholesterol (mg)", "cholesterol", 50.0), ("Canxi (mg)", "canxi", 100.0), ("Photpho (mg)", "phospho", 100.0), ("Sắt (mg)", "sắt", 3.0), ("Natri (mg)", "natri", 200.0),
    ("Kali (mg)", "kali", 200.0), ("Beta Caroten (mcg)", "beta caroten", 100.0), ("Vitamin A (mcg)", "vitamin A", 50.0), ("Vitamin B1 (mg)", "vitamin B1", 0.1), ("Vitamin C (mg)", "vitamin C", 10.0),
]
NAME, GROUP = "TÊN THỨC ĂN", "Loại"
# The sentences, with the places of name, group, lists and amounts.
GROUPED = "{name} là một thực phẩm thuộc nhóm {group}."
UNGROUPED = "{name} là một thực phẩm phổ biến trong ẩm thực Việt Nam."
HOLDS = "Thành phần dinh dưỡng trong 100g {name} bao gồm: {items}."
SOURCE = "{name} được xem là nguồn {items} tốt."
SODIUM = "Do chứa nhiều natri ({amount} mg), {name} có thể làm trầm trọng thêm bệnh tăng huyết áp và bệnh thận."
FAT = "{name} chứa nhiều chất béo và cholesterol, cần hạn chế ở người mắc bệnh tim mạch và gan nhiễm mỡ."
CARBS = "Hàm lượng carbohydrate cao ({amount} g) trong {name} có thể ảnh hưởng đến đường huyết, người bệnh tiểu đường cần thận trọng khi sử dụng."
FIBRE = "Chất xơ trong {name} ({amount} g) có tác dụng hỗ trợ kiểm soát đường huyết và phòng ngừa táo bón."


def _cell(df: DataFrame, heading: str) -> Column:
    return T.strip(F.coalesce(F.col(f"`{heading}`").cast("string"), F.lit(""))) if heading in df.columns else F.lit("")


def _rows(df: DataFrame, sources: list[tuple[str, str, float]]) -> Column:
    """(name, unit, said, amount, least) of each nutrient, in order."""
    row = lambda h, n, t: F.struct(F.lit(n).alias("name"), T.unit(F.lit(h)).alias("unit"), F.replace(_cell(df, h), F.lit(","), F.lit(".")).alias("said"), T.decimal(_cell(df, h), 0.0).alias("amount"), F.lit(t).alias("least"))
    return F.array(*[row(*s) for s in sources])


def source_tags(df: DataFrame, sources: list[tuple[str, str, float]] = SOURCES) -> Column:
    """Names of the nutrients of which a row (cells as text, decimals with comma or point) has the least amount."""
    return F.transform(F.filter(_rows(df, sources), lambda x: (x["amount"] > 0) & (x["amount"] >= x["least"])), lambda x: x["name"])


def paragraph(df: DataFrame, sources: list[tuple[str, str, float]] = SOURCES) -> Column:
    """A row as prose; null without a name."""
    name, group = _cell(df, NAME), _cell(df, GROUP)
    amount = lambda h: T.decimal(_cell(df, h), 0.0)
    held = F.transform(F.filter(_rows(df, sources), lambda x: x["amount"] > 0), lambda x: F.concat(x["name"], F.lit(": "), x["said"], F.lit(" "), x["unit"]))
    tags = source_tags(df, sources)
    listed = lambda template, items: F.when(F.size(items) > 0, T.fill(template, name=name, items=F.array_join(items, ", ")))
    said = lambda template, heading, high: F.when(high, T.fill(template, name=name, amount=_cell(df, heading)))
    lines = [
        F.when(~group.isin("", "None"), T.fill(GROUPED, name=name, group=group)).otherwise(T.fill(UNGROUPED, name=name)),
        listed(HOLDS, held),
        listed(SOURCE, tags),
        said(SODIUM, "Natri (mg)", amount("Natri (mg)") > 400),
        said(FAT, "Fat (g)", (amount("Fat (g)") > 15) | (amount("Cholesterol (mg)") > 100)),
        said(CARBS, "Carbonhydrates (g)", amount("Carbonhydrates (g)") > 50),
        said(FIBRE, "Chất xơ (g)", amount("Chất xơ (g)") >= 3),
    ]
    return F.when(name != "", F.concat_ws(" ", *lines))
