"""The knowledge graph that the registered queries run on, derived from the relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, r, o), with repeats."""
    t = lambda n: table(spark, sf_dir, n)
    row = lambda df, s, r, o: df.select(F.col(s).alias("s"), F.lit(r).alias("r"), F.col(o).alias("o"))
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    part, customer = t("part"), t("customer")
    parts = [
        row(part, "p_name", "has_brand", "p_brand"),
        row(part, "p_name", "has_type", "p_type"),
        row(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "located_in", "n_name"),
        row(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "located_in", "n_name"),
        row(nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "part_of", "r_name"),
        row(customer, "c_name", "in_segment", "c_mktsegment"),
        row(t("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")), "c_name", "ordered_with", "o_orderpriority"),
    ]
    return reduce(DataFrame.unionByName, parts)


#: The same for DuckDB, to follow WITH.
TRIPLES_SQL = """kg AS (
  SELECT p_name AS s, 'has_brand' AS r, p_brand AS o FROM part
  UNION ALL SELECT p_name, 'has_type', p_type FROM part
  UNION ALL SELECT s_name, 'located_in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, 'located_in', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, 'in_segment', c_mktsegment FROM customer
  UNION ALL SELECT c_name, 'ordered_with', o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)"""


def labelled(df: DataFrame) -> DataFrame:
    """Distinct edges with labels: Part, Brand, Type, Place, Party, Segment or Priority."""
    label = F.when(F.col("r").isin("has_brand", "has_type"), "Part").when(F.col("r") == "part_of", "Place").otherwise("Party")
    other = F.when(F.col("r") == "has_brand", "Brand").when(F.col("r") == "has_type", "Type").when(F.col("r") == "in_segment", "Segment").when(F.col("r") == "ordered_with", "Priority").otherwise("Place")
    return df.distinct().select(label.alias("s_label"), F.col("s").alias("s_name"), F.upper("r").alias("rel_type"), F.col("r").alias("relation"), other.alias("o_label"), F.col("o").alias("o_name"))


EDGES_SQL = TRIPLES_SQL + """, edges AS (SELECT DISTINCT
  CASE WHEN r IN ('has_brand', 'has_type') THEN 'Part' WHEN r = 'part_of' THEN 'Place' ELSE 'Party' END AS s_label, s AS s_name,
  upper(r) AS rel_type, r AS relation,
  CASE r WHEN 'has_brand' THEN 'Brand' WHEN 'has_type' THEN 'Type' WHEN 'in_segment' THEN 'Segment' WHEN 'ordered_with' THEN 'Priority' ELSE 'Place' END AS o_label, o AS o_name FROM kg),
nodes AS (SELECT s_label AS label, s_name AS name FROM edges UNION SELECT o_label, o_name FROM edges)"""


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("s_label").alias("label"), F.col("s_name").alias("name")), F.struct(F.col("o_label").alias("label"), F.col("o_name").alias("name")))).alias("n")).select("n.*").distinct()
