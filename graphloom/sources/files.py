"""Readers and writers of the pipeline's files."""

from __future__ import annotations

import hashlib
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph
from graphloom.operators.cleaning import numbered
from graphloom.operators.evaluation import evaluation_rows, length_filter
from graphloom.sources.commits import commit, fresh_data, last_commit, tidy
from graphloom.sources.work import saved
from graphloom.sources.xlsx import _file_system, read_xlsx

# Spreadsheet headings and the properties they become.
FOOD_COLUMNS = {
    "TÊN THỨC ĂN": "name", "Calories (kcal)": "calories", "Protein (g)": "protein", "Fat (g)": "fat", "Carbonhydrates (g)": "carbs", "Chất xơ (g)": "fiber", "Cholesterol (mg)": "cholesterol", "Canxi (mg)": "calcium", "Photpho (mg)": "phosphorus", "Sắt (mg)": "iron", "Natri (mg)": "sodium", "Kali (mg)": "potassium", "Beta Caroten (mcg)": "beta_carotene", "Vitamin A (mcg)": "vitamin_a", "Vitamin B1 (mg)": "vitamin_b1", "Vitamin C (mg)": "vitamin_c", "Loại": "food_group",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text): lines in order, blank ones too, numbered within each file.

    Files are read in blocks: a line's place is its place in its block and the lines of the blocks before.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("m"))
    placed = raw.withColumn("at", F.row_number().over(Window.partitionBy("file", "block").orderBy("m")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("file", "block").agg(F.max("at").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(base, ["file", "block"]).select("file", (F.col("base") + F.col("at") - 1).cast("bigint").alias("line_no"), "text")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


#: Bytes of a file that are held at once, and lines of a file of paragraphs.
PIECE_BYTES, FILE_LINES = 1 << 20, 100_000


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """(files, digest): how many files a folder has and the md5 of their bytes, one after the other in order of name. A
    digest is sequential, so one task reads them all, but it holds PIECE_BYTES of them, whatever their size."""
    names = spark.read.format("binaryFile").load(path).agg(F.array_sort(F.collect_list("path")).alias("names"))

    def work(frames):
        for pdf in frames:
            for found in pdf["names"]:
                md5 = hashlib.md5()
                for name in found:
                    fs, at = _file_system(name)
                    with fs.open_input_stream(at, compression=None) as f:
                        while piece := f.read(PIECE_BYTES):
                            md5.update(piece)
                yield pd.DataFrame({"files": [len(found)], "digest": [md5.hexdigest()]})

    return names.mapInPandas(work, "files bigint, digest string")


def read_sheet(spark: SparkSession, path: str, sheet: str = "0") -> DataFrame:
    """A spreadsheet's rows as strings, in order: CSV, or, by the path's ending, an .xlsx file or a folder of them."""
    if path.rstrip("/").endswith(".xlsx"):
        return read_xlsx(spark, path, sheet=sheet)
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_food(spark: SparkSession, path: str, missing: float | None = None, sheet: str = "0") -> DataFrame:
    """A food table, .xlsx or CSV: headings renamed, comma-decimals parsed, the last row of a name (any case) wins."""
    df = read_sheet(spark, path, sheet).withColumn("_row", F.monotonically_increasing_id())
    df = df.withColumnsRenamed({k: v for k, v in FOOD_COLUMNS.items() if k in df.columns})
    df = df.withColumns({c: T.decimal(F.col(c), missing) for c in FOOD_COLUMNS.values() if c in df.columns and c not in ("name", "food_group")})
    keyed = df.where("name IS NOT NULL").groupBy(F.lower(T.strip(F.col("name"))).alias("key")).agg(F.max_by(F.struct(*[c for c in df.columns if c != "_row"]), "_row").alias("r"))
    return keyed.select("key", "r.*")


def read_schema(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(relation, definition, ord): commas in a definition are kept; the last line of a relation wins. header: the first
    line of each file is headings, not a relation."""
    lines = read_lines(spark, path).where(F.length(T.strip(F.col("text"))) > 0)
    if header:
        lines = lines.where("line_no > 0")
    parts = lines.select("file", "line_no", T.strip(F.regexp_extract("text", "^([^,]*)", 1)).alias("relation"), T.strip(F.regexp_replace("text", "^[^,]*,?", "")).alias("definition"))
    return parts.groupBy("relation").agg(F.max_by("definition", F.struct("file", "line_no")).alias("definition"), F.min("line_no").cast("bigint").alias("ord"))


def read_triples(spark: SparkSession, path: str, nested_only: bool = False) -> DataFrame:
    """(src, chunk_no, pos, s, r, o) of files with a list of triples, or one triple, a line."""
    found = T.clean_triple_literals(F.col("text")) if nested_only else T.triple_literals(F.col("text"))
    rows = read_lines(spark, path).select(F.col("file").alias("src"), F.col("line_no").alias("chunk_no"), F.posexplode(found).alias("pos", "t"))
    return rows.select("src", "chunk_no", "pos", *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate("sro")])


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (sentence, triples) as (text, triples)."""
    return spark.read.schema("sentence string, triples array<array<string>>").json(path).select(F.col("sentence").alias("text"), "triples")


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_evaluation_xml(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(entry, triples) of entries with 's | r | o' texts; kind: gtriple (gold: mtriple) as the element's name."""
    holder = "generatedtripleset" if kind == "gtriple" else "modifiedtripleset"
    schema = f"_eid string, {holder} struct<{kind}:array<string>>"
    return spark.read.schema(schema).option("rowTag", "entry").xml(path).select(F.col("_eid").alias("entry"), F.coalesce(F.col(f"{holder}.{kind}"), F.array().cast("array<string>")).alias("triples"))


def write_evaluation_xml(df: DataFrame, path: str, kind: str) -> None:
    """df (entry, triples: array of strings)."""
    holder = "generatedtripleset" if kind == "gtriple" else "modifiedtripleset"
    df.select(F.col("entry").alias("_eid"), F.struct(F.col("triples").alias(kind)).alias(holder)).write.option("rowTag", "entry").option("rootTag", "entries").xml(path)


def write_lines(df: DataFrame, column: str, order: list[str], path: str, parts: int = 1) -> None:
    """A column as text in order: range-sorted, so that files in order of name hold the lines in order. An existing path is
    refused. One part makes one file; more are written by as many tasks."""
    rows = df.repartitionByRange(parts, *order) if parts > 1 else df.coalesce(1)
    rows.sortWithinPartitions(*order).select(F.col(column).cast("string").alias("value")).write.mode("errorifexists").text(path)


def write_prose(df: DataFrame, path: str) -> None:
    """Documents (doc, text) as lines in order of doc, one file."""
    write_lines(df, "text", ["doc"], path)


def read_prompt(spark: SparkSession, path: str) -> str:
    """A template or few-shot text."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_cells(spark: SparkSession, path: str, sheet: str = "0") -> DataFrame:
    """(row, col, heading, value) of a spreadsheet, .xlsx or CSV: the first line's headings, then each cell in order."""
    df = numbered(read_sheet(spark, path, sheet).withColumn("_m", F.monotonically_increasing_id()), ["_m"], "row").drop("_m")
    cells = F.array(*[F.struct(F.lit(h).alias("heading"), F.col(f"`{h}`").alias("value")) for h in df.columns if h != "row"])
    return df.select("row", F.posexplode(cells).alias("col", "c")).select("row", "col", "c.heading", "c.value")


def write_evaluation(predicted: DataFrame, gold: DataFrame, path: str, most: int | None = None) -> None:
    """Two tables of lines (line_no, text) as pred and ref below path: rows that cannot be read go with their gold, and so
    do those whose numbers of triples differ by more than most."""
    rows = evaluation_rows(predicted, gold)
    if most is not None:
        rows = length_filter(rows, most)
    for name, kind, column in (("pred", "gtriple", "predicted"), ("ref", "mtriple", "gold")):
        write_evaluation_xml(rows.select(F.col("line_no").alias("entry"), F.col(column).alias("triples")), f"{path}/{name}", kind)


def triple_text(s="s", r="r", o="o"):
    """A triple as a list literal."""
    quoted = lambda c: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(F.col(c), r"\\", r"\\\\"), "'", r"\\'"), F.lit("'"))
    return F.concat(F.lit("["), F.concat_ws(", ", quoted(s), quoted(r), quoted(o)), F.lit("]"))


def write_chunk_triples(df: DataFrame, path: str, parts: int = 1) -> None:
    """One line a chunk, its list of triples in order."""
    rows = df.withColumn("t", triple_text()).groupBy("chunk_no").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("l"))
    write_lines(rows.withColumn("line", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["t"]), ", "), F.lit("]"))), "line", ["chunk_no"], path, parts)


def write_flat_triples(df: DataFrame, order: list[str], path: str, parts: int = 1) -> None:
    write_lines(df.withColumn("line", triple_text()), "line", order, path, parts)


def write_stages(df: DataFrame, path: str, iteration: int) -> None:
    """Stage records as JSON; an existing iteration is refused."""
    df.write.mode("errorifexists").json(str(PurePosixPath(path) / f"iter={iteration}"))


def write_paragraphs(df: DataFrame, column: str, order: str, path: str, size: int = 20, parts: int | None = None) -> None:
    """Paragraphs in order, a blank line after every size of them and after the last; in files of about FILE_LINES of them,
    in order of name, unless parts says how many."""
    placed = numbered(df, [order], "_at")
    last = placed.count() - 1
    parts = parts or 1 + last // FILE_LINES
    line = F.when((F.col("_at") % size == size - 1) | (F.col("_at") == last), F.concat(F.col(column), F.lit("\n"))).otherwise(F.col(column))
    write_lines(placed.withColumn("line", line), "line", ["_at"], path, parts)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_split(df: DataFrame, path: str, shares=(0.75, 0.125, 0.125), seed: int = 7, key: list[str] | None = None) -> None:
    """Rows as train, valid and test below path, in about these shares. A row's side follows from the hash of its key (all
    columns, unless named) and the seed alone, so that it is the same however the rows are partitioned or added to."""
    at = F.pmod(F.xxhash64(F.lit(seed), *(key or df.columns)), F.lit(1 << 30)) / (1 << 30)
    placed, total, low = df.withColumn("_at", at), sum(shares), 0.0
    for n, (name, share) in enumerate(zip(("train", "valid", "test"), shares, strict=True)):
        high = low + share / total if n < 2 else 2.0
        placed.where((F.col("_at") >= low) & (F.col("_at") < high)).drop("_at").write.mode("errorifexists").parquet(f"{path}/{name}")
        low = high


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables; edges are laid out by type, so that lookups of a type read its files only.

    They replace what stood at path, of which they may be made, by a commit: until it stands, and whenever something fails,
    the old graph is the one that is read.
    """
    spark = nodes.sparkSession
    version, _ = last_commit(spark, path)
    at = fresh_data()
    nodes.write.parquet(f"{path}/{at}/nodes")
    edges.write.partitionBy("rel_type").parquet(f"{path}/{at}/edges")
    commit(spark, path, version + 1, {"graph": at})
    tidy(spark, path, {at})


def rebuild_graph(spark: SparkSession, parts: list[tuple[str, str | None]], path: str) -> None:
    """A graph from nothing: parts are files of triples, each with a food table or None, loaded one after the other. The
    keys are checked before the old graph is replaced."""
    rows = [(read_triples(spark, t).select("s", "r", "o"), None if f is None else saved(read_food(spark, f))) for t, f in parts]
    nodes, edges = graph.rebuild(rows)
    for df, keys in ((nodes, ("label", "name")), (edges, tuple(graph.EDGE_KEY))):
        if graph.violations(df, keys).limit(1).count():
            raise ValueError(f"{keys} are not unique")
    save_graph(nodes, edges, path)


def clear_graph(spark: SparkSession, path: str) -> None:
    """Deletes all nodes and edges."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def triples_of(edges: DataFrame) -> DataFrame:
    """(s, r, o) of saved edges."""
    return edges.select(F.col("s_name").alias("s"), F.col("relation").alias("r"), F.col("o_name").alias("o"))


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    version, says = last_commit(spark, path)
    if not version:
        raise ValueError(f"no graph at {path}")
    return spark.read.parquet(f"{path}/{says['graph']}/nodes"), spark.read.parquet(f"{path}/{says['graph']}/edges")


def answer_dict(text: str | dict) -> dict:
    """A service's answer: plain text becomes a response without nutrition."""
    return text if isinstance(text, dict) else {"bot_response": text, "nutrition": None}
