"""Advice: requests about a food and a disease, answered from the graph by joins, in batches or one question at a time."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph
from graphloom.operators.cleaning import mapped, numbered
from graphloom.operators.models import ModelClient, Prompts, asked
from graphloom.sources.work import saved

#: Letters of a gram by which substrings are looked up; shorter keys are grams themselves.
GRAM = 3
#: Names of one gram that one task compares with the gram's keys; more are dealt out.
GRAM_NAMES = 50_000
#: Bytes of names that one prompt lists.
PAGE_BYTES = 32_000


@dataclass(frozen=True)
class Settings:
    """What a session may set as spark.graphloom.<field>, lists separated by '|', and what holds otherwise."""

    avoid: str = "|".join(graph.AVOID)
    needed: str = "calories"
    metrics: str = "|".join(graph.METRICS)
    graph_path: str = ""
    model: str = "stub"

    @staticmethod
    def of(spark: SparkSession) -> Settings:
        return Settings(**{f.name: spark.conf.get(f"spark.graphloom.{f.name}", f.default) for f in fields(Settings)})

    def listed(self, name: str) -> list[str]:
        return [x for x in getattr(self, name).split("|") if x]


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of size letters in text."""
    places = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def holding(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """wanted (key) by names (name, ...): every pair where name, in lower case, holds key; an empty key is in every name.

    A name is listed under each of its grams. A key is looked up in one list only, that of the gram of its own that the
    fewest names have (a key of less than GRAM letters is its only gram, the empty one's list has all names), and compared
    whole with the names there. Names of a frequent gram are dealt out over several lists, each of which its keys visit; a
    key with a gram that no name has is dropped. Null keys and names give no pair.
    """
    keys = wanted.select("key").where("key IS NOT NULL").distinct()
    size = F.least(F.length("key"), F.lit(GRAM))
    own = F.when(size == 0, F.array(F.lit("")))
    for n in range(1, GRAM + 1):
        own = own.when(size == n, _grams(F.col("key"), n))
    asked = keys.select("key", F.explode(own).alias("gram"))
    lows = saved(names.select(F.lower("name").alias("low")).where("low IS NOT NULL").distinct())
    listed = lows.select("low", F.explode(F.concat(F.array(F.lit("")), *[_grams(F.col("low"), n) for n in range(1, GRAM + 1)])).alias("gram"))
    counts = listed.groupBy("gram").agg(F.count("*").alias("names"))
    # a gram that no name has sorts first, and its key meets no list
    routed = asked.join(counts, "gram", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("least")).select("key", "least.*").where("names > 0")
    lists = saved(routed.withColumn("lists", F.ceil(F.col("names") / GRAM_NAMES).cast("int")))
    held = listed.join(lists.select("gram", "lists").distinct(), "gram").withColumn("list", F.pmod(F.hash("low"), F.col("lists")))
    visits = lists.select("key", "gram", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("list"))
    found = held.join(visits, ["gram", "list"]).where(F.contains("low", F.col("key"))).select("low", "key")
    return names.join(found, F.lower("name") == F.col("low")).drop("low")


def avoid_lists(wanted: DataFrame, triples: DataFrame, avoid: list[str]) -> DataFrame:
    """(key, avoid): for each key (in lower case) the sorted, distinct other ends of avoid edges with an end that holds it."""
    bad = triples.where(F.lower("r").isin([a.lower() for a in avoid]))
    ends = bad.select(F.col("o").alias("name"), F.col("s").alias("item")).union(bad.select("s", "o")).distinct()
    return holding(wanted, ends).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("avoid"))


def found_foods(wanted: DataFrame, nodes: DataFrame, needed: str) -> DataFrame:
    """(key, found): for each key (in lower case) the shortest node name, then by name, that holds it and has the property."""
    names = nodes.where(F.col(needed).isNotNull() & F.col("name").isNotNull()).select("name").distinct()
    return holding(wanted, names).groupBy("key").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("found"))


def _chosen(lists: DataFrame, names: DataFrame, client: ModelClient, prompts: Prompts) -> DataFrame:
    """(id, page, ord, name): what the model names, in its order, of the page's nodes (id, page, food, nodes)."""
    prompt = prompts.fill("match", nodes=F.col("nodes"), question=F.col("food"))
    answers = asked(lists.select("id", "page", prompt.alias("prompt")), client, "prompt", "answer", strict=False)
    rows = answers.select("id", "page", F.posexplode(T.first_json_array(F.col("answer"))).alias("ord", "name"))
    return saved(rows.join(names, "name", "left_semi").select("id", "page", "ord", "name"))


def _listed(placed: DataFrame, *by: str) -> DataFrame:
    return placed.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("nodes"))


def map_to_nodes(requests: DataFrame, names: DataFrame, client: ModelClient, prompts: Prompts = Prompts(), page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(id, name, ord) of requests (id, food): the nodes that the model names, in its order, of those (name) there are.

    The names are cut into pages, in order, whose names fill page_bytes at most (a longer name has a page of its own). Each
    request is asked about each page; where several pages have winners, these meet again, in as few pages as hold them,
    until one page is left or a round leaves as many pages as before, whose winners then follow one another. Names of one
    page are asked about once. A failed call matches nothing.
    """
    every = saved(names.select("name").where("name IS NOT NULL").distinct())
    count, longest = every.agg(F.count("*"), F.max(F.octet_length("name"))).first()
    size = max(1, page_bytes // ((longest or 0) + 1))
    pages = _listed(numbered(every, ["name"], "at").select("name", F.floor(F.col("at") / size).alias("page")), "page")
    last = max(0, -(-count // size) - 1)
    lists = requests.select("id", "food", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))).alias("page")).join(pages, "page")
    won = _chosen(lists, every, client, prompts)
    order = Window.partitionBy("id").orderBy("page", "ord")
    while True:
        several = won.groupBy("id").agg(F.count_distinct("page").alias("pages")).where("pages > 1")
        before = several.agg(F.sum("pages")).first()[0]
        if before is None:
            break
        again = won.join(several, "id", "left_semi").withColumn("page", F.floor((F.row_number().over(order) - 1) / size))
        met = saved(_listed(again, "id", "page"))
        if met.count() >= before:
            break
        fresh = _chosen(met.join(requests.select("id", "food"), "id"), every, client, prompts)
        won = saved(won.join(several, "id", "left_anti").unionByName(fresh))
    return won.select("id", "name", (F.row_number().over(order) - 1).alias("ord"))


def zeroed(df: DataFrame, metrics: list[str] = graph.METRICS) -> DataFrame:
    """df with every metric there, null or missing ones as 0."""
    return df.withColumns({m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) if m in df.columns else F.lit(0.0) for m in metrics})


def _lines(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n")


def context_text() -> Column:
    """What the graph knows, as text, of columns food, disease, avoid, status, found, connections and relations."""
    none = F.array().cast("array<string>")
    avoided = F.when(F.size(F.coalesce("avoid", none)) > 0, F.concat(F.lit("To be avoided with "), "disease", F.lit(":\n"), _lines(F.col("avoid")))).otherwise(F.concat(F.lit("(nothing known to be avoided with "), "disease", F.lit(")")))
    direct = F.concat(F.lit("Node: "), "found", F.lit("\nConnections:\n"), _lines(F.coalesce("connections", none)))
    via = F.concat(F.lit("'"), "food", F.lit("' stands for node: '"), "found", F.lit("'\nRelations:\n"), _lines(F.coalesce("relations", none)))
    return F.concat_ws("\n", F.concat(F.lit("Question: "), "food"), F.concat(F.lit("Disease: "), "disease"), avoided, F.when(F.col("status") == "OK_FOOD", direct).when(F.col("status") == "OK_MAPPED", via))


def advise(requests: DataFrame, nodes: DataFrame, triples: DataFrame, avoid: list[str] = graph.AVOID, aliases: dict[str, str] = graph.DISEASE_ALIASES, needed: str = "calories", matches: DataFrame | None = None, metrics: list[str] = graph.METRICS, direct: DataFrame | None = None) -> DataFrame:
    """One row a request (id, food, disease): status, found, avoid, connections, relations, nutrition, context.

    avoid: other ends of avoid edges at nodes that hold the disease's name, or its alias's. found: the shortest node name
    that holds the food's and has the needed property (OK_FOOD, connections: its outgoing ends), else the first of matches
    (id, name, ord) that has relations (OK_MAPPED, relations: its edges, both ways). Without either the status is BLOCKED
    where something is to be avoided, and no context is made, else NOT_FOUND. nutrition: the metrics of the found node, 0
    where unknown; null for a mapped node without the property and for NOT_FOUND, all 0 for BLOCKED. direct: what
    found_foods() gave, where it is known.
    """
    req = requests.withColumn("target", F.lower(mapped(F.lower(T.strip(F.col("disease"))), aliases, F.col("disease")))).withColumn("food_key", F.lower("food"))
    lists = avoid_lists(req.select(F.col("target").alias("key")), triples, avoid).withColumnRenamed("key", "target")
    if direct is None:
        direct = found_foods(req.select(F.col("food_key").alias("key")), nodes, needed)
    out = req.join(lists, "target", "left").join(direct.select(F.col("key").alias("food_key"), F.col("found").alias("direct")), "food_key", "left")
    if matches is None:
        out = out.withColumn("mapped", F.lit(None).cast("string"))
    else:
        linked = triples.select(F.explode(F.array("s", "o")).alias("name")).distinct()
        first = matches.join(linked, "name", "left_semi").groupBy("id").agg(F.min_by("name", "ord").alias("mapped"))
        out = out.join(first, "id", "left")
    # the nodes found are looked up three times
    out = saved(out.withColumn("found", F.coalesce("direct", "mapped")))
    some = out.select("found").where("found IS NOT NULL").distinct()
    ends = triples.select(F.col("s").alias("found"), "o").join(some, "found", "left_semi").groupBy("found").agg(F.array_sort(F.collect_set("o")).alias("connections"))
    said = F.concat("s", F.lit(" --["), "r", F.lit("]--> "), "o")
    both = triples.select(F.explode(F.array_distinct(F.array("s", "o"))).alias("found"), said.alias("said")).join(some, "found", "left_semi").groupBy("found").agg(F.array_sort(F.collect_set("said")).alias("relations"))
    have = [m for m in metrics if m in nodes.columns]
    props = zeroed(nodes.where(F.col(needed).isNotNull()).groupBy("name").agg(*[F.max(m).alias(m) for m in have]), metrics)
    props = props.select(F.col("name").alias("found"), F.struct(*metrics).alias("nutrition")).join(some, "found", "left_semi")
    for side in (ends, both, props):
        out = out.join(side, "found", "left")
    none = F.array().cast("array<string>")
    status = F.when(F.col("direct").isNotNull(), "OK_FOOD").when(F.col("mapped").isNotNull(), "OK_MAPPED").when(F.size(F.coalesce("avoid", none)) > 0, "BLOCKED").otherwise("NOT_FOUND")
    out = out.withColumn("status", status).withColumns({c: F.coalesce(c, none) for c in ("avoid", "connections", "relations")})
    out = out.withColumn("nutrition", F.when(F.col("status") == "BLOCKED", F.struct(*[F.lit(0.0).alias(m) for m in metrics])).otherwise(F.col("nutrition")))
    return out.select("id", "food", "disease", "status", "found", "avoid", "connections", "relations", "nutrition", F.when(F.col("status").startswith("OK"), context_text()).alias("context"))


def answered(advice: DataFrame, client: ModelClient, prompts: Prompts = Prompts()) -> DataFrame:
    """advice with response: the model's answer from the context; the context itself where the model fails; a fixed text
    where there is no context."""
    prompt = prompts.fill("answer", disease=F.col("disease"), context=F.col("context"), question=F.col("food"))
    asks = asked(advice.where("context IS NOT NULL").select("id", prompt.alias("prompt")), client, "prompt", "answer", strict=False)
    out = advice.join(asks.select("id", "answer", "answer_error"), "id", "left")
    failed = F.concat(F.col("context"), F.lit("\n\nThe model failed: "), F.col("answer_error"))
    blocked = F.concat(F.lit("Nothing is known about "), F.col("food"), F.lit("; no advice is given."))
    missing = F.concat(F.lit("Nothing is known about "), F.col("food"), F.lit(" or "), F.col("disease"), F.lit("."))
    text = F.when(F.col("status") == "BLOCKED", blocked).when(F.col("status") == "NOT_FOUND", missing).otherwise(F.coalesce("answer", failed))
    return out.withColumn("response", text).drop("answer", "answer_error")


def identified(images: DataFrame, client: ModelClient, prompts: Prompts = Prompts()) -> DataFrame:
    """images (id, image: base64) with food, the dish that the model sees; null where it sees none or fails."""
    asks = asked(images.withColumn("prompt", prompts.fill("identify", image=F.col("image"))), client, "prompt", "answer", strict=False)
    return asks.withColumn("food", F.nullif(T.strip(F.col("answer")), F.lit(""))).drop("prompt", "answer", "answer_error")


def flow(requests: DataFrame, nodes: DataFrame, triples: DataFrame, client: ModelClient, avoid: list[str] = graph.AVOID, aliases: dict[str, str] = graph.DISEASE_ALIASES, needed: str = "calories", metrics: list[str] = graph.METRICS, prompts: Prompts = Prompts()) -> DataFrame:
    """advise() and answered() over requests (id, food, disease); the model maps only foods that the graph does not hold."""
    direct = saved(found_foods(requests.select(F.lower("food").alias("key")), nodes, needed))
    open_ = requests.join(direct, F.lower("food") == F.col("key"), "left_anti")
    matches = map_to_nodes(open_, nodes.where("name IS NOT NULL").select("name"), client, prompts)
    return answered(advise(requests, nodes, triples, avoid, aliases, needed, matches, metrics, direct), client, prompts)


def ask(spark: SparkSession, question: str, disease: str, nodes: DataFrame, triples: DataFrame, client: ModelClient, **options) -> dict:
    """One question's answer as a service gives it: {"bot_response", "nutrition"}; nutrition is None where nothing is found."""
    request = spark.createDataFrame([(0, question, disease)], "id bigint, food string, disease string")
    r = flow(request, nodes, triples, client, **options).first()
    nutrition = None if r["nutrition"] is None else {"name": r["found"] or question, **r["nutrition"].asDict()}
    return {"bot_response": r["response"], "nutrition": nutrition}


def ask_image(spark: SparkSession, image: str, disease: str, nodes: DataFrame, triples: DataFrame, client: ModelClient, **options) -> dict:
    """As ask(), of a dish on an image in base64."""
    seen = identified(spark.createDataFrame([(0, image)], "id bigint, image string"), client, options.get("prompts", Prompts())).first()["food"]
    if seen is None:
        return {"bot_response": "No dish can be seen on the image.", "nutrition": None}
    return ask(spark, seen, disease, nodes, triples, client, **options)
