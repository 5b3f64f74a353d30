"""Open extraction, definition and canonicalization with a pluggable model, refinement, enrichment, documents as chunks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.functions import text as T
from graphloom.operators import retrieval
from graphloom.operators.cleaning import numbered
from graphloom.operators.models import CALL_SIZE, ModelClient, Prompts, asked, call, embedded
from graphloom.sources.work import saved

PROMPTS = Prompts()


def extract(chunks: DataFrame, client: ModelClient, prompts: Prompts = PROMPTS, entities: str | None = None, relations: str | None = None) -> DataFrame:
    """(chunk, pos, s, r, o) of chunks (chunk, text); entities and relations name columns of hints."""
    hint = lambda c: F.lit("") if c is None else F.col(c)
    prompt = prompts.fill("extract", input_text=F.col("text"), entities_hint=hint(entities), relations_hint=hint(relations))
    answers = asked(chunks.select("chunk", prompt.alias("prompt")), client, "prompt", "answer")
    return answers.select("chunk", F.posexplode(T.answer_triples(F.col("answer"))).alias("pos", "t")).select("chunk", F.col("pos").cast("bigint").alias("pos"), *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate("sro")])


def _listed(relation: str = "r"):
    """A chunk's triples in order as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s", F.col(relation).alias("r"), "o"))), lambda x: F.concat_ws(" | ", x["s"], x["r"], x["o"])), "; ")


def define(triples: DataFrame, client: ModelClient, chunks: DataFrame | None = None, prompts: Prompts = PROMPTS) -> DataFrame:
    """(chunk, relation, definition): each chunk's distinct relations, asked once a chunk, with its text and triples."""
    asks = triples.groupBy("chunk").agg(F.array_join(F.array_sort(F.collect_set("r")), "|").alias("relations"), _listed().alias("triples"))
    asks = asks.withColumn("text", F.lit("")) if chunks is None else asks.join(chunks.select("chunk", "text"), "chunk")
    prompt = prompts.fill("define", text=F.col("text"), triples=F.col("triples"), relations=F.col("relations"))
    answers = asked(asks.select("chunk", prompt.alias("prompt")), client, "prompt", "answer")
    return answers.select("chunk", F.explode(T.definition_rows(F.col("answer"))).alias("d")).select("chunk", F.col("d.name").alias("relation"), F.col("d.definition").alias("definition"))


def _options(pairs: DataFrame, schema: DataFrame, k: int) -> DataFrame:
    """(chunk, r, options) of pairs (chunk, r, v): the k nearest schema relations (relation, definition, ord, w), in order,
    with their scores. Pairs with at see only relations whose since lies before it."""
    queries = pairs.select(F.struct("chunk", "r").alias("q"), "v", *[c for c in ("at",) if c in pairs.columns])
    best = retrieval.top_k(queries, schema.select(F.col("relation").alias("t"), "ord", "w", *[c for c in ("since",) if c in schema.columns]), k)
    best = best.join(schema.select(F.col("relation").alias("t"), F.col("definition").alias("d")), "t")
    options = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("t").alias("relation"), "score", F.col("d").alias("definition")))).alias("options"))
    return options.select("q.*", "options")


def _picked(asks: DataFrame, client: ModelClient, prompts: Prompts) -> DataFrame:
    """(chunk, r, options, picked) of asks (chunk, r, definition, triple, text, options): what the model picks, or null."""
    said = T.choices(F.transform("options", lambda x: F.concat(x["relation"], F.lit(": "), x["definition"])))
    prompt = prompts.fill("verify", input_text=F.col("text"), query_triplet=F.col("triple"), query_relation=F.col("r"), query_relation_definition=F.col("definition"), choices=said)
    answers = asked(asks.select("chunk", "r", "options", prompt.alias("prompt")), client, "prompt", "answer")
    return answers.select("chunk", "r", "options", T.chosen(F.col("answer"), F.transform("options", lambda x: x["relation"])).alias("picked"))


def _candidates() -> Column:
    return F.transform("options", lambda x: F.struct(x["relation"].alias("relation"), x["score"].alias("score")))


def _verified(pairs: DataFrame, schema: DataFrame, client: ModelClient, chunks: DataFrame | None, prompts: Prompts, k: int) -> DataFrame:
    """(chunk, r, candidates, picked) of pairs (chunk, r, definition, v, triple): the k nearest schema relations (relation,
    definition, ord, w) with their scores, and the one that the model picks, or null."""
    asks = pairs.join(_options(pairs, schema, k), ["chunk", "r"])
    asks = asks.withColumn("text", F.lit("")) if chunks is None else asks.join(chunks.select("chunk", "text"), "chunk")
    return _picked(asks, client, prompts).select("chunk", "r", _candidates().alias("candidates"), "picked")


def canonicalize(triples: DataFrame, definitions: DataFrame, schema: DataFrame, client: ModelClient, k: int = 5, chunks: DataFrame | None = None, prompts: Prompts = PROMPTS, enrich: bool = False) -> DataFrame:
    """triples (chunk, pos, s, r, o) with status, canonical and candidates: canonical is r itself if it is in the schema,
    else the option the model picks among the k nearest schema relations (relation, definition, ord), else null.
    Relations without a definition: null.

    The split by status comes before the model, so canonical relations cost no call; each distinct relation is asked once
    a chunk. With enrich a relation that nothing is picked for joins the schema, for itself and for all after it, in order
    of chunk and place (grown_schema).
    """
    split = retrieval.canonical_split(triples, schema, definitions)
    defined = definitions.groupBy("chunk", F.col("relation").alias("r")).agg(F.max("definition").alias("definition"))
    match = split.where("status = 'match'").groupBy("chunk", "r").agg(F.min("pos").alias("pos"), F.min_by(F.concat_ws(" | ", "s", "r", "o"), "pos").alias("triple"))
    pairs = saved(embedded(match.join(defined, ["chunk", "r"]), client, "definition", "v"))
    targets = saved(embedded(schema.select("relation", "definition", F.col("ord").cast("bigint").alias("ord")), client, "definition", "w"))
    if enrich:
        picked = grown_schema(pairs, targets, client, chunks, prompts, k)[0]
    else:
        picked = _verified(pairs, targets, client, chunks, prompts, k)
    out = split.join(picked, ["chunk", "r"], "left")
    return out.withColumn("canonical", F.when(F.col("status") == "canonical", F.col("r")).otherwise(F.col("picked"))).select(*triples.columns, "status", "canonical", "candidates")


#: Pairs that one task decides in order.
STRETCH = 20_000


class _Additions:
    """Relations that joined the schema in one stretch, in order, with their vectors."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.known: set[str] = set()
        self.texts: list[str | None] = []
        self.vectors, self.placed, self.most = np.zeros((0, 0)), [], 0.0

    def add(self, name: str, text: str | None, v: np.ndarray | None) -> None:
        if v is not None:
            n = len(self.placed)
            if n == len(self.vectors):
                more = np.zeros((max(256, 2 * n), len(v)))
                more[:n] = self.vectors.reshape(n, len(v))
                self.vectors = more
            self.vectors[n] = v
            self.placed.append(len(self.names))
            self.most = max(self.most, float(np.sqrt(v @ v)))
        self.names.append(name)
        self.texts.append(text)
        self.known.add(name)

    def nearer(self, v: np.ndarray, options: list[tuple], k: int, since: int) -> list[tuple]:
        """The k best of options (relation, score, definition) and the vectors added from place since on; ties keep this
        order. Products that may count are taken anew, in the order of the places, as dot() takes them."""
        some = self.vectors[since : len(self.placed)]
        if not len(some):
            return options
        near = some @ v
        if len(options) >= k:
            at = np.flatnonzero(near >= options[-1][1] - 1e-9 * (1.0 + self.most * float(np.sqrt(v @ v))))
        else:
            at = np.arange(len(some))
        if not len(at):
            return options
        score = np.add.accumulate(some[at] * v, axis=1)[:, -1]
        which = [self.placed[since + i] for i in at.tolist()]
        return sorted([*options, *((self.names[n], x, self.texts[n]) for n, x in zip(which, score.tolist(), strict=True))], key=lambda o: -o[1])[:k]


def _settled(client: ModelClient, k: int, wait: float = 0.5):
    """Batches of pairs in order, with what the model picked among the options of the schema before the stretch, to
    (at, candidates, picked, added) under the schema as it grows.

    A pair whose options no addition has changed keeps that answer. The others are asked again in calls of up to CALL_SIZE,
    before it is known whether one of them adds a relation: where one does and that changes a later one's options, the later
    ones are asked in the next call, which takes twice as many as the last one settled.
    """
    grown = _Additions()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = CALL_SIZE
        for pdf in frames:
            names, texts = pdf["r"].tolist(), [None if pd.isna(x) else x for x in pdf["definition"]]
            vectors = [None if x is None else np.asarray(x, np.float64) for x in pdf["v"]]
            options = [[(x["relation"], x["score"], x["definition"]) for x in o] for o in pdf["options"]]
            picked = [None if pd.isna(x) else x for x in pdf["picked"]]
            parts = pdf["parts"].tolist()
            added, answered, seen = [False] * len(pdf), [True] * len(pdf), [0] * len(pdf)

            def refresh(i: int) -> None:
                if vectors[i] is not None and seen[i] < len(grown.placed):
                    now = grown.nearer(vectors[i], options[i], k, seen[i])
                    if now is not options[i] and [o[0] for o in now] != [o[0] for o in options[i]]:
                        answered[i] = False
                    options[i] = now
                seen[i] = len(grown.placed)

            i = 0
            while i < len(pdf):
                if names[i] in grown.known:
                    options[i], picked[i], i = None, names[i], i + 1
                    continue
                refresh(i)
                if not answered[i]:
                    turn = [j for j in range(i, min(i + size, len(pdf))) if names[j] not in grown.known]
                    for j in turn:
                        refresh(j)
                    turn = [j for j in turn if not answered[j]]
                    said, error = call(client, ["".join(_with_choices(parts[j], options[j])) for j in turn], wait)
                    if error:
                        raise RuntimeError(f"the model failed: {error}")
                    for j, answer in zip(turn, said, strict=True):
                        picked[j], answered[j] = T.chosen_of(answer, [o[0] for o in options[j]]), True
                    begin = i
                    while i < len(pdf) and i < begin + size:
                        if names[i] in grown.known:
                            options[i], picked[i], i = None, names[i], i + 1
                            continue
                        refresh(i)
                        if not answered[i]:
                            break
                        if picked[i] is None:
                            picked[i], added[i] = names[i], True
                            grown.add(names[i], texts[i], vectors[i])
                        i += 1
                    size = max(1, min(CALL_SIZE, 2 * (i - begin)))
                    continue
                if picked[i] is None:
                    picked[i], added[i] = names[i], True
                    grown.add(names[i], texts[i], vectors[i])
                i += 1
            near = [None if o is None else [{"relation": x[0], "score": x[1]} for x in o] for o in options]
            yield pd.DataFrame({"at": pdf["at"], "candidates": near, "picked": picked, "added": added})

    return work


def _with_choices(parts: list[str], options: list[tuple]) -> Iterator[str]:
    said = T.choices_of([None if o[0] is None or o[2] is None else f"{o[0]}: {o[2]}" for o in options])
    for n, part in enumerate(parts):
        if n:
            yield said
        yield part


def grown_schema(pairs: DataFrame, schema: DataFrame, client: ModelClient, chunks: DataFrame | None = None, prompts: Prompts = PROMPTS, k: int = 5, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(picked, schema): pairs (chunk, r, pos, definition, v, triple) decided in order of chunk and place, where each one
    that the model picks nothing for adds its relation to the schema (relation, definition, ord, w) at once.

    Every addition may change all decisions after it, so the order is part of the result; it is followed in stretches of
    pairs. All tasks search a stretch's nearest options in the schema before it (by bounds, see inner_products) and ask the
    model about them; pairs of a relation that has joined need neither. Then one task goes through the stretch in order,
    batch by batch, holds the vectors that join in it, and asks again only about pairs whose options these have changed
    (_settled). So a stretch takes a fixed number of jobs, whatever joins in it, and no task holds more than one batch and
    one stretch's additions.
    """
    kind = "array<struct<relation:string,score:double>>"
    schema = saved(schema.select("relation", "definition", F.col("ord").cast("bigint").alias("ord"), "w"))
    last = schema.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    text = pairs.withColumn("text", F.lit("")) if chunks is None else pairs.join(chunks.select("chunk", "text"), "chunk", "left").withColumn("text", F.coalesce("text", F.lit("")))
    known = schema.select(F.col("relation").alias("r")).distinct()
    decided = text.join(known, "r", "left_semi").select("chunk", "r", F.lit(None).cast(kind).alias("candidates"), F.col("r").alias("picked"))
    open_ = saved(numbered(text.join(known, "r", "left_anti"), ["chunk", "pos", "r"], "at"))
    none = F.array().cast("array<struct<rank:bigint,relation:string,score:double,definition:string>>")
    values = {"input_text": F.col("text"), "query_triplet": F.col("triple"), "query_relation": F.col("r"), "query_relation_definition": F.col("definition")}
    parts = F.array(*[F.lit("") if not p else prompts.fill("verify", template=p, **values) for p in prompts.verify.split("{choices}")])
    now, more, total = schema, [], open_.count()
    for begin in range(0, total, stretch):
        some = open_.where((F.col("at") >= begin) & (F.col("at") < begin + stretch))
        joined = now.select(F.col("relation").alias("r")).distinct()
        if begin:
            decided = decided.unionByName(some.join(joined, "r", "left_semi").select("chunk", "r", F.lit(None).cast(kind).alias("candidates"), F.col("r").alias("picked")))
            some = some.join(joined, "r", "left_anti")
        options = some.select("chunk", "r").join(_options(some, now, k), ["chunk", "r"], "left").withColumn("options", F.coalesce("options", none))
        asks = _picked(saved(some.join(options, ["chunk", "r"])), client, prompts)
        asks = some.join(asks, ["chunk", "r"]).select("at", "r", "definition", "v", "options", "picked", parts.alias("parts"))
        settled = saved(asks.repartition(1).sortWithinPartitions("at").mapInPandas(_settled(client, k), f"at bigint, candidates {kind}, picked string, added boolean"))
        decided = decided.unionByName(some.select("at", "chunk", "r").join(settled, "at").select("chunk", "r", "candidates", "picked"))
        new = some.join(settled.where("added").select("at"), "at").select(F.col("r").alias("relation"), "definition", (F.lit(last + 1) + F.col("at")).alias("ord"), F.col("v").alias("w"))
        more.append(saved(new))
        now = now.unionByName(more[-1])
    for n, new in enumerate(more):
        more[n] = numbered(new, ["ord"], "no").select("relation", "definition", (F.lit(last + 1) + F.col("no")).cast("bigint").alias("ord"), "w")
        last += new.count()
        schema = schema.unionByName(more[n])
    return saved(decided), schema


def enrich(relations: DataFrame, schema: DataFrame, threshold: float) -> DataFrame:
    """(ord, relation, canonical, added) of relations (ord, relation, v) in order, with a threshold in the model's place.

    A relation of the schema (relation, w) is itself. Another one takes the nearest known relation whose cosine reaches
    the threshold (ties: the schema first, then in order of name or place); without one it joins the schema, for itself
    and for all after it. A repeated name is decided once, by its first row. Known are the schema's relations from the
    start, so this is a leader rule whose first leaders are given.
    """
    names = schema.select("relation").distinct()
    first = relations.groupBy("relation").agg(F.min("ord").alias("ord"), F.min_by("v", "ord").alias("v"))
    new = first.join(names, "relation", "left_anti")
    given = schema.groupBy("relation").agg(F.first("w").alias("v"))
    # one numbering: the schema by name, then the new ones by place
    both = retrieval.numbered(given.select(F.lit(0).alias("src"), F.lit(None).cast("bigint").alias("ord"), "relation", "v").unionByName(new.select(F.lit(1).alias("src"), F.col("ord").cast("bigint").alias("ord"), "relation", "v")), ["src", "ord", "relation"], "i")
    both = saved(both)
    pairs = saved(retrieval.similar_pairs(both.select("i", "v"), threshold))
    src = both.select("i", "src", "relation")
    # pairs within the schema say nothing
    inner = pairs.join(src.select(F.col("i").alias("j"), F.col("src").alias("js")), "j").where("js = 1").select("i", "j", "sim")
    leaders = retrieval.leaders_of(src.select("i"), inner.select("i", "j"))
    near = inner.join(leaders, "i", "left_semi").groupBy("j").agg(F.max_by("i", F.struct("sim", -F.col("i"))).alias("to"))
    found = src.where("src = 1").join(leaders.withColumn("own", F.lit(True)), "i", "left").join(near.withColumnRenamed("j", "i"), "i", "left")
    target = src.select(F.col("i").alias("to"), F.col("relation").alias("known"))
    found = found.join(target, "to", "left").select("relation", F.when(F.col("own"), F.col("relation")).otherwise(F.col("known")).alias("canonical"), F.coalesce("own", F.lit(False)).alias("added"))
    decided = found.unionByName(names.select("relation", F.col("relation").alias("canonical"), F.lit(False).alias("added")))
    began = first.select("relation", F.col("ord").alias("began"))
    return relations.select("ord", "relation").join(decided, "relation").join(began, "relation").select("ord", "relation", "canonical", (F.col("added") & (F.col("ord") == F.col("began"))).alias("added"))


def extract_entities(chunks: DataFrame, client: ModelClient, prompts: Prompts = PROMPTS) -> DataFrame:
    """(chunk, entities) of chunks (chunk, text)."""
    answers = asked(chunks.select("chunk", prompts.fill("entities", input_text=F.col("text")).alias("prompt")), client, "prompt", "answer")
    return answers.select("chunk", T.answer_entities(F.col("answer")).alias("entities"))


def merge_entities(chunks: DataFrame, first: DataFrame, second: DataFrame, client: ModelClient, prompts: Prompts = PROMPTS) -> DataFrame:
    """(chunk, entities): the model's merger of two lists (chunk, entities) of a chunk."""
    none = F.array().cast("array<string>")
    both = chunks.select("chunk", "text").join(first.select("chunk", F.col("entities").alias("a")), "chunk", "left").join(second.select("chunk", F.col("entities").alias("b")), "chunk", "left")
    prompt = prompts.fill("merge", input_text=F.col("text"), entity_list_1=F.array_join(F.coalesce("a", none), "|"), entity_list_2=F.array_join(F.coalesce("b", none), "|"))
    answers = asked(both.select("chunk", prompt.alias("prompt")), client, "prompt", "answer")
    return answers.select("chunk", T.answer_entities(F.col("answer")).alias("entities"))


def previous(triples: DataFrame, relation: str = "r") -> DataFrame:
    """(chunk, entities, relations): the distinct entities and relations of a chunk's triples, each sorted."""
    e = triples.select("chunk", F.explode(F.array("s", "o")).alias("e")).groupBy("chunk").agg(F.array_sort(F.collect_set("e")).alias("entities"))
    return e.join(triples.groupBy("chunk").agg(F.array_sort(F.collect_set(relation)).alias("relations")), "chunk")


def refinement_hints(chunks: DataFrame, triples: DataFrame, schema: DataFrame, client: ModelClient, prompts: Prompts = PROMPTS, k: int = 10) -> DataFrame:
    """chunks (chunk, text) with entity_hint and relation_hint, made from the surviving triples of the last round.

    Entities: those of the triples merged with those that the model finds in the text. Relations: those of the triples,
    then the k of the schema that are nearest to the text, as numbered lines with definitions and examples.
    """
    before = saved(previous(triples))
    merged = merge_entities(chunks, before.select("chunk", "entities"), extract_entities(chunks, client, prompts), client, prompts)
    targets = embedded(schema.select("relation", "definition", "ord"), client, "definition", "w").select(F.col("relation").alias("t"), "ord", "w")
    queries = embedded(chunks.select(F.col("chunk").alias("q"), "text"), client, "text", "v")
    near = retrieval.top_k(queries.select("q", "v"), targets, k).select(F.col("q").alias("chunk"), F.col("t").alias("rel"), F.col("rank").alias("pos"))
    prior = before.select("chunk", F.posexplode("relations").alias("pos", "rel")).select("chunk", "rel", F.col("pos").cast("bigint").alias("pos"))
    lines = retrieval.relation_hints(prior, near, schema, triples, chunks)
    out = chunks.join(merged.select("chunk", F.array_join("entities", "|").alias("entity_hint")), "chunk", "left").join(lines.withColumnRenamed("hint", "relation_hint"), "chunk", "left")
    return out.fillna("", ["entity_hint", "relation_hint"])


def run_stages(chunks: DataFrame, schema: DataFrame, client: ModelClient, rounds: int = 0, prompts: Prompts = PROMPTS, enriched: bool = False, write=None) -> tuple[DataFrame, DataFrame]:
    """(triples, records) of the last of rounds + 1 rounds: extraction, definition, canonicalization.

    Every round but the first gets hints from the triples that survived the one before, with canonical relations, and
    every round's tables are written before the next one reads them. write(round, records, triples): a sink for each.
    """
    chunks = chunks.select("chunk", "text")
    last = records = None
    for n in range(rounds + 1):
        hinted = chunks.withColumns({c: F.lit("") for c in ("entity_hint", "relation_hint")}) if last is None else refinement_hints(chunks, last, schema, client, prompts)
        hinted = saved(hinted)
        triples = saved(extract(hinted, client, prompts, "entity_hint", "relation_hint"))
        definitions = saved(define(triples, client, chunks, prompts))
        canonical = saved(canonicalize(triples, definitions, schema, client, 5, chunks, prompts, enriched))
        last = canonical.where("canonical IS NOT NULL").select("chunk", "pos", "s", F.col("canonical").alias("r"), "o")
        records = stage_records(hinted, triples, definitions, canonical)
        if write is not None:
            write(n, records, last)
    return last, records


def stage_records(chunks: DataFrame, triples: DataFrame, definitions: DataFrame, canonical: DataFrame) -> DataFrame:
    """(chunk, input_text, entity_hint, relation_hint, oie, schema_definition, canonicalization_candidates,
    schema_canonicalization) of chunks (chunk, text, entity_hint, relation_hint): a round's results, nested.

    Lists keep the triples' order; in the last one a rejected triple has a null relation.
    """
    row = lambda r: F.transform(F.array_sort(F.collect_list(F.struct("pos", "s", F.col(r).alias("r"), "o"))), lambda x: F.struct(x["s"].alias("s"), x["r"].alias("r"), x["o"].alias("o")))
    oie = triples.groupBy("chunk").agg(row("r").alias("oie"))
    said = definitions.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("relation", "definition"))).alias("schema_definition"))
    near = F.transform(F.array_sort(F.collect_list(F.struct("pos", "candidates"))), lambda x: x["candidates"])
    canon = canonical.groupBy("chunk").agg(near.alias("canonicalization_candidates"), row("canonical").alias("schema_canonicalization"))
    out = chunks.withColumnRenamed("text", "input_text")
    for side in (oie, said, canon):
        out = out.join(side, "chunk", "left")
    return out


#: Documents whose chunks are resolved side by side in one task.
SIDE_BY_SIDE = 500


def resolve_coreference(chunks: DataFrame, client: ModelClient, window: int = 1, prompts: Prompts = PROMPTS, errors: bool = False, wait: float = 0.5) -> DataFrame:
    """(doc, chunk, text) with each chunk resolved in the light of the window resolved ones before it; with errors also
    error, what the model's failure says. A chunk whose call fails stays as it was.

    Each chunk waits for the one before, so documents go side by side: a wave asks the k-th chunk of SIDE_BY_SIDE documents
    in calls of CALL_SIZE prompts, then the next one. A task holds that many documents, however many it is given.
    """
    head, middle, tail = _around(prompts.resolve, "{context}", "{current}")
    strip = lambda t: t.strip(" \t\n\x0B\f\r")
    fields = StructType([*chunks.schema.fields, *([StructField("error", StringType())] if errors else [])])

    def resolved(pdf: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
        texts = [None if pd.isna(t) else t for t in pdf["text"]]
        said: list[str | None] = list(texts)
        failed: list[str | None] = [None] * len(texts)
        docs = list(zip(starts, [*starts[1:], len(texts)], strict=True))
        for k in range(max(b - a for a, b in docs)):
            turn = [a + k for a, b in docs if a + k < b]
            begin = {a + k: max(a, a + k - window) for a, b in docs}
            for n in range(0, len(turn), CALL_SIZE):
                some = turn[n : n + CALL_SIZE]
                asks = [head + " ".join(t or "" for t in said[begin[i] : i]) + middle + (texts[i] or "") + tail for i in some]
                answers, error = call(client, asks, wait)
                for i, answer in zip(some, answers, strict=True):
                    failed[i] = error
                    if answer is not None:
                        answer = strip(answer)
                        for x in T.ANSWER_PREFIXES:
                            answer = strip(answer.removeprefix(x))
                        said[i] = answer
        return pdf.assign(text=said, **({"error": failed} if errors else {}))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in chain(frames, [None]):
            now = rest if pdf is None else pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if now is None or not len(now):
                continue
            doc, before = now["doc"], now["doc"].shift()
            new = (doc != before) & ~(doc.isna() & before.isna())
            new.iloc[0] = True
            starts = [i for i, x in enumerate(new) if x]
            whole, end = starts, len(now)
            if pdf is not None:
                # full rounds only, and the last document may go on in the next batch
                full = (len(starts) - 1) // SIDE_BY_SIDE * SIDE_BY_SIDE
                whole, end = starts[:full], starts[full]
            for n in range(0, len(whole), SIDE_BY_SIDE):
                some = whole[n : n + SIDE_BY_SIDE]
                upto = whole[n + SIDE_BY_SIDE] if n + SIDE_BY_SIDE < len(whole) else end
                yield resolved(now.iloc[some[0] : upto].reset_index(drop=True), [i - some[0] for i in some])
            rest = now.iloc[end:].reset_index(drop=True)

    return chunks.repartition("doc").sortWithinPartitions("doc", "chunk").mapInPandas(work, fields)


def _around(template: str, first: str, second: str) -> tuple[str, str, str]:
    head, rest = template.split(first)
    middle, tail = rest.split(second)
    return head, middle, tail


def prepare(documents: DataFrame, client: ModelClient | None = None, size: int = 3, window: int = 1, prompts: Prompts = PROMPTS) -> DataFrame:
    """(doc, chunk, text) of documents (doc, text): lines cleaned, cut into sentences, joined in chunks of size, and
    resolved by the client where there is one."""
    parts = documents.select("doc", F.posexplode(T.chunked(T.sentences(T.clean_lines(F.col("text"))), size)).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("bigint"))
    return parts if client is None else resolve_coreference(parts, client, window, prompts)


def standardise(documents: DataFrame, client: ModelClient, prompts: Prompts = PROMPTS) -> DataFrame:
    """(doc, text) of documents (doc, text) as prose; those that the model answers nothing for, or fails on, are left out."""
    answers = asked(documents.select("doc", prompts.fill("standardise", raw_text=F.col("text")).alias("prompt")), client, "prompt", "answer", strict=False)
    return answers.select("doc", T.strip(F.col("answer")).alias("text")).where("text <> ''")


def crawl_definitions(entries: DataFrame, client: ModelClient, most: int = 5, prompts: Prompts = PROMPTS) -> DataFrame:
    """(entry, text, triples, relations, definitions) of entries (entry, text, triples: arrays of three strings), in order,
    whose relations are all new, until most relations are collected; definitions is the model's answer as it is.

    Each accepted entry brings a relation, so at most most passes look for the next one.
    """
    names = F.transform("triples", lambda t: F.get(t, F.lit(1)))
    good = entries.where((F.size("triples") > 0) & F.forall("triples", lambda t: F.size(t) == 3)).withColumn("names", names)
    taken, seen, after = [], [], None
    while len(seen) < most:
        rest = good if after is None else good.where(F.col("entry") > F.lit(after))
        rest = rest.where(~F.arrays_overlap("names", F.array(*[F.lit(s) for s in seen]).cast("array<string>"))) if seen else rest
        found = rest.orderBy("entry").limit(1).collect()
        if not found:
            break
        after = found[0]["entry"]
        taken.append(after)
        seen += [n for n in dict.fromkeys(found[0]["names"]) if n not in seen]
    chosen = good.where(F.col("entry").isin(taken)) if taken else good.limit(0)
    chosen = chosen.withColumn("relations", F.array_distinct("names"))
    said = F.array_join(F.transform("triples", lambda t: F.array_join(t, " | ")), "; ")
    prompt = prompts.fill("define", text=F.col("text"), triples=said, relations=F.array_join("relations", "|"))
    return asked(chosen.select("entry", "text", "triples", "relations", prompt.alias("prompt")), client, "prompt", "definitions").drop("prompt", "definitions_error")


def latest_context(chunks: DataFrame, window: int = 2) -> DataFrame:
    """chunks (doc, chunk, text) with context: the window chunks before, joined by blanks."""
    w = Window.partitionBy("doc").orderBy("chunk").rowsBetween(-window, -1)
    return chunks.withColumn("context", F.array_join(F.collect_list("text").over(w), " "))
