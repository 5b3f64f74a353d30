"""Model clients and how they are called: prompts, batches, retries. No remote service is part of this engine."""

from __future__ import annotations

import base64
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from graphloom.functions.text import fill

#: Prompts, or texts to embed, of one call; calls of a batch before it counts as failed.
CALL_SIZE, TRIES = 50, 3


class ModelClient(Protocol):
    """What a worker calls; it is shipped to workers and opens its connections there."""

    def complete(self, prompts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Dispatch:
    """Sends prompts and texts to the client of the first rule (part of a model's name, client) that the model's name holds."""

    def __init__(self, model: str, rules: list[tuple[str, ModelClient]]):
        self.client = next((c for part, c in rules if part in model), None)
        if self.client is None:
            raise ValueError(f"no client for the model {model!r}")

    def complete(self, prompts: list[str]) -> list[str]:
        return self.client.complete(prompts)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.client.embed(texts)


@dataclass(frozen=True)
class Prompts:
    """A template a task, with its fields in braces, and the few-shot text that goes into {few_shot_examples}.

    The first line of a prompt names its task.
    """

    extract: str = "extract\n## examples\n{few_shot_examples}\n## entities\n{entities_hint}\n## relations\n{relations_hint}\n## text\n{input_text}"
    define: str = "define\n## examples\n{few_shot_examples}\n## text\n{text}\n## triples\n{triples}\n## relations\n{relations}"
    verify: str = "verify\n## text\n{input_text}\n## triple\n{query_triplet}\n## relation\n{query_relation}\n## definition\n{query_relation_definition}\n## choices\n{choices}"
    entities: str = "entities\n## examples\n{few_shot_examples}\n## text\n{input_text}"
    merge: str = "merge\n## text\n{input_text}\n## first\n{entity_list_1}\n## second\n{entity_list_2}"
    resolve: str = "resolve\n## context\n{context}\n## text\n{current}"
    standardise: str = "standardise\n## text\n{raw_text}"
    identify: str = "identify\n## image\n{image}"
    match: str = "match\n## nodes\n{nodes}\n## question\n{question}"
    answer: str = "answer\n## disease\n{disease}\n## context\n{context}\n## question\n{question}"
    few_shot: dict[str, str] = field(default_factory=dict)

    def fill(self, task: str, template: str | None = None, **values: Column) -> Column:
        """The task's template, or a part of it, filled in."""
        return fill(getattr(self, task) if template is None else template, few_shot_examples=F.lit(self.few_shot.get(task, "")), **values)

    def text(self, task: str, **values: str) -> str:
        """As fill(), of plain strings."""
        named = {"few_shot_examples": self.few_shot.get(task, ""), **values}
        return re.sub(r"\{(\w+)\}", lambda m: named.get(m[1], m[0]), getattr(self, task))

    def loaded(self, spark: SparkSession, templates: dict[str, str] | None = None, few_shot: dict[str, str] | None = None) -> Prompts:
        """These prompts with templates and few-shot texts read from the given paths, by task."""
        read = lambda path: spark.read.text(path, wholetext=True).first()[0]
        return replace(self, **{t: read(p) for t, p in (templates or {}).items()}, few_shot=self.few_shot | {t: read(p) for t, p in (few_shot or {}).items()})


def sections(prompt: str) -> tuple[str, dict[str, str]]:
    """(task, text of each '## name' section) of a prompt."""
    task, _, body = prompt.partition("\n")
    parts = re.split(r"(?:\A|\n)## ([a-z]+)\n", body)
    return task, dict(zip(parts[1::2], parts[2::2], strict=True))


class StubClient:
    """Answers by fixed rules over whole texts, so that every query can be rerun and SQL can say what comes out.

    Triples of neighbouring words (of the text, then of the entity hint), definitions by name, the first option with the
    relation's first letter, capitalised words as entities, "it" as the last capitalised word of the context, vectors of
    letter counts.
    """

    def complete(self, prompts: list[str]) -> list[str]:
        return [getattr(self, "_" + task)(parts) for task, parts in map(sections, prompts)]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(chr(c))) for c in range(97, 123)] for t in texts]

    @staticmethod
    def _extract(p: dict) -> str:
        words = re.findall(r"[^\W\d_]+", p["text"]) + re.findall(r"[^\W\d_]+", p["entities"])
        return str([words[i : i + 3] for i in range(0, len(words) - 2, 3)])

    @staticmethod
    def _define(p: dict) -> str:
        return "\n".join(f"{w}: what {w} means" for w in p["relations"].split("|") if w)

    @staticmethod
    def _verify(p: dict) -> str:
        return next((x[0] for x in p["choices"].split("\n") if x[1:3] == ". " and x[3:4] == p["relation"][:1]), "Z")

    @staticmethod
    def _entities(p: dict) -> str:
        return str(list(dict.fromkeys(re.findall(r"[A-Z][a-z]+", p["text"]))))

    @staticmethod
    def _merge(p: dict) -> str:
        return str(list(dict.fromkeys(x for k in ("first", "second") for x in p[k].split("|") if x)))

    @staticmethod
    def _resolve(p: dict) -> str:
        names = re.findall(r"[A-Z][a-z]+", p["context"])
        return p["text"].replace(" it ", f" {names[-1]} ") if names else p["text"]

    @staticmethod
    def _standardise(p: dict) -> str:
        return re.sub(r"[ \t\n\x0B\f\r|]+", " ", p["text"]).strip(" ")

    @staticmethod
    def _identify(p: dict) -> str:
        try:
            return base64.b64decode(p["image"], validate=True).decode()
        except ValueError:
            return ""

    @staticmethod
    def _match(p: dict) -> str:
        wanted = set(p["question"].lower().split())
        return "[" + ", ".join(f'"{n}"' for n in p["nodes"].split("|") if n.lower() in wanted) + "]"

    @staticmethod
    def _answer(p: dict) -> str:
        return f"{p['question']} / {p['disease']}: {p['context']}"


def call(client: ModelClient, prompts: list[str], wait: float) -> tuple[list[str | None], str | None]:
    """(answers, error): the call is made up to TRIES times; the error is the last one's."""
    said = None
    for n in range(TRIES):
        try:
            got = list(client.complete(prompts))
            if len(got) != len(prompts):
                raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
            return got, None
        except Exception as e:  # whatever a service's client raises
            said = f"{type(e).__name__}: {e}"
            if n < TRIES - 1:
                time.sleep(wait * (n + 1))
    return [None] * len(prompts), said


def asked(df: DataFrame, client: ModelClient, prompt: str, answer: str, strict: bool = True, wait: float = 0.5) -> DataFrame:
    """df with the model's answer to each row's prompt, and {answer}_error.

    Calls have CALL_SIZE prompts. Where a call fails TRIES times, strict fails the task, so that a service that is down
    never looks like texts without content; otherwise the answers are null and the error says why.
    """
    fields = StructType([*df.schema.fields, StructField(answer, StringType()), StructField(f"{answer}_error", StringType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), CALL_SIZE):
                some = pdf.iloc[at : at + CALL_SIZE].copy()
                some[answer], error = call(client, some[prompt].tolist(), wait)
                if error and strict:
                    raise RuntimeError(f"the model failed {TRIES} times: {error}")
                some[f"{answer}_error"] = error
                yield some

    return df.mapInPandas(work, fields)


def embedded(df: DataFrame, client: ModelClient, column: str, out: str) -> DataFrame:
    """df with out, the vector of each row's text, CALL_SIZE texts a call; a null text has none."""

    def work(frames):
        for pdf in frames:
            for at in range(0, len(pdf), CALL_SIZE):
                some = pdf.iloc[at : at + CALL_SIZE].copy()
                known = [t for t in some[column] if t is not None]
                vectors = iter(client.embed(known) if known else [])
                some[out] = [None if t is None else next(vectors) for t in some[column]]
                yield some

    fields = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))])
    return df.mapInPandas(work, fields)
