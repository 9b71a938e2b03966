"""Raw question-answering sources in one schema, and the columns that trainers read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.tables import PROMPT_REASONING, PROMPT_SHORT
from answerloom.functions.text import clean_answer, extract_answer, fill, first_line, strip
from answerloom.operators.tables import payloads

#: Rows that a provider gets at once.
CHUNK = 256
UNIFIED = ("dataset", "qid", "image", "question", "answers", "answer_type")


def from_multi_qa(rows: DataFrame, dataset: str = "vqav2", prefix: str = "cauldron") -> DataFrame:
    """(position, images, texts): a row for each text; the first image, the first line of ``user``, the cleaned answer."""
    each = rows.select("position", F.get("images", F.lit(0)).alias("image"), F.posexplode("texts").alias("j", "text"))
    return each.select(
        F.lit(dataset).alias("dataset"), F.concat_ws("-", F.lit(prefix), F.col("position").cast("string"), F.col("j").cast("string")).alias("qid"),
        "image", strip(first_line(F.col("text.user"))).alias("question"), F.array(clean_answer(F.col("text.assistant"))).alias("answers"), F.lit("").alias("answer_type"),
    )


def from_annotators(rows: DataFrame, dataset: str = "vqav2") -> DataFrame:
    """(question_id, image, question, answers of structs, answer_type): all annotators' answers."""
    return rows.select(F.lit(dataset).alias("dataset"), F.col("question_id").cast("string").alias("qid"), "image", "question", F.col("answers.answer").alias("answers"), "answer_type")


def from_instructions(instructions: DataFrame, images: DataFrame, dataset: str = "gqa", order: Column | None = None) -> DataFrame:
    """(id, imageId, question, answer, types.structural) with their images (id, image); every image must be there, and
    of one that repeats the last by ``order``, a column of ``images``, counts."""
    named = images.withColumnRenamed("id", "image_id").withColumnRenamed("image", "payload")
    rows = payloads(instructions, "imageId", named, "image_id", order)
    return rows.select(F.lit(dataset).alias("dataset"), F.col("id").cast("string").alias("qid"), F.col("payload").alias("image"), "question", F.array("answer").alias("answers"), F.col("types.structural").alias("answer_type"))


def from_counting(rows: DataFrame, tag: str, dataset: str = "clevr") -> DataFrame:
    """(position, image, problem, solution): the solution's tagged answer; the id holds the absolute position."""
    return rows.select(F.lit(dataset).alias("dataset"), F.concat_ws("-", F.lit(tag), F.col("position").cast("string")).alias("qid"), "image", F.col("problem").alias("question"), F.array(extract_answer(F.col("solution"))).alias("answers"), F.lit("number").alias("answer_type"))


def from_ocr(rows: DataFrame, dataset: str = "textvqa") -> DataFrame:
    """(question_id, image, question, answers)."""
    return rows.select(F.lit(dataset).alias("dataset"), F.col("question_id").cast("string").alias("qid"), "image", "question", "answers", F.lit("").alias("answer_type"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(question: Column, uri: Column, template: str) -> Column:
    """One user message of an image part and a text part; ``to_json`` leaves out what a part doesn't have."""
    none = F.lit(None).cast("struct<url: string>")
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), url.alias("image_url"), text.alias("text"))
    parts = F.array(part("image_url", F.lit(None).cast("string"), F.struct(uri.alias("url"))), part("text", fill(template, question=question), none))
    return F.array(F.struct(F.lit("user").alias("role"), parts.alias("content")))


def to_supervised(examples: DataFrame) -> DataFrame:
    """prompt and completion messages, with the image."""
    prompt = F.array(message("user", fill(PROMPT_SHORT, question=F.col("question"))))
    return examples.select(prompt.alias("prompt"), F.array(message("assistant", F.get("answers", F.lit(0)))).alias("completion"), "image")


def to_reinforcement(examples: DataFrame) -> DataFrame:
    """The reasoning prompt, with what the rewards need."""
    prompt = F.array(message("user", fill(PROMPT_REASONING, question=F.col("question"))))
    return examples.select(prompt.alias("prompt"), "image", "answers", "dataset", "question")


def generate(examples: DataFrame, schema: str, answer: Callable[[pd.DataFrame], pd.DataFrame], size: int = CHUNK) -> DataFrame:
    """Model output from a provider: ``answer`` maps a frame of some rows to one with ``schema``, a row for each of them.

    It gets ``size`` rows at once, whatever the Arrow batches, and fewer only at a partition's end; no more than those and
    one Arrow batch are held. A call that gives other than one row for each it got fails the job, so outputs never slip.
    """

    def answered(rows: pd.DataFrame) -> pd.DataFrame:
        out = answer(rows.reset_index(drop=True))
        if len(out) != len(rows):
            raise ValueError(f"{len(out)} answers to {len(rows)} rows")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch])
            full = len(rows) // size * size
            yield from (answered(rows.iloc[at : at + size]) for at in range(0, full, size))
            rest = rows.iloc[full:] if full < len(rows) else None
        if rest is not None:
            yield answered(rest)

    return examples.mapInPandas(run, schema)


def token_logprobs(ids: Column, by_position: Column) -> Column:
    """Each token's own entry of the map at its position. Fails where a map lacks its token, or one array is longer."""
    missing = lambda t: F.raise_error(F.concat(F.lit("no entry of token "), F.coalesce(t.cast("string"), F.lit("null"))))
    return F.zip_with(ids, by_position, lambda t, m: F.when(F.map_contains_key(m, t), F.element_at(m, t)).otherwise(missing(t)))
