"""Question structure, query fan-out, evidence and prompts around a pluggable chat provider."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation_label, is_image_data_url

STRUCTURE = "struct<type:string,question_text:string,statements:array<struct<id:string,text:string>>>"
HISTORY_TURNS, HISTORY_CHARS = 8, 6000


class AnswerError(RuntimeError):
    """A question, picture or model reply that cannot be used."""


class ChatProvider(Protocol):
    """Shipped to executors; ``complete`` is called once for each row."""

    def complete(self, model: str, messages: list[dict], response_format: dict | None = None, temperature: float = 0.0) -> str: ...


def message(text: str, picture: str | None) -> str | list[dict]:
    """What a user message holds: the text, or the text and a picture's data URL."""
    if not isinstance(picture, str):
        return text
    return [{"type": "text", "text": text}, {"type": "image_url", "image_url": {"url": picture, "detail": "high"}}]


def complete_column(
    rows: DataFrame, provider: ChatProvider, model: str, system: str, prompt: str, output: str, picture: str | None = None, **options
) -> DataFrame:
    """``rows`` with the provider's reply to each prompt (null prompts get none); ``picture`` names a column of data URLs."""
    kept = rows.columns

    def run(batches):
        for pdf in batches:
            out = pdf.copy()
            out[output] = [
                provider.complete(model, [{"role": "system", "content": system}, {"role": "user", "content": message(p, x)}], **options) if isinstance(p, str) else None
                for p, x in zip(pdf[prompt], pdf[picture] if picture else [None] * len(pdf))
            ]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{output}` string"
    return rows.select(*kept).mapInPandas(run, schema)


def unfence(c: Column) -> Column:
    """A model's reply without a surrounding Markdown code fence."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*$", "")
    return F.when(F.startswith(t, F.lit("```")), F.regexp_replace(body, r"^\s+|\s+$", "")).otherwise(t)


def parse_structure(reply: Column, fallback: Column) -> tuple[Column, Column]:
    """(structure, error): the validated structure of a reply, or null and why it is refused."""
    text = unfence(reply)
    raw = F.from_json(text, STRUCTURE)
    root = F.try_parse_json(text)
    shape = F.schema_of_variant(root)
    items = F.coalesce(raw["statements"], F.array().cast("array<struct<id:string,text:string>>"))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    named = F.transform(
        items,
        lambda x, i: F.struct(
            F.when(blank(x["id"]), F.concat(F.lit("S"), (i + 1).cast("string"))).otherwise(F.trim(x["id"])).alias("id"), F.trim(x["text"]).alias("text")
        ),
    )
    error = (
        F.when(root.isNull(), "invalid JSON")
        .when(~F.startswith(shape, F.lit("OBJECT")), "not an object")
        .when(~F.coalesce(raw["type"].isin("single", "multiple_statements"), F.lit(False)), "unknown type")
        .when(F.exists(items, lambda x: x.isNull() | blank(x["text"])), "empty statement")
        .when((raw["type"] == "multiple_statements") & (F.size(items) < 2), "too few statements")
    )
    value = F.struct(
        raw["type"].alias("type"),
        F.when(blank(raw["question_text"]), F.trim(fallback)).otherwise(F.trim(raw["question_text"])).alias("question_text"),
        F.when(raw["type"] == "single", F.array().cast("array<struct<id:string,text:string>>")).otherwise(named).alias("statements"),
    )
    return F.when(error.isNull(), value), error


def fan_out(rows: DataFrame, structure: str = "structure") -> DataFrame:
    """One row for each retrieval query: the question itself, or each of its statements."""
    s = F.col(structure)
    one = F.array(F.struct(F.lit("Q").alias("id"), s["question_text"].alias("text")))
    each = F.when(s["type"] == "single", one).otherwise(s["statements"])
    keep = [c for c in rows.columns if c != structure]
    return rows.select(*keep, F.posexplode(each).alias("query_no", "q")).select(*keep, "query_no", F.col("q.id").alias("query_id"), F.col("q.text").alias("query_text"))


def read_pictures(rows: DataFrame, provider: ChatProvider, model: str, system: str, picture: str = "image_data", output: str = "ocr_text") -> DataFrame:
    """``rows`` with the text that a model reads from each picture (a data URL); rows without a valid one get none."""
    asked = rows.withColumn("_ask", F.when(is_image_data_url(F.col(picture)), F.lit("Write down the text of this picture.")))
    return complete_column(asked, provider, model, system, "_ask", output, picture).drop("_ask")


def combined_text(typed: Column, read: Column) -> Column:
    """Typed text, blank line, text read from a picture; null if there is neither."""
    t, r = F.trim(F.coalesce(typed, F.lit(""))), F.coalesce(read, F.lit(""))
    return F.when((t != "") & (r != ""), F.concat(t, F.lit("\n\n"), r)).when(t != "", t).when(r != "", r)


def recent_history(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", last: int = HISTORY_TURNS) -> DataFrame:
    """Of each conversation's last turns those of user and assistant that say something, cut to a length."""
    n = F.row_number().over(Window.partitionBy(conversation).orderBy(F.col(turn).desc()))
    rows = turns.withColumn("_n", n).filter(F.col("_n") <= last).drop("_n")
    rows = rows.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return rows.withColumn("text", F.substring(F.trim("text"), 1, HISTORY_CHARS))


def history_json(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conversation, history): the recent turns as a JSON list."""
    item = F.struct(F.col(turn), F.struct("role", F.col("text").alias("content")).alias("x"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda t: t["x"])
    return recent_history(turns, conversation, turn).groupBy(conversation).agg(F.to_json(listed).alias("history"))


def with_catalog_titles(passages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Titles from the catalog, else the passage's own, else the book id; and citation labels."""
    names = catalog.select("book_id", F.col("title").alias("_title"))
    out = passages.join(names, "book_id", "left").withColumn("book_title", F.coalesce("_title", "book_title", "book_id")).drop("_title")
    return out.withColumn("citation_label", citation_label(F.col("book_title"), F.col("book_pages")))


def evidence(passages: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(key, evidence): Markdown sections of a question's queries with their cited passages in rank order.

    ``queries`` has (key, query_no, query_id, query_text); ``passages`` (key, query_no, rank,
    citation_label, chapter_title, text).
    """
    text = F.concat(F.lit("Label: ["), "citation_label", F.lit("]\nChapter: "), "chapter_title", F.lit("\n"), "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), "\n\n")
    found = passages.groupBy(key, "query_no").agg(joined.alias("found"))
    body = F.coalesce("found", F.lit("Nothing was found."))
    section = F.concat(F.lit("## Passages for "), "query_id", F.lit("\nLooked up: "), "query_text", F.lit("\n\n"), body)
    rows = queries.join(found, [key, "query_no"], "left").select(key, F.struct("query_no", section.alias("s")).alias("x"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n\n").alias("evidence"))


def prompt(question: Column, history: Column, structure: Column, evidence_text: Column) -> Column:
    """What the answering model is asked: question, recent turns, structure and cited evidence."""
    return F.concat(
        F.lit("# The question as asked\n"),
        question,
        F.lit("\n\n# What was said before\n"),
        F.coalesce(history, F.lit("[]")),
        F.lit("\n\n# How the question is built\n"),
        F.to_json(structure),
        F.lit("\n\n# Passages found in the books\n"),
        evidence_text,
        F.lit("\n\nReply in Persian to the question as asked, and cite by the labels of book and page given above, nothing else."),
    )


def missing_scores(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Pairs (cache_key, question, passage) that a score cache (cache_key, score) lacks, once each."""
    return pairs.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def cached_scores(pairs: DataFrame, cache: DataFrame, score) -> tuple[DataFrame, DataFrame]:
    """(scored pairs, new cache rows): ``score(questions, passages)`` runs for misses only."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "score": [float(s) for s in score(pdf["question"].tolist(), pdf["passage"].tolist())]})

    new = missing_scores(pairs, cache).select("cache_key", "question", "passage").mapInPandas(run, "cache_key string, score double")
    return pairs.join(cache.select("cache_key", "score").unionByName(new), "cache_key"), new
