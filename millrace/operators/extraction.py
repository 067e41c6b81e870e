"""What is computed from the answers of models and from conversations: merging, ranking, turns, tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions.text import entity_valid, first_words, sentences, word_count
from millrace.session import cut


class Model(Protocol):
    """A model as the engine calls it: batches of texts in, one answer each out."""

    def __call__(self, texts: list[str]) -> list[str]: ...


def applied(frame: DataFrame, text: str, model: Callable[[list[str]], list[str]], name: str = "answer", batch: int = 32) -> DataFrame:
    """Add the model's answer for each text, in batches; null texts have none and are not sent."""
    schema = StructType([*(f for f in frame.schema.fields if f.name != name), StructField(name, StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers: list[str | None] = [None] * len(part)
            rows = [k for k, t in enumerate(part[text]) if t is not None]
            for start in range(0, len(rows), batch):
                chunk = rows[start : start + batch]
                for k, answer in zip(chunk, model([part[text].iloc[k] for k in chunk]), strict=True):
                    answers[k] = answer
            yield part.assign(**{name: pd.Series(answers, index=part.index, dtype=object)})[schema.names]

    return frame.mapInPandas(run, schema)


def map_reduce(
    chunks: DataFrame,
    leaf: Callable[[list[str]], list[str]],
    merge: Callable[[list[str]], str],
    key: str = "doc_id",
    position: str = "pos",
    text: str = "chunk",
    budget: int | None = None,
    rounds: int = 3,
) -> DataFrame:
    """key, result: the leaf answers of a text's chunks, merged in order.  Failed tasks are retried by Spark.

    With a ``budget`` of characters, a result of more than twice as many is cut into chunks of that
    length and goes through again, at most ``rounds`` times.  Answers of a round are written before the
    next, so that no model is asked twice.  Texts without an answer have no row.
    """

    @F.pandas_udf("string")
    def reduced(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: merge(list(x)))

    def once(rows: DataFrame) -> DataFrame:
        answered = applied(rows.select(key, position, text), text, leaf).where("answer is not null")
        parts = answered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), "answer"))).alias("a"))
        return parts.select(key, reduced(F.transform("a", lambda x: x["answer"])).alias("result"))

    result = once(chunks)
    for _ in range(rounds if budget else 0):
        result = cut(result)
        long = F.length("result") > 2 * budget
        if result.where(long).isEmpty():
            break
        starts = F.sequence(F.lit(1), F.length("result"), F.lit(budget))
        again = result.where(long).select(key, "result", F.posexplode(starts).alias(position, "__at")).select(key, position, F.substring(F.col("result"), F.col("__at"), F.lit(budget)).alias(text))
        result = result.where(~F.coalesce(long, F.lit(False))).unionByName(once(again))
    return result


def translated(items: DataFrame, model: Callable[[list[str]], list[str]], key: str, text: str, most: int = 400) -> DataFrame:
    """key, text: long items cut into pieces of ``most`` words, translated and joined again in order."""
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(most)))
    pieces = items.select(key, words.alias("w"), F.posexplode(starts).alias("pos", "start")).select(key, "pos", F.array_join(F.slice("w", F.col("start") + 1, most), " ").alias("chunk"))
    return map_reduce(pieces, model, " ".join, key).withColumnRenamed("result", text)


# --- merging of found items


def merge_keywords(found: DataFrame, most: int = 10, document: str = "doc_id", chunk: str = "chunk", position: str = "pos", word: str = "keyword") -> DataFrame:
    """Per document the keywords of most chunks, equal but for case, in their first form; ties by first place."""
    grouped = found.groupBy(document, F.lower(word).alias("key")).agg(F.count_distinct(chunk).alias("n"), F.min(F.struct(chunk, position, word)).alias("first"))
    ranked = grouped.withColumn("rank", F.row_number().over(Window.partitionBy(document).orderBy(F.desc("n"), "first")))
    return ranked.where(F.col("rank") <= most).select(document, "rank", F.col(f"first.{word}").alias(word), "n")


def merge_entities(found: DataFrame, document: str = "doc_id", position: str = "pos") -> DataFrame:
    """Per document the first of the valid entities that are equal but for case, in order."""
    valid = found.where(entity_valid("word", "label"))
    first = valid.groupBy(document, F.lower("word").alias("key")).agg(F.min(F.struct(position, "word", "label")).alias("e"))
    return first.select(document, f"e.{position}", "e.word", "e.label")


def fallback_keywords(documents: DataFrame, most: int = 10, words: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, rank, keyword: the distinct beginnings of a text's sentences that occur most, ties by first place."""
    parts = documents.select(key, F.posexplode(sentences(text)).alias("pos", "sentence")).select(key, "pos", first_words("sentence", words).alias("keyword"))
    grouped = parts.where("keyword <> ''").groupBy(key, F.lower("keyword").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "keyword")).alias("first"))
    ranked = grouped.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first.pos")))
    return ranked.where(F.col("rank") <= most).select(key, "rank", F.col("first.keyword").alias("keyword"), "n")


def fallback_points(documents: DataFrame, most: int = 5, least_words: int = 3, most_words: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, rank, point: the first distinct sentences of three to ten words."""
    parts = documents.select(key, F.posexplode(sentences(text)).alias("pos", "point")).where(word_count("point").between(least_words, most_words))
    first = parts.groupBy(key, "point").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    return ranked.where(F.col("rank") <= most).select(key, "rank", "point")


# --- conversations


def last_turns(turns: DataFrame, most: int = 16, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The latest turns of user and assistant of each conversation."""
    rows = turns.where(F.col("role").isin("user", "assistant"))
    later = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return rows.withColumn("__n", F.row_number().over(later)).where(F.col("__n") <= most).drop("__n")


def last_user_message(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    return turns.where("role = 'user'").groupBy(conversation).agg(F.max_by(text, turn).alias(text))


# What a memory step may do, and kinds of memories.
MEMORY_ACTIONS = ("save", "replace", "forget", "none")
MEMORY_TYPES = ("fact", "episode", "instruction")


def memory_actions(proposed: DataFrame, known: str = "known_ids") -> DataFrame:
    """Checked memory steps: action, type, name, body, target_id.

    Saving needs a name and a body, replacing and forgetting an id among the known ones; a step that
    lacks them, or an unknown one, is none.  Unknown types are fact, names are cut to 120.
    """
    action = F.lower(F.trim("action"))
    written = (F.trim(F.coalesce("name", F.lit(""))) != "") & (F.trim(F.coalesce("body", F.lit(""))) != "")
    aimed = F.coalesce(F.array_contains(known, F.col("target_id")), F.lit(False))
    done = F.when((action == "save") & written, action).when((action == "replace") & written & aimed, action).when((action == "forget") & aimed, action).otherwise("none")
    kind = F.when(F.lower(F.trim("type")).isin(*MEMORY_TYPES), F.lower(F.trim("type"))).otherwise("fact")
    return proposed.select(
        done.alias("action"),
        F.when(done.isin("save", "replace"), kind).alias("type"),
        F.when(done.isin("save", "replace"), F.substring(F.trim("name"), 1, 120)).alias("name"),
        F.when(done.isin("save", "replace"), F.trim("body")).alias("body"),
        F.when(done.isin("replace", "forget"), F.col("target_id")).alias("target_id"),
    )


def keep_allowed(answers: Column, allowed: Sequence[str]) -> Column:
    return F.array_intersect(answers, F.array(*map(F.lit, allowed)))
