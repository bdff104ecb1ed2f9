"""Prompt texts as column expressions over a table of templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx

#: Wording of the prompts, by the domain of a dataset; own texts.
TEMPLATES = [
    ("paper", "Decide which research area the paper below belongs to.", "paper"),
    ("product", "Decide which shop category the product below belongs to.", "product"),
    ("forum", "Decide which board the thread below belongs to.", "thread"),
    ("", "Decide which class the node below belongs to.", "node"),
]
SEARCH_HELP = "You may search up to {k} times with 1-hop:, 2-hop:, pagerank: or similar: inside <|begin_of_query|> and <|end_of_query|>."


def templates(spark) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "domain string, task string, noun string")


def pool_limit(own: Column, default: Column, fallback: int = 5) -> Column:
    """A pool's own limit (0 counts), else the default, where 0 or nothing means the fallback."""
    return F.coalesce(own, F.nullif(default, F.lit(0)), F.lit(fallback))


def node_prompts(nodes: DataFrame, with_classes: tuple[str, ...] = ("product", "forum"), k: int = 5, snippet: int = 500) -> DataFrame:
    """Adds prompt to (domain, text, classes); the class list is shown for the given domains only."""
    t = F.broadcast(templates(nodes.sparkSession))  # four rows
    j = nodes.join(t.withColumnRenamed("domain", "_d"), F.col("_d") == F.when(F.col("domain").isin([x[0] for x in TEMPLATES]), F.col("domain")).otherwise(F.lit("")))
    shown = F.when(F.col("domain").isin(*with_classes), F.concat(F.lit("\nClasses: "), F.array_join("classes", ", "))).otherwise(F.lit(""))
    body = F.concat(F.col("task"), F.lit("\n"), F.lit(SEARCH_HELP.replace("{k}", str(k))), shown, F.lit("\nThe "), F.col("noun"), F.lit(": "), tx.preview(F.col("text"), snippet))
    return j.withColumn("prompt", body).drop("_d", "task", "noun")


def link_prompts(pairs: DataFrame, k: int = 5, snippet: int = 480) -> DataFrame:
    """Adds prompt to (dataset, text_u, text_v)."""
    ask = F.concat(F.lit("Decide whether a "), tx.relation_of(F.col("dataset")), F.lit(" joins the two nodes; answer yes or no.\n"), F.lit(SEARCH_HELP.replace("{k}", str(k))))
    return pairs.withColumn("prompt", F.concat(ask, F.lit("\nNode U: "), tx.preview_within(F.col("text_u"), snippet), F.lit("\nNode V: "), tx.preview_within(F.col("text_v"), snippet)))


def chat(messages: Column, open_: str = "<|{role}|>", close: str = "<|end|>") -> Column:
    """A list of (role, content) as one text with role marks."""
    head, tail = open_.split("{role}")
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(head), m["role"], F.lit(tail), m["content"], F.lit(close))), "")
