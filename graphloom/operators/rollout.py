"""Iterative rollouts: generate, read the query, retrieve, append the documents, repeat.

The working set shrinks from round to round: rows without a further query leave it. Each round is written to the shared folder, so
the lineage stays short and a lost executor costs one round at most. The generator is a function of a DataFrame, so a model plugs
in as a pandas_udf; the scripted one below is for tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.session import materialise

Generator = Callable[[DataFrame], DataFrame]
Retriever = Callable[[DataFrame], DataFrame]


def rollout(samples: DataFrame, generate: Generator, retrieve: Retriever, rounds: int = 12, searches: int = 5, closing: str = tx.ANSWER[1]) -> DataFrame:
    """samples: qid, prompt, ... -> qid, transcript, searches, finished.

    generate(df with qid, transcript, turn) adds `output`; retrieve(df with qid, query) gives qid, docs (a text). A row is finished
    when its output holds the closing mark or no query; a query beyond the limit is ignored and the row goes on; rows that are
    left after the last round come out unfinished, as they are."""
    live = samples.select("qid", F.col("prompt").alias("transcript"), F.lit(0).alias("searches"))
    done = None
    for turn in range(rounds):
        out = generate(live.withColumn("turn", F.lit(turn)))
        out = out.withColumn("transcript", F.concat("transcript", "output")).withColumn("query", tx.last_query(F.col("output")))
        out = materialise(out.withColumn("finished", F.col("output").contains(closing) | F.col("query").isNull()))
        ended = out.where("finished").select("qid", "transcript", "searches", F.lit(True).alias("finished"))
        done = ended if done is None else done.union(ended)
        going = out.where("not finished")
        if not going.head(1):
            return done
        asking = going.where(F.col("searches") < searches)
        docs = retrieve(asking.select("qid", "query"))
        block = F.concat(F.lit("\n" + tx.DOCS[0] + "\n"), F.coalesce("docs", F.lit("None\n")), F.lit(tx.DOCS[1] + "\n"))
        found = asking.join(docs, "qid", "left").select("qid", F.concat("transcript", block).alias("transcript"), (F.col("searches") + 1).alias("searches"))
        live = materialise(found.union(going.where(F.col("searches") >= searches).select("qid", "transcript", "searches")))
    left = live.select("qid", "transcript", "searches", F.lit(False).alias("finished"))
    return left if done is None else done.union(left)


def scripted(df: DataFrame) -> DataFrame:
    """A deterministic generator: row qid asks qid modulo 4 queries, one a turn and each of another kind, then answers."""
    kinds = F.array(*[F.lit(k) for k in tx.SEARCH_KINDS])
    ask = F.concat(F.lit(tx.QUERY[0]), F.element_at(kinds, (F.col("turn") % 4 + 1).cast("int")), F.lit(": step "), F.col("turn").cast("string"), F.lit(tx.QUERY[1]))
    return df.withColumn("output", F.when(F.col("turn") < F.col("qid") % 4, ask).otherwise(F.concat(F.lit("<answer>"), F.col("qid").cast("string"), F.lit("</answer>"))))
