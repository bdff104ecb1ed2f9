"""Small HTTP services: rewards of responses and embeddings of texts, over the same expressions and encoders as the batch queries.

A request is a micro-batch: its rows become a table, are scored in one plan and come back in order. For a stream of requests from many
trainers use streaming.jobs.reward_batches instead."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import rewards as rw
from graphloom.sources import readers as rd


def rewards(spark: SparkSession, labels: DataFrame, rules: rw.Rules = rw.NC_STAGE1, link: bool = False) -> Callable[[dict], dict]:
    """POST {query: [{idx, response}, ...]} -> {rewards: [...]}, in the order asked; an idx without a label is scored without one."""

    def answer(request: dict) -> dict:
        rows = [(i, r.get("idx"), r.get("response") or "") for i, r in enumerate(request["query"])]
        asked = spark.createDataFrame(rows, "at int, idx long, response string")
        j = asked.join(labels.select("idx", F.col("gold").cast("int" if link else "string").alias("gold")), "idx", "left")
        found = j.select("at", F.round(rw.total(F.col("response"), F.col("gold"), rules, link), 6).alias("reward")).orderBy("at").collect()  # one request
        return {"rewards": [r.reward for r in found]}

    return answer


def embeddings(spark: SparkSession, encoder: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[dict], dict]:
    """POST {texts: [...]} -> {embeddings: [[...], ...]}, in the order asked."""

    def answer(request: dict) -> dict:
        asked = spark.createDataFrame(list(enumerate(request["texts"])), "at int, text string")
        found = rd.remote_vectors(asked, "text", encoder).orderBy("at").collect()  # one request
        return {"embeddings": [list(r.embedding) for r in found]}

    return answer


def served(routes: dict[str, Callable[[dict], dict]], host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server of POST routes with JSON bodies; start it with serve_forever(). A bad request gets 400, an unknown path 404."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802 - the name is fixed by the library
            route = routes.get(self.path)
            try:
                code, body = (200, route(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))) if route else (404, {"error": "no such path"})
            except (KeyError, TypeError, ValueError) as e:
                code, body = 400, {"error": f"{type(e).__name__}: {e}"}
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
