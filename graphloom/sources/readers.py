"""Readers of graph folders, JSON and JSON-lines files, categories, splits, embeddings and run configurations."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.session import file_system


def read_any(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, most: int | None = None, **options: str) -> DataFrame:
    """parquet, orc, json, jsonl, csv, tsv or text by the ending of the path or the given kind; at most `most` rows where that is set."""
    kind = kind or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower() or "parquet"
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if kind in ("csv", "tsv"):
        reader = reader.option("header", options.get("header", "true")).option("sep", "\t" if kind == "tsv" else ",")
    out = reader.format({"jsonl": "json", "tsv": "csv", "txt": "text"}.get(kind, kind)).load(path)
    return out if most is None else out.limit(most)


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON arrays as (path, pos, v): the position is the node id; v is a variant, so elements may differ in kind."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.from_json("value", "array<variant>")).alias("pos", "v"))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): blank lines are skipped, a byte-order mark is tolerated, lines that are no JSON objects come out as bad."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("line")).where("trim(line) <> ''")
    parsed = raw.select("line", F.from_json("line", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    ok = F.col("r._corrupt").isNull() & F.col("r").isNotNull()
    return parsed.where(ok).select("r.*").drop("_corrupt"), parsed.where(~ok).select("line")


def falsy_coalesce(*cs: Column) -> Column:
    """The first value that is neither null nor empty after stripping; empty if there is none."""
    return F.coalesce(*[F.when(strip(c) != "", strip(c)) for c in cs], F.lit(""))


def node_texts(arrays: DataFrame, chain: tuple[str, ...] = ("summary_en", "summary", "text", "original")) -> DataFrame:
    """(path, node_id, text) from elements that are strings or objects; of objects the first non-empty field of the chain."""
    plain = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
    fields = [F.try_variant_get("v", f"$.{f}", "string") for f in chain]
    return arrays.select("path", F.col("pos").cast("long").alias("node_id"), falsy_coalesce(plain, *fields).alias("text"))


def categories(arrays: DataFrame) -> DataFrame:
    """(path, node_id, label): a string, or the first element of a list."""
    first = F.coalesce(F.try_variant_get("v", "$[0]", "string"), F.try_variant_get("v", "$", "string"))
    return arrays.select("path", F.col("pos").cast("long").alias("node_id"), first.alias("label"))


def neighbour_lists(arrays: DataFrame) -> DataFrame:
    """(path, node_id, hop): numbers cast to long; anything that is no list is an empty one."""
    hop = F.coalesce(F.transform(F.try_variant_get("v", "$", "array<double>"), lambda x: x.cast("long")), F.array().cast("array<bigint>"))
    return arrays.select("path", F.col("pos").cast("long").alias("node_id"), hop.alias("hop"))


def splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, node_id) from an object of id lists; ids that are no numbers go."""
    whole = spark.read.text(path, wholetext=True)
    m = whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("split", "ids"))
    return m.select("split", F.explode("ids").alias("i")).select("split", F.col("i").try_cast("long").alias("node_id")).where("node_id is not null")


def first_existing(paths: list[str]) -> str | None:
    """The first path that exists on its file system (a handful of names)."""
    return next((p for p in paths if exists(p)), None)


def exists(path: str) -> bool:
    fs, at = file_system(SparkSession.active(), path)
    return fs.exists(at(path))


def spellings(name: str) -> list[str]:
    """A dataset name with - and _ either way."""
    return list(dict.fromkeys([name, name.replace("-", "_"), name.replace("_", "-")]))


def discovered(root: str, marker: str = "node_texts.json") -> list[str]:
    """Names of the folders below root that hold the marker file, sorted."""
    fs, at = file_system(SparkSession.active(), root)
    names = [e.getPath().getName() for e in fs.listStatus(at(root)) if e.isDirectory()]
    return sorted(n for n in names if fs.exists(at(f"{root.rstrip('/')}/{n}/{marker}")))


def pagerank_pairs(spark: SparkSession, path: str, schema: str = "dataset string, node_u long, node_v long, is_edge boolean, rank int") -> DataFrame:
    """The side file of top pairs; a missing one is an empty table."""
    return json_lines(spark, path, schema)[0] if exists(path) else spark.createDataFrame([], schema)


def cached_vectors(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Vectors from the cache at path, or made and written there if it is absent; a cache that cannot be written is no error."""
    if exists(path):
        return spark.read.parquet(path)
    made = make()
    try:
        made.write.parquet(path)
    except Exception as e:  # noqa: BLE001 - the cache is a convenience
        warnings.warn(f"no cache at {path}: {type(e).__name__}", stacklevel=2)
        return made
    return spark.read.parquet(path)


def remote_documents(queries: DataFrame, query_col: str, client: Callable[[], Callable[[list[str]], list[list[str]]]], tries: int = 5) -> DataFrame:
    """Adds `docs`, the texts that a search service gives for each query: client() is called once per task and gives a function of a list
    of queries. A failed call is tried again; after that the task fails and Spark runs it elsewhere."""

    @F.pandas_udf("array<string>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = client()
        for b in batches:
            yield pd.Series(_tried(f, b.fillna("").tolist(), tries), index=b.index)

    return queries.withColumn("docs", ask(query_col))


def _tried(f: Callable, values: list, tries: int):
    for left in range(tries - 1, -1, -1):
        try:
            return f(values)
        except OSError:
            if not left:
                raise
    raise AssertionError


def category_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(name, category) from a text of lines like 'name': ['a', 'b']."""
    t = spark.read.text(path, wholetext=True)
    p = r"'([^']+)'\s*:\s*\[([^\]]*)\]"
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(p), F.lit(1)).alias("name"), F.regexp_extract_all("value", F.lit(p), F.lit(2)).alias("list"))
    one = t.select(F.explode(pairs).alias("p")).select("p.name", F.regexp_extract_all("p.list", F.lit("'([^']*)'"), F.lit(1)).alias("c"))
    return one.select("name", F.explode("c").alias("category"))


def source_registry(files: DataFrame, order: str = "position") -> DataFrame:
    """dataset, split, pairs, base_offset from (position, dataset, split, pairs); the same dataset and split twice is an error."""
    n = F.count("*").over(Window.partitionBy("dataset", "split"))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("listed twice: "), F.col("dataset"), F.lit("/"), F.col("split")))).otherwise(F.col("pairs"))
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("pairs", checked.cast("long")).withColumn("base_offset", F.coalesce(F.sum("pairs").over(w), F.lit(0)))


def run_options(spark: SparkSession, path: str) -> DataFrame:
    """One row per run of a configuration {shared: {...}, runs: [{...}]}: name and the merged options, the run's own winning."""
    whole = spark.read.text(path, wholetext=True)
    c = whole.select(F.from_json("value", "shared map<string,string>, runs array<map<string,string>>").alias("c")).select("c.shared", F.explode("c.runs").alias("own"))
    left = F.map_filter(F.coalesce("shared", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.col("own"), k))
    return c.select(F.col("own")["name"].alias("name"), F.map_concat(left, F.col("own")).alias("options"))


def remote_vectors(texts: DataFrame, text_col: str, client: Callable[[], Callable[[list[str]], list[list[float]]]], tries: int = 5) -> DataFrame:
    """Adds `embedding` by a remote or local encoder: client() is called once per task and gives a function of a list of texts.

    A failed call is tried again; after that the task fails and Spark runs it elsewhere."""
    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = client()
        for b in batches:
            yield pd.Series(_tried(f, b.fillna("").tolist(), tries), index=b.index)

    return texts.withColumn("embedding", encode(text_col))
