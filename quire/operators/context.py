"""Retrieval context: rendered blocks, their metadata, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .batches import ordered_join

#: The marker words of a rendered context.
DOCUMENT, CONTENT, METADATA = "문서", "내용:", "메타데이터:"


def build_context(hits: DataFrame) -> DataFrame:
    """hits(query_id, rank, content, metadata) -> query_id, context: a numbered block for each hit, in order of rank."""
    block = F.format_string(f"{DOCUMENT} %d:\n{CONTENT} %s\n{METADATA} %s\n\n", F.col("rank"), "content", "metadata")
    return hits.withColumn("_block", block).groupBy("query_id").agg(ordered_join(["rank"], "_block", "").alias("context"))


def extract_metadata_context(ctx: DataFrame) -> DataFrame:
    """R2: for each metadata marker the lines after it, up to the next document or content marker; markers may be indented.

    A metadata marker among such lines is one of them, and the lines after it come once more. A context without any, or null, gives an empty text.
    """
    lines = ctx.select("query_id", F.posexplode(F.split(F.coalesce("context", F.lit("")), "\n")).alias("pos", "line"))
    t = strip(F.col("line"))
    stop = (t.startswith(DOCUMENT) | t.startswith(CONTENT)).cast("int")
    run = F.sum(stop).over(Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    runs = lines.select("query_id", "pos", "line", t.startswith(METADATA).alias("mark"), run.alias("run"))
    runs = runs.groupBy("query_id", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "line", "mark"))).alias("l"))
    after = F.transform("l", lambda x, k: F.when(x["mark"], F.slice(F.col("l.line"), k + 2, F.size("l"))).otherwise(F.array().cast("array<string>")))
    kept = runs.select("query_id", F.struct("run", F.flatten(after).alias("lines")).alias("part"))
    parts = F.sort_array(F.collect_list("part"))
    return kept.groupBy("query_id").agg(F.array_join(F.flatten(F.transform(parts, lambda p: p["lines"])), "\n").alias("metadata_context"))


def render_prompts(requests: DataFrame, template: str, model: str = "model", temperature: float = 0.0) -> DataFrame:
    """requests(query_id, question, context) -> the request table; the template's slots are {question} and {context}."""
    prompt = F.replace(F.replace(F.lit(template), F.lit("{question}"), F.col("question")), F.lit("{context}"), F.col("context"))
    return requests.select("query_id", F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), prompt.alias("prompt"))
