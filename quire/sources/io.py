"""Sources and sinks: parsed documents, text lines, tolerant JSON, embeddings, element tables, listings."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
CONTENT = T.StructType([T.StructField("text", T.StringType()), T.StructField("markdown", T.StringType())])
ELEMENT = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("page", T.LongType()), T.StructField("category", T.StringType()), T.StructField("type", T.StringType()), T.StructField("content", CONTENT), T.StructField("coordinates", T.ArrayType(POINT))]
)
DOCUMENT = T.StructType(
    [T.StructField("api", T.StringType()), T.StructField("model", T.StringType()), T.StructField("content", CONTENT), T.StructField("elements", T.ArrayType(ELEMENT)), T.StructField("usage", T.StructType([T.StructField("pages", T.LongType())]))]
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or, where the session names none, one in the warehouse. A cluster whose session names none, and whose warehouse is a local folder, is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/steps"
        if at.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


GOOD, BAD = "good", "quarantined"
CORRUPT = "_corrupt"


@dataclass
class Outcome:
    """What a landing leaves: rows that can be used, rows set aside with a reason, and how many of either the one pass over the input saw."""

    good: DataFrame
    quarantined: DataFrame
    counts: dict[str, int]


def land(rows: DataFrame, reason: Column, path: str) -> Outcome:
    """Writes rows in one pass, those with a reason apart from those without (folders outcome=quarantined and outcome=good of path), and counts both on the way."""
    told = Observation()
    own = rows.withColumn("reason", reason)
    bad = F.col("reason").isNotNull()
    own = own.withColumn("outcome", F.when(bad, BAD).otherwise(GOOD)).observe(told, F.count_if(~bad).alias(GOOD), F.count_if(bad).alias(BAD))
    own.write.mode("overwrite").partitionBy("outcome").parquet(path)
    spark = rows.sparkSession
    back = spark.read.schema(T.StructType([*own.schema.fields])).parquet(path)
    return Outcome(back.filter(F.col("outcome") == GOOD).drop("outcome", "reason"), back.filter(F.col("outcome") == BAD).drop("outcome"), {k: int(told.get[k] or 0) for k in (GOOD, BAD)})


def parsed_documents(spark: SparkSession, path: str, multi_line: bool = True, key: str | None = None) -> DataFrame:
    """Nested parse JSON, a document per file (or line) -> a row for each document, with doc_id (the file, or a top-level field), source (the file) and the text of what could not be parsed."""
    full = T.StructType([*DOCUMENT.fields, T.StructField(CORRUPT, T.StringType())])
    docs = spark.read.schema(full).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    at = F.col("_metadata.file_path")
    return docs.select((F.col(key) if key else at).alias("doc_id"), at.alias("source"), "*")


def document_reason() -> Column:
    """Why a document of parsed_documents() is of no use; null for those that are."""
    return F.when(F.col(CORRUPT).isNotNull(), "malformed").when(F.col("elements").isNull(), "no elements").when(F.col("doc_id").isNull(), "no key")


def elements_of(docs: DataFrame) -> DataFrame:
    """A row for each element, with pos; a document of an empty list gives none."""
    rows = docs.select("doc_id", F.posexplode("elements").alias("pos", "e"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "e.id", "e.page", "e.category", "e.type", F.col("e.content.text").alias("text"), F.col("e.content.markdown").alias("markdown"), "e.coordinates")


def read_parsed_documents(spark: SparkSession, path: str, multi_line: bool = True, key: str | None = None) -> DataFrame:
    """IO1: nested parse JSON, a document per file (or line) -> a row for each element with doc_id (the file, or a top-level field) and pos. What cannot be parsed is left out; land_parsed_documents() sets it aside."""
    return elements_of(parsed_documents(spark, path, multi_line, key))


def land_parsed_documents(spark: SparkSession, path: str, out: str, multi_line: bool = True, key: str | None = None) -> Outcome:
    """IO1 with quarantine: good are elements; quarantined are documents (doc_id, source, raw, reason): malformed, without a list of elements, or without a key. Counts are of documents."""
    docs = parsed_documents(spark, path, multi_line, key)
    landed = land(docs.select("doc_id", "source", F.col(CORRUPT).alias("raw"), "elements", CORRUPT), document_reason(), out)
    return Outcome(elements_of(landed.good), landed.quarantined.select("doc_id", "source", "raw", "reason"), landed.counts)


def to_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """IO2: docs(doc_id, text) -> doc_id, line_number (from 1, over raw lines), text stripped; blank lines go after numbering."""
    out = docs.select("doc_id", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("n", "text"))
    return out.select("doc_id", (F.col("n") + 1).cast("long").alias("line_number"), strip(F.col("text")).alias("text")).filter("text <> ''")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """IO2 on files, one document each."""
    return to_lines(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")))


def repair_json(raw: Column) -> Column:
    """Doubles backslashes that begin no legal escape; twice, since neighbours share a character."""
    for _ in range(2):
        raw = F.regexp_replace(raw, r'(^|[^\\])\\([^\\"/bfnrtu])', r"$1\\\\$2")
    return raw


def read_json_tolerant(df: DataFrame, raw: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """IO3: adds `parsed` (from the text, else from its repaired form), `repaired` (was it that form?) and `reason`, null where all is well: empty, malformed, or missing with the required fields that are not there; and `ok`."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parse = lambda c: F.from_json(c, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = df.withColumn("_p", parse(F.col(raw)))
    again = F.col("_p").isNull() | F.col(f"_p.{CORRUPT}").isNotNull()
    out = out.withColumn("repaired", F.coalesce(again, F.lit(False)) & (repair_json(F.col(raw)) != F.col(raw)))
    out = out.withColumn("_p", F.when(F.col("repaired"), parse(repair_json(F.col(raw)))).otherwise(F.col("_p")))
    whole = F.col("_p").isNotNull() & F.col(f"_p.{CORRUPT}").isNull()
    missing = F.array_compact(F.array(*[F.when(F.col(f"_p.{name}").isNull(), name) for name in required]) if required else F.array().cast("array<string>"))
    reason = F.when(F.coalesce(strip(F.col(raw)), F.lit("")) == "", "empty").when(~whole, "malformed").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    parsed = F.when(whole, F.struct(*[F.col(f"_p.{f.name}") for f in schema.fields]))
    out = out.withColumns({"parsed": parsed, "reason": reason, "repaired": F.coalesce(F.col("repaired") & whole, F.lit(False))})
    return out.withColumn("ok", F.col("reason").isNull()).drop("_p")


def land_json_tolerant(df: DataFrame, raw: str, schema: T.StructType, required: list[str], out: str) -> Outcome:
    """IO3 with quarantine: good have `parsed` and `repaired`; quarantined keep the raw text, with the reason."""
    return land(read_json_tolerant(df, raw, schema, required).drop("ok"), F.col("reason"), out)


def write_elements(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """IO4: elements, statistics, patterns or blocks -> files, in folders by the given columns.

    A write replaces the folders that it has rows for and leaves the others, so that a retry, or a later run over some
    documents or families, changes nothing else. Without such columns it replaces the whole table.
    """
    to = df.write.mode("overwrite").format(fmt)
    (to.option("partitionOverwriteMode", "dynamic").partitionBy(*by) if by else to).save(path)


def read_embeddings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """IO5: an array of {content, metadata, embedding} records (or a record a line) -> vector rows."""
    schema = T.StructType([T.StructField("content", T.StringType()), T.StructField("metadata", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def toc_listing(toc: DataFrame) -> DataFrame:
    """IO6: toc(doc_id, pos, title, target_page) -> printable lines, by target page."""
    return toc.orderBy("doc_id", "target_page", "pos").select("doc_id", F.format_string("%s (page %d)", "title", "target_page").alias("line"))


def heading_listing(els: DataFrame) -> DataFrame:
    """IO6: classified headings by page and text, with where they come from."""
    heads = els.filter("type = 'heading'")
    return heads.orderBy("doc_id", "page", "text").select("doc_id", F.format_string("[%s] %s (page %d)", F.coalesce("source", F.lit("-")), "text", "page").alias("line"))
