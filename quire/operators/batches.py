"""Parse batches of a document become one document again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import ranges, running


def ordered_join(order: list[str], value: str, sep: str) -> Column:
    """Texts of a group in the order of some columns, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"]), sep)


def merge_batches(els: DataFrame) -> DataFrame:
    """M1: els(doc_id, batch_no, status, pos, ...) -> those of completed batches, numbered from 0 in each document. A range is a part of a batch."""
    done = running(els.filter("status = 'completed'"), ["batch_no", "pos"], [F.col("batch_no").cast("long"), ranges()], sums={"id": F.lit(1)})
    return done.withColumn("id", F.col("id") - 1)


def merge_batch_content(batches: DataFrame) -> DataFrame:
    """M2: batches(doc_id, batch_no, status, api, model, pages, text, markdown) -> a row for each document; api and model of its first batch."""
    done = batches.filter("status = 'completed'")
    return done.groupBy("doc_id").agg(
        ordered_join(["batch_no"], "text", "").alias("text"), ordered_join(["batch_no"], "markdown", "").alias("markdown"), F.sum("pages").alias("pages"), F.min_by("api", "batch_no").alias("api"), F.min_by("model", "batch_no").alias("model")
    )


def page_context(els: DataFrame) -> DataFrame:
    """els(doc_id, page, id, content) -> doc_id, page, page_content: non-empty contents in id order, a line each."""
    return els.filter("content <> ''").groupBy("doc_id", "page").agg(ordered_join(["id"], "content", "\n").alias("page_content"))


def attach_page_context(els: DataFrame) -> DataFrame:
    """Each element with its page's content and the rendered metadata; a null page is a page too."""
    ctx = page_context(els).withColumnsRenamed({"doc_id": "_d", "page": "_p"})
    out = els.join(ctx, (els["doc_id"] == ctx["_d"]) & els["page"].eqNullSafe(ctx["_p"]), "left").drop("_d", "_p")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    shown = F.format_string('id:%s,\npage: %s,\npage_content: {\n"%s"\n}', known("id"), known("page"), F.coalesce("page_content", F.lit("")))
    return out.withColumn("metadata", shown)


def document_text(els: DataFrame, sep: str = " ") -> DataFrame:
    """The document's non-empty texts in order, the separator before each."""
    return els.filter("text <> ''").groupBy("doc_id").agg(F.concat(F.lit(sep), ordered_join(["pos"], "text", sep)).alias("text"))
