"""Counts and statistics of elements, pages, fonts and columns. All sums are partial before a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import ranges, running

WORD = r"[\p{L}\p{N}_]+"


def count_by_label(df: DataFrame, label: str, default: str = "unknown") -> DataFrame:
    """S1."""
    return df.groupBy("doc_id", F.coalesce(F.col(label), F.lit(default)).alias("label")).agg(F.count("*").alias("n"))


def elements_per_page(els: DataFrame) -> DataFrame:
    """A missing page is page 0."""
    return els.groupBy("doc_id", F.coalesce("page", F.lit(0)).alias("page")).agg(F.count("*").alias("n"))


def basic_statistics(els: DataFrame) -> DataFrame:
    """S3: lengths over non-empty texts, 0 when there is none."""
    n = F.when(F.length("text") > 0, F.length("text"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return els.groupBy("doc_id").agg(
        F.count("*").alias("total_elements"), F.max(F.coalesce("page", F.lit(0))).alias("total_pages"), F.round(zero(F.avg(n)), 6).alias("avg_length"), zero(F.min(n)).cast("long").alias("min_length"), zero(F.max(n)).cast("long").alias("max_length")
    )


def page_word_counts(els: DataFrame) -> DataFrame:
    """Pages without a word are kept."""
    return els.groupBy("doc_id", F.coalesce("page", F.lit(0)).alias("page")).agg(F.sum(F.regexp_count("text", F.lit(WORD))).cast("long").alias("words"))


def content_totals(els: DataFrame) -> DataFrame:
    """Characters with one joining space for each element, and words."""
    return els.groupBy("doc_id").agg(F.sum(F.length("text") + 1).cast("long").alias("total_chars"), F.sum(F.regexp_count("text", F.lit(WORD))).cast("long").alias("total_words"))


def layout_statistics(els: DataFrame) -> DataFrame:
    """Mean and population deviation of element centres on each page; elements without coordinates don't count."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    stats = {f"{k}_{f}": F.round(g(c), 8) for k, c in (("x", x), ("y", y)) for f, g in (("mean", F.avg), ("std", F.stddev_pop))}
    return els.filter("x1 is not null").groupBy("doc_id", "page").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in stats.items()])


def sections(els: DataFrame, flag: str = "type = 'heading'") -> DataFrame:
    """els with the number of the section that a heading opened, by position; 0 before the first."""
    return running(els, ["pos"], [ranges()], sums={"section": F.when(F.expr(flag), 1)})


def section_lengths(els: DataFrame) -> DataFrame:
    """Each heading with the number of elements up to the next."""
    s = sections(els).filter("section > 0")
    first = lambda c: F.min_by(c, "pos").alias(c)
    return s.groupBy("doc_id", "section").agg(first("text"), first("page"), (F.count("*") - 1).alias("length")).withColumnRenamed("text", "title")


def section_contents(els: DataFrame, flag: str = "type = 'heading'") -> DataFrame:
    """Per heading the elements below it: paragraphs by type, tables, images and lists by category; and its pages."""
    s = sections(els, flag).filter("section > 0")
    body = ~F.coalesce(F.expr(flag), F.lit(False))
    like = lambda p: F.count_if(body & F.coalesce(F.col("category").startswith(p), F.lit(False))).alias(f"{p}s")
    paragraphs = F.count_if(body & F.coalesce(F.col("type") == "paragraph", F.lit(False))).alias("paragraphs")
    return s.groupBy("doc_id", "section").agg(F.min_by("text", "pos").alias("title"), F.count_if(body).alias("elements"), paragraphs, like("table"), like("image"), like("list"), F.min_by("page", "pos").alias("first_page"), F.max("page").alias("last_page"))


def font_statistics(spans: DataFrame) -> DataFrame:
    """spans(doc_id, size) -> mean, upper median, extremes, body (commonest; of equally common ones the smaller, a decision of ours) and title sizes.

    Spans are summed up to (document, size) first: the median is then the size at which the running count passes half.
    """
    by = spans.groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    up, all_, common = Window.partitionBy("doc_id").orderBy("size"), Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy(F.desc("n"), "size")
    by = by.select("doc_id", "size", "n", F.sum("n").over(up).alias("upto"), F.sum("n").over(all_).alias("total"), F.row_number().over(common).alias("rank"))
    by = by.withColumn("body", F.max(F.when(F.col("rank") == 1, F.col("size"))).over(all_))
    half = F.floor(F.col("total") / 2)
    median = F.min(F.when(F.col("upto") > half, F.col("size")))
    title = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").isin(2, 3) & (F.col("size") > F.col("body")), F.struct("rank", "size")))), lambda s: F.round(s["size"], 1).cast("string")), ",")
    return by.groupBy("doc_id").agg(F.round(F.sum(F.col("size") * F.col("n")) / F.sum("n"), 6).alias("mean_size"), median.alias("median_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.max("body").alias("body_size"), title.alias("title_sizes"))


def column_profile(df: DataFrame, exact: bool = False, few: int = 1000) -> DataFrame:
    """A row for each column: type, nulls, distinct values, rows.

    One scan gives a sketch of each column; a second one counts, as sets, those that have few distinct values by it, and `exact` tells
    which these are. With `exact`, all are counted column by column: each reads that column alone, and sums up equal values before the shuffle.
    """
    if exact:
        out = None
        for name, kind in df.dtypes:
            value = F.col(f"`{name}`")
            by = df.groupBy(value.alias("v")).agg(F.count("*").alias("n"))
            total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
            one = by.agg(total(F.when(F.col("v").isNull(), F.col("n"))).alias("nulls"), F.count("v").alias("distinct_values"), total(F.col("n")).alias("rows"))
            one = one.select(F.lit(name).alias("column"), F.lit(kind).alias("type"), "nulls", "distinct_values", "rows")
            out = one if out is None else out.unionByName(one)
        return out
    told = {r.column: r for r in sketched_profile(column_sketches(df)).collect()}  # a row for each column
    few_ = [c for c, r in told.items() if r.distinct_values <= 1.2 * few]
    sets = df.agg(*[F.size(F.collect_set(f"`{c}`")).cast("long").alias(f"d{k}") for k, c in enumerate(few_)]).first() if few_ else ()
    counted = {c: n for c, n in zip(few_, sets, strict=True) if n <= few}
    rows = [(r.column, r.type, r.nulls, counted.get(c, r.distinct_values), r.rows, c in counted) for c, r in told.items()]
    return df.sparkSession.createDataFrame(rows, "column string, type string, nulls long, distinct_values long, rows long, exact boolean")


def column_sketches(df: DataFrame, by: list[str] | None = None, lg_k: int = 12) -> DataFrame:
    """S10 in parts: for each column, of each group if asked for: type, rows, nulls and a sketch of its distinct values, as bytes that can be kept and merged. One scan for all columns."""
    by = by or []
    kinds = [(n, t) for n, t in df.dtypes if n not in by]
    value = lambda n: F.when(F.col(f"`{n}`").isNotNull(), F.xxhash64(f"`{n}`"))
    aggs = [c for k, (n, _) in enumerate(kinds) for c in (F.count_if(F.col(f"`{n}`").isNull()).alias(f"_n{k}"), F.hll_sketch_agg(value(n), F.lit(lg_k)).alias(f"_s{k}"))]
    one = df.groupBy(*by).agg(F.count("*").alias("_rows"), *aggs)
    rows = [F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.col("_rows").alias("rows"), F.col(f"_n{k}").alias("nulls"), F.col(f"_s{k}").alias("sketch")) for k, (n, t) in enumerate(kinds)]
    return one.select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.*")


def merge_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of parts of a table -> those of the whole, or of larger groups."""
    return sketches.groupBy(*(by or []), "column", "type").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("sketch").alias("sketch"))


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """Sketches with the number of distinct values that each stands for."""
    return sketches.withColumn("distinct_values", F.hll_sketch_estimate("sketch")).drop("sketch")


def head_sample(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows."""
    return df.limit(n)


def repeating_blocks(blocks: DataFrame, band: float = 0.1, least_pages: int = 3) -> DataFrame:
    """blocks(doc_id, page, pos, places y1, y2 as shares of the page) inside the top or bottom band at a height y (two decimals) that recurs on several pages; the first on each page, with its own height y_rel.

    A block that reaches from one band to the other stands in both.
    """
    sides = F.array(F.struct(F.lit("top").alias("side"), F.when(F.col("y1") < band, F.col("y1")).alias("y_rel")), F.struct(F.lit("bottom").alias("side"), F.when(F.col("y2") > 1 - band, F.col("y2")).alias("y_rel")))
    own = blocks.withColumn("_s", F.explode(sides)).select("*", "_s.side", "_s.y_rel").drop("_s").filter("y_rel is not null").withColumn("y", F.round("y_rel", 2))
    kept = own.groupBy("doc_id", "side", "y").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= least_pages)
    first = F.row_number().over(Window.partitionBy("doc_id", "side", "y", "page").orderBy("pos"))
    return own.join(kept, ["doc_id", "side", "y"]).withColumn("_k", first).filter("_k = 1").drop("_k")

