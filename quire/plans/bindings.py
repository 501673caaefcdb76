"""The driver's tables in the shapes that the operators take, each with its SQL twin.

E lines of documents, N numbered headings, G geometry, H page elements, K rendered Korean
sentences, V vectors, C conversations, T titles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer parts than there are cores, as a small file is, dealt to all of them; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """E."""
    out = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    out = out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("text").alias("text")).filter("text <> ''")
    kind = F.when(F.length("text").between(3, 40), "heading").otherwise("paragraph")
    return out.select("doc_id", "pos", F.col("pos").alias("id"), F.expr("pos div 10 + 1").alias("page"), "text", kind.alias("type"), F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("string").alias("category"))


E = """e0 AS (SELECT doc_id, unnest(range(len(a))) AS pos, trim(unnest(a)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
e AS (SELECT doc_id, pos, pos AS id, pos // 10 + 1 AS page, text, CASE WHEN length(text) BETWEEN 3 AND 40 THEN 'heading' ELSE 'paragraph' END AS type FROM e0 WHERE text <> '')"""


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """N."""
    k = F.col("pos") % 6
    head = F.when(k == 0, "1. ").when(k == 2, "1.1. ").when(k == 4, "1.1.1. ").otherwise("")
    tail = F.when(k.isin(1, 2), F.concat(F.lit(" ..... "), F.col("page"))).otherwise("")
    els = lines(spark, sf)
    size = (F.lit(10) + F.length("text") % 5).cast("double")
    return els.select("doc_id", "pos", "id", "page", F.concat(head, "text", tail).alias("text"), F.when(F.col("pos") % 2 == 0, "heading").otherwise("paragraph").alias("type"), size.alias("size"), F.lit(0.1).alias("x"), F.col("pos").cast("double").alias("y"), "markdown", "category")


N = E + """, n AS (SELECT doc_id, pos, id, page, CASE pos % 6 WHEN 0 THEN '1. ' WHEN 2 THEN '1.1. ' WHEN 4 THEN '1.1.1. ' ELSE '' END || text || CASE WHEN pos % 6 IN (1, 2) THEN ' ..... ' || page ELSE '' END AS text,
 CASE WHEN pos % 2 = 0 THEN 'heading' ELSE 'paragraph' END AS type, (10 + length(text) % 5)::DOUBLE AS size, 0.1::DOUBLE AS x, pos::DOUBLE AS y FROM e)"""


def geometry(spark: SparkSession, sf: str) -> DataFrame:
    """G: a page is 1 x 1; each has a page number too."""
    els = lines(spark, sf)
    text = F.concat(F.when(F.col("pos") % 6 == 0, F.concat(F.expr("pos div 6 + 1"), F.lit(". "))).otherwise(""), F.regexp_replace("text", r"[.!?]+$", ""))
    x1 = ((F.expr("pos div 3") * 37 + F.col("doc_id") * 11) % 50) / F.lit(100.0)
    y1 = (F.col("pos") % 10) / F.lit(10.0)
    size = F.when(F.col("pos") % 6 == 0, F.lit(16.0)).otherwise((F.lit(10) + F.length("text") % 3).cast("double"))
    rows = els.select("doc_id", "pos", "page", text.alias("text"), x1.alias("x1"), y1.alias("y1"), (x1 + F.lit(0.4)).alias("x2"), (y1 + F.lit(0.04)).alias("y2"), size.alias("size"), F.when(F.col("pos") % 7 == 0, "Bold").otherwise("Regular").alias("font"))
    pages = els.select("doc_id", "page").distinct().select("doc_id", (F.lit(1000000) + F.col("page")).alias("pos"), "page", F.col("page").cast("string").alias("text"), F.lit(0.90).alias("x1"), F.lit(0.95).alias("y1"), F.lit(0.95).alias("x2"), F.lit(0.97).alias("y2"), F.lit(9.0).alias("size"), F.lit("Regular").alias("font"))
    return rows.unionByName(pages)


G = E + """, g AS (SELECT doc_id, pos, page, CASE WHEN pos % 6 = 0 THEN (pos // 6 + 1) || '. ' ELSE '' END || regexp_replace(text, '[.!?]+$', '') AS text,
 (((pos // 3) * 37 + doc_id * 11) % 50) / 100::DOUBLE AS x1, (pos % 10) / 10::DOUBLE AS y1, (((pos // 3) * 37 + doc_id * 11) % 50) / 100::DOUBLE + 0.4::DOUBLE AS x2, (pos % 10) / 10::DOUBLE + 0.04::DOUBLE AS y2,
 CASE WHEN pos % 6 = 0 THEN 16.0::DOUBLE ELSE (10 + length(text) % 3)::DOUBLE END AS size, CASE WHEN pos % 7 = 0 THEN 'Bold' ELSE 'Regular' END AS font FROM e
 UNION ALL SELECT DISTINCT doc_id, 1000000 + page, page, page::VARCHAR, 0.90::DOUBLE, 0.95::DOUBLE, 0.95::DOUBLE, 0.97::DOUBLE, 9.0::DOUBLE, 'Regular' FROM e)"""


def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    """H."""
    pattern = r"<(title|h1|p|li)(?:\s[^>]*)?>([^<]*)"
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("text"))
    out = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(both).alias("pos", "m"))
    category = F.create_map(*[F.lit(v) for kv in {"h1": "heading1", "p": "paragraph", "li": "list", "title": "header"}.items() for v in kv])
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit(1).cast("long").alias("page"), category[F.col("m.tag")].alias("category"), F.trim("m.text").alias("text"), F.lit(None).cast("string").alias("type"), F.col("pos").cast("double").alias("y"))


H = r"""h AS (SELECT doc_id, pos, 1::BIGINT AS page, CASE tag WHEN 'h1' THEN 'heading1' WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'list' ELSE 'header' END AS category, trim(text) AS text, pos::DOUBLE AS y FROM (
 SELECT page_id AS doc_id, unnest(range(len(t))) AS pos, unnest(t) AS tag, unnest(x) AS text FROM (
 SELECT page_id, regexp_extract_all(html, '<(title|h1|p|li)(?:\s[^>]*)?>([^<]*)', 1) AS t, regexp_extract_all(html, '<(title|h1|p|li)(?:\s[^>]*)?>([^<]*)', 2) AS x FROM pages)))"""


def korean(spark: SparkSession, sf: str) -> DataFrame:
    """K: a line for each order."""
    k, p = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    year, month, day = (f("o_orderdate").cast("string") for f in (F.year, F.month, F.dayofmonth))
    head = F.concat(year, F.lit("년 "), month, F.lit("월 "), day, F.lit("일 "))
    line = (
        F.when(k % 4 == 0, F.concat(head, F.lit("금액 "), p, F.lit("원, (소득법 제"), k % 120 + 1, F.lit("조), 「견본세법」 제"), k % 120 + 1, F.lit("조 제"), k % 5 + 1, F.lit("항, 견본 시행령, 견본 시행규칙")))
        .when(k % 4 == 1, F.concat(head, F.lit("예금 금리 "), k % 9 + 1, F.lit("%, 한도 "), k % 90 + 10, F.lit("만원 "), k % 9 + 1, F.lit("억원 "), k % 3 + 1, F.lit("조원 "), k % 70 + 1, F.lit("천원, 견본재단, 재단법인 견본")))
        .when(k % 4 == 2, F.concat(k % 20 + 1, F.lit(". 견본 항목\n- 표 "), k % 9 + 1, F.lit(" 그림 "), k % 4 + 1, F.lit(" 페이지 "), k % 300 + 1, F.lit(" ["), k % 7, F.lit("] *\nA. 견본")))
        .otherwise(F.concat(head, F.lit("계약서 제"), k % 30 + 1, F.lit("조 당사자, 적용시기 : "), year, F.lit(".1.1. 이후\n"), F.trim(head), F.lit("부터 "), head))
    )
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("pos"), line.alias("text"))


K = """k0 AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, o_orderkey AS k, floor(o_totalprice)::BIGINT AS p, year(o_orderdate)::VARCHAR AS y, year(o_orderdate) || '년 ' || month(o_orderdate) || '월 ' || day(o_orderdate) || '일 ' AS head FROM orders),
k AS (SELECT doc_id, pos, CASE k % 4
 WHEN 0 THEN head || '금액 ' || p || '원, (소득법 제' || (k % 120 + 1) || '조), 「견본세법」 제' || (k % 120 + 1) || '조 제' || (k % 5 + 1) || '항, 견본 시행령, 견본 시행규칙'
 WHEN 1 THEN head || '예금 금리 ' || (k % 9 + 1) || '%, 한도 ' || (k % 90 + 10) || '만원 ' || (k % 9 + 1) || '억원 ' || (k % 3 + 1) || '조원 ' || (k % 70 + 1) || '천원, 견본재단, 재단법인 견본'
 WHEN 2 THEN (k % 20 + 1) || '. 견본 항목' || chr(10) || '- 표 ' || (k % 9 + 1) || ' 그림 ' || (k % 4 + 1) || ' 페이지 ' || (k % 300 + 1) || ' [' || (k % 7) || '] *' || chr(10) || 'A. 견본'
 ELSE head || '계약서 제' || (k % 30 + 1) || '조 당사자, 적용시기 : ' || y || '.1.1. 이후' || chr(10) || trim(head) || '부터 ' || head END AS text FROM k0)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """C: a line for each turn; a user's turn opens a section."""
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("type"), "role", "text", F.expr("turn div 4 + 1").alias("page"))


C = "c AS (SELECT conv_id AS doc_id, turn AS pos, CASE WHEN role = 'user' THEN 'heading' ELSE 'paragraph' END AS type, role, text, turn // 4 + 1 AS page FROM conversations)"


def titles(spark: SparkSession, sf: str) -> DataFrame:
    """T: the first line of every twentieth document."""
    return lines(spark, sf).filter("pos = 0 and doc_id % 20 = 0").select(F.col("doc_id").alias("title_no"), F.col("text").alias("title"))


T = "t AS (SELECT doc_id AS title_no, text AS title FROM e WHERE pos = 0 AND doc_id % 20 = 0)"
