"""A query for each operator, on the driver's tables, and its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as X
from ..operators import batches, blocks, classify, context, match, offsets, sequence, stats, vectors
from ..sources import io
from . import bindings as B

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def chain(x: str, rules: list[tuple[str, str]]) -> str:
    """Nested regexp_replace calls; `$1` becomes SQL's `\\1`; look-ahead is left out, which the bound data don't need."""
    for p, to in rules:
        p = p.replace(r"(?!\s*적용)", "").replace("'", "''")
        x = f"regexp_replace({x}, '{p}', '{to.replace('$', chr(92))}', 'g')"
    return x


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def normal(x: str) -> str:
    return f"lower({squeeze(f"replace(replace({x}, chr(65381), chr(183)), chr(12685), chr(183))")})"


def clean(x: str) -> str:
    x = f"regexp_replace({x}, '^>>>>\\s*', '')"
    x = rf"CASE WHEN regexp_matches({x}, '^\d{{4}}년') OR regexp_matches({x}, '^제\s*\d+\s*[장절]') THEN {x} ELSE regexp_replace({x}, '^\d+\.?\s*', '') END"
    x = chain(f"({x})", X.YEARS + X.PAGE_ENDS + X.MIDDLE_DOTS + X.DATES)
    return rf"trim(regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '\(\s*\)', '', 'g'))"


def quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def count(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(p)}))"


COMPLETE = lambda x: rf"(regexp_matches(regexp_replace(coalesce({x}, ''), '\s+$', ''), '[.!?:;\"'')]$') AND NOT regexp_matches(regexp_replace(coalesce({x}, ''), '\s+$', ''), '\d\.$'))"
KD = B.K + ", kd AS (SELECT doc_id, ' ' || string_agg(text, ' ' ORDER BY pos) AS text FROM k GROUP BY doc_id)"
KL = B.K + ", kd AS (SELECT doc_id, chr(10) || string_agg(text, chr(10) ORDER BY pos) AS text FROM k GROUP BY doc_id)"


def k_docs(s: SparkSession, d: str, sep: str = " ") -> DataFrame:
    return batches.document_text(B.korean(s, d), sep)


# sources and listings


def parsed(s, d):
    """E as parse JSON, written and read again: a document a line, its number in `api`."""
    e = B.lines(s, d)
    el = F.struct("id", "page", "category", "type", F.struct("text", "markdown").alias("content"), F.array().cast("array<struct<x double, y double>>").alias("coordinates"))
    docs = e.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", el.alias("e")))), lambda x: x["e"]).alias("elements"))
    path = io.scratch(s, "parsed")
    docs.select(F.col("doc_id").cast("string").alias("api"), "elements").write.json(path)
    return io.read_parsed_documents(s, path, multi_line=False, key="api")


@query(f"WITH {B.E} SELECT doc_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, id, page, type, text FROM e")
def io1_parsed_documents(s, d):
    return parsed(s, d).select("doc_id", "pos", "id", "page", "type", "text")


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'malformed' WHEN doc_id % 7 = 0 THEN 'no elements' ELSE 'good' END AS outcome, doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN len(list_filter(string_split(text, chr(10)), lambda t: trim(t) <> '')) END AS elements FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR len(list_filter(string_split(text, chr(10)), lambda t: trim(t) <> '')) > 0")
def io1_quarantine(s, d):
    """E as parse JSON, a document a line; every fifth is cut off, every seventh has no list of elements."""
    el = F.struct(F.col("pos").alias("id"), "page", "type", F.struct("text").alias("content"))
    docs = B.lines(s, d).groupBy("doc_id").agg(F.collect_list(el).alias("elements"))
    docs = B.table(s, d, "documents").select("doc_id").join(docs, "doc_id", "left")
    k, line = F.col("doc_id"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("api"), F.when(F.col("doc_id") % 7 != 0, F.col("elements")).alias("elements")))
    path = io.scratch(s, "parsed")
    docs.filter((k % 5 == 0) | (k % 7 == 0) | F.col("elements").isNotNull()).select(F.when(k % 5 == 0, F.concat(F.substring(line, 1, 8), k)).otherwise(line).alias("value")).write.text(path)
    out = io.land_parsed_documents(s, path, io.scratch(s, "landed"), multi_line=False, key="api")
    good = out.good.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("elements")).select(F.lit("good").alias("outcome"), "doc_id", "elements")
    # of what is cut off nothing but the raw text tells the document: its number ends it
    number = F.coalesce(F.col("doc_id"), F.substring("raw", 9, 20)).cast("long")
    return good.unionByName(out.quarantined.select(F.col("reason").alias("outcome"), number.alias("doc_id"), F.lit(None).cast("long").alias("elements")))


@query(f"WITH {B.E} SELECT doc_id, pos, CASE WHEN type = 'heading' AND doc_id % 2 = 0 THEN '! ' || text ELSE text END AS text, type FROM e WHERE type <> 'heading' OR doc_id % 2 = 0")
def io4_write_elements(s, d):
    """All lines by type; then one type's folder again, of every second document and marked: the other stays."""
    path, e = io.scratch(s, "elements"), B.lines(s, d).select("doc_id", "pos", "text", "type")
    io.write_elements(e, path, "parquet", ["type"])
    io.write_elements(e.filter("type = 'heading' and doc_id % 2 = 0").withColumn("text", F.concat(F.lit("! "), "text")), path, "parquet", ["type"])
    return s.read.parquet(path)


@query(f"WITH {B.E} SELECT doc_id, pos + 1 AS line_number, text FROM e")
def io2_text_lines(s, d):
    return io.to_lines(B.table(s, d, "documents"))


PROPS = r"""CASE WHEN event_id % 7 = 0 THEN '{"broken' WHEN event_id % 5 = 0 THEN '{"note":"a\s\sb\n","own":' || event_id || '}' WHEN event_id % 3 = 0 THEN '{"own":' || event_id || '}' ELSE '{"note":"fine","own":' || event_id || '}' END"""


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS own, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'a' || chr(92) || 's' || chr(92) || 'sb' || chr(10) WHEN event_id % 3 = 0 THEN NULL ELSE 'fine' END AS note,
 (event_id % 7 <> 0 AND (event_id % 5 = 0 OR event_id % 3 <> 0)) AS ok, event_id % 7 <> 0 AND event_id % 5 = 0 AS repaired, CASE WHEN event_id % 7 = 0 THEN 'malformed' WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN 'missing note' END AS reason FROM events""")
def io3_tolerant_json(s, d):
    """Good rows and those set aside, of one pass."""
    k = F.col("event_id")
    raw = F.when(k % 7 == 0, '{"broken').when(k % 5 == 0, F.concat(F.lit('{"note":"a\\s\\sb\\n","own":'), k, F.lit("}"))).when(k % 3 == 0, F.concat(F.lit('{"own":'), k, F.lit("}"))).otherwise(F.concat(F.lit('{"note":"fine","own":'), k, F.lit("}")))
    schema = T.StructType([T.StructField("note", T.StringType()), T.StructField("own", T.LongType())])
    out = io.land_json_tolerant(B.table(s, d, "events").select("event_id", raw.alias("raw")), "raw", schema, ["note", "own"], io.scratch(s, "json"))
    shown = lambda df, reason: df.select("event_id", "parsed.own", "parsed.note", reason.isNull().alias("ok"), "repaired", reason.alias("reason"))
    return shown(out.good, F.lit(None).cast("string")).unionByName(shown(out.quarantined, F.col("reason")))


@query("SELECT vec_id, 'vector ' || vec_id AS content, len(embedding) AS dim, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS squared FROM embeddings")
def io5_embeddings(s, d):
    """The vectors as JSON records, written and read again."""
    path = io.scratch(s, "embeddings")
    e = B.table(s, d, "embeddings").select(F.format_string("vector %d", "vec_id").alias("content"), F.col("vec_id").cast("string").alias("metadata"), "embedding")
    e.write.json(path)
    v = io.read_embeddings(s, path, multi_line=False)
    return v.select(F.col("metadata").cast("long").alias("vec_id"), "content", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("squared"))


TOC_SQL = rf"""toc0 AS (SELECT doc_id, pos, x, regexp_extract(tx, '[0-9]+$') AS num, regexp_replace(tx, '[0-9]+$', '') AS head FROM (SELECT doc_id, pos, x, page, {strip('text')} AS tx FROM n) WHERE page BETWEEN 1 AND 2 AND length(tx) >= 3),
toc1 AS (SELECT *, CASE WHEN regexp_matches(head, '\.\.\.\s*$') THEN regexp_replace(head, '\.+\s*$', '') WHEN regexp_matches(head, '\.\.$') THEN regexp_replace(head, '..$', '') WHEN regexp_matches(head, '\.\.\s+$') OR ends_with(head, '.') THEN NULL WHEN regexp_matches(head, '\.\s+$') THEN regexp_replace(head, '\.\s+$', '')
 WHEN regexp_matches(head, '\s\s\s$') THEN regexp_replace(head, '...$', '') WHEN regexp_matches(head, '·\s+$') THEN regexp_replace(head, '·\s+$', '') WHEN regexp_matches(head, '\s>+\s+$') THEN regexp_replace(head, '\s>+\s+$', '') END AS z FROM toc0 WHERE num <> ''),
toc2 AS (SELECT *, CASE WHEN regexp_matches(z, '^[-\s>]*(\..*)?$') THEN regexp_extract(z, '[-\s>]?(\..*)?$') ELSE regexp_extract(z, '^[-\s>]*(.*)$', 1) END AS r FROM toc1 WHERE z IS NOT NULL),
toc AS (SELECT doc_id, pos, {strip('r')} AS title, TRY_CAST(num AS BIGINT) AS target_page, x FROM toc2 WHERE NOT contains(r, '..') AND left(r, 1) <> '.' AND right(r, 1) <> '.' AND {strip('r')} <> '' AND TRY_CAST(num AS BIGINT) IS NOT NULL)"""


@query(f"WITH {B.N}, {TOC_SQL} SELECT doc_id, title || ' (page ' || target_page || ')' AS line FROM toc")
def io6_toc_listing(s, d):
    return io.toc_listing(classify.extract_toc_entries(B.numbered(s, d), 1, 2))


@query(f"WITH {B.N} SELECT doc_id, '[type] ' || text || ' (page ' || page || ')' AS line FROM n WHERE type = 'heading'")
def io6_heading_listing(s, d):
    return io.heading_listing(B.numbered(s, d).withColumn("source", F.lit("type")))


# batches and page context


def batch_rows(s, d):
    """E with the page as the batch; every seventh batch failed."""
    return B.lines(s, d).withColumns({"batch_no": F.col("page"), "status": F.when(F.col("page") % 7 == 0, "failed").otherwise("completed")})


@query(f"WITH {B.E} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS id, page, pos, text FROM e WHERE page % 7 <> 0")
def m1_merge_batches(s, d):
    return batches.merge_batches(batch_rows(s, d)).select("doc_id", "id", "page", "pos", "text")


@query(f"""WITH {B.E}, b AS (SELECT doc_id, page AS batch_no, string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS pages FROM e WHERE page % 7 <> 0 GROUP BY ALL)
SELECT doc_id, string_agg(text, '' ORDER BY batch_no) AS text, string_agg(lower(text), '' ORDER BY batch_no) AS markdown, sum(pages)::BIGINT AS pages, 'v' || min(batch_no) AS api, 'm' || min(batch_no) AS model FROM b GROUP BY doc_id""")
def m2_merge_batch_content(s, d):
    b = batch_rows(s, d).groupBy("doc_id", "batch_no", "status").agg(batches.ordered_join(["pos"], "text", " ").alias("text"), F.count("*").alias("pages"))
    b = b.withColumns({"markdown": F.lower("text"), "api": F.concat(F.lit("v"), "batch_no"), "model": F.concat(F.lit("m"), "batch_no")})
    return batches.merge_batch_content(b)


@query(f"""WITH {B.E}, p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY id) AS page_content FROM e GROUP BY ALL)
SELECT doc_id, id, md5('id:' || id || ',' || chr(10) || 'page: ' || page || ',' || chr(10) || 'page_content: {{' || chr(10) || '"' || page_content || '"' || chr(10) || '}}') AS metadata_md5 FROM e JOIN p USING (doc_id, page)""")
def j1_page_context(s, d):
    out = batches.attach_page_context(B.lines(s, d).withColumn("content", F.col("text")))
    return out.select("doc_id", "id", F.md5("metadata").alias("metadata_md5"))


@query(f"WITH {B.E} SELECT doc_id, md5(' ' || string_agg(text, ' ' ORDER BY pos)) AS text_md5 FROM e GROUP BY doc_id")
def x1_document_text(s, d):
    return batches.document_text(B.lines(s, d)).select("doc_id", F.md5("text").alias("text_md5"))


# scalar functions

MIXED = "CASE WHEN pos % 3 = 0 THEN '' ELSE text END AS a, CASE WHEN pos % 4 = 0 THEN NULL ELSE lower(text) END AS b"


@query(f"WITH {B.E} SELECT doc_id, pos, coalesce(nullif(a, ''), nullif(b, ''), '') AS text_pref, coalesce(nullif(b, ''), nullif(a, ''), '') AS md_pref FROM (SELECT doc_id, pos, {MIXED} FROM e)")
def p1_content(s, d):
    e = B.lines(s, d).selectExpr("doc_id", "pos", *MIXED.replace("AS a,", "AS a|").split("| "))
    return e.select("doc_id", "pos", X.text_first(F.col("a"), F.col("b")).alias("text_pref"), X.markdown_first(F.col("a"), F.col("b")).alias("md_pref"))


@query(f"WITH {B.E} SELECT doc_id, pos, replace(replace(text, ' ', chr(92) || 'n'), chr(92) || 'n', chr(10)) AS text FROM e")
def p2_unescape_newlines(s, d):
    return B.lines(s, d).select("doc_id", "pos", X.unescape_newlines(F.replace("text", F.lit(" "), F.lit("\\n"))).alias("text"))


DOTTED = "replace(replace(text, ', ', ' · '), '. ', 'ㆍ')"


@query(f"WITH {B.E} SELECT doc_id, pos, {normal(DOTTED)} AS title FROM e")
def p3_normalize_title(s, d):
    return B.lines(s, d).select("doc_id", "pos", X.normalize_title(F.expr(DOTTED)).alias("title"))


@query(f"WITH {B.N}, {B.K}, u AS (SELECT doc_id, pos, {DOTTED} AS text FROM n UNION ALL SELECT doc_id, pos, replace(text, chr(10), ' ') FROM k) SELECT doc_id, pos, {clean('text')} AS title FROM u")
def p4_clean_title(s, d):
    u = B.numbered(s, d).select("doc_id", "pos", F.expr(DOTTED).alias("text")).unionByName(B.korean(s, d).select("doc_id", "pos", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")))
    return u.select("doc_id", "pos", X.clean_title(F.col("text")).alias("title"))


P5 = """SELECT doc_id, pos, coalesce(list_reduce(list_filter(list_transform(string_split(replace(replace(text, ',', '-'), 'a ', '∙ '), ' '), lambda t: trim(t)), lambda t: t <> ''), lambda acc, t: acc || CASE WHEN right(acc, 1) IN ('･', '·', 'ㆍ', '-', '.') THEN '' ELSE ' ' END || t), '') AS text FROM c"""


@query(f"WITH {B.C} {P5}")
def p5_assemble_line_text(s, d):
    marked = F.replace(F.replace("text", F.lit(","), F.lit("-")), F.lit("a "), F.lit("∙ "))
    return B.turns(s, d).select("doc_id", "pos", X.assemble_line_text(F.split(marked, " ")).alias("text"))


@query(f"WITH {B.G} SELECT doc_id, pos, round((x1 + x2 + x2 + x1) / 4, 6) AS cx, round((y1 + y1 + y2 + y2) / 4, 6) AS cy, x1, y1, x2, y2 FROM g")
def p6_geometry(s, d):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    g = B.geometry(s, d).select("doc_id", "pos", F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2")).alias("c"))
    g = g.select("doc_id", "pos", X.polygon_center(F.col("c")).alias("m"), X.polygon_box(F.col("c")).alias("b"))
    return g.select("doc_id", "pos", F.round("m.x", 6).alias("cx"), F.round("m.y", 6).alias("cy"), "b.x1", "b.y1", "b.x2", "b.y2")


@query(f"WITH {B.G}, p AS (SELECT doc_id, page, max(x2) AS w, max(y2) AS h FROM g GROUP BY ALL) SELECT doc_id, pos, round(y1 / h, 6) AS y_rel_top, round(y2 / h, 6) AS y_rel_bottom, round(x1 / w, 6) AS x_rel_left, round(x2 / w, 6) AS x_rel_right, round(CASE WHEN x2 > x1 THEN (y2 - y1) / (x2 - x1) ELSE 0 END, 4) AS aspect FROM g JOIN p USING (doc_id, page)")
def p7_relative_position(s, d):
    g = B.geometry(s, d)
    pages = g.groupBy("doc_id", "page").agg(F.max("x2").alias("width"), F.max("y2").alias("height"))
    return classify.relative_position(g, pages).select("doc_id", "pos", *[F.round(c, 6).alias(c) for c in ("y_rel_top", "y_rel_bottom", "x_rel_left", "x_rel_right")], F.round("aspect", 4).alias("aspect"))


def title_words(x: str) -> str:
    """A list of the words of a title."""
    marks, p, m = "[-･·ㆍ]", f"regexp_split_to_array({x}, '[-･·ㆍ]')", f"regexp_extract_all({x}, '[-･·ㆍ]')"
    pair = f"CASE WHEN 2 * k + 2 <= len({p}) THEN {p}[2 * k + 1] || {m}[2 * k + 1] || {p}[2 * k + 2] ELSE {strip(f'{p}[2 * k + 1]')} END"
    return f"list_filter(list_transform(range((len({p}) + 1) // 2), lambda k: {pair}), lambda w: w <> '' AND NOT regexp_full_match(w, '{marks}'))"


@query(f"WITH {B.E} SELECT doc_id, pos, array_to_string({title_words('tx')}, '|') AS words FROM (SELECT doc_id, pos, regexp_replace(text, 'a |,+', '-', 'g') AS tx FROM e)")
def p8_split_title_words(s, d):
    return B.lines(s, d).select("doc_id", "pos", F.array_join(X.split_title_words(F.regexp_replace("text", r"a |,+", "-")), "|").alias("words"))


@query(rf"WITH {B.K} SELECT doc_id, pos, nullif(regexp_extract(text, {quoted(X.CITATION)}), '') AS law_reference, nullif(regexp_extract(text, {quoted(X.EFFECTIVE)}), '') AS application_date FROM k")
def p9_references(s, d):
    return B.korean(s, d).select("doc_id", "pos", X.first_law_reference(F.col("text")).alias("law_reference"), X.first_application_date(F.col("text")).alias("application_date"))


@query(f"WITH {B.N} SELECT doc_id, pos, {COMPLETE('text')} AS complete FROM n")
def p10_complete_sentence(s, d):
    return B.numbered(s, d).select("doc_id", "pos", X.is_complete_sentence(F.col("text")).alias("complete"))


# classification


@query(f"WITH {B.N}, {TOC_SQL} SELECT doc_id, pos, title, target_page, x FROM toc")
def c1_toc_entries(s, d):
    return classify.extract_toc_entries(B.numbered(s, d), 1, 2).select("doc_id", "pos", "title", "target_page", "x")


def potential(t: str, x: str) -> str:
    forms = " OR ".join(f"regexp_matches({strip(t)}, {quoted(p)})" for p in classify.TITLE_FORMS)
    return rf"(length({strip(t)}) <= 200 AND NOT regexp_matches({strip(t)}, '^[0-9\s.\-=><()]+$') AND coalesce({x}, 0) <= 0.5 AND ({forms}))"


@query(f"WITH {B.G} SELECT doc_id, pos, {potential('text', 'x1')} AS potential FROM g")
def c2_potential_title(s, d):
    return B.geometry(s, d).select("doc_id", "pos", classify.is_potential_title(F.col("text"), F.col("x1")).alias("potential"))


def toc_of_geometry(s, d):
    """A table of contents for G: its numbered lines beyond page 1, named with their pages."""
    return B.geometry(s, d).filter("page > 1 and pos % 12 = 0 and pos < 1000000").select("doc_id", F.col("page").alias("target_page"), F.concat(F.when(F.col("pos") % 24 == 12, "07. ").otherwise(""), "text").alias("title"), (F.col("x1") + F.when(F.col("pos") % 24 == 0, 0.05).otherwise(0.2)).alias("x"))


GT = B.G + ", gt AS (SELECT doc_id, page AS target_page, CASE WHEN pos % 24 = 12 THEN '07. ' ELSE '' END || text AS title, x1 + CASE WHEN pos % 24 = 0 THEN 0.05::DOUBLE ELSE 0.2::DOUBLE END AS x FROM g WHERE page > 1 AND pos % 12 = 0 AND pos < 1000000)"
GM = rf"EXISTS (SELECT 1 FROM gt WHERE gt.doc_id = g.doc_id AND gt.target_page = g.page AND contains(lower({squeeze('g.text')}), lower(coalesce(nullif(regexp_replace({squeeze('gt.title')}, '^[-\s>]*([0-9][0-9]\.|\([0-9]+\)|[IVX]+\.|[A-Z]\.)\s*', ''), ''), {squeeze('gt.title')}))) AND (abs(g.x1 - gt.x) < 0.1 OR gt.x IS NULL))"


@query(f"WITH {GT} SELECT doc_id, pos, text FROM g WHERE {GM}")
def j4_toc_headings(s, d):
    return match.match_toc_headings(B.geometry(s, d), toc_of_geometry(s, d)).select("doc_id", "pos", "text")


@query(f"""WITH {GT}, m AS (SELECT *, {GM} AS hit, {potential('text', 'x1')} AS pot, CASE WHEN pos % 11 = 0 THEN 'heading2' ELSE '' END AS category FROM g)
SELECT doc_id, pos, CASE WHEN length(trim(text)) < 3 THEN 'unknown' WHEN page BETWEEN 1 AND 1 THEN CASE WHEN pot THEN 'heading' ELSE 'toc' END WHEN hit OR category LIKE 'heading%' THEN 'heading' ELSE 'paragraph' END AS type,
 CASE WHEN length(trim(text)) < 3 THEN NULL WHEN page BETWEEN 1 AND 1 THEN CASE WHEN pot THEN 'toc_page' END WHEN hit THEN 'toc_match' WHEN category LIKE 'heading%' THEN 'category' END AS source FROM m""")
def c3_classify_elements(s, d):
    g = B.geometry(s, d).withColumn("category", F.when(F.col("pos") % 11 == 0, "heading2").otherwise(""))
    hits = match.match_toc_headings(g, toc_of_geometry(s, d)).select("doc_id", "pos").withColumn("hit", F.lit(True))
    own = g.join(hits, ["doc_id", "pos"], "left")
    return classify.classify_elements(own, F.coalesce("hit", F.lit(False)), 1, 1).select("doc_id", "pos", "type", "source")


HF = "CASE WHEN h > 0 THEN CASE WHEN y2 <= h * 0.1::DOUBLE THEN 'header' WHEN y1 >= h * (1 - 0.1::DOUBLE) THEN 'footer' END END"


@query(f"WITH {B.G} SELECT doc_id, pos, {HF} AS category FROM (SELECT *, max(y2) OVER (PARTITION BY doc_id, page) AS h FROM g)")
def c4_header_footer(s, d):
    return classify.label_header_footer(B.geometry(s, d).withColumn("category", F.lit(None).cast("string"))).select("doc_id", "pos", "category")


def ladder(lines: str, titles: str) -> str:
    """hits(doc_id, pos, title_no, rung) of lines(doc_id, pos, k) and titles(title_no, k), where k is the cleaned text in lower case: every pair, by each rung."""
    page = r"'\s*[.·･]{2,}\s*\d+\s*$'"
    keys = lambda t: f"SELECT *, regexp_replace(k2, '^(?:\\d+\\.)?\\s*', '') AS k3 FROM (SELECT *, regexp_replace(k, {page}, '') AS k2 FROM {t} WHERE k <> '')"
    return f"""lk AS (SELECT *, {title_words('k3')} AS ws FROM ({keys(lines)})), tk AS (SELECT *, list_filter(ws, lambda w: length(w) > 1) AS main FROM (SELECT *, {title_words('k3')} AS ws FROM ({keys(titles)}))),
    pairs AS (SELECT lk.doc_id, lk.pos, tk.title_no, CASE WHEN lk.k = tk.k THEN 1 WHEN lk.k2 = tk.k2 THEN 2 WHEN lk.k3 = tk.k3 THEN 3 ELSE 4 END AS rung FROM lk JOIN tk ON lk.k = tk.k OR lk.k2 = tk.k2 OR lk.k3 = tk.k3
     OR (len(tk.ws) > 1 AND len(main) > 0 AND len(list_filter(main, lambda w: len(list_filter(lk.ws, lambda t: contains(t, w))) > 0)) >= len(main) * 0.7::DOUBLE)),
    hits AS (SELECT doc_id, pos, min(title_no) AS title_no, min_by(rung, title_no) AS rung FROM pairs GROUP BY doc_id, pos)"""


#: Commas and a common word become marks, so that titles have words; some lines say more than their title.
MARKED = "regexp_replace(text, ', | of ', '-', 'g')"
G5 = B.G.replace("g AS (", "g_ AS (") + f", g AS (SELECT * REPLACE ({MARKED} AS text) FROM g_)"
T5 = B.T.replace("t AS (", "t_ AS (") + f", t AS (SELECT title_no, {MARKED.replace('text', 'title')} AS title FROM t_)"


def marked(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, F.regexp_replace(text, ", | of ", "-"))


@query(f"""WITH {G5}, {T5}, kt AS (SELECT lower({clean(strip('title'))}) AS key, min(title_no) AS title_no, max_by(title, title_no) AS original_title FROM t WHERE {strip('title')} <> '' GROUP BY 1),
gg AS (SELECT *, {HF} AS cat FROM (SELECT *, max(y2) OVER (PARTITION BY doc_id, page) AS h FROM g)), l AS (SELECT doc_id, pos, lower({clean(f"lower({clean(strip('text'))})")}) AS k FROM gg WHERE cat IS NULL), tl AS (SELECT title_no, lower({clean('key')}) AS k FROM kt), {ladder('l', 'tl')}
SELECT gg.doc_id, gg.pos, CASE WHEN original_title IS NOT NULL THEN 'heading1' ELSE coalesce(cat, 'paragraph') END AS category, original_title FROM gg LEFT JOIN (hits JOIN kt USING (title_no)) x ON gg.doc_id = x.doc_id AND gg.pos = x.pos""")
def c5_titles_paragraphs(s, d):
    g = classify.label_header_footer(marked(B.geometry(s, d), "text").withColumn("category", F.lit(None).cast("string")))
    return classify.label_titles_and_paragraphs(g, marked(B.titles(s, d), "title")).select("doc_id", "pos", "category", "original_title")


@query(f"""WITH {B.G}, {B.T}, kt AS (SELECT DISTINCT lower({clean('title')}) AS key FROM t)
SELECT doc_id, pos, CASE WHEN y2 <= 0.1 THEN 'header' WHEN y1 >= 1 - 0.1::DOUBLE THEN 'footer' WHEN kt.key <> '' THEN 'heading1' ELSE 'paragraph' END AS category FROM g LEFT JOIN kt ON lower({clean('text')}) = kt.key WHERE trim(text) <> ''""")
def c6_categorize_spans(s, d):
    return classify.categorize_spans(B.geometry(s, d), B.titles(s, d)).select("doc_id", "pos", "category")


TB = r"""CASE WHEN length(trim(text)) > 150 THEN false WHEN regexp_matches(trim(text), '^[0-9]+[.\s]') THEN length(trim(text)) <= 100 WHEN regexp_matches(trim(text), '^제\d+[장절]') THEN true WHEN size > body * 1.5 THEN length(trim(text)) <= 70
 ELSE (contains(lower(font), 'bold') AND length(trim(text)) < 50 AND size > body * 1.1::DOUBLE) OR (trim(text) = upper(trim(text)) AND regexp_matches(trim(text), '\p{Lu}') AND length(trim(text)) < 25) END"""
BODY = "bs AS (SELECT doc_id, size AS body FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, size) AS k FROM g GROUP BY doc_id, size) WHERE k = 1)"


def with_titles(s, d):
    g = B.geometry(s, d)
    body = stats.font_statistics(g).select("doc_id", "body_size")
    return g.join(body, "doc_id").withColumn("is_title", classify.is_title_block(F.col("text"), F.col("size"), F.col("font"), F.col("body_size")))


@query(f"WITH {B.G}, {BODY} SELECT doc_id, pos, {TB} AS is_title FROM g JOIN bs USING (doc_id)")
def c7_title_blocks(s, d):
    return with_titles(s, d).select("doc_id", "pos", "is_title")


PN = r"(length(text) <= 5 AND regexp_full_match(replace(text, '.', ''), '\d+') AND ((x1 < 0.15 AND y2 > 0.85) OR (x2 > 0.85 AND y2 > 0.85) OR (x2 > 0.85 AND y1 < 0.15)))"
RB = """rb0 AS (SELECT *, 'top' AS side, y1 AS y_rel, round(y1, 2) AS y FROM g WHERE y1 < 0.1::DOUBLE UNION ALL SELECT *, 'bottom', y2, round(y2, 2) FROM g WHERE y2 > 0.9::DOUBLE),
rb1 AS (SELECT doc_id, side, y, count(DISTINCT page) AS pages FROM rb0 GROUP BY ALL HAVING count(DISTINCT page) >= 3),
rb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, side, y, page ORDER BY pos) AS k FROM rb0 JOIN rb1 USING (doc_id, side, y)) WHERE k = 1)"""
NEAR = lambda side, y, within: f"({within} AND EXISTS (SELECT 1 FROM rb WHERE rb.doc_id = g.doc_id AND rb.side = '{side}' AND abs(g.{y} - rb.y_rel) < 0.02))"
TOP, LOW = NEAR("top", "y1", "g.y1 < 0.1::DOUBLE"), NEAR("bottom", "y2", "g.y2 > 0.9::DOUBLE")
DEMOTED = r"""((length(text) > 100 OR length(text) - length(replace(text, '.', '')) > 3) AND NOT regexp_matches(text, '^(제\d+[장절]|\d+[.\s])') OR ((contains(text, '(') AND contains(text, ')')) OR contains(text, ':')) AND length(text) > 80)"""


@query(rf"""WITH {B.G}, {BODY}, {RB} SELECT doc_id, pos, CASE WHEN is_title THEN CASE WHEN {DEMOTED} THEN 'body' ELSE 'title' END WHEN x2 > x1 AND (y2 - y1) / (x2 - x1) > 3 AND x2 - x1 < 0.15 THEN 'index' WHEN {PN} THEN 'page_number'
 WHEN top THEN 'header' WHEN low THEN 'footer' WHEN regexp_matches(text, '^\d+\..*\d+$') THEN 'index' ELSE 'body' END AS block_type
FROM (SELECT g.*, {TB} AS is_title, {TOP} AS top, {LOW} AS low FROM g JOIN bs ON g.doc_id = bs.doc_id)""")
def c8_classify_blocks(s, d):
    g = with_titles(s, d)
    hits = match.match_repeating_bands(g, stats.repeating_blocks(B.geometry(s, d))).groupBy("doc_id", "pos").agg(*[F.max(F.col("side") == side).alias(side) for side in ("top", "bottom")])
    own = g.join(hits, ["doc_id", "pos"], "left")
    return classify.classify_blocks(own, *[F.coalesce(side, F.lit(False)) for side in ("top", "bottom")]).select("doc_id", "pos", "block_type")


@query(f"WITH {B.G} SELECT doc_id, pos, text FROM g WHERE {PN}")
def c9_page_numbers(s, d):
    return B.geometry(s, d).filter(classify.is_page_number(*(F.col(c) for c in ("text", "x1", "y1", "x2", "y2")))).select("doc_id", "pos", "text")


SCORES = ", ".join(f"2 * ({' + '.join(count('text', p) for p in ps)}) AS s{i}" for i, ps in enumerate(P.TYPES.values()))
BEST = f"greatest({', '.join(f's{i}' for i in range(len(P.TYPES)))})"


@query(f"WITH {KD} SELECT doc_id, CASE WHEN b < 3 THEN '{P.OTHER_TYPE}' " + " ".join(f"WHEN s{i} = b THEN '{t}'" for i, t in enumerate(P.TYPES)) + f" END AS doc_type, b AS score FROM (SELECT *, {BEST} AS b FROM (SELECT doc_id, {SCORES} FROM kd))")
def c10_document_type(s, d):
    return P.detect_document_type(k_docs(s, d))


@query(rf"""WITH {B.N}, {B.K}, u AS (SELECT doc_id, pos, text FROM n UNION ALL SELECT -1 - doc_id, pos, text FROM k), w AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM u)
SELECT doc_id, pos, (p IS NOT NULL AND (regexp_matches(text, '^\((?:{X.ACTS})(?:법|령)\s+제\d+조') OR starts_with(text, '적용시기') OR starts_with(text, '<적용시기') OR regexp_matches(regexp_replace(p, '\s+$', ''), '(?:다만|그러나|하지만|또한|,|\.|:)$')
 OR coalesce(TRY_CAST(nullif(regexp_extract(text, '^\s*(\d{{1,15}})\.\s+', 1), '') AS BIGINT) = TRY_CAST(nullif(regexp_extract(p, '^\s*(\d{{1,15}})\.\s+', 1), '') AS BIGINT) + 1, false)
 OR coalesce(unicode(nullif(regexp_extract(text, '^\s*([가-힣])\.\s+', 1), '')) = unicode(nullif(regexp_extract(p, '^\s*([가-힣])\.\s+', 1), '')) + 1, false))) AS continues FROM w""")
def c11_continuations(s, d):
    u = B.numbered(s, d).select("doc_id", "pos", "text").unionByName(B.korean(s, d).select((F.lit(-1) - F.col("doc_id")).alias("doc_id"), "pos", "text"))
    return classify.flag_continuations(u).select("doc_id", "pos", "continues")


# matching

TITLED = r"CASE WHEN doc_id % 2 = 1 THEN '07 ' || text ELSE text END"


def titled(s, d):
    return B.lines(s, d).select("doc_id", "pos", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("07 "), "text")).otherwise(F.col("text")).alias("text"))


E5 = B.E.replace("e AS (", "e_ AS (") + f", e AS (SELECT doc_id, pos, {MARKED} || CASE WHEN pos % 3 = 1 THEN '-and more' ELSE '' END AS text FROM e_)"


@query(f"WITH {E5}, {T5.replace('FROM e WHERE', 'FROM e_ WHERE')}, l AS (SELECT doc_id, pos, lower({clean('text')}) AS k FROM e), tl AS (SELECT title_no, lower({clean('title')}) AS k FROM t), {ladder('l', 'tl')} SELECT doc_id, pos, title_no, rung FROM hits")
def j2_titles_fuzzy(s, d):
    more = marked(B.lines(s, d), "text").withColumn("text", F.concat("text", F.when(F.col("pos") % 3 == 1, "-and more").otherwise("")))
    return match.match_titles_fuzzy(more.select("doc_id", "pos", "text"), marked(B.titles(s, d), "title")).filter("title_no is not null").select("doc_id", "pos", "title_no", "rung")


BARE = lambda x: rf"regexp_replace({x}, '^0?\d{{1,2}}\s+', '')"
JT = f"""u AS (SELECT doc_id, pos, {TITLED} AS text FROM e), ta AS (SELECT key, min(title_no) AS no, max_by(title, title_no) AS title FROM (SELECT {normal('title')} AS key, title_no, title FROM t) WHERE key <> '' GROUP BY key), tb AS (SELECT {BARE('key')} AS key, min(no) AS no, min_by(title, no) AS title FROM ta GROUP BY 1),
j AS (SELECT u.*, coalesce(ta.no, tb.no) AS title_no, CASE WHEN ta.no IS NOT NULL THEN ta.title ELSE tb.title END AS title FROM u LEFT JOIN ta ON {normal('u.text')} = ta.key LEFT JOIN tb ON {BARE(normal('u.text'))} = tb.key)"""


@query(f"WITH {B.E}, {B.T}, {JT} SELECT doc_id, pos, title_no, title FROM j WHERE title_no IS NOT NULL")
def j3_titles_exact(s, d):
    return match.match_titles_exact(titled(s, d), B.titles(s, d)).filter("title_no is not null").select("doc_id", "pos", "title_no", "title")


@query(f"WITH {B.G}, {RB} SELECT doc_id, pos, 'top' AS side FROM g WHERE {TOP} UNION ALL SELECT doc_id, pos, 'bottom' FROM g WHERE {LOW}")
def j5_repeating_bands(s, d):
    g = B.geometry(s, d)
    return match.match_repeating_bands(g, stats.repeating_blocks(g)).select("doc_id", "pos", "side")


# statistics


@query(f"WITH {B.H} SELECT doc_id, coalesce(category, 'unknown') AS label, count(*) AS n FROM h GROUP BY ALL")
def s1_count_by_label(s, d):
    return stats.count_by_label(B.page_elements(s, d), "category")


@query(f"WITH {B.E} SELECT doc_id, page, count(*) AS n FROM e GROUP BY ALL")
def s2_elements_per_page(s, d):
    return stats.elements_per_page(B.lines(s, d))


@query(f"WITH {B.E} SELECT doc_id, count(*) AS total_elements, max(page) AS total_pages, round(avg(length(text)), 6) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length FROM e GROUP BY doc_id")
def s3_basic_statistics(s, d):
    return stats.basic_statistics(B.lines(s, d))


@query(f"WITH {B.E} SELECT doc_id, page, sum({count('text', stats.WORD)})::BIGINT AS words FROM e GROUP BY ALL")
def s4_page_word_counts(s, d):
    return stats.page_word_counts(B.lines(s, d))


@query(f"WITH {B.E} SELECT doc_id, sum(length(text) + 1)::BIGINT AS total_chars, sum({count('text', stats.WORD)})::BIGINT AS total_words FROM e GROUP BY doc_id")
def s5_content_totals(s, d):
    return stats.content_totals(B.lines(s, d))


@query(f"WITH {B.G} SELECT doc_id, page, count(*) AS n, round(avg((x1 + x2) / 2), 8) AS x_mean, round(avg((y1 + y2) / 2), 8) AS y_mean, round(stddev_pop((x1 + x2) / 2), 8) AS x_std, round(stddev_pop((y1 + y2) / 2), 8) AS y_std FROM g GROUP BY ALL")
def s6_layout_statistics(s, d):
    return stats.layout_statistics(B.geometry(s, d))


SEC = "SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM {}"


@query(f"WITH {B.E}, s AS ({SEC.format('e')}) SELECT doc_id, section::BIGINT AS section, min_by(text, pos) AS title, min_by(page, pos) AS page, count(*) - 1 AS length FROM s WHERE section > 0 GROUP BY doc_id, section")
def s7_section_lengths(s, d):
    return stats.section_lengths(B.lines(s, d))


@query(f"""WITH {B.H}, s AS ({SEC.replace("type = 'heading'", "category = 'heading1'").format('h')}) SELECT doc_id, section::BIGINT AS section, min_by(text, pos) AS title, count(*) - 1 AS elements, count_if(category LIKE 'paragraph%') AS paragraphs, count_if(category LIKE 'table%') AS tables, count_if(category LIKE 'image%') AS images,
 count_if(category LIKE 'list%') AS lists, min_by(page, pos) AS first_page, max(page) AS last_page FROM s WHERE section > 0 GROUP BY doc_id, section""")
def s8_section_contents(s, d):
    """The binding's elements get their type from their tag."""
    kind = F.when(F.col("category") == "heading1", "heading").when(F.col("category") == "paragraph", "paragraph")
    return stats.section_contents(B.page_elements(s, d).withColumn("type", kind))


@query(f"""WITH {B.G}, c AS (SELECT doc_id, size, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, size) AS k FROM g GROUP BY doc_id, size), b AS (SELECT doc_id, size AS body FROM c WHERE k = 1),
o AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM g)
SELECT doc_id, round(avg(size), 6) AS mean_size, max(CASE WHEN i = n // 2 THEN size END) AS median_size, min(size) AS min_size, max(size) AS max_size, any_value(body) AS body_size,
 coalesce((SELECT string_agg(round(c.size, 1)::VARCHAR, ',' ORDER BY c.k) FROM c WHERE c.doc_id = o.doc_id AND c.k IN (2, 3) AND c.size > any_value(body)), '') AS title_sizes FROM o JOIN b USING (doc_id) GROUP BY o.doc_id, doc_id""")
def s9_font_statistics(s, d):
    return stats.font_statistics(B.geometry(s, d))


#: Spark's names of types, as SQL has them.
SQL_TYPES = {"int": "integer", "string": "varchar", "array<float>": "float[]", "array<double>": "double[]", "timestamp_ntz": "timestamp"}
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS \"column\", lower(any_value(typeof({c}))) AS type, count_if({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, count(*) AS rows FROM {t}" for t, cs in COLUMNS.items() for c in cs.split()))
def s10_column_profile(s, d):
    out = None
    for t in COLUMNS:
        own = stats.column_profile(B.table(s, d, t), exact=True).withColumn("table_name", F.lit(t))
        out = own if out is None else out.unionByName(own)
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in SQL_TYPES.items() for x in kv])[F.col("type")], F.col("type"))
    return out.select("table_name", "column", kind.alias("type"), "nulls", "distinct_values", "rows")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS \"column\", count_if({c} IS NULL) AS nulls, CASE WHEN count(DISTINCT {c}) <= 1000 THEN count(DISTINCT {c}) END AS distinct_values, count(*) AS rows FROM {t}" for t, cs in COLUMNS.items() for c in cs.split()))
def s10_column_sketches(s, d):
    """Two scans a table; distinct values where they are few."""
    out = None
    for t in COLUMNS:
        own = stats.column_profile(B.table(s, d, t)).withColumn("table_name", F.lit(t))
        out = own if out is None else out.unionByName(own)
    return out.select("table_name", "column", "nulls", F.when(F.col("exact"), F.col("distinct_values")).alias("distinct_values"), "rows")


@query(f"WITH {B.G}, {RB} SELECT doc_id, side, y, page, pos, pages, y_rel FROM rb")
def s11_repeating_blocks(s, d):
    return stats.repeating_blocks(B.geometry(s, d)).select("doc_id", "side", "y", "page", "pos", "pages", "y_rel")


# patterns


#: Written apart from the Spark side's patterns. There is no look-around here: boundary characters are doubled, or a blank put in, so that a match that takes one leaves another for the next.
BY_HAND = {
    "year": {"year": ("text", r"(19|20)[0-9]{2}\s*년", 0), "digits": (r"regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g')", r"(?:^|[^\p{L}\p{N}_])([0-9]{4}년)(?:[^\p{L}\p{N}_]|$)", 1)},
    "amount": {u: ("text", r"[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?\s*" + u, 0) for u in ("원", "만원", "억원", "조원", "천원")},
    "general": {"general": ("text", r"[0-9]+(,[0-9]{3})*(\.[0-9]+)?\s*(원|만원|억원|천원)", 0)},
    "date": {
        "ymd": ("text", r"(19|20)[0-9]{2}\s*년\s*[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일", 0),
        "ym": ("text", r"((?:19|20)[0-9]{2}\s*년\s*[0-9]{1,2}\s*월)(?:[^0-9]|$)", 1),
        "md": ("replace(text, '일', '일 ')", r"(?:^|[^0-9])([0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일)", 1),
        "period": ("text", r"(19|20)[0-9]{2}\s*년\s*[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일\s*(~|부터|까지)\s*(19|20)[0-9]{2}\s*년\s*[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일", 0),
    },
}


def matches_sql(family: str, docs: str = "kd") -> str:
    pack = BY_HAND.get(family) or {k: ("text", *v) for k, v in P.PACKS[family].items()}
    return " UNION ALL ".join(f"SELECT doc_id, '{family}' AS family, '{k}' AS kind, unnest(range(len(v))) AS seq, unnest(v) AS value FROM (SELECT doc_id, regexp_extract_all({x}, {quoted(p)}, {g}) AS v FROM {docs})" for k, (x, p, g) in pack.items())


@query(f"WITH {KD} {' UNION ALL '.join(matches_sql(f) for f in ('year', 'law', 'percent'))}")
def x2_extract_patterns(s, d):
    return P.extract_patterns(k_docs(s, d), ["year", "law", "percent"]).withColumn("seq", F.col("seq").cast("long"))


@query(f"WITH {KD}, m AS ({matches_sql('year')}) SELECT doc_id, kind, value, count(*) AS n FROM m GROUP BY ALL")
def x3_year_mentions(s, d):
    return P.year_mentions(k_docs(s, d))


@query(f"WITH {KD}, m AS ({matches_sql('amount')}), o AS ({matches_sql('general')}) SELECT doc_id, kind, seq, value FROM m UNION ALL SELECT doc_id, kind, seq, value FROM o WHERE seq < 20")
def x4_financial_amounts(s, d):
    return P.financial_amounts(k_docs(s, d)).withColumn("seq", F.col("seq").cast("long"))


def distinct_query(name: str, family: str, docs_sql: str, docs: Callable) -> None:
    @query(f"WITH {docs_sql}, m AS ({matches_sql(family)}) SELECT DISTINCT doc_id, family, kind, value FROM m")
    def f(s, d):
        return P.distinct_values(P.extract_patterns(docs(s, d), family))

    Q[name], SQL[name] = Q.pop("f"), SQL.pop("f")


distinct_query("x5_legal_references", "law", KD, k_docs)
distinct_query("x6_date_expressions", "date", KD, k_docs)
distinct_query("x8_contacts", "contact", "kd AS (SELECT doc_id, text FROM documents)", lambda s, d: B.table(s, d, "documents").select("doc_id", "text"))
distinct_query("x9_organizations", "organization", KD, k_docs)


@query(f"WITH {KD}, m AS ({matches_sql('percent')}) SELECT doc_id, seq, value FROM m")
def x7_percentages(s, d):
    return P.extract_patterns(k_docs(s, d), "percent").select("doc_id", F.col("seq").cast("long").alias("seq"), "value")


BULLET = " ".join(f"WHEN regexp_matches(tx, {quoted(p)}) THEN '{k}'" for k, p in P.BULLETS.items())


@query(f"""WITH {B.K}, l AS (SELECT doc_id, pos, line, trim(tx) AS tx FROM (SELECT doc_id, pos, unnest(range(len(a))) AS line, unnest(a) AS tx FROM (SELECT doc_id, pos, string_split(text, chr(10)) AS a FROM k)))
SELECT * FROM (SELECT doc_id, pos, line, CASE {BULLET} END AS kind, trim(regexp_replace(tx, {quoted('|'.join(P.BULLETS.values()))}, '')) AS content FROM l) WHERE kind IS NOT NULL AND content <> ''""")
def x10_bullet_points(s, d):
    return P.bullet_points(B.korean(s, d)).withColumn("line", F.col("line").cast("long"))


REFS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(text, {quoted(p)}, {g}) AS v FROM kd" for k, (p, g) in P.PACKS["reference"].items())


@query(f"WITH {KL}, r AS ({REFS}) SELECT * FROM (SELECT doc_id, kind, len(v) AS n, array_to_string(v[1:5], '|') AS examples, (sum(len(v)) OVER (PARTITION BY doc_id))::BIGINT AS total FROM r) WHERE n > 0")
def x11_reference_counts(s, d):
    return P.reference_counts(k_docs(s, d, "\n")).withColumn("n", F.col("n").cast("long"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 20")
def x12_top_words(s, d):
    return P.top_words(B.table(s, d, "documents"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 20")
def x12_heavy_words(s, d):
    return P.heavy_words(B.table(s, d, "documents"))


@query("SELECT doc_id, word, n, rank FROM (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, word) AS rank FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS word FROM documents) GROUP BY doc_id, word) WHERE rank <= 20")
def x12_top_words_by_document(s, d):
    return P.top_words_by_document(B.table(s, d, "documents"))


def spots_sql(pack: dict[str, list[str]], docs: str, flags: str = "") -> str:
    """Matches with offsets: a match starts where the gaps up to it and the matches before it end."""
    one = "SELECT doc_id, '{f}' AS family, {n} AS pattern_no, regexp_extract_all(text, {p}) AS m, regexp_split_to_array(text, {p}) AS gap FROM {docs}"
    found = " UNION ALL ".join(one.format(f=f, n=n, p=quoted(flags + p), docs=docs) for f, ps in pack.items() for n, p in enumerate(ps))
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)::INT"
    rows = f"SELECT doc_id, family, pattern_no, unnest(list_transform(range(len(m)), lambda k: {{'k': k, 'text': m[k + 1], 'start': {size('gap[1:k + 1]')} + {size('m[1:k]')}}})) AS u FROM ({found})"
    return f'SELECT doc_id, family, pattern_no, u.k::INT AS seq, u.text, u.start, u.start + length(u.text)::INT AS "end" FROM ({rows})'


@query(f"WITH {KL} {spots_sql(P.ELEMENTS, 'kd')}")
def x13_extract_elements(s, d):
    return offsets.extract_elements(k_docs(s, d, "\n"))


MORE = "상품 안내\n금리 안내\n계약 기간\n부 칙\n제1조 (당사자)"
TYPED = f"kt AS (SELECT doc_id, text || chr(10) || '{MORE}' AS text FROM kd), ty AS (SELECT *, {BEST} AS b FROM (SELECT doc_id, text, {SCORES} FROM kt)), tt AS MATERIALIZED (SELECT doc_id, text, CASE WHEN b < 3 THEN '{P.OTHER_TYPE}' " + " ".join(f"WHEN s{i} = b THEN '{t}'" for i, t in enumerate(P.TYPES)) + " END AS doc_type FROM ty)"


@query(f"WITH {KL}, {TYPED} " + " UNION ALL ".join(f"({spots_sql(pack, f'(SELECT * FROM tt WHERE doc_type = {quoted(t)})', '(?m)')})" for t, pack in P.SECTIONS.items()))
def x14_detect_sections(s, d):
    docs = k_docs(s, d, "\n").withColumn("text", F.concat("text", F.lit("\n" + MORE)))
    return offsets.detect_sections(docs, P.detect_document_type(docs))


# sequences


@query(f"""WITH {B.E}, {B.T}, {JT}, s AS (SELECT *, count(title_no) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM j), a AS (SELECT doc_id, section, min_by(text, pos) AS text, min(pos) + 1 AS line_number, min_by(title, pos) AS title, coalesce(string_agg(CASE WHEN title_no IS NULL THEN text END, chr(10) ORDER BY pos), '') AS content FROM s WHERE section > 0 GROUP BY doc_id, section)
SELECT doc_id, section, a.text, title AS original_title, line_number, content, nullif(regexp_extract(a.text, {quoted(X.CITATION)}), '') AS law_reference, nullif(regexp_extract(a.text, {quoted(X.EFFECTIVE)}), '') AS application_date,
 count(*) OVER (PARTITION BY doc_id) AS total_count FROM a""")
def t1_sections_by_title(s, d):
    return sequence.sectionize_by_title(titled(s, d), B.titles(s, d))


LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(text, {quoted(p)}) THEN {n}" for p, n in classify.LEVELS) + " ELSE 1 END"
NH = f"nh AS (SELECT *, least({LEVEL}, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC)) AS level FROM n WHERE type = 'heading')"
def tree(headings: str) -> str:
    """tr: headings(doc_id, id, page, y, level, ...) with parent_id, depth and path, by recursion from the roots."""
    return f"""no AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, id) AS rn FROM {headings}),
    up AS (SELECT a.doc_id, a.rn, max(b.rn) AS prn FROM no a LEFT JOIN no b ON a.doc_id = b.doc_id AND b.rn < a.rn AND b.level < a.level GROUP BY ALL),
    st AS (SELECT no.*, prn FROM no JOIN up USING (doc_id, rn)), tr AS (SELECT *, NULL::BIGINT AS parent_id, 0 AS depth, id::VARCHAR AS path FROM st WHERE prn IS NULL
     UNION ALL SELECT st.*, tr.id, tr.depth + 1, tr.path || '/' || st.id FROM st JOIN tr ON st.doc_id = tr.doc_id AND st.prn = tr.rn)"""


DEEPER = "level + pos % 4 * (pos % 3)"


def n_headings(s, d):
    return sequence.heading_levels(sequence.select_headings(B.numbered(s, d)))


@query(f"WITH RECURSIVE {B.N}, {NH}, dh AS (SELECT * REPLACE ({DEEPER} AS level) FROM nh), {tree('dh')} SELECT doc_id, id, level::INT AS level, parent_id, depth, path FROM tr")
def t2_heading_hierarchy(s, d):
    """Levels up to 10."""
    return sequence.heading_hierarchy(n_headings(s, d).withColumn("level", F.expr(DEEPER).cast("int"))).select("doc_id", "id", "level", "parent_id", "depth", "path")


FORMS = "(" + " OR ".join(f"regexp_matches(text, {quoted(p)})" for p in classify.HEADING_FORMS) + ")"


@query(f"""WITH {B.N}, {B.H}, u AS (SELECT doc_id, pos, text, NULL AS category, CASE WHEN doc_id % 2 = 0 THEN type END AS type FROM n UNION ALL SELECT -1 - doc_id, pos, text, category, NULL FROM h),
f AS (SELECT *, coalesce(type = 'heading', false) AS a, coalesce(category LIKE 'heading%', false) AS b, {FORMS} AS p FROM u), w AS (SELECT *, bool_or(a) OVER (PARTITION BY doc_id) AS aa, bool_or(b) OVER (PARTITION BY doc_id) AS bb FROM f)
SELECT doc_id, pos, CASE WHEN aa THEN 'type' WHEN bb THEN 'category' ELSE 'pattern' END AS tier FROM w WHERE CASE WHEN aa THEN a WHEN bb THEN b ELSE p END""")
def t3_select_headings(s, d):
    n = B.numbered(s, d).select("doc_id", "pos", "text", "category", F.when(F.col("doc_id") % 2 == 0, F.col("type")).alias("type"))
    h = B.page_elements(s, d).select((F.lit(-1) - F.col("doc_id")).alias("doc_id"), "pos", "text", "category", "type")
    return sequence.select_headings(n.unionByName(h)).select("doc_id", "pos", "tier")


@query(f"WITH {B.N}, {NH} SELECT doc_id, id, level FROM nh")
def t4_heading_levels(s, d):
    return n_headings(s, d).select("doc_id", "id", "level")


@query(f"""WITH RECURSIVE {B.N}, {NH}, {tree('nh')}
SELECT doc_id, rn AS line_no, repeat(' ', 4 * depth) || CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END || ' (' || page || ')' AS line FROM tr""")
def t5_toc_outline(s, d):
    return sequence.toc_outline(sequence.heading_hierarchy(n_headings(s, d)))


STARTS = r"(starts_with(trim(text), '[') OR regexp_matches(trim(text), '^\d+\.') OR regexp_matches(trim(text), '^제\s*\d+\s*[장절]') OR regexp_matches(trim(text), '^\d{4}년') OR starts_with(trim(text), '>>>>') OR contains(text, 'Q&A'))"
PAGE_END = lambda x: rf"regexp_matches(trim({x}), '(?:\.{{2,}}|[･·ㆍ]{{2,}})\s*\d+$')"


@query(f"""WITH {B.N}, o AS (SELECT doc_id, pos, text, sum({STARTS}::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS s, {PAGE_END('text')}::INT AS e FROM n), i AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id, s ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM o WHERE s > 0),
a AS (SELECT doc_id, s, string_agg(trim(text), ' ' ORDER BY pos) AS title, min(pos) AS pos FROM i WHERE bf = 0 GROUP BY doc_id, s), l AS (SELECT *, max(s) OVER (PARTITION BY doc_id) AS last FROM a), cl AS (SELECT *, {clean('title')} AS clean FROM l WHERE s < last OR {PAGE_END('title')})
SELECT doc_id, pos, title, clean FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, clean ORDER BY pos) AS k FROM cl WHERE clean <> '') WHERE k = 1""")
def t6_toc_titles(s, d):
    return sequence.accumulate_toc_titles(B.numbered(s, d))


@query(f"WITH {B.G} SELECT doc_id, page, text FROM (SELECT doc_id, page, {squeeze('string_agg(text, chr(10) ORDER BY pos)')} AS text FROM g WHERE NOT (y1 < 0.1::DOUBLE OR y1 > 0.9::DOUBLE) GROUP BY doc_id, page) WHERE text <> ''")
def t7_page_text(s, d):
    return sequence.clean_page_text(B.geometry(s, d))


@query(f"WITH {B.C} SELECT doc_id, page, 'p' || page || '_b' || pos AS id, trim(text) AS text, role AS font_name, (10 + pos % 3)::DOUBLE AS font_size FROM c WHERE trim(text) <> ''")
def t8_assemble_blocks(s, d):
    span = lambda w: F.struct(w.alias("text"), F.col("role").alias("font"), (F.lit(10) + F.col("pos") % 3).cast("double").alias("size"))
    line = F.struct(F.transform(F.split("text", " "), span).alias("spans"))
    return sequence.assemble_blocks(B.turns(s, d).select("doc_id", "page", F.col("pos").alias("idx"), F.array(line).alias("lines")))


def g_blocks(s, d):
    return with_titles(s, d).withColumns({"id": F.col("pos"), "seq": F.col("pos")})


def of(alias: str, condition: str) -> str:
    """A condition on a block's columns, for the block of that alias."""
    return re.sub(r"\b(text|size|body|font)\b", rf"{alias}.\1", condition)


ACROSS = "least(r.x2, o.x2) - greatest(r.x1, o.x1)"
GOES_ON = f"({ACROSS} >= 0 AND {ACROSS} >= 0.5::DOUBLE * (r.x2 - r.x1) AND o.y1 - r.y2 >= 0 AND o.y1 - r.y2 <= 1.8::DOUBLE * greatest(r.size, o.size) * 0.01::DOUBLE AND NOT {of('r', COMPLETE('text'))} AND NOT ({of('r', TB)}) AND NOT ({of('o', TB)}))"
RELATED = rf"""(least(r.y2, o.y2) > greatest(r.y1, o.y1) AND {ACROSS} > 0 AND ((starts_with(trim(o.text), '(') AND r.is_title) OR regexp_matches(trim(o.text), '^\((소득|조특|법인|부가가치|상속|증여)(법|령)\s+제\d+조') OR starts_with(trim(o.text), '적용시기') OR starts_with(trim(o.text), '<적용시기') OR (r.font = o.font AND abs(r.size - o.size) < 5 AND r.is_title = o.is_title)))"""


def fold_sql(name: str, blocks: str, joins: str, sep: str) -> str:
    """name: blocks(doc_id, page, i from 1 on a page, ...) folded one by one; a row for each fold."""
    return f"""{name}_r AS (SELECT *, 1 AS grp FROM {blocks} WHERE i = 1 UNION ALL SELECT doc_id, page, i, CASE WHEN j THEN no ELSE ono END, CASE WHEN j THEN text || sep || otext ELSE otext END, CASE WHEN j THEN least(x1, ox1) ELSE ox1 END, CASE WHEN j THEN least(y1, oy1) ELSE oy1 END, CASE WHEN j THEN greatest(x2, ox2) ELSE ox2 END, CASE WHEN j THEN greatest(y2, oy2) ELSE oy2 END,
     CASE WHEN j THEN size ELSE osize END, CASE WHEN j THEN font ELSE ofont END, CASE WHEN j THEN body ELSE obody END, CASE WHEN j THEN is_title ELSE otitle END, CASE WHEN j THEN ids || ',' || oids ELSE oids END, CASE WHEN j THEN grp ELSE grp + 1 END
     FROM (SELECT r.* EXCLUDE (i), o.i, o.no AS ono, o.text AS otext, o.x1 AS ox1, o.y1 AS oy1, o.x2 AS ox2, o.y2 AS oy2, o.size AS osize, o.font AS ofont, o.body AS obody, o.is_title AS otitle, o.ids AS oids, {joins} AS j, {sep} AS sep FROM {name}_r r JOIN {blocks} o ON o.doc_id = r.doc_id AND o.page = r.page AND o.i = r.i + 1)),
    {name} AS (SELECT * EXCLUDE (i) FROM {name}_r QUALIFY row_number() OVER (PARTITION BY doc_id, page, grp ORDER BY i DESC) = 1)"""


def folds_sql(y2: str, overlapping: bool) -> str:
    given = f"ob AS MATERIALIZED (SELECT g.doc_id, page, row_number() OVER (PARTITION BY g.doc_id, page ORDER BY y1, x1, pos) AS i, 0::BIGINT AS no, text, x1, y1, x2, {y2} AS y2, size, font, body, {TB} AS is_title, pos::VARCHAR AS ids FROM g JOIN bs ON g.doc_id = bs.doc_id)"
    numbers = "nb AS MATERIALIZED (SELECT doc_id, page, grp::BIGINT AS i, row_number() OVER (PARTITION BY doc_id ORDER BY page, grp) AS no, text, x1, y1, x2, y2, size, font, body, is_title, ids FROM fa)"
    second = ", " + fold_sql("fb", "nb", RELATED, "CASE WHEN starts_with(trim(o.text), '(') THEN ' ' ELSE chr(10) END") if overlapping else ""
    return f"WITH RECURSIVE {B.G}, {BODY}, {given}, {fold_sql('fa', 'ob', GOES_ON, chr(39) + ' ' + chr(39))}, {numbers}{second} SELECT doc_id, page, 'm' || no AS id, text, ids AS merged FROM {'fb' if overlapping else 'nb'}"


@query(folds_sql("y2", False))
def t9_merge_adjacent(s, d):
    return blocks.merge_blocks(g_blocks(s, d), gap=0.01).select("doc_id", "page", "id", "text", F.array_join("merged_ids", ",").alias("merged"))


@query(folds_sql("y2 + CASE WHEN pos % 5 = 0 THEN 0.08::DOUBLE ELSE 0 END", True))
def t10_merge_overlapping(s, d):
    tall = g_blocks(s, d).withColumn("y2", F.col("y2") + F.when(F.col("pos") % 5 == 0, 0.08).otherwise(0.0))  # some reach into the next line
    return blocks.merge_blocks(tall, gap=0.01, overlapping=True).select("doc_id", "page", "id", "text", F.array_join("merged_ids", ",").alias("merged"))


# vectors and context


#: crc32 by its table of 256 remainders, for each distinct word; words are what white space of any kind parts.
V1 = r"""WITH remainders AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
ws AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS word FROM documents),
counts AS (SELECT doc_id, word, count(*) AS n FROM ws GROUP BY doc_id, word),
octets AS (SELECT word, list_transform(range(1, length(hex(word)), 2), lambda k: ('0x' || substr(hex(word), k, 2))::BIGINT) AS o FROM (SELECT DISTINCT word FROM counts)),
crcs AS (SELECT word, xor(list_reduce(list_prepend(4294967295, o), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS crc FROM octets, remainders),
sums AS (SELECT doc_id, crc % 64 AS k, sum(CASE WHEN crc >= 2147483648 THEN n ELSE -n END)::DOUBLE AS v FROM counts JOIN crcs USING (word) GROUP BY doc_id, k)
SELECT doc_id AS id, 64 AS dim, round((coalesce(sum(v) FILTER (WHERE k = 0), 0) / sqrt(sum(v * v)))::FLOAT::DOUBLE, 4) + 0 AS first FROM sums GROUP BY doc_id HAVING sum(v * v) > 0"""


@query(V1)
def v1_embed_rows(s, d):
    rows = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return vectors.embed_rows(rows).select("id", F.size("embedding").alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / n, 5) AS first, round(embedding[64]::DOUBLE / n, 5) AS last FROM (SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def v2_l2_normalize(s, d):
    e = B.table(s, d, "embeddings").select("vec_id", vectors.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return e.select("vec_id", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(F.get("v", F.lit(63)), 5).alias("last"))


HITS = """hits AS (SELECT query_id, vec_id, similarity, rank FROM (SELECT q.vec_id AS query_id, b.vec_id, s AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, b.vec_id) AS rank FROM (SELECT q.vec_id AS qid, b.vec_id AS bid, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0) x JOIN embeddings q ON q.vec_id = x.qid JOIN embeddings b ON b.vec_id = x.bid) WHERE rank <= 5)"""


def hits(s, d):
    e = B.table(s, d, "embeddings")
    return vectors.cosine_topk(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e)


def passages(s, d):
    t = B.table(s, d, "documents")
    return t.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), F.format_string("id: %d,\npage: %s", F.col("doc_id"), "source").alias("metadata"))


PASSAGES = "ps AS (SELECT doc_id AS vec_id, text AS content, 'id: ' || doc_id || ',' || chr(10) || 'page: ' || source AS metadata FROM documents)"
CONTEXT = f"""cx AS (SELECT query_id, string_agg('{context.DOCUMENT} ' || rank || ':' || chr(10) || '{context.CONTENT} ' || content || chr(10) || '{context.METADATA} ' || metadata || chr(10) || chr(10), '' ORDER BY rank) AS context FROM hits JOIN ps USING (vec_id) GROUP BY query_id)"""


@query(f"WITH {HITS} SELECT query_id, vec_id, rank, round(similarity, 4) AS similarity FROM hits")
def v3_cosine_topk(s, d):
    return hits(s, d).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 4).alias("similarity"))


@query(f"WITH {HITS}, {PASSAGES} SELECT query_id, rank, vec_id, md5(content) AS content_md5, metadata FROM hits JOIN ps USING (vec_id)")
def v4_hydrate_hits(s, d):
    return vectors.hydrate_hits(hits(s, d), passages(s, d)).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.md5("content").alias("content_md5"), "metadata")


def contexts(s, d):
    return context.build_context(vectors.hydrate_hits(hits(s, d), passages(s, d)))


@query(f"WITH {HITS}, {PASSAGES}, {CONTEXT} SELECT query_id, md5(context) AS context_md5 FROM cx")
def r1_build_context(s, d):
    return contexts(s, d).select("query_id", F.md5("context").alias("context_md5"))


R2 = f"""ln AS (SELECT query_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT query_id, string_split(context, chr(10)) AS a FROM cx)), mk AS (SELECT *, CASE WHEN starts_with(trim(line), '{context.METADATA}') THEN 'm' WHEN starts_with(trim(line), '{context.DOCUMENT}') OR starts_with(trim(line), '{context.CONTENT}') THEN 'x' END AS mark FROM ln),
st AS (SELECT *, count(*) FILTER (WHERE mark = 'x') OVER (PARTITION BY query_id ORDER BY pos) AS run FROM mk), md AS (SELECT m.query_id, m.pos AS marker, l.pos, l.line FROM st m JOIN st l ON l.query_id = m.query_id AND l.run = m.run AND l.pos > m.pos WHERE m.mark = 'm'),
r2 AS (SELECT query_id, coalesce(string_agg(line, chr(10) ORDER BY marker, pos), '') AS metadata_context FROM (SELECT DISTINCT query_id FROM cx) LEFT JOIN md USING (query_id) GROUP BY query_id)"""


@query(f"WITH {HITS}, {PASSAGES}, {CONTEXT}, {R2} SELECT query_id, metadata_context FROM r2")
def r2_metadata_context(s, d):
    return context.extract_metadata_context(contexts(s, d))


TEMPLATE = "Question: {question}\nContext:\n{context}\nAnswer:"


@query(f"WITH {HITS}, {PASSAGES}, {CONTEXT}, {R2} SELECT query_id, 'model' AS model, 0.0::DOUBLE AS temperature, 'Question: What is ' || query_id || '?' || chr(10) || 'Context:' || chr(10) || metadata_context || chr(10) || 'Answer:' AS prompt FROM r2")
def r3_render_prompts(s, d):
    ctx = context.extract_metadata_context(contexts(s, d)).select("query_id", F.format_string("What is %d?", "query_id").alias("question"), F.col("metadata_context").alias("context"))
    return context.render_prompts(ctx, TEMPLATE)
