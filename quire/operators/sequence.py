"""Work that follows a document's order: sections, heading trees, tables of contents, page text.

What runs along a document runs in ranges of it (see scan), so that no task holds a whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .batches import ordered_join
from .classify import HEADING_FORMS, LEVELS, any_of
from .match import match_titles_exact
from .scan import keyed, ranges, running


def sectionize_by_title(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """lines(doc_id, pos, text): each matched title opens a section of the lines up to the next; what comes before the first goes."""
    hit = match_titles_exact(lines, titles)
    s = running(hit, ["pos"], [ranges()], sums={"section": F.when(F.col("title_no").isNotNull(), 1)}, totals=True).filter("section > 0")
    body = F.when(F.col("title_no").isNull(), F.struct("pos", F.col("text").alias("_v")))
    content = F.array_join(F.transform(F.array_sort(F.array_compact(F.collect_list(body))), lambda x: x["_v"]), "\n")
    out = s.groupBy("doc_id", "section").agg(
        F.min_by("text", "pos").alias("text"), F.min_by("title", "pos").alias("original_title"), (F.min("pos") + 1).alias("line_number"), content.alias("content"), F.max("section_total").alias("total_count")
    )
    return out.withColumns({"law_reference": X.first_law_reference(F.col("text")), "application_date": X.first_application_date(F.col("text"))})


def select_headings(els: DataFrame) -> DataFrame:
    """A document's headings by type; if it has none, by category; if it has none of these, by form."""
    tiers = {"_t": F.coalesce(F.col("type") == "heading", F.lit(False)), "_c": F.coalesce(F.col("category").startswith("heading"), F.lit(False)), "_p": any_of(F.col("text"), HEADING_FORMS)}
    own = els.withColumns(tiers)
    w = Window.partitionBy("doc_id")
    own = own.withColumns({f"_any{k}": F.max(k).over(w) for k in ("_t", "_c")})
    keep = F.when(F.col("_any_t"), F.col("_t")).when(F.col("_any_c"), F.col("_c")).otherwise(F.col("_p"))
    tier = F.when(F.col("_any_t"), "type").when(F.col("_any_c"), "category").otherwise("pattern")
    return own.withColumn("tier", tier).filter(keep).drop("_t", "_c", "_p", "_any_t", "_any_c")


def pattern_level(text: Column) -> Column:
    level = F
    for pattern, n in LEVELS:
        level = level.when(text.rlike(f"(?U){pattern}"), n)
    return level.otherwise(1)


def heading_levels(headings: DataFrame) -> DataFrame:
    """T4: by numbering, but no deeper than the rank of the font size where sizes are known."""
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))
    level = pattern_level(F.col("text"))
    return headings.withColumn("level", F.when(F.col("size").isNotNull(), F.least(level, rank)).otherwise(level).cast("int"))


#: Pages of a document whose headings are put in order together, and headings of these that a fold goes through at once.
PAGES, HEADINGS = 16, 1000
STACK = "array<struct<id: {0}, level: int>>"


def pushed(stack: Column, heading: Column) -> Column:
    """The open headings once this one has come: those of smaller levels, and itself."""
    return F.concat(F.filter(stack, lambda s: s["level"] < heading["level"]), F.array(F.struct(heading["id"].alias("id"), heading["level"].cast("int").alias("level"))))


def heading_hierarchy(headings: DataFrame) -> DataFrame:
    """headings(doc_id, id, page, y, level, ...) -> parent_id: the nearest one before with a smaller level; depth: ancestors; path: their ids and the own one, by `/`.

    Levels are any whole numbers. Headings are folded in ranges of a document with a stack of the open ones. A range's carry
    is the stack it leaves behind by itself: after it, the open headings are those from before with
    levels under its lowest, and then its own. So carries of a document add up to the stack that each range begins with.
    """
    columns, kind = headings.columns, dict(headings.dtypes)["id"]
    own, doc, (block,) = keyed(headings, "doc_id", [F.floor(F.col("page") / PAGES).cast("long")])
    place = F.row_number().over(Window.partitionBy(*doc, block).orderBy("page", "y", "id"))
    own = own.withColumn("_part", F.floor((place - 1) / HEADINGS).cast("int"))
    cell = [*doc, block, "_part"]
    whole = F.struct(F.col("page").alias("_page"), F.col("y").alias("_y"), "id", F.col("level").cast("int").alias("level"), F.struct(*columns).alias("row"))
    folded = own.groupBy(*cell).agg(F.array_sort(F.collect_list(whole)).alias("_h"))
    empty = F.array().cast(STACK.format(kind))
    narrow = own.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("_page"), F.col("y").alias("_y"), "id", F.col("level").cast("int").alias("level")))).alias("_h"))
    left = narrow.select(*cell, F.aggregate("_h", empty, pushed).alias("left"))
    # along the document: what each range begins with, and the stack after it
    both = f"struct<began: array<struct<{block}: bigint, _part: int, stack: {STACK.format(kind)}>>, open: {STACK.format(kind)}>"
    after = lambda a, x: F.concat(F.filter(a["open"], lambda s: F.coalesce(s["level"] < F.get(x["left"], F.lit(0))["level"], F.lit(True))), x["left"])
    began = lambda a, x: F.array_append(a["began"], F.struct(x[block].alias(block), x["_part"].alias("_part"), a["open"].alias("stack")))
    start = F.struct(F.array().alias("began"), F.array().alias("open")).cast(both)
    along = left.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct(block, "_part", "left"))).alias("_r")).filter(F.size("_r") > 1)
    along = along.select(*doc, F.explode(F.aggregate("_r", start, lambda a, x: F.struct(began(a, x).alias("began"), after(a, x).alias("open")), lambda a: a["began"])).alias("b"))
    along = along.select(*doc, f"b.{block}", "b._part", "b.stack")
    # inside a range: each heading's own stack
    out = folded.join(along, cell, "left").select("_h", F.coalesce("stack", empty).alias("stack"))
    states = f"struct<out: array<{STACK.format(kind)}>, open: {STACK.format(kind)}>"
    step = lambda a, h: F.get(F.transform(F.array(pushed(a["open"], h)), lambda s: F.struct(F.array_append(a["out"], s).alias("out"), s.alias("open"))), F.lit(0))
    stacks = F.aggregate("_h", F.struct(F.array().alias("out"), F.col("stack").alias("open")).cast(states), step, lambda a: a["out"])
    out = out.select(F.explode(F.arrays_zip(F.col("_h").alias("h"), stacks.alias("s"))).alias("z")).select("z.h.row.*", F.col("z.s").alias("_s"))
    n = F.size("_s")
    return out.withColumns({"parent_id": F.get("_s", n - 2)["id"], "depth": n - 1, "path": F.array_join(F.transform("_s", lambda s: s["id"].cast("string")), "/")}).drop("_s")


def toc_outline(headings: DataFrame, indent: int = 4, most: int = 30) -> DataFrame:
    """T5: a line for each heading of heading_hierarchy(), numbered in document order: indented text, cut at `most` characters, and page."""
    label = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text"))
    own = running(headings, ["page", "y", "id"], [F.floor(F.col("page") / PAGES).cast("long")], sums={"line_no": F.lit(1)})
    return own.select("doc_id", "line_no", F.concat(F.repeat(F.lit(" "), F.col("depth") * indent), label, F.lit(" ("), F.col("page"), F.lit(")")).alias("line"))


def accumulate_toc_titles(lines: DataFrame) -> DataFrame:
    """Titles of several lines: opened by a start, up to a line that ends in a leader and page number; a start closes the open title; equal cleaned titles count once.

    Lines after a start fall into runs, each up to the next such end; the first run of a start is its title.
    """
    own = lines.withColumns({"_start": X.is_title_start(F.col("text")).cast("int"), "_end": F.coalesce(X.ends_in_page_number(F.col("text")), F.lit(False)).cast("int")})
    own = running(own, ["pos"], [ranges()], sums={"_s": F.col("_start"), "_e": F.col("_end")}, totals=True).filter("_s > 0")
    runs = own.withColumn("_t", X.strip(F.col("text"))).groupBy("doc_id", "_s", (F.col("_e") - F.col("_end")).alias("_before"))
    runs = runs.agg(ordered_join(["pos"], "_t", " ").alias("title"), F.min("pos").alias("pos"), F.max("_s_total").alias("_last"))
    t = runs.groupBy("doc_id", "_s").agg(F.min_by(F.struct("title", "pos", "_last"), "_before").alias("_r")).select("doc_id", "_s", "_r.*")
    t = t.filter((F.col("_s") < F.col("_last")) | X.ends_in_page_number(F.col("title")))
    t = t.withColumn("clean", X.clean_title(F.col("title"))).filter("clean <> ''")
    once = F.row_number().over(Window.partitionBy("doc_id", "clean").orderBy("pos"))
    return t.withColumn("_k", once).filter("_k = 1").select("doc_id", "pos", "title", "clean")


def clean_page_text(lines: DataFrame, height: Column | float = 1.0, share: float = 0.1) -> DataFrame:
    """lines(doc_id, page, pos, text, y1): without those that begin in the outer tenths of the page, whose height may be a column; on one line; empty pages go."""
    h = height if isinstance(height, Column) else F.lit(height)
    kept = lines.filter((F.col("y1") >= h * share) & (F.col("y1") <= h * (1 - share)))
    out = kept.groupBy("doc_id", "page").agg(ordered_join(["pos"], "text", "\n").alias("text"))
    return out.withColumn("text", X.squeeze(F.col("text"))).filter("text <> ''")


def assemble_blocks(pages: DataFrame) -> DataFrame:
    """blocks(doc_id, page, idx, lines: array of struct(spans)) -> id, text, font and size of the first span; blank ones go."""
    spans = F.flatten(F.transform("lines", lambda x: x["spans"]))
    text = X.strip(F.array_join(F.transform(spans, lambda s: s["text"]), " "))
    first = F.get(spans, F.lit(0))
    name = F.format_string("p%d_b%d", F.col("page").cast("long"), F.col("idx").cast("long"))
    return pages.select("doc_id", "page", name.alias("id"), text.alias("text"), first["font"].alias("font_name"), first["size"].alias("font_size")).filter("text <> ''")
