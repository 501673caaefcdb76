"""Column functions on titles, lines and spans. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The middle dots, and the one they become when titles are cleaned.
DOTS, DOT = "･·ㆍ", "･"
#: Fixed value: the one they become when titles are normalised.
PLAIN_DOT = "·"
#: Tax acts in citations.
ACTS = "소득|조특|법인|부가가치|상속|증여"
SPLIT_MARKS = f"-{DOTS}"
#: What counts as white space at a text's ends: Unicode's, and the four separators of ASCII.
BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where the value is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(col: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(col, F.lit(BLANK))


def text_first(text: Column, markdown: Column) -> Column:
    """Text, else markdown; empty counts as missing."""
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(markdown, F.lit("")), F.lit(""))


def markdown_first(text: Column, markdown: Column) -> Column:
    return text_first(markdown, text)


def unescape_newlines(col: Column) -> Column:
    """A literal backslash-n becomes a line break."""
    return F.replace(col, F.lit("\\n"), F.lit("\n"))


def squeeze(col: Column) -> Column:
    return strip(F.regexp_replace(col, r"(?U)\s+", " "))


def normalize_title(col: Column) -> Column:
    """One middle dot, single spaces, lower case."""
    return F.lower(squeeze(F.translate(col, DOTS, PLAIN_DOT * 3)))


def chained(col: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        col = F.regexp_replace(col, f"(?U){pattern}", to)
    return col


#: Fixed values, applied in this order; a year before "적용" keeps its form.
YEARS = [
    (r"(\d{4})\s*년도", "$1년"),
    (r"(\d{4})\s*년(?!\s*적용)", "$1년"),
    (r"'(\d{2})년(?!\s*적용)", "20$1년"),
    (r"^(\d{2})년(?!\s*적용)", "20$1년"),
    (r"(\d{4})\s*[~∼]\s*(\d{4})\s*년", "$1-$2년"),
    (r"(\d{4})\.(\d{1,2})\.(\d{1,2})", "$1년 $2월 $3일"),
]
#: Fixed values, in this order: what page numbers and leaders leave at a title's end.
PAGE_ENDS = [(r"\s*[･·ㆍ∙]{2,}\s*\d+\s*$", ""), (r"\s*\.{3,}\s*\d+$", ""), (r"\s*\d+$", ""), (r"\s*\.{3,}\s*", "")]
#: A dot with a space beside it stands apart, another one tight; the private character keeps the first kind from the second rule.
MIDDLE_DOTS = [(r"\s*∙\s*", " "), (rf"\s* \s*[{DOTS}]\s*|\s*[{DOTS}]\s* \s*", " \ue000 "), (rf"\s*[{DOTS}]\s*", DOT), ("\ue000", DOT)]
#: Spacing of months and days.
DATES = [(r"(\d{1,2})\s*월\s*", "$1월 "), (r"(\d{1,2})\s*일\s*", "$1일 ")]


def strip_number(col: Column) -> Column:
    """Without a leading number, unless it is a year's (a chapter's has a character before it)."""
    return F.regexp_replace(col, r"(?U)^(?!\d{4}년)\d+\.?\s*", "")


#: What a text must hold for any of the rules to change it: most texts pass few of them.
IF_YEAR, IF_END, IF_DOT, IF_DATE = r"\d", r"\d|\.{3}", rf"[{DOTS}∙\ue000]", r"\d\s*[월일]"


def clean_title(col: Column) -> Column:
    """Marker, leading number, years, page number, middle dots, dates, spaces, empty brackets."""
    col = strip_number(F.regexp_replace(col, r"(?U)^>>>>\s*", ""))
    where = lambda needed, rules: lambda c: F.when(c.rlike(f"(?U){needed}"), chained(c, rules)).otherwise(c)
    for needed, rules in ((IF_YEAR, YEARS), (IF_END, PAGE_ENDS), (IF_DOT, MIDDLE_DOTS), (IF_DATE, DATES)):
        col = bound(col, where(needed, rules))
    return strip(chained(col, [(r"\s+", " "), (r"\(\s*\)", "")]))


def assemble_line_text(spans: Column) -> Column:
    """P5: the spans' texts joined by a space, but by nothing after a middle dot, a hyphen or a full stop."""
    texts = F.filter(F.transform(spans, strip), lambda t: t != "")
    return F.aggregate(texts, F.lit(""), lambda acc, t: F.concat(acc, F.when((acc == "") | acc.rlike(rf"[{DOTS}.\-]\z"), "").otherwise(" "), t))


def center_x(x1: Column, x2: Column) -> Column:
    return (x1 + x2) / 2


def polygon_box(points: Column) -> Column:
    """Bounding box of corner points."""
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def polygon_center(points: Column) -> Column:
    """Mean of the corner points; null without any."""
    n = F.nullif(F.size(points), F.lit(0))
    mean = lambda f: F.aggregate(points, F.lit(0.0), lambda a, p: a + f(p)) / n
    return F.struct(mean(lambda p: p.x).alias("x"), mean(lambda p: p.y).alias("y"))


def split_title_words(col: Column) -> Column:
    """Cut at hyphens and middle dots, then glue each two neighbours with the mark between them as they stand; a last odd one stands alone, stripped. Blanks and bare marks go."""
    cut = F.struct(F.split(col, rf"[{SPLIT_MARKS}]").alias("parts"), F.regexp_extract_all(col, F.lit(rf"([{SPLIT_MARKS}])"), F.lit(1)).alias("marks"))

    def pairs(c: Column) -> Column:
        n = F.size(c["parts"])
        part = lambda k: F.get(c["parts"], k)
        glue = lambda k: F.when(k * 2 + 1 < n, F.concat(part(k * 2), F.get(c["marks"], k * 2), part(k * 2 + 1))).otherwise(strip(part(k * 2)))
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), glue)

    # the one-element array binds the cut, which is else evaluated for each pair
    bound = F.flatten(F.transform(F.array(cut), pairs))
    return F.filter(bound, lambda p: ~p.isin("", *SPLIT_MARKS))


#: A citation of a tax act; when a rule takes effect.
CITATION = rf"\((?:{ACTS})(?:법|령)\s+제\d+조(?:의\d+)?(?:\s*제\d+항)?(?:\s*,\s*제\d+조(?:의\d+)?)*\)"
EFFECTIVE = r"(?:적용시기|적용기한|시행일)\s*:\s*[^\n]*|\d{4}\.\d{1,2}\.\d{1,2}\.(?:까지|부터)(?:\s+한시)?(?:적용|시행)"


def first_match(col: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(col, f"(?U){pattern}", 0), F.lit(""))


def first_law_reference(col: Column) -> Column:
    """P9."""
    return first_match(col, CITATION)


def first_application_date(col: Column) -> Column:
    return first_match(col, EFFECTIVE)


def is_complete_sentence(col: Column) -> Column:
    """P10: ends as a sentence does, but not in a digit and a full stop."""
    end = F.rtrim(F.coalesce(col, F.lit("")), F.lit(BLANK))
    return end.rlike(r"[.!?:;\"')]\z") & ~end.rlike(r"(?U)\d\.\z")


def is_title_start(col: Column) -> Column:
    """A line that opens an entry of a table of contents."""
    t = strip(col)
    return t.startswith("[") | t.rlike(r"(?U)^\d+\.") | t.rlike(r"(?U)^제\s*\d+\s*[장절]") | t.rlike(r"(?U)^\d{4}년") | t.startswith(">>>>") | t.contains("Q&A")


def ends_in_page_number(col: Column) -> Column:
    return col.rlike(rf"(?U)(?:\.{{2,}}|[{DOTS}]{{2,}})\s*\d+\s*\z")
