"""Pattern packs and the one extraction that runs them.

Patterns are fixed values: what counts as a date, an amount or a citation. Classes of
characters are Unicode's. Labels of document types are the values that results carry;
kinds of patterns are named by this library.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import strip

AMOUNT = r"\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*"
GENERAL = r"\d+(?:,\d{3})*(?:\.\d+)?\s*(?:원|만원|억원|천원)"
DAY = r"(?:19|20)\d{2}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일"
#: Family -> kind -> (pattern, group of the value)
PACKS: dict[str, dict[str, tuple[str, int]]] = {
    "year": {"year": (r"(?:19|20)\d{2}\s*년", 0), "digits": (r"\b\d{4}년\b", 0)},
    "amount": {unit: (AMOUNT + unit, 0) for unit in ("원", "만원", "억원", "조원", "천원")},
    "law": {
        "act": (r"(?:「|제|｢)[^」｣]+(?:법|법률|령|규칙|고시|예규)(?:」|｣|제\s*\d+\s*조)", 0),
        "article": (r"제\s*\d+\s*조(?:\s*제\s*\d+\s*항)?(?:\s*제\s*\d+\s*호)?", 0),
        "decree": (r"[가-힣]+\s*시행령", 0),
        "rule": (r"[가-힣]+\s*시행규칙", 0),
    },
    "date": {
        "ymd": (DAY, 0),
        "ym": (r"(?:19|20)\d{2}\s*년\s*\d{1,2}\s*월(?!\d)", 0),
        "md": (r"(?<!\d)\d{1,2}\s*월\s*\d{1,2}\s*일", 0),
        "period": (DAY + r"\s*(?:~|부터|까지)\s*" + DAY, 0),
    },
    "percent": {"percent": (r"\d+(?:\.\d+)?\s*%", 0)},
    "contact": {
        "phone": (r"(?:\(?\d{2,3}\)?[-\s.]?)?(?:\d{3,4}[-\s.]?\d{4})", 0),
        "email": (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+", 0),
        "website": (r"(?:https?://)?(?:www\.)?[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+(?:/[a-zA-Z0-9._~:/?#\[\]@!$&'()*+,;=-]*)?", 0),
    },
    "organization": {"suffix": (r"[가-힣]+(?:부|청|위원회|공단|공사|센터|진흥원|재단|연구소|협회)", 0), "foundation": (r"(?:재단법인|사단법인)\s[가-힣]+", 0)},
    "reference": {
        "page": (r"(?:p\.|page|페이지)\s*\d+", 0),
        "figure": (r"(?:그림|fig\.|figure)\s*\d+", 0),
        "table": (r"(?:표|table)\s*\d+", 0),
        "section": (r"제\s*\d+\s*(?:장|절|항|호)", 0),
        "footnote": (r"\s*\[\d+\]\s*", 0),
        "asterisk": (r"\s*\*+\s*", 0),
    },
}
#: Document types in order of preference, three patterns each; a match scores two.
TYPES: dict[str, list[str]] = {
    "법률문서": [rf"(?:소득|조특|법인|부가가치|상속|증여)(?:법|령)\s+제\d+조", r"민법|형법|상법|헌법|행정\s*절차법|국세\s*기본법", r"(?:대법원|헌법재판소).*?(?:판결|결정)"],
    "금융문서": [r"예금|적금|펀드|투자|주식|채권|상품|계좌", r"(?:이율|수익률|금리)\s*\d+(?:\.\d+)?\s*%", r"만기일|만기금액|원금|이자"],
    "의학문서": [r"진단|처방|투약|용법|용량|부작용", r"환자|의사|간호사|병원|약국", r"수술|치료|검사|예방|예후"],
    "기술문서": [r"시스템|모듈|인터페이스|프로토콜|API", r"설계|구현|테스트|배포|유지보수", r"버전|릴리스|업데이트"],
    "학술문서": [r"연구|실험|분석|조사|관찰", r"참고문헌|인용|출처", r"가설|이론|모델|방법론"],
    "계약문서": [r"계약서|약관|당사자|갑|을|계약기간", r"제\d+\s*조|위약금|해지|해제|배상", r"서명|날인|입회인|증인"],
}
OTHER_TYPE = "일반문서"
#: Marks that open a bullet point.
BULLETS = {"number": r"^\s*\d+\.\s+", "letter": r"^\s*[A-Za-z]\.\s+", "symbol": r"^\s*[•◆■□○●★※▶-]\s+"}


def matches(pattern: str, group: int = 0, text: str = "text") -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(group))


def extract_patterns(docs: DataFrame, families: str | list[str], kinds: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, family, kind, seq, value: all matches of all families in order, in one pass over the text."""

    def marked(family: str, kind: str):
        return lambda v, i: F.struct(F.lit(family).alias("family"), F.lit(kind).alias("kind"), i.alias("seq"), v.alias("value"))

    wanted = [(f, k, *v) for f in ([families] if isinstance(families, str) else families) for k, v in PACKS[f].items() if kinds is None or k in kinds]
    found = [F.transform(matches(p, g), marked(f, k)) for f, k, p, g in wanted]
    out = docs.select("doc_id", F.explode(F.concat(*found)).alias("m"))
    return out.select("doc_id", "m.family", "m.kind", "m.seq", "m.value")


def distinct_values(matches: DataFrame) -> DataFrame:
    """Each value once for a document and kind."""
    return matches.select("doc_id", "family", "kind", "value").distinct()


def year_mentions(docs: DataFrame) -> DataFrame:
    """X3."""
    return extract_patterns(docs, "year").groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))


def financial_amounts(docs: DataFrame, first: int = 20) -> DataFrame:
    """Matches by unit, and a general amount of which the first 20 are reported."""
    by_unit = extract_patterns(docs, "amount").select("doc_id", "kind", "seq", "value")
    general = F.slice(matches(GENERAL), 1, first)
    general = docs.select("doc_id", F.lit("general").alias("kind"), F.posexplode(general).alias("seq", "value"))
    return by_unit.unionByName(general)


def reference_counts(docs: DataFrame, examples: int = 5) -> DataFrame:
    """X11: per kind of cross-reference the count and the first examples, and the document's total."""
    kinds = [F.struct(F.lit(k).alias("kind"), matches(p, g).alias("all")) for k, (p, g) in PACKS["reference"].items()]
    out = docs.select("doc_id", F.explode(F.array(*kinds)).alias("m")).select("doc_id", "m.kind", F.size("m.all").alias("n"), F.array_join(F.slice("m.all", 1, examples), "|").alias("examples"))
    return out.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id"))).filter("n > 0")


def bullet_points(els: DataFrame) -> DataFrame:
    """els(doc_id, pos, text) -> doc_id, pos, line, kind, content, marker removed; lines that are nothing else are dropped."""
    lines = els.select("doc_id", "pos", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("t", strip(F.col("t")))
    kind = reduce(lambda c, k: c.when(F.col("t").rlike(f"(?U){BULLETS[k]}"), k), BULLETS, F)
    content = strip(F.regexp_replace("t", "(?U)" + "|".join(BULLETS.values()), ""))
    return lines.select("doc_id", "pos", "line", kind.alias("kind"), content.alias("content")).filter("kind is not null and content <> ''")


def top_words(docs: DataFrame, pattern: str = r"[\p{L}]+", n: int = 20) -> DataFrame:
    """X12, corpus-wide: counts are summed before the shuffle, the n largest kept."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def word_summaries(docs: DataFrame, by: list[str] | None = None, pattern: str = r"[\p{L}]+", tracked: int = 10_000) -> DataFrame:
    """X12 in parts: for each group, or all rows: how many words there are, and a summary of the frequent ones that holds `tracked` of them at most, and can be kept and merged. Each task sums up its own rows first."""
    by = by or []
    words = docs.select(*by, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("word"))
    return words.groupBy(*by).agg(F.count("*").alias("words"), F.expr(f"approx_top_k_accumulate(word, {tracked})").alias("summary"))


def merge_word_summaries(parts: DataFrame, by: list[str] | None = None, tracked: int = 10_000) -> DataFrame:
    """Summaries of parts of a table -> those of the whole, or of larger groups."""
    return parts.groupBy(*(by or [])).agg(F.sum("words").alias("words"), F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"))


def heavy_words(docs: DataFrame, pattern: str = r"[\p{L}]+", n: int = 20, tracked: int = 10_000, summary: DataFrame | None = None) -> DataFrame:
    """X12, corpus-wide, without a shuffle of each distinct word: a summary names the candidates, and they alone are counted exactly.

    A summary of m words names each that occurs more often than 6 / m of all (its map holds 4/3 m, its error is 3.5 of
    a map's share, and a word is left out within twice the error). If the n-th count is beyond that, no other word can be
    among the n; otherwise (few distinct words, or none frequent) all are counted. `summary`: one row of merged summaries kept from before.
    """
    one = (summary if summary is not None else word_summaries(docs, None, pattern, tracked)).select("words", F.expr(f"approx_top_k_estimate(summary, {tracked})").alias("named")).first()
    named = [(x["item"],) for x in one.named or []] if one else []
    if len(named) >= n:
        words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("word"))
        counted = words.join(F.broadcast(docs.sparkSession.createDataFrame(named, "word string")), "word").groupBy("word").agg(F.count("*").alias("n"))
        best = counted.orderBy(F.desc("n"), "word").limit(n).collect()
        if best[-1].n > 6 * one.words / tracked:
            return docs.sparkSession.createDataFrame(best, "word string, n long")
    return top_words(docs, pattern, n)


def top_words_by_document(docs: DataFrame, pattern: str = r"[\p{L}]+", n: int = 20) -> DataFrame:
    """X12, for each document."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("word"))
    counts = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def detect_document_type(docs: DataFrame, least: int = 3) -> DataFrame:
    """The family with the best score, the first of equals; another if none reaches `least`."""
    score = lambda ps: reduce(lambda a, b: a + b, [F.regexp_count("text", F.lit(f"(?U){p}")) for p in ps]) * 2
    best = F.array_max(F.array(*[F.struct(score(ps).alias("score"), F.lit(-i).alias("rank"), F.lit(t).alias("name")) for i, (t, ps) in enumerate(TYPES.items())]))
    out = docs.select("doc_id", best.alias("b"))
    return out.select("doc_id", F.when(F.col("b.score") >= least, F.col("b.name")).otherwise(OTHER_TYPE).alias("doc_type"), F.col("b.score").alias("score"))


#: Families of marked elements in a text, by the labels that results carry.
ELEMENTS: dict[str, list[str]] = {
    "법률_참조": [r"제\d+조(?:\s*제\d+항)?(?:\s*제\d+호)?", r"[「｢][^」｣]+(?:법|법률|조례|규칙)[」｣]", r"(?:대법원|헌법재판소|행정법원).*?\d{4}[년.]\s*\d{1,2}[월.]\s*\d{1,2}[일.]"],
    "금액_표시": [r"\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:원|만원|억원|조원)", r"(?:금|￦|\\)\s*\d{1,3}(?:,\d{3})*(?:\.\d+)?", r"\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:달러|유로|엔|위안)"],
    "날짜_표시": [r"\d{4}[년.]\s*\d{1,2}[월.]\s*\d{1,2}[일.]", r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}", r"오늘|내일|어제|당일|익일|전일|다음날|지난날"],
    "적용시기_표시": [r"적용(?:시기|일|기간|대상|범위)(?:\s*:|\s*은)", r"<적용시기.*?>", r"\d{4}[년.]\s*\d{1,2}[월.]\s*\d{1,2}[일.]\s*(?:부터|이후)"],
    "표_구분": [r"(?:표|테이블|Table)\s*\d+[.\-:]", r"[|┃│](?:[^│|┃]+[|┃│]){2,}", r"-{3,}[+\-]{3,}-{3,}"],
    "목차_항목": [r"^\s*\d+\.\s+[가-힣A-Za-z]", r"^\s*[IVXLCDM]+\.\s+[가-힣A-Za-z]", r"^\s*[가-힣]\.\s+[가-힣A-Za-z]"],
    "참조_표시": [r"(?:\*|※|주\)|각주)\s*\d*\s*:", r"\[\s*\d+\s*\]", r"(?:참고|참조|관련)\s*:?"],
}
#: Sections to look for by document type.
SECTIONS: dict[str, dict[str, list[str]]] = {
    "법률문서": {"제목": [r"^제\d+\s*장\s+[가-힣A-Za-z]", r"^제\d+\s*절\s+[가-힣A-Za-z]"], "본문": [r"^제\d+\s*조\s+\([가-힣A-Za-z]+\)", r"^\d+\.\s+[가-힣A-Za-z]"], "부칙": [r"^부\s*칙", r"제\d+\s*조\s*\(시행일\)"]},
    "금융문서": {"상품정보": [r"(?:상품|펀드|예금)\s*(?:정보|개요|안내)", r"(?:금리|이율)\s*(?:정보|안내)"], "거래조건": [r"(?:거래|계약)\s*(?:조건|정보|방법)", r"(?:수수료|비용)\s*(?:정보|안내)"], "유의사항": [r"(?:유의|주의)\s*(?:사항|안내)", r"(?:위험|리스크)\s*(?:고지|안내)"]},
    "계약문서": {
        "당사자": [r"(?:계약|협약)\s*(?:당사자|주체)", r"제\d+\s*조\s*\(당사자\)"], "계약내용": [r"(?:계약|협약)\s*(?:내용|범위|대상)", r"제\d+\s*조\s*\(계약내용\)"],
        "계약기간": [r"(?:계약|협약)\s*(?:기간|일정|종료)", r"제\d+\s*조\s*\(계약기간\)"], "해지조항": [r"(?:계약|협약)\s*(?:해지|해제|종료)", r"제\d+\s*조\s*\(계약해지\)"],
    },
}
