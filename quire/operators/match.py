"""Joins of lines with titles, tables of contents and bands. The title side is a table of any size: Spark broadcasts it only where its size allows."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..sources.io import scratch

#: The leader and page number that a title may end in; its number.
LEADER = r"(?U)\s*[.·･]{2,}\s*\d+\s*$"
NUMBER = r"(?U)^(?:\d+\.)?\s*"


def cleaned(df: DataFrame, text: str) -> DataFrame:
    """Adds _k1, _k2, _k3: the cleaned text in lower case, without leader and page, without number; and _ws: the words of the last. A text that nothing is left of has none."""
    df = df.withColumn("_k1", F.nullif(F.lower(X.clean_title(F.col(text))), F.lit("")))
    df = df.withColumn("_k2", F.regexp_replace("_k1", LEADER, ""))
    df = df.withColumn("_k3", F.regexp_replace("_k2", NUMBER, ""))
    return df.withColumn("_ws", F.when(F.col("_k3").rlike(f"[{X.SPLIT_MARKS}]"), X.split_title_words(F.col("_k3"))))


class TitleWords:
    """Titles of several words, found in a line's words.

    A line holds enough of a title's n words only if it holds one of any n - need + 1 of them: so a title is filed under that
    many of its rarest, told by the number of titles that have a word. One automaton finds the words of all titles in a line's.
    """

    def __init__(self, titles: list[tuple[Any, list[str]]], threshold: float):
        """titles: (what stands for the title, its words), in the order in which they are preferred."""
        import ahocorasick

        self.shown = [t for t, _ in titles]
        held = Counter(w for _, words in titles for w in set(words))
        number = {w: k for k, w in enumerate(held)}
        self.words = [[number[w] for w in words] for _, words in titles]
        self.need = [next(m for m in range(len(words) + 1) if m >= len(words) * threshold) for _, words in titles]
        self.filed: dict[int, list[int]] = {}
        for k, (_, words) in enumerate(titles):
            count, left = Counter(words), len(words) - self.need[k] + 1
            for w in sorted(count, key=lambda w: (held[w], -len(w), w)):
                if left <= 0:
                    break
                self.filed.setdefault(number[w], []).append(k)
                left -= count[w]
        self.automaton = ahocorasick.Automaton()
        for w, k in number.items():
            self.automaton.add_word(w, k)
        self.automaton.make_automaton()

    def first(self, words: list[str]) -> Any:
        """The first title that the words match, or None."""
        found = {k for w in words for _, k in self.automaton.iter(w)}
        best = len(self.words)
        for k in found:
            for t in self.filed.get(k, ()):
                if t >= best:
                    break
                if sum(w in found for w in self.words[t]) >= self.need[t]:
                    best = t
        return self.shown[best] if best < len(self.words) else None


READY: dict[str, TitleWords] = {}


def title_words(key: str, sent: Broadcast) -> TitleWords:
    """The titles sent under that key; a worker makes the automaton once."""
    if key not in READY:
        READY.clear()
        READY[key] = TitleWords(*sent.value)
    return READY[key]


def by_automaton(lines: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    """Adds _h4 to lines(_ws, ...) where titles(_t, main) are few enough to be sent to all tasks."""
    rows = sorted(((tuple(r["_t"]), list(r.main)) for r in titles.collect()), key=lambda r: r[0])
    kind = titles.schema["_t"].dataType
    if not rows:
        return lines.withColumn("_h4", F.lit(None).cast(kind))
    sent, key, arrow = lines.sparkSession.sparkContext.broadcast((rows, threshold)), uuid.uuid4().hex, to_arrow_type(kind)
    at = lines.columns.index("_ws")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        titles = title_words(key, sent)
        for b in it:
            hits = [titles.first(w) if w else None for w in b.column(at).to_pylist()]
            cells = [dict(zip(("title_no", "title"), h, strict=True)) if h else None for h in hits]
            yield pa.record_batch([*b.columns, pa.array(cells, arrow)], names=[*b.schema.names, "_h4"])

    return lines.mapInArrow(run, T.StructType([*lines.schema.fields, T.StructField("_h4", kind)]))


#: Lengths that the parts of a word, before its mark and after it, are cut to: each to the largest that it reaches.
ENDS = (0, 1, 2, 3, 4, 8, 16)
#: Bits that a filter of keys has for each of them, and at most; each key sets PROBES.
BITS_EACH, MOST_BITS, PROBES = 32, 1 << 28, 4


def keys_at_marks(texts: list[str], used: list[tuple[int, int]], whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each pair of lengths: the texts' numbers and keys of the words that reach it, a key being a hash of the mark and the ends of that length on either side.

    Words are cut as split_title_words() does: every second mark of a text glues two parts. whole: only words that these are the lengths of.
    """
    if not texts:
        return
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    ends = np.cumsum(sizes)
    at = np.flatnonzero(np.isin(codes, [ord(c) for c in X.SPLIT_MARKS]))
    row = np.searchsorted(ends, at, "right")
    start = (ends - sizes)[row]
    low = np.maximum(start, np.concatenate([[-1], at])[:-1] + 1)
    high = np.minimum(ends[row], np.concatenate([at, [len(codes)]])[1:])
    glued = (np.arange(len(at)) - np.searchsorted(at, start)) % 2 == 0
    at, row, low, high = at[glued], row[glued], low[glued], high[glued]
    if not len(at):
        return

    def hashes(step: int) -> dict[int, np.ndarray]:
        """Of the characters on one side, the nearest first; beyond a part's end they are of no use."""
        h, out = np.zeros(len(at), np.uint64), {}
        for n in range(ENDS[-1] + 1):
            if n in ENDS:
                out[n] = h
            h = h * np.uint64(0x100000001B3) + codes[np.clip(at + step * (n + 1), 0, len(codes) - 1)] + np.uint64(1)
        return out

    before, after, mark = hashes(-1), hashes(1), codes[at].astype(np.uint64)
    reached = lambda room: np.asarray(ENDS)[np.searchsorted(ENDS, room, "right") - 1]
    own_a, own_b = reached(at - low), reached(high - at - 1)
    for a, b in used:
        fits = np.flatnonzero((own_a == a) & (own_b == b) if whole else (own_a >= a) & (own_b >= b))
        side = lambda h, n: pd.util.hash_array(h[fits] + np.uint64(n))
        yield row[fits], pd.util.hash_array(side(before[a], a) * np.uint64(3) + side(after[b], b) + mark[fits])


def held_by(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where a key's bits are all set in the filter: all that were put in, and few others."""
    left, low, step, last = np.arange(len(keys)), keys & np.uint64(0x7FFFFFFF), (keys >> np.uint64(32)) | np.uint64(1), np.uint64(len(bits) * 64 - 1)
    for k in range(PROBES):
        p = (low[left] + np.uint64(k) * step[left]) & last
        left = left[(bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
    return left


def filter_of(keys: DataFrame, n: int) -> np.ndarray:
    """The filter that held_by() asks, of n keys at most (column key): set in tasks, and bounded in size, whatever their number."""
    size = 1 << 16
    while size < min(n * BITS_EACH, MOST_BITS):
        size *= 2
    place = [f"((key & 2147483647) + {k}L * (shiftrightunsigned(key, 32) | 1L)) & {size - 1}L" for k in range(PROBES)]
    set_ = keys.select(F.explode(F.expr(f"array({', '.join(place)})")).alias("p")).groupBy(F.expr("cast(shiftright(p, 6) as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    got, bits = set_.toArrow(), np.zeros(size // 64, np.int64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return bits.view(np.uint64)


def digest(c: Column) -> Column:
    """Stands for a text wherever equal ones meet: 32 bytes instead of the text."""
    return F.unhex(F.sha2(c.cast("binary"), 256))


def with_digests(df: DataFrame) -> DataFrame:
    """Adds _s1, _s2, _s3, the digests of _k1, _k2 and _k3, most of which are equal."""
    df = df.withColumn("_s1", digest(F.col("_k1")))
    for k in (2, 3):
        df = df.withColumn(f"_s{k}", F.when(F.col(f"_k{k}") == F.col(f"_k{k - 1}"), F.col(f"_s{k - 1}")).otherwise(digest(F.col(f"_k{k}"))))
    return df


def kept(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Tells a key that a title is filed under from one that is merely a title's; keys of a line beyond so many are not compared with a title's before the words are.
FILED, MOST_KEYS = 0x5DEECE66D1234567, 64


def by_keys(texts: DataFrame, known: DataFrame, several: DataFrame, threshold: float, at: str) -> DataFrame:
    """texts(_text) -> _line, _hit: the digest of each distinct text that titles match by any rung, and its hit. For any number of titles; tables of steps are written under the path `at`.

    A title of several words has one that holds a mark, and a line that matches holds it too: its ends beside that mark, cut to ENDS, are a key, and a title
    is filed under those of its rarest words, as many as TitleWords takes. A filter of all titles' keys and digests goes to the tasks: lines that it
    rules out, nearly all that match nothing, go no further. Of the others digests and keys meet titles'. Pairs that hold keys of enough words are verified.
    """
    sums = lambda pairs, of: F.aggregate(pairs, F.lit(0), lambda n, x: n + of(x))
    several = kept(several.withColumn("no", F.monotonically_increasing_id()), f"{at}/several")
    marked = F.filter(F.array_distinct("main"), lambda w: w.rlike(f"[{X.SPLIT_MARKS}]"))
    counted = F.transform(marked, lambda w: F.struct(w.alias("w"), F.size(F.filter("main", lambda x: x == w)).alias("n")))
    words = several.select("no", (F.size("main") - F.ceil(F.size("main") * threshold)).alias("spare"), F.explode(counted).alias("c")).select("no", "spare", "c.w", "c.n")
    pairs = [(a, b) for a in ENDS for b in ENDS]

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            key, kind = np.zeros(len(b), np.int64), np.zeros(len(b), np.int32)
            for k, (rows, keys) in enumerate(keys_at_marks(b.column(b.schema.get_field_index("w")).to_pylist(), pairs, whole=True)):
                key[rows], kind[rows] = keys.view(np.int64), k
            yield pa.record_batch([*b.columns, pa.array(key), pa.array(kind)], names=[*b.schema.names, "key", "kind"])

    words = words.mapInArrow(keyed, T.StructType([*words.schema.fields, T.StructField("key", T.LongType()), T.StructField("kind", T.IntegerType())]))
    words = words.select("no", "spare", "n", "key", "kind", F.length("w").alias("size")).withColumn("held", F.count("*").over(Window.partitionBy("key")))
    rarer = Window.partitionBy("no").orderBy("held", F.desc("size"), "key", "n").rowsBetween(Window.unboundedPreceding, -1)
    words = kept(words.withColumn("filed", F.coalesce(F.sum("n").over(rarer), F.lit(0)) <= F.col("spare")).select("no", "n", "key", "kind", "filed"), f"{at}/words")
    rungs = known.filter("_k1 is not null").select("_t", F.posexplode(F.array("_s1", "_s2", "_s3")).alias("rung", "s"))
    equal = kept(rungs.groupBy("s").agg(*[F.min(F.when(F.col("rung") == k - 1, F.col("_t"))).alias(f"_t{k}") for k in (1, 2, 3)]), f"{at}/equal")
    asked = lambda k, s: F.xxhash64(F.lit(k), s)
    keys = words.select("key").union(words.filter("filed").select(F.col("key").bitwiseXOR(F.lit(FILED))))
    for k in (1, 2, 3):
        keys = keys.union(equal.filter(f"_t{k} is not null").select(asked(k, F.col("s"))))
    used = [pairs[r.kind] for r in words.select("kind").distinct().collect()]
    sent = texts.sparkSession.sparkContext.broadcast((filter_of(keys.distinct(), 2 * words.count() + 3 * equal.count()), used))

    def lists(rows: np.ndarray, keys: np.ndarray, left: np.ndarray) -> pa.Array:
        """Each row's distinct keys, for the rows that are left."""
        order = np.lexsort((keys, rows))
        rows, keys = rows[order], keys[order]
        new = np.append(True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1]))[: len(rows)]
        rows, keys = rows[new], keys[new]
        return pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(rows, left), len(rows)).astype(np.int32)), pa.array(keys.view(np.int64)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, used = sent.value
        for b in it:
            found = [(rows[i], keys[i]) for rows, keys in keys_at_marks([x or "" for x in b.column(4).to_pylist()], used) for i in [held_by(bits, keys)]]
            rows, keys = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, kind) for k, kind in ((0, np.int64), (1, np.uint64)))
            filed = held_by(bits, keys ^ np.uint64(FILED))
            stays, equal = np.zeros(len(b), bool), np.zeros((3, len(b)), bool)
            stays[rows[filed]] = True
            words = pa.array(stays)
            for k in range(3):
                equal[k, held_by(bits, b.column(5 + k).to_numpy().view(np.uint64))] = True
            left = np.flatnonzero(stays | equal.any(0))
            digests = [pc.if_else(pa.array(equal[k]), b.column(1 + k), None) for k in range(3)]
            cells = [c.take(pa.array(left)) for c in (b.column(0), *digests, pc.if_else(words, b.column(4), None))]
            on = stays[rows]
            yield pa.record_batch([*cells, lists(rows[on], keys[on], left), lists(rows[filed], keys[filed], left)], names=[*b.schema.names[:5], "_keys", "_filed"])

    own = with_digests(cleaned(texts, "_text")).select(digest(F.col("_text")).alias("_line"), "_s1", "_s2", "_s3", "_k3", *[asked(k, F.col(f"_s{k}")).alias(f"_q{k}") for k in (1, 2, 3)])
    longs = T.ArrayType(T.LongType())
    own = kept(own.mapInArrow(run, T.StructType([*own.schema.fields[:5], T.StructField("_keys", longs), T.StructField("_filed", longs)])), f"{at}/lines")
    hit = lambda t, rung: F.struct(t["title_no"].alias("title_no"), F.lit(rung).alias("rung"), t["title"].alias("title"))
    rung = lambda k: F.coalesce(F.col(f"_s{k}") == F.col("s"), F.lit(False)).alias(f"is{k}")
    same = own.withColumn("s", F.explode(F.array_distinct(F.array("_s1", "_s2", "_s3")))).filter("s is not null").select("_line", "s", rung(1), rung(2), rung(3)).distinct()
    same = same.join(equal, "s").select("_line", F.least(*[F.when(F.col(f"is{k}") & F.col(f"_t{k}").isNotNull(), hit(F.col(f"_t{k}"), k)) for k in (1, 2, 3)]).alias("_hit")).filter("_hit is not null")
    few = F.when(F.size("_keys") <= MOST_KEYS, F.col("_keys")).alias("_keys")
    titles = several.join(words.groupBy("no").agg(F.collect_list(F.struct("key", "n")).alias("keys")), "no")
    met = own.select("_line", few, F.explode("_filed").alias("key")).distinct().join(words.filter("filed").select("key", "no"), "key").drop("key").join(titles, "no")
    likely = F.size("main") - sums(F.col("keys"), lambda x: F.when(F.array_contains("_keys", x["key"]), 0).otherwise(x["n"])) >= F.size("main") * threshold
    lines = own.filter(F.size("_filed") > 0).select("_line", "_k3").distinct().select("_line", X.split_title_words(F.col("_k3")).alias("_ws"))
    got = F.size(F.filter("main", lambda w: F.exists("_ws", lambda t: F.contains(t, w))))
    alike = met.filter(F.col("_keys").isNull() | likely).select("_line", "_t", "main").join(lines, "_line").filter(got >= F.size("main") * threshold).select("_line", hit(F.col("_t"), 4).alias("_hit"))
    return same.union(alike).groupBy("_line").agg(F.min("_hit").alias("_hit"))


#: Titles, and characters of theirs, that are sent to all tasks at most; beyond, lines and titles are joined.
MOST_TITLES, MOST_CHARS = 200_000, 20_000_000


def with_hits(lines: DataFrame, text: str, titles: DataFrame, threshold: float = 0.7, shown: str = "title", most_titles: int = MOST_TITLES) -> DataFrame:
    """Adds _hit(title_no, rung, title) to lines(doc_id, pos, ...): the first of titles(title_no, title) that a line's text matches by any rung; null if none does.

    Rungs, on cleaned text in lower case: 1 equal; 2 equal without leader and page; 3 equal
    without number; 4 a title of several words (cut at hyphens and middle dots) of which
    `threshold` are parts of the line's words. Each text is cleaned once, and where titles are few enough, lines are not shuffled.
    shown: the column that the hit's title is taken from. threshold: over a half, so that a match takes a word with a mark, and a line without any mark has none.
    """
    if threshold <= 0.5:
        raise ValueError("the threshold must be over 0.5")
    known = cleaned(titles.select("title_no", "title", F.col(shown).alias("_shown")), "title").withColumn("_t", F.struct("title_no", F.col("_shown").alias("title")))
    main = F.filter("_ws", lambda w: F.length(w) > 1)
    # of titles of the same words the first is enough; where one word, which stands in the middle then, makes a match alone, the others don't count
    middle = lambda m: F.get(m, F.floor(F.size(m) / 2).cast("int"))
    alone = lambda m: F.when(F.size(F.filter(m, lambda w: w == middle(m))) >= F.size(m) * threshold, F.array(middle(m))).otherwise(m)
    first = lambda known: known.filter((F.size("_ws") > 1) & (F.size(main) > 0)).select("_t", F.array_sort(main).alias("main")).groupBy(alone(F.col("main")).alias("main")).agg(F.min("_t").alias("_t"))
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("title") + F.length("_shown")), F.lit(0)).alias("chars")).first()
    if size.n > most_titles or size.chars > MOST_CHARS:
        spark, at = lines.sparkSession, scratch(lines.sparkSession, "titles")
        known = kept(with_digests(known).select("_t", "_k1", "_s1", "_s2", "_s3", "_ws"), f"{at}/known")
        hits = kept(by_keys(lines.select(F.col(text).alias("_text")), known, first(known), threshold, at), scratch(spark, "hits"))
        removed(spark, at)
        # rows without a text are spread by their place
        line = F.coalesce(digest(F.col(text)), F.hex(F.xxhash64("doc_id", "pos")).cast("binary"))
        return lines.withColumn("_line", line).join(hits, "_line", "left").select(*lines.columns, "_hit")
    own = by_automaton(cleaned(lines, text), first(known), threshold)
    for k in (1, 2, 3):
        equal = known.groupBy(F.col(f"_k{k}").alias(f"_q{k}")).agg(F.min("_t").alias(f"_h{k}"))
        own = own.join(F.broadcast(equal), F.col(f"_k{k}") == F.col(f"_q{k}"), "left")
    hit = F.least(*[F.when(F.col(f"_h{k}").isNotNull(), F.struct(F.col(f"_h{k}.title_no").alias("title_no"), F.lit(k).alias("rung"), F.col(f"_h{k}.title").alias("title"))) for k in (1, 2, 3, 4)])
    return own.select(*lines.columns, hit.alias("_hit"))


def match_titles_fuzzy(lines: DataFrame, titles: DataFrame, threshold: float = 0.7, most_titles: int = MOST_TITLES) -> DataFrame:
    """Adds title_no, title and rung of the first title that matches (see with_hits()) to lines(doc_id, pos, text, ...), null where none does."""
    out = with_hits(lines, "text", titles, threshold, most_titles=most_titles)
    return out.withColumns({c: F.col(f"_hit.{c}") for c in ("title_no", "title", "rung")}).drop("_hit")


def match_titles_exact(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds title_no and title: equal when normalised, else when both lose a leading number of one or two digits (or 0 before) and the space after it.

    Titles of one normalised form are one title: it stands where the first does, and the last gives its text. Of
    several forms that are equal without their numbers, the one that stands first is taken.
    """
    bare = lambda c: F.regexp_replace(c, r"(?U)^0?\d{1,2}\s+", "")
    forms = titles.withColumn("_a", X.normalize_title(F.col("title"))).filter("_a <> ''")
    forms = forms.groupBy("_a").agg(F.struct(F.min("title_no").alias("title_no"), F.max_by("title", "title_no").alias("title")).alias("_a_t"))
    loose = forms.groupBy(bare(F.col("_a")).alias("_b")).agg(F.min_by("_a_t", "_a_t.title_no").alias("_b_t"))
    own = lines.withColumn("_a", X.normalize_title(F.col("text"))).withColumn("_b", bare(F.col("_a")))
    out = own.join(forms, "_a", "left").join(loose, "_b", "left")
    hit = F.coalesce("_a_t", "_b_t")
    return out.withColumns({"title_no": hit["title_no"], "title": hit["title"]}).select(*lines.columns, "title_no", "title")


#: Numbers that a title in a table of contents may begin with.
TOC_NUMBER = r"(?U)^[\s>-]*(?:\d{2}\.|\([0-9]+\)|[IVX]+\.|[A-Z]\.)\s*"


def match_toc_headings(els: DataFrame, toc: DataFrame, near: float = 0.1) -> DataFrame:
    """Elements that a table of contents names: same page, its title in their text (with or without its leading number), and about its place."""
    title = X.squeeze(F.col("title"))
    rest = F.regexp_replace(title, TOC_NUMBER, "")
    t = toc.select(F.col("doc_id").alias("_d"), F.col("target_page").alias("_p"), F.lower(F.when(rest == "", title).otherwise(rest)).alias("_t"), F.col("x").alias("_x"))
    place = F.coalesce(F.abs(F.col("x1") - F.col("_x")) < near, F.lit(True))
    return els.join(t, (els["doc_id"] == t["_d"]) & (els["page"] == t["_p"]) & F.contains(F.lower(X.squeeze(F.col("text"))), F.col("_t")) & place, "left_semi")


def match_repeating_bands(blocks: DataFrame, bands: DataFrame, near: float = 0.02, band: float = 0.1) -> DataFrame:
    """blocks(doc_id, pos, y1, y2, places as shares of the page) -> doc_id, page, pos, side of those in an outer tenth within `near` of a band's own height.

    bands: of repeating_blocks(). Heights are dealt to cells `near` wide: of each cell the
    lowest and the highest band tell for the neighbouring cells, so no document's bands are compared pair by pair.
    """
    cell = F.floor(F.col("at") / near)
    known = bands.withColumn("cell", F.floor(F.col("y_rel") / near)).groupBy("doc_id", "side", "cell").agg(F.min("y_rel").alias("_lo"), F.max("y_rel").alias("_hi"))
    sides = F.array(F.struct(F.lit("top").alias("side"), F.when(F.col("y1") < band, F.col("y1")).alias("at")), F.struct(F.lit("bottom").alias("side"), F.when(F.col("y2") > 1 - band, F.col("y2")).alias("at")))
    own = blocks.select("doc_id", "page", "pos", F.explode(sides).alias("s")).select("doc_id", "page", "pos", "s.side", "s.at").filter("at is not null")
    own = own.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    hit = (F.abs(F.col("at") - F.col("_lo")) < near) | (F.abs(F.col("at") - F.col("_hi")) < near)
    return own.join(known, ["doc_id", "side", "cell"]).filter(hit).select("doc_id", "page", "pos", "side").distinct()
