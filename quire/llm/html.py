"""Main text of web pages: structure where pages have it, a host suffix array where they don't.

A page is cut into blocks (block-level elements), each with its place: in a container
marked as boilerplate (nav, header, footer, aside, form, advert, notice, comments and the
like, by element, role, class or id), in an article, a main part or a content container,
or loose. Marked containers go, inline ones (buttons, adverts) with them; a header inside an
article or main part keeps its headings. What lies in the page's innermost kind of container stays.

Between the two the host's token streams decide: over the blocks of an outer container
(a title in the main part, beside the article) and, on pages without any container, over all
that isn't marked. Streams are concatenated, dealt to chunks of bounded size, and a
suffix array (prefix doubling, ordered by the first RUN tokens) finds the runs of RUN tokens
or more in each chunk, which cover every longer repeat; equal runs of the chunks are then
summed up over the host with the smallest and largest page they are on. Pages with equal
text are one. Runs on distinct pages are boilerplate: blocks that they cover by half go,
the unique runs stay. A page of which nothing would be left is a copy, and keeps its blocks.

Runs inside an article are not removed, for article passages that several pages share
are text to keep whole; nor are unique runs in marked containers kept. These are the departures from covering everything.

Defined cases: null or empty html gives an empty text; a null url or one without host has
the host ''; null page_id is kept; repeated rows are one page as far as runs go, and rows of their own in the result; an
empty table gives no rows; more columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, mix64, written

RUN = 8
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
STOP = re.compile(r"""[>"']""")
DIGITS = re.compile(r"&#([0-9]{9,})")
ATTR = re.compile(r"""([\w:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
DROP = frozenset("nav header footer aside form head button select menu dialog svg math canvas object audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class or id that mark boilerplate containers.
MARKS = frozenset(  # a name of these and NEUTRAL words alone
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar"
    " footer bottombar sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login"
    " search share sharing social related recommended comment comments commentlist disqus respond reply replies pagination pager toolbar skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond ad ads advert related".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
#: Of these, words that mark a container in whatever name they stand.
SURE = (COMMENTS | frozenset("advertisement advertising adsense sponsored navbar navigation breadcrumb breadcrumbs sidebar sidebars cookie cookies gdpr newsletter pagination popup modal".split())) - {"related", "ad", "ads", "advert"}
#: Words beside a mark that leave it one.
NEUTRAL = frozenset("site page top bottom left right main global primary secondary box bar block area container wrapper wrap inner outer list section links link items item group unit slot posts articles stories form content text image big small mobile desktop sticky fixed js is has".split())
CONTENT = frozenset("article content post entry story articlebody".split())
WORD = re.compile(r"[^\W_]+")


def place(tag: str, attrs: str) -> tuple[bool, int]:
    """(boilerplate, kind of container: 3 article, 2 main, 1 content, 0 none) of an element."""
    own = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)} if attrs.strip() else {}
    kind = 3 if tag == "article" else 2 if tag == "main" or own.get("role") == "main" or own.get("itemprop") == "articleBody" else 0
    tokens = [WORD.findall(t) for k in ("class", "id") for t in own.get(k, "").lower().split()]
    names = {w for t in tokens for w in t}
    marked = bool(names & SURE) or any(set(t) & MARKS and all(w in MARKS or w in NEUTRAL or w[0].isdigit() for w in t) for t in tokens)
    if kind == 3 or tag in ("html", "body", "main"):
        return tag != "body" and tag != "html" and marked and bool(names & COMMENTS) or "hidden" in own, kind
    bad = tag in DROP or marked or own.get("role") in ROLES or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "")
    return bad, kind or (1 if names & CONTENT else 0)


def decoded(text: str) -> str:
    """Character references decoded; a number of any length is one, though Python reads short ones only."""
    if "&" not in text:
        return text
    return unescape(DIGITS.sub(lambda m: f"&#{x}" if len(x := m[1].lstrip("0") or "0") < 9 else "&#999999999", text))


class Tags:
    """The tags of a page. Each place is looked at a bounded number of times, however broken the page is."""

    def __init__(self, html: str):
        self.html, self.last, self.ends = html, html.rfind(">"), {}  # ends: for a quote or > outside of quotes, the > that ends its tag, or -1

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at a place: the first > outside of quotes, or, if quotes are left open, the first of all."""
        path, goal, k = [], -1, at
        while m := STOP.search(self.html, k):
            s = m.start()
            if s in self.ends:
                goal = self.ends[s]
                break
            path.append(s)
            if m[0] == ">":
                goal = s
                break
            k = self.html.find(m[0], s + 1) + 1
            if not k:
                break
        self.ends.update(dict.fromkeys(path, goal))
        return goal if goal >= 0 else self.html.find(">", at)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, is an end tag, name, attributes) of the first tag from a place on; comments and declarations have no name."""
        html = self.html
        while (b := html.find("<", at)) >= 0:
            if html.startswith("<!--", b):
                e = html.find("-->", b + 4)
                return b, len(html) if e < 0 else e + 3, False, "", ""
            if b > self.last:  # nothing but a comment can begin where no > follows
                at = html.find("<!--", b)
                if at < 0:
                    return None
                continue
            if html.startswith(("<!", "<?"), b):
                return b, html.find(">", b) + 1, False, "", ""
            if m := TAG.match(html, b):
                e = self.end(m.end())
                return b, e + 1, bool(m[1]), m[2].lower(), html[m.end() : e]
            at = b + 1
        return None


def blocks(html: str) -> list[tuple[str, bool, int]]:
    """(text, in boilerplate, kind of container) of each block, in page order."""
    out: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, int, int, int]] = []  # element, what holds inside it, and where its text begins if it is inline boilerplate
    open_: dict[str, list[int]] = {}  # places on the stack of the open elements of each name
    open_blocks: list[int] = []  # and of all block elements
    parts: list[str] = []
    tags = Tags(html)
    bad, kind, at, size = 0, 0, 0, len(html)  # bad: 1 in the header of an article or main part alone, whose headings are text; 2 in other boilerplate

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((text, bad > 0, kind))

    def pop() -> None:
        nonlocal bad, kind
        name, _, _, cut = stack.pop()
        open_[name].pop()
        if name in BLOCK:
            open_blocks.pop()
        if cut >= 0:
            del parts[cut:]
        bad, kind = stack[-1][1:3] if stack else (0, 0)

    while at < size:
        found = tags.next(at)
        if not found:
            parts.append(decoded(html[at:]))
            break
        begin, after, closes, tag, attrs = found
        if begin > at:
            parts.append(decoded(html[at:begin]))
        at = after
        if not tag:
            continue
        if not closes and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}", re.I).search(html, at)
            at = html.find(">", end.end()) + 1 if end else 0
            at = at or size
            continue
        if tag in BLOCK:
            flush()
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if closes:
            if open_.get(tag):
                if tag not in BLOCK and open_blocks and open_blocks[-1] > open_[tag][-1]:
                    continue  # an inline end tag doesn't close blocks
                flush() if tag in BLOCK else None
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            if tag in BLOCK and open_.get("p") and stack and stack[-1][0] == "p":
                pop()
            b, k = place(tag, attrs)
            level = 0 if not b else 1 if tag == "header" and kind >= 2 else 2
            held = 0 if tag in HEADING and bad == 1 else bad
            bad, kind = max(held, level), max(kind, k)
            open_.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                open_blocks.append(len(stack))
            stack.append((tag, bad, kind, len(parts) if level == 2 and tag not in BLOCK else -1))
    flush()
    return out


def main_text(html: str | None) -> tuple[str | None, list[str], list[bool], list[str]]:
    """(main text, if its innermost kind of container is all there is; else null, and the blocks in question with whether that container protects them; all other blocks)."""
    all_ = blocks(html or "")
    best = max((k for _, bad, k in all_ if not bad), default=0)
    # without a container all that isn't marked is in question; with one, what lies in an outer container only
    asked = [(t, bool(best) and k == best) for t, bad, k in all_ if not bad and (k or not best)]
    if all(own for _, own in asked):
        return "\n".join(t for t, _ in asked), [], [], [t for t, bad, k in all_ if bad or k != best]
    return None, [t for t, _ in asked], [own for _, own in asked], [t for t, bad, k in all_ if bad or not best or k != best]


def token_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def suffix_runs(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of concatenated streams in the order of the first `run` (a power of two) tokens.

    (starts in that order; rank of each, equal for equal runs). A suffix that its page's
    end cuts off before `run` tokens has a rank of its own.
    """
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    h = 1
    while h < run:
        ahead = np.full(n, -1, np.int64)
        same = page[h:] == page[:-h] if h < n else np.zeros(0, bool)
        ahead[: n - h][same] = rank[h:][same]
        pair = rank * (n + 2) + ahead + 1
        _, rank = np.unique(pair, return_inverse=True)
        h *= 2
    whole = np.zeros(n, bool)
    if n >= run:
        whole[: n - run + 1] = page[run - 1 :] == page[: n - run + 1]
    rank = np.where(whole, rank, n + np.arange(n))
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


def run_hashes(tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    """A name for the run of `run` tokens that starts at each token."""
    n = len(tokens) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, run, np.uint64)
    for k in range(run):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n])
    return out


def chunk_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """A chunk (host, page, rest) of a host's pages -> host, run, lo, hi: each distinct run with its smallest and largest page."""
    streams = [token_hashes("\n".join(x)) for x in pdf.rest]
    tokens = np.concatenate([*streams, np.zeros(0, np.uint64)])
    page = np.repeat(pdf.page.to_numpy(np.int64), [len(s) for s in streams])
    row = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    if len(tokens) < RUN:
        return pd.DataFrame({"host": [], "run": [], "lo": [], "hi": []})
    order, rank = suffix_runs(tokens, row)
    starts = np.flatnonzero(np.diff(rank, prepend=-1))
    lo, hi = (f.reduceat(page[order], starts) for f in (np.minimum, np.maximum))
    ok = rank[starts] < len(tokens)
    names = run_hashes(tokens)
    return pd.DataFrame({"host": pdf.host.iloc[0], "run": names[order[starts[ok]]].view(np.int64), "lo": lo[ok], "hi": hi[ok]})


def unique_blocks(asked: list[str], protected: list[bool], known: set[int]) -> str:
    """The blocks that are protected, or that boilerplate runs cover by less than half; all, if nothing would be left: such a page is a copy."""
    streams = [token_hashes(t) for t in asked]
    tokens = np.concatenate([*streams, np.zeros(0, np.uint64)])
    hit = np.zeros(len(tokens) + 1, np.int64)
    for at, name in enumerate(run_hashes(tokens).view(np.int64).tolist()):
        if name in known:
            hit[at] += 1
            hit[at + RUN] -= 1
    covered = np.cumsum(hit[:-1]) > 0
    ends = np.cumsum([len(s) for s in streams])
    kept = [t for t, own, s, e in zip(asked, protected, streams, ends, strict=True) if own or not len(s) or covered[e - len(s) : e].mean() < 0.5]
    return "\n".join(kept or asked)


def parsed(pages: DataFrame) -> DataFrame:
    """pages -> page_id, url, host, page (hash of all its text), row, text (null if undecided), loose, own, rest."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("loose", pa.list_(pa.string())), ("own", pa.list_(pa.bool_())), ("rest", pa.list_(pa.string()))])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((i, u, *main_text(h)) for b in it for i, u, h in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)), schema)

    cols = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    out = cols.mapInArrow(rows, "page_id long, url string, text string, loose array<string>, own array<boolean>, rest array<string>")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return out.withColumns({"host": host, "page": F.xxhash64("text", "loose", "rest"), "row": F.monotonically_increasing_id()})


def extract(pages: DataFrame, chunk: int = 2000, chunk_chars: int = 16_000_000) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars.

    chunk, chunk_chars: about how many pages and characters of a host one task concatenates; larger hosts are dealt to several by the page's hash.
    """
    table = written(parsed(pages), "pages")
    done = table.filter("text is not null").select("page_id", "url", "text")
    todo = table.filter("text is null")
    chars = F.aggregate("rest", F.lit(0).cast("long"), lambda n, t: n + F.length(t))
    sizes = table.groupBy("host").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum(chars) / chunk_chars)).cast("int").alias("parts"))
    # only hosts of several chunks are looked up; while they are few, without moving the pages of a host together
    large = written(sizes.filter("parts > 1"), "hosts")
    large = F.broadcast(large) if large.count() <= 100_000 else large
    dealt = table.filter("size(rest) > 0").select("host", "page", "rest").join(large, "host", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("page"), F.coalesce("parts", F.lit(1))))
    runs = dealt.select("host", "part", "page", "rest").groupBy("host", "part").applyInPandas(chunk_runs, "host string, run long, lo long, hi long")
    shared = runs.groupBy("host", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("host", "run")
    shared = written(shared, "runs")
    if todo.isEmpty():
        out = done
    else:
        own = pa.schema([("row", pa.int64()), ("host", pa.string()), ("run", pa.int64())])

        def names(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from batches(((r, h, x) for b in it for r, h, l in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for x in set(run_hashes(token_hashes("\n".join(l))).view(np.int64).tolist())), own, 50_000)

        hits = todo.select("row", "host", "loose").mapInArrow(names, "row long, host string, run long").join(shared, ["host", "run"]).groupBy("row").agg(F.collect_set("run").alias("known"))
        kept = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

        def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from batches(((i, u, unique_blocks(l, o, set(k or ()))) for b in it for i, u, l, o, k in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True)), kept)

        rest = todo.join(hits, "row", "left").select("page_id", "url", "loose", "own", "known").mapInArrow(keep, "page_id long, url string, text string")
        out = done.unionByName(rest)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
