"""Hierarchical language identification: family first, then one against one within it.

Features are hashed letter bigrams and trigrams (lower case, everything but letters is a
space), square roots of their shares in the whole text. A linear support vector machine
for each family against the rest picks the family; within it, one for each pair of its
languages votes. Families of learned languages come from the table below; a language
that it lacks is a family of its own.

Learning uses rows with a language whose crc32(doc_id as text) mod 5 is not 0: of each
language up to `per_lang` of them (at most `total` in all), those lowest by a hash of id
and text; that bound is the only sampling. One task trains on these. Prediction sees the text alone.

The score is the product of the two steps' sureness (a logistic function of the lead of
the best family over the next, and of the narrowest vote that the language has won) and
of a probability that the text is in the language at all: a logistic function of its
likeness to the language's mean vector and of its length. It is fitted on every fourth
sample row, kept apart from the machines: these rows and short cuts of them against
the same rows likened to the other languages' means (as if their own were not learned) and
rows with their letters shuffled. `keep` rejects below a threshold of the same rows: what
all but 1 in 100 of the whole texts among them reach, 0.1 at most.

Defined cases: text that is null or has no letter is `und` with score 0; null lang or
null doc_id is not learned from (a null id counts as held out: false); without any learned
language all is `und`; with one language all letters are its; repeated rows count once in
learning; an empty table gives no rows; more columns are ignored, or kept by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, in_one_task, keyed_crc, newton, sigmoid

DIM = 4096
#: Families of language codes.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "malayic": "id ms tl jv su",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_letters: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points in lower case, runs of other characters than letters as one space, with a space at both ends."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(1 << 16)]))
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters[0][np.minimum(code, 0xFFFF)]
    high = np.flatnonzero(code > 0xFFFF)
    if len(high):
        is_letter[high] = [chr(c).isalpha() for c in code[high].tolist()]
    x = np.where(is_letter, code, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of others
    return np.concatenate([[32], x[keep] if len(x) else x, [32]]).astype(np.uint32)


def features(text: str | None) -> tuple[np.ndarray, int] | None:
    """(a vector of length 1, letters and spaces), or None for a text without letters."""
    x = letters(text) if text else np.zeros(0, np.uint32)
    if len(x) < 3:
        return None
    two = x[:-1] * np.uint32(0x9E3779B1) ^ x[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) ^ x[2:] * np.uint32(0x27D4EB2F)
    at = np.concatenate([(two ^ two >> 15) * np.uint32(0x2C1B3C6D) >> 20, (three ^ three >> 15) * np.uint32(0x297A2D39) >> 20])
    return np.sqrt(np.bincount(at, minlength=DIM) / len(at)).astype(np.float32), len(x) - 2


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30, seed: int = 0) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, by dual coordinate descent; classes weigh the same. Rows of x are used as they stand: there is no copy."""
    rng = np.random.default_rng(seed)
    weight = np.where(y > 0, len(y) / 2 / max((y > 0).sum(), 1), len(y) / 2 / max((y < 0).sum(), 1))
    diag, q = 0.5 / (c * weight), np.einsum("ij,ij->i", x, x, dtype=np.float64) + 1
    w, bias, a = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(x))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = max(a[i] - (y[i] * (float(w @ x[i]) + bias) - 1 + diag[i] * a[i]) / (q[i] + diag[i]), 0.0)
            if new != a[i]:
                step = float((new - a[i]) * y[i])
                w += np.float32(step) * x[i]
                bias += step
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return np.append(w, np.float32(bias))


def likeness(cosine: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What tells a text of a language: its likeness to the mean, more so the longer it is."""
    size = np.log(np.maximum(n, 2))
    return np.stack([cosine, size, cosine * size], axis=1)


class Model:
    """Weights of all machines in one matrix; means of the languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.typical, self.least = None, 0.0
        own = np.array([self.langs.index(v) for v in langs], int)
        fam = [FAMILY.get(v.lower().split("-")[0], v) for v in self.langs]
        self.families = sorted(set(fam))
        self.of = np.array([self.families.index(f) for f in fam], int)
        ws = [svm(x, np.where(self.of[own] == f, 1.0, -1.0)) for f in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = [(a, b) for a, b in combinations(range(len(self.langs)), 2) if self.of[a] == self.of[b]]
        for a, b in self.pairs:
            m = (own == a) | (own == b)
            ws.append(svm(x[m], np.where(own[m] == a, 1.0, -1.0)))
        self.w = np.array(ws, np.float32).reshape(-1, DIM + 1)
        mean = np.array([x[own == k].mean(axis=0) for k in range(len(self.langs))], np.float32).reshape(-1, DIM)
        self.mean = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)

    def calibrate(self, x: np.ndarray, n: np.ndarray, langs: list[str | None], whole: np.ndarray) -> None:
        """Fits the probability of being in a language, and the threshold, on rows kept apart (whole: not cuts); lang None: junk."""
        if not self.langs or not len(x):
            return
        like = x @ self.mean.T
        own = np.array([self.langs.index(v) if v in self.langs else -1 for v in langs])
        good = own >= 0
        inside = like[good, own[good]]
        like[good, own[good]] = -1
        others = np.ones(len(x), bool) if len(self.langs) > 1 else ~good
        z = likeness(np.concatenate([inside, like[others].max(axis=1)]), np.concatenate([n[good], n[others]]))
        y = np.concatenate([np.ones(len(inside)), np.zeros(others.sum())])
        if not 0 < y.mean() < 1:
            return
        self.typical = newton(z, y, np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y), 1e-2)
        right = [s for (v, s), lang in zip(self.predict(x[whole], n[whole]), np.array(langs, object)[whole], strict=True) if v == lang]
        self.least = min(0.1, float(np.quantile(right, 0.01))) if right else 0.0

    def predict(self, x: np.ndarray, letters: np.ndarray) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(x)
        s = x @ self.w[:, :DIM].T + self.w[:, DIM]
        n, rows = len(self.families) if len(self.families) > 1 else 0, np.arange(len(x))
        sure = np.ones(len(x))
        fam = np.zeros(len(x), int)
        if n:
            fam = s[:, :n].argmax(axis=1)
            ranked = np.sort(s[:, :n], axis=1)
            sure = 1 / (1 + np.exp(-3 * (ranked[:, -1] - ranked[:, -2])))
        votes = np.where(self.of[None, :] == fam[:, None], 0.0, -1e9)
        narrow = np.full((len(x), len(self.langs)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = s[:, n + k]
            # a vote counts 1; the bounded margin decides ties
            votes[:, a] += (m >= 0) + np.tanh(m) / (4 * len(self.langs))
            votes[:, b] += (m < 0) - np.tanh(m) / (4 * len(self.langs))
            narrow[:, a], narrow[:, b] = np.minimum(narrow[:, a], m), np.minimum(narrow[:, b], -m)
        best = votes.argmax(axis=1)
        sure = sure / (1 + np.exp(-3 * np.minimum(narrow[rows, best], 50)))
        if self.typical is not None:
            z = likeness(np.einsum("ij,ij->i", x, self.mean[best]), letters)
            sure = sure * sigmoid(z @ self.typical[:-1] + self.typical[-1])
        return [(self.langs[b], float(p)) for b, p in zip(best, sure, strict=True)]


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(keyed_crc(col), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, per_lang: int = 800, total: int = 16_000) -> Model:
    """Learns from docs(doc_id, text, lang); reads no other column."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(np.zeros((0, DIM), np.float32), [])
    most = max(1, min(per_lang, total // len(counts)))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.3 * most / n + 20 / n))])
    some = own.withColumn("o", F.xxhash64("doc_id", "text")).filter(F.pmod("o", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).dropDuplicates(["doc_id", "o"])
    schema = pa.schema([("lang", pa.string()), ("o", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("x", pa.binary())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for b in it:
                for v, o, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    for kind, text in enumerate(variants(t, o)):
                        if (f := features(text)) is not None:
                            yield v, o, kind, f[1], f[0].astype(np.float16).tobytes()

        yield from batches(out(), schema)

    def train(it: Iterator[pa.RecordBatch]) -> Model:
        seen: dict[str, int] = {}
        sets: tuple = ([], [], [], []), ([], [], [], [])  # to learn from, kept apart: vectors, letters, languages, whole
        held = None
        for b in it:
            for v, o, kind, n, x in zip(*(b.column(c).to_pylist() for c in ("lang", "o", "kind", "n", "x")), strict=True):
                if kind == 0:
                    if seen.get(v, 0) >= most:
                        continue
                    seen[v] = seen.get(v, 0) + 1
                    held = o if seen[v] % 4 == 0 else None
                elif held != o:
                    continue  # cuts and junk are made of rows kept apart alone
                own = sets[held is not None]
                for known, value in zip(own, (np.frombuffer(x, np.float16), n, None if kind == 2 else v, kind == 0), strict=True):
                    known.append(value)
        matrix = lambda own: np.array(own[0], np.float32).reshape(-1, DIM)
        if len(set(sets[0][2])) < len(seen):  # so few rows of some language that those kept apart are needed
            for part, more in zip(*sets, strict=True):
                part += [x for x, own in zip(more, sets[1][3], strict=True) if own]
        model = Model(matrix(sets[0]), sets[0][2])
        model.calibrate(matrix(sets[1]), np.array(sets[1][1]), sets[1][2], np.array(sets[1][3], bool))
        return model

    made = some.select("lang", "o", "text").mapInArrow(rows, "lang string, o long, kind int, n long, x binary")
    return in_one_task(made.withColumn("place", F.pmod("o", F.lit(1 << 20))), ["place", "o", "lang", "kind"], train)


def variants(text: str, seed: int) -> Iterator[str]:
    """A text, a short cut of it, and (of some) such a cut, or the whole, with its letters shuffled."""
    yield text
    rng = np.random.default_rng(seed % 2**32)
    n = int(np.exp(rng.uniform(1, 6)))
    at = int(rng.integers(0, max(len(text) - n, 0) + 1))
    yield text[at : at + n]
    junk = text if rng.random() < 0.5 else text[at : at + n]
    yield "".join(np.array([*junk], object)[rng.permutation(len(junk))])


def predictions(model: Model, texts: list[str | None], block: int = 512) -> Iterator[tuple[str, float]]:
    for at in range(0, len(texts), block):
        fs = [features(t) for t in texts[at : at + block]]
        own = [f for f in fs if f is not None]
        known = iter(model.predict(np.stack([x for x, _ in own]), np.array([n for _, n in own])) if own else [])
        for f in fs:
            yield ("und", 0.0) if f is None else next(known)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((d, h, *p) for b in it for d, h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), predictions(known.value, b.column(2).to_pylist()), strict=True)), schema)

    cols = docs.select(F.col("doc_id").cast("long"), held_out(), F.col("text").cast("string"))
    return cols.mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float | None = None) -> DataFrame:
    """The rows, all columns, whose text has a language with a score of at least `least`, or the fitted threshold."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    least = model.least if least is None else least

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array([v != "und" and s >= least for v, s in predictions(known.value, b.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
