"""Quality by co-training: two views of a document teach each other.

The text view is a logistic regression on hashed words (square roots of counts, length
1). The metadata view is one on the document's record and page layout (language, source,
size, line and word statistics, shares of kinds of characters), each number cut at the
sample's quantiles. Two targets are learned apart on these views: quality 1, and not toxic.

Both views start from labelled rows. In each round, each view labels a pool of unlabelled
rows, and its surest ones, as many good as bad, join the other view's training set
at half weight. Then each view's logit is calibrated on labelled rows kept apart (Platt),
and a logistic combination of the two, fitted on the same rows, scores every document.
A score is the product of both targets' probabilities. Either target rejects: quality below
0.35 (which keeps nearly all good ones), or a probability of not being toxic below that
which all but 1 % of the kept-apart good documents reach.

Labelled rows: up to `per_stratum` of each (quality, toxic), those lowest by a hash of the
id; rows weigh as their stratum does in all labels. That bound is the only sampling. The
unlabelled rows are all others: each round looks for its surest ones in another part of
them, dealt by a hash, so that the rounds go through the whole table, and every document
is scored, from its whole text. Views are computed once, into a table; one task trains
on the bounded sample, and the driver sees models alone.

Defined cases: null or empty text has neither words nor lines and is scored as such; null
labels, labels without a document and null ids are not learned from; several labels of
a document count as the worst of them; a target whose labels are all alike takes no part,
and without any all scores are 0.5 and accepted; an empty table gives no rows; more columns are ignored or kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, in_one_task, newton, remove_steps, sigmoid, steps, written

WORDS, BINS, NUMBERS = 1 << 17, 12, 26
SYMBOLS = np.zeros(128, bool)
SYMBOLS[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~/"]] = True
STRIP = re.compile(r"^\W+|\W+$")


def text_view(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words, counts)."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=len(words) > 200)
    at, n = np.unique((h >> np.uint64(47)).astype(np.int32), return_counts=True)
    return at, n.astype(np.uint32)


def meta_view(text: str, words: list[str], counts: np.ndarray, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Numbers of the record and the layout."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    low = np.bincount(raw, minlength=256).astype(np.float64)
    lines = [x for x in text.split("\n") if x.strip()]
    n, total = max(len(words), 1), max(len(raw), 1)
    lengths = np.array([*map(len, words)] or [0], np.float64)
    upper = low[65:91].sum()
    letters = upper + low[97:123].sum() + low[128:].sum() / 2
    per_line = np.array([*map(len, lines)] or [0], np.float64)
    return np.array([
        np.log1p(n_chars if n_chars is not None else len(text)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), lengths.max(), per_line.mean(), per_line.std(),
        upper / max(letters, 1), low[48:58].sum() / total, low[33:127][SYMBOLS[33:127]].sum() / n, low[ord("!")] / n, low[ord("|")] / n, low[ord(".")] / n, low[ord(",")] / n, low[ord("*")] / n, low[ord("#")] / n,
        low[128:].sum() / total, len(counts) / n, counts.max(initial=0) / n, 1 - len(set(lines)) / max(len(lines), 1), max(Counter(lines).values(), default=0) / max(len(lines), 1),
        low[10] / n, low[32] / total, zlib.crc32((lang or "").encode()) % 64, zlib.crc32((source or "").encode()) % 64,
    ], np.float32)


def views(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed words, their counts, numbers)."""
    text = text or ""
    words = text.split()
    at, n = text_view([STRIP.sub("", w) or w for w in text.lower().split()] if words else [])
    return at, n, meta_view(text, words, n, lang, source, n_chars)


def text_rows(at: list[bytes], n: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashed words, values: square roots of counts, length 1) of each text."""
    out = []
    for a, c in zip(at, n, strict=True):
        v = np.sqrt(np.frombuffer(c, np.uint32).astype(np.float32))
        out.append((np.frombuffer(a, np.int32), v / np.float32(max(np.sqrt(np.dot(v, v)), 1e-9))))
    return out


def numbers(meta: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(meta), np.float32).reshape(-1, NUMBERS).astype(np.float64)


class Sparse:
    """Logistic regression on rows of (indices, values), by Adagrad over shuffled batches."""

    def __init__(self, size: int, l2: float, rate: float, epochs: int):
        self.size, self.l2, self.rate, self.epochs = size, l2, rate, epochs

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray) -> Sparse:
        rng = np.random.default_rng(5)
        w, b, g2, gb = np.zeros(self.size), 0.0, np.full(self.size, 1e-8), 1e-8
        weight = weight / weight.mean()
        for _ in range(max(self.epochs, 400 * 32 // max(len(rows), 1))):  # 400 batches at least
            order = rng.permutation(len(rows))
            for k in range(0, len(order), 32):
                part = order[k : k + 32]
                at = np.concatenate([rows[i][0] for i in part])
                v = np.concatenate([rows[i][1] for i in part])
                row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
                err = weight[part] * (sigmoid(np.bincount(row, w[at] * v, len(part)) + b) - y[part])
                ids, inv = np.unique(at, return_inverse=True)
                g = np.bincount(inv, err[row] * v, len(ids)) / len(part) + self.l2 * w[ids]
                g2[ids] += g * g
                w[ids] -= self.rate * g / np.sqrt(g2[ids])
                e = err.mean()
                gb += e * e
                b -= self.rate * e / np.sqrt(gb)
        self.w, self.b = w.astype(np.float32), b
        return self

    def logit(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([self.w[at] @ v + self.b for at, v in rows])


class Binned:
    """Numbers cut at quantiles, each bin an indicator."""

    def __init__(self, x: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.base = np.cumsum([0, *[len(c) + 1 for c in self.cuts]])

    def rows(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        at = np.stack([b + np.searchsorted(c, v, side="right") for b, c, v in zip(self.base, self.cuts, x.T, strict=False)], axis=1)
        one = np.full(at.shape[1], 1 / np.sqrt(at.shape[1]), np.float32)
        return [(r, one) for r in at]


Picked = list[tuple[int, float, tuple, np.ndarray]]  # view that learns, label, text row, numbers


class CoTrained:
    """Two views, trained on labelled rows and on those that the other view has picked; calibrated and combined."""

    def __init__(self, texts: list, metas: np.ndarray, y: np.ndarray, weight: np.ndarray, picked: Picked = (), words: tuple[float, float] = (1e-6, 4.0)):
        self.ready = len(y) >= 8 and 0 < y.mean() < 1
        if not self.ready:
            return
        self.bins = Binned(metas)
        m = self.bins.rows(metas)
        test = np.arange(len(y)) % 4 == 3  # kept apart for calibration
        if len(set(y[test])) < 2 or len(set(y[~test])) < 2:
            test = np.zeros(len(y), bool)
        train = np.flatnonzero(~test)
        sets = [([texts[i] for i in train], y[train].tolist(), weight[train].tolist()), ([m[i] for i in train], y[train].tolist(), weight[train].tolist())]
        for view, label, text, meta in picked:
            rows, ys, ws = sets[view]
            rows.append(text if view == 0 else self.bins.rows(meta[None])[0])
            ys.append(label)
            ws.append(float(np.mean(weight)) / 2)
        makes = Sparse(WORDS, *words, 14), Sparse(int(self.bins.base[-1]), 1e-5, 1.0, 25)
        self.text, self.meta = (c.fit(rows, np.array(ys, float), np.array(ws)) for c, (rows, ys, ws) in zip(makes, sets, strict=True))
        self.held = held = np.flatnonzero(test) if test.any() else np.arange(len(y))
        z = self.logits([texts[i] for i in held], metas[held])
        self.platt = [newton(z[:, k : k + 1], y[held], weight[held]) for k in (0, 1)]
        self.both = newton(z, y[held], weight[held])

    def logits(self, texts: list, metas: np.ndarray) -> np.ndarray:
        return np.stack([self.text.logit(texts), self.meta.logit(self.bins.rows(metas))], axis=1)

    def score(self, texts: list, metas: np.ndarray) -> np.ndarray:
        """(text view, metadata view, both): probabilities of good."""
        if not self.ready or not texts:
            return np.full((len(texts), 3), 0.5)
        z = self.logits(texts, metas)
        one = [sigmoid(z[:, k] * p[0] + p[1]) for k, p in enumerate(self.platt)]
        return np.stack([*one, sigmoid(z @ self.both[:2] + self.both[2])], axis=1)


class Judge:
    """Co-trained targets: quality 1, and not toxic, which rarer words decide (a slower, more regular text view)."""

    def __init__(self, texts: list, metas: np.ndarray, fine: np.ndarray, clean: np.ndarray, weight: np.ndarray, picked: tuple[Picked, Picked] = ((), ())):
        self.fine = CoTrained(texts, metas, fine, weight, picked[0])
        self.clean = CoTrained(texts, metas, clean, weight, picked[1], words=(1e-4, 1.0))
        self.least_clean = 0.0
        if self.clean.ready:
            held = [i for i in self.clean.held if fine[i] and clean[i]]
            if held:
                p = self.clean.score([texts[i] for i in held], metas[held])[:, 2]
                order = np.argsort(p)
                lost = np.cumsum(weight[held][order]) / weight[held].sum()
                self.least_clean = float(p[order][np.searchsorted(lost, 0.01, side="right")])

    def score(self, texts: list, metas: np.ndarray) -> np.ndarray:
        """(text view, metadata view, both: probabilities of good; quality, not toxic: those of each target)."""
        fine, clean = (t.score(texts, metas) if t.ready else np.ones((len(texts), 3)) for t in (self.fine, self.clean))
        good = fine * clean if self.fine.ready or self.clean.ready else np.full((len(texts), 3), 0.5)
        return np.column_stack([good, fine[:, 2], clean[:, 2]])

    def accepted(self, s: np.ndarray, least: float) -> np.ndarray:
        return (s[:, 3] >= least) & (s[:, 4] >= self.least_clean)


COLS = ("text", "lang", "source", "n_chars")
VIEWS = ("at", "n", "meta")


def record(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("long" if c == "n_chars" else "string") for c in COLS])


def prepared(docs: DataFrame, whole: bool) -> DataFrame:
    """A table of the documents' views: struct v(doc_id, o, at, n, meta), beside all columns of docs if whole; o: hash of id and text."""
    rows = record(docs).columns
    apart = whole and isinstance(docs.schema["text"].dataType, T.StringType)  # the text is in d, and need not go to Python twice
    own = [c for c in rows if not (apart and c == "text")]
    given = docs.select(F.struct(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("o"), *[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in own]).alias("v"), *([F.struct(*docs.columns).alias("d")] if whole else []))
    kind = pa.struct([("doc_id", pa.int64()), ("o", pa.int64()), ("at", pa.binary()), ("n", pa.binary()), ("meta", pa.binary())])

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for k in range(0, big.num_rows, 500):
                b = big.slice(k, 500)
                v = pa.RecordBatch.from_struct_array(b.column("v"))
                text = pc.struct_field(b.column("d"), "text") if apart else v.column("text")
                made = [[x.tobytes() for x in views(*row)] for row in zip(text.to_pylist(), *(v.column(c).to_pylist() for c in COLS[1:]), strict=True)]
                cols = [v.column("doc_id"), v.column("o"), *(pa.array([x[i] for x in made], pa.binary()) for i in range(3))]
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(cols, fields=list(kind)), *(b.column(c) for c in b.schema.names[1:])], names=b.schema.names)

    out = T.StructType([T.StructField(f.name, T.LongType() if f.type == pa.int64() else T.BinaryType()) for f in kind])
    return written(given.mapInArrow(work, T.StructType([T.StructField("v", out), *given.schema.fields[1:]])), "views")


def surest(part: DataFrame, model: Judge, most: int) -> DataFrame:
    """Of a part of the table the `most` surest texts by each (target, view, label): list, at, n, meta. Each task sends its own surest only; equal texts count once."""
    known = part.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("list", pa.int32()), ("z", pa.float64()), ("o", pa.int64()), *[(c, pa.binary()) for c in VIEWS]])

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[tuple, tuple]] = {k: {} for k in range(8)}
        targets = [t for t in (known.value.fine, known.value.clean)]
        for b in it:
            o, at, n, meta = (b.column(c).to_pylist() for c in ("o", *VIEWS))
            texts, metas = text_rows(at, n), numbers(meta)
            for t, target in enumerate(targets):
                if not target.ready:
                    continue
                z = target.logits(texts, metas)
                for view in (0, 1):
                    order = np.argsort(z[:, view], kind="stable")
                    for label, some in ((0, order[: 4 * most]), (1, order[::-1][: 4 * most])):
                        own = best[4 * t + 2 * view + label]
                        for i in some.tolist():
                            if abs(z[i, view]) > 1 and (z[i, view] > 0) == bool(label):
                                own.setdefault((at[i], n[i]), (-abs(float(z[i, view])), o[i], at[i], n[i], meta[i]))
                        if len(own) > most:
                            best[4 * t + 2 * view + label] = dict(sorted(own.items(), key=lambda x: x[1][:2])[:most])
        yield from batches(((k, *row) for k, own in best.items() for row in own.values()), schema)

    found = part.select("v.o", *[f"v.{c}" for c in VIEWS]).mapInArrow(work, "list int, z double, o long, at binary, n binary, meta binary")
    found = found.withColumn("same", F.xxhash64("at", "n")).dropDuplicates(["list", "same"])
    for keys in (["list", F.pmod("same", F.lit(64))], ["list"]):  # first within parts of a list
        found = found.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("z", "o"))).filter(F.col("k") <= most)
    return found.select("list", "o", *VIEWS)


def fit(table: DataFrame, labels: DataFrame, per_stratum: int = 2500, rounds: int = 4, most: int = 60) -> Judge:
    """table: of prepared(). The broadcast sample has four strata of about 1.3 per_stratum ids each at most."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("toxic").cast("int")).dropna(subset=["doc_id", "quality"])
    own = own.groupBy("doc_id").agg((F.min("quality") == 1).cast("int").alias("q"), (F.coalesce(F.max("toxic"), F.lit(0)) != 0).cast("int").alias("t"))
    counts = {(r.q, r.t): r.n for r in own.groupBy("q", "t").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = F.lit(0.0)
    for (q, t), n in counts.items():
        share = F.when((F.col("q") == q) & (F.col("t") == t), min(1.0, (1.3 * per_stratum + 20) / n)).otherwise(share)
    picked = own.filter(place < share * (1 << 20))
    rows = table.select("v.doc_id", "v.o", *[f"v.{c}" for c in VIEWS]).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "o"])
    columns = [F.lit(-1).alias("list"), "q", "t", "o", *VIEWS]
    spark, at = table.sparkSession, steps("fit")
    sample = written(rows.select(*columns), f"{at}/sample")
    empty = F.lit(None).cast("int")

    def train(it: Iterator[pa.RecordBatch]) -> Judge:
        seen: dict[tuple, int] = {}
        kept, given = [], ([], [])
        for b in it:
            for k, q, t, at, n, meta in zip(*(b.column(c).to_pylist() for c in ("list", "q", "t", *VIEWS)), strict=True):
                if k >= 0:  # target, teacher and label are the list's bits
                    given[k >> 2].append((1 - (k >> 1 & 1), float(k & 1), text_rows([at], [n])[0], numbers([meta])[0]))
                elif seen.get((q, t), 0) < per_stratum:
                    seen[q, t] = seen.get((q, t), 0) + 1
                    kept.append((q, t, at, n, meta))
        weight = np.array([counts[q, t] / seen[q, t] for q, t, *_ in kept])
        fine, clean = np.array([float(r[0]) for r in kept]), np.array([1.0 - r[1] for r in kept])
        return Judge(text_rows([r[2] for r in kept], [r[3] for r in kept]), numbers([r[4] for r in kept]), fine, clean, weight, given)

    learned = sample
    for r in range(rounds + 1):
        model = in_one_task(learned, ["list", "o", "at"], train)
        if r == rounds or not (model.fine.ready or model.clean.ready):
            remove_steps(spark, at)
            return model
        part = table.join(F.broadcast(own_ids(picked)), F.col("v.doc_id") == F.col("labelled"), "left_anti").filter(F.pmod("v.o", F.lit(rounds)) == r)
        more = surest(part, model, most).select("list", empty.alias("q"), empty.alias("t"), "o", *VIEWS)
        learned = learned.unionByName(written(more, f"{at}/picked"))


def own_ids(picked: DataFrame) -> DataFrame:
    return picked.select(F.col("doc_id").alias("labelled"))


def scores(model: Judge, v: pa.RecordBatch, block: int = 2000) -> np.ndarray:
    at, n, meta = (v.column(c).to_pylist() for c in VIEWS)
    out = [np.zeros((0, 5))]
    for k in range(0, len(at), block):
        out.append(model.score(text_rows(at[k : k + block], n[k : k + block]), numbers(meta[k : k + block])))
    return np.concatenate(out)


def classify(table: DataFrame, model: Judge, least: float = 0.35) -> DataFrame:
    """A table of prepared() -> doc_id, text_score, meta_score, score, accepted."""
    known = table.sparkSession.sparkContext.broadcast(model)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = scores(known.value, b)
            yield pa.record_batch([b.column(0), *[pa.array(s[:, k], pa.float64()) for k in range(3)], pa.array(known.value.accepted(s, least), pa.bool_())], names=["doc_id", "text_score", "meta_score", "score", "accepted"])

    return table.select("v.doc_id", *[f"v.{c}" for c in VIEWS]).mapInArrow(work, "doc_id long, text_score double, meta_score double, score double, accepted boolean")


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.35, **params) -> DataFrame:
    """The accepted rows of docs, all columns."""
    table = prepared(docs, True)
    known = docs.sparkSession.sparkContext.broadcast(fit(table, labels, **params))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok = known.value.accepted(scores(known.value, pa.RecordBatch.from_struct_array(b.column("v"))), least)
            yield b.select(["d"]).filter(pa.array(ok, pa.bool_()))

    return table.mapInArrow(work, T.StructType([table.schema["d"]])).select("d.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = prepared(spark.read.parquet(f"{sf_dir}/documents.parquet"), False)
    return classify(table, fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet")))
