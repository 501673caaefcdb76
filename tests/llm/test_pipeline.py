"""The pipeline on a small corpus with planted cases."""

import random
import shutil

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "and", "er", "ing", "on", "re"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        t = text(rng.randint(40, 90))
        if i % 4 == 3:
            t = " ".join(w + "***" for w in t.split())
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(i % 4 != 3), 0))
    item = text(25)
    rows += [(300, rows[0][1], "en", "s", 1), (301, rows[0][1] + " more", "en", "s", 1), (302, text(30) + " " + item + " " + text(20), "en", "s", 1), (303, "1 2 3", "en", "s", 5)]
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    cols, ids = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, at)
        docs.write.parquet(f"{at}/out{k}")
        docs = spark.read.parquet(f"{at}/out{k}")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == cols
    junk = {i for i in range(240) if i % 4 == 3}
    assert len(junk & ids[0]) < 4 and len(ids[0] - junk) > 170
    assert 303 not in ids[1]
    assert ids[1] - ids[2] == {300, 301} & ids[1]
    assert 302 in ids[2] and ids[2] - ids[3] == {302}
    assert ids[4] == ids[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, at).collect()} == ids[4]
    shutil.rmtree(at)


def test_odd_tables(spark, tmp_path):
    """Null ids, texts and labels; repeated rows; clashing column names; then empty tables."""
    at, cols = str(tmp_path), "doc_id long, text string, lang string, source string, n_chars long, v int, d string, o long, _h int, h long, key string, class_id long"
    extra = (1, "x", 2, 3, 4, "k", 5)
    rows = [(None, "the one text of a null id that stands here and there", "en", None, None, *extra), (1, None, "en", "s", 0, *extra), (2, "", None, "s", 0, *extra), (3, "again and again the same row of words", "en", "s", 9, *extra), (3, "again and again the same row of words", "en", "s", 9, *extra)]
    rows += [(10 + k, f"some words of the document number {k} and of no other one {k * k} here", "en", "s", 50, *extra) for k in range(12)]
    for name, data, schema in (("documents", rows, cols), ("labels", [(None, 1, 0), (3, None, None), (10, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, None), (None, ""), (2, "no such item")], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == [c.split()[0] for c in cols.split(", ")]
    left = [r.doc_id for r in docs.collect()]
    assert left.count(3) == 1 and 1 not in left and 2 not in left and None in left
    assert {r.doc_id for r in corpus_pipeline.run(spark, at).collect()} == set(left)
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{at}/{name}.parquet")
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{at}/e/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{at}/e").count() == 0
