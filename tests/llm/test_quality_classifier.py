import numpy as np
from pyspark.sql import functions as F
import zlib

from lexloom.llm import quality_classifier
from lexloom.llm.queries import op6_quality

D = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    rows = op6_quality(spark, D).collect()
    assert len(rows) == spark.read.parquet(f"{D}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.score, r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum(p == y for _, p, y in held) / len(held) > 0.88


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("quality", quality_classifier.F.when(quality_classifier.held_out(), 1 - quality_classifier.F.col("quality")).otherwise(quality_classifier.F.col("quality")))
    a, b = quality_classifier.fit(docs, labels), quality_classifier.fit(docs.drop("lang", "source"), flipped)
    texts = [b"", b"Some plain words. " * 40, b"a### b%%% c$$$ " * 30]
    assert (a.score(texts) == b.score(texts)).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, "fine words here. " * 30, "x"), (2, None, "y"), (None, "z", "z"), (2, "", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None), (3, 7)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.score(docs, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    none = quality_classifier.fit(docs.limit(0), labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), model).collect() == []


def test_scores_match_naive_neighbours(spark):
    """Every cosine by itself, the nearest by sorting, their votes by a loop."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    some = docs.filter("doc_id < 120").unionByName(docs.filter("doc_id < 1").withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit(None).cast("string")}))
    texts = {r.doc_id: (r.text or "").encode() for r in some.collect()}
    for r in quality_classifier.score(some, model, keep=["doc_id"]).collect():
        z = (quality_classifier.vectors([texts[r.doc_id]])[0].astype(float) * model.weight) @ model.axes
        z /= max(np.linalg.norm(z), 1e-9)
        cosines = [float(z @ model.known[:, j]) for j in range(model.known.shape[1])]
        least = sorted(cosines)[-quality_classifier.NEAREST]
        near = [(c, j) for j, c in enumerate(cosines) if c >= least - 1e-9]
        votes = [(max(c, 0.05) ** 8 * model.value[j], model.label[j]) for c, j in near]
        assert abs(r.score - sum(v * y for v, y in votes) / sum(v for v, _ in votes)) < 2e-3


def test_words_are_features():
    a, b = quality_classifier.features([b"alpha beta", b"gamma beta"])
    assert (a[: quality_classifier.TERMS] != b[: quality_classifier.TERMS]).any()
