import zlib

import numpy as np

from provenant.llm import quality

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, score string"


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op10_quality(docs, labels)
    assert got.count() == docs.count()
    t = got.join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(t.doc_id, t.held_out))
    t = t[t.held_out]
    assert auc(t.score.to_numpy(), t.quality.to_numpy()) > 0.9
    assert (t.predicted == t.quality).mean() > 0.9


def test_column_equals_numpy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 300
    t = quality.with_features(docs.select("doc_id", "text")).select("__q_.*", model.column().alias("s")).toPandas()
    assert np.allclose(model.score(t[list(quality.FEATURES)].to_numpy()), t.s, atol=1e-12)


def test_statistics(spark):
    text = "Ab, cd!! É 12.\nab\tAb, cd!! É 12.\n\n"
    row = quality.with_features(spark.createDataFrame([(1, text), (2, None), (3, "  ")], "doc_id long, text string")).orderBy("doc_id").select("__q_.*").collect()
    one = row[0].asDict()
    assert one["chars"] == len(text) and one["words"] == 9
    assert one["upper"] == 4 / 12 and one["digits"] == 4 / len(text) and one["marks"] == 4 / 9 and one["stops"] == 2 / 9
    assert all(v == (k == "distinct_lines") for k, v in row[1].asDict().items())
    assert row[2].words == 0


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, None, None, "a"), (1, "", "x", "b"), (None, "Some text here.", "x", None), (4, "word " * 200_000, "x", "c")]
    docs = spark.createDataFrame(rows, DOCS)
    got = quality.op10_quality(docs, labels).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    assert quality.keep_quality(docs, labels).columns == docs.columns
    assert quality.keep_quality(docs, labels).count() == 4
    assert quality.op10_quality(spark.createDataFrame([], DOCS), labels).count() == 0
    odd = spark.createDataFrame([(1, None, 0), (1, 1, None), (1, 0, 1), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.op10_quality(docs, odd).count() == 4
