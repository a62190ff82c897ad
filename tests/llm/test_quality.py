import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaplake.llm import quality as q

from .conftest import SF


def test_held_out_accuracy(workers):
    docs, labels = (workers.read.parquet(f"{SF}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = q.score_documents(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    good, bad = ([r.score for r in held if r.quality == y] for y in (1, 0))
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert np.mean([[x > y for y in bad] for x in good]) > 0.97


def test_odd_rows(workers, make_docs, small_rows):
    labels = workers.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (5, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    docs = make_docs(small_rows, extra=True)
    got = q.score_documents(docs.drop("score"), labels).collect()
    assert len(got) == len(small_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    empty = {r.score for r in got if r.doc_id in (900, 901, 902)}
    assert len(empty) == 1
    none = q.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert q.score_documents(make_docs([]), labels).count() == 0


def test_sample_is_bounded_and_votes_are_exact(workers, make_docs, small_rows):
    labels = workers.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = q.train(make_docs(small_rows), labels, sample=50)
    assert len(model.labels) == 50
    rng = np.random.default_rng(0)
    x = rng.poisson(0.2, (20, q.WORDS + q.SHAPES)).astype(np.float32)
    z = model.weighted(x) @ model.projection
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for got, cosine in zip(model.score(x), z @ model.vectors.T, strict=True):
        near = np.argsort(-cosine, kind="stable")[: q.NEIGHBOURS]
        weight = np.maximum(cosine[near], 1e-6) ** q.POWER
        assert got == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), abs=1e-4)


def test_keep_good(workers, make_docs, small_rows):
    labels = workers.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = make_docs(small_rows, extra=True)
    model = q.train(docs, labels)
    kept = q.keep_good(docs, model)
    want = docs.select("doc_id", "text").join(q.score(docs, model).where("predicted = 1").select(F.col("doc_id").alias("i")).distinct(), F.expr("doc_id <=> i"))
    assert kept.schema == docs.schema
    assert kept.count() == want.count()
