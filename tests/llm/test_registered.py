"""The registered queries on the given tables: SQL twins, whole tables, the pipeline against its stages' rules."""

import duckdb
import pytest

import corpus_pipeline
from snaplake.llm import workload

from .conftest import SF
from .test_decontaminate import brute as contamination
from .test_repeats import covered
from .test_simhash import labels, print_of

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", workload.ORACLES)
def test_query_equals_its_sql(workers, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    relation = con.execute(workload.ORACLES[name])
    names = [d[0] for d in relation.description]
    df = workload.QUERIES[name](workers, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(relation.fetchall(), key=repr)


@pytest.mark.parametrize("name", workload.QUERIES)
def test_every_row_is_answered(workers, name):
    df = workload.QUERIES[name](workers, SF)
    number = int(name[2:].split("_")[0])
    source, key = ("pages", "page_id") if number == 6 else ("conversations", "conv_id") if number > 10 else ("documents", "doc_id")
    ids = {r[0] for r in workers.read.parquet(f"{SF}/{source}.parquet").select(key).collect()}
    if number == 12:
        ids.add(-1)
    found = {r[0] for r in df.select(key).collect()}
    assert found <= ids if number == 13 else found == ids


def test_pipeline_stages(workers):
    import numpy as np

    docs = workers.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing",
    ]
    held = [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(stage(workers, held[-1], SF).cache())
    start, good, unlike, unrepeated, clean, packed = ([tuple(r) for r in df.collect()] for df in held)
    assert all(df.columns == docs.columns for df in held[:-1])
    known = {r.doc_id: r.quality for r in workers.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in good}
    assert np.mean([(r[0] in kept) == (known[r[0]] == 1) for r in start if r[0] in known]) > 0.95
    good.sort()
    label = labels(np.array([print_of(r[1]) for r in good], np.uint64))
    assert sorted(unlike) == [r for k, r in enumerate(good) if label[k] == k]
    unlike.sort()
    texts = [(r[0], r[1]) for r in unlike]
    cut = [bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore") for b, gone in covered(texts)]
    assert sorted(unrepeated) == [(*r[:1], t, *r[2:4], len(t)) for r, t in zip(unlike, cut, strict=True)]
    items = [(r.item_id, r.text) for r in workers.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(clean) == sorted(r for r in unrepeated if not contamination([r[:2]], items)[0][5])
    assert {r[0] for r in packed} == {r[0] for r in clean}


def test_pipeline_runs(workers):
    assert corpus_pipeline.run(workers, SF).count() > 0
