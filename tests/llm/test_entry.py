"""The registered queries and the pipeline's stages on the smallest tables."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from quern.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    known = __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in known)] == []
    assert known["pipeline"] is corpus_pipeline.run and set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_sql_twin(spark, key):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[key](spark, SF)
    want = con.sql(queries.SQL[key])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(repr, want.select(*columns).fetchall()))


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 3:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    before = {r.doc_id: r.text for r in seen["toxicity"]}
    classes = {}
    for r in seen["simhash_near_dedup"]:
        classes[r.doc_id] = r.text
    assert set(classes) <= set(before) and len({before[i] for i in classes}) == len(classes)  # no exact copies are left
    first = {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in sorted(classes.items())}
    for i, w in words.items():
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for r in seen["substring_dedup"]:
        w = words[r.doc_id]
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < r.doc_id:
                gone[j : j + 13] = [True] * 13
        assert r.text == (" ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else classes[r.doc_id])
        assert r.n_chars == len(r.text)
    assert {r.doc_id for r in seen["packing"]} == set(classes)
    assert sum(r.length for r in seen["packing"]) == max(r.sequence_id * 2048 + r.offset + r.length for r in seen["packing"])
