"""Registered corpus queries against their SQL, and the pipeline stage by stage."""

import zlib

import duckdb
import numpy as np
import pytest
from test_corpus_operators import brute_near, library

import corpus_pipeline
from trialweave.llm import langid, queries
from trialweave.llm.line_dedup import ORACLE

SF = "/root/testdata/sf0.001"


def rows(x):
    return sorted(map(repr, x))


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql(spark, name):
    for t in ("documents", "pages"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = duckdb.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert rows(tuple(r[c] for c in order) for r in got.collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "packing"]
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < 3:
            assert kept[-1].columns == docs.columns
    judged = {r.doc_id: r.rejected for r in langid.language_id(docs).collect()}
    assert {r.doc_id for r in kept[1].collect()} == {i for i, r in judged.items() if not r}
    documents = kept[1].toPandas()
    got = {r.doc_id: r.text for r in kept[2].collect()}
    con = duckdb.connect()
    con.register("documents", documents)
    assert got == {r[0]: r[3] for r in con.sql(ORACLE).fetchall()}
    assert all(r.n_chars == len(r.text) for r in kept[2].collect())
    near = brute_near([(r.doc_id, r.text) for r in kept[2].collect()])
    assert {r.doc_id for r in kept[3].collect()} == {i for i, (_, root) in near.items() if i == root}
    texts, pieces, tool, held = {r.doc_id: r.text for r in kept[3].collect()}, {}, library(), {}
    for r in kept[4].collect():
        pieces[r.doc_id, r.start] = (r.length, r.ids_crc32)
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    want = {}
    for i, text in texts.items():
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 0]
        want |= {(i, k): (len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)}
    assert pieces == want and max(held.values()) <= 2048 and len(held) <= 1.02 * -(-sum(held.values()) // 2048) + 1
    assert corpus_pipeline.run(spark, SF).count() == kept[4].count()


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []
