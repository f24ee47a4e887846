"""The pipeline's stages on a small table, each against a brute-force version of its decision."""

import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from brute_llm import components

import __spark_entry__ as entry
import corpus_pipeline
from tickloom.llm import decontaminate, language, mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    columns = before.columns
    tables = [before]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, tables[-1], SF).write.parquet(path)
        tables.append(spark.read.parquet(path))
    for table in tables[:-1]:
        assert table.columns == columns
    rows = [t.collect() for t in tables]
    for a, b in zip(rows, rows[1:], strict=False):
        assert not Counter(tuple(r)[:5] for r in b) - Counter(tuple(r)[:5] for r in a)
    # Language: what goes has no letter or no likely language.
    kept = {r.doc_id for r in rows[1]}
    model = language.fit_languages(before.where(~language.held_out("doc_id", 5, 0)))
    for r in rows[0]:
        (lang,), (score,) = language.score_texts(pa.array([r.text]), model)
        assert (r.doc_id in kept) == (lang != "und" and score >= 0.3)
    # Near copies: one row a component.
    want = {c for _, _, c in components([(r.doc_id, r.text) for r in rows[1]])}
    assert {r.doc_id for r in rows[2]} == want and len(rows[2]) == len(want)
    # Benchmark: whole items that stand in a text.
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    clean = {r.doc_id for r in rows[3]}
    for r in rows[2]:
        if any(i[:-1] in r.text for i in items):
            assert r.doc_id not in clean
    gone = spark.createDataFrame([(r.doc_id, r.text) for r in rows[2] if r.doc_id not in clean], "doc_id long, text string").collect()
    words = [set(i.lower().split()) for i in items]
    assert all(max(len(w & set(r.text.lower().split())) for w in words) >= decontaminate.RUN - 3 for r in gone)
    # Mixing: the drawn rows are those below their probability.
    drawn = mixing.mixed(tables[3], mixing.dimensions(), budget=mixing.KEEP, repeats=False).collect()
    assert {r.doc_id for r in rows[4]} == {r.doc_id for r in drawn if r._sampled}
    assert sum(r._tokens * r._probability for r in drawn) == pytest.approx(mixing.KEEP * sum(r._tokens for r in drawn), rel=1e-6)
    # Sharding: every row, gapless slots.
    assert Counter(r.doc_id for r in rows[5]) == Counter(r.doc_id for r in rows[4])
    for s in {r.shard for r in rows[5]}:
        assert sorted(r.slot for r in rows[5] if r.shard == s) == list(range(sum(r.shard == s for r in rows[5])))


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name in ("op3_ngram_jaccard_join", "op5_warc", "op8_exact_top_k", "op9_line_dedup", "op10_substring_dedup", "op11_hard_negatives", "op13_license_scan"):
        cursor = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert Counter(tuple(r) for r in entry.queries()[name](spark, SF).select(*names).collect()) == Counter(cursor.fetchall()), name


def test_query_columns(spark):
    q = entry.queries()
    rows = q["op1_sharding"](spark, SF).collect()
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None} and {r.shard for r in rows} == set(range(16))
    text = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    assert {"op1_sharding", "op2_template_decontamination", "op4_quality_rules", "op6_language_id", "op7_mixing_to_targets", "op12_whitening", "pipeline"} <= set(q)
