"""The queries against their SQL, and the pipeline's stages against brute force."""

import re
from pathlib import Path

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from tests_helpers import brute_near, brute_lines, rows_of
from tokenizers import Tokenizer

from hertzlake.llm import pii, quality
from hertzlake.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, folder, name):
    db = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found, twin = queries()[name](spark, folder), db.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(twin.columns)
    assert rows_of(found.columns, map(tuple, found.collect())) == rows_of(twin.columns, twin.fetchall())


@pytest.mark.parametrize("name", sorted(x for x in set(queries()) - set(oracle_sql()) if x.startswith("op")))  # all have a row a document
def test_query_returns_every_document(spark, folder, name):
    found = [r.doc_id for r in queries()[name](spark, folder).select("doc_id").collect()]
    ids = [r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()]
    assert sorted(set(found) if "packing" in name else found) == sorted(ids)  # packing has a row a piece


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    at = {name: stage for name, stage in corpus_pipeline.STAGES}
    assert [re.sub("[^a-z0-9]+", "", n.lower()) for n in at] == ["qualityclassifier", "linededup", "minhashneardedup", "pii", "bestfitpacking"]
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    first = at["quality classifier"](spark, docs, folder).cache()
    kept = {r.doc_id for r in quality.classify_quality(docs).collect() if r.kept}
    assert first.columns == docs.columns and text(first) == {k: v for k, v in text(docs).items() if k in kept}
    second = at["line dedup"](spark, first, folder).cache()
    ids = sorted(text(first))
    assert second.columns == docs.columns and text(second) == dict(zip(ids, brute_lines([text(first)[k] for k in ids], 10)))
    assert all(r.n_chars == len(r.text) for r in second.collect())
    third = at["minhash near-dedup"](spark, second, folder).cache()
    assert third.columns == docs.columns and set(text(third)) == brute_near(text(second))
    fourth = at["pii"](spark, third, folder).cache()
    assert fourth.columns == docs.columns and text(fourth) == {k: pii.redact(v, pii.find_spans(v)) for k, v in text(third).items()}
    last = at["best-fit packing"](spark, fourth, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {k: len(tokenizer.encode(v, add_special_tokens=False).ids) + 1 for k, v in text(fourth).items()}
    assert {k: sum(r.length for r in last if r.doc_id == k) for k in tokens} == tokens
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in last)


def test_pipeline_of_odd_rows(spark, folder, tmp_path):
    good = "The quiet river bends around the old mill, and the miller counts his sacks every evening before supper."
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, line string"
    rows = [(1, good), (1, good), (2, good + " Then he sleeps."), (3, None), (4, ""), (None, good), (None, good), (5, "\n\n"), (6, " ".join(f"{good[k % 60 :]} {k}" for k in range(900)))]
    docs = spark.createDataFrame([(i, t, None, None, None, None, "x") for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = quality.classify_quality(docs).filter("kept").collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in kept} - {2}  # 2 is near 1
    assert sum(r.doc_id is None for r in found) == 2 and sum(r.doc_id == 1 for r in found) == 2
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
