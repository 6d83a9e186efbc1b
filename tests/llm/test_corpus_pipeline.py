"""The corpus pipeline on a small table: every stage's decisions take effect on what the next one reads."""

from collections import Counter

import pytest

import corpus_pipeline
from tickforge.llm import bpe, mixing, near_dup, quality_rules, secrets
from tickforge.llm.common import Scratch

from .test_llm_operators import SCHEMA, fixture_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = fixture_rows()
    key = "token = 0123456789abcdef0123456789abcdef"
    rows.append((500, " ".join(f"v{i}" for i in range(80)) + " " + key, "en", "a", 1, None, None, None))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_in_order():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "secret_scans", "mixing", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None


def test_run_equals_the_composition(spark, folder):
    scratch = Scratch(spark, "composed")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = scratch.put(quality_rules.filter_quality(docs))
    kept = {r["doc_id"] for r in quality_rules.quality_report(docs).collect() if r["kept"]}
    assert {r["doc_id"] for r in good.collect()} == kept
    one = scratch.put(near_dup.keep_first(good, words=5))
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in near_dup.near_dup_report(good, words=5).collect() if r["kept"]}
    clean = scratch.put(secrets.redact(one))
    assert "0123456789abcdef" not in " ".join(r["text"] for r in clean.collect()) and clean.columns == docs.columns
    mixed = scratch.put(mixing.mix(clean))
    codec = bpe.Codec(bpe.public_tokenizers.path(bpe.RANKS), bpe.public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], tuple(codec.encode(r["text"]))) for r in mixed.collect())
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want and got
