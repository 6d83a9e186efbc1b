"""Texts whose chunks don't meet, among others that do: encoded whole, as the library does."""

import base64
import hashlib

import public_tokenizers
import tiktoken

from tests.llm.test_llm_operators import prose
from tickforge.llm import bpe


def test_texts_whose_chunks_do_not_meet(spark):
    import random

    rng = random.Random(1)
    texts = ["x" * 40_000, prose(rng, 9000), "é" * 30_000 + " tail", None, "short", prose(rng, 9000), "x" * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_digests(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = plain.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
