"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks of ``CHUNK`` characters that run ``OVERLAP`` characters into the next one. Chunks are rows
of their own, so the chunks of a long text are pre-tokenised in parallel, each from its own arbitrary start. Two
neighbours are stitched at the first pre-token boundary that both see in their overlap: the pattern looks ahead but
never back, so from a common boundary on they agree. Only boundaries after a letter or digit are used; there no
look-ahead of the piece before reaches across, and the piece can be encoded alone.

Each chunk is encoded where it is, as the pieces between its boundaries in the overlaps, and says how many ids come
before each of these. Only ids and boundaries are shuffled; a stitched text is the ids of its chunks between their
joints. Texts whose chunks don't resynchronise somewhere (a pre-token longer than the overlap) are found by their keys
and encoded whole. A text of up to ``CHUNK`` characters is one chunk without joints, and is finished where it is read.
Decoding looks up the bytes of the ids and concatenates them.

Defined cases: null and empty texts have no ids; repeated rows give repeated results; an empty table gives an empty
result; extra columns are dropped; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import KeyFilter, Scratch, row_key, table

CHUNK = 16_384
OVERLAP = 512
RANKS = "byte_bpe_50k.tiktoken"
DIGESTS = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS = pa.schema([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
PARTS = "doc_id long, key long, k int, ids array<int>, head array<int>, head_at array<int>, tail array<int>, tail_at array<int>"


@functools.cache
def load(ranks_path: str, pattern: str) -> tuple[tiktoken.Encoding, regex.Pattern, list[bytes], list[str]]:
    """The encoder of a rank file, the pattern, the bytes of each id and each id in decimal."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    return encoder, regex.compile(pattern), pieces, [str(i) for i in range(len(pieces))]


def boundaries(text: str, pattern: regex.Pattern, last: bool) -> list[int]:
    """Starts of pre-tokens in a chunk read from its own start, after a letter or digit. Near the end of a
    chunk that isn't the text's last, a pre-token may be cut short; what touches the end is left out."""
    ends = [m.end() for m in pattern.finditer(text)]
    return [0, *(e for e in ends if (last or e < len(text) - 1) and text[e - 1].isalnum())]


class Codec:
    """Encodes texts and chunk lists, decodes ids."""

    def __init__(self, ranks_path: str, pattern: str):
        self.encoder, self.pattern, self.pieces, self.decimal = load(ranks_path, pattern)

    def encode(self, text: str) -> list[int]:
        return self.encoder.encode_ordinary(text)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def part(self, text: str, k: int, n_chunks: int) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
        """(ids, head, head_at, tail, tail_at) of a chunk: its boundaries within the overlap with the chunk before, and
        with the chunk after (from its start), each with the number of ids before it."""
        at = boundaries(text, self.pattern, k == n_chunks - 1)
        head, tail = [x for x in at if x <= OVERLAP] if k else [], [x for x in at if x >= CHUNK] if k < n_chunks - 1 else []
        cuts = sorted({0, len(text), *head, *tail})
        ids: list[int] = []
        before = {0: 0}
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids += self.encode(text[a:b])
            before[b] = len(ids)
        return ids, head, [before[x] for x in head], [x - CHUNK for x in tail], [before[x] for x in tail]

    def stitch(self, parts: list[tuple]) -> list[int] | None:
        """The ids of a text from its chunks (as ``part`` gives them) in order; null if two of them don't meet."""
        start, out = 0, []
        for k, (ids, _, _, tail, tail_at) in enumerate(parts):
            if k == len(parts) - 1:
                return out + ids[start:]
            head, head_at = parts[k + 1][1:3]
            common = set(tail) & set(head)
            if not common:
                return None
            joint = min(common)
            end = tail_at[tail.index(joint)]
            if end < start:
                return None
            out += ids[start:end]
            start = head_at[head.index(joint)]
        return out

    def finish(self, ids: list[list[int]], wanted: pa.Schema) -> list[pa.Array]:
        """The wanted columns for the ids of some texts."""
        cols: list[pa.Array] = [pa.array([len(x) for x in ids], pa.int64())]
        if "ids" in wanted.names:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids]) if ids else np.zeros(0, dtype=np.int32)
            return [*cols, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
        of_ids = [hashlib.sha256(" ".join(map(self.decimal.__getitem__, x)).encode()).hexdigest() for x in ids]
        return [*cols, pa.array(of_ids, pa.string()), pa.array([hashlib.sha256(self.decode(x)).hexdigest() for x in ids], pa.string())]


def _whole(ranks_path: str, pattern: str, wanted: pa.Schema) -> Callable:
    """Texts of one chunk: encoded at once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks_path, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *codec.finish(ids, wanted)], ["doc_id", *wanted.names])

    return each


def _encoded_parts(ranks_path: str, pattern: str) -> Callable:
    """Chunks of long texts, encoded where they are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks_path, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                cols = [batch.column(c).to_pylist() for c in ("text", "k", "n_chunks")]
                found = [pa.array(c, pa.list_(pa.int32())) for c in zip(*(codec.part(*x) for x in zip(*cols, strict=True)), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "k")), *found], ["doc_id", "key", "k", "ids", "head", "head_at", "tail", "tail_at"])

    return each


def _stitched(ranks_path: str, pattern: str, wanted: pa.Schema) -> Callable:
    """Parts sorted by key and number: one row per text, as often as the text is repeated; without n_tokens where its
    chunks don't meet."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks_path, pattern)
        held: dict[int, tuple] = {}
        key, doc_id, copies = None, None, 0

        def done() -> pa.RecordBatch:
            ids = codec.stitch([held[k] for k in sorted(held)])
            cols = codec.finish([ids or []] * copies, wanted)
            if ids is None:
                cols = [pa.nulls(copies, pa.int64()), *cols[1:]]
            return pa.RecordBatch.from_arrays([pa.array([doc_id] * copies, pa.int64()), pa.array([key] * copies, pa.int64()), *cols], ["doc_id", "key", *wanted.names])

        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in ("key", "k", "doc_id", "ids", "head", "head_at", "tail", "tail_at")], strict=True):
                if row[0] != key:
                    if held:
                        yield done()
                    held, key, doc_id, copies = {}, row[0], row[2], 0
                copies += row[1] == 0
                held[row[1]] = row[3:]
        if held:
            yield done()

    return each


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, key, k, n_chunks, text: the overlapping chunks of every text. Input: doc_id, text, not null."""
    last = F.ceil(F.length("text") / CHUNK).cast("int") - 1
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(F.col("text"), k * CHUNK + 1, F.lit(CHUNK + OVERLAP)))
    out = docs.select("doc_id", row_key().alias("key"), (last + 1).alias("n_chunks"), F.posexplode(cut).alias("k", "text"))
    return out.select("doc_id", "key", "k", "n_chunks", "text")


def _encoded(docs: DataFrame, wanted: pa.Schema, ranks: str) -> DataFrame:
    path, pattern = public_tokenizers.path(ranks), public_tokenizers.PATTERN
    kinds = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    schema = ", ".join(["doc_id long", *(f"{f.name} {kinds[f.type]}" for f in wanted)])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > CHUNK
    out = texts.where(~long).mapInArrow(_whole(path, pattern, wanted), schema)
    parts = chunked(texts.where(long)).mapInArrow(_encoded_parts(path, pattern), PARTS).repartition("key").sortWithinPartitions("key", "k")
    scratch = Scratch(docs.sparkSession, "bpe")
    stitched = scratch.put(parts.mapInArrow(_stitched(path, pattern, wanted), schema.replace("doc_id long", "doc_id long, key long", 1)))
    out = out.unionByName(stitched.where("n_tokens IS NOT NULL").drop("key"))
    apart = scratch.put(stitched.where("n_tokens IS NULL").select("key").distinct())
    if apart.isEmpty():
        return out
    # a filter of fixed size leaves the few texts to join, so that the others aren't shuffled
    keyed = texts.where(long).withColumn("key", row_key()).mapInArrow(_passing(KeyFilter(apart)), "doc_id long, text string, key long")
    return out.unionByName(keyed.join(apart, "key", "left_semi").drop("key").mapInArrow(_whole(path, pattern, wanted), schema))


def _passing(wanted: KeyFilter) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.has(np.asarray(batch.column("key")))))

    return each


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids."""
    return _encoded(docs, IDS, ranks)


def encode_digests(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """One row per document: doc_id, the number of ids, their digest and the digest of the bytes decoded from them."""
    return _encoded(docs, DIGESTS, ranks)


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and the bytes of the ids, concatenated as ``data``; null ids are empty."""
    path, pattern = public_tokenizers.path(ranks), public_tokenizers.PATTERN

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            data = [codec.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(each, "doc_id long, data binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
