"""Language identification with hyperdimensional profiles.

Every letter has a pseudorandom vector of ``DIM`` values +1 and -1. The vector of a letter trigram binds its three
letter vectors, each permuted (rotated) by its place, through elementwise multiplication. A document bundles (sums)
the vectors of all its trigrams, a language those of its learning documents, each brought to length 1. The
prediction is the language whose prototype has the largest cosine with the document.

Texts are lower-cased; everything but letters counts as one blank between words. Prototypes are learned from about
``SAMPLE`` documents a language, chosen by a hash of the id at a rate that follows from the number of documents of
the language (all of them where there are fewer); predictions are made for every document.

Defined cases: null texts and texts without letters are ``und`` with score 0, as is everything when no language could
be learned; ties go to the least language; a cosine below 0 scores 0; repeated rows are predicted each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import table
from tickforge.llm.rolling import mix64

DIM = 1024
SAMPLE = 4000
FOLDS, HELD_OUT = 4, 2
#: Characters encoded at a time, so that memory doesn't depend on the batches.
SLICE_CHARS = 400_000


@functools.lru_cache(maxsize=4096)
def letter_vector(code: int) -> np.ndarray:
    """The +1/-1 vector of a letter, from its code point."""
    seed = mix64(np.array([code + 1], dtype=np.uint64))
    words = mix64(seed + np.arange(DIM // 64, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """One row per trigram code (three code points of 21 bits)."""
    mask = np.uint64(0x1FFFFF)
    out = np.ones((len(grams), DIM), dtype=np.int8)
    for place in range(3):
        codes = (grams >> np.uint64(21 * (2 - place))) & mask
        found, at = np.unique(codes, return_inverse=True)
        out *= np.stack([np.roll(letter_vector(int(c)), 2 - place) for c in found])[at]
    return out


@functools.lru_cache(maxsize=200_000)
def _class(ch: str) -> int:
    return ord(ch) if ch.isalpha() else 32


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, trigram) with counts, over the lower-cased letters of some texts."""
    joined = "\x00".join(texts).lower() if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    distinct, at = np.unique(codes, return_inverse=True)
    # the joints stand apart; U+0000 inside a text would too, so texts come without it
    kinds = np.array([0 if c == 0 else _class(chr(c)) for c in distinct], dtype=np.uint64)[at] if len(codes) else np.zeros(0, np.uint64)
    doc = np.cumsum(kinds == 0)
    keep = np.ones(len(kinds), dtype=bool)
    keep[1:] = ~((kinds[1:] == 32) & (kinds[:-1] == 32))
    kinds, doc = kinds[keep], doc[keep]
    if len(kinds) < 3:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty.astype(np.uint64), empty
    grams = (kinds[:-2] << np.uint64(42)) | (kinds[1:-1] << np.uint64(21)) | kinds[2:]
    inside = (kinds[:-2] != 0) & (kinds[1:-1] != 0) & (kinds[2:] != 0)
    grams, doc = grams[inside], doc[:-2][inside]
    found, at = np.unique(grams, return_inverse=True)
    pairs, counts = np.unique(doc * len(found) + at, return_counts=True)
    return pairs // max(1, len(found)), found[pairs % max(1, len(found))], counts


def profiles(texts: list[str]) -> np.ndarray:
    """The bundle of each text, of length 1; zeros for a text without letters."""
    # blanks at both ends let the shortest words have trigrams
    doc, grams, counts = trigrams([" " + t.replace("\x00", " ") + " " for t in texts])
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    found, at = np.unique(grams, return_inverse=True)
    for i in range(0, len(found), 2048):
        near = (at >= i) & (at < i + 2048)
        dense = np.zeros((len(texts), min(2048, len(found) - i)), dtype=np.float32)
        dense[doc[near], at[near] - i] = counts[near]
        out += dense @ gram_vectors(found[i : i + 2048]).astype(np.float32)
    lengths = np.linalg.norm(out, axis=1)
    return out / np.where(lengths > 0, lengths, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t or "") > SLICE_CHARS or i - start >= 256):
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if texts:
        yield start, len(texts)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, at, value: the sums of the profiles of this task, a row per place."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lo, hi in slices(texts):
            made = profiles(texts[lo:hi])
            for lang in set(langs[lo:hi]):
                own = made[[x == lang for x in langs[lo:hi]]].sum(axis=0, dtype=np.float64)
                sums[lang] = sums.get(lang, 0) + own
    for lang, own in sums.items():
        # whole numbers, so that the order of adding doesn't matter
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(np.rint(own * 2**24).astype(np.int64))], ["lang", "at", "value"]
        )


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages, in order, and their prototypes of length 1. Input: doc_id, text, lang."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, DIM))
    at = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 20))
    rates = {lang: min(1 << 20, max(1, (sample << 20) // n)) for lang, n in sizes.items()}
    below = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
    sums = usable.where(at < below).select("lang", "text").mapInArrow(_bundles, "lang string, at int, value long")
    rows = sums.groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r["lang"] for r in rows})
    prototypes = np.zeros((len(langs), DIM))
    for r in rows:
        prototypes[langs.index(r["lang"]), r["at"]] = r["value"]
    lengths = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return langs, prototypes / np.where(lengths > 0, lengths, 1)


def _predicted(langs: list[str], prototypes: np.ndarray) -> Callable:
    held = prototypes.astype(np.float32).T

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            best, score = [], []
            for lo, hi in slices(texts):
                part = [t or "" for t in texts[lo:hi]]
                if langs:
                    cosines = profiles(part) @ held
                    first = cosines.argmax(axis=1)
                for i, t in enumerate(part):
                    known = bool(langs) and has_letter(t)
                    best.append(langs[first[i]] if known else "und")
                    score.append(min(1.0, max(0.0, float(cosines[i, first[i]]))) if known else 0.0)
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "lang_pred", "score"])

    return each


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Held-out documents take no part in learning; a null
    id is in no fold and is learned from."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    held = F.coalesce(fold == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held.alias("held_out"))
    langs, prototypes = learn(rows.where("NOT held_out").select("doc_id", "text", "lang"))
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        _predicted(langs, prototypes), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
