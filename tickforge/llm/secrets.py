"""Secret scans.

Three fixed kinds of spans (assigned values, access keys, long hexadecimal runs) come from patterns. The method adds
a fourth, ``novel``: a string in a sensitive context that a primed zstandard compressor cannot shorten. A candidate's
marginal size is what it adds to the compressed size of the text around it, without other copies of the candidate,
under a dictionary of words (those of a public vocabulary), year and month stamps, and the words of the identifiers of
Python's standard library and of PySpark. Novelty is that size over the mean size of
``CONTROLS`` random strings of the same form in the same place (a digit for each digit, a letter for each letter, signs
as they are; seeded by the candidate): about one for keys of any alphabet, and less for paths, dates and identifiers.
Case is folded before. No other test stands before or beside it but length.

A text is walked once, in time linear in its length.

Defined cases: null text is empty and has no spans; texts are scanned whole; repeated rows are scanned each; an empty
table gives an empty result; extra columns pass through ``redact`` untouched.
"""

from __future__ import annotations

import base64
import bisect
import builtins
import hashlib
import http
import importlib
import itertools
import keyword
import random
import re
import string
import sys
import zlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tickforge.llm.common import table

KINDS = ("assign", "access", "hex", "novel")
# The patterns of the three base kinds and their least lengths.
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

#: A candidate: a run of token characters near a sensitive word.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_LENGTH = 16
CONTEXT = re.compile(r"(?ai:secret|token|passw|passwd|credential|private|api_?key|access_?key|auth|bearer|signature|session)")
#: A candidate is near a sensitive word that starts within so many characters before or after it.
BEFORE, AFTER = 96, 32
#: Characters of text on each side that prime the compressor.
AROUND = 256
#: Share of what random strings of the same form need, and their number.
LEAST_NOVELTY, CONTROLS = 0.88, 3
#: What follows, as the compressor finds no repeats at the very end.
TAIL = "\n" * 16
#: The public vocabulary whose words are in the dictionary, and its years.
VOCABULARY = "byte_bpe_50k.tiktoken"
YEARS = range(1990, 2040)
#: Modules whose names are identifiers of the dictionary, beside those of the standard library's modules themselves.
MODULES = (
    "argparse ast asyncio base64 collections configparser csv datetime email errno functools hashlib hmac http.client http.server io "
    "itertools json logging math multiprocessing os os.path pathlib random re secrets shutil signal socket sqlite3 ssl statistics string "
    "subprocess tempfile threading time traceback typing unittest urllib.parse urllib.request uuid xml.etree.ElementTree zipfile "
    "pyspark.sql.functions pyspark.sql.types pyspark.sql"
).split()
#: What code around keys says.
COMMON = (
    "username user name account admin config settings environment production staging client server key keys id header authorization "
    "bearer signature credential private public access refresh session token secret password localhost example documents reports "
    "images static assets scripts packages site release version final summary handler profile manager service controller factory "
    "component button index main test tests source target build dist node modules vendor usr local lib bin etc var tmp home opt data"
).split()

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed kinds, each kind leftmost and not overlapping itself."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def identifiers(vocabulary: str = VOCABULARY) -> bytes:
    """The dictionary, in small letters; what is last is cheapest to refer to. It is made on the driver and broadcast,
    some 250 KB, so all executors judge alike."""
    with open(public_tokenizers.path(vocabulary), "rb") as f:
        pieces = (base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip().lower() for line in f)
        common = list(dict.fromkeys(p for p in pieces if len(p) > 3 and p.isascii() and p.isalpha()))
    names = [*keyword.kwlist, *dir(builtins), *sys.stdlib_module_names, *(s.name for s in http.HTTPStatus)]
    for module in MODULES:
        found = importlib.import_module(module)
        names += dir(found)
        for thing in vars(found).values():
            if isinstance(thing, type):
                names += dir(thing)
    months = [f"{year}-{month:02d}-" for year in YEARS for month in range(1, 13)]
    own = sorted({w.lower() for n in names for w in WORDS.findall(n) if len(w) > 2})
    return " ".join([*reversed(common), *months, *own, *COMMON]).encode()


class Novelty:
    """Marginal compressed size under the dictionary, as a share of what random strings of the same form need."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=6)
        self.pack = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        own = text[start:end].lower()
        before, after = (x.lower().replace(own, "") for x in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))
        rng = random.Random(zlib.crc32(own.encode()))
        made = lambda: "".join(rng.choice(string.digits if c.isdigit() else string.ascii_lowercase) if c.isalnum() else c for c in own)
        controls = [made() for _ in range(CONTROLS)]
        share = 0.0
        for head, tail in ((before, f"{after}{TAIL}"), (f"{before}\n{after}\n", "")):
            size = lambda x: len(self.pack.compress(f"{head}{x}{tail}".encode()))  # noqa: B023, E731
            alone = size("")
            share += (size(own) - alone) * CONTROLS / max(1, sum(size(c) - alone for c in controls))
        return share / 2


def spans(text: str, novelty: Novelty) -> list[tuple[int, int, int]]:
    """All spans: the base spans and the novel strings that overlap none of them."""
    found = base_spans(text)
    contexts = [m.start() for m in CONTEXT.finditer(text)]
    if not contexts:
        return found
    # spans by start, with the furthest end so far, so that one search tells whether a stretch meets any of them
    starts, reach = [a for a, _, _ in found], list(itertools.accumulate((b for _, _, b in found), max))

    def novel(s: int, e: int) -> bool:
        before = bisect.bisect_left(starts, e)
        return not (before and reach[before - 1] > s) and novelty(text, s, e) >= LEAST_NOVELTY

    added = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        i = bisect.bisect_right(contexts, s - BEFORE)
        if i == len(contexts) or contexts[i] >= e + AFTER:
            continue
        inside = contexts[j] if (j := bisect.bisect_right(contexts, s)) < len(contexts) and contexts[j] < e else None
        # a run around a sensitive word counts as a whole, then without what comes before the word or the word
        for a, b in [(s, e)] if inside is None else [(s, e), (inside, e), (s, inside)]:
            if b - a >= LEAST_LENGTH and novel(a, b):
                added.append((a, 3, b))
                break
    return sorted(found + added)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _reports(dictionary) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary.value)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = spans(text.as_py() or "", novelty)
                base = [x for x in found if x[1] < 3]
                n = [sum(x[1] == k for x in found) for k in range(4)]
                rows.append((n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), n[3]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names
            )

    return each


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with the counts, the digest of the base spans, and all spans."""
    dictionary = docs.sparkSession.sparkContext.broadcast(identifiers())  # the same for all executors
    return docs.select("doc_id", "text").mapInArrow(_reports(dictionary), SCHEMA)


def redact(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """The documents with every span replaced by its kind; all columns stay, ``n_chars`` follows where it exists."""
    sized, dictionary = "n_chars" in docs.columns, docs.sparkSession.sparkContext.broadcast(identifiers())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary.value)
        for batch in batches:
            texts, kind = batch.column("text").to_pylist(), batch.schema.field("text").type
            for i, text in enumerate(texts):
                parts, at = [], 0
                for s, k, e in spans(text or "", novelty):
                    if e > at:
                        parts += [text[at : max(s, at)], mark.format(KINDS[k]) if s >= at else ""]
                        at = e
                if parts:
                    texts[i] = "".join(parts) + text[at:]
            out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, kind))
            if sized:
                i = batch.schema.get_field_index("n_chars")
                was = batch.column(i).to_pylist()
                now = [len(t) if t is not None else n for t, n in zip(texts, was, strict=True)]
                out = out.set_column(i, "n_chars", pa.array(now, batch.schema.field(i).type))
            yield out

    return docs.mapInArrow(each, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
