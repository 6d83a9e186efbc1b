"""Personal data by boosted trees over overlapping candidates.

Four base kinds of spans (addresses of mail, addresses of hosts, card numbers, phone numbers) come from patterns and
arithmetic. The method adds three: high-recall generators propose overlapping spans (windows of digit groups, spelled-out
mail addresses, grouped codes), gradient-boosted trees score each proposal by its format (groups, signs, check digits) and
its context (words that stand before it, what it touches), and a threshold per kind, calibrated on rows held out of the
fit, selects what is reported. Of overlapping proposals the highest score stays, then the longest, then the first.

The trees learn from the corpus itself: into each of ``PASSAGES`` passages (the bounded sample, ``PASSAGE`` characters
each, those with the least hashes) one made example is planted, personal or a look-alike, with or without a word that
tells. Every proposal of the passage is a row: it is positive if it is exactly the planted personal span, so wrong extents
and the corpus's own numbers are negatives. Fitting is a Spark job over these rows; scoring runs inside the tasks.

Defined cases: null text is empty and has no spans; texts are scanned whole, in time linear in their length; repeated rows
are scanned each; an empty table gives an empty result (the passages then are blank); ``redact`` leaves extra columns
untouched, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import Scratch, table

KINDS = ("email", "ip", "card", "phone", "contact", "number", "code")
BASE_KINDS = 4
CONTACT, NUMBER, CODE = 4, 5, 6
# The four base patterns. Runs are entered only at their start, which finds the same and stays linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The bounded sample that the trees learn from, and its share that calibrates thresholds.
PASSAGES, PASSAGE, HELD_OUT = 3000, 400, 4
TREES, DEPTH, STEP = 30, 4, 0.2
#: Least precision of what a threshold lets through, on held-out rows.
LEAST_PRECISION = 0.99
#: Proposals scored at once.
BLOCK = 8192
#: Characters before a proposal that count as its context.
CONTEXT = 48

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four base kinds, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)]
    small = lambda part: len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255
    out += [(1, *m.span()) for m in IP.finditer(text) if all(map(small, m.groups()))]
    digits = lambda m: m[0].replace(" ", "").replace("-", "")
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits(m)) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# Generators. They propose more than is personal; extents overlap.
GROUPS = re.compile(r"[0-9]+(?:[\x20./()-]{1,2}[0-9]+)*+")
GROUP = re.compile(r"[0-9]+")
SPELLED = re.compile(
    r"(?<![A-Za-z0-9])([A-Za-z0-9][A-Za-z0-9._-]{0,63})(\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|\x20@\x20)"
    r"(?=([A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,3}))"
)
CODES = re.compile(
    r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,4})?|[0-9A-Fa-f]{1,4}(?:[:-]{1,2}[0-9A-Fa-f]{1,4}){3,9}+)(?![A-Za-z0-9])"
)
PIECE = re.compile(r"[A-Za-z0-9]+")
MOST_GROUPS = 5


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of all proposals, overlapping ones too."""
    for run in GROUPS.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [m.span() for m in GROUP.finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups):
            n = 0
            for s, e in groups[i : i + MOST_GROUPS]:
                n += e - s
                if n > 18:
                    break
                if n >= 7:
                    yield NUMBER, start, e
                    if start and text[start - 1] == "(":
                        yield NUMBER, start - 1, e
    for m in SPELLED.finditer(text):
        yield CONTACT, m.start(), m.end(3)
        cut = text.rfind(".", m.start(3), m.end(3))
        if cut > m.start(3) and "." in text[m.start(3) : cut]:
            yield CONTACT, m.start(), cut
    for m in CODES.finditer(text):
        pieces = [p.span() for p in PIECE.finditer(text, *m.span())]
        if m.end() - m.start() < 11:
            continue
        yield CODE, m.start(), m.end()
        for k in range(1, min(3, len(pieces))):
            for s, e in ((pieces[k][0], m.end()), (m.start(), pieces[-1 - k][1])):
                if e - s >= 11:
                    yield CODE, s, e


# Words that tell, by what they speak for.
TELLS = tuple(
    re.compile(rf"(?i)(?<![a-z])(?:{words})(?![a-z])")
    for words in (
        "phone|tel|telephone|call|mobile|cell|fax|sms|whatsapp|telefon|handy|anruf|tél|téléphone|teléfono|móvil",
        "ssn|social security|national id|passport|tax id|insurance number|ausweis|dni|nif",
        "card|credit|debit|visa|amex|mastercard|karte|carte|tarjeta|cvv",
        "iban|account|bank|konto|compte|cuenta|transfer",
        "mail|email|e-mail|contact|write|reach|correo|courriel",
        "mac|ipv6|host|address|device|client|adresse|dirección",
        "order|invoice|ref|reference|ticket|item|sku|serial|model|isbn|issn|part|batch|id|uuid|hash|commit|bestellung|commande|pedido",
        "date|time|year|version|release|since|until|page|chapter|section|total|price|amount|score|ratio|size|population",
    )
)
SIGNS = " .-()/:"
N_FEATURES = 3 + 9 + len(SIGNS) + 5 + 6 + 2 * len(TELLS)


def _mod97(code: str) -> bool:
    code = (code[4:] + code[:4]).upper()
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a proposal, as N_FEATURES numbers."""
    own = text[start:end]
    plain = "".join(PIECE.findall(own))
    digits = "".join(c for c in plain if c in "0123456789")
    groups = PIECE.findall(own)
    sizes = [len(g) for g in groups]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 2]
    letters = len(plain) - len(digits)
    out = [kind == CONTACT, kind == NUMBER, kind == CODE]
    out += [len(own), len(digits), letters, sum(c.isupper() for c in plain), sum(c in "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ" for c in plain), len(set(plain)), len(groups), max(sizes) - min(sizes), max(sizes)]
    out += [own.count(c) for c in SIGNS]
    out += [sizes[0], sizes[-1], sizes[1] if len(sizes) > 1 else 0, int(digits[0]) if digits else -1, int(digits[:2]) if len(digits) > 1 else -1]
    touched = before[-1:]
    # check digits; and whether the proposal could be longer on either side
    out += [
        len(digits) == len(plain) and 13 <= len(digits) <= 19 and luhn(digits),
        15 <= len(plain) <= 34 and plain[:2].isalpha() and plain[2:4].isdigit() and plain.isascii() and _mod97(plain),
        bool(touched) and (touched.isalnum() or touched in "+@_"), bool(re.search(r"[0-9A-Za-z][-./:@]\Z|[0-9] \Z|\(\Z", before)),
        after[:1].isalnum(), bool(re.match(r"[-./:@_][0-9A-Za-z]| [0-9]", after)),
    ]
    for tell in TELLS:
        last = None
        for last in tell.finditer(before):
            pass
        out += [last is not None, len(before) - last.end() if last else CONTEXT]
    return [float(x) for x in out]


# Made examples.
def _digits(rng: random.Random, shape: str) -> str:
    """The shape with 9 for any digit, 8 for one that isn't 0, x for a hexadecimal one, A for a capital."""
    return "".join(
        rng.choice("0123456789") if c == "9" else rng.choice("123456789") if c == "8" else rng.choice("0123456789abcdef") if c == "x" else rng.choice("ABCDEFGHKLMNPRSTUVW") if c == "A" else c
        for c in shape
    )


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))


def _with_check(rng: random.Random, body: str, valid: bool) -> str:
    good = next(d for d in "0123456789" if luhn(body + d))
    return body + (good if valid else rng.choice([d for d in "0123456789" if d != good]))


def _iban(rng: random.Random, valid: bool) -> str:
    country, body = _digits(rng, "AA"), _digits(rng, "8" + "9" * rng.randint(13, 19))
    check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
    if not valid:
        check = (check + rng.randint(1, 80)) % 97
    whole = f"{country}{check:02d}{body}"
    return whole if rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))


def personal(rng: random.Random) -> tuple[str, str]:
    """A made personal string and the words before it."""
    pick = rng.randrange(7)
    if pick < 2:
        tell = rng.choice(["phone", "tel", "call", "mobile", "fax", "Telefon", "téléphone", "teléfono", "Tel."])
        return _digits(rng, rng.choice(["(899) 899-9999", "899-899-9999", "899.899.9999", "089 999 99999", "0899/9999999", "08 99 99 99 99", "0089 99 9999999", "899 999 999", "899-9999"])), tell
    if pick == 2:
        return _digits(rng, "899-89-8999"), rng.choice(["SSN", "social security", "national id", "tax id"])
    if pick == 3:
        number = _with_check(rng, _digits(rng, "37999999999999"), True)
        return rng.choice([number, f"{number[:4]} {number[4:10]} {number[10:]}", f"{number[:4]}-{number[4:10]}-{number[10:]}"]), rng.choice(["card", "amex", "credit card", "carte", ""])
    if pick == 4:
        name, host = rng.choice([_word(rng), f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}{rng.randrange(99)}"]), _word(rng)
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" @ ", "."), ("[at]", ".")])
        return f"{name}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}", rng.choice(["email", "mail", "contact", "write to", "reach me", ""])
    if pick == 5:
        return _iban(rng, True), rng.choice(["IBAN", "account", "Konto", "compte", "cuenta", ""])
    return _digits(rng, rng.choice(["2xxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx", "fexx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx", "xx:xx:xx:xx:xx:xx", "xx-xx-xx-xx-xx-xx"])), rng.choice(["MAC", "host", "client", "device", "address", "ipv6"])


def alike(rng: random.Random) -> tuple[str, str]:
    """A made string that looks personal and isn't, and the words before it."""
    pick = rng.randrange(9)
    if pick == 0:
        return _digits(rng, rng.choice(["2089-89-89", "89.89.2089", "2089-89-89 89:99", "89/89/2089", "1989-2089"])), rng.choice(["date", "since", "until", "", "released"])
    if pick == 1:
        return _digits(rng, rng.choice(["8.99.999.9", "89.9.9-9999", "8 999 999", "8,999,999.99", "999999999"])), rng.choice(["version", "total", "price", "amount", "population", ""])
    if pick == 2:
        return _digits(rng, rng.choice(["978-9-99-999999-9", "8999999999", "899-9999999-9999999", "99999-9999", "899-899-9999"])), rng.choice(["ISBN", "order", "invoice", "ref", "ticket", "serial", "part"])
    if pick == 3:
        return _with_check(rng, _digits(rng, "8" + "9" * rng.choice([12, 13, 14, 15, 17])), False), rng.choice(["", "", "id", "item", "order", "number"])
    if pick == 4:
        return rng.choice([f"look at {_word(rng)} dot patterns", f"meet at {_word(rng)}.", f"{_word(rng)} at {_word(rng)}.{rng.choice(['The', 'It', 'And'])}", f"sold at 8.50 each, {_word(rng)}"]), rng.choice(["", "we", "they"])
    if pick == 5:
        return _iban(rng, False), rng.choice(["", "serial", "model", "code", "batch"])
    if pick == 6:
        return _digits(rng, rng.choice(["xxxxxxxx-xxxx-4xxx-8xxx-xxxxxxxxxxxx", "AA99-AA99-9999", "AA 999 AA 99", "AAA-9999-AA"])), rng.choice(["uuid", "id", "serial", "model", "sku", ""])
    if pick == 7:
        return _digits(rng, rng.choice(["89:89:89", "89:89 - 89:89", "8:9:9:99", "00:89:89.999", "89:89:89:99"])), rng.choice(["time", "ratio", "score", "at", ""])
    return " ".join(_digits(rng, rng.choice(["8", "89", "899", "8999"])) for _ in range(rng.randint(3, 8))), rng.choice(["", "section", "pages", "row", "size"])


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """passage, seed -> kind, label, held_out, features of each proposal in the passage with its planted example."""
    for batch in batches:
        rows: list[tuple[int, float, bool, list[float]]] = []
        for passage, seed in zip(batch.column("passage").to_pylist(), batch.column("seed").to_pylist(), strict=True):
            rng = random.Random(seed)
            good = rng.random() < 0.5
            made, tell = personal(rng) if good else alike(rng)
            at = passage.find(" ", rng.randrange(len(passage) + 1))
            head, tail = (passage[:at], passage[at:]) if at >= 0 else (passage, "")
            lead = f"{head} {tell}{rng.choice([' ', ': ', ' is '])}" if tell else f"{head} "
            text = lead + made + rng.choice([" ", ", ", ". ", "\n"]) + tail.lstrip()
            span, base = (len(lead), len(lead) + len(made)), base_spans(text)
            for kind, s, e in proposals(text):
                if not any(s < b and a < e for _, a, b in base):
                    rows.append((kind, float(good and (s, e) == span), seed % HELD_OUT == 0, features(text, kind, s, e)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = [pa.int32(), pa.float64(), pa.bool_(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "label", "held_out", "features"])


def passages(docs: DataFrame) -> DataFrame:
    """passage, seed: PASSAGES stretches of text, with the least hashes; blank ones fill up what a small corpus lacks."""
    seed = F.xxhash64("doc_id", "text")
    start = F.pmod(seed, F.greatest(F.length("text") - PASSAGE, F.lit(1))) + 1
    found = docs.where("text IS NOT NULL").select(F.col("text").substr(start.cast("int"), F.lit(PASSAGE)).alias("passage"), seed.alias("seed"))
    blank = docs.sparkSession.range(PASSAGES).select(F.lit(" ").alias("passage"), (F.lit(2**63 - 1) - F.col("id")).alias("seed"))
    return found.unionByName(blank).orderBy("seed", "passage").limit(PASSAGES)


class Boosted:
    """The fitted trees as arrays in heap order, scored for many rows at once, and the thresholds of the added kinds."""

    def __init__(self, trees: list, weights: list[float]):
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        self.feature = np.zeros((len(trees), inner), dtype=np.int64)
        self.limit = np.full((len(trees), inner), np.inf)
        self.value = np.zeros((len(trees), leaves))
        self.thresholds = np.full(len(KINDS), np.inf)
        for t, (root, weight) in enumerate(zip(trees, weights, strict=True)):
            self._fill(t, root, 0, 0, weight)

    def _fill(self, t: int, node, at: int, depth: int, weight: float) -> None:
        """A node of the fitted tree at a place of the heap; a leaf above the lowest level is the left one below it."""
        leaf = node.numDescendants() == 0
        if depth == DEPTH:
            self.value[t, at - (2**DEPTH - 1)] = weight * node.prediction()
        elif leaf:
            self._fill(t, node, 2 * at + 1, depth + 1, weight)
        else:
            self.feature[t, at], self.limit[t, at] = node.split().featureIndex(), node.split().threshold()
            self._fill(t, node.leftChild(), 2 * at + 1, depth + 1, weight)
            self._fill(t, node.rightChild(), 2 * at + 2, depth + 1, weight)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features."""
        tree = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (np.take_along_axis(x, self.feature[tree, at], axis=1) > self.limit[tree, at])
        return 1 / (1 + np.exp(-2 * self.value[tree, at - (2**DEPTH - 1)].sum(axis=1)))

    def calibrate(self, kind: np.ndarray, label: np.ndarray, score: np.ndarray) -> None:
        """The least score of each kind above which at least LEAST_PRECISION of the held-out rows are personal, and
        never under a half; a kind without such a score adds nothing."""
        for k in range(BASE_KINDS, len(KINDS)):
            own = kind == k
            order = np.argsort(-score[own], kind="stable")
            s, y = score[own][order], label[own][order]
            last = np.flatnonzero(np.append(s[1:] != s[:-1], True)) if len(s) else np.zeros(0, dtype=np.int64)
            right = np.cumsum(y)[last] / (last + 1)
            fit = last[(right >= LEAST_PRECISION) & (s[last] >= 0.5)]
            self.thresholds[k] = s[fit[-1]] if len(fit) else math.inf


def learn(docs: DataFrame, scratch: Scratch) -> Boosted:
    rows = scratch.put(scratch.put(passages(docs)).repartition(4).mapInArrow(_planted, "kind int, label double, held_out boolean, features array<double>"))
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, featuresCol="x", labelCol="label").fit(
        rows.where("NOT held_out").select(array_to_vector("features").alias("x"), "label").coalesce(2)
    )
    model = Boosted([t._call_java("rootNode") for t in fitted.trees], list(fitted.treeWeights))
    held = rows.where("held_out").toArrow()
    x = np.asarray(held.column("features").combine_chunks().flatten()).reshape(-1, N_FEATURES)
    model.calibrate(np.asarray(held.column("kind")), np.asarray(held.column("label")), model.scores(x))
    return model


def _chosen(scored: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the best of overlapping proposals: highest score, longest, first."""
    starts: list[int] = []
    taken: list[tuple[int, int, int]] = []
    for _, kind, s, e in sorted(scored, key=lambda x: (-x[0], x[2] - x[3], x[2], x[1])):
        i = bisect.bisect_left(starts, e)
        if i == 0 or taken[i - 1][2] <= s:
            starts.insert(i, s)
            taken.insert(i, (kind, s, e))
    return taken


def spans_of(texts: list[str], model: Boosted) -> list[list[tuple[int, int, int]]]:
    """The spans of each text, by kind and start: base spans, and what the trees add where no base span is."""
    bases = [base_spans(t) for t in texts]
    kept: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    block: list[tuple[int, int, int, int]] = []

    def score() -> None:
        x = np.array([features(texts[i], k, s, e) for i, k, s, e in block])
        for p, (i, k, s, e) in zip(model.scores(x).tolist(), block, strict=True):
            if p >= model.thresholds[k]:
                kept[i].append((p, k, s, e))
        block.clear()

    for i, text in enumerate(texts):
        order = sorted(x[1:] for x in bases[i])
        starts, reach = [a for a, _ in order], list(itertools.accumulate((b for _, b in order), max))
        for kind, s, e in proposals(text):
            n = bisect.bisect_left(starts, e)
            if not n or reach[n - 1] <= s:
                block.append((i, kind, s, e))
                if len(block) == BLOCK:
                    score()
    if block:
        score()
    return [base + sorted(_chosen(own)) for base, own in zip(bases, kept, strict=True)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _reports(model) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                rows = []
                for spans in spans_of([t or "" for t in batch.column("text").to_pylist()], model.value):
                    n = [sum(x[0] == k for x in spans) for k in range(len(KINDS))]
                    base = hashlib.sha256(_joined([x for x in spans if x[0] < BASE_KINDS]).encode()).hexdigest()
                    rows.append((*n[:BASE_KINDS], base, _joined(spans), sum(n[BASE_KINDS:])))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                names = ["doc_id", *(f"n_{k}" for k in KINDS[:BASE_KINDS]), "base_sha256", "spans", "n_added"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return each


def scan_pii(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    model = model or learn(docs, Scratch(docs.sparkSession, "pii"))
    return docs.select("doc_id", "text").mapInArrow(_reports(docs.sparkSession.sparkContext.broadcast(model)), SCHEMA)


def redact(docs: DataFrame, model: Boosted | None = None, mark: str = "[{}]") -> DataFrame:
    """The documents with every span replaced by its kind; all columns stay."""
    model = model or learn(docs, Scratch(docs.sparkSession, "pii"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kind = batch.column("text").to_pylist(), batch.schema.field("text").type
            for i, spans in enumerate(spans_of([t or "" for t in texts], shared.value)):
                parts, at = [], 0
                for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])):
                    if e > at:
                        parts += [texts[i][at : max(s, at)], mark.format(KINDS[k]) if s >= at else ""]
                        at = e
                if parts:
                    texts[i] = "".join(parts) + texts[i][at:]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, kind))

    return docs.mapInArrow(each, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents"))
