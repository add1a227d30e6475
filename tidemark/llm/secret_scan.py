"""Secrets in texts: three patterns, and strings that zstandard finds novel in a sensitive place.

A candidate is a run of token characters shortly behind a sensitive identifier; a run like ``KEY=value`` is split,
and its identifier counts as context of the value. What the patterns found is cut out of candidates. A candidate is
compressed behind a text of common identifiers, with a raw dictionary of identifiers and of the text around it, without
itself. What it adds to the compressed size, over what random strings of its alphabet add, is its novelty: near
one for keys. Identifiers, paths and repeated values are matches of the dictionary, and the rest of an
identifier has frequent letters, which cost less than those of a random string.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import cache, partial

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, in_blocks, pick, texts

AROUND = 512  # characters on each side that prime the dictionary
CONTEXT = 48  # characters before a candidate that may hold a sensitive identifier
WINDOW = 48  # characters of a candidate measured at once
LEAST_CHARS = 16
LEAST_NOVELTY = 0.82
DRAWN = 32  # random strings whose mean cost is the measure of an alphabet and length

# Base patterns, sensitive identifiers, identifier dictionary.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
SENSITIVE = ("secret", "token", "passw", "passphrase", "apikey", "api_key", "api-key", "auth", "bearer", "credential", "private", "signature", "access_key", "accesskey")
IDENTIFIERS = (
    "public private protected static final const var let function return import export default class struct interface package module "
    "string integer boolean float double number object array list map dict value values key keys name names type types index "
    "config configuration settings environment variable parameter argument option options default_value base_url endpoint "
    "http:// https:// www. .com .org .net .example.com /api/v1/ /usr/local/bin /etc/ /home/ localhost 127.0.0.1 username user_id "
    "client_id client_secret access_token refresh_token api_key private_key public_key password passphrase authorization bearer "
    "credential credentials signature certificate session session_id cookie header headers content-type application/json "
    "database connection host port timeout retry_count max_length created_at updated_at timestamp description message error "
    "example_value your_token_here your-api-key-here changeme placeholder xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ test_token test_secret sample undefined null none true false version release 2023-01-01T00:00:00"
).encode()

WORDS = """
    action add agent allow archive async audit balance batch block branch buffer button cache cancel channel child clean client close
    cluster collection column commit component compute console context convert count cursor data decode delete deploy device directory
    dispatch domain driver edge email encode end entity event execute expire extension factory feature field filter first flush force
    format function generate global group handler head hidden hook icon import info inner insert integer internal item job json layer
    length library line list load lock login lookup main manual mask matrix member merge method middleware mode module mount mutex
    network node notify number offset operation origin owner page parse patch pattern pending phone pixel platform point pool post
    prepare primary process profile project provider public pull query random rate ready record redirect refresh register reload
    remove render reply repository require resolve response result retry role route rule runtime save schedule scope script section
    select sequence server session shard show signal single sleep snapshot sort space stack start static step store string style
    subscribe summary switch sync table target template test theme time tool track transfer translate trigger unique unlock upgrade
    user valid value vector version virtual volume warning web width worker write
""".split()

# The first that holds a string's letters and digits is its alphabet.
_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
ALPHABETS = [
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567", _LOWER + "234567", _LOWER, _UPPER, _LOWER + _DIGITS, _UPPER + _DIGITS,
    _LOWER + _UPPER, _LOWER + _UPPER + _DIGITS,
]
_FORMS = "".join(f"_{w}{w.title()}_{w.upper()}" for w in WORDS).encode()
_COMMON = " ".join(WORDS[::2]) + " " + "_".join(w.title() if i % 3 else w.upper() for i, w in enumerate(WORDS[1::2])) + "\n"

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_CHARS)
_EQUALS = re.compile("=+")
_HEX_CLASS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

Span = tuple[str, int, int, float | None]


class Marginal:
    """Bytes that a string adds to the compressed common text, given identifiers and the text around it."""

    def __init__(self, around: str) -> None:
        known = zstandard.ZstdCompressionDict(_FORMS + IDENTIFIERS + b"\n" + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=False, write_content_size=False)
        self.empty = self.size("")

    def size(self, value: str) -> int:
        return len(self.compressor.compress((_COMMON + value).encode()))

    def cost(self, value: str) -> int:
        return self.size(value) - self.empty


def _alphabet(value: str) -> str:
    held = set(value) & set(ALPHABETS[-1])
    return next(a for a in ALPHABETS if held.issubset(a))


@cache
def _random_cost(alphabet: str, n: int) -> float:
    """Mean bytes of random strings; a worker measures every alphabet and length once."""
    draw, measure = random.Random(n), Marginal("")
    return sum(measure.cost("".join(draw.choices(alphabet, k=n))) for _ in range(DRAWN)) / DRAWN


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes of the most novel window of a span, over those of random strings of its alphabet.

    Windows have ``WINDOW`` characters: the digits of longer random strings would change what is a frequent character.
    """
    measure = Marginal(text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND])
    starts = [*range(start, max(start + 1, end - WINDOW), WINDOW), max(start, end - WINDOW)]
    windows = {text[i : min(i + WINDOW, end)] for i in starts}
    return max(measure.cost(w) / _random_cost(_alphabet(w), len(w)) for w in windows)


def base_spans(text: str, low: str) -> Iterator[Span]:
    """Matches of the three patterns; ``low`` is the text in lower case."""
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                yield "assign", m.start(), m.end(), None
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield "access", m.start(), m.end(), None
    # A cheap test for 16 hexadecimal digits in a row comes before the pattern.
    if b"xxxxxxxxxxxxxxxx" in text.encode().translate(_HEX_CLASS):
        for m in HEX.finditer(text):
            yield "hex", m.start(), m.end(), None


def _without(start: int, end: int, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """What is left of a range when the spans are cut out."""
    for _, a, b, _ in sorted(taken, key=lambda s: s[1]):
        if a < end and start < b:
            yield start, a
            start = max(start, b)
    yield start, end


def novel_spans(text: str, low: str, taken: list[Span], least_novelty: float) -> Iterator[Span]:
    """Novel candidates in a sensitive context, without the parts that base spans cover."""
    if not any(word in low for word in SENSITIVE):
        return
    for m in _CANDIDATE.finditer(text):
        for a, b in _without(m.start(), m.end(), taken):
            # The value behind each "=" with its identifier as context, then the candidate as a whole.
            for start in [*(a + e.end() for e in _EQUALS.finditer(text[a:b])), a]:
                # Sixteen digits in a row are a base span; dates and versions are no secrets.
                if b - start < LEAST_CHARS or not any(c.isalpha() for c in text[start:b]):
                    continue
                # A part keeps the context of its candidate.
                before = text[max(0, (m.start() if start == a else start) - CONTEXT) : start].lower()
                if any(word in before for word in SENSITIVE):
                    value = novelty(text, start, b)
                    if value >= least_novelty:
                        yield "novel", start, b, round(value, 6)
                        break


def find(text: str, least_novelty: float = LEAST_NOVELTY) -> list[Span]:
    """All spans of a text by start, then kind; ends are exclusive."""
    low = text.lower()
    base = list(base_spans(text, low))
    spans = base + list(novel_spans(text, low, base, least_novelty))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind: string, start: long, stop: long, novelty: double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("novelty", pa.float64())]))


def _scan(batches: Batches, least_novelty: float) -> Batches:
    names = ("kind", "start", "stop", "novelty")
    for batch in in_blocks(batches):
        rows = [[dict(zip(names, s, strict=True)) for s in find(t, least_novelty)] for t in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPANS)], names=["doc_id", "spans"])


def scan(docs: DataFrame, least_novelty: float = LEAST_NOVELTY) -> DataFrame:
    """Secrets of every document: ``doc_id, spans``, code points, ends exclusive.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Each row gives one row, repeated
    ones too; null and empty texts have no spans; an empty table gives no rows. Kinds are ``assign``,
    ``access``, ``hex`` (patterns, non-overlapping within a kind) and ``novel`` with its novelty, never
    touching a pattern's span. Spans are ordered by start, then kind in this order.
    """
    return pick(docs, "doc_id", "text").mapInArrow(partial(_scan, least_novelty=least_novelty), f"doc_id long, spans {SPANS}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of :func:`scan`."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
