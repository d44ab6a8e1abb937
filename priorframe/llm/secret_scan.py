"""Secrets in texts: three fixed patterns, and random strings that a public vocabulary cannot shorten.

A byte-pair vocabulary covers words, names and code with few tokens, random strings with many. A run of letters, digits
and ``+/_-`` with at least ``LEAST`` characters, letters and digits among them, is a secret if it has fewer than ``RATIO``
characters a token and is no known digest and no identifier (see :func:`known`). Such spans get the kind ``random``; one
that lies inside a span of a pattern is not repeated.

Texts are scanned where they are: no shuffle, one text at a time in memory.

Defined cases: a null text is the empty text; bytes that are not UTF-8 are read as U+FFFD; offsets are code points, the
end exclusive; runs and texts are whole at any length (a run's tokens are counted in pieces of ``PIECE`` characters);
repeated rows give equal rows; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 20
RATIO = 2.0
PIECE = 2048
KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind:string,start:bigint,end:bigint,ratio:double>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more, so the same matches as runs of any length, the short ones dropped
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
LETTER, DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")

DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
NAMED_DIGEST = re.compile(r"(?:md5|sha1|sha224|sha256|sha384|sha512)[-_=/][A-Za-z0-9+/_-]+=*", re.I)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
NUMBERED = re.compile(r"[A-Za-z]{1,12}[-_/]?[0-9][0-9_/-]*")  # a name and a number: orders, accounts, parts
SPLIT = re.compile(r"[+/_-]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
WORD = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{2,}|[0-9]{1,8}")


def known(run: str) -> bool:
    """Whether a run is a digest or an identifier.

    Digests: hexadecimal of a usual hash's length, or anything that names its hash. Identifiers: UUIDs, a name followed by
    a number, and runs that fall into words and numbers (by separators, humps and digits) with at most a tenth of their
    characters in other parts.
    """
    if DIGEST.fullmatch(run) or NAMED_DIGEST.fullmatch(run) or UUID.fullmatch(run) or NUMBERED.fullmatch(run):
        return True
    if not re.search(r"[/_-]", run):
        return False
    parts = [p for p in SPLIT.split(run) if p]
    odd = sum(len(p) for p in parts if not WORD.fullmatch(p))
    return odd <= len(run) / 10


class Vocabulary:
    """A tiktoken file's ranks; how many characters of a string one token covers."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, run: str) -> float:
        tokens = sum(len(self.encoding.encode_ordinary(run[k : k + PIECE])) for k in range(0, len(run), PIECE))
        return len(run) / tokens


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary for each Python worker, which tasks reuse."""
    return Vocabulary(path, pattern)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three patterns, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def random_spans(text: str, vocab: Vocabulary, base: list[tuple[str, int, int]], ratio: float = RATIO) -> list[tuple[int, int, float]]:
    """(start, end, characters a token) of the random strings that no base span holds."""
    found, at, reach = [], 0, -1
    for m in RUN.finditer(text):
        run, start, end = m[0], m.start(), m.end()
        while at < len(base) and base[at][1] <= start:
            reach, at = max(reach, base[at][2]), at + 1
        # the farthest end of the base spans that begin at or before the run decides whether one holds it
        if reach >= end or not LETTER.search(run) or not DIGIT.search(run) or known(run):
            continue
        value = vocab.ratio(run)
        if value < ratio:
            found.append((start, end, value))
    return found


def spans_of(text: str, vocab: Vocabulary, ratio: float = RATIO) -> list[dict]:
    """All spans of a text by start and then kind."""
    base = base_spans(text)
    rows = [{"kind": k, "start": s, "end": e, "ratio": None} for k, s, e in base]
    rows += [{"kind": "random", "start": s, "end": e, "ratio": v} for s, e, v in random_spans(text, vocab, base, ratio)]
    return sorted(rows, key=lambda r: (r["start"], KINDS.index(r["kind"])))


def _text(value: pa.Scalar) -> str:
    return (value.as_py() or b"").decode("utf-8", "replace")


def with_spans(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", spans_col: str = "secrets", redacted_col: str | None = None, ratio: float = RATIO,
) -> DataFrame:
    """docs with the spans of each text and, if asked for, the text with every span replaced by its kind in brackets.

    Columns of these names are replaced. Overlapping spans are redacted together, under the first one's kind.
    """
    kept = docs.drop(spans_col, *([redacted_col] if redacted_col else []))
    names, place = kept.columns, kept.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            spans, texts = [], []
            for value in batch.column(place).cast(pa.binary()):
                text = _text(value)
                spans.append(spans_of(text, vocab, ratio))
                if redacted_col:
                    texts.append(redacted(text, spans[-1]) if value.is_valid else None)
            extra = [pa.array(spans, kind)] + ([pa.array(texts, pa.string())] if redacted_col else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, spans_col, *([redacted_col] if redacted_col else [])])

    added = [T.StructField(spans_col, T._parse_datatype_string(SPANS))] + ([T.StructField(redacted_col, T.StringType())] if redacted_col else [])
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))


def redacted(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def digest_rows(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans)`` for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            counts, digests, shown = {k: [] for k in KINDS}, [], []
            for value in batch.column(1):
                found = spans_of(_text(value), vocab, ratio)
                texts = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in found]
                for k in KINDS:
                    counts[k].append(sum(kind == k for kind, _ in texts))
                digests.append(hashlib.sha256(",".join(t for kind, t in texts if kind != "random").encode()).hexdigest())
                shown.append(",".join(t for _, t in texts))
            arrays = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
