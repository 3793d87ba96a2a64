"""Secrets in texts, found by one deterministic automaton for all rules.

A rule is a head and a tail. The heads are compiled together by subset construction and minimisation into
transition arrays (automaton.py). One pass over the bytes of all texts steps through that array and gives
every place where the head of a rule ends. From there nothing is scanned but the match itself: backwards over
the head, by the array of the turned head, to the leftmost place where it can begin; forwards over the tail.
So each kind's matches are leftmost, longest and without overlap; those that are too short are dropped after
they have used up their characters. The work is proportional to the text, whatever it holds.

Base kinds, in the order in which spans are listed: assign, access, hex. Further kinds: pem, github,
slack, jwt, google, stripe. Spans are counted in code points, with an exclusive end.

Edge cases: a null text counts as empty and has no spans, and so has an empty text. Texts are read whole,
whatever their length. Equal rows give equal results; input columns other than the id and the text are
ignored by scan() and kept by redact(). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common as C
from .automaton import Automaton

KEY = "(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
VALUE = "[A-Za-z0-9+/_.=-]"

#: A private key runs to its END line, over whatever stands between two lines of dashes in the characters of base64, headers,
#: white space and quoting. Without an END line it runs over headers and long runs of base64, and the short run after those.
PEM = "-----BEGIN[A-Z ]*PRIVATE KEY-----"
PEM_SPACE = "(?:[\\x20\\t\\r\\n]|\\\\[nr])*"
PEM_END = "(?:-{0,4}[A-Za-z0-9+/=_:,.;()@\\\\\"'\\x20\\t\\r\\n>#*|])*-----END[A-Z ]*PRIVATE KEY-----"
PEM_OPEN = f"(?:{PEM_SPACE}[A-Z][A-Za-z]*-[A-Z][A-Za-z]*:[A-Za-z0-9,\\x20:+/=.()_-]*)*(?:{PEM_SPACE}[A-Za-z0-9+/=]{{16,}})+(?:{PEM_SPACE}[A-Za-z0-9+/=]+)?"
PEM_WHOLE = f"{PEM}(?:{PEM_END}|{PEM_OPEN})?"

#: kind, head (after which a match goes on in one way only, wherever it began), tail, pattern with the least length,
#: whether letters fold. hex counts in its head, as no shorter run is a match; the others begin with rare characters.
RULES = [
    ("assign", KEY + VALUE, VALUE + "*", KEY + VALUE + "{6,}", True),
    ("access", "AKIA[A-Z0-9]", "[A-Z0-9]*", "AKIA[A-Z0-9]{16,}", False),
    ("hex", "[0-9a-f]{24}", "[0-9a-f]*", "[0-9a-f]{24,}", False),
    ("pem", PEM, f"(?:{PEM_END}|{PEM_OPEN})?", PEM_WHOLE, False),
    ("github", "gh[opsur]_[A-Za-z0-9]", "[A-Za-z0-9]*", "gh[opsur]_[A-Za-z0-9]{30,}", False),
    ("slack", "xox[abprs]-[A-Za-z0-9-]", "[A-Za-z0-9-]*", "xox[abprs]-[A-Za-z0-9-]{10,}", False),
    ("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]", "[A-Za-z0-9_-]*\\.[A-Za-z0-9_-]+", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", False),
    ("google", "AIza[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", "AIza[A-Za-z0-9_-]{35,}", False),
    ("stripe", "[rs]k_live_[A-Za-z0-9]", "[A-Za-z0-9]*", "[rs]k_live_[A-Za-z0-9]{16,}", False),
]
KINDS = [r[0] for r in RULES]
BASE = ("assign", "access", "hex")

SPANS = "array<struct<kind:string,start:int,end:int>>"
SCANNED = f"doc_id long, spans {SPANS}"


@lru_cache(maxsize=1)
def combined() -> Automaton:
    return Automaton([(r[1], r[4]) for r in RULES], search=True)


@lru_cache(maxsize=1)
def single() -> list[tuple[Automaton, Automaton, Automaton]]:
    """For each rule the turned head, the tail, and the rule with its least length."""
    return [(Automaton([(head, fold)], search=False, reverse=True), Automaton([(tail, fold)], search=False), Automaton([(least, fold)], search=False)) for _, head, tail, least, fold in RULES]


def byte_spans(data: bytes, rule: int, ends: np.ndarray) -> list[tuple[int, int]]:
    """Leftmost longest matches of a rule that are long enough, as byte positions; ends: where its head ends."""
    head, tail, least = single()[rule]
    out, done, at = [], 0, 0
    while at < len(ends):
        place = int(ends[at])
        start = head.leftmost(data, place, done)
        end = tail.longest(data, place) if start >= 0 else -1
        at += 1
        if end >= 0:
            done = end
            if least.longest(data, start, end) == end:
                out.append((start, end))
            at += int(np.searchsorted(ends[at:], done, "right"))
    return out


def spans_of(data: bytes, ends: np.ndarray, masks: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed; ends, masks: where heads of which rules end."""
    rules = int(np.bitwise_or.reduce(masks))
    found = [(b, e, k) for k in range(len(RULES)) if rules >> k & 1 for b, e in byte_spans(data, k, ends[masks >> k & 1 == 1])]
    if not found:
        return []
    ahead = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    found.sort(key=lambda x: (x[0], x[2]))
    return [(int(ahead[b]), int(ahead[e]), KINDS[k]) for b, e, k in found]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where its texts begin and end."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan_column(column: pa.Array) -> list[list[tuple[int, int, str]]]:
    column = column.fill_null("")
    if not len(column):
        return []
    data, offsets = buffers(column)
    ends, masks = combined().hits(data, offsets)
    owner = np.searchsorted(offsets, ends, "left") - 1
    out: list[list] = [[]] * len(column)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(owner))):
        i = owner[a]
        out[i] = spans_of(data[offsets[i] : offsets[i + 1]].tobytes(), ends[a:b] - offsets[i], masks[a:b])
    return out


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[{"kind": k, "start": b, "end": e} for b, e, k in x] for x in scan_column(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row."""
    C.prepare(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_scan, SCANNED)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span (overlapping ones as one) replaced by [SECRET]."""
    out, done = [], 0
    for b, e, _ in spans:
        if b >= done:
            out += [text[done:b], "[SECRET]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def _redact(text_at: int, n_at: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(text_at)
            found = scan_column(texts)
            if any(found):
                new = [masked(t, s) if s else t for t, s in zip(texts.to_pylist(), found)]
                columns = list(batch.columns)
                columns[text_at] = pa.array(new, texts.type)
                if n_at >= 0:
                    was = columns[n_at].to_pylist()
                    columns[n_at] = pa.array([len(t) if s else w for t, s, w in zip(new, found, was)], columns[n_at].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return run


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with secrets replaced by [SECRET] and the length column brought up to date where it exists."""
    C.prepare(docs.sparkSession)
    names = docs.columns
    return docs.mapInArrow(_redact(names.index(text_col), names.index(length_col) if length_col in names else -1), docs.schema)


def _digest(batches):
    for batch in batches:
        rows = scan_column(batch.column(1))
        base = [[s for s in x if s[2] in BASE] for x in rows]
        text = lambda x: ",".join(f"{k}:{b}:{e}" for b, e, k in x)
        count = lambda kind: pa.array([sum(s[2] == kind for s in x) for x in base], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(text(x).encode()).hexdigest() for x in base], pa.string()), pa.array([text(x) for x in rows], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
