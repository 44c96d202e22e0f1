"""Secret scans: patterns, and zstandard novelty against primed dictionaries.

Assignments, access keys and long hexadecimal strings are found by pattern. Beyond
them, a string in a sensitive context (a credential word shortly before it) is a
candidate. Its novelty is the number of bytes that it adds to a zstandard frame
primed with the identifiers common in code and with the text around it: known
words and repeated names add almost nothing, secrets nearly all their bytes. As a
frame also codes the candidate's own alphabet, these bytes are held against those
of an even random string of the same length and alphabet. The lines of a private
key that follow its header are spans if one of them is novel.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import lean, small_batches

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A credential word, then up to 40 characters of one line, then the candidate.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "credential", "private_key", "private key", "access_key", "access key", "authorization", "bearer")
CONTEXT = re.compile(r"(?:" + "|".join(map(re.escape, CONTEXT_WORDS)) + r")(?![a-z])", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=@-])[A-Za-z0-9+/_.=-]{16,}(?![@A-Za-z0-9])")
#: A private key's header, lines of names and values after it, and the lines of its body.
KEY_HEADER = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
KEY_FIELD = re.compile(r"(?:\s|\\[nr])*[A-Za-z][A-Za-z-]*: (?:(?!\\[nr])[^\r\n])*")
KEY_PIECE = re.compile(r"\\[nr]|([A-Za-z0-9+/=]+)")
KEY_LINE = re.compile(r"(?:\s|\\[nr])*([A-Za-z0-9+/=]+)(?=\s|\\[nr]|[\"']|\Z)")
#: Characters that fill up alphabets of fewer than 16, so that strings of a few characters aren't novel.
LEAST_ALPHABET = b"0123456789ABCDEF"
IDENTIFIERS = b" ".join(
    b"password passwd secret token api_key apikey access_key private_key client_secret authorization bearer credential username user login "
    b"account config settings environment variable default example placeholder changeme your_password_here true false null none undefined "
    b"string number boolean object array function return import export class public private protected static void const import from self "
    b"request response header content-type application/json http https localhost 127.0.0.1 example.com index.html version update create delete "
    b"select insert where database connection timeout session cookie encrypt decrypt encode decode base64 abcdefghijklmnopqrstuvwxyz "
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx".split()
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, each leftmost and non-overlapping, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def even_strings(candidate: bytes, n: int = 16) -> list[bytes]:
    """Random strings of the candidate's length, even over its characters."""
    own = sorted(set(candidate))
    own += [c for c in LEAST_ALPHABET if c not in own][: max(0, len(LEAST_ALPHABET) - len(own))]
    draw = random.Random(len(candidate))
    return [bytes(draw.choices(own, k=len(candidate))) for _ in range(n)]


def novelty(candidate: bytes, around: bytes, level: int = 12) -> float:
    """Bytes that the candidate adds to a frame primed with identifiers and its surroundings, a byte of an even random string."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b" " + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frames = {"level": level, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    press, plain = zstandard.ZstdCompressor(dict_data=primed, **frames), zstandard.ZstdCompressor(**frames)
    even = min(len(plain.compress(x)) for x in even_strings(candidate)) - len(plain.compress(b""))
    return (len(press.compress(candidate)) - len(press.compress(b""))) / min(even, len(candidate))


def key_lines(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) of the lines of each private key: up to its END, or without one as far as lines look like a key's."""
    out = []
    for header in KEY_HEADER.finditer(text):
        at = header.end()
        stop = text.find("-----BEGIN", at)
        stop = len(text) if stop < 0 else stop
        end = text.find("-----END", at, stop)
        while m := KEY_FIELD.match(text, at, stop if end < 0 else end):
            at = m.end()
        lines: list[tuple[int, int]] = []
        whole = True  # the line before was a whole one, so that this may be the last
        if end >= 0:
            found = (m.span(1) for m in KEY_PIECE.finditer(text, at, end) if m[1])
        else:
            found = []
            while m := KEY_LINE.match(text, at, stop):
                found.append(m.span(1))
                at = m.end()
        for s, e in found:
            if e - s >= 16 or (lines and whole):
                lines.append((s, e))
            whole = e - s >= 16
        out.append(lines)
    return out


class Taken:
    """Spans in order, asked for those that overlap a range."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _, _ in self.spans]
        self.far = list(itertools.accumulate((e for _, _, e in self.spans), max))  # the greatest end so far

    def overlaps(self, s: int, e: int) -> bool:
        """Whether a span that starts before e ends behind s."""
        at = bisect.bisect_left(self.starts, e)
        return at > 0 and self.far[at - 1] > s

    def meeting(self, s: int, e: int) -> list[tuple[int, int, int]]:
        at, out = bisect.bisect_left(self.starts, e), []
        while at > 0 and self.far[at - 1] > s:
            at -= 1
            if self.spans[at][2] > s:
                out.append(self.spans[at])
        return out[::-1]


def uncovered(s: int, e: int, taken: Taken) -> list[tuple[int, int]]:
    """The parts of s to e that no span covers."""
    out = []
    for a, _, b in taken.meeting(s, e):
        if s < a:
            out.append((s, a))
        s = max(s, b)
    return [*out, (s, e)] if s < e else out


def novel_spans(text: str, taken: list[tuple[int, int, int]], reach: int, width: int, least: float) -> list[tuple[int, int, int]]:
    """Incompressible strings within `reach` characters after a credential word, and lines of private keys, that no base span covers."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    out, seen, base = [], set(), Taken(taken)

    def is_novel(s: int, e: int) -> bool:
        around = text[max(0, s - width) : s] + " " + text[e : e + width]
        return novelty(text[s:e].encode(), around.encode()) >= least

    if "-----BEGIN" in text:
        for lines in key_lines(text):
            if any(e - s >= 16 and is_novel(s, e) for s, e in lines):
                out += [(a, 3, b) for s, e in lines for a, b in uncovered(s, e, base)]
        base = Taken(taken + out)
    for hint in CONTEXT.finditer(text):
        for m in CANDIDATE.finditer(text, hint.end(), min(len(text), hint.end() + reach + 512)):
            s, e = m.span()
            if s > hint.end() + reach or "\n" in text[hint.end() : s]:
                break
            if e == hint.end() + reach + 512:  # the window may cut it
                e = s + len(re.compile(r"[A-Za-z0-9+/_.=-]+").match(text, s)[0])
            word = text[s:e].rstrip(".")
            e = s + len(word)
            if s in seen or len(word) < 16 or base.overlaps(s, e):
                continue
            seen.add(s)
            classes = sum(any(f(c) for c in word) for f in (str.islower, str.isupper, str.isdigit))
            if not any(c.isdigit() for c in word) or classes < 2:
                continue
            if is_novel(s, e):
                out.append((s, 3, e))
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scanner(reach: int, width: int, least: float):
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "found"]

    @lean
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                more = novel_spans(text, base, reach, width, least)
                count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                every = sorted(base + more)
                rows.append((doc, *count, len(more), hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every]))
            span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), span]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = 40, width: int = 400, least: float = 0.9) -> DataFrame:
    """One row for each row of docs with the spans of its secrets, in code points, ends exclusive.

    n_assign, n_access, n_hex and base_sha256 are of the base patterns; n_novel,
    spans and found also have the candidates whose novelty is `least` or more.
    Spans are sorted by start, then kind; those of different kinds may overlap, but
    novel ones do not overlap base ones. A null text counts as empty and has no
    span, an empty table gives an empty result. Repeated rows are scanned each; a text
    of any length is scanned whole, in time that grows with it and its candidates.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scanner(reach, width, least), SCHEMA)


def _redactor(columns: list[str], text_col: str, reach: int, width: int, least: float):
    @lean
    def run(batches):
        for batch in batches:
            at = columns.index(text_col)
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    spans, pieces, done = sorted(base + novel_spans(text, base, reach, width, least)), [], 0
                    for s, k, e in spans:
                        if e <= done:
                            continue
                        pieces += [text[done : max(s, done)], f"[{KINDS[k].upper()}]" if s >= done else ""]
                        done = e
                    text = "".join(pieces) + text[done:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(k).type) if k == at else batch.column(k) for k in range(len(columns))], columns)

    return run


def redact(docs: DataFrame, *, text_col: str = "text", reach: int = 40, width: int = 400, least: float = 0.9) -> DataFrame:
    """docs with every secret replaced by its kind in brackets; all rows and columns stay."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_redactor(docs.columns, text_col, reach, width, least), docs.schema)
