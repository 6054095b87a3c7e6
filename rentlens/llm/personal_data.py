"""Personal data: expressions propose spans, checksums and shapes confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.shared import LOWER, UPPER, text_of

#: Spans added to the base ones need this score (0 to 100).
THRESHOLD = 60
#: Code points looked at before and after a span, and what a helpful or a contrary word there is worth.
BEFORE, AFTER, HELP, HARM = 48, 24, 25, -30
#: Order of the kinds in a digest.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

#: The base proposals, as the contract writes them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals added by the method. They see what a greedy base proposal hides (a card behind a telephone number).
ADDED = {
    "card": r"[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{12,}",
    "phone": r"(?:\+1[\x20.-]?)?\(?[2-9][0-9]{2}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: Score of a confirmed proposal before its context.
SCORE = {"email": 90, "ip": 70, "card": 80, "phone": 65, "iban": 85, "ssn": 40}
#: A national number without its country prefix.
BARE_PHONE = 40
HELPFUL = {
    "email": ("mail", "email", "contact"), "ip": ("ip", "address", "host"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social", "security"),
}
CONTRARY = {
    "email": (), "ip": ("version", "release", "section"), "card": ("order", "invoice", "tracking", "isbn"),
    "phone": ("order", "invoice", "part", "isbn"), "iban": ("order", "invoice"), "ssn": ("order", "invoice", "part"),
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset(LOWER + UPPER + "0123456789._%+-")
# the base proposals again, without the backtracking that makes long runs of digits cost their square
_RUNS = {"ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
         "phone": re.compile(BASE["phone"])}
_NEW = {kind: re.compile(pattern) for kind, pattern in ADDED.items()}
_WORDS = {kind: tuple(re.compile(f"[^a-z](?:{'|'.join(words)})[^a-z]") if words else None for words in (HELPFUL[kind], CONTRARY[kind])) for kind in KINDS}
_FOLD = str.maketrans(UPPER, LOWER)
_LEADING, _TRAILING = re.compile("^[a-z]*"), re.compile("[a-z]*$")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: int
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an account number: moved by four, letters as 10 to 35, the remainder by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every ``@`` with a domain, stretched to the left as far as the last address allows; each character is seen once."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _card(s: str) -> bool:
    return 12 <= len(d := _digits(s)) <= 19 and luhn(d)


_CONFIRM: dict[str, Callable[[str], bool]] = {"ip": _octets, "card": _card, "phone": lambda s: 9 <= len(_digits(s)) <= 15}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The confirmed base proposals: leftmost, not overlapping within a kind, failing ones dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for kind, pattern in _RUNS.items():
        if kind != "phone" or "+" in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _CONFIRM[kind](m.group())]
    return out


def context_score(text: str, kind: str, start: int, end: int) -> int:
    """What the whole words around a span are worth; words cut by the edge of the view do not count."""
    left = text[max(0, start - BEFORE):start].translate(_FOLD)
    right = text[end:end + AFTER].translate(_FOLD)
    if start > BEFORE:
        left = _LEADING.sub("", left, count=1)
    if end + AFTER < len(text):
        right = _TRAILING.sub("", right, count=1)
    view = f" {left} | {right} "
    helpful, contrary = _WORDS[kind]
    return (HELP if helpful and helpful.search(view) else 0) + (HARM if contrary and contrary.search(view) else 0)


def _is(text: str, i: int, test: Callable[[str], bool]) -> bool:
    return 0 <= i < len(text) and test(text[i])


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _iban_end(text: str, start: int, end: int) -> int | None:
    """The longest prefix of 15 to 34 characters that ends at a word's end and passes mod 97."""
    for stop in range(end, start + 14, -1):
        if text[stop - 1] != " " and not _is(text, stop, _alnum):
            compact = text[start:stop].replace(" ", "")
            if 15 <= len(compact) <= 34 and mod97(compact):
                return stop
    return None


def added_spans(text: str) -> Iterator[tuple[str, int, int, int]]:
    """``kind, start, end, score`` of the confirmed proposals beyond the base ones, before context."""
    for kind, pattern in _NEW.items():
        for m in pattern.finditer(text):
            start, end = m.span()
            score = SCORE[kind]
            if kind == "iban":
                end = None if _is(text, start - 1, _alnum) else _iban_end(text, start, end)
                if end is None:
                    continue
            elif _is(text, start - 1, _digit) or _is(text, end, _digit):
                continue
            elif kind == "card" and not _card(m.group()):
                continue
            elif kind == "phone" and not m.group().startswith("+"):
                score = BARE_PHONE
            elif kind == "ssn" and (m.group()[:3] in ("000", "666") or m.group()[0] == "9" or m.group()[4:6] == "00" or m.group()[7:] == "0000"):
                continue
            yield kind, start, end, score


def find_spans(text: str, threshold: int = THRESHOLD) -> list[Span]:
    """All spans by start, then kind. Base spans stay at any score; an added one needs ``threshold`` and must not lie
    within a base span."""
    base = base_spans(text)
    out = [Span(kind, a, b, SCORE[kind] + context_score(text, kind, a, b), True) for kind, a, b in base]
    inner = sorted((a, b) for _, a, b in base)
    reach, ends = 0, []
    for _, b in inner:
        reach = max(reach, b)
        ends.append(reach)
    for kind, a, b, score in added_spans(text):
        if not _covered(inner, ends, a, b) and (score := score + context_score(text, kind, a, b)) >= threshold:
            out.append(Span(kind, a, b, score, False))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def _covered(inner: list[tuple[int, int]], ends: list[int], a: int, b: int) -> bool:
    """Whether one of the spans, sorted by start and with the furthest end so far, starts at or before a and ends at b or after."""
    from bisect import bisect_right
    i = bisect_right(inner, (a, float("inf")))
    return i > 0 and ends[i - 1] >= b


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones together, replaced by its kind in angle brackets."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at:s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


SPAN_TYPE = "array<struct<kind:string,start:long,end:long,score:int,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32()), ("base", pa.bool_())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: int = THRESHOLD, redacted: bool = False) -> DataFrame:
    """``id, spans`` of every row (and ``redacted``, the text with its spans replaced), offsets in code points.

    One pass without a shuffle, whole texts, one text in memory at a time beside its batch. A null text counts as
    empty and has no spans; ids are carried as they are, null, text and repeated ones too, so each row gives one row;
    other columns are ignored. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, texts = [], []
            for cell in b.column(1):
                text = cell.as_py()
                spans = find_spans(text, threshold)
                found.append([s._asdict() for s in spans])
                if redacted:
                    texts.append(redact(text, spans))
            columns = [b.column(0), pa.array(found, _ARROW)] + ([pa.array(texts, pa.string())] if redacted else [])
            yield pa.RecordBatch.from_arrays(columns, names=["id", "spans", *(["redacted"] if redacted else [])])

    out = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).mapInArrow(
        run, f"id {kind}, spans {SPAN_TYPE}" + (", redacted string" if redacted else ""))
    return out.withColumnRenamed("id", id_col)
