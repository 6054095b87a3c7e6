"""On which pages of its document each asked needle stands.

Needles are short strings asked of one document, each in a form:

* ``C`` a part of the page's canonical text,
* ``N`` a run of digits once separators are dropped,
* ``T`` a rank followed by its number word, not after a digit,
* ``R`` the head of a line (``7`` or, over two lines, ``7(1)``).

Asks and pages are shuffled once, on the document, and sorted: a document's asks, then its pages. They are walked in
order, with one document's needles and the page before as state. What crosses from a page to the next is found in the
seam between the two, which is as long as the document's longest needle. An ask leaves with the page numbers of its
needles; texts stay behind.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_type

from rentlens.functions import text as T

#: Needles of a page with more needles than characters are looked up by their first characters, so many of them.
LEAD = 4
#: Only these roles are asked of pages numbered below zero (sections).
SECTION_ROLES = "PMQ"
_WHITE = " \t\n\x0b\x0c\r"
_CANON = re.compile("[0-9A-Za-z가-힣]+")
_TOKEN = re.compile("[가-힣a-z]+|[0-9]+")
_COMPOSITE = re.compile(r"[0-9]+\([0-9]+\)")
_SPLIT = re.compile(r"^[ \t]*[0-9]+[ \t]*$\n[ \t]*\([0-9]+\)", re.M)
_DROPPED = dict.fromkeys(map(ord, T.DIGIT_SEPARATORS))
FOUND = ST.ArrayType(ST.StructType([ST.StructField("role", ST.StringType()), ST.StructField("idx", ST.IntegerType()),
                                    ST.StructField("ones", ST.ArrayType(ST.IntegerType())), ST.StructField("twos", ST.ArrayType(ST.IntegerType()))]))


def _split_heads(text: str) -> set[str]:
    return {re.sub(r"\s+", "", m) for m in _SPLIT.findall(text)}


def _numbered(text: str, rank: str) -> bool:
    """Is a rank, not after a digit, followed by its number word?"""
    at = text.find(rank)
    while at >= 0:
        if (not at or text[at - 1] not in "0123456789") and text[at + len(rank):].lstrip(_WHITE).startswith("번"):
            return True
        at = text.find(rank, at + 1)
    return False


class _Needles:
    """Distinct needles by form, and those that a page holds."""

    def __init__(self, needles: set[tuple[str, str]]):
        of = {f: [] for f in "CNTR"}
        for f, n in needles:
            of[f].append(n)
        self.canon, self.digits, self.ranks = of["C"], of["N"], of["T"]
        self.split = [n for n in of["R"] if _COMPOSITE.fullmatch(n)]
        self.heads = [n for n in of["R"] if not _COMPOSITE.fullmatch(n)]
        self.longest = [max(map(len, of[f]), default=1) for f in "CNT"]
        self.short = [n for n in self.canon if len(n) < LEAD]
        self.by_lead = defaultdict(list)
        for n in self.canon:
            if len(n) >= LEAD:
                self.by_lead[n[:LEAD]].append(n)

    def _near(self, canon: str) -> Iterator[str]:
        if len(self.canon) <= len(canon):
            return iter(self.canon)
        leads = {canon[i:i + LEAD] for i in range(len(canon) - LEAD + 1)}
        return (n for some in (self.short, *(self.by_lead.get(x, ()) for x in leads)) for n in some)

    def held(self, canon: str, nosep: str, text: str, heads: list[str], lines: str) -> set[tuple[str, str]]:
        out = {("C", n) for n in self._near(canon) if n in canon} if canon else set()
        if self.digits:
            out.update([("N", n) for n in self.digits if n in nosep])
        if self.ranks:
            out.update([("T", n) for n in self.ranks if _numbered(text, n)])
        if self.heads and heads:
            out.update([("R", n) for n in set(heads).intersection(self.heads)])
        if self.split:
            out.update([("R", n) for n in _split_heads(lines).intersection(self.split)])
        return out


class _Document:
    """The asks of one document and where its pages hold their needles."""

    def __init__(self):
        self.asks, self.ones, self.twos = [], defaultdict(set), defaultdict(set)
        self.number, self.here, self.before, self.needles = None, [], [], None

    def read(self, number: int, text: str, heads: list[str] | None) -> None:
        if self.needles is None:
            terms = [t for _, _, terms in self.asks for t in terms]
            self.needles = _Needles({t[2:] for t in terms}), _Needles({t[2:] for t in terms if t[0] in SECTION_ROLES})
        needles = self.needles[number < 0]
        canon, nosep = "".join(_CANON.findall(text)).lower(), text.translate(_DROPPED) if needles.digits else ""
        found = needles.held(canon, nosep, text, heads or [], text)
        for x in found:
            self.ones[x].add(number)
        if number != self.number:
            self.before, self.here = self.here if self.number is not None and number == self.number + 1 else [], []
            self.number = number
        c, n, t = needles.longest
        for tails, earlier in self.before:
            seam = tails[0] + canon[:c - 1], tails[1] + nosep[:n - 1], f"{tails[2]}\n{text.lstrip(_WHITE)[:1]}"
            lines = f"{tails[3]}\n{text.split(chr(10), 1)[0]}" if needles.split else ""
            for x in found | earlier | needles.held(*seam, [], lines):
                self.twos[x].add(number - 1)
        tail = lambda s, k: s[-k:] if k > 0 else ""
        self.here.append(((tail(canon, c - 1), tail(nosep, n - 1), tail(text.rstrip(_WHITE), t + 1), text.rsplit("\n", 1)[-1]), found))

    def answers(self) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
        """Each ask's place and what was found for it; asks of one number share what is found."""
        # each needle's pages in order, once for all that ask for it
        pages = {x: (sorted(self.ones.get(x, ())), sorted(self.twos.get(x, ()))) for x in self.ones.keys() | self.twos.keys()}
        for _, asks in groupby(sorted(self.asks, key=lambda a: a[1]), key=lambda a: a[1]):
            asks = list(asks)
            found = [(term[0], term[1], *pages[term[2:]]) for _, _, terms in asks for term in terms if term[2:] in pages]
            for place, _, _ in asks:
                yield place, found


def _found_array(found: list[list[tuple]]) -> pa.Array:
    flat = [x for f in found for x in f]
    ends = [0]
    for f in found:
        ends.append(ends[-1] + len(f))
    columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["role", "idx", "ones", "twos"]))


def _strings(column: pa.Array) -> list[str | None]:
    """A column of strings as a list, made at once and not value by value."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _lists(column: pa.Array) -> list[list | None]:
    """A column of lists of strings as lists, null as none."""
    flat, ends = _strings(column.flatten()), [0]
    sizes = column.value_lengths().to_pylist()
    for k in sizes:
        ends.append(ends[-1] + (k or 0))
    return [None if k is None else flat[a:b] for k, a, b in zip(sizes, ends, ends[1:])]


def _walker(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, doc, done = {}, None, _Document(), []

        def emit() -> Iterator[pa.RecordBatch]:
            for n, some in groupby(sorted(done, key=lambda x: x[0]), key=lambda x: x[0][0]):
                some = list(some)
                rows = held[n].take(pa.array([row for (_, row), _ in some], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, _found_array([f for _, f in some])], names=[*columns, "_found"])
            done.clear()

        for n, b in enumerate(batches):
            held[n] = b.select(columns)
            terms = b.column("_terms")
            flat, ends = terms.flatten(), [0]
            role, idx, form, needle = (flat.field(i) for i in range(4))
            parts = list(zip(_strings(role), idx.to_numpy().tolist(), _strings(form), _strings(needle)))
            for k in terms.value_lengths().to_pylist():
                ends.append(ends[-1] + (k or 0))
            read = [b.column(c).to_pylist() for c in ("doc_id", "seq", "_page")] + [_strings(b.column("_text")), _lists(b.column("_heads"))]
            for row, (d, seq, page, text, heads) in enumerate(zip(*read)):
                if d != key:
                    done.extend(doc.answers())
                    key, doc = d, _Document()
                if page is None:
                    doc.asks.append(((n, row), seq, parts[ends[row]:ends[row + 1]]))
                elif doc.asks:
                    doc.read(page, text, heads)
            yield from emit()
            live = {place[0] for place, _, _ in doc.asks}
            held = {k: v for k, v in held.items() if k in live}
        done.extend(doc.answers())
        yield from emit()
    return run


def find_terms(asks: DataFrame, pages: DataFrame, terms: Column) -> DataFrame:
    """The asks with ``_found``: role, idx, ones and twos of each of their terms that its document holds. ``ones`` are
    the pages with the needle, ``twos`` the first pages of pairs of neighbouring pages that hold it together.

    ``asks``: doc_id, seq and what ``terms`` reads, an array of (role, idx, form, needle). ``pages``: doc_id, page_no,
    text; page n and n + 1 are neighbours, any other numbering only needs gaps; below zero only ``SECTION_ROLES`` are
    looked for. Asks of which nothing is found have an empty list. Null texts and null documents find nothing.
    """
    a = asks.where(F.col("doc_id").isNotNull() & F.col("seq").isNotNull())
    kind = asks.schema["doc_id"].dataType
    p = pages.where(F.col("doc_id").isNotNull() & F.col("page_no").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.col("page_no").cast("int").alias("_page"), F.col("text").alias("_text"))
    none = lambda t: F.lit(None).cast(t)
    rows = a.withColumns({"_page": none("int"), "_text": none("string")}).unionByName(p, allowMissingColumns=True)
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", F.col("_page").asc_nulls_first())
    rows = rows.withColumns({"_terms": F.when(F.col("_page").isNull(), terms), "_heads": F.when(F.col("_page") > 0, T.line_heads(F.col("_text")))})
    schema = ST.StructType([*[ST.StructField(f.name, f.dataType) for f in a.schema], ST.StructField("_found", FOUND)])
    return rows.mapInArrow(_walker(a.columns), schema)


class _Owners:
    """The owners of one document that are still looked for, and the last page, whose next one has not been read."""

    def __init__(self):
        self.rows, self.open, self.found, self.page = [], defaultdict(list), {}, None

    def ask(self, place: tuple[int, int], seq, keys: dict | None) -> None:
        self.rows.append((place, seq))
        if keys is not None:
            self.open[seq].append(keys)

    def read(self, number, text: str | None) -> None:
        self.settle(text)
        self.page = (number, text) if self.open and text is not None else None

    def settle(self, after: str | None) -> None:
        """Looks on the last page, and over it and the next, for each owner without a place."""
        if self.page is None:
            return
        number, text = self.page
        page, both = _OwnerPage(text), None
        for seq, asked in list(self.open.items()):
            pages = 0
            for keys in asked:
                if keys["_name"] not in page.canon or not page.names_owner(keys):
                    continue
                if not keys["_address"] or page.supports(keys):
                    pages = 1
                    break
                if after is not None:
                    both = both or _OwnerPage(f"{text}\n{after}")
                    pages = 2 if both.supports(keys) else pages
            if pages and number is None:
                self.found.setdefault(seq, (None, None, None, None))
            elif pages:
                self.found[seq] = number, pages, text, after if pages == 2 else None
                del self.open[seq]

    def answers(self) -> Iterator[tuple[tuple[int, int], tuple]]:
        self.settle(None)
        return ((place, self.found[seq]) for place, seq in self.rows if seq in self.found)


class _OwnerPage:
    """A page's text, or that of two, with its forms; each is made when it is first asked for."""

    def __init__(self, text: str):
        self.text, self.canon = text, "".join(_CANON.findall(text)).lower()

    @cached_property
    def nosep(self) -> str:
        return self.text.translate(_DROPPED)

    @cached_property
    def tokens(self) -> list[str]:
        return _TOKEN.findall(self.text.lower())

    def names_owner(self, keys: dict) -> bool:
        """Does the id stand within the window around one of the name's occurrences, which do not overlap?"""
        if not keys["_jumin"]:
            return True
        ids = [x for x in {keys["_id"], keys["_id_no"]} if x is not None and x in self.canon] if keys["_id"] else []
        size, at = len(keys["_name"]), self.canon.find(keys["_name"])
        while ids and at >= 0:
            if any(self.canon.find(x, max(at - keys["_window"], 0), at + size + keys["_window"]) >= 0 for x in ids):
                return True
            at = self.canon.find(keys["_name"], at + size)
        return False

    def supports(self, keys: dict) -> bool:
        """Is the address found as a whole, by its digits, or by three or more words in their order?"""
        if keys["_address_canon"] and keys["_address_canon"] in self.canon or keys["_address_no"] and keys["_address_no"] in self.nosep:
            return True
        if len(keys["_tokens"]) < 3:
            return False
        left = iter(self.tokens)
        return all(t in left for t in keys["_tokens"])


def find_owners(owners: DataFrame, pages: DataFrame, keys: list[str], window: int) -> DataFrame:
    """The owners with the first page that supports them, ``first_page, n_pages, _t1, _t2``; others drop out.

    ``owners``: doc_id, owner_seq and ``keys`` (_name, null for an owner not looked for, _jumin, _id, _id_no, _address,
    _address_canon, _address_no, _tokens), which stay behind. Owners of one number share the first place of any of them.
    Owners and pages are shuffled once, on the document, and a document's pages are read in order until all its owners
    have a place; two neighbouring pages are in memory at a time.
    """
    a = owners.where(F.col("doc_id").isNotNull() & F.col("owner_seq").isNotNull())
    kind, number = owners.schema["doc_id"].dataType, pages.schema["page_no"].dataType
    p = pages.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("page_no").alias("_page"), F.col("text").alias("_text"), F.lit(True).alias("_read"))
    rows = a.withColumn("_read", F.lit(False)).unionByName(p, allowMissingColumns=True)
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "_read", "_page")
    columns = [c for c in owners.columns if c not in keys]
    added = [ST.StructField("first_page", number), ST.StructField("n_pages", ST.IntegerType()), ST.StructField("_t1", ST.StringType()), ST.StructField("_t2", ST.StringType())]
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, doc, done = {}, None, _Owners(), []

        def emit() -> Iterator[pa.RecordBatch]:
            for n, some in groupby(sorted(done, key=lambda x: x[0]), key=lambda x: x[0][0]):
                some = list(some)
                rows = held[n].take(pa.array([row for (_, row), _ in some], pa.int64()))
                places = [pa.array([place[i] for _, place in some], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *places], names=[*columns, *(f.name for f in added)])
            done.clear()

        for n, b in enumerate(batches):
            held[n] = b.select(columns)
            asked = [c.to_pylist() for c in b.select(keys).columns]
            for row, (d, seq, read, page, text) in enumerate(zip(*[b.column(c).to_pylist() for c in ("doc_id", "owner_seq", "_read", "_page", "_text")])):
                if d != key:
                    done.extend(doc.answers())
                    key, doc = d, _Owners()
                if read:
                    doc.read(page, text)
                else:
                    mine = dict(zip(keys, [c[row] for c in asked]), _window=window)
                    doc.ask((n, row), seq, mine if mine["_name"] else None)
            yield from emit()
            live = {place[0] for place, _ in doc.rows}
            held = {k: v for k, v in held.items() if k in live}
        done.extend(doc.answers())
        yield from emit()

    return rows.mapInArrow(run, ST.StructType([*[owners.schema[c] for c in columns], *added]))
