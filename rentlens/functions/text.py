"""Text rules as Column expressions.

Page-side and value-side work is kept apart: everything that depends only on a
page (canonical text, separator-free text, line heads) is computed once per
page, everything that depends only on a value once per value, so the check of a
(value, page) pair is a plain ``contains`` inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as Python's str.split() sees it.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
)
_SPACES = r"(?U)[\s\x1c-\x1f]+"

# Characters that may stand between the digits of one number.
DIGIT_SEPARATORS = SPACE_CHARS + ",./:()-년월일"
NUMERIC_ONLY = r"^[0-9\s,./:()\-]+\z"

# Purpose words that must all be found again in the source text.
PURPOSE_MARKERS = (
    "근저당권", "전세권", "임차권", "압류", "가압류", "가처분",
    "경매개시결정", "신탁", "가등기", "말소", "변경", "이전",
)

# First matching word decides the kind of a right.
KIND_WORDS = (
    ("강제경매개시결정", "AUCTION"),
    ("임의경매개시결정", "AUCTION"),
    ("경매개시결정", "AUCTION"),
    ("가압류", "PROVISIONAL_SEIZURE"),
    ("압류", "SEIZURE"),
    ("가처분", "PROVISIONAL_DISPOSITION"),
    ("근저당권변경", "MORTGAGE_AMEND"),
    ("근저당권이전", "MORTGAGE_TRANSFER"),
    ("근저당권설정", "MORTGAGE"),
    ("전세권설정", "JEONSE_RIGHT"),
    ("주택임차권", "LEASEHOLD_REGISTRATION"),
    ("가등기", "PROVISIONAL_REGISTRATION"),
    ("소유권보존", "OWNERSHIP"),
    ("소유권이전", "OWNERSHIP"),
    ("공유자전원", "OWNERSHIP"),
    ("신탁", "TRUST"),
)

# Section headings of a register.
GAP_HEADING = r"[【\[]\s*갑\s*구\s*[】\]]"
EUL_HEADING = r"[【\[]\s*을\s*구\s*[】\]]"

# Long province names and their short forms.
PROVINCES = {
    "서울특별시": "서울", "부산광역시": "부산", "대구광역시": "대구",
    "인천광역시": "인천", "광주광역시": "광주", "대전광역시": "대전",
    "울산광역시": "울산", "세종특별자치시": "세종", "경기도": "경기",
    "강원특별자치도": "강원", "강원도": "강원", "충청북도": "충북",
    "충청남도": "충남", "전북특별자치도": "전북", "전라북도": "전북",
    "전라남도": "전남", "경상북도": "경북", "경상남도": "경남",
    "제주특별자치도": "제주",
}
PROVINCE_LONG = r"([가-힣]+(?:특별시|광역시|특별자치시|특별자치도|도))\s*([가-힣]+?[시군구])"
PROVINCE_SHORT = r"([가-힣]{2,3})\s*([가-힣]+?[시군구])"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Single spaces between words, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def compact(c: Column) -> Column:
    """Text without any white space; null becomes ''."""
    return F.translate(text(c), SPACE_CHARS, "")


def _only(c: Column, allowed: str) -> Column:
    # Collecting the allowed runs is several times faster than replacing the rest:
    # Java's negated character classes take a slow path.
    return F.array_join(F.regexp_extract_all(text(c), F.lit(f"[{allowed}]+"), 0), "")


def canonical(c: Column) -> Column:
    return F.lower(_only(c, "0-9A-Za-z가-힣"))


def digits(c: Column) -> Column:
    return _only(c, "0-9")


def name_key(c: Column) -> Column:
    return F.lower(compact(c))


def party_key(c: Column) -> Column:
    """Party name without a resident registration number."""
    return canonical(F.regexp_replace(text(c), r"(?U)\b[0-9]{6}-[0-9]{7}\b", ""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(text(c)), F.lit(""))


def pad4(c: Column) -> Column:
    """Left-pad with zeros to four characters, never truncating."""
    return F.when(F.length(c) >= 4, c).otherwise(F.lpad(c, 4, "0"))


def lot_number(c: Column) -> Column:
    """Lot number as text: '12.0' -> '0012'; anything but digits -> ''."""
    raw = F.regexp_replace(strip(text(c)), r"\.0\z", "")
    return F.when(raw.rlike(r"^[0-9]+\z"), pad4(raw)).otherwise(F.lit(""))


def first_integer(c: Column) -> Column:
    found = F.regexp_extract(F.regexp_replace(c, ",", ""), "-?[0-9]+", 0)
    return F.nullif(found, F.lit("")).try_cast("long")


def first_decimal(c: Column) -> Column:
    found = F.regexp_extract(F.regexp_replace(c, ",", ""), r"[0-9]+(?:\.[0-9]+)?", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def clean_integer(c: Column) -> Column:
    """Digits of a formatted amount as a long; none -> null."""
    return F.nullif(digits(c), F.lit("")).try_cast("long")


def iso_date(c: Column) -> Column:
    """A strict yyyy-MM-dd date, otherwise null."""
    raw = strip(c)
    ok = raw.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z")
    return F.try_to_date(F.when(ok, raw), "yyyy-M-d")


def date_from_parts(y: Column, m: Column, d: Column) -> Column:
    joined = F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string"))
    return F.try_to_date(F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), joined), "yyyy-M-d")


def loose_date(c: Column) -> Column:
    """First year, month, day run in a text with any separators, as yyyy-MM-dd text."""
    pattern = "([0-9]{4})[^0-9]+([0-9]{1,2})[^0-9]+([0-9]{1,2})"
    part = lambda i, width: F.lpad(F.regexp_extract(c, pattern, i), width, "0")
    return F.when(c.rlike(pattern), F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)))


def add_months(month: Column, k: int) -> Column:
    """'yyyy-MM' shifted by k months."""
    first = F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")
    return F.date_format(F.add_months(first, k), "yyyy-MM")


def month_index(month: Column) -> Column:
    """Months since year 0 of a 'yyyy-MM' text."""
    return F.substring(month, 1, 4).try_cast("int") * 12 + F.substring(month, 6, 2).try_cast("int") - 1


def date_month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def birth_age(birth: Column, as_of: Column) -> Column:
    """Age at a date from a yyMMdd birth text; the century is the one that keeps
    the age at or below 100. Malformed text or an impossible day gives null."""
    head = F.split(birth, "-", -1).getItem(0)
    ok = head.rlike(r"^[0-9]{6}\z")
    yy = F.substring(head, 1, 2).try_cast("int")
    year = F.when(F.year(as_of) - (yy + 1900) <= 100, yy + 1900).otherwise(yy + 2000)
    born = date_from_parts(year, F.substring(head, 3, 2), F.substring(head, 5, 2))
    before = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.when(ok & born.isNotNull(), F.year(as_of) - F.year(born) - before.cast("int"))


def target_ranks(purpose: Column) -> Column:
    """Ranks named in a purpose ('3번' -> '3', '7번(1)' -> '7(1)'), distinct, in order."""
    pattern = r"([0-9]+(?:-[0-9]+)?)\s*번(?:\s*\(([0-9]+)\))?"
    base = F.regexp_extract_all(text(purpose), F.lit(pattern), 1)
    suffix = F.regexp_extract_all(text(purpose), F.lit(pattern), 2)
    named = F.zip_with(
        base, suffix,
        lambda b, s: F.when(F.coalesce(s, F.lit("")) == "", b).otherwise(F.concat(b, F.lit("("), s, F.lit(")"))),
    )
    return F.array_distinct(named)


def right_kind(c: Column) -> Column:
    """Kind of a register entry from its purpose without spaces; the order of the tests matters."""
    mortgage = c.contains("근저당권")
    expr = (
        F.when(c.contains("말소"), "CANCELLATION")
        .when(mortgage & c.contains("변경"), "MORTGAGE_AMEND")
        .when(mortgage & c.contains("이전"), "MORTGAGE_TRANSFER")
    )
    for word, kind in KIND_WORDS:
        expr = expr.when(c.contains(word), kind)
    return expr.otherwise("OTHER")


def section_texts(full: Column) -> tuple[Column, Column]:
    """(ownership section, other-rights section); a missing heading gives null."""
    gap_mark = F.regexp_extract(full, GAP_HEADING, 0)
    eul_mark = F.regexp_extract(full, EUL_HEADING, 0)
    gap_at, eul_at = F.position(gap_mark, full), F.position(eul_mark, full)
    gap_from = gap_at + F.length(gap_mark)
    rest = F.length(full)
    gap = F.when(gap_mark != "", F.substring(
        full, gap_from,
        F.when(eul_mark == "", rest).otherwise(F.greatest(eul_at - gap_from, F.lit(0))),
    ))
    eul = F.when(eul_mark != "", F.substring(full, eul_at + F.length(eul_mark), rest))
    return gap, eul


def region_of(address: Column) -> Column:
    """'province district' of an address; long province names first, then short ones."""
    names = F.create_map(*[F.lit(x) for pair in PROVINCES.items() for x in pair])
    long1, long2 = (F.regexp_extract(address, PROVINCE_LONG, i) for i in (1, 2))
    short1, short2 = (F.regexp_extract(address, PROVINCE_SHORT, i) for i in (1, 2))
    short_name = F.coalesce(F.try_element_at(names, long1), F.substring(long1, 1, 2))
    return (
        F.when(long1 != "", F.concat_ws(" ", short_name, long2))
        .when(short1 != "", F.concat_ws(" ", short1, short2))
    )


# ---- evidence in page text -------------------------------------------------

def without_separators(page: Column) -> Column:
    return F.translate(page, DIGIT_SEPARATORS, "")


def number_key(value: Column, is_number: bool = False) -> Column:
    """Digits to look for when a value is only a number (two digits or more), else null."""
    raw = text(value)
    keep = F.length(digits(raw)) >= 2
    if not is_number:
        keep = keep & raw.rlike(NUMERIC_ONLY)
    return F.when(keep, digits(raw))


def key_supported(canon: Column, number: Column, page_canon: Column, page_nosep: Column) -> Column:
    """Is a value (given by its two keys) found in a page (given by its two forms)?"""
    return F.coalesce(
        ((canon != "") & F.contains(page_canon, canon)) | F.contains(page_nosep, number),
        (canon != "") & F.contains(page_canon, canon),
        F.lit(False),
    )


def value_supported(value: Column, page: Column, is_number: bool = False) -> Column:
    return key_supported(
        canonical(value), number_key(value, is_number), canonical(page), without_separators(page)
    )


def purpose_supported(
    purpose: Column, page_canon: Column, page_nosep: Column, markers=PURPOSE_MARKERS
) -> Column:
    """Purpose found as a whole, or every marker word (and leading rank) it contains found."""
    return purpose_key_supported(canonical(purpose), number_key(purpose), page_canon, page_nosep, markers)


def purpose_key_supported(
    canon: Column, number: Column, page_canon: Column, page_nosep: Column, markers=PURPOSE_MARKERS
) -> Column:
    target = F.regexp_extract(canon, "^([0-9]+)번", 1)
    present = [canon.contains(m) for m in markers] + [target != ""]
    found = [page_canon.contains(m) for m in markers] + [
        F.contains(page_canon, F.concat(target, F.lit("번")))
    ]
    any_present = reduce(lambda a, b: a | b, present)
    all_found = reduce(lambda a, b: a & b, [~p | f for p, f in zip(present, found)])
    return key_supported(canon, number, page_canon, page_nosep) | (any_present & all_found)


def line_heads(page: Column) -> Column:
    """First word of every line."""
    return F.regexp_extract_all(page, F.lit(r"(?mU)^\s*(\S+)"), 1)


def split_heads(page: Column) -> Column:
    """'7(1)' for a line '7' followed by a line that starts with '(1)'."""
    found = F.regexp_extract_all(page, F.lit(r"(?md)^[ \t]*[0-9]+[ \t]*$\r?\n[ \t]*\([0-9]+\)"), 0)
    return F.transform(found, lambda m: F.regexp_replace(m, r"\s+", ""))


def rank_supported(rank: Column, heads: Column, split: Column) -> Column:
    r = F.regexp_replace(strip(text(rank)), r"\s*번\s*\z", "")
    hit = F.when(r.rlike(r"^[0-9]+\([0-9]+\)\z"), F.array_contains(split, r)).otherwise(
        F.array_contains(heads, r)
    )
    return (r != "") & hit


def address_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit("([가-힣a-z]+|[0-9]+)"), 1)


def tokens_in_order(tokens: Column, source: Column) -> Column:
    """Do all tokens (three or more) occur in the source tokens in this order?"""
    n = F.size(tokens)
    reached = F.aggregate(
        source, F.lit(0),
        lambda i, t: F.when((i < n) & F.try_element_at(tokens, i + 1).eqNullSafe(t), i + 1).otherwise(i),
    )
    return (n >= 3) & (reached == n)


def address_supported(address: Column, page: Column, page_canon: Column, page_nosep: Column) -> Column:
    direct = key_supported(canonical(address), number_key(address), page_canon, page_nosep)
    return F.when(direct, True).otherwise(tokens_in_order(address_tokens(address), address_tokens(page)))


def share_fraction(share: Column, page: Column) -> Column:
    """Share as 'a/b' when the page supports it; 'b분의 a' is turned around."""
    slash, korean = r"^\s*([0-9]+)\s*/\s*([0-9]+)\s*\z", r"^\s*([0-9]+)\s*분의\s*([0-9]+)\s*\z"
    g = lambda p, i: F.regexp_extract(share, p, i)
    supported = value_supported(share, page)
    turned = F.concat(g(slash, 2), F.lit("분의"), g(slash, 1))
    return F.when(share.isNull() | (share == ""), F.lit(None).cast("string")).when(
        share.rlike(slash),
        F.when(supported | F.contains(compact(page), turned), F.concat_ws("/", g(slash, 1), g(slash, 2))),
    ).when(
        share.rlike(korean) & supported, F.concat_ws("/", g(korean, 2), g(korean, 1))
    ).when(supported, strip(share))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; inside a lambda, Spark would
    otherwise compute it again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Fixed value: every line end, a carriage return with its line feed first.
LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def excerpt(page: Column, values: list[Column], more: Column | None = None) -> Column:
    """Lines holding one of the values, with a neighbour on each side, joined by ' | '.

    Only the first line that holds a value counts for that value. ``more`` is an array
    of further values.
    """
    lines = F.filter(F.transform(F.split(page, LINE_ENDS), strip), lambda s: s != "")
    forms = F.transform(lines, lambda s: F.struct(s.alias("s"), canonical(s).alias("c"), digits(s).alias("d")))
    key = lambda v: F.struct(canonical(v).alias("c"), digits(v).alias("d"))
    wanted = F.array(*[key(v) for v in values])
    keys = F.filter(
        wanted if more is None else F.concat(wanted, F.transform(more, key)),
        lambda k: (k["c"] != "") | (F.length(k["d"]) >= 2))

    def holds(line: Column, key: Column) -> Column:
        return ((key["c"] != "") & F.contains(line["c"], key["c"])) | (
            (F.length(key["d"]) >= 2) & F.contains(line["d"], key["d"]))

    def around(v: Column) -> Column:
        hits = F.transform(v["keys"], lambda k: F.array_position(F.transform(v["lines"], lambda x: holds(x, k)), F.lit(True)))
        return let(F.filter(hits, lambda h: h > 0), lambda found: F.array_join(F.transform(
            F.filter(v["lines"], lambda x, i: F.exists(found, lambda h: F.abs(h - 1 - i) <= 1)), lambda x: x["s"]), " | "))

    return let(F.struct(forms.alias("lines"), keys.alias("keys")), around)


# ---- display ---------------------------------------------------------------

def money_label(amount: Column) -> Column:
    """Won amount in units of 10^8 and 10^4, with carry."""
    a = F.abs(amount)
    rest = F.rint((a % 100_000_000) / 10_000).cast("long")
    carry = rest == 10_000
    eok = F.call_function("div", a, F.lit(100_000_000)) + carry.cast("long")
    man = F.when(carry, F.lit(0)).otherwise(rest)
    grouped = lambda c: F.format_number(c, 0)
    body = (
        F.when((eok > 0) & (man > 0), F.concat(eok.cast("string"), F.lit("억 "), grouped(man), F.lit("만원")))
        .when(eok > 0, F.concat(eok.cast("string"), F.lit("억원")))
        .when(man > 0, F.concat(grouped(man), F.lit("만원")))
        .otherwise(F.concat(grouped(a), F.lit("원")))
    )
    return F.when(amount.isNull(), F.lit("확인 필요")).otherwise(
        F.concat(F.when(amount < 0, F.lit("-")).otherwise(F.lit("")), body)
    )


def rate_label(rate: Column) -> Column:
    return F.when(rate.isNull(), F.lit("확인 필요")).otherwise(
        F.format_string("%.2f%%", rate * 100)
    )


def percent2(rate: Column) -> Column:
    return F.bround(rate * 100, 2)


def file_tag(filename: Column) -> Column:
    """File name made safe for use inside a '[FILE x]' tag."""
    safe = strip(F.regexp_replace(filename, r"[\[\]\r\n]+", "_"))
    return F.when(safe == "", F.lit("unnamed.pdf")).otherwise(safe)


# ---- units -----------------------------------------------------------------

def unit_label(value: Column, suffix: str) -> Column:
    """Unit label without the leading '제' and the trailing suffix."""
    cut = F.regexp_replace(F.regexp_replace(strip(value), "^제", ""), suffix + r"\z", "")
    return F.nullif(strip(cut), F.lit(""))


def unit_from_address(address: Column, suffix: str) -> Column:
    if suffix == "동":
        p = r"(?U)(?:제\s*([가-힣A-Za-z0-9-]+)|([A-Za-z0-9-]+))\s*동\b"
        first, second = F.regexp_extract(address, p, 1), F.regexp_extract(address, p, 2)
        return F.nullif(F.when(first != "", first).otherwise(second), F.lit(""))
    p = rf"(?U)(?:제\s*)?([가-힣A-Za-z0-9-]+)\s*{suffix}\b"
    return F.nullif(F.regexp_extract(address, p, 1), F.lit(""))


def is_legal_dong(value: Column, address: Column) -> Column:
    """Is the label the legal district before a lot number rather than a building unit?"""
    label = unit_label(value, "동")
    quoted = F.concat(F.lit(r"\Q"), label, F.lit(r"\E"))
    legal = F.concat(quoted, F.lit(r"\s*동\s+(?:산\s*)?[0-9]+(?:-[0-9]+)?(?:\s|$)"))
    explicit = F.concat(F.lit(r"(?U)제\s*"), quoted, F.lit(r"\s*동\b"))
    return F.coalesce(F.rlike(address, legal) & ~F.rlike(address, explicit), F.lit(False))
