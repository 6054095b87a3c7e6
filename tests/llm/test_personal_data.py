"""Personal data against the plain expressions, and the added spans."""

import random
import re

from rentlens.llm import personal_data as P


def plain_base(text):
    out = []
    for kind, pattern in P.BASE.items():
        for m in re.finditer(pattern, text):
            s = m.group()
            digits = [int(c) for c in s if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == "card":
                doubled = [2 * d if i % 2 else d for i, d in enumerate(digits[::-1])]
                if not 12 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out)


def test_base_is_what_the_plain_expressions_find():
    rng = random.Random(5)
    found = 0
    for _ in range(30_000):
        text = "".join(rng.choice("aZ@.@.-+ 0123456789().%é\n") for _ in range(rng.randint(0, 60)))
        found += len(plain_base(text))
        assert sorted(P.base_spans(text)) == plain_base(text), text
    assert found > 2000


def test_checksums():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("DE89370400440532013000") and P.mod97("GB82WEST12345698765432") and not P.mod97("DE89370400440532013001")


def kinds(text, **options):
    return [(s.kind, text[s.start:s.end], s.base) for s in P.find_spans(text, **options)]


def test_added_spans_and_context():
    text = "call +1 (689) 555-1019 4472194062177086 now"          # the base expressions run the two numbers together
    assert not P.base_spans(text)
    assert kinds(text) == [("phone", "+1 (689) 555-1019", False), ("card", "4472194062177086", False)]
    assert kinds("iban DE89 3704 0044 0532 0130 00 IS") == [("iban", "DE89 3704 0044 0532 0130 00", False)]
    assert kinds("ES9121000418450200051332 x") == [("iban", "ES9121000418450200051332", False)]
    assert kinds("ES9121000418450200051333 x") == []
    assert kinds("my ssn is 123-45-6789") == [("ssn", "123-45-6789", False)] and kinds("part 123-45-6789") == [] and kinds("123-45-6789") == []
    assert kinds("ssn 000-45-6789, 123-00-6789, 123-45-67890") == []
    assert kinds("phone: 415 555-1212") == [("phone", "415 555-1212", False)] and kinds("415 555-1212") == [] and kinds("hotel 415 555-1212") == []
    assert kinds("x" * 45 + "tel 415 555-1212") == [] and kinds("a" * 60 + " tel 415 555-1212") == [("phone", "415 555-1212", False)]


def test_base_stays_at_any_score():
    span, = P.find_spans("version 1.2.3.4", threshold=90)
    assert span.base and span.score == P.SCORE["ip"] + P.HARM
    assert P.redact("a b@c.de 1.2.3.4", P.find_spans("a b@c.de 1.2.3.4")) == "a <email> <ip>"


def test_long_texts_take_linear_time():
    import time
    start = time.time()
    for text in ("a" * 10**6, "1" * 10**6, "a@" * 500_000, "AB12" + "A" * 10**6, "+" + "1" * 10**6 + " " * 10**6, "1-" * 500_000):
        P.find_spans(text)
    assert time.time() - start < 30


def test_rows(spark):
    schema = "doc_id string, text string, id string, t string, spans string, redacted string"
    rows = [(None, None, *"abcd"), ("x", "", *"abcd"), ("x", "mail a.b@c.de", *"abcd"), ("x", "mail a.b@c.de", *"abcd"), ("y", "😀 8.8.8.8", *"abcd")]
    out = P.detect(spark.createDataFrame(rows, schema), redacted=True)
    assert out.columns == ["doc_id", "spans", "redacted"]
    got = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans], r.redacted) for r in out.collect())
    assert got == [("None", [], ""), ("x", [], ""), ("x", [("email", 5, 13)], "mail <email>"), ("x", [("email", 5, 13)], "mail <email>"), ("y", [("ip", 2, 9)], "😀 <ip>")]
    assert P.detect(spark.createDataFrame([], schema)).count() == 0


def test_twin_on_hard_texts(spark, tmp_path):
    import duckdb

    from rentlens.llm import queries as Q
    from tests.oracle import duck_rows, spark_rows
    rng = random.Random(2)
    words = ["+1 (689) 555-1019", "4472194062177086", "4472 1940 6217 7086", "DE89 3704 0044 0532 0130 00", "ES9121000418450200051332", "AT61", "123-45-6789", "tel", "Phone",
             "order", "ssn", "8.8.8.8", "1.2.3.256", "a@b.c", "x@y.z@q.r.s", "415 555-1212", "415.555.1212", "hotel", "é", "NO93 8601 1117 947", "IS", "0", "-", ".", "version"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "", ", ", "\n"]) for _ in range(rng.randint(0, 25)))) for i in range(400)] + [(400, None), (401, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mine, theirs = spark_rows(Q.op11_personal_data(spark, str(tmp_path))), duck_rows(con, Q.OP11)
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1], (list((mine[1] - theirs[1]))[:2], list((theirs[1] - mine[1]))[:2])
