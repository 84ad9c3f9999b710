import hashlib
import random
import re
import time

import pytest
from helpers_llm import empty, odd, saved
from pyspark.sql import functions as F

from quillon.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(float(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d))))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(t):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if holds(k, m[0])]


def base(t):
    return [x for x in personal.spans(t) if x[0] in personal.BASE]


CARD = "4111 1111 1111 1111"
CASES = [
    "a@b.c", "a@b@c.d", "a@b.c@d.e", "x.y+z%1@mail-5.example.com.", "@b.c", "a@b..c", "a@.b", "é@b.c a@é.c", "a@b.c,d@e.f;", "1.2.3.4@5.6.7.8",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "001.02.3.255", "256.1.1.1", "1.2.3", "1..2.3.4.5", "9" * 5000 + ".1.1.1", "1.2.3.4.", ".1.2.3.4 1.2.3.4-5.6.7.8",
    CARD, CARD.replace(" ", "-"), CARD + " 1", CARD[:-1] + "2", "x" + CARD + "y", "4111  1111 1111 1111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4111 1111 1111 1111 -", "0" * 16, "0" * 20,
    "+49 (30) 123-4567", "+1", "+12", "+123", "+1 2", "+1-234567", "+1234567890123456", "+ 12345678", "++12345678 ", "+12345678+87654321", "+1 (2) 345 678 90 ().-", "+123.456.78.90",
    "😀a@b.c 😀1.2.3.4", "", "\x00a@b.c\n",
]


@pytest.mark.parametrize("t", CASES)
def test_base_spans_are_those_of_the_patterns(t):
    assert base(t) == brute(t)


def test_random_texts_against_the_patterns():
    rng = random.Random(3)
    for alphabet in ("0123456789.@+-() aA%_é", "01.", "0123456789 -", "+12 ()-.", "a@.b-", "ab@.:/09 "):
        for _ in range(700):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert base(t) == brute(t), t


def got(t):
    return [(k, t[s:e]) for k, s, e in personal.spans(t) if k not in personal.BASE]


def test_further_kinds():
    assert got("see https://user@www.example.com:8080/a(b)?c=d#e. (http://ex.org/x)") == [("address", "https://user@www.example.com:8080/a(b)?c=d#e"), ("address", "http://ex.org/x")]
    assert got("http://[2001:db8::1]:80/ ftp://1.2.3.4/ http://1.2.3.999/ http://a.b:99999/ http://localhost/ ://x.y") == [("address", "http://[2001:db8::1]:80/"), ("address", "ftp://1.2.3.4/")]
    assert got('jörg@exämple.de "a b"@ex.org plain@ex.org') == [("mailbox", "jörg@exämple.de"), ("mailbox", '"a b"@ex.org')]
    assert got("IBAN: DE89 3704 0044 0532 0130 00 and iban GB82WEST12345698765432, IBAN DE88 3704 0044 0532 0130 00 taliban GB82WEST12345698765432") == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert got("Account number: 1234-5678, passport X1234567. account 12 subaccount 123456 Konto 12345ß ACCT#998877") == [("account", "1234-5678"), ("account", "X1234567"), ("account", "998877")]


def test_masks_cover_spans_and_leave_the_rest():
    t = "write to a@b.c or jö@ex.de at +49 30 1234567."
    assert personal.masked(t, personal.spans(t)) == "write to [email] or [mailbox] at [phone]."
    assert personal.masked("clean", personal.spans("clean")) == "clean"


@pytest.mark.parametrize("unit", ["a@", "1.", "1 ", "+1", "a://", "://", "http://a.b/", "account ", "IBAN ", '"@', "a.b@c.d", "@a.", "9" * 50])
def test_long_texts_take_linear_time(unit):
    t = unit * (400_000 // len(unit))
    began = time.time()
    personal.spans(t)
    assert time.time() - began < 8


def test_odd_rows(spark, tmp_path):
    docs = odd(spark).unionByName(spark.createDataFrame([(k, t) for k, t in enumerate(CASES, 100)], "doc_id long, text string"), allowMissingColumns=True)
    out = personal.find(docs.withColumn("n_email", F.lit("x")))
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, *personal.ADDED}
    folder = saved(docs, tmp_path)
    for r in personal.op11_personal(spark, folder).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        want = brute(r.text)
        assert r.base_sha256 == hashlib.sha256(personal.joined(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.BASE] == [sum(x[0] == k for x in want) for k in personal.BASE]
        assert r.spans == personal.joined(personal.spans(r.text or ""))
    hidden = personal.mask(docs)
    assert hidden.columns == docs.columns and hidden.filter("text is null").count() == docs.filter("text is null").count()
    assert personal.find(hidden).filter("n_email > 0").count() == 0
    assert personal.find(empty(spark)).collect() == [] and personal.mask(empty(spark)).collect() == []
