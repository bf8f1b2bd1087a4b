"""PII spans against the plain patterns."""

import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tracewarden.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                good = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                good = 14 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(int(d) * 2, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            else:
                good = kind == "email" or 10 <= len(digits) <= 15
            if good:
                out.append((m.start(), list(PLAIN).index(kind), m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def own(text):
    return [(s.start, s.end, s.kind) for s in pii.find(text) if s.kind in PLAIN]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab.@-+%() 0123459é\n", max_size=60))
def test_dense(text):
    assert own(text) == plain(text)


def test_soup():
    r = random.Random(5)
    parts = ["a@b.co", "x.y@", "@b.c.d", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "+44.20", " ", "-", ".", "7", "é", "@", "word"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert own(text) == plain(text)


def test_long_runs_are_linear():
    began = time.time()
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "a@" * 500_000, "+1" + " " * 1_000_000, "a-" * 500_000, "token=" * 300_000, "DE89 " * 300_000, "key: " + "a1" * 500_000, "eyJ" * 300_000):
        pii.find(text)
    assert time.time() - began < 40


def test_validators_and_context():
    assert [s.kind for s in pii.find("iban DE89 3704 0044 0532 0130 00 ok")] == ["iban"]
    assert pii.find("DE88370400440532013000") == []
    assert [s.kind for s in pii.find("her ssn is 123-45-6789.")] == ["ssn"] and pii.find("part 123-45-6789") == []
    assert pii.masked("mail a@b.co or +1 555 010 9999 x", pii.find("mail a@b.co or +1 555 010 9999 x")) == "mail <EMAIL> or <PHONE> x"


def test_ibans_have_their_countrys_length():
    accounts = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NO9386011117947", "MT84MALT011000012345MTLCAST001S", "NL91ABNA0417164300"]
    spaced = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in accounts]
    for x in (*accounts, *spaced):
        for text in (x, f"Account {x} AND more", f"({x}), {x} 12 NEXT"):
            assert {text[s.start : s.end] for s in pii.find(text) if s.kind == "iban"} == {x}, text
        assert not [s for s in pii.find(f"{x}Z A{x} {x[:-1]}") if s.kind == "iban"]
    assert not [s for s in pii.find("ZZ89370400440532013000") if s.kind == "iban"]


def test_secrets():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'words token = "{key}" and password: hunter2hunter2X9 then'
    assert [text[s.start : s.end] for s in pii.find(text) if s.kind == "secret"] == [key, "hunter2hunter2X9"]
    assert [s.kind for s in pii.find("AKIA" + "IOSFODNN7EXAMPLE1"[:16])] == ["secret"]
    for clean in ("the token = is a word", "the secret: something", "password: aaaaaaaaaaaaaaaa1", "a key to the door: opened", "tokens = 1234567890123456"):
        assert not [s for s in pii.find(clean) if s.kind == "secret"], clean
    assert pii.masked(text, pii.find(text)) == 'words token = "<SECRET>" and password: <SECRET> then'


def test_tables(spark):
    docs = spark.createDataFrame([(1, "a@b.co é +1 555 010 9999", 5), (2, None, 5), (2, None, 5), (None, "", 1)], "doc_id long, text string, spans int")
    rows = {r.doc_id: r for r in pii.report(docs).collect()}
    assert rows[1].spans == "email:0:6,phone:9:24" and rows[1].n_email == rows[1].n_phone == 1
    assert rows[2].base_sha256 == hashlib.sha256(b"").hexdigest() and pii.report(docs).count() == 4
    assert pii.report(docs.limit(0)).count() == 0 and pii.cleaned(docs).where("doc_id = 1").first().text == "<EMAIL> é <PHONE>"
