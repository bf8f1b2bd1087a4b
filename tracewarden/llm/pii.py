"""PII: patterns propose spans, checksum validators confirm them, nearby words adjust the score.

Base kinds are always reported. Further kinds (bank account numbers of their country's length confirmed
by mod 97, social security numbers, and secrets confirmed by their form or by how many different
signs they have) are reported when their score reaches a threshold: validators set the
score of a proposal and context words close by raise it, words of other meanings lower it.

Spans are half-open, in code points; spans of different kinds may overlap. Nulls count as empty texts,
repeated rows are treated alike, empty tables give empty results and other columns are ignored, or kept
by ``cleaned``, whatever their names are. Work is linear in a text's length, also in texts that consist
of one run of pattern characters.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewarden.llm.bpe import texts_of
from tracewarden.llm.shared import retext, sliced

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
#: Reported from this score on; base kinds always are.
THRESHOLD = 0.6
#: How far context words reach, in characters.
REACH = 40
# fixed values: words that speak for a kind, and words that speak against all kinds
FOR = {
    "email": ("email", "e-mail", "mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "mobile", "call", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("key", "secret", "token", "password", "credentials", "auth", "bearer"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "example", "sku", "tracking")
# fixed values: the patterns of the base kinds
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
# fixed values: the lengths of bank account numbers by country
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
# fixed values: forms of secrets that tell themselves, and names that a secret is given to
SECRET_FORM = re.compile(
    r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,80}|sk-[A-Za-z0-9_-]{20,80}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]{8,2000}\.[A-Za-z0-9_-]{8,1000})(?![A-Za-z0-9_-])"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
)
SECRET_NAME = re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|secret[_ -]?key|auth[_ -]?token|private[_ -]?key)[\"']?[ \t]{0,4}(?:=>|:=|=|:)[ \t]{0,4}[\"']?([^\s\"',;<>]{8,200})")
#: What a text holds if it holds any of these.
FORM_HINTS, NAME_HINTS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "AIza", "eyJ", "PRIVATE KEY"), ("passw", "pwd", "secret", "token", "key")
#: Bits per sign that an assigned value has at least if it is a secret, and the length from which it counts as one without context.
ENTROPY, LONG_SECRET = 2.8, 16
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
CONTEXT = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
LENGTH_OF = {x[:2]: int(x[2:]) for x in IBAN_LENGTHS.split()}


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    text = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in text)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each sign is looked at once: a run of local characters can only match up to the sign after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL_CHARS:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            yield a, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(a, b, "email") for a, b in emails(text)]
    if text.count(".") > 2:
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() > 13 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return out


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length, whatever follows, with single spaces or none."""
    for m in IBAN.finditer(text):
        size = LENGTH_OF.get(m[0][:2], 0)
        at, n = m.end(), 4
        while n < size and at < len(text):
            at += text[at] == " " and at + 1 < len(text)
            if not ("A" <= text[at] <= "Z" or "0" <= text[at] <= "9"):
                break
            at, n = at + 1, n + 1
        if n == size and not (at < len(text) and text[at].isalnum()) and mod97(text[m.start() : at].replace(" ", "")):
            yield m.start(), at


def entropy(value: str) -> float:
    """Bits per sign, from the value's own frequencies."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def secrets(text: str) -> Iterator[tuple[int, int, float]]:
    if any(x in text for x in FORM_HINTS):
        for m in SECRET_FORM.finditer(text):
            yield *m.span(), 0.9
    low = text.lower()
    for m in SECRET_NAME.finditer(text) if any(x in low for x in NAME_HINTS) else ():
        value = m[1].rstrip(".")
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        if mixed and entropy(value) >= ENTROPY:
            yield m.start(1), m.start(1) + len(value), 0.7 if len(value) >= LONG_SECRET else 0.4


def more_spans(text: str) -> list[tuple[int, int, str, float]]:
    """Proposals of the further kinds with the score that their validators give."""
    out = [(a, b, "iban", 0.8) for a, b in ibans(text)]
    held: set[tuple[int, int]] = set()
    for a, b, score in secrets(text):
        if (a, b) not in held:
            held.add((a, b))
            out.append((a, b, "secret", score))
    if text.count("-") > 1:
        for m in SSN.finditer(text):
            area, group, serial = m[0].split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                out.append((*m.span(), "ssn", 0.4))
    return out


def adjusted(text: str, start: int, end: int, kind: str, score: float) -> float:
    near = {w.lower() for part in (text[max(0, start - REACH) : start], text[end : end + REACH]) for w in CONTEXT.findall(part)}
    score += 0.3 * any(w in near for w in FOR[kind]) - 0.3 * any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, score)), 2)


def find(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans by start, then kind. Base kinds are kept whatever their score is."""
    base = [(a, b, kind, 0.7 if kind in ("card", "email") else 0.6) for a, b, kind in base_spans(text)]
    found = [Span(a, b, kind, adjusted(text, a, b, kind, s)) for a, b, kind, s in [*base, *more_spans(text)]]
    return sorted((s for s in found if s.kind in BASE_KINDS or s.score >= threshold), key=lambda s: (s.start, KINDS.index(s.kind)))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named after the first."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, row, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in schema.split(", ")]
        for batch in batches:
            for part in sliced(batch):
                rows = [(i, *row(t)) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return texts_of(docs).mapInArrow(run, schema)


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, all spans, their scores, and n_spans, how many they are."""

    def row(text: str) -> tuple:
        spans = find(text, threshold)
        listed = [f"{s.kind}:{s.start}:{s.end}" for s in spans]
        base = ",".join(x for x, s in zip(listed, spans) if s.kind in BASE_KINDS)
        return *(sum(s.kind == k for s in spans) for k in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(listed), ",".join(f"{s.score:.2f}" for s in spans), len(spans)

    return _mapped(docs, row, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, n_spans long")


def cleaned(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all spans in the texts replaced by their kinds; all columns stay."""
    return retext(docs, lambda text: masked(text, find(text, threshold)))
