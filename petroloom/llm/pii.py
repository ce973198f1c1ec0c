"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs and digits, schemes
of personal addresses, and cues that name an identifier. A local parser for each kind of anchor reads on
from there to both sides as far as its characters go, and validates what lies between the boundaries:

- `email`: a name to the left of an at-sign and a domain of two parts or more to its right.
- `ip`: four numbers joined by dots, each 255 at most.
- `card`: digits, one space or hyphen between two of them, 12 to 19 in all, with a right check digit (Luhn).
- `phone`: from a plus sign over digits, blanks, dots, brackets and hyphens; 9 to 15 digits.
- `address`: a scheme (mailto, tel, sip ...) with the name or number after it, or the authority of a locator
  that holds a user's name. A scheme must not be the end of a longer word.
- `account`: the identifier after a cue (IBAN, account number, social security number ...), with at most a
  word such as "number" and a sign between them. An IBAN must have a right checksum, a social security number
  an area, group and serial that are given out, any other 6 to 20 characters, half of them digits at least.

Matches of one kind do not overlap; the first to begin is taken and what fails validation is dropped
whole. `address` and `account` may overlap the others, which stay as they are. Offsets are code points, ends exclusive.

Each anchor is expanded over characters that no anchor of its kind before it has taken, so the work grows with
a text's length, also for texts of digits or at-signs alone. Texts are read whole.

Nulls: a null text is empty and has no spans; a null id keeps its row. Equal texts have equal spans,
repeated rows each have a row. An empty table gives no rows. Columns other than doc_id and text play no part in
find(), and redact() keeps them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from petroloom.llm import shared

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")

# The characters of each kind.
NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FOUR = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
NUMBER = re.compile(r"[0-9]+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
CALL = re.compile(r"\+[0-9][ ().0-9-]+")
SCHEMES = ("mailto:", "tel:", "sms:", "callto:", "sip:", "sips:", "xmpp:", "skype:", "facetime:")
DIALLED = ("tel:", "sms:", "callto:", "facetime:")
CUES = ("iban", "ssn", "social security", "passport", "account", "acct", "tax id", "national id", "customer id", "user id", "member id", "patient id", "routing")

_DIALLED_NUMBER = re.compile(r"\+?[0-9](?:[ ().-]?[0-9])+")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+(?:@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)?")
_AUTHORITY = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
_BETWEEN = re.compile(r"(?:[ \t]*(?i:number|num|no|nr|code|id)\b\.?)?[ \t]*[:=#]?[ \t]*")
_IDENTIFIER = re.compile(r"[A-Za-z0-9]+(?:[ -][A-Z0-9]*[0-9][A-Z0-9]*)*")
_SSN = re.compile(r"([0-9]{3})[- ]?([0-9]{2})[- ]?([0-9]{4})(?![0-9A-Za-z])")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, ("digit" if c.isdigit() else c, c))
    a.add_word("://", ("://", "://"))
    for what, names in (("scheme", SCHEMES), ("cue", CUES)):
        for x in names:
            for form in {x, x.upper(), x.capitalize()}:
                a.add_word(form, (what, form))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    """The checksum: letters as numbers from 10, the first four characters last, 1 modulo 97."""
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Parsers:
    """The local parsers over one text, called with anchors from left to right."""

    def __init__(self, text: str) -> None:
        self.text, self.spans = text, []
        self.ends = dict.fromkeys(("email", "ip", "card", "phone", "address", "account"), 0)  # no anchor of the kind counts before
        self.expand = {"@": self.email, "+": self.phone, "digit": self.digit, "scheme": self.scheme, "://": self.locator, "cue": self.cue}

    def take(self, kind: str, start: int, end: int, good: bool) -> None:
        self.ends[kind] = end
        if good:
            self.spans.append((start, KINDS.index(kind), end))

    def email(self, at: int, _: str) -> None:
        text, start, first = self.text, at, self.ends["email"]
        while start > first and text[start - 1] in NAME:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            self.take("email", start, domain.end(), True)

    def phone(self, at: int, _: str) -> None:
        if m := CALL.match(self.text, at):
            end = m.end()
            while not self.text[end - 1].isdigit():
                end -= 1
            if end - at >= 4:  # plus, a digit, one character at least, a digit
                digits = sum(c.isdigit() for c in self.text[at:end])
                self.take("phone", at, end, 9 <= digits <= 15)

    def digit(self, at: int, _: str) -> None:
        if at >= self.ends["card"]:
            if m := DIGITS.match(self.text, at):
                digits = m[0].replace(" ", "").replace("-", "")
                self.take("card", at, m.end(), 12 <= len(digits) <= 19 and luhn(digits))
            else:
                self.ends["card"] = at + 1
        if at >= self.ends["ip"]:
            if m := FOUR.match(self.text, at):
                self.take("ip", at, m.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")))
            else:  # what begins later in this number fails as well
                self.ends["ip"] = NUMBER.match(self.text, at).end()

    def _free(self, kind: str, at: int) -> bool:
        return at >= self.ends[kind] and not (at and _word(self.text[at - 1]))

    def scheme(self, at: int, form: str) -> None:
        if not self._free("address", at):
            return
        begin, name = at + len(form), form.lower()
        if name in DIALLED and (m := _DIALLED_NUMBER.match(self.text, begin)):
            self.take("address", at, m.end(), 7 <= sum(c.isdigit() for c in m[0]) <= 15)
        elif name not in ("tel:", "sms:") and (m := _ADDRESS.match(self.text, begin)):
            found = m[0].rstrip(".-%+")
            self.take("address", at, begin + len(found), len(found) >= 3 and any(c.isalpha() for c in found) and ("@" in found or name == "skype:"))

    def locator(self, at: int, _: str) -> None:
        start, first = at, max(self.ends["address"], at - 16)
        while start > first and self.text[start - 1].isascii() and (self.text[start - 1].isalnum() or self.text[start - 1] in "+.-"):
            start -= 1
        if start < at and self.text[start].isalpha() and (m := _AUTHORITY.match(self.text, at + 3)):
            self.take("address", start, at + 3 + len(m[0].rstrip(".-")), True)

    def cue(self, at: int, form: str) -> None:
        begin = at + len(form)
        if not self._free("account", at) or (begin < len(self.text) and _word(self.text[begin])):
            return
        begin, name = _BETWEEN.match(self.text, begin).end(), form.lower()
        if name == "iban":
            if m := _IBAN.match(self.text, begin):
                # the longest beginning, by whole groups, that has a right checksum
                ends = [begin + x.start() for x in re.finditer(r"(?<=[A-Za-z0-9])(?![A-Za-z0-9])", m[0])]
                good = [e for e in ends if iban(self.text[begin:e])]
                self.take("account", begin, max(good, default=m.end()), bool(good))
        elif name in ("ssn", "social security"):
            if m := _SSN.match(self.text, begin):
                self.take("account", begin, m.end(), m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000")
        elif m := _IDENTIFIER.match(self.text, begin):
            plain = m[0].replace(" ", "").replace("-", "")
            digits = sum(c.isdigit() for c in plain)
            self.take("account", begin, m.end(), 6 <= len(plain) <= 20 and 2 * digits >= len(plain))


def spans(text: str | None, automaton) -> list[Span]:
    """All spans of a text, by start and then by kind."""
    if not text:
        return []
    parsers = Parsers(text)
    for last, (what, form) in automaton.iter(text):
        parsers.expand[what](last - len(form) + 1, form)
    return sorted(parsers.spans)


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id and spans, an array of (s, kind, e) by start and then by kind."""
    made = pa.list_(pa.struct([("s", pa.int64()), ("kind", pa.string()), ("e", pa.int64())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in rows:
            held = [[{"s": s, "kind": KINDS[k], "e": e} for s, k, e in spans(t.as_py(), automaton)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, made)], names=["doc_id", "spans"])

    shared.bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(shared.lean(run), f"doc_id {kind}, spans array<struct<s:bigint,kind:string,e:bigint>>")


def redact(docs: DataFrame) -> DataFrame:
    """docs with `<kind>` in place of each span of `text`; of spans that overlap, the name of the first for all."""
    at = docs.columns.index("text")

    def hidden(text: str | None, automaton) -> str | None:
        out, done = [], 0
        for s, k, e in spans(text, automaton):
            if s >= done:
                out += [text[done:s], f"<{KINDS[k]}>"]
            done = max(done, e)
        return text if not out else "".join([*out, text[done:]])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in rows:
            texts = pa.array([hidden(t.as_py(), automaton) for t in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    shared.bound_batches(docs.sparkSession)
    return docs.mapInArrow(shared.lean(run), docs.schema)


def _listed(kinds: tuple[str, ...]) -> Column:
    of = F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and a digest of the base kinds, and the list of all spans."""
    docs = shared.table(spark, sf_dir, "documents")
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(BASE), 256).alias("base_sha256"), _listed(KINDS).alias("spans"), *[count(k) for k in KINDS[len(BASE) :]])
