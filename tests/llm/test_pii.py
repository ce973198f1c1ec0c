"""Personal data against regular expressions and by cases."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from petroloom.llm import pii, shared


def luhn(d):
    s = 0
    for k, c in enumerate(d[::-1]):
        x = int(c) * (1 + k % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def plain(t):
    """(start, kind, end) of the base kinds."""
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        out += [(m.start(), 2, m.end())] * (12 <= len(d) <= 19 and luhn(d))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def automaton():
    return pii._automaton()


def base(t, automaton):
    return [x for x in pii.spans(t, automaton) if x[1] < 4]


def test_base_kinds_on_random_strings(automaton):
    rng = random.Random(5)
    pieces = ["a", "z9", ".", "@", "1", "2", "0", "255", "256", "+", " ", "-", "(", ")", "%", "é", "٣", "\n", "4539578763621486", "tel:", "://", "IBAN "]
    for _ in range(20_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40)))
        assert base(t, automaton) == plain(t), t


@pytest.mark.parametrize("t", ["1", "@", "1.1.", "+1", "a@", "1 ", "x", "account 1 ", "http://", "+1 ("])
def test_long_texts_cost_what_they_hold(automaton, t):
    start = time.process_time()
    assert base(t * 100_000, automaton) is not None and time.process_time() - start < 20
    short = t * 300 + "@b.c"
    assert base(short, automaton) == plain(short)


@pytest.mark.parametrize("t, want", [
    ("write mailto:joe@x.org.", [("address", "mailto:joe@x.org"), ("email", "joe@x.org")]),
    ("hotel:5551234567 sip:me", []),
    ("tel:555-123-4567 now", [("address", "tel:555-123-4567")]),
    ("skype:john.doe", [("address", "skype:john.doe")]),
    ("sftp://bob:pw@host.example.com/x", [("address", "sftp://bob:pw@host.example.com"), ("email", "pw@host.example.com")]),
    ("see https://host.example.com/a@b", []),
    ("IBAN: DE89 3704 0044 0532 0130 00 is mine", [("account", "DE89 3704 0044 0532 0130 00")]),
    ("iban DE88370400440532013000", []),
    ("SSN 123-45-6789", [("account", "123-45-6789")]),
    ("ssn 666-45-6789, ssn 123-00-6789", []),
    ("Account number: AB-1234567", [("account", "AB-1234567")]),
    ("accountable 12345678, account of 2 people, account abcdefgh", []),
    ("Passport no. X1234567", [("account", "X1234567")]),
])
def test_added_kinds(automaton, t, want):
    assert sorted((pii.KINDS[k], t[s:e]) for s, k, e in pii.spans(t, automaton)) == sorted(want)


def test_odd_rows(spark):
    rows = [(1, None, 7), (None, "a@b.c", 8), (2, "", None), (3, "a@b.c", 1), (3, "a@b.c", 1), (4, "\U0001f600 a@b.c", 2), (5, "x" * 2_000_000 + " 10.0.0.1", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = [(r["doc_id"], [(x["s"], x["kind"], x["e"]) for x in r["spans"]]) for r in pii.find(df).collect()]
    mail = [(0, "email", 5)]
    assert sorted(got, key=str) == sorted([(1, []), (None, mail), (2, []), (3, mail), (3, mail), (4, [(2, "email", 7)]), (5, [(2_000_001, "ip", 2_000_009)])], key=str)
    assert pii.find(df.limit(0)).count() == 0
    hidden = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert hidden[3]["text"] == "<email>" and hidden[1]["text"] is None and hidden[4]["text"] == "\U0001f600 <email>" and hidden[5]["spans"] == 3
    assert pii.redact(df).columns == df.columns


def test_query_against_plain_code(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in shared.table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = pii.op12_personal_data(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r["doc_id"]])
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[1] == i for x in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in pii.BASE) == listed
    schema = dict(pii.op12_personal_data(spark, sf).dtypes)
    assert schema["n_email"] == "bigint" and schema["spans"] == "string"
