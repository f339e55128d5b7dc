import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from farebox.llm import pii


def brute(text):
    """The base kinds by their patterns."""
    found = []
    for k, kind in enumerate(pii.BASE):
        for m in re.finditer(pii.PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


def base(text):
    return [s for s in pii.find_spans(text) if s[1] < 4]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a9.@+-_% ()1é\n/:", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert base(text) == brute(text)


@pytest.mark.parametrize(
    "text",
    ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "1.2.3.400 1.2.3.004", "4111 1111 1111 1111", "+49 (30) 123-4567 8", "x@y", "a@b..c", "@@a@b.cc", "0001.2.3.4", "00000255.1.1.1", "+1+2 345 678 9012"],
)
def test_base_cases(text):
    assert base(text) == brute(text)


def test_added_spans_and_redaction():
    text = 'see https://a.example.com/x?y=1. token = "f33e61083db5" IBAN DE89370400440532013000 by @someone'
    kinds = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find_spans(text) if k > 3]
    assert kinds == [("url", "https://a.example.com/x?y=1"), ("account", "f33e61083db5"), ("account", "DE89370400440532013000"), ("account", "@someone")]
    assert pii.redact_text("mail a.b@c.de now") == "mail [EMAIL] now"
    assert pii.redact_text(None) is None and pii.redact_text("") == ""


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1" * 100_000, "http://" * 50_000):
        pii.find_spans(text)


def test_frame(spark):
    rows = [(1, "x a@b.cc 10.0.0.1", "keep"), (None, None, "keep"), (3, "", "keep"), (3, "", "keep")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {tuple(r) for r in pii.find_pii(df).selectExpr("doc_id", "size(spans)").collect()}
    assert got == {(1, 2), (None, 0), (3, 0)}
    assert pii.redact(df.limit(0)).count() == 0


def test_overlapping_spans_leave_no_tail():
    assert pii.redact_text("ftp://first.last@host.com") == "[URL]"
    assert pii.redact_text("see ftp://first.last@host.com, or http://a.com/x4111 1111 1111 1111 now") == "see [URL], or [URL] now"


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("see @" + "a" * 40 + " there", "account", "@" + "a" * 40),
        ("at http://a.bb:123456/secret now", "url", "http://a.bb:123456/secret"),
        ("token" + " " * 9 + "=" + " " * 7 + "abc12345", "account", "abc12345"),
        ("IBAN DE89 3704 0044 0532 0130 00 is it", "account", "DE89 3704 0044 0532 0130 00"),
        ("iban: GB82WEST12345698765432.", "account", "GB82WEST12345698765432"),
        ("password: h$nter!2x", "account", "h$nter!2x"),
    ],
)
def test_spans_are_whole(text, kind, value):
    assert (kind, value) in {(pii.KINDS[k], text[a:b]) for a, k, b in pii.find_spans(text)}


def test_no_value_without_digits():
    assert not pii.find_spans("the password is required, tokens are spent, account: closed by them")
