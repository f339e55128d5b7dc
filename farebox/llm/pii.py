"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors in one pass over the text: at-signs, plus signs, URL schemes and
identifier cues. A local parser then expands each anchor to its left and right and validates what it has found.
Runs of digits anchor network addresses and card numbers. Every parser looks at a run of characters once, so
the work is linear in the text, however long its runs are.

Kinds, in the order in which spans with one start are listed:
- email, ip, card, phone: exactly the leftmost non-overlapping matches of the patterns in PATTERNS that pass the
  kind's check.
- url: a scheme of SCHEMES, ``://``, a host with a dot or ``localhost``, port and path.
- account: the value behind an identifier cue (``token = "..."``, ``account no. 1234567``, ``IBAN DE..`` in one or in groups), and
  ``@name`` handles. A value has six characters and two digits, after a sign such as ``=`` one digit and any other characters.

Edge cases: a null text has no span; spans count code points, the end is exclusive; repeated rows give repeated
results; an empty table gives an empty one; a column of the input that has the name of the output column is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm.common import table

#: The base patterns. The parsers below give the same matches without backtracking.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http", "https", "ftp", "ftps", "ssh", "ws", "wss")
#: Identifier cues; each is looked for in lower, upper and title case.
CUES = ("token", "api_key", "apikey", "secret", "password", "passwd", "account", "acct", "iban", "ssn", "passport")

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPANS_DDL = "array<struct<kind:string,start:int,end:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|localhost)(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
_LINK = re.compile(r"(?:s|[ _-]?(?:number|no\.?|id))?[ \t]*([:=#])?[ \t]*[\"']?")
_VALUE = re.compile(r"[A-Za-z0-9_-]{6,}")
#: After a sign between cue and value, such as ``=``, any characters but white space, quotes and separators may be a value.
_MARKED = re.compile(r"[^\s\"'<>,;]{6,}")
_GROUPED = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9])*")
_HANDLE = re.compile(r"[A-Za-z0-9_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _iban_end(text: str, at: int) -> int | None:
    """Where the account number that starts at `at` ends, written in one or in groups; the longest that is valid."""
    m = _GROUPED.match(text, at)
    if not m:
        return None
    end = best = None
    size = 0
    for end in range(at, m.end()):
        size += text[end] != " "
        if size > 34:
            break
        if size >= 14 and text[end] != " " and not text[end + 1 : end + 2].isalnum() and iban(text[at : end + 1].replace(" ", "")):
            best = end + 1
    return best


def _value_end(text: str, at: int, marked: bool) -> int | None:
    """Where the value behind a cue ends: with two digits, or after a sign with one."""
    m = _VALUE.match(text, at)
    if m and sum(c.isdigit() for c in m[0]) >= 2 and not marked:
        return m.end()
    m = _MARKED.match(text, at) if marked else None
    if not m:
        return None
    value = m[0].rstrip(".!?)]}:")
    return at + len(value) if len(value) >= 6 and any(c.isdigit() for c in value) else None


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.title()}:
            found.add_word(form, ("iban" if cue == "iban" else "cue", len(form)))
    found.make_automaton()
    return found


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _numbers(text: str, found: list) -> None:
    """ip and card, from the runs of digits."""
    chain: list[tuple[int, int]] = []

    def close() -> None:
        for i in range(0, len(chain) - 3, 4):
            if all(_octet(text[a:b]) for a, b in chain[i : i + 4]):
                found.append((chain[i][0], 1, chain[i + 3][1]))

    for m in _DIGITS.finditer(text):
        a, b = m.span()
        if chain and not (a == chain[-1][1] + 1 and text[a - 1] == "."):
            close()
            chain = []
        chain.append((a, b))
    close()
    for m in _CARD.finditer(text):
        a, b = m.span()
        if b - a >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((a, 2, b))


def _left_word(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of every span, in order."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    mail_end = plus_end = url_end = account_end = 0
    seen = -1
    for last, (what, n) in automaton().iter(text):
        at, after = last - n + 1, last + 1
        if what == "at":
            m = _DOMAIN.match(text, after)
            start = _left_word(text, at, max(mail_end, seen + 1)) if m else at
            seen = at
            if m and start < at:
                found.append((start, 0, m.end()))
                mail_end = m.end()
            elif at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "@_.-/"):
                h = _HANDLE.match(text, after)
                if h and h[0][0].isalpha() and not text[h.end() : h.end() + 1] == "@":
                    found.append((at, 5, h.end()))
        elif what == "plus":
            if at >= plus_end and (m := _PHONE.match(text, at)):
                plus_end = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((at, 3, m.end()))
        elif what == "scheme":
            start = at
            while start > url_end and at - start < 6 and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if at >= url_end and text[start:at].lower() in SCHEMES and (m := _URL.match(text, after)):
                end = start + len(text[start : m.end()].rstrip(".,;:!?)]}&"))
                found.append((start, 4, end))
                url_end = end
        elif at >= account_end and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")):
            link = _LINK.match(text, after)
            if link.end() > after:
                end = _iban_end(text, link.end()) if what == "iban" else _value_end(text, link.end(), bool(link[1]))
                if end:
                    found.append((link.end(), 5, end))
                    account_end = end
    _numbers(text, found)
    found.sort()
    return found


def _spans(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t.as_py())] for t in texts], SPANS)


def redact_text(text: str | None) -> str | None:
    """The text with ``[KIND]`` in place of each span; overlapping spans are replaced as one, by the kind of the first, or at one start the longest."""
    if text is None:
        return None
    out, at = [], 0
    for a, k, b in sorted(find_spans(text), key=lambda s: (s[0], -s[2], s[1])):
        if a >= at:
            out += (text[at:a], f"[{KINDS[k].upper()}]")
        at = max(at, b)
    return "".join((*out, text[at:])) if at else text


def _redacted(texts: pa.Array) -> pa.Array:
    return pa.array([redact_text(t.as_py()) for t in texts], pa.string())


def find_pii(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """df with the spans of each text as an array of (kind, start, end), ordered by start, then kind."""
    return df.withColumn(out, F.arrow_udf(_spans, SPANS_DDL)(F.col(text)))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span of the text replaced by its kind in brackets. Null texts stay null; no row goes."""
    return df.withColumn(text, F.arrow_udf(_redacted, "string")(F.col(text)))


def _digest(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")


def op4_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select(
        "doc_id",
        *(_count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_digest(base).cast("binary"), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"),
    )
