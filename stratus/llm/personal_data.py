"""Personal data by anchor expansion.

One Aho-Corasick automaton passes over a text and finds anchors: at-signs, scheme marks,
the places where digits meet (directly, over a dot, a blank or a hyphen, or after a plus)
and cue words of identifiers. From an anchor a parser of its kind goes out to the left
and to the right, as far as the kind's characters go, and validates what it has: domain
labels of an email, parts of an address up to 255, the Luhn sum of a card, the digits of a
phone, the remainder of an IBAN. Every parser goes over a place of the text at most once
(or stops at a fixed length), so the work is linear whatever the text.

Kinds. ``email``, ``ip``, ``card`` and ``phone`` are the base, the leftmost
non-overlapping matches of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)   parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                  14 to 19 digits, Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]             10 to 15 digits

where a match that fails its check is dropped and not tried again. Context adds three:

    url      scheme://user[:password]@host..., to the end of the URL
    account  after a cue (account, acct, iban, ssn, passport): an IBAN whose remainder is
             1, an SSN as ddd-dd-dddd, or 6 to 17 letters and digits, a digit among them
    secret   after a cue (token, secret, password, api_key): ``=`` or ``:`` and a value of
             at least 16 letters and digits, both among them

A cue stands alone (no letter or digit beside it) in lower case, capitalised or in upper
case. Spans of an added kind don't overlap each other; they may overlap spans of the base,
which always stay.

Defined cases: a null text is empty and has no spans; rows that repeat an id are searched
each; other columns pass unchanged, those of the appended names are replaced; an empty
table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratus.llm import tokens
from stratus.llm.common import unused

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
CUES = {
    "account": ("account", "account number", "account no", "acct", "iban", "ssn", "passport"),
    "secret": ("token", "secret", "password", "api_key", "api key"),
}
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
AUTHORITY = re.compile(r"[^\x00-\x20\x7f\"'<>/?#@]+@[A-Za-z0-9\[][^\x00-\x20\x7f\"'<>]*")
GAP = re.compile(r"[\x20]?(?:[:=#]|is|no\.?|number)?[\x20]?[\"']?")
ASSIGN = re.compile(r"[\x20]?[:=][\x20]?[\"']?")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
CODE = re.compile(r"(?=[A-Z]{0,3}[0-9])[A-Z0-9]{6,17}(?![A-Za-z0-9])")
VALUE = re.compile(r"(?=[A-Za-z_-]{0,64}[0-9])(?=[0-9_-]{0,64}[A-Za-z])[A-Za-z0-9_-]{16,128}(?![A-Za-z0-9_-])")
#: Longest scheme; what stands before a longer one is not read.
SCHEME_CHARS = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    body = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def anchors():
    """The automaton: each anchor's value is its kind and its length."""
    import ahocorasick

    made = ahocorasick.Automaton()
    made.add_word("@", ("email", 1))
    made.add_word("://", ("url", 3))
    for a in DIGITS:
        made.add_word(f"+{a}", ("phone", 2))
        for b in DIGITS:
            made.add_word(f"{a}.{b}", ("ip", 3))
            for gap in ("", " ", "-"):
                made.add_word(f"{a}{gap}{b}", ("card", 2 + len(gap)))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in (cue, cue.capitalize(), cue.upper()):
                made.add_word(form, (kind, len(form)))
    made.make_automaton()
    return made


class Finder:
    """Spans of texts, each a list of (start, kind's number, end)."""

    def __init__(self):
        self.automaton = anchors()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        done = dict.fromkeys(KINDS, 0)  # a kind's parser has read up to here
        parse = {"email": self._email, "ip": self._ip, "card": self._card, "phone": self._phone, "url": self._url, "account": self._account, "secret": self._secret}
        for last, (kind, size) in self.automaton.iter(text):
            at = last + 1 - size
            if at >= done[kind]:
                done[kind] = parse[kind](text, at, at + size, done[kind], found)
        found.sort()
        return found

    # Each parser gets the anchor's bounds and where it last stopped; it returns where it stops.

    def _email(self, text: str, at: int, end: int, done: int, found: list) -> int:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, end) if start < at else None
        if domain is None:
            return end  # its local part belongs to no later at-sign
        found.append((start, 0, domain.end()))
        return domain.end()

    def _ip(self, text: str, at: int, end: int, done: int, found: list) -> int:
        start = at
        while start > done and text[start - 1] in DIGITS:
            start -= 1
        chain = DOTTED.match(text, start)
        parts = chain.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            stop = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((start, 1, stop))
            start = stop + 1
        return chain.end()

    def _card(self, text: str, at: int, end: int, done: int, found: list) -> int:
        # the first anchor of a chain is at its start
        chain = SPACED.match(text, at)
        if chain.end() - at < 38:
            digits = chain.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((at, 2, chain.end()))
        return chain.end()

    def _phone(self, text: str, at: int, end: int, done: int, found: list) -> int:
        match = PHONE.match(text, at)
        if match is None:
            return end
        if 10 <= sum(c in DIGITS for c in match.group()) <= 15:
            found.append((at, 3, match.end()))
        return match.end()

    def _url(self, text: str, at: int, end: int, done: int, found: list) -> int:
        start = at
        while start > max(done, at - SCHEME_CHARS) and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "+.-"):
            start -= 1
        while start < at and not text[start].isalpha():
            start += 1
        rest = AUTHORITY.match(text, end) if SCHEME.match(text[start:at]) else None
        if rest is None:
            return end
        stop = rest.end()
        while text[stop - 1] in ".,;:!?)]}":
            stop -= 1
        found.append((start, 4, stop))
        return rest.end()

    def _alone(self, text: str, at: int, end: int) -> bool:
        return not (at and text[at - 1].isalnum()) and not (end < len(text) and text[end].isalnum())

    def _account(self, text: str, at: int, end: int, done: int, found: list) -> int:
        if not self._alone(text, at, end):
            return done
        begin = GAP.match(text, end).end()
        number = IBAN.match(text, begin)
        if number is not None and not iban(number.group()):
            number = None
        number = number or SSN.match(text, begin) or CODE.match(text, begin)
        if number is None:
            return done
        found.append((begin, 5, number.end()))
        return number.end()

    def _secret(self, text: str, at: int, end: int, done: int, found: list) -> int:
        sign = ASSIGN.match(text, end) if self._alone(text, at, end) else None
        value = VALUE.match(text, sign.end()) if sign else None
        if value is None:
            return done
        found.append((sign.end(), 6, value.end()))
        return value.end()


_finders: list[Finder] = []


def finder() -> Finder:
    """The worker's own finder."""
    if not _finders:
        _finders.append(Finder())
    return _finders[0]


def find_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, out: str = "spans") -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, by default all) with ``out`` appended, an array
    of (start, kind, end) by start, then kind in the order of KINDS."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    n = len(kept)
    x = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`"))
    x = x.toDF(*[f"c{i}" for i in range(n + 1)])  # the result has the names; here they are numbers
    row = "array<struct<start: int, kind: int, end: int>>"
    of = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder().spans
        for b in batches:
            for lo, hi in tokens.slices(b.column(n)):
                part = b.slice(lo, hi - lo)
                spans = [[{"start": s, "kind": k, "end": e} for s, k, e in find(t or "")] for t in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(spans, of)], names=[*part.schema.names[:n], "spans"])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in x.schema.fields[:n])
    found = x.mapInArrow(run, f"{fields}spans {row}")
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end")))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], spans.alias(out))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span of the text replaced by its kind in angle
    brackets; of spans that overlap the first stays, and of those with one start the
    longest."""
    held = unused("spans", docs)
    x = find_spans(docs, text_col, out=held)
    first = F.array_sort(F.transform(held, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        before = F.substring(F.col(f"`{text_col}`"), done["at"] + 1, s["start"] - done["at"])
        taken = F.struct((-s["end"]).alias("at"), F.concat(done["parts"], F.array(before, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("parts"))
        return F.when(s["start"] >= done["at"], taken).otherwise(done)

    def finish(done: Column) -> Column:
        return F.concat(F.array_join(done["parts"], ""), F.substring(F.col(f"`{text_col}`"), done["at"] + 1, F.lit(2**31 - 1)))

    clean = F.when(F.size(held) > 0, F.aggregate(first, start, step, finish)).otherwise(F.col(f"`{text_col}`"))
    return x.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    x = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return x.select("doc_id", *counts, F.sha2(_joined(of(*BASE_KINDS)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
