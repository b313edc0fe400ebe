"""Personal data against the patterns themselves, and its own kinds."""

import hashlib
import random
import re

from llm_data import documents, frame

from pyspark.sql import functions as F
from stratus.llm import personal_data as pd_


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base(text):
    """The contract's patterns by a regular-expression engine."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group()))


AWKWARD = [
    "", "@", "a@b", "a@b.c", "a@b.c@d.e", "a@b@c.d", "a@b..c", ".@-.-", "x a@b.c.d. e_f@g.h,i@j.k.", "é@b.c aé@b.c", "a@b.c_d@e.f", "a@b.cd@e.f",
    "1.2.3.4", "1.2.3.4.5", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.0255 1.2.3", "9.1.2.3.4", "01.1.1.1..2.2.2.2", "0000000000255.1.1.1", "1" * 4000 + ".1.1.1",
    "4111111111111111", "4111 1111 1111 1111", "4111-1111 1111-1111", "4111  1111 1111 1111", "-4111 1111 1111 1111-", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "12 4111111111111111", "5" * 40, "0" * 19, "0" * 20,
    "+1 (017) 555-7713", "+12", "+123456789 0", "++1 2345678901", "+1..........2", "+1 234 567 890 123 456", "+1 (017) 555-7713)) +44 20 7946 0958.", "+1 2345678901+1 2345678901", "+", "+é1",
]


def test_base_kinds_equal_their_patterns():
    find, draw = pd_.Finder().spans, random.Random(5)
    alphabet = ["a", "b@", "@", ".", "1", "2", "25", "411111", " ", "-", "+", "(", ")", "é", "1.", ".1", "x.y", "4111111111111111", "token", "://", "_", "\n"]
    texts = AWKWARD + ["".join(draw.choices(alphabet, k=draw.randint(1, 60))) for _ in range(20000)]
    texts += ["".join(draw.choices("0123456789 -.+()", k=200)) for _ in range(2000)] + [t or "" for _, t, *_ in documents()]
    for t in texts:
        assert [s for s in find(t) if s[1] < 4] == base(t), t


def test_added_kinds():
    def kinds(text):
        return [(pd_.KINDS[k], text[s:e]) for s, k, e in pd_.Finder().spans(text) if k > 3]

    assert kinds("see https://bob:pw1@example.org/a?b=1, and http://example.org/") == [("url", "https://bob:pw1@example.org/a?b=1")]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00.") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert kinds("iban DE88370400440532013000, Account number: 0012345678 and SSN 123-45-6789") == [("account", "0012345678"), ("account", "123-45-6789")]
    assert kinds("passport no. X1234567; accounting 12345678; account closed; ssn 000-12-3456") == [("account", "X1234567")]
    assert kinds('token = "b44e15e09fd311c3" TOKEN = "9233A8ECF7C5B09FE5949719" secret: aaaaaaaaaaaaaaaaaaaa tokens = b44e15e09fd311c3') == [("secret", "b44e15e09fd311c3"), ("secret", "9233A8ECF7C5B09FE5949719")]


def test_long_texts_take_linear_time():
    import time

    find = pd_.Finder().spans
    for unit in ("@", "a@", "1", "1.", "1 ", "+1", "://", "a://b", "token=", "account ", "a.b-c"):
        t0 = time.process_time()
        find(unit * 200_000)
        assert time.process_time() - t0 < 5, unit


def test_frames(spark):
    rows = documents() + [(200 + i, t, "en", "a") for i, t in enumerate(AWKWARD)]
    out = pd_.find_spans(frame(spark, rows).withColumnRenamed("fp", "spans").withColumnRenamed("bin", "kind"))
    assert out.columns.count("spans") == 1 and "kind" in out.columns
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", [tuple(s) for s in r.spans if s.kind in pd_.BASE_KINDS]) for r in out.collect())
    assert got == sorted((d is not None, d or 0, t or "", [(s, pd_.KINDS[k], e) for s, k, e in base(t or "")]) for d, t, *_ in rows)
    assert pd_.find_spans(frame(spark, rows).limit(0)).count() == 0


def test_redaction(spark):
    text = "mail é a.b@c.de or +1 (017) 555-7713, https://u:p@h.org/x 1.2.3.4!"
    docs = spark.createDataFrame([(1, text, "keep"), (2, None, "keep"), (3, "clean", "keep")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pd_.redact(docs).collect()}
    assert got[1].text == "mail é <EMAIL> or <PHONE>, <URL> <IP>!" and got[2].text is None and got[3].text == "clean"
    assert all(r.spans == "keep" for r in got.values())


def test_query(spark, tmp_path):
    rows = documents() + [(200 + i, t, "en", "a") for i, t in enumerate(AWKWARD)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = pd_.query(spark, str(tmp_path))
    assert [t for c, t in got.dtypes if c[:2] == "n_"] == ["bigint"] * 4
    want = []
    for d, t, *_ in rows:
        found = base(t or "")
        joined = ",".join(f"{pd_.KINDS[k]}:{s}:{e}" for s, k, e in found)
        want.append((str(d), *[sum(k == i for _, k, _ in found) for i in range(4)], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:6]) for r in got.collect()) == sorted(want)
    assert got.filter(F.col("n_ip") > 0).select("spans").first()[0].count("ip:") > 0
