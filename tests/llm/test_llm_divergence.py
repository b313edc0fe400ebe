"""The audit against its SQL and a plain count, the perfect hash alone, rounds and blocks."""

import random
from collections import Counter

import duckdb
import numpy as np
from llm_data import frame

from pyspark.sql import functions as F
from stratus.llm import divergence as dv


def test_perfect_hash():
    draw = random.Random(3)
    for n in (1, 2, 3, 50, 5000):
        keys = list({bytes(draw.choices(b"abc\xc3\xa9", k=draw.randint(1, 12))) + str(i).encode() for i in range(n)})
        table = dv.PerfectHash.unpack(dv.PerfectHash.of(keys).pack())
        assert sorted(table.find(keys)) == list(range(len(keys)))
        assert table.find([k + b"!" for k in keys]) == [-1] * len(keys)  # the stored key decides
        assert all(table.keys[s] == k for s, k in zip(table.find(keys), keys))
        assert sum(len(x) for x in table.levels) < 8 * n + 8


def test_shares_are_exact():
    draw = random.Random(4)
    for _ in range(300):
        v, counts = draw.randint(1, 10**6), [draw.randint(0, 10 ** draw.randint(1, 14)) for _ in range(5)]
        n = sum(counts)
        assert dv.shares(np.array(counts), n, v).tolist() == [1 + (10**9 * (c + 5)) // (n + 5 * v) for c in counts]


def rows(seed=2):
    draw = random.Random(seed)
    out = [(i, " ".join(draw.choices(["Wort", "häß", "the", "THE", "it's", "x1y", "日本", "\x85z", "a", "b", "c"], k=draw.randint(0, 30))), draw.choice(["en", "de", None]), draw.choice(["a", "b", "Z", "é", None, ""])) for i in range(150)]
    out += [(3, "the a b", "en", "a")] * 5 + [(None, None, None, None), (500, "", "xx", "only"), (501, "12 !", "xx", "other"), (502, "rare", "yy", "one")]
    return out + [(600, "the " * 30000 + "b", "en", "hot")]


def plain(data, min_docs, top):
    letters = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c > "\x7f" or "a" <= c <= "z" else " " for c in t or "")
    count, df, groups = {}, {}, {}
    for _, t, lang, source in data:
        lang, source = lang or "", source or ""
        w = [x for x in letters(t).split(" ") if x]
        groups.setdefault(lang, set()).add(source)
        count.setdefault((lang, source), Counter()).update(w)
        df.setdefault(lang, Counter()).update(set(w))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, f, r) for r, (x, f) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


def test_audit_equals_a_plain_count(spark, monkeypatch):
    docs = frame(spark, rows()).withColumn("term", F.lit("clash")).withColumn("shard", F.lit(1))
    for min_docs, top, shard, block, held in ((30, 50, 1024, 64, 10**6), (2, 2, 2, 2, 3)):
        monkeypatch.setattr(dv, "SHARD", shard)
        monkeypatch.setattr(dv, "BLOCK", block)
        monkeypatch.setattr(dv, "HELD_SLOTS", held)
        got = dv.audit(docs, min_docs=min_docs, top=top, round_bytes=dv.ROUND_BYTES if held > 3 else 600)
        assert sorted(map(tuple, got.collect())) == plain(rows(), min_docs, top)
    assert dv.audit(docs.limit(0)).count() == 0


def test_query_equals_sql(spark, tmp_path):
    frame(spark, rows()).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = dv.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(dv.SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) == plain(rows(), 30, 50)
