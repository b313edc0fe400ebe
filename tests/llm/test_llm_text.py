"""Line dedup, substring dedup, SimHash and quality rules against brute force."""

import brute
import numpy as np
import pytest
from llm_data import documents, frame

from pyspark.sql import functions as F
from stratus.llm import line_dedup, rules, simhash, substring_dedup
from stratus.llm.components import components

order = lambda rows: sorted(rows, key=str)


def test_line_dedup(spark):
    out = line_dedup.dedup_lines(frame(spark))
    assert out.columns[:2] == ["doc_id", "text"] and "key" in out.columns
    got = [(r.doc_id, r.n_lines, r.n_dropped, brute.sha(r.text.encode())) for r in out.collect()]
    want = brute.line_dedup([(d, t) for d, t, _, _ in documents()])
    assert order(got) == order(want) and sum(x[2] for x in want) > 0
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_clashing_names_pass_unchanged(spark):
    from stratus.llm import mixing

    names = ["drops", "drop_id", "kept", "__drops", "__drop_id", "__kept", "__p_epochs", "__size", "__key", "__tie", "__source", "bucket", "cut", "c0", "s"]
    docs = frame(spark)
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    for out in (line_dedup.dedup_lines(docs), mixing.mix(docs, prefix="mix_"), simhash.one_of_each(docs)):
        for n in names:
            assert [r[0] for r in out.select(n).distinct().collect()] == [f"own {n}"]


def test_line_dedup_of_a_text_with_many_frequent_lines(spark):
    """20,000 dropped lines of one text are found by bucket, kept ones stay in order."""
    frequent = [f"frequent line number {i} of at least forty code points" for i in range(20_000)]
    own = [f"x{i}" for i in range(20_000)]
    long = "\n".join(v for pair in zip(frequent, own, strict=True) for v in pair)
    rows = [(0, long)] + [(i, "\n".join(frequent)) for i in range(1, 6)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0]["text"] == "\n".join(own) and got[0]["n_dropped"] == 20_000
    assert got[1]["text"] == "" and got[5]["text"] == rows[5][1]


def test_line_dedup_keeps_the_last_of_null_ids(spark):
    line = "x" * 40
    rows = [(i, line, None, None) for i in range(4)] + [(None, line + " ", None, None), (None, "short\n" + line, None, None)]
    got = [(r.doc_id, r.n_lines, r.n_dropped, brute.sha(r.text.encode())) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()]
    assert order(got) == order(brute.line_dedup([(d, t) for d, t, _, _ in rows]))


@pytest.mark.parametrize("window", [13, 3])
def test_substring_dedup(spark, window):
    got = [tuple(r) for r in substring_dedup.dedup_substrings(frame(spark), window=window, digest=True).collect()]
    want = brute.substring_dedup([(d, t) for d, t, _, _ in documents()], window)
    assert order(got) == order(want) and sum(x[2] for x in want) > 0
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0


def test_sketch_never_underestimates():
    draw = np.random.default_rng(3)
    layout = substring_dedup.Layout(64, 1)  # far too narrow: many cells are shared
    parts = [draw.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(3)]
    parts[1][:50] = parts[0][:50]
    for row in range(substring_dedup.DEPTH):
        reached = set()
        seen = {}
        for p in parts:
            cells, twice = substring_dedup._sketch_cells(p, layout, row)
            for c, t in zip(cells.tolist(), twice.tolist()):
                seen[c] = seen.get(c, 0) + 1 + t
        reached = {c for c, n in seen.items() if n > 1}
        assert set(layout.cells(parts[0][:50], row).tolist()) <= reached


def test_substring_dedup_least_id_and_null(spark):
    shared = " ".join(f"w{i}" for i in range(20))
    rows = [(None, f"{shared} a b"), (-(1 << 63), f"c {shared}"), (None, shared), (7, f"{shared} d"), (7, f"{shared} d"), ((1 << 63) - 1, shared)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, 22, 0, f"{shared} a b"), (None, 20, 0, shared), (-(1 << 63), 21, 20, "c"), (7, 21, 20, "d"), (7, 21, 20, "d"), ((1 << 63) - 1, 20, 20, "")]
    key = lambda r: (r[0] is not None, r[0] or 0, r[3])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    own = spark.createDataFrame(rows[3:5] + [(7, f"e {shared}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.dedup_substrings(own).collect()} == {0}


def test_substring_candidates_once_a_partition():
    """A passage that all documents of a partition hold is sent once for each window."""
    import numpy as np
    import pyarrow as pa

    passage = " ".join(f"w{i}" for i in range(30))
    table = pa.table({"id": pa.array([None, *range(500)], pa.int64()), "text": [f"{passage} own{i}" for i in range(501)], "pid": pa.array([3] * 501, pa.int64())})
    layout = substring_dedup.Layout(1 << 14, 4)
    sketch = substring_dedup.sketch(table, layout, 13)
    merged = [substring_dedup.merge(sketch.take([i]), layout) for i in range(sketch.num_rows)]
    answers = pa.concat_tables(merged)
    sent = substring_dedup.candidates(table, answers, layout, 13)
    assert sum(len(substring_dedup._unzip(x, "<u8")) for x in sent.column("hash").to_pylist()) <= 18 + 30  # 18 shared windows and false alarms
    found = substring_dedup.Candidates(substring_dedup.Texts(table, 13), answers.to_pylist(), layout)
    assert len(found.order) >= 18 * 501 and np.count_nonzero(~found.after) <= len(found.hash)


def test_substring_dedup_keeps_text(spark):
    rows = [(1, "a b c d", None, None), (2, "x a b c y", None, None)]
    got = {r.doc_id: r.kept for r in substring_dedup.dedup_substrings(frame(spark, rows), window=3).collect()}
    assert got == {1: "a b c d", 2: "x y"}


def test_simhash(spark):
    docs = documents()
    fps = [brute.simhash(t) for _, t, _, _ in docs]
    tops = brute.components(len(docs), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    least = {}
    for (d, *_), t in zip(docs, tops):
        if d is not None:
            least[t] = min(least.get(t, d), d)
    want = [(d, f"{f:016x}", least.get(t)) for (d, *_), f, t in zip(docs, fps, tops)]
    out = simhash.near_duplicates(frame(spark)).withColumn("hex", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    assert order((r.doc_id, r.hex, r.component_id) for r in out.collect()) == order(want)
    kept = simhash.one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    rows = kept.select("doc_id").collect()
    assert len(rows) == len(set(tops))
    assert {r.doc_id for r in rows if r.doc_id is not None} == set(least.values())
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.one_of_each(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("shard", "tree_bytes"), [(20, 1 << 20), (20, 0), (4096, 1 << 20)])
def test_shards_are_cut_without_losing_links(spark, shard, tree_bytes):
    """Fingerprints around few centres crowd the shards; any cut gives the same groups."""
    draw, values = np.random.default_rng(5), set()
    centres = [int(x) for x in draw.integers(0, 1 << 62, 3)]
    while len(values) < 400:
        x = centres[draw.integers(3)]
        for _ in range(draw.integers(1, 6)):
            x ^= 1 << int(draw.integers(62))
        values.add(x)
    values = sorted(values)
    tops = brute.components(len(values), lambda i, j: bin(values[i] ^ values[j]).count("1") <= 2)
    frame_ = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in components(simhash.links(frame_, 2, shard, tree_bytes)).collect()}
    assert [got.get(v, v) for v in values] == [values[t] for t in tops]


def test_bk_tree_follows_edges_within_the_radius():
    draw = np.random.default_rng(1)
    values = np.unique(draw.integers(0, 1 << 16, 300)).astype(np.uint64)
    draw.shuffle(values)
    tree = simhash.BKTree.of(values)
    q, node, _ = tree.within(values[:40], 3)
    assert set(zip(q, node)) == {(i, j) for i in range(40) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 3} and len(q) == len(set(zip(q, node)))
    for i in range(1, len(values)):  # a child hangs under its distance to the parent
        assert tree.edge[i] == int(values[i] ^ values[tree.parent[i]]).bit_count()


def test_bk_trees_prune(spark):
    """A shard holds thousands, and a search sees a part of it."""
    draw = np.random.default_rng(2)
    values = draw.integers(0, 1 << 63, 40_000).astype(np.uint64)
    tree = simhash.BKTree.of(values[: simhash.SHARD])
    *_, visits = tree.within(values[:1000], 2)
    assert visits / 1000 < 0.4 * simhash.SHARD
    df = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fp long")
    sizes = [r["count"] for r in simhash.shards(df).groupBy("mask", "key").count().collect()]
    assert min(sizes) > 500 and max(sizes) <= 4 * simhash.SHARD


def test_rows_of_equal_short_hashes_are_not_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_digest", lambda text: F.lit(b"x"))
    docs = [d for d in documents() if d[0] not in (None, 3, 7)]  # ids of one row each
    tops = brute.components(len(docs), lambda i, j: bin(brute.simhash(docs[i][1]) ^ brute.simhash(docs[j][1])).count("1") <= 2)
    least = {t: min(d[0] for d, top in zip(docs, tops) if top == t) for t in set(tops)}
    kept = simhash.one_of_each(frame(spark, docs).withColumnRenamed("fp", "row").withColumnRenamed("bin", "nth"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_components(spark):
    draw = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, int(x)) for x in draw.integers(101, 160, 50)] + [(7, 7), (-3, 200), (200, -9)]
    nodes = sorted({x for p in pairs for x in p})
    linked = {frozenset(p) for p in pairs}
    tops = brute.components(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in linked)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == {n: nodes[t] for n, t in zip(nodes, tops)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_base_statistics(spark):
    out = rules.judge(frame(spark))
    got = [(r.doc_id, *(r[c] for c in rules.BASE), r.base_failed) for r in out.collect()]
    assert order(got) == order((d, *brute.base_statistics(t)) for d, t, _, _ in documents())
    assert rules.judge(frame(spark, [])).count() == 0


def test_outliers_match_a_plain_estimate(spark):
    """One cell of clean documents with a few that have many symbols or long words."""
    import random

    draw = random.Random(4)
    rows = []
    for i in range(260):
        text = " ".join("".join(draw.choices("abcdefghij", k=draw.randint(3, 8))) for _ in range(draw.randint(60, 300)))
        rows.append((i, text if i >= 12 else text.replace(" ", " | ") if i % 2 else text.replace(" ", "!!!!!! "), "en", "a"))
    got = {r.doc_id: r for r in rules.judge(frame(spark, rows)).collect()}
    x = []
    for _, t, _, _ in rows:
        n, chars, symbols, dups, rep, _ = brute.base_statistics(t)
        x.append((np.log1p(n), np.log1p(chars / n), (symbols / chars) ** 0.5, (dups / len(t.split("\n"))) ** 0.5, (rep / n) ** 0.5))
    x, floors = np.array(x), np.diag(np.square(rules.FLOORS))
    scale = np.sqrt(((np.percentile(x, 75, 0) - np.percentile(x, 25, 0)) / 1.349) ** 2 + np.square(rules.FLOORS))
    d = (((x - np.median(x, 0)) / scale) ** 2).sum(1)
    for _ in range(30):
        near = np.argsort(d, kind="stable")[: (len(x) + rules.P + 1) // 2]
        d = _distances(x, x[near], rules.HALF, floors)
    d = _distances(x, x[d <= rules.chi2_point(0.975, rules.P)], 1.0, floors)
    mine = np.array([got[i].d2 for i in range(len(rows))])
    assert np.corrcoef(np.log(mine + 1), np.log(d + 1))[0, 1] > 0.99
    want = d <= rules.chi2_point(rules.KEEP, rules.P)
    assert [got[i].kept for i in range(len(rows))] == want.tolist() and not want[:12].any() and want[12:].all()


def test_repetition_alone_rejects(spark):
    """A clean cell with documents whose only fault is repeated lines, or repeated words
    under the base limit; a phrase said twice is no fault."""
    import random

    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(draw.randint(60, 300)), "en", "a") for i in range(200)]
    for i in range(200, 204):
        few, lines = [word() for _ in range(40)], None
        while lines is None or len(set(zip(lines, lines[1:], lines[2:]))) < len(lines) - 2:
            lines = draw.choices(few, k=160)
        rows.append((i, "\n".join(lines), "en", "a"))
    for i in range(204, 208):
        phrases = [text(8) for _ in range(4)]
        rows.append((i, " ".join(f"{p} {text(12)}" for p in phrases + phrases), "en", "a"))
    twice = text(3)
    rows.append((208, f"{twice} {text(80)} {twice} {text(80)}", "en", "a"))
    got = {r.doc_id: r for r in rules.judge(frame(spark, rows)).collect()}
    assert all(got[i].n_repeat_words == 0 and got[i].n_dup_lines >= 0.7 * 160 for i in range(200, 204))
    assert all(got[i].n_dup_lines == 0 and 100 * got[i].n_repeat_words == 40 * got[i].n_words for i in range(204, 208))
    assert not any(got[i].base_failed or got[i].kept for i in range(200, 208))
    assert all(got[i].kept for i in [*range(200), 208])


def _mcd(x):
    """(n, mean, covariance) by the four starts, with exact halves."""
    floors = np.square(rules.FLOORS)
    m = np.median(x, 0)
    s = np.sqrt(((np.percentile(x, 75, 0) - np.percentile(x, 25, 0)) / 1.349) ** 2 + floors)
    z = (x - m) / s
    far = np.sqrt((z * z).sum(1))[:, None]
    t, u = np.tanh(z), np.divide(z, far, out=np.zeros_like(z), where=far > 0)

    def around(c):
        by = np.sqrt(np.outer(np.diag(c), np.diag(c)))
        r = np.divide(c, by, out=np.zeros_like(c), where=by > 0)
        np.fill_diagonal(r, 1)
        return m, r * np.outer(s, s)

    starts = [around(np.eye(rules.P)), around(np.cov(t.T, bias=True)), around(u.T @ u / len(x)), (x.mean(0), np.cov(x.T, bias=True))]

    def step(mean, c):
        e = x - mean
        d = np.einsum("ij,jk,ik->i", e, np.linalg.inv(c + np.diag(floors)), e)
        near = x[np.argsort(d, kind="stable")[: (len(x) + rules.P + 1) // 2]]
        return near.mean(0), np.cov(near.T, bias=True).reshape(rules.P, rules.P) * rules.HALF

    for _ in range(2):
        starts = [step(*e) for e in starts]
    best = min(starts, key=lambda e: np.linalg.slogdet(e[1] + np.diag(floors))[1])
    for _ in range(30):
        best = step(*best)
    e = x - best[0]
    inner = x[np.einsum("ij,jk,ik->i", e, np.linalg.inv(best[1] + np.diag(floors)), e) <= rules.chi2_point(0.975, rules.P)]
    return len(x), inner.mean(0), np.cov(inner.T, bias=True).reshape(rules.P, rules.P)


def test_every_cell_is_judged_by_a_shrunk_estimate(spark):
    """Cells of 5, 50 and 500 documents, a document without faults in each and one with."""
    import random

    draw = random.Random(8)
    text = lambda: " ".join("".join(draw.choices("abcdefghij", k=draw.randint(3, 8))) for _ in range(draw.randint(60, 300)))
    rows, bad = [], []
    for source, lang, n in (("five", "en", 5), ("fifty", "en", 50), ("many", "de", 500), (None, None, 1)):
        for k in range(n):
            t = text()
            if k == 4:
                bad.append(len(rows))
                t = t.replace(" ", " |# ")
            rows.append((len(rows), t, lang, source))
    df = frame(spark, rows).withColumn("x1", F.lit("keep")).withColumn("cell", F.lit("keep")).withColumn("m1", F.lit("keep"))
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    assert all((r.x1, r.cell, r.m1) == ("keep",) * 3 and r.d2 is not None for r in got.values())
    assert sorted(i for i, r in got.items() if not r.kept) == bad

    x = []
    for _, t, *_ in rows:
        n, chars, symbols, dups, rep, _ = brute.base_statistics(t)
        x.append((np.log1p(n), np.log1p(chars / n), (symbols / chars) ** 0.5, (dups / len(t.split("\n"))) ** 0.5, (rep / n) ** 0.5))
    x, of = np.array(x), [(lang, source) for _, _, lang, source in rows]
    pick = lambda test: _mcd(x[[i for i, o in enumerate(of) if test(o)]])
    whole = pick(lambda o: True)
    want = np.zeros(len(rows))
    for key in set(of):
        if key[0] is None:
            continue  # one document: its own covariance is none
        a, b = pick(lambda o: o == key), pick(lambda o: o[0] == key[0])
        mix = lambda e, f: tuple(e[0] / (e[0] + rules.PRIOR) * p + rules.PRIOR / (e[0] + rules.PRIOR) * q for p, q in zip(e[1:], f))
        m, c = mix(a, mix(b, whole[1:]))
        for i, o in enumerate(of):
            if o == key:
                want[i] = (x[i] - m) @ np.linalg.inv(c + np.diag(np.square(rules.FLOORS))) @ (x[i] - m)
    mine = np.array([got[i].d2 for i in range(len(rows) - 1)])
    assert np.corrcoef(np.log(mine + 1), np.log(want[:-1] + 1))[0, 1] > 0.99


def test_the_start_of_least_determinant_goes_on(spark):
    names = [f"l{i}{j}" for i, j in rules.LOWER]
    rows = [("a", s, *[float(s + 1) if n[1] == n[2] else 9.0 * s for n in names]) for s in (2, 0, 1)] + [("b", 3, *[0.5] * len(names)), ("b", 1, *[0.5] * len(names))]
    df = spark.createDataFrame(rows, "cell string, start int, " + ", ".join(f"{n} double" for n in names))
    assert sorted((r.cell, r.start) for r in rules._least(df).collect()) == [("a", 0), ("b", 1)]


def _distances(x, near, factor, floors):
    s = np.cov(near.T, bias=True) * factor + floors
    e = x - near.mean(0)
    return np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e)


def test_chi2():
    assert abs(rules.chi2_point(0.95, 1) - 3.841459) < 1e-5 and abs(rules.chi2_point(0.975, 5) - 12.832502) < 1e-5
