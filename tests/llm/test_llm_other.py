"""WARC round trips, the classifier's held-out accuracy, vector recall, and the pipeline."""

import io
import random
from collections import Counter

import brute
import duckdb
import numpy as np
from conftest import SF_MID, SF_SMALL
from llm_data import documents, frame

from pyspark.sql import functions as F
from stratus.llm import packing, quality, vectors, warc


def test_records_of_any_split():
    draw = random.Random(1)
    rows, data = [], b""
    for i in range(150):
        n = draw.choice([0, 5, 3000, 100000])
        body = bytes(draw.choices(b"abc<> \x1f\x8b\x08", k=n)) if n < 50000 else draw.randbytes(n)
        rows.append((i, body))
        data += warc.record(i, f"http://x/\r\n{i}", body)
    for split in (997, 65536, 1 << 40):
        got = [r for at in range(0, len(data), split) for r in warc.records(io.BytesIO(data), at, min(at + split, len(data)))]
        assert [(r["page_id"], r["payload"]) for r in got] == rows
    assert got[3]["url"] == "http://x/%0D%0A3"
    hurt = data[:50000] + b"XXXX" + data[50004:]
    assert len(list(warc.records(io.BytesIO(hurt), 0, len(hurt)))) == len(rows) - 1


def test_a_members_own_bytes_are_no_record():
    """A stored member inside a payload is skipped with the record that holds it."""
    inner = warc.record(5, None, b"inner")
    data = warc.record(1, None, inner * 3) + warc.record(2, None, b"x")
    assert [r["page_id"] for r in warc.records(io.BytesIO(data), 0, len(data))] == [1, 2]


def test_warc_round_trip(spark):
    big, rows = "é" * 600, []
    rows += [(i, f"http://h/{i}", big, 1) for i in range(1, 9)] + [(8, None, big, 1), (None, None, big, 1), (None, "u", "z" * 2000, 1)]
    rows += [(20, "u", None, 1), (21, "u", "", 1), (22, "u", "s" * 999, 1), (23, "u", "s" * 999, 1), (24, "u", "t" * 1000, 1), (25, "u", "t" * 1000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.read_warc(warc.write_warc(pages, file_bytes=500), split_bytes=200).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    import hashlib

    for r in got:
        body = next((x[2] or "").encode() for x in rows if (x[0], x[1]) == (r.page_id, r.url))
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        copies = [x[0] for x in rows if x[2] and len(x[2].encode()) >= 1000 and x[2].encode() == body and x[0] is not None]
        revisit = bool(copies) and r.page_id != max(copies)
        assert (r.record_type, r.refers_to) == (("revisit", max(copies)) if revisit else ("response", None))
        assert (bytes(r.payload) == body) if not revisit else r.payload is None
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_factorisation_identity():
    """The linear form equals the sum over all pairs."""
    draw = np.random.default_rng(2)
    m = quality.Machine(0.3, draw.normal(size=quality.SIZE).astype(np.float32), draw.normal(size=(quality.SIZE, quality.FACTORS)).astype(np.float32))
    index, value = draw.choice(quality.SIZE, 20, replace=False), draw.normal(size=20).astype(np.float32) / 5
    pairs = sum(float(m.v[index[i]] @ m.v[index[j]]) * value[i] * value[j] for i in range(20) for j in range(i))
    want = 1 / (1 + np.exp(-(m.bias + float(m.w[index] @ value) + pairs)))
    assert abs(m.scores([(index, value)])[0] - want) < 1e-4


def test_quality_on_held_out_documents(spark):
    got = quality.query(spark, SF_MID).toPandas().set_index("doc_id")
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF_MID}/labels.parquet'").df().set_index("doc_id").quality
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out].join(labels, how="inner")
    assert (held.predicted == held.quality).mean() > 0.93


def test_quality_of_awkward_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(d, i % 2, None) for i, (d, *_) in enumerate(documents())] + [(None, 1, None), (1, None, None), (2, 5, None)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.fit(docs, labels))
    assert out.columns == [*docs.columns, "score"] and out.filter("score BETWEEN 0 AND 1").count() == len(documents())
    none = quality.fit(docs, labels.limit(0))
    assert [r.score for r in quality.score(docs, none).select("score").distinct().collect()] == [0.5]
    assert quality.score(docs.limit(0), none).count() == 0


def _vectors(seed=1, n=400, dim=16):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim))
    x[n // 2 :] = x[: n - n // 2] + draw.normal(size=(n - n // 2, dim)) * draw.choice([0.02, 0.08, 0.12, 0.3], size=(n - n // 2, 1))
    x[100:160] = x[0] + draw.normal(size=(60, dim)) * 0.03
    x[160:190] = x[1]
    return x.astype(np.float32)


def test_vectors_find_all_links_near_the_target(spark):
    x = _vectors()
    labels = [i % 3 if i < 100 or i >= 190 else 0 for i in range(len(x))]
    rows = [(i, v.tolist(), labels[i]) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] + [1.0] * 15, 0), (905, x[0].tolist(), None), (906, [1.0, 2.0], 0), (907, [float("inf")] + [1.0] * 15, 0), (3, x[5].tolist(), 1), (None, x[1].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("n"))
    got = vectors.near_duplicates(df).collect()
    live = [(i, v, lab) for i, v, lab in rows if v and len(v) == 16 and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    u = vectors.unit(np.array([v for _, v, _ in live], dtype=np.float32))
    near = (u @ u.T >= 0.93) & (np.array([[a == b for _, _, a in live] for _, _, b in live]))
    np.fill_diagonal(near, False)
    assert len(got) == len(rows)
    found, true = sum(r.n_links for r in got), int(near.sum())
    assert 0.99 * true <= found <= true
    most = Counter(i for i, _, _ in live)
    limit = {i: int(near[k].sum()) for k, (i, _, _) in enumerate(live) if most[i] == 1}
    assert all(r.n_links <= limit[r.vec_id] for r in got if r.vec_id in limit)
    for r in got:
        if r.vec_id is not None and r.vec_id >= 900:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert {r.component_id for r in got if r.vec_id in range(160, 190)} == {160}  # their original has another label
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_every_length_in_their_own_precision(spark):
    rows = [(i, [float(i), 1.0, 2.0, 0.5, 1.0, 1.0, 1.0, 1.0], 0) for i in range(50)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0 + i / 1000], 0) for i in range(3)]  # a rarer length
    rows += [(200, [1e300, 1e300], 1), (201, [1e299, 1e299], 1), (202, [1e300, -1e300], 1)]
    for k, c in enumerate((0.93 + 1e-9, 0.93 - 1e-9)):  # in single precision both would be judged alike
        rows += [(300 + 10 * k, [1.0, 0.0, 0.0], 2 + k), (301 + 10 * k, [c, float(np.sqrt(1 - c * c)), 0.0], 2 + k)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[100 + i] for i in range(3)] == [(2, 100)] * 3
    assert (got[200], got[201], got[202]) == ((1, 200), (1, 200), (0, 202))
    assert (got[300], got[301], got[310], got[311]) == ((1, 300), (1, 300), (0, 310), (0, 311))


def test_visits_are_in_order_of_distance():
    draw = np.random.default_rng(4)
    m = vectors.MultiIndex(draw.normal(size=(6, 3)), draw.normal(size=(5, 3)), 4.0)
    d = m.distances(draw.normal(size=(20, 6)))
    for a, b in zip(*d):
        total = (a[:, None] + b[None, :]).ravel()
        want = np.flatnonzero(total <= total.min() + 4.0)
        got = m.visits(a, b)
        assert sorted(got) == want.tolist() and (np.diff(total[got]) >= -1e-12).all() and got[0] == total.argmin()


def test_hot_cells_give_the_same_links(spark, monkeypatch):
    x = _vectors(3, 300)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, vectors.near_duplicates(df).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 16)
    assert sorted(map(tuple, vectors.near_duplicates(df).collect())) == whole


# ---- the pipeline -----------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "pack"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").cache()
    step = dict(corpus_pipeline.STAGES)
    good = step["quality"](spark, docs, SF_SMALL)
    assert good.columns == docs.columns
    rows = [tuple(r) for r in good.collect()]
    assert 0 < len(rows) < docs.count() and set(rows) <= {tuple(r) for r in docs.collect()}
    good = spark.createDataFrame(rows, docs.schema)
    lines = step["line_dedup"](spark, good, SF_SMALL)
    got = lines.collect()
    want = brute.line_dedup([(r[0], r[1]) for r in rows])
    assert lines.columns == docs.columns and Counter((r.doc_id, brute.sha(r.text.encode())) for r in got) == Counter((w[0], w[3]) for w in want)
    assert all(r.n_chars == len(r.text) for r in got)
    lines = spark.createDataFrame(got, docs.schema)
    left = step["near_dedup"](spark, lines, SF_SMALL).collect()
    fps = [brute.simhash(r.text) for r in got]
    tops = brute.components(len(got), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    least = {}
    for r, t in zip(got, tops):
        least[t] = min(least.get(t, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in left) == sorted(least.values())
    left = spark.createDataFrame(left, docs.schema)
    mix = step["mix"](spark, left, SF_SMALL)
    assert mix.columns == docs.columns
    sizes = {}
    for r in left.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    taken, most = Counter(), Counter()
    for r in mix.collect():
        taken[r.source] += len(brute.words(r.text))
        most[r.source] = max(most[r.source], len(brute.words(r.text)))
    for s, t in brute.targets(sizes).items():
        assert abs(taken[s] - t) <= max(most[s], 1) or taken[s] == 0
    last = step["pack"](spark, mix, SF_SMALL)
    tokens = packing.pieces(mix).agg(F.sum("length")).first()[0]
    assert last.agg(F.sum("length")).first()[0] == tokens
    assert last.select("sequence_id").distinct().count() <= -(-tokens // 4096) + 2


def test_pipeline_of_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    docs = frame(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in documents()], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    x = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        x = stage(spark, x, str(tmp_path))
        assert x.columns == docs.columns, name
        x = spark.createDataFrame(x.collect(), docs.schema)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
