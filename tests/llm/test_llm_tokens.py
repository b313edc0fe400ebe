"""Token files, packing and mixing against brute force and exact round trips."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from llm_data import documents, frame

from stratus.llm import mixing, packing, token_files, tokens

VOCABULARY = tokens.default_vocabulary()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_give_the_librarys_ids(tokenizer):
    draw = random.Random(9)
    marks = " \t\n\r\x0b\x0c\x1c\x00\x85 　́̈abcABCéÈßΣςÜÿſİ²½ªº'stre12.,!?#日本한<|endoftext|>"
    texts = ["".join(draw.choice(marks) for _ in range(draw.randint(0, 50))) + draw.choice(["", "<|endoftext|>x"]) for _ in range(1500)]
    got = tokens.WordEncoder(VOCABULARY).encode([*texts, None, "y" * 5000])
    for t, g in zip([*texts, "", "y" * 5000], got):
        assert np.frombuffer(g, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_planes_round_trip(unit):
    draw = np.random.default_rng(0)
    for top in (1, 2, 255, 49408, 1 << 31):
        ids = draw.integers(0, top, 1000).astype("<u4")
        planes = token_files.to_planes(ids, unit)
        assert (token_files.from_planes(planes, len(ids), unit) == ids).all()
    assert token_files.to_planes(np.zeros(5, "<u4"), unit) == []


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_token_files(spark, tokenizer, unit):
    rows = documents()
    manifest = token_files.write_tokens(frame(spark), unit=unit, block_ids=500)
    got = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, *_ in rows), key=lambda d: (d is not None, d))
    at, want = 0, Counter((d, tuple(ids_of(tokenizer, t))) for d, t, _, _ in rows)
    for r in got:
        ids = tuple(np.frombuffer(r.ids, "<u4").tolist())
        want[(r.doc_id, ids)] -= 1
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert not any(want.values())
    assert token_files.read_tokens(token_files.write_tokens(frame(spark, []))).count() == 0


def test_one_chunk_can_be_read_alone(tmp_path):
    writer, draw = token_files.TokenWriter(str(tmp_path), block_ids=100), np.random.default_rng(1)
    docs = [draw.integers(0, 49000, n).astype("<u4") for n in (0, 30, 250, 1, 99)]
    for k, x in enumerate(docs):
        writer.add(k, x.tobytes())
    reader, flat = token_files.TokenReader(writer.close()["path"]), np.concatenate(docs)
    assert (reader.chunk(2) == flat[200:300]).all() and len(reader.index["chunks"]) == 4
    assert [b for _, _, b in reader.documents()] == [x.tobytes() for x in docs]


def test_plan_uses_every_piece_once():
    draw = random.Random(1)
    for _ in range(150):
        capacity, counts = draw.choice([7, 16, 50]), Counter()
        for _ in range(draw.randint(0, 60)):
            counts[draw.randint(1, capacity)] += draw.choice([1, 1, 3])
        made, used = packing.plan(dict(counts), capacity), Counter()
        for combo, times in made:
            assert sum(combo) <= capacity and times > 0
            for x in combo:
                used[x] += times
        assert used == counts
        filled = sum(t for _, t in made)
        assert filled <= best_fit_decreasing(counts, capacity)


def best_fit_decreasing(counts, capacity):
    gaps = []
    for x in sorted(counts.elements(), reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            gaps.append(capacity - x)
        else:
            gaps[gaps.index(fit)] -= x
    return len(gaps)


def test_plan_finds_exact_complements():
    assert packing.plan({60: 2, 40: 2, 100: 1}, 100) == [([100], 1), ([60, 40], 2)]
    assert packing.plan({50: 1, 30: 1, 20: 1}, 100) == [([50, 30, 20], 1)]
    assert packing.plan({40: 1, 30: 1, 20: 1, 10: 1}, 100) == [([40, 30, 20, 10], 1)]


def test_packing(spark, tokenizer):
    rows, capacity = documents(), 256
    found = packing.pack(packing.pieces(frame(spark), capacity=capacity, with_ids=True), capacity=capacity)
    got, want = found.collect(), Counter()
    for d, t, _, _ in rows:
        ids = ids_of(tokenizer, t)
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[(d, k, at, len(ids[at : at + capacity]), brute.crc(ids[at : at + capacity]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(found).collect()}
    assert whole == {k: b"".join(bytes(r.ids) for r in sorted(v, key=lambda r: r.offset)) for k, v in sequences.items()}
    assert len(sequences) <= best_fit_decreasing(Counter(r.length for r in got), capacity)
    assert packing.pack(packing.pieces(frame(spark, []))).count() == 0


def test_mixing(spark):
    rows = documents()
    got = mixing.mix(frame(spark)).collect()
    assert len(got) == len(rows) and {"key", "fp", "doc_id", "text"} <= set(got[0].asDict())
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(brute.words(t))) for d, t, _, _ in rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 for r in own)
        epochs = int(want[s] // sizes[s]) if sizes[s] else 0
        assert all(epochs <= r.copies <= min(3, epochs + 1) for r in own)
        # the document on which the budget ends may be off by half, and repeats go together
        assert abs(sum(r.size * r.copies for r in own) - want[s]) <= 3 * max(r.size for r in own)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    again = mixing.mix(frame(spark)).collect()
    assert Counter((r.doc_id, r.text, r.copies) for r in got) == Counter((r.doc_id, r.text, r.copies) for r in again)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_targets_stop_at_the_cap(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, None: 400}
    frame_ = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.targets(frame_).collect()}
    assert got == pytest.approx(brute.targets(sizes)) and got["a"] == 30


def test_sampling_follows_the_weights(spark):
    """Documents of weight 1 are taken far more often than those of the least weight."""
    from pyspark.sql import functions as F

    rows = [(i, "w " * 10, None, "a" if i < 1000 else "b") for i in range(1200)]
    heavy = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25)
    got = [r for r in mixing.mix(frame(spark, rows), weight=heavy, weights=(1, 2)).collect() if r.source == "a"]
    share = lambda even: np.mean([r.copies for r in got if (r.doc_id % 2 == 0) == even])
    assert 0 < got[0].target < got[0].source_size and share(True) > 1.3 * share(False)
