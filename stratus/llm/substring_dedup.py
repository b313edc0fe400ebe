"""Substring dedup with a count-min prefilter.

A window is ``window`` consecutive words. Words that a window covers go if the same
window also starts in a document with a smaller id. Three passes over the texts, which
are shuffled once into partitions of their own (pid) that every pass reads:

1. Each partition makes its count-min sketch: ``DEPTH`` rows of cells, a window of a
   document adding one to a cell of each row. Only the cells it touches are sent, sorted
   and packed, to the block of cells they belong to. Blocks merge the partitions' counts
   and tell each partition, in a bit for each of its cells, which reached two. An
   estimate is never below the true count, so no repeated window is lost.
2. Windows whose cells all reached two are sent with a 96-bit hash, once a partition with
   the least document that has them there, to buckets by hash. Those group them exactly and
   answer with a bit for each: whether another partition has a smaller document.
3. Partitions take the words of those windows out of their texts.

Nothing is broadcast and nothing grows in one place: rows of the sketch are four times as
wide as there are windows and are cut into blocks by that number, so the share of false
alarms (about 5 %) and the size of a merge stay the same for any input. A passage that
very many documents share is one cell in each partition's sketch and one row of each in
its bucket. Rows that repeat both id and text share a partition.

Defined cases: a null or empty text has no words; texts shorter than a window stay whole;
rows that repeat an id are one document (their windows don't remove each other); a null
id is smaller than all others; other columns aren't read; an empty table gives an empty
result. Ids are integers.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DEPTH = 2
#: Windows in a merge, and bytes of text in a partition, about.
BLOCK_WINDOWS, PART_BYTES = 1 << 20, 12 << 20
#: Odd multipliers that spread a hash over a row's cells, and over positions in a window.
SPREAD = np.array([1, 0xD6E8FEB86659FD93], dtype=np.uint64)
STEP = 0x9E3779B97F4A7C15


# ---- windows and packed arrays ----------------------------------------------------------


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes for each word."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2)


def windows(hashes: np.ndarray, window: int) -> np.ndarray:
    """A hash for each window: the sum of its words' hashes times powers of an odd number."""
    n = len(hashes) - window + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k, power in enumerate(_powers(window) if n > 0 else ()):
        out += hashes[k : k + n] * power
    return out


@lru_cache
def _powers(n: int) -> np.ndarray:
    return np.array([pow(STEP, k, 1 << 64) for k in range(n)], dtype=np.uint64)


def _zip(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.reshape(-1, 1).view(np.uint8).T).tobytes())


def _unzip(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0)) if len(a) else a


def _cut(sorted_keys: np.ndarray, shift: int):
    """(block, first, last) for each run of keys with equal bits above ``shift``."""
    blocks = sorted_keys >> np.uint64(shift)
    at = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else np.zeros(0, np.int64)
    for i, first in enumerate(at):
        yield int(blocks[first]), int(first), int(at[i + 1]) if i + 1 < len(at) else len(blocks)


class Texts:
    """The documents of a partition in a fixed order, whatever order they came in."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("id").to_pylist()
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids, self.texts, self.window = [ids[i] for i in order], [texts[i] for i in order], window
        self.found: list | None = None

    def hashed(self, keep: bool):
        """(index, word hashes, window hashes) of documents that have windows; ``keep``
        holds them for the next time."""
        if self.found is not None:
            yield from self.found
            return
        held = []
        for i, t in enumerate(self.texts):
            words = t.split()
            if len(words) >= self.window:
                h = word_hashes(words)
                row = (i, h, windows(h[:, 0], self.window))
                if keep:
                    held.append(row)
                yield row
        if keep:
            self.found = held


class Layout:
    """Width of the sketch and number of its blocks and buckets, powers of two."""

    def __init__(self, n_windows: int, parallel: int):
        self.cell_bits = int(np.ceil(np.log2(max(4 * n_windows, 1 << 12))))
        self.block_bits = min(int(np.ceil(np.log2(max(n_windows / BLOCK_WINDOWS, parallel / 4, 1)))), self.cell_bits - 8)

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return (hashes * SPREAD[row]) >> np.uint64(64 - self.cell_bits)


# ---- pass 1: sketches and their merge ---------------------------------------------------

SKETCH = pa.schema([("row", pa.int32()), ("block", pa.int64()), ("pid", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())])
ANSWER = pa.schema([("pid", pa.int64()), ("row", pa.int32()), ("block", pa.int64()), ("bits", pa.binary())])


def _sketch_cells(hashes: np.ndarray, layout: Layout, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells a partition touches, whether it counts at least two there)."""
    cells = np.sort(layout.cells(hashes, row))
    first = np.r_[True, cells[1:] != cells[:-1]] if len(cells) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return cells[at], np.diff(np.r_[at, len(cells)]) > 1


def _gathered(texts: Texts, keep: bool) -> np.ndarray:
    """Each document's distinct windows."""
    found = [np.unique(w) for _, _, w in texts.hashed(keep)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def sketch(table: pa.Table, layout: Layout, window: int) -> pa.Table:
    pid, hashes, rows = table.column("pid")[0].as_py(), _gathered(Texts(table, window), False), []
    shift = layout.cell_bits - layout.block_bits
    for row in range(DEPTH):
        cells, twice = _sketch_cells(hashes, layout, row)
        for block, a, b in _cut(cells, shift):
            inside = (cells[a:b] - np.uint64(block << shift)).astype("<u8")
            rows.append({"row": row, "block": block, "pid": pid, "cells": _zip(_deltas(inside)), "twice": np.packbits(twice[a:b]).tobytes()})
    return pa.Table.from_pylist(rows, SKETCH)


def merge(table: pa.Table, layout: Layout) -> pa.Table:
    """All partitions' counts for a block of cells: which reach two."""
    width = 1 << (layout.cell_bits - layout.block_bits)
    once, twice, held = np.zeros(width, bool), np.zeros(width, bool), []
    for x in table.to_pylist():
        cells = np.cumsum(_unzip(x["cells"], "<u8")).astype(np.int64)
        twice[cells[once[cells] | np.unpackbits(np.frombuffer(x["twice"], np.uint8), count=len(cells)).astype(bool)]] = True
        once[cells] = True
        held.append((x, cells))
    return pa.Table.from_pylist([{"pid": x["pid"], "row": x["row"], "block": x["block"], "bits": np.packbits(twice[c]).tobytes()} for x, c in held], ANSWER)


# ---- pass 2: exact groups of the windows estimated repeated -----------------------------

CANDIDATE = pa.schema([("bucket", pa.int64()), ("pid", pa.int64()), ("hash", pa.binary()), ("more", pa.binary()), ("doc", pa.binary()), ("ids", pa.binary()), ("known", pa.binary())])


class Candidates:
    """A partition's windows that the merged sketch estimates repeated, sorted by hash: in
    ``hash``, ``more`` and ``doc`` once each with the first document, in ``order`` and
    ``group`` once a document, where ``after`` tells that the first one's id is smaller."""

    def __init__(self, texts: Texts, answers: list[dict], layout: Layout):
        hashes = _gathered(texts, True)
        self.by_doc: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        local_bits = min(max(10, (16 * len(hashes)).bit_length()), 25)
        mask = np.uint64((1 << local_bits) - 1)
        local = []
        for row in range(DEPTH):
            cells, _ = _sketch_cells(hashes, layout, row)
            bits = {x["block"]: x["bits"] for x in answers if x["row"] == row}
            flags = [np.unpackbits(np.frombuffer(bits[k], np.uint8), count=b - a) for k, a, b in _cut(cells, layout.cell_bits - layout.block_bits)]
            # a table by the low bits of a cell; two cells that share them only add candidates
            repeated = np.zeros(1 << local_bits, bool)
            if flags:
                repeated[cells[np.concatenate(flags).astype(bool)] & mask] = True
            local.append(repeated)
        h0, h1, doc = [], [], []
        for i, words, w in texts.hashed(True):
            able = local[0][layout.cells(w, 0) & mask]
            for row in range(1, DEPTH):
                able &= local[row][layout.cells(w, row) & mask]
            if able.any():
                at = np.flatnonzero(able)
                own, first = np.unique(w[at], return_index=True)
                self.by_doc[i] = (w, own)
                h0.append(own)
                h1.append(windows(words[:, 1], texts.window)[at[first]] >> np.uint64(32))
                doc.append(np.full(len(own), i, dtype=np.uint32))
        both = np.concatenate(h0) if h0 else np.zeros(0, np.uint64)
        more = (np.concatenate(h1) if h1 else both).astype("<u4")
        docs = (np.concatenate(doc) if doc else both).astype("<u4")
        order = np.argsort(both, kind="stable")  # documents stay in their order
        if np.any((both[order][1:] == both[order][:-1]) & (more[order][1:] != more[order][:-1])):
            order = np.lexsort((docs, more, both))
        h, m, d = both[order], more[order], docs[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])] if len(h) else np.zeros(0, bool)
        self.order, self.group = order, np.cumsum(first) - 1
        self.hash, self.more, self.doc = h[first], m[first], d[first]
        place = np.cumsum([i > 0 and x != texts.ids[i - 1] for i, x in enumerate(texts.ids)])  # equal ids share one
        self.after = place[d] > place[self.doc[self.group]]
        self.sizes = [(i, len(own)) for i, (_, own) in self.by_doc.items()]


def candidates(table: pa.Table, answers: pa.Table, layout: Layout, window: int) -> pa.Table:
    pid, texts, rows = table.column("pid")[0].as_py(), Texts(table, window), []
    found = Candidates(texts, answers.to_pylist(), layout)
    ids = np.array([x or 0 for x in texts.ids], dtype="<i8")
    known = np.array([x is not None for x in texts.ids])
    for bucket, a, b in _cut(found.hash, 64 - layout.block_bits) if layout.block_bits else [(0, 0, len(found.hash))] * bool(len(found.hash)):
        docs, index = np.unique(found.doc[a:b], return_inverse=True)
        rows.append({"bucket": bucket, "pid": pid, "hash": _zip(_deltas(found.hash[a:b])), "more": _zip(found.more[a:b]), "doc": _zip(index.astype("<u4")),
                     "ids": _zip(ids[docs]), "known": np.packbits(known[docs]).tobytes()})
    return pa.Table.from_pylist(rows, CANDIDATE)


def exact(table: pa.Table) -> pa.Table:
    """Groups the windows of a bucket; a bit for each: another partition has a smaller
    document."""
    rows, parts = table.select(["pid", "bucket"]).to_pylist(), []
    for x in table.select(["hash", "more", "doc", "ids", "known"]).to_pylist():
        ids, doc = _unzip(x["ids"], "<i8"), _unzip(x["doc"], "<u4")
        known = np.unpackbits(np.frombuffer(x["known"], np.uint8), count=len(ids))
        parts.append((np.cumsum(_unzip(x["hash"], "<u8")), _unzip(x["more"], "<u4"), known[doc], ids[doc]))
    hashes, more, known, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((docs, known, more, hashes))
    h, m, k, d = hashes[order], more[order], known[order], docs[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])]
    least = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = np.zeros(len(d), bool)
    later[order] = (k > k[least]) | (d > d[least]) & (k == k[least])
    out, at = [], 0
    for x, (part, *_) in zip(rows, parts, strict=True):
        out.append({"pid": x["pid"], "row": DEPTH, "block": x["bucket"], "bits": np.packbits(later[at : at + len(part)]).tobytes()})
        at += len(part)
    return pa.Table.from_pylist(out, ANSWER)


# ---- pass 3: texts without those windows ------------------------------------------------


def rewritten(table: pa.Table, answers: pa.Table, layout: Layout, window: int, schema: pa.Schema) -> pa.Table:
    texts, told = Texts(table, window), answers.to_pylist()
    found = Candidates(texts, [x for x in told if x["row"] < DEPTH], layout)
    bits = {x["block"]: x["bits"] for x in told if x["row"] == DEPTH}
    cuts = _cut(found.hash, 64 - layout.block_bits) if layout.block_bits else [(0, 0, len(found.hash))] * bool(len(found.hash))
    flags = [np.unpackbits(np.frombuffer(bits[k], np.uint8), count=b - a) for k, a, b in cuts]
    gone = np.zeros(len(found.order), bool)
    if flags:
        gone[found.order] = found.after | np.concatenate(flags).astype(bool)[found.group]
    removed, at = {}, 0
    for i, n in found.sizes:
        w, own = found.by_doc[i]
        flag = gone[at : at + n]
        at += n
        if flag.any():
            place = np.minimum(np.searchsorted(own, w), n - 1)
            removed[i] = np.flatnonzero(flag[place] & (own[place] == w))
    cols: dict[str, list] = {f.name: [] for f in schema}
    for i, t in enumerate(texts.texts):
        words = t.split()
        kept = words
        if i in removed:
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, removed[i], 1)
            np.add.at(edge, removed[i] + window, -1)
            kept = [x for x, c in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
        body = b" ".join(kept)
        row = {"id": texts.ids[i], "n_words": len(words), "n_removed": len(words) - len(kept)}
        for name in cols:
            cols[name].append(row[name] if name in row else hashlib.sha256(body).hexdigest() if name == "kept_sha256" else body.decode())
    return pa.Table.from_pydict(cols, schema)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, digest: bool = False) -> DataFrame:
    """A row per row of ``docs``: the id, n_words, n_removed, and the kept words joined by
    one space (``kept``), or with ``digest`` their SHA-256 (``kept_sha256``)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout, n_parts = Layout(total // 6, parallel), max(total // PART_BYTES + 1, 2 * parallel)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = named.withColumn("pid", F.pmod(F.xxhash64("id", "text"), F.lit(n_parts)))
    last = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256" if digest else "kept", pa.string())])

    def ddl(schema: pa.Schema) -> str:
        kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
        return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)

    sketches = texts.groupBy("pid").applyInArrow(lambda t: sketch(t, layout, window), ddl(SKETCH))
    repeated = sketches.groupBy("row", "block").applyInArrow(lambda t: merge(t, layout), ddl(ANSWER))
    able = texts.groupBy("pid").cogroup(repeated.groupBy("pid")).applyInArrow(lambda t, a: candidates(t, a, layout, window), ddl(CANDIDATE))
    later = able.groupBy("bucket").applyInArrow(exact, ddl(ANSWER))
    answers = repeated.unionByName(later)
    out = texts.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(lambda t, a: rewritten(t, a, layout, window, last), ddl(last))
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
k AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS words FROM x),
f AS (SELECT words, min(doc_id) AS least FROM k GROUP BY words),
g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM k JOIN f USING (words) WHERE least < doc_id),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
n AS (SELECT r, (count(*) FILTER (WHERE g.i IS NOT NULL))::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.i IS NULL) AS kept
      FROM p LEFT JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r)
"""
