"""Source divergence audit: a recount of the frequent terms through minimal perfect hashes.

Which words does a source use more than its language does, and how far apart are two
sources? Terms are runs of letters (``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased).

Pass 1 counts documents by (lang, term), exactly: tasks send partial counts, summed where
the terms meet. Terms in at least ``min_docs`` documents of their language are kept and
cut by hash into shards of about ``SHARD`` terms; each shard gets a minimal perfect hash
(levels of bit arrays: a key lives at the first level where no other key falls on its
bit, its slot is the number of bits before it) and its keys in the order of their slots.

Pass 2 reads the texts again. A task looks every distinct word up: hash, slot, and then
the key that is stored there, so that a word outside the kept terms is never counted. The
counts go to dense slots by (lang, source) group and shard. The shards are broadcast, in
as many rounds as keep a round's bytes under ``ROUND_BYTES``, each round a scan of the
texts; slots are sent on when a task holds ``HELD_SLOTS`` of them. A group's slots are
added in a sorted stream, one accumulator at a time, so a source with a third of all
documents is no more than its share of rows from each task.

From the slots, all in integers:

    p = 1 + floor(10^9 (count + 5) / (N + 5 V))

with N the group's count over its language's V kept terms. Distances of sources are summed
by shard and by blocks of ``BLOCK`` x ``BLOCK`` sources; the terms of a group stream past
their language's slots, which leave a task's best ``top`` of them.

Defined cases: null text, lang and source are ''; every row is a document, also one that
repeats an id; groups without terms have N = 0; a language without kept terms has pairs of
value 0 and no terms; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratus.llm import tokens
from stratus.llm.common import written

MIN_DOCS, TOP = 30, 50
UNIT, ADDED = 1_000_000_000, 5
#: Terms in a shard (mean), bytes of shards broadcast at once, sources in a block.
SHARD, ROUND_BYTES, BLOCK = 1024, 48 << 20, 64
#: Places where a language's terms meet its number of shards.
SALTS = 256
#: Distinct terms and slots that a task holds before it sends them on; remembered words.
HELD_TERMS, HELD_SLOTS, HELD_WORDS = 300_000, 8_000_000, 400_000
#: Letters (A-Z lower-cased) and bytes of other than ASCII characters; all else is a blank.
LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: What bytes.split() takes for blanks are all blanks in LETTERS.


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


# ---- minimal perfect hash ---------------------------------------------------------------


def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), np.uint64, len(keys))


def _places(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """Another 64-bit mix for each level, folded to 0..size-1."""
    x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0..n-1 of n distinct keys, which are stored in slot order."""

    def __init__(self, seed: int, levels: list[np.ndarray], keys: list[bytes]):
        self.seed, self.levels, self.keys = seed, levels, keys
        self.before = np.concatenate([[0], np.cumsum([x.sum() for x in levels])]).astype(np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(x[:-1])]).astype(np.int64) for x in levels]

    @classmethod
    def of(cls, keys: list[bytes]) -> "PerfectHash":
        seed = 0
        while len(np.unique(h := _hashes(keys, seed))) < len(keys):
            seed += 1  # two keys of one hash would never part
        levels, left = [], h
        while len(left):
            size = 2 * len(left)
            at = _places(left, len(levels), size)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            left = left[hits[at] > 1]
        made = cls(seed, levels, [])
        slots = made._slots(h)
        order = np.empty(len(keys), np.int64)
        order[slots] = np.arange(len(keys))
        made.keys = [keys[i] for i in order]
        return made

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where no level has its bit."""
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, bits in enumerate(self.levels):
            at = _places(h[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.before[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out

    def find(self, words: list[bytes]) -> list[int]:
        """Slot of each word, -1 for words that are no key."""
        found = self._slots(_hashes(words, self.seed)).tolist()
        return [s if s >= 0 and self.keys[s] == w else -1 for s, w in zip(found, words, strict=True)]

    def pack(self) -> dict:
        return {"seed": self.seed, "n": len(self.keys), "sizes": [len(x) for x in self.levels], "bits": b"".join(np.packbits(x).tobytes() for x in self.levels), "keys": b" ".join(self.keys)}

    @classmethod
    def unpack(cls, row) -> "PerfectHash":
        levels, at = [], 0
        for size in row["sizes"]:
            n = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(row["bits"], np.uint8, n, at), count=size).astype(bool))
            at += n
        return cls(row["seed"], levels, bytes(row["keys"]).split(b" ") if row["n"] else [])


# ---- pass 1: terms that are frequent enough ------------------------------------------------


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def frequent_terms(texts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n_docs) of the terms found in at least ``min_docs`` documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                keys = list(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([k.decode() for k in keys], pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "term", "n"])
            held.clear()

        for b in batches:
            for lo, hi in tokens.slices(b.column(1)):
                lang, text = (b.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 1))
                for of, t in zip(lang, text, strict=True):
                    held.setdefault(of, Counter()).update(set(terms(t)))
                if sum(map(len, held.values())) > HELD_TERMS:
                    yield from sent()
        yield from sent()

    parts = texts.select("lang", "text").mapInArrow(count, "lang string, term string, n long")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def shards(kept: DataFrame) -> DataFrame:
    """(lang, shard, n_shards of the language, and a packed perfect hash) of the kept terms."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("n_shards"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # a language's terms meet its number of shards in SALTS places
    x = kept.withColumn("salt", F.pmod(F.xxhash64("term", F.lit("salt")), F.lit(SALTS))).join(sizes, ["lang", "salt"])
    x = x.select("lang", "term", F.pmod(F.xxhash64("term", F.lit("shard")), F.col("n_shards")).alias("shard"), "n_shards")

    def build(group: pa.Table) -> pa.Table:
        made = PerfectHash.of([t.encode() for t in group.column("term").to_pylist()]).pack()
        return pa.Table.from_pylist([{"lang": group.column("lang")[0].as_py(), "shard": group.column("shard")[0].as_py(), "n_shards": group.column("n_shards")[0].as_py(), **made}], _SHARD)

    return x.groupBy("lang", "shard").applyInArrow(build, "lang string, shard long, n_shards long, seed long, n long, sizes array<long>, bits binary, keys binary")


_SHARD = pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("n_shards", pa.int64()), ("seed", pa.int64()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("keys", pa.binary())])


# ---- pass 2: dense counts -----------------------------------------------------------------


class _Slots:
    """A task's words and dense counts for the shards of one round. The shards of a language
    lie one after the other; a word's number is its place in them."""

    def __init__(self, packed: list):
        self.shards: dict[str, dict[int, tuple[int, PerfectHash]]] = {}
        self.n_shards = {r["lang"]: r["n_shards"] for r in packed}
        self.slots = dict.fromkeys(self.n_shards, 0)
        for r in packed:
            self.shards.setdefault(r["lang"], {})[r["shard"]] = (self.slots[r["lang"]], PerfectHash.unpack(r))
            self.slots[r["lang"]] += r["n"]
        self.words: dict[str, dict[bytes, int]] = {}
        self.counts: dict[tuple[str, str], np.ndarray] = {}
        self.held = 0

    def learn(self, lang: str, words: set[bytes]) -> dict[bytes, int]:
        """Remembers each word's number, -1 for words that aren't kept."""
        known = self.words.setdefault(lang, {})
        fresh = words - known.keys()
        if len(known) + len(fresh) > HELD_WORDS:
            known.clear()
            fresh = words
        by: dict[int, list[bytes]] = {}
        for w in fresh:
            by.setdefault(_shard_of(w, self.n_shards[lang]), []).append(w)
        for shard, some in by.items():
            if shard not in self.shards[lang]:  # another round counts it
                known.update(dict.fromkeys(some, -1))
                continue
            first, table = self.shards[lang][shard]
            known.update(zip(some, (first + x if x >= 0 else -1 for x in table.find(some)), strict=True))
        return known

    def add(self, lang: str, source: str, counted: Counter, known: dict[bytes, int]) -> None:
        at = np.fromiter(map(known.__getitem__, counted), np.int64, len(counted))
        much = np.fromiter(counted.values(), np.int64, len(counted))
        if (lang, source) not in self.counts:
            self.counts[lang, source] = np.zeros(self.slots[lang], np.int64)
            self.held += self.slots[lang]
        self.counts[lang, source][at[at >= 0]] += much[at >= 0]  # a word's slot is its own

    def sent(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), mine in self.counts.items():
            parts = {shard: mine[first : first + len(table.keys)] for shard, (first, table) in self.shards[lang].items()}
            parts = {shard: x.tobytes() for shard, x in parts.items() if x.any()}
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(parts), pa.int64()), pa.array(list(parts.values()), pa.binary())], names=["lang", "source", "shard", "counts"])
        self.counts.clear()
        self.held = 0


def _shard_of(word: bytes, n: int) -> int:
    """What Spark's pmod(xxhash64(term, 'shard'), n) is: XXH64 with the seed 42, whose result
    is the seed for the mark."""
    h = xxhash.xxh64_intdigest(b"shard", xxhash.xxh64_intdigest(word, 42))
    return (h - (1 << 64) if h >= 1 << 63 else h) % n


def recount(texts: DataFrame, tables: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(lang, source, shard, counts): a packed long for each slot, for the groups and shards
    that have any count; each once."""
    spark = texts.sparkSession
    size = F.sum(F.octet_length("keys") + F.octet_length("bits") + 200)
    rounds, mark = 1, F.xxhash64("lang", "shard", F.lit("round"))
    while (tables.groupBy(F.pmod(mark, F.lit(rounds))).agg(size.alias("b")).agg(F.max("b")).first()[0] or 0) > round_bytes:
        rounds *= 2  # a shard is small, so it ends
    parts = None
    for r in range(rounds):
        mine = tables.filter(F.pmod(mark, F.lit(rounds)) == r).collect()  # at most round_bytes
        shared = spark.sparkContext.broadcast([row.asDict() for row in mine])

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            state = _Slots(shared.value)
            for b in batches:
                for lo, hi in tokens.slices(b.column(2)):
                    counted: dict[tuple[str, str], Counter] = {}
                    for lang, source, t in zip(*(b.column(i).slice(lo, hi - lo).to_pylist() for i in range(3)), strict=True):
                        if lang in state.n_shards:
                            counted.setdefault((lang, source), Counter()).update(terms(t))
                    for lang in {k[0] for k in counted}:
                        known = state.learn(lang, set().union(*[c.keys() for k, c in counted.items() if k[0] == lang]))
                        for (of, source), c in counted.items():
                            if of == lang:
                                state.add(lang, source, c, known)
                                if state.held > HELD_SLOTS:
                                    yield from state.sent()
            yield from state.sent()

        some = texts.mapInArrow(count, "lang string, source string, shard long, counts binary")
        parts = some if parts is None else parts.unionByName(some)
    return _summed(parts, ["lang", "source", "shard"])


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The packed counts added by key, in a sorted stream that holds one sum."""
    n = len(keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        rows: list[tuple] = []

        def sent() -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(columns[i], f.type) for i, f in enumerate(fields)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[n], pa.binary())], names=[*keys, "counts"])

        for b in batches:
            fields = [b.schema.field(i) for i in range(n)]
            for *k, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k == key:
                    total += np.frombuffer(packed, np.int64)
                    continue
                if key is not None:
                    rows.append((*key, total.tobytes()))
                key, total = k, np.frombuffer(packed, np.int64).copy()
                if len(rows) >= 256:
                    yield sent()
                    rows = []
        if key is not None:
            rows.append((*key, total.tobytes()))
            yield sent()

    x = parts.select(*keys, "counts").repartition(*keys).sortWithinPartitions(*keys)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields)
    return x.mapInArrow(add, types)


# ---- distances ----------------------------------------------------------------------------


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(UNIT (count + ADDED) / (n + ADDED v)) in integers: long division by three
    decimals at a time, so nothing overflows below 9 * 10^15 words."""
    by = n + ADDED * v
    left, out = counts + ADDED, np.zeros(len(counts), np.int64)
    out += left // by * UNIT
    left = left % by
    for scale in (1_000_000, 1000, 1):
        out += left * 1000 // by * scale
        left = left * 1000 % by
    return out + 1


def _pairs(frame: DataFrame) -> DataFrame:
    """(lang, a, b, value): distances of a's and b's shares, summed over the shards; both
    ways. ``frame`` has each group's counts in each shard of its language, with n, v and
    the group's place among its language's (at) and their number (groups)."""
    block = F.floor(F.col("at") / BLOCK)
    blocks = F.ceil(F.col("groups") / BLOCK)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct(F.least(o, block).alias("low"), F.greatest(o, block).alias("high")))
    x = frame.withColumn("m", F.explode(meets)).select("lang", "shard", F.col("m.low").alias("low"), F.col("m.high").alias("high"), "source", block.alias("block"), "counts", "n", "v")

    def compare(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        p = [shares(np.frombuffer(r["counts"], np.int64), r["n"], r["v"]) if r["v"] else np.zeros(0, np.int64) for r in rows]
        first = [i for i, r in enumerate(rows) if r["block"] == r["low"]]
        other = [i for i, r in enumerate(rows) if r["block"] == r["high"]]
        a, b, value = [], [], []
        for i in first:
            for j in other:
                if rows[i]["block"] != rows[j]["block"] or i < j:
                    d = int(np.abs(p[i] - p[j]).sum())
                    a += [rows[i]["source"], rows[j]["source"]]
                    b += [rows[j]["source"], rows[i]["source"]]
                    value += [d, d]
        return pa.table({"lang": pa.array([rows[0]["lang"]] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})

    parts = x.groupBy("lang", "shard", "low", "high").applyInArrow(compare, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _terms(frame: DataFrame, whole: DataFrame, tables: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): terms that a group has more of than its language, the
    ``top`` of each group and shard. Rows of a shard stream by: its keys, its language's
    counts, then each group's."""
    none = lambda kind: F.lit(None).cast(kind)
    keys = tables.select("lang", "shard", F.lit(0).alias("kind"), none("string").alias("source"), F.col("keys").alias("data"), none("long").alias("n"), none("long").alias("v"))
    langs = whole.select("lang", "shard", F.lit(1).alias("kind"), none("string").alias("source"), F.col("counts").alias("data"), "n", "v")
    own = frame.select("lang", "shard", F.lit(2).alias("kind"), "source", F.col("counts").alias("data"), "n", "v")
    x = keys.unionByName(langs).unionByName(own).repartition("lang", "shard").sortWithinPartitions("lang", "shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, q = [], None
        for b in batches:
            lang, source, item, value = [], [], [], []
            for r in b.to_pylist():
                if r["kind"] == 0:
                    words = bytes(r["data"]).split(b" ") if r["data"] else []
                elif r["kind"] == 1:
                    q = shares(np.frombuffer(r["data"], np.int64), r["n"], r["v"])
                else:
                    counts = np.frombuffer(r["data"], np.int64)
                    over = np.where(counts > 0, shares(counts, r["n"], r["v"]) - q, 0)
                    at = np.flatnonzero(over > 0)
                    if len(at) > top:  # all that tie with the last stay for the final ranking
                        at = at[over[at] >= np.partition(over[at], -top)[-top]]
                    lang += [r["lang"]] * len(at)
                    source += [r["source"]] * len(at)
                    item += [words[i].decode() for i in at]
                    value += over[at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])

    return x.mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the other sources of its
    language by distance ('pair'), and the terms that it has more of than its language
    ('term', the ``top`` first); ranks by value, then item."""
    texts = _texts(docs, text_col, lang_col, source_col)
    kept = written(frequent_terms(texts, min_docs), "frequent-terms")  # counted and placed from here
    tables = written(shards(kept), "term-shards")
    slots = written(recount(texts, tables, round_bytes), "term-slots")
    groups = texts.select("lang", "source").distinct()
    groups = groups.withColumns({"at": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, "groups": F.count(F.lit(1)).over(Window.partitionBy("lang"))})
    vocabulary = tables.groupBy("lang").agg(F.sum("n").alias("v"))
    counted = _with_sums(slots)
    totals = counted.groupBy("lang", "source").agg(F.sum("s").alias("n"))
    groups = groups.join(vocabulary, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "n"])
    # a language without kept terms has one empty shard
    sized = tables.select("lang", "shard", F.col("n").alias("slots"))
    frame = groups.join(sized, "lang", "left").na.fill(0, ["shard", "slots"]).join(slots, ["lang", "source", "shard"], "left")
    zeros = F.unhex(F.repeat(F.lit("00"), (8 * F.col("slots")).cast("int")))
    frame = written(frame.withColumn("counts", F.coalesce("counts", zeros)).drop("slots"), "term-frame")
    pair = _pairs(frame).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    whole = _summed(frame.filter("v > 0"), ["lang", "shard"])
    of_lang = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    term = _terms(frame.filter("v > 0"), whole.join(of_lang, "lang"), tables, top).withColumn("part", F.lit("term")).select("lang", "source", "part", "item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = lambda x: x.withColumn("rank", F.row_number().over(best))
    return rank(pair).unionByName(rank(term).filter(F.col("rank") <= top))


def _with_sums(slots: DataFrame) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [int(np.frombuffer(x, np.int64).sum()) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.int64())], names=["lang", "source", "s"])

    return slots.select("lang", "source", "counts").mapInArrow(add, "lang string, source string, s long")


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(k.term)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM g) l LEFT JOIN k ON l.lang = k.lang GROUP BY l.lang),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS nn FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (gn.nn + 5 * v.v) AS p
      FROM gn JOIN v ON gn.lang = v.lang JOIN k ON k.lang = gn.lang
      LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
ln AS (SELECT lang, sum(nn)::HUGEINT AS nn FROM gn GROUP BY lang),
lc AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term),
q AS (SELECT k.lang, k.term, 1 + (1000000000 * (lc.n + 5)) // (ln.nn + 5 * v.v) AS q
      FROM k JOIN lc ON k.lang = lc.lang AND k.term = lc.term JOIN ln ON ln.lang = k.lang JOIN v ON v.lang = k.lang),
s AS (SELECT a.lang, a.source AS a, b.source AS b, sum(abs(a.p - b.p)) AS f
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.f, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.a = a.source AND s.b = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, abs(p.p - q.q)::BIGINT
      FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 50
"""
