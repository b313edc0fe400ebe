"""Best-fit packing by exact-complement hashing.

Pieces of at most ``capacity`` tokens go into as few sequences of ``capacity`` tokens as
it can. The work is planned on the histogram of lengths, at most ``capacity`` numbers
whatever the input's size, and every step moves as many sequences as the counts allow:

1. For each length, longest first, the gap to the capacity is looked up in hashes of
   single lengths, of sums of two and of sums of three lengths that are still there.
   A combination that fills the gap exactly is used as often as its counts allow.
2. What has no exact complement is placed longest first, each into the least gap that
   holds it; a new sequence starts where none does.
3. Filling gaps with many short lengths can leave too few for the rest where there are
   few pieces; of the plans with complements up to three, two, one and none, the one with
   the fewest sequences counts.

The plan is a list of slots (length, first rank, count, first sequence, offset), bounded
by the capacity alone. A piece finds its slot by its rank among pieces of its length;
ranks come from hash buckets (the square root of a length's count), their running sums
and a window inside each bucket, so a length that very many pieces have is not sorted in
one task.

Defined cases: a null or empty text is one piece that holds the end id only; rows that
repeat an id are packed as pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stratus.llm import tokens
from stratus.llm.common import written

CAPACITY = 4096


# ---- the plan, on a histogram of lengths ------------------------------------------------


class Stock:
    """Counts by length, and which sums of two lengths can be had."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in counts.items():
            self.n[length] = count
        self.sums: np.ndarray | None = None

    def fits(self, combo: list[int]) -> int:
        """How often the combination can be taken."""
        return min(int(self.n[x]) // combo.count(x) for x in combo)

    def take(self, combo: list[int], times: int) -> None:
        for x in combo:
            self.n[x] -= times
        if not all(self.n[x] for x in combo):
            self.sums = None

    def pair_sums(self) -> np.ndarray:
        if self.sums is None:
            have = (self.n > 0).astype(np.float64)
            have[0] = 0
            size = 1 << (2 * len(have)).bit_length()
            wave = np.fft.rfft(have, size)
            self.sums = np.fft.irfft(wave * wave, size)[: len(have)] > 0.5
        return self.sums

    def single(self, gap: int, lead: list[int]) -> list[int] | None:
        return [gap] if self.fits([*lead, gap]) else None

    def pair(self, gap: int, lead: list[int]) -> list[int] | None:
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        for x in a[(self.n[a] > 0) & (self.n[gap - a] > 0)]:
            if self.fits([*lead, int(x), gap - int(x)]):
                return [int(x), gap - int(x)]
        return None

    def triple(self, gap: int, lead: list[int]) -> list[int] | None:
        a = np.arange(gap - 2, max(0, (gap - 1) // 3), -1)
        for x in a[(self.n[a] > 0) & self.pair_sums()[gap - a]]:
            if self.n[x] > lead.count(int(x)) and (rest := self.pair(gap - int(x), [*lead, int(x)])):
                return [int(x), *rest]
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, number of such sequences)] for a histogram of lengths: the
    shortest of the plans whose complements have at most three, two, one or no lengths."""
    return min((_planned(counts, capacity, most) for most in (3, 2, 1, 0)), key=lambda made: sum(t for _, t in made))


def _planned(counts: dict[int, int], capacity: int, most: int) -> list[tuple[list[int], int]]:
    stock, made = Stock(counts, capacity), []
    for length in range(capacity, 0, -1):
        gap = capacity - length
        for find in (stock.single, stock.pair, stock.triple)[:most] if gap else (lambda _gap, _lead: [],):
            while stock.n[length] and (more := find(gap, [length])) is not None:
                combo = [length, *more]
                times = stock.fits(combo)
                stock.take(combo, times)
                made.append((combo, times))
    open_by_gap: dict[int, list[tuple[list[int], int]]] = {}
    gaps = np.zeros(capacity + 1, dtype=bool)

    def put(combo: list[int], gap: int, times: int) -> None:
        if times:
            open_by_gap.setdefault(gap, []).append((combo, times))
            gaps[gap] = True

    for length in range(capacity, 0, -1):
        left = int(stock.n[length])
        while left:
            able = np.flatnonzero(gaps[length:])
            if len(able):
                gap = length + int(able[0])
                combo, there = open_by_gap[gap].pop()
                gaps[gap] = bool(open_by_gap[gap])
                used = min(left, there)
                put(combo, gap, there - used)
                put([*combo, length], gap - length, used)
                left -= used
            else:
                each = min(capacity // length, left)
                put([length] * each, capacity - each * length, left // each)
                left -= left // each * each
    return made + [x for group in open_by_gap.values() for x in group]


def slots(made: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset), by length and rank."""
    rows, rank, sequence = [], {}, 0
    for combo, times in made:
        at = 0
        for x in combo:
            rows.append((x, rank.get(x, 0), times, sequence, at))
            rank[x] = rank.get(x, 0) + times
            at += x
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# ---- Spark ------------------------------------------------------------------------------


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset appended. Lengths lie between 1
    and ``capacity``. Columns of other names pass unchanged."""
    spark, names = pieces.sparkSession, pieces.columns
    held = written(pieces.withColumn("__salt", F.xxhash64(*[F.col(f"`{c}`") for c in names])), "pack-pieces")
    counts = {r[0]: r[1] for r in held.groupBy(F.col(f"`{length_col}`").alias("length")).count().collect()}  # at most ``capacity`` rows
    table = slots(plan(counts, capacity))
    buckets = spark.createDataFrame([(int(k), int(np.ceil(np.sqrt(v)))) for k, v in counts.items()], "__length int, __buckets long")
    x = held.join(F.broadcast(buckets), F.col(f"`{length_col}`") == F.col("__length")).withColumn("__bucket", F.pmod("__salt", "__buckets"))
    first = Window.partitionBy("__length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy("__length", "__bucket").count().select(F.col("__length").alias("__l"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("count").over(first), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__length", "__bucket").orderBy("__salt", *[F.col(f"`{c}`") for c in names])
    ranked = x.withColumn("__in", F.row_number().over(inside) - 1).join(starts, (F.col("__length") == F.col("__l")) & (F.col("__bucket") == F.col("__b")))
    ranked = ranked.withColumn("__rank", F.col("__start") + F.col("__in"))
    shared = spark.sparkContext.broadcast(table)  # bounded by the capacity
    kept = [c for c in names if c not in ("sequence_id", "offset")]
    out = ranked.select(*[F.col(f"`{c}`") for c in kept], F.col("__length").cast("long"), F.col("__rank").cast("long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = (t[:, 0] << 48) + t[:, 1]
        for b in batches:
            length, rank = (b.column(len(kept) + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            found = t[at]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], names=[*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[: len(kept)])
    return out.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: the id, piece, start, length, ids_crc32, and with ``with_ids`` the
    ids themselves (little-endian unsigned 32-bit)."""
    path = vocabulary or tokens.default_vocabulary()
    end = np.array([tokens.END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for lo, hi in tokens.slices(texts):
                row, number, start, length, crc, body = [], [], [], [], [], []
                for i, ids in enumerate(encode(texts.slice(lo, hi - lo).to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row.append(i), number.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part)), body.append(part)
                cols = [keys.slice(lo, hi - lo).take(pa.array(row, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(body, pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token arrays of the sequences, from packed pieces that carry
    their ids. A sequence holds at most ``capacity`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
