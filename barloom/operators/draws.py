"""Hashed draws of the Monte Carlo test: what each run draws, fetched and chained a few million at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Draws that a task holds at most and, where there are so many, at least; blocks in a row of the packed table.
HELD, LEAST, SLICE = 1 << 23, 1 << 16, 1024
# Bits for the place of a draw among those held.
BITS = 24
PARTS = ("total", "top", "fall", "drop")


# The constants and rotations of MD5 (RFC 1321), and the values it starts from.
SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
TURNS = [((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4] for i in range(64)]
LEFT, RIGHT = [np.uint32(t) for t in TURNS], [np.uint32(32 - t) for t in TURNS]
START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def md5_60(head: bytes, first: int, n: int) -> np.ndarray:
    """`sqlmath.hash60` of head followed by each of the numbers first .. first + n - 1, for arrays of them."""
    out, done = np.empty(n, np.int64), 0
    while done < n:
        digits = len(str(first + done))
        m = min(n - done, 10**digits - first - done, 16384)
        out[done : done + m] = _md5_same(head, np.arange(first + done, first + done + m), digits)
        done += m
    return out


def _md5_same(head: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    size, n = len(head) + digits, len(numbers)
    if size > 55:  # more than one block
        from hashlib import md5

        joined = b"".join([md5(b"%s%d" % (head, i)).digest() for i in numbers.tolist()])
        return (np.frombuffer(joined, ">u8")[::2] >> np.uint64(4)).astype(np.int64)
    constant = head + bytes(digits) + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
    words = list(np.frombuffer(constant, "<u4"))
    for at in range(size - 1, len(head) - 1, -1):
        digit = (numbers % 10 + 48).astype(np.uint32)
        words[at // 4] = words[at // 4] | (digit << np.uint32(8 * (at % 4)))
        numbers = numbers // 10
    a, b, c, d = [np.full(n, x) for x in START]
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            at = 7 * i % 16
        np.add(f, a, out=f)
        np.add(f, SINES[i], out=f)
        np.add(f, words[at], out=f)
        np.right_shift(f, RIGHT[i], out=g)
        np.left_shift(f, LEFT[i], out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    high = (a + START[0]).byteswap().astype(np.uint64) << np.uint64(32)
    return ((high | (b + START[1]).byteswap()) >> np.uint64(4)).astype(np.int64)


def chained(total: np.ndarray, top: np.ndarray, fall: np.ndarray, drop: np.ndarray) -> tuple[float, ...]:
    """`metrics.chain` over blocks in their order."""
    ends = np.cumsum(total)
    start = np.concatenate([[0.0], ends[:-1]])
    tops, lows = start + top, start + fall
    peaks = np.maximum.accumulate(np.concatenate([[0.0], tops[:-1]]))
    return ends[-1], tops.max(), np.fmin.reduce(lows), np.maximum(drop, peaks - lows).max()


def simple(total: np.ndarray) -> list[np.ndarray]:
    """Top, fall and drop of blocks of one trade."""
    return [np.maximum(total, 0.0), np.fmin(total, 0.0), np.maximum(-total, 0.0)]


class Held:
    """The draws of the stretches lo .. hi - 1 of a key, and their blocks as far as these have come by.

    Stretches are counted through all runs. Draws are sorted by their block, so each slice of blocks is laid
    out at once; the parts of blocks of one trade are made from the total where they are used.
    """

    def __init__(self, seed: int, mid: str, n: int, draws: int, stretch: int, lo: int, hi: int):
        self.parts = -(-draws // stretch)
        self.index = np.arange(lo, hi)
        first = self.index % self.parts * stretch
        self.ends = np.cumsum(np.minimum(stretch, draws - first))
        self.starts = np.concatenate([[0], self.ends[:-1]])
        many = int(self.ends[-1])
        self.keys = np.empty(many, np.int64)
        runs = self.index // self.parts + 1
        for i in np.flatnonzero(np.diff(runs, prepend=0)):
            last = np.searchsorted(runs, runs[i], "right") - 1
            at, until = self.starts[i], self.ends[last]
            self.keys[at:until] = md5_60(f"{seed}|{runs[i]}{mid}".encode(), int(first[i]), int(until - at))
        self.keys %= n
        self.keys <<= BITS
        self.keys |= np.arange(many)
        self.keys.sort()
        self.n, self.seen, self.unknown = n, 0, None
        self.values = {"total": np.zeros(many)}

    def fill(self, start: int, arrays: dict) -> None:
        """Lay out the blocks from number `start` on; only the total may hold nulls, other parts may be absent."""
        total = arrays["total"]
        at, until = np.searchsorted(self.keys, [start << BITS, (start + len(total)) << BITS])
        mine = self.keys[at:until]
        self.seen += len(total)
        here, mine = (mine >> BITS) - start, mine & ((1 << BITS) - 1)
        if total.null_count:
            if self.unknown is None:
                self.unknown = np.zeros(len(self.keys), bool)
            self.unknown[mine] = np.asarray(total.is_null())[here]
            total = total.fill_null(0.0)
        own = total.to_numpy(zero_copy_only=False)[here]
        if arrays["top"] is not None and len(self.values) == 1:
            self.values |= dict(zip(PARTS[1:], simple(self.values["total"]), strict=True))
        self.values["total"][mine] = own
        if len(self.values) > 1:
            plain = arrays["top"] is None
            more = simple(own) if plain else [arrays[p].to_numpy(zero_copy_only=False)[here] for p in PARTS[1:]]
            for part, value in zip(PARTS[1:], more, strict=True):
                self.values[part][mine] = value

    def summaries(self) -> dict:
        """run, part and summary of each stretch; the total is null where no block's is known."""
        import pyarrow as pa

        if self.seen != self.n:
            raise ValueError(f"{self.seen} of {self.n} blocks came by")
        rows = []
        for at, until in zip(self.starts, self.ends):
            total, *more = [v[at:until] for v in self.values.values()]
            rows.append(chained(total, *(more or simple(total))))
        none = None if self.unknown is None else np.logical_and.reduceat(self.unknown, self.starts)
        total, *more = np.array(rows).T
        runs, part = (self.index // self.parts + 1).astype(np.int32), self.index % self.parts
        return {"run": pa.array(runs), "_part": pa.array(part), "total": pa.array(total, mask=none)} | {
            p: pa.array(v) for p, v in zip(PARTS[1:], more, strict=True)
        }


def sliced(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """SLICE blocks a row as arrays, from number `_start` on; only the total where the rest follows from it."""
    t = F.coalesce("total", F.lit(0.0))
    plain = (
        (F.col("top") == F.greatest(t, F.lit(0.0))) & (F.col("fall") == F.least(t, F.lit(0.0)))
        & (F.col("drop") == F.greatest(-t, F.lit(0.0)))
    )
    rows = blocks.groupBy(*by, (F.floor(F.col("block_no") / SLICE) * SLICE).alias("_start")).agg(
        F.array_sort(F.collect_list(F.struct("block_no", *PARTS))).alias("_b"), F.every(plain).alias("_plain")
    )
    more = [F.when(~F.col("_plain"), F.col(f"_b.{p}")).alias(p) for p in PARTS[1:]]
    return rows.select(*by, "_start", F.col("_b.total").alias("total"), *more)


def stretches_of(slices: DataFrame, held: DataFrame, by: Sequence[str], seed: int, stretch: int, tasks: int) -> DataFrame:
    """The summary of every stretch: by, run, `_part`, total, top, fall, drop.

    held: by, `_n` blocks, `_draws` of a run, and stretches `_lo` .. `_hi` - 1 for a task to hold. A task reads the
    stored slices once and lets those of the key come by each of its rows of `held`, in any order; no copy of them is
    shuffled, so what is written grows with the blocks and not with blocks times draws.
    """
    mid = F.concat_ws("|", F.lit(""), *[F.col(c).cast("string") for c in by], F.lit("")).alias("_mid")
    turn = F.pmod(F.xxhash64(*by) + F.col("_turn"), F.lit(tasks)).cast("int")
    dealt = held.repartitionById(tasks, turn).hint("shuffle_replicate_nl")
    rows = dealt.join(slices.coalesce(1), list(by)).withColumn("_mid", mid)
    line = rows.select(*by, "_mid", "_n", "_draws", "_lo", "_hi", "_start", *PARTS)
    schema = T.StructType(
        [*[line.schema[c] for c in by], T.StructField("run", T.IntegerType()), T.StructField("_part", T.LongType())]
        + [T.StructField(p, T.DoubleType()) for p in PARTS]
    )

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done(own: list, held: Held):
            found = held.summaries()
            many = len(found["run"])
            keys = [a.take(pa.array(np.zeros(many, np.int64))) for a in own]
            return pa.RecordBatch.from_arrays([*keys, *found.values()], schema.names)

        what, own, held = None, [], None
        for batch in batches:
            names = ["_mid", "_n", "_draws", "_lo", "_hi", "_start", *by]
            for i, row in enumerate(zip(*[batch.column(c).to_pylist() for c in names], strict=True)):
                mid, n, draws, lo, hi, start, *key = row
                if (key, lo) != what:
                    if held is not None:
                        yield done(own, held)
                    what, held = (key, lo), None
                    # A copy, so that the batch can go.
                    own = [pa.array(batch.column(c).slice(i, 1).to_pylist(), batch.schema.field(c).type) for c in by]
                    held = Held(seed, mid, n, draws, stretch, lo, hi)
                held.fill(start, {p: batch.column(p)[i].values for p in PARTS})
        if held is not None:
            yield done(own, held)

    return line.mapInArrow(fold, schema)
