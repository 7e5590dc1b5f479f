"""Best-fit packing of tokenised documents by a configuration linear program."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import signed
from barloom.llm.tokens import worker_encoder
from barloom.session import store

CAPACITY, END = 4096, 1
#: Pricing rounds of the linear program, and lengths that a round chooses from.
ROUNDS, CHOICES = 1500, 192
#: How strongly a length loses weight as it is covered, and the share of it that a round uses.
EAGER, STEP = 0.25, 0.7
#: Up to so many lengths, a plan above the bound is also sought by the simplex method.
FEW = 400
#: Pieces of a length are numbered in so many parts.
PARTS = 256


def pieces(docs: DataFrame, spec: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, sig, piece, start, length, ids_crc32 (and ids, little-endian 32-bit, if asked for).

    The ids of a whole text and the end id; only what is longer than `capacity` is cut, into
    pieces of that many ids and a last one. Null and empty texts are the end id alone.
    """
    schema = T.StructType(
        [
            docs.schema["doc_id"], T.StructField("sig", T.LongType()), T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()), *[T.StructField("ids", T.BinaryType())] * with_ids,
        ]
    )

    def run(batches):
        import pyarrow as pa

        encoder, tail, width = worker_encoder(spec), np.array([end], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for row, ids in enumerate(encoder.encode(batch.column("text").to_pylist())):
                ids += tail
                for i, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((row, i, at // 4, len(part) // 4, zlib.crc32(part), part))
            origin, *columns = zip(*rows, strict=True) if rows else [()] * 6
            origin = pa.array(origin, pa.int32())
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            keys = [batch.column("doc_id").take(origin), batch.column("sig").take(origin)]
            yield pa.RecordBatch.from_arrays([*keys, *arrays], schema.names)

    return signed(docs).select("doc_id", "sig", "text").mapInArrow(run, schema)


def best_configuration(lengths: np.ndarray, values: np.ndarray, capacity: int) -> list[int]:
    """Knapsack by dynamic programming: which of the lengths, each once, are worth most together."""
    worth = np.zeros(capacity + 1)
    taken = np.zeros((len(lengths), capacity + 1), bool)
    for i, (size, value) in enumerate(zip(lengths.tolist(), values.tolist(), strict=True)):
        better = worth[: capacity + 1 - size] + value
        np.greater(better, worth[size:], out=taken[i, size:])
        np.maximum(better, worth[size:], out=worth[size:])
    chosen, room = [], capacity
    for i in range(len(lengths) - 1, -1, -1):
        if taken[i, room]:
            chosen.append(i)
            room -= int(lengths[i])
    return chosen


def best_copies(lengths: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack with up to `most` copies of a length, split into powers of two: copies of each length."""
    kinds, times = [], []
    for i, left in enumerate(np.minimum(most, capacity // lengths).astype(int).tolist()):
        power = 1
        while left > 0:
            kinds.append(i)
            times.append(min(power, left))
            left, power = left - power, power * 2
    kinds, times = np.array(kinds, int), np.array(times, int)
    chosen = best_configuration(lengths[kinds] * times, values[kinds] * times, capacity)
    return np.bincount(kinds[chosen], times[chosen], len(lengths)).astype(int)


def configurations(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, full: bool = True
) -> dict[tuple, float]:
    """Fractional solution of the configuration program: how often each configuration is used.

    A configuration is a sorted tuple of lengths that fit together. Multiplicative weights: a
    length starts with a weight in proportion to itself, the price of its volume, and loses
    weight exponentially in the share of its pieces that are covered. The rounds take turns with
    CHOICES lengths of all sizes; each finds the heaviest configuration of them, in as many copies
    as fit, and uses it for a part of what its scarcest length has left. With `full`, one with room
    left is not worth its price and best fit sees to those pieces; else the round's heaviest counts.
    """
    left, used = counts.astype(float), {}
    for turn in range(rounds):
        waiting = np.flatnonzero(left >= 1)
        if not len(waiting) or float(left @ lengths) < capacity:
            break
        stride = -(-len(waiting) // CHOICES)
        some = waiting[turn % stride :: stride]
        value = lengths[some] * np.exp(-EAGER * (1 - left[some] / counts[some]))
        taken = best_copies(lengths[some], value, left[some], capacity)
        kinds, copies = some[taken > 0], taken[taken > 0]
        if full and int(lengths[kinds] @ copies) < capacity:  # worth less than the sequence costs
            continue
        times = max(1.0, STEP * float((left[kinds] / copies).min()))
        times = min(times, float((left[kinds] / copies).min()))
        left[kinds] -= times * copies
        key = tuple(sorted(np.repeat(lengths[kinds], copies).tolist(), reverse=True))
        used[key] = used.get(key, 0.0) + times
    return used


def simplex(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> dict[tuple, float]:
    """The configuration program by column generation, for few lengths.

    Starts with configurations of one length each. A round prices the lengths by the program's
    dual values; the knapsack's best configuration enters if it is worth more than the one sequence
    it costs, with or without room left. None does: the solution is the program's least.
    """
    most = np.minimum(capacity // lengths, counts)
    basis, inverse, uses = np.diag(most).astype(float), np.diag(1.0 / most), counts / most
    for turn in range(rounds):
        prices = inverse.sum(0)
        entering = best_copies(lengths, np.maximum(prices, 0), np.where(prices > 1e-12, most, 0), capacity)
        if float(prices @ entering) <= 1 + 1e-9:
            break
        change = inverse @ entering
        ratio = np.where(change > 1e-9, uses / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = entering
        inverse = np.linalg.inv(basis)
        uses = np.maximum(inverse @ counts, 0)
    keys = [tuple(np.repeat(lengths, c).tolist()) for c in basis.T.round().astype(int)]
    return {k: float(n) + 1e-6 for k, n in zip(keys, uses, strict=True)}  # whole numbers stay whole


def best_fit(counts: dict[int, int], bins: list[tuple[tuple, int]], capacity: int) -> list[tuple[tuple, int]]:
    """Place the pieces left into bins with room, longest first, each where it fits best.

    bins: (lengths in it, how many such bins). Works on groups of like bins and like pieces, so
    the cost depends on the number of lengths, not of pieces.
    """
    by_room: dict[int, list[tuple[tuple, int]]] = {}
    for held, many in bins:
        by_room.setdefault(capacity - sum(held), []).append((held, many))
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            room = next((r for r in range(length, capacity) if by_room.get(r)), None)
            if room is None:
                held, many = (), (todo + capacity // length - 1) // (capacity // length)
                room = capacity
            else:
                held, many = by_room[room].pop()
            fits = room // length if held == () else 1
            used = min(many, max(todo // fits, 1))
            each = min(fits, todo)
            by_room.setdefault(room - each * length, []).append((held + (length,) * each, used))
            if many > used and held:
                by_room[room].append((held, many - used))
            todo -= used * each
    return [group for groups in by_room.values() for group in groups]


@dataclass
class Plan:
    """Where pieces go, by length and rank among the pieces of that length.

    Row i: pieces of lengths[i] ranked from first[i] up to the next row's first fill sequences
    from base[i] on, copies[i] pieces each, beginning at offset[i].
    """

    lengths: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Configurations for all pieces of a length histogram: linear program, rounding, best fit.

    The histogram has at most `capacity` lengths. Uses are rounded down; what is left over, and
    the room left in configurations, goes through best fit. Where that takes more than the bound
    (ids / capacity), configurations with room left are tried as well, and for few lengths the
    simplex method; the plan with the fewest sequences counts. The number of configurations is
    bounded by the rounds and the lengths, not by the pieces.
    """
    lengths = np.array(sorted((n for n in histogram if n < capacity), reverse=True), int)
    counts = np.array([histogram[n] for n in lengths.tolist()], int)

    def rounded(uses: dict[tuple, float]) -> list[tuple[tuple, int]]:
        rest, bins = dict(zip(lengths.tolist(), counts.tolist(), strict=True)), []
        for held, times in uses.items():
            times = min(int(times), *(rest[n] // held.count(n) for n in set(held)))
            if times:
                bins.append((held, times))
                for n in held:
                    rest[n] -= times
        return best_fit({n: c for n, c in rest.items() if c}, bins, capacity)

    def size(bins: list[tuple[tuple, int]]) -> int:
        return sum(many for _, many in bins)

    bins = rounded(configurations(lengths, counts, capacity, rounds))
    bound = -(-int(lengths @ counts) // capacity)
    if size(bins) > bound:
        bins = min(bins, rounded(configurations(lengths, counts, capacity, rounds, full=False)), key=size)
    if size(bins) > bound and len(lengths) <= FEW:
        bins = min(bins, rounded(simplex(lengths, counts, capacity, rounds)), key=size)
    if histogram.get(capacity):
        bins.append(((capacity,), histogram[capacity]))

    rows, base, ranked = [], 0, dict.fromkeys(histogram, 0)
    for held, many in sorted(bins, reverse=True):
        at = 0
        for n in sorted(set(held), reverse=True):
            copies = held.count(n)
            rows.append((n, ranked[n], copies, base, at))
            ranked[n] += many * copies
            at += n * copies
        base += many
    if ranked != histogram:
        raise ValueError("the plan does not cover the pieces")
    rows.sort()
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] or [np.zeros(0, np.int64)] * 5
    return Plan(*columns, sequences=base)


def ranked(found: DataFrame) -> DataFrame:
    """found with rank, from 0 within each length.

    A length may hold most pieces, so it is numbered in PARTS parts by hash; the parts' sizes,
    at most one per length and part, are summed up before them.
    """
    split = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "sig", "piece"), F.lit(PARTS)).cast("int"))
    sizes = split.groupBy("length", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "sig", "piece")
    numbered = split.withColumn("place", F.row_number().over(inside))
    return numbered.join(store(sizes, "packing-parts"), ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("place") - 1
    )


def placed(found: DataFrame, plan: Plan) -> DataFrame:
    """The ranked pieces with sequence_id and offset."""
    drop = ("part", "before", "place", "rank")
    keep = [f for f in found.schema if f.name not in drop]
    schema = T.StructType([*keep, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        import pyarrow as pa

        reach = int(plan.first.max(initial=0)) + 1
        keys = plan.lengths * reach + plan.first  # rows are sorted by length and first
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            row = np.searchsorted(keys, length * reach + np.minimum(rank, reach - 1), "right") - 1
            inside = rank - plan.first[row]
            sequence = plan.base[row] + inside // plan.copies[row]
            offset = plan.offset[row] + inside % plan.copies[row] * length
            columns = [batch.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], schema.names)

    return found.mapInArrow(run, schema)


def pack(docs: DataFrame, spec: str, capacity: int = CAPACITY, end: int = END, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece.

    Pieces fill sequences of at most `capacity` ids, gapless from 0. Only the length histogram,
    at most `capacity` rows, reaches the driver, and only the plan, whose size has nothing to do
    with the number of pieces, reaches the tasks. Repeated rows are packed once each; an empty
    table gives no sequence.
    """
    found = store(pieces(docs, spec, capacity, end), "packing-pieces")
    rows = found.groupBy("length").count().collect()
    plan = plan_packing({r["length"]: r["count"] for r in rows}, capacity, rounds)
    return placed(ranked(found), plan).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
