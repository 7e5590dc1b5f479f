"""Hard negatives by threshold joins over an inverted index that leaves out what bounds cover.

All rows of at least a threshold are found for each anchor, and the threshold is lowered, for the
anchors that need it, until their windows are full. Rows lie in blocks, anchors in chunks; every
chunk visits every block once a round. Within a visit, partial scores are summed by dimension; a
row is listed under a dimension only while the norm of its remaining ones could still reach the
threshold, and pairs whose partial score and remaining norms cannot reach it are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import store

#: Rows of a block and anchors of a chunk: a visit's matrix of partial scores has 4 MB.
BLOCK, CHUNK = 1024, 512
#: Blocks are dealt to so many shards per core, and every shard gets a copy of the anchors.
SHARDS = 4
#: Dimensions are listed, and bounds taken, in groups of so many.
GROUP = 8
#: Thresholds of each round: shares of the anchor's squared norm for positives (None: all rows), of the
#: least score of a positive whose window is not full for negatives. The last ones leave nothing out.
POSITIVE_SHARES = (0.5, 0.35, 0.2, 0.0, None)
NEGATIVE_SHARES = (0.9, 0.75)
#: Larger vectors take no part: their scores may exceed a long.
MOST_NORM = float(1 << 31)


def scaled(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vec (floor(scale * x) of each component) of the rows that take part.

    Rows with a null label, a null vector, or any null or non-finite component are left out, and so
    are those whose scaled vector is of norm 2^31 or more. Rows that repeat with one id, label and
    vector are one; rows that share only the id stay apart. Copies melt before the shuffle.
    """
    double = F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), double.alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    rows = rows.withColumn("y", F.transform("x", lambda x: F.floor(x * scale).cast("double")))
    norm = F.aggregate("y", F.lit(0.0), lambda s, y: s + y * y)
    rows = rows.where(norm < MOST_NORM * MOST_NORM)
    return rows.select("vec_id", "label", F.col("y").cast("array<int>").alias("vec")).distinct()


BLOCKS = "block long, n int, dims int, ids binary, nulls binary, labels binary, sigs binary, vecs binary"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """The rows of each partition in blocks: int64 ids, null flags, labels and row hashes, int32 vectors.

    Vectors of fewer components than the longest of the block go on with zeros.
    """

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number, held, waiting = TaskContext.get().partitionId() << 32, [], 0

        def block(table):
            nonlocal number
            number += 1
            vec, ids = table["vec"].combine_chunks(), table["vec_id"].combine_chunks()
            sizes = np.diff(np.asarray(vec.offsets))
            dims = int(sizes.max())
            data = np.zeros((len(table), dims), "<i4")
            data[np.arange(dims) < sizes[:, None]] = np.asarray(vec.flatten())
            long = lambda a: np.asarray(a).astype("<i8").tobytes()
            columns = [
                [number], [len(table)], [dims], [long(ids.fill_null(0))], [np.asarray(ids.is_null()).astype(np.uint8).tobytes()],
                [long(table["label"])], [long(table["sig"])], [data.tobytes()],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        for batch in batches:
            held.append(batch)
            waiting += len(batch)
            while waiting >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size).combine_chunks())
                held = table.slice(size).to_batches()
                waiting -= size
        if waiting:
            yield block(pa.Table.from_batches(held).combine_chunks())

    names = [c.split()[0] for c in BLOCKS.split(", ")]
    sig = F.xxhash64("vec_id", "label", "vec").alias("sig")
    return rows.select("vec_id", "label", "vec", sig).mapInArrow(pack, BLOCKS)


def reached(x, y, least):
    """(anchor, row, score) of all pairs of the vectors x and y with a score of least[anchor] or more.

    `least` may be -inf. Sums are exact: doubles while no score can leave their integers, else longs.
    """
    import numpy as np

    dims = max(x.shape[1], y.shape[1])
    x, y = (np.pad(v, ((0, 0), (0, dims - v.shape[1]))).astype(np.float64) for v in (x, y))
    order = np.argsort(-(y * y).sum(0), kind="stable")  # dimensions of much weight first, so that norms fall fast
    x, y = x[:, order], y[:, order]

    def rest_norms(v):
        tail = np.sqrt(np.cumsum((v * v)[:, ::-1], 1))[:, ::-1]
        return np.concatenate([tail, np.zeros((len(v), 1))], 1) * (1 + 1e-9)

    xn, yn = rest_norms(x), rest_norms(y)
    kind = np.float64 if xn.max(initial=0) * yn.max(initial=0) < 1 << 52 else np.int64
    x, y = x.astype(kind), y.astype(kind)
    edges = [*range(0, dims, GROUP), dims]
    # A row is listed under the groups before `cut`: the dimensions from there on reach no threshold by themselves.
    cut = np.full(len(y), len(edges) - 1)
    if (least > 0).all():
        for g in range(len(edges) - 2, -1, -1):
            with np.errstate(divide="ignore"):
                bound = (least / xn[:, edges[g]]).min(initial=np.inf)
            cut[yn[:, edges[g]] < bound] = g
    by_cut = np.argsort(-cut, kind="stable")
    y, yn, cut = y[by_cut], yn[by_cut], cut[by_cut]
    score = np.zeros((len(x), len(y)), kind)
    for g in range(len(edges) - 1):
        n = np.searchsorted(-cut, -g, "left")  # rows with a cut above g come first
        score[:, :n] += x[:, edges[g] : edges[g + 1]] @ y[:n, edges[g] : edges[g + 1]].T
    at = np.array(edges)[cut]
    a, r = np.nonzero(score + xn[:, at] * yn[np.arange(len(y)), at] >= least[:, None])
    total = score[a, r]
    for first in range(0, len(a), 1 << 15):  # what was not listed, for the pairs that are left
        s = slice(first, first + (1 << 15))
        listed = np.arange(dims) < at[r[s]][:, None]
        total[s] += np.where(listed, 0, x[a[s]] * y[r[s]]).sum(1)
    near = total >= least[a]
    return a[near], by_cut[r[near]], total[near].astype(np.int64)


def first_of(keys, score, nulls, ids, sigs, most: int):
    """Places of the `most` first entries of each key: higher scores, then smaller ids, null ids last."""
    import numpy as np

    order = np.lexsort((sigs, ids, nulls, -score, keys))
    k = keys[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    rank = np.arange(len(k)) - np.repeat(start, np.diff(np.r_[start, len(k)]))
    return order[rank < most]


def search(table: DataFrame, anchors: DataFrame, share_of: DataFrame, windows: bool, most: int) -> DataFrame:
    """anchor, slot, vec_id, sig, score: what of each block can be among the `most` first of a slot.

    share_of: anchor, least (threshold, null: none) and, for windows, slots: an array of (slot, low, high).
    Without windows, the rows of the anchor's label other than itself are asked for (slot 0); with them, the
    rows of other labels whose score lies within each slot's bounds.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    shards = max(1, min(table.count(), SHARDS * cores))
    wanted = share_of.join(anchors, "anchor")
    slots = F.col("slots") if windows else F.lit(None).cast("array<struct<slot:int,low:long,high:long>>")
    wanted = wanted.select("anchor", "vec_id", "label", "sig", "vec", "least", slots.alias("slots"))
    chunk = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-share_of.count() // CHUNK)))).alias("chunk")
    asked = wanted.withColumn("a", F.struct(*wanted.columns)).groupBy(chunk).agg(F.collect_list("a").alias("asked"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    placed = table.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))

    def visit(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                n, dims = row["n"].as_py(), row["dims"].as_py()
                ids, labels, sigs = (np.frombuffer(row[c].as_py(), "<i8") for c in ("ids", "labels", "sigs"))
                nulls = np.frombuffer(row["nulls"].as_py(), np.uint8)
                y = np.frombuffer(row["vecs"].as_py(), "<i4").reshape(n, dims)
                for at in range(0, len(row["asked"]), CHUNK):
                    asked = row["asked"].values.slice(at, CHUNK)
                    vecs, least = asked.field("vec"), asked.field("least").to_pylist()
                    vecs = vecs.to_pylist()
                    x = np.zeros((len(vecs), max(map(len, vecs))), "<i4")
                    for i, v in enumerate(vecs):
                        x[i, : len(v)] = v
                    least = np.array([-np.inf if t is None else t * (1 - 1e-9) for t in least])
                    a, r, score = reached(x, y, least)
                    same = np.asarray(asked.field("label"))[a] == labels[r]
                    slot = np.zeros(len(a), np.int64)
                    if windows:
                        a, r, score = a[~same], r[~same], score[~same]
                        lists = asked.field("slots").to_pylist()
                        width = max(map(len, lists))
                        low, high = np.full((2, len(lists), width), np.iinfo(np.int64).max)
                        high[:] = -1
                        name = np.zeros((len(lists), width), np.int64)
                        for i, found in enumerate(lists):
                            for j, s in enumerate(found):
                                name[i, j], low[i, j], high[i, j] = s["slot"], s["low"], s["high"]
                        inside = (low[a] <= score[:, None]) & (score[:, None] <= high[a])
                        pair, j = np.nonzero(inside)
                        slot, a, r, score = name[a[pair], j], a[pair], r[pair], score[pair]
                    else:
                        itself = np.asarray(asked.field("sig"))[a] == sigs[r]
                        other = same & ~itself
                        a, r, score, slot = a[other], r[other], score[other], slot[other]
                    best = first_of(a * (slot.max(initial=0) + 1) + slot, score, nulls[r], ids[r], sigs[r], most)
                    a, r, score, slot = a[best], r[best], score[best], slot[best]
                    columns = [
                        pa.array(np.asarray(asked.field("anchor"))[a], pa.int64()), pa.array(slot.astype(np.int32)),
                        pa.array(ids[r], pa.int64(), mask=nulls[r].astype(bool)), pa.array(sigs[r], pa.int64()), pa.array(score, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "slot", "vec_id", "sig", "score"])

    # The work is in the visits, not in the bytes: dealt out by number, which is left as it is at run time.
    asked = asked.select("shard", "asked").repartition(shards, "shard")
    met = asked.join(placed.drop("block").repartition(shards, "shard"), "shard").drop("shard")
    found = met.mapInArrow(visit, "anchor long, slot int, vec_id long, sig long, score long")
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "sig")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def top_positives(table: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """anchor, rank, vec_id, sig, score: the `most` best other rows of each anchor's label."""
    left, parts = anchors.select("anchor", "square"), []
    for share in POSITIVE_SHARES:
        least = F.lit(None).cast("double") if share is None else F.col("square") * share
        asked = left.select("anchor", least.alias("least"))
        found = store(search(table, anchors, asked, False, most), "negatives-positives")
        full = found.groupBy("anchor").count().where(F.col("count") >= most).select("anchor")
        if share is None:
            parts.append(found)
            break
        parts.append(found.join(full, "anchor", "left_semi"))
        left = store(left.join(full, "anchor", "left_anti"), "negatives-left")
        if left.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows of `scaled`.

    For each anchor and each of its `positives` first other rows of the same label, the `negatives` first rows
    of other labels whose score is `low` to `high` percent of the positive's. Higher scores come first, ties by
    smaller vec_id, null ids last. Vectors of unlike length are compared as if the shorter went on with zeros;
    empty vectors score 0. A positive of a negative score has no window. Anchors without positives, and positives
    without negatives, give no row; no rows at all give none.
    """
    rows = store(rows, "negatives-rows")
    table = store(blocks(rows, BLOCK), "negatives-blocks")
    sig = F.xxhash64("vec_id", "label", "vec").alias("sig")
    square = F.aggregate("vec", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")).alias("square")
    anchors = rows.where(is_anchor).select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "vec", sig, square)
    anchors = store(anchors, "negatives-anchors")
    best = store(top_positives(table, anchors, positives), "negatives-best")

    # Bounds in whole numbers, without a product that could leave a long.
    share = "score div 100 * {0} + {1}((score % 100) * {0} / 100)"
    bounds = [F.expr(share.format(p, f)).cast("long").alias(n) for p, f, n in ((low, "ceil", "low"), (high, "floor", "high"))]
    slot = F.struct(F.col("rank").alias("slot"), *bounds)
    left, parts = best.where("score >= 0").select("anchor", "score", "rank", slot.alias("slot")), []
    for share in (*NEGATIVE_SHARES, low / 100):
        asked = left.groupBy("anchor").agg((F.min("score") * F.lit(share)).alias("least"), F.collect_list("slot").alias("slots"))
        found = store(search(table, anchors, asked, True, negatives), "negatives-found")
        if share == low / 100:
            parts.append(found)
            break
        full = found.groupBy("anchor", F.col("slot").alias("rank")).count().where(F.col("count") >= negatives).select("anchor", "rank")
        parts.append(found.join(full.withColumnRenamed("rank", "slot"), ["anchor", "slot"], "left_semi"))
        left = store(left.join(full, ["anchor", "rank"], "left_anti"), "negatives-unfilled")
        if left.isEmpty():
            break
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.select("anchor", F.col("slot").alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = best.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return found.join(known, ["anchor", "place"]).join(named, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"
    )
