"""SimHash near-duplicates: pivot distance tables, verified pairs, connected components."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import hex_of, lean, whole_text
from barloom.session import store

SHINGLE, SEED, RADIUS = 3, 42, 2
PIVOTS = 16
#: Bit blocks of a fingerprint. RADIUS differing bits leave all but RADIUS blocks alike.
BLOCKS = 5
#: Cells of more fingerprints are linked through midpoints instead of pairs.
PAIR_CELL = 64
#: Edges for a task, where more than its cores' share.
TASK_EDGES = 1 << 17


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; no words: zero. Unsigned."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and fp, the 64-bit fingerprint as a signed long."""

    def stamp(batches):
        import pyarrow as pa

        for batch in batches:
            prints = [fingerprint(t) for t in batch.column("text").to_pylist()]
            signed = pa.array([p - (p >> 63 << 64) for p in prints], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], signed], [*key, "fp"])

    texts = lean(docs, *key, "text").select(*key, whole_text().alias("text"))
    schema = T.StructType([*[texts.schema[k] for k in key], T.StructField("fp", T.LongType())])
    return texts.mapInArrow(stamp, schema)


def pivot_table(prints: DataFrame) -> DataFrame:
    """Each fingerprint with its Hamming distances to the reference fingerprints."""
    return prints.select("fp", pivot_distances("fp").alias("pivots"))


def pivot_distances(fp: str) -> Column:
    pivots = [F.xxhash64(F.lit(i)) for i in range(PIVOTS)]
    return F.array(*[F.bit_count(F.col(fp).bitwiseXOR(p)).cast("byte") for p in pivots])


def masks() -> list[int]:
    """For every choice of BLOCKS - RADIUS blocks, the bits in them."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(block, BLOCKS - RADIUS)]


def signed_bits(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def cells(table: DataFrame) -> DataFrame:
    """A row per fingerprint and mask: cell (mask number), part (the bits under the mask)."""
    parts = [
        F.struct(F.lit(i).alias("cell"), F.col("fp").bitwiseAND(signed_bits(m)).alias("part"))
        for i, m in enumerate(masks())
    ]
    return table.select("fp", "pivots", F.explode(F.array(*parts)).alias("c")).select("c.cell", "c.part", "fp", "pivots")


def linked_pairs(members: DataFrame) -> DataFrame:
    """Pairs of a cell that no pivot tells apart by more than RADIUS and that are within RADIUS."""
    a, b = members.alias("a"), members.alias("b")
    apart = [F.abs(F.col("a.pivots")[i] - F.col("b.pivots")[i]) for i in range(PIVOTS)]
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
    together = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.part") == F.col("b.part"))
    return a.join(b, together & (F.col("a.fp") > F.col("b.fp")) & (F.greatest(*apart) <= RADIUS) & near).select(
        F.col("a.fp").alias("u"), F.col("b.fp").alias("v")
    )


def linked_by_midpoints(members: DataFrame) -> DataFrame:
    """Links of large cells without pairs.

    Two fingerprints of a cell within two bits share a midpoint at one free bit or less from
    either; the reverse holds as well. Each midpoint's members are linked to its smallest one.
    """
    bits = [F.array(*[signed_bits(1 << i) for i in range(64) if not m >> i & 1]) for m in masks()]
    flips = F.transform(F.array(*bits)[F.col("cell")], lambda bit: F.col("fp").bitwiseXOR(bit))
    spread = members.select("cell", "part", "fp", F.explode(F.concat(F.array("fp"), flips)).alias("mid"))
    low = spread.groupBy("cell", "part", "mid").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where("v < top")
    return spread.join(low, ["cell", "part", "mid"]).where("fp > v").select(F.col("fp").alias("u"), "v")


def links(table: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that connect just what fingerprints within RADIUS connect.

    Such fingerprints agree on BLOCKS - RADIUS blocks, so they share a cell. Cells of one
    fingerprint hold no pair. In the others the pivot table discards pairs and the Hamming
    distance verifies the rest; nothing is capped, as large cells go through midpoints.
    """
    rows = cells(table)
    sizes = store(rows.groupBy("cell", "part").agg(F.count("*").alias("size")).where("size > 1"), "simhash-cells")
    members = store(rows.join(sizes, ["cell", "part"]), "simhash-members")
    small = linked_pairs(members.where(F.col("size") <= PAIR_CELL))
    large = linked_by_midpoints(members.where(F.col("size") > PAIR_CELL))
    return small.unionByName(large).distinct()


def state_of(edges: DataFrame) -> tuple:
    """How many edges there are, and a sum that tells sets of edges apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; the root is the component's smallest node.

    Alternates large and small stars: each round hangs a node's neighbours on its smallest
    neighbour, until only stars are left, after about log(n) rounds; edges that are stars already take
    one. Every round is written to the shared folder, by no more tasks than its edges need: a session of
    many shuffle partitions would else run and log thousands of tasks of a few edges each. A hub's
    neighbours are joined, not gathered.
    """
    edges = store(edges, "simhash-edges")
    mark = state_of(edges)
    while True:
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, mark[0] // TASK_EDGES)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Merged, so that the smallest neighbours stay in the partitions where they are found.
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).hint("merge")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.coalesce(tasks), "simhash-large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = moved.coalesce(tasks).unionByName(low.select("u", F.col("m").alias("v")).coalesce(tasks)).distinct()
        edges = store(stars.coalesce(tasks), "simhash-small-star")
        now = state_of(edges)
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def grouped(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of (doc_id, fp) rows."""
    first = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(pivot_table(first)))
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = first.join(nodes, F.col("fp") == F.col("node")).select("fp", "root", "first")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    known = linked.join(smallest, "root").select(F.col("fp").alias("f"), "smallest")
    return first.join(known, F.col("fp") == F.col("f"), "left").select(
        "fp", F.when(F.col("f").isNull(), F.col("first")).otherwise(F.col("smallest")).alias("component_id")
    )


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row per document.

    Equal fingerprints are one node, so copies are never paired. Null text counts as empty;
    texts without words share the fingerprint zero and are linked like any others. Repeated
    rows get a row each. Null ids are passed over for component_id, which is null only where a
    component has no other id.
    """
    prints = store(fingerprints(docs), "simhash-prints")
    found = store(grouped(prints), "simhash-groups")
    return prints.join(found, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
