"""Near copies by SimHash over word shingles, with exact Jaccard on the survivors.

MinHash bands propose, since pairs of Jaccard 0.8 lie too many bits apart to be looked up by their
fingerprints. Inside the join that proposes, a pair is discarded by the largest difference of its
distances to the pivots, by its Hamming distance, and by what its sets can have in common at most.
Only texts of surviving pairs are spelled out as sets, and every link is verified on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import packed, unpacked, whole_text
from barloom.llm.simhash import PAIR_CELL, PIVOTS, SEED, components, pivot_distances
from barloom.session import store

SHINGLE, LEAST = 5, 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Fingerprints of a pair of similarity 0.8 differ in 9.7 bits on average, with a deviation of 2.9.
RADIUS = 20
#: Members of a large cell that are compared with all of it: one at first, then so many times more each round.
GROWTH = 16
#: 64-bit words of the bitmap in which a text marks its shingles.
MARKS = 16


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only


def text_id(words: list[bytes]) -> bytes:
    """128 bits that stand for the words; equal ones count as equal texts."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words), SEED)


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE):
    """The distinct 64-bit hashes of the shingles, sorted; fewer words are one shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest

    n = min(shingle, len(words))
    found = {xxh64_intdigest(b" ".join(words[i : i + n]), SEED) for i in range(len(words) - n + 1)} if n else ()
    return np.sort(np.fromiter(found, np.uint64))


def bits_of(hashes) -> int:
    """The SimHash of distinct shingles: bits set in over half of them. Signed."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def marks_of(hashes) -> list[int]:
    """The bitmap of the shingles, as signed words."""
    import numpy as np

    bits = np.zeros(64 * MARKS, np.uint8)
    bits[(hashes % np.uint64(64 * MARKS)).astype(np.int64)] = 1
    return np.packbits(bits).view(">i8").tolist()


def signatures(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, sig, id (of the words), n (distinct shingles), fp (SimHash), marks and a MinHash value per band; none without words."""

    def stamp(batches):
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(SEED)
        odd = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        plus = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
        mix = rng.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            ids, sizes, prints, marks, bands = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                hashes = shingle_hashes(words, shingle)
                least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
                for at in range(0, len(hashes), 4096):
                    np.minimum(least, (hashes[at : at + 4096, None] * odd + plus).min(0), out=least)
                ids.append(text_id(words))
                sizes.append(len(hashes))
                prints.append(bits_of(hashes))
                marks.append(marks_of(hashes))
                bands.append((least.reshape(BANDS, ROWS) * mix).sum(1, dtype=np.uint64).view(np.int64).tolist() if words else [])
            columns = [pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in (marks, bands)]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sig"), *columns], names)

    texts = rows.select("doc_id", "sig", whole_text().alias("text"))
    more = {"id": T.BinaryType(), "n": T.IntegerType(), "fp": T.LongType(), "marks": T.ArrayType(T.LongType()), "bands": T.ArrayType(T.LongType())}
    schema = T.StructType([texts.schema["doc_id"], texts.schema["sig"], *[T.StructField(k, t) for k, t in more.items()]])
    names = schema.names
    return texts.mapInArrow(stamp, schema)


def shingle_sets(rows: DataFrame, wanted: DataFrame, known: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node and the hashes of its shingles, of the wanted nodes.

    Texts are picked by their narrow hash alone, so that the list of them is small and, below Spark's
    threshold, no text is shuffled; one that shares the hash by chance falls out when ids are compared.
    """

    def spell(batches):
        import pyarrow as pa

        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            sets = [shingle_hashes(w, shingle).view("int64") for w in words]
            ids = pa.array([text_id(w) for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"])

    named = store(known.join(wanted, "node", "left_semi").select("node", "id", "sig"), "near-wanted")
    texts = rows.select("sig", whole_text().alias("text")).join(named.select("sig").distinct(), "sig", "left_semi")
    spelled = texts.select("text").mapInArrow(spell, "id binary, hashes array<long>")
    return spelled.join(named.select("node", "id"), "id").select("node", "hashes").dropDuplicates(["node"])


def can_be_alike(a: str, b: str, least: float) -> Column:
    """Pairs (rows of members) that no pivot, no bit count and no size tells apart.

    `shared` shingles of a row occur in other texts; two sets have no more in common than either has of those.
    """
    apart = [F.abs(F.col(f"{a}.pivots")[i] - F.col(f"{b}.pivots")[i]) for i in range(PIVOTS)]
    near = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= RADIUS
    both = F.least(f"{a}.shared", f"{b}.shared")
    sizes = both >= least * (F.col(f"{a}.n") + F.col(f"{b}.n") - both)
    return sizes & (F.greatest(*apart) <= RADIUS) & near


def marked_alike(a: str, b: str, least: float) -> Column:
    """A bit that only one of two texts has stands for a shingle or more that the other lacks."""

    def left(x: str, y: str) -> Column:
        alone = [F.bit_count(F.col(f"{x}.marks")[i].bitwiseAND(F.bitwise_not(F.col(f"{y}.marks")[i]))) for i in range(MARKS)]
        return F.col(f"{x}.n") - sum(alone[1:], alone[0])

    both = F.least(left(a, b), left(b, a))
    return both >= least * (F.col(f"{a}.n") + F.col(f"{b}.n") - both)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose Jaccard similarity is `least` or more."""
    a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").where(both >= least * (F.size("a") + F.size("b") - both)).select("u", "v")


def pairs_of(members: DataFrame, least: float) -> DataFrame:
    a, b = members.alias("a"), members.alias("b")
    together = (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part"))
    met = a.join(b, together & (F.col("a.node") > F.col("b.node")) & can_be_alike("a", "b", least))
    return met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def shared_counts(large: DataFrame, sets: DataFrame) -> DataFrame:
    """node and how many of its shingles some other member of a large cell has as well."""
    held = sets.join(large.select("node").distinct(), "node", "left_semi").select("node", F.explode("hashes").alias("h"))
    common = store(held.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "near-common")
    return held.join(common, "h").groupBy("node").agg(F.count("*").cast("int").alias("common"))


def link_large(large: DataFrame, edges: DataFrame, sets: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """Edges that connect what the pairs of large cells connect, without making all pairs.

    Pairs within a component add nothing. Of two components of a cell one is not its largest, so it is
    enough to compare each member outside the largest component with the whole cell. Members with too few
    shingles in common with anybody are left out, those of most large cells are compared first (they lie in
    the middle of their copies, so one of them links most of the cell), and each round links the
    components anew, until none is left. A round starts from the last one's components, each node linked to
    its root, in place of all edges so far; those links are what is returned.
    """
    weight = large.groupBy("node").agg(F.count("*").alias("weight"))
    counts = store(shared_counts(large, sets).join(weight, "node").join(marks, "node"), "near-counts")
    large = large.drop("shared").join(counts.withColumnRenamed("common", "shared"), "node")
    large = store(large.where(F.col("shared") >= least * F.col("n")), "near-large")
    columns = ["band", "part", "node", "n", "shared", "fp", "pivots", "weight", "marks"]
    led, many = None, 1
    while True:
        found = components(edges)
        roots = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
        placed = large.join(store(roots, "near-roots"), "node", "left").select(*columns, F.coalesce("root", "node").alias("root"))
        placed = store(placed, "near-placed")
        parts = placed.groupBy("band", "part", "root").agg(F.count("*").alias("held"))
        most = parts.groupBy("band", "part").agg(F.max_by("root", F.struct("held", "root")).alias("main"), F.count("*").alias("kinds"))
        others = placed.join(store(most.where("kinds > 1"), "near-most"), ["band", "part"]).where("root != main" if led is not None else "true")
        if led is not None:
            others = others.join(led, ["band", "part", "node"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("band", "part").orderBy(F.desc("weight"), "node"))
        leaders = store(others.withColumn("rank", rank).where(F.col("rank") <= many).select(*columns, "root"), "near-leaders")
        stars = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
        if leaders.isEmpty():
            return stars
        a, b = placed.alias("a"), leaders.alias("b")
        together = (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.root") != F.col("b.root"))
        met = a.join(b, together & can_be_alike("a", "b", least) & marked_alike("a", "b", least))
        met = met.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()
        edges = stars.unionByName(verified(store(met, "near-pairs"), sets, least))
        now = leaders.select("band", "part", "node")
        led, many = now if led is None else led.unionByName(now), many * GROWTH


def links(rows: DataFrame, known: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Edges (u, v), u > v, that connect just what nodes of different texts connect that share a band and are alike by `least` or more.

    known: node, id, sig (of one of its texts), n, fp, marks, bands.
    """
    spread = known.select("node", "n", "fp", F.posexplode("bands").alias("band", "part"))
    sizes = store(spread.groupBy("band", "part").agg(F.count("*").alias("size")).where("size > 1"), "near-cells")
    members = spread.join(sizes, ["band", "part"]).withColumn("shared", F.col("n")).withColumn("pivots", pivot_distances("fp"))
    members = store(members, "near-members")
    small = store(pairs_of(members.where(F.col("size") <= PAIR_CELL), least), "near-pairs")
    large = members.where(F.col("size") > PAIR_CELL)
    wanted = small.select(F.explode(F.array("u", "v")).alias("node")).unionByName(large.select("node")).distinct()
    sets = store(shingle_sets(rows, wanted, known, shingle), "near-sets")
    edges = verified(small, sets, least)
    return edges if large.isEmpty() else link_large(large, edges, sets, known.select("node", "marks"), least)


def near_keep(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The documents without near copies: the smallest doc_id of each component, all columns.

    Linked are texts of the same words, and texts whose sets of `shingle`-word shingles have a Jaccard
    similarity of `least` or more. Bands propose the pairs and every link is verified; no cell is capped.
    Null text counts as empty; texts without words are one group. Where the smallest id of a group occurs on
    several of its rows, the row with the smallest text hash stays, once. A null id stays only where its
    component has no other id. No documents: none.
    """
    rows = packed(docs)
    prints = store(signatures(rows, shingle), "near-prints")
    known = prints.groupBy("id").agg(
        F.count("*").alias("held"), F.min("sig").alias("sig"), *[F.any_value(c).alias(c) for c in ("n", "fp", "marks", "bands")]
    )
    known = store(known.withColumn("node", F.monotonically_increasing_id()), "near-distinct")
    roots = components(links(rows, known.where("n > 0"), shingle, least))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    groups = known.select("node", "id", "held").join(store(roots, "near-roots"), "node", "left")
    groups = groups.where("held > 1 or root is not null").select("id", F.coalesce("root", "node").alias("root"))
    # Documents without a copy stay unseen: only those that go are named to the texts.
    copies = store(prints.select("doc_id", "sig", "id").join(store(groups, "near-groups"), "id").drop("id"), "near-copies")
    first = copies.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("first"))
    first = store(first.select("root", F.col("first.doc_id").alias("d"), F.col("first.sig").alias("s")), "near-first")
    stays = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sig") == F.col("s"))
    gone = store(copies.join(first, "root").where(~stays).select(F.col("doc_id").alias("d"), F.col("sig").alias("s")).distinct(), "near-gone")
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sig") == F.col("s")), "left_anti")
    if not copies.groupBy("doc_id", "sig").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "sig"])
    return unpacked(rows, docs.columns)
