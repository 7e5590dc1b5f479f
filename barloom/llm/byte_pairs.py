"""Byte-pair encoding by prefix dynamic programming: exact ids, appends and edits of encoded texts.

The ids of a piece are those whose neighbours belong together: a sequence of tokens is an
encoding exactly if every two neighbours, merged by rank, come out as the same two tokens. So each
byte prefix of a piece has one valid last token, and that token does not depend on the bytes that
follow. The table of last tokens is all the state there is: appended bytes add entries, an edit
keeps the entries before it, and the ids are read off backwards.
"""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import lean, whole_text

#: A worker process remembers the ids of so many pieces, and so many pairs; beyond that it starts anew.
REMEMBERED = 600_000
#: Longer pieces are encoded where they occur and not remembered.
LONGEST = 64
#: Characters behind a piece on which its end may depend: pieces this far before a change stay.
AHEAD = 3


def read_ranks(path: str) -> bytes:
    """The rank file, read where the query is planned and sent along to the workers."""
    with open(path, "rb") as f:
        return f.read()


class BytePairs:
    """Tokens of a rank file: lines of a base64 token and its rank, all 256 single bytes among them."""

    def __init__(self, spec: bytes, pattern: str):
        import ahocorasick
        import regex

        lines = (line.split() for line in spec.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pieces = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}
        self.span = max(self.tokens) + 1
        self.sizes = [len(self.tokens.get(i, b"")) for i in range(self.span)]
        self.edges: dict[tuple[int, bool], list[int] | None] = {}
        self.valid: dict[int, bool] = {}

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Merge the neighbours of the lowest rank, leftmost first, down to `stop` parts: the definition."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            ranks = [self.ranks.get(a + b, sys.maxsize) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == sys.maxsize:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, right: bool) -> list[int] | None:
        """The tokens at the token's right or left edge while it is merged: a byte first, itself last.

        None where it is not its own encoding, or where the merges do not rise in rank.
        """
        key = (token, right)
        if key not in self.edges:
            data, found = self.tokens[token], [token]
            while found and len(data) > 1:
                parts = self.merged(data, stop=2)
                if len(parts) != 2 or parts[0] + parts[1] != data or max(map(self.ranks.get, parts)) > found[-1]:
                    found = None
                    break
                data = parts[right]
                found.append(self.ranks[data])
            self.edges[key] = found and found[::-1]
        return self.edges[key]

    def fits(self, before: int, token: int) -> bool:
        """The token may follow the token before it, or may be the first (before: -1).

        While both are merged, lowest rank first, their inner edges grow towards each other. The pair
        fails if at some time the two edges make a token that comes before either edge's next one;
        of equal ranks the leftmost goes first.
        """
        left, right = self.edge(before, True) if before >= 0 else [], self.edge(token, False)
        if left is None or right is None:
            ids = [token] if before < 0 else [before, token]
            return [self.ranks[p] for p in self.merged(b"".join(self.tokens[i] for i in ids))] == ids
        i = j = 0
        while before >= 0:
            a = left[i + 1] if i + 1 < len(left) else sys.maxsize
            b = right[j + 1] if j + 1 < len(right) else sys.maxsize
            cross = self.ranks.get(self.tokens[left[i]] + self.tokens[right[j]], sys.maxsize)
            if cross < a and cross <= b and cross < sys.maxsize:
                return False
            if a == b == sys.maxsize:
                break
            i, j = (i + 1, j) if a <= b else (i, j + 1)
        return True

    def extend(self, piece: bytes, lasts: list[int]) -> list[int]:
        """The last token of every byte prefix of the piece; lasts holds those of its first prefixes."""
        lasts = list(lasts)
        n, sizes, valid, span = len(lasts), self.sizes, self.valid, self.span
        for end, token in self.automaton.iter(piece.decode("latin-1"), max(0, n - self.longest + 1)):
            if end < n:  # known, or told by a token that ends here as well
                continue
            first = end - sizes[token]
            before = lasts[first] if first >= 0 else -1
            key = before * span + token
            fits = valid.get(key)
            if fits is None:
                if len(valid) > REMEMBERED:
                    valid.clear()
                fits = valid[key] = self.fits(before, token)
            if fits:
                lasts.append(token)
                n += 1
        return lasts

    def backwards(self, piece: bytes, lasts: list[int]) -> list[int]:
        """The ids of a piece, read off its table. A piece that is a token is that token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        ids, at = [], len(piece)
        while at:
            ids.append(lasts[at - 1])
            at -= len(self.tokens[lasts[at - 1]])
        return ids[::-1]

    def ids(self, piece: str) -> bytes:
        """The ids of a piece as little-endian 32-bit integers."""
        import numpy as np

        found = self.known.get(piece)
        if found is None:
            data = piece.encode()
            found = np.array(self.backwards(data, [] if data in self.ranks else self.extend(data, [])), "<i4").tobytes()
            if len(piece) <= LONGEST:
                if len(self.known) >= REMEMBERED:  # the first met are the most frequent
                    self.known = dict(islice(self.known.items(), REMEMBERED // 2))
                self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        known = self.known.get
        return b"".join([known(p) or self.ids(p) for p in self.pieces.findall(text)])

    def state(self, text: str) -> tuple[list[int], list[int]]:
        """(start of each piece in characters, last token of every byte prefix of every piece)."""
        starts, lasts = [], []
        for m in self.pieces.finditer(text):
            starts.append(m.start())
            lasts += self.extend(m[0].encode(), [])
        return starts, lasts

    def ids_of(self, text: str, starts: list[int], lasts: list[int]) -> list[int]:
        ids, at = [], 0
        for a, b in zip(starts, [*starts[1:], len(text)], strict=False):
            piece = text[a:b].encode()
            ids += self.backwards(piece, lasts[at : at + len(piece)])
            at += len(piece)
        return ids

    def edit(self, text: str, starts: list[int], lasts: list[int], first: int, end: int, new: str):
        """(text, starts, lasts) with new in place of text[first:end].

        Pieces far enough before the edit stay. Behind it, pieces are cut anew until a cut meets
        an old one, since the pattern looks at nothing before a piece; what follows stays as well.
        A new piece that begins like the old one at its place keeps the table of the common bytes.
        """
        from bisect import bisect_left, bisect_right
        from os.path import commonprefix

        first = max(0, min(first, len(text)))
        end = max(first, min(end, len(text)))
        whole, shift = text[:first] + new + text[end:], len(new) - (end - first)
        keep = bisect_right(starts, first - AHEAD) - 1  # the piece around here is cut anew, those before it stay
        keep = max(keep, 0)
        at = starts[keep] if starts else 0
        before = len(text[:at].encode())
        cuts, table, old, byte = starts[:keep], lasts[:before], set(starts[keep:]), before
        place = {s: k for k, s in enumerate(starts)}
        while at < len(whole):
            if at >= first + len(new) and at - shift in old:
                k = place[at - shift]
                return whole, cuts + [s + shift for s in starts[k:]], table + lasts[len(text[: at - shift].encode()) :]
            piece = self.pieces.match(whole, at)[0]
            data = piece.encode()
            k = bisect_left(starts, at)
            known: list[int] = []
            if k < len(starts) and starts[k] == at <= first:
                was = text[at : starts[k + 1] if k + 1 < len(starts) else len(text)].encode()
                known = lasts[byte : byte + len(commonprefix([was, data]))]
            cuts.append(at)
            table += self.extend(data, known)
            byte += len(data) if at < first else 0
            at += len(piece)
        return whole, cuts, table


def worker_pairs(spec: bytes, pattern: str) -> BytePairs:
    """The tokens of this worker process; tasks that follow each other share them."""
    state = sys.modules.setdefault("_barloom_worker", types.ModuleType("_barloom_worker")).__dict__
    key = ("byte pairs", hash(spec), pattern)
    if key not in state:
        state[key] = BytePairs(spec, pattern)
    return state[key]


INTS = T.ArrayType(T.IntegerType(), False)


def int_lists(lists: list[bytes]):
    """An Arrow list column of little-endian 32-bit integers."""
    import numpy as np
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(lists), "<i4")))


def encode(docs: DataFrame, spec: bytes, pattern: str) -> DataFrame:
    """doc_id and ids, a row per document in its place: no shuffle.

    The pattern cuts the text into pieces, which are encoded on their own; it must leave nothing
    out and look at nothing before a piece. Null and empty texts have no ids. Repeated rows and
    null ids give a row each.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        pairs = worker_pairs(spec, pattern)
        for batch in batches:
            ids = int_lists([pairs.encode(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    texts = lean(docs).select("doc_id", whole_text().alias("text"))
    return texts.mapInArrow(run, T.StructType([texts.schema["doc_id"], T.StructField("ids", INTS)]))


def decode(encoded: DataFrame, spec: bytes, pattern: str) -> DataFrame:
    """The rows of doc_id and ids with `bytes`, what the ids stand for; null ids are no ids.

    Ids outside the vocabulary raise an error. The bytes of all rows of a batch are taken out of
    the vocabulary at once.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pairs = worker_pairs(spec, pattern)
        if not hasattr(pairs, "table"):
            size = max(pairs.tokens) + 1
            pairs.table = pa.array([pairs.tokens.get(i) for i in range(size)], pa.binary())
        for batch in batches:
            ids = batch.column("ids")
            found = pairs.table.take(ids.flatten())
            if found.null_count:
                raise ValueError("an id is not in the vocabulary")
            ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, found.offset * 4)
            cuts = ends[np.asarray(ids.offsets) - ids.offsets[0].as_py()]
            data = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(cuts.tobytes()), found.buffers()[2]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, data], ["doc_id", "ids", "bytes"])

    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast(INTS)).alias("ids"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", INTS), T.StructField("bytes", T.BinaryType())])
    return rows.mapInArrow(run, schema)


STATE = [T.StructField("text", T.StringType()), T.StructField("starts", INTS), T.StructField("lasts", INTS)]


def tables(docs: DataFrame, spec: bytes, pattern: str) -> DataFrame:
    """doc_id, text, starts, lasts: the state from which `edited` goes on and `ids_of` reads the ids."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pairs = worker_pairs(spec, pattern)
        for batch in batches:
            found = [pairs.state(t) for t in batch.column("text").to_pylist()]
            lists = [int_lists([np.array(f[k], "<i4").tobytes() for f in found]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *lists], names)

    texts = lean(docs).select("doc_id", whole_text().alias("text"))
    schema = T.StructType([texts.schema["doc_id"], *STATE])
    names = schema.names
    return texts.mapInArrow(run, schema)


def edited(state: DataFrame, edits: DataFrame, spec: bytes, pattern: str) -> DataFrame:
    """The state after the edits, (doc_id, first, end, new): text[first:end] becomes new.

    Offsets are code points, cut to the text; null offsets stand for the end of the text, so that
    an edit without them appends. A document without an edit stays as it is, one with several must
    come in as many calls: they refer to one text. Rows of several texts with one id get its edit
    each. The state meets the edits by doc_id; a null id meets none.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pairs = worker_pairs(spec, pattern)
        for batch in batches:
            rows = [
                pairs.edit(r["text"], r["starts"], r["lasts"], *(len(r["text"]) if r[c] is None else r[c] for c in ("first", "end")), r["new"])
                for r in batch.to_pylist()
            ]
            lists = [int_lists([np.array(r[k], "<i4").tobytes() for r in rows]) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), *lists], names)

    schema = T.StructType([state.schema["doc_id"], *STATE])
    names = schema.names
    changes = edits.select("doc_id", F.col("first").cast("int"), F.col("end").cast("int"), F.coalesce("new", F.lit("")).alias("new"), F.lit(1).alias("hit"))
    met = state.select(*names).join(changes, "doc_id", "left")
    same = met.where("hit is null").select(*names)
    return met.where("hit = 1").drop("hit").mapInArrow(run, schema).unionByName(same)


def ids_of(state: DataFrame, spec: bytes, pattern: str) -> DataFrame:
    """doc_id and ids of the state."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pairs = worker_pairs(spec, pattern)
        for batch in batches:
            found = [pairs.ids_of(r["text"], r["starts"], r["lasts"]) for r in batch.to_pylist()]
            lists = int_lists([np.array(f, "<i4").tobytes() for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return state.mapInArrow(run, T.StructType([state.schema["doc_id"], T.StructField("ids", INTS)]))


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids, a space between), decoded_sha256."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
