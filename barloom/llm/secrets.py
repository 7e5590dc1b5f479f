"""Secret scan: keyword automaton, patterns anchored at its hits, checksums at the end."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import lean, whole_text

#: The kinds, in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "card")
BASE = 3

#: Keywords of the automaton, in lower case, and the kinds they may begin.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign",
    "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "card": "card",
}

#: The patterns, matched at a keyword's hit only.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
CARD = re.compile(r"card(?:[ _]?(?:number|no))?[\"']?\x20*[:=#]?\x20*[\"']?([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.I | re.A)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

_HEX_CLASS = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
_HEX_RUN = b"h" * LEAST_HEX


def crc_digits(body: str) -> str:
    """The CRC-32 of a token's body as six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def keyword_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    return automaton


def hex_spans(text: str, raw: bytes) -> Iterator[tuple[str, int, int]]:
    """Runs of 24 or more hex digits. `raw` is the text with one byte per code point or more."""
    if _HEX_RUN not in raw.translate(_HEX_CLASS):
        return
    for m in re.finditer(rf"[0-9a-f]{{{LEAST_HEX},}}", text):
        yield "hex", m.start(), m.end()


def spans_of(text: str, automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    lowered = raw.lower().decode("utf-8", "surrogatepass")
    found = list(hex_spans(text, raw))
    done = dict.fromkeys(KINDS, 0)  # where the last match of each kind ended, kept or not
    # Hits come by their ends; the keywords of a kind have no suffix in common, so also by starts.
    for end, (length, kind) in automaton.iter(lowered):
        at = end + 1 - length
        if at < done[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                done[kind] = m.end()
                if len(m[1]) >= LEAST_ASSIGN:
                    found.append((kind, at, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                done[kind] = m.end()
                if m.end() - at >= LEAST_ACCESS:
                    found.append((kind, at, m.end()))
        elif kind == "card":
            if (m := CARD.match(text, at)) and luhn(m[1]):
                done[kind] = m.end()
                found.append((kind, m.start(1), m.end()))
        elif (m := (GITHUB if kind == "github" else NPM).match(text, at)) and crc_digits(m[1]) == m[2]:
            done[kind] = m.end()
            found.append((kind, at, m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<(kind, start, end)>: one row per document, in one pass, no shuffle.

    An automaton finds the keywords in each whole text; the pattern of a kind is tried at the
    hits alone, from left to right, not inside its previous match. Hex runs have no keyword:
    texts without a long enough run are passed over by a class map of their bytes. Spans of
    kinds with a checksum (github, npm: CRC-32; card: Luhn) count only if it holds.

    Null text counts as empty: no spans. Rows are independent, so repeated or null ids and
    repeated texts give a row each; an empty table gives an empty result.
    """

    def scan(batches):
        import pyarrow as pa

        automaton = keyword_automaton()
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t, automaton)]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"]
            )

    texts = lean(docs).select("doc_id", whole_text().alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("spans", T.ArrayType(SPAN))])
    return texts.mapInArrow(scan, schema)


def span_list(spans: str) -> F.Column:
    written = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(written, ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hashes of the base kinds, and the list of all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS[:BASE]],
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list("spans").alias("spans"),
    )
