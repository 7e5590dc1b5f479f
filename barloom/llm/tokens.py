"""Token ids of whole texts with a given tokenizer file."""

from __future__ import annotations

import re
import struct
import sys
import types
from itertools import chain, islice

#: A worker process remembers the ids of so many words; beyond that it forgets the latest half.
REMEMBERED = 400_000
#: Longer words are encoded where they occur and not remembered.
LONGEST = 64
#: Texts of so many characters, or a single longer one, are cut into words at a time.
CHARACTERS = 2_000_000
#: Words that go to the tokenizer in one string.
TOGETHER = 64

#: Lower case is a letter-by-letter matter in this range (fixed values: U+0130 has two letters).
_PLAIN = re.compile("[^\x00-įı-ɏ]")
#: Lower-case letters that normalisation leaves alone; a word of them is one token of words.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: b for b in shown}, **{b: 256 + i for i, b in enumerate(hidden)}}


def read_spec(path: str) -> str:
    """The tokenizer file, read where the query is planned and sent along to the workers."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to the library's for the whole text.

    For tokenizers that lower the case, cut at white space and never join over it, as
    `word_bpe_49k.json` does. So the ids of a text are those of its words, one after the other,
    and each distinct word goes to the library once for as long as it is remembered. Words of
    plain letters go straight to the library's model, all others through its whole chain.
    """

    def __init__(self, spec: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.np, self.tokenizer, self.remembered = np, Tokenizer.from_str(spec), remembered
        self.known, self.long, self.letters = {"": b""}, set(), byte_letters()
        (self.zero,) = self.tokenizer.encode("0", add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return self.np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out, first, size = [], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= CHARACTERS or k == len(texts) - 1:
                out += self.encode_some(texts[first : k + 1])
                first, size = k + 1, 0
        return out

    def encode_some(self, texts: list[str]) -> list[bytes]:
        """The words of some texts are cut, told apart and put together again by Arrow; Python sees each distinct one."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        texts = [t if "<|" in t or _PLAIN.search(t) else t.lower() for t in texts]
        plain = ["" if "<|" in t else t.replace("\n", " ") for t in texts]
        cut = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        known = self.learn(set(distinct))
        ids = [known[w] for w in distinct]
        for w in self.long:
            del known[w]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
        spread = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4"))).take(words.indices)
        data, at = np.asarray(spread.flatten()), np.asarray(spread.offsets)[np.asarray(cut.offsets)]
        at = (at - at[0]).tolist()
        return [self.whole(t) if "<|" in t else data[a:b].tobytes() for t, a, b in zip(texts, at, at[1:], strict=False)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """What is known, once it holds the words."""
        if len(self.known) > self.remembered:  # the first met are the most frequent
            self.known = dict(islice(self.known.items(), self.remembered // 2))
        known = self.known
        new = {w for w in words if w not in known}
        # A stop after a letter is a token of its own.
        stopped = [w for w in new if len(w) > 1 and w[-1] in ".," and "a" <= w[-2] <= "z"]
        new.difference_update(stopped)
        new.update({w[:-1] for w in stopped}, {w[-1] for w in stopped})
        new = {w for w in new if w not in known}
        self.long = {w for w in chain(new, stopped) if len(w) > LONGEST}
        plain = [w for w in new if _LETTERS.fullmatch(w) and w not in self.long]
        model, letters = self.tokenizer.model, self.letters
        for w in plain:
            shown = w if w.isascii() else w.encode().decode("latin-1").translate(letters)
            ids = [t.id for t in model.tokenize(shown)]
            known[w] = struct.pack(f"<{len(ids)}I", *ids)
        new.difference_update(plain)
        rest = [w for w in new if "0" in w or w in self.long]
        self.look_up(list(new.difference(rest)))
        for w in rest:
            known[w] = self.whole(w)
        for w in stopped:
            known[w] = known[w[:-1]] + known[w[-1]]
        return known

    def look_up(self, words: list[str]) -> None:
        """Encode words without a zero, many at a time with a zero after each."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        strings = ["".join([f"{w} 0 " for w in g]) for g in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            ids = self.np.array(found.ids, "<u4")
            ends = self.np.flatnonzero(ids == self.zero).tolist()
            if len(ends) != len(group):
                raise ValueError("the tokenizer joins over white space")
            data, at = ids.tobytes(), 0
            for word, end in zip(group, ends, strict=True):
                self.known[word] = data[4 * at : 4 * end]
                at = end + 1


def worker_encoder(spec: str, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of this worker process; tasks that follow each other share it."""
    state = sys.modules.setdefault("_barloom_worker", types.ModuleType("_barloom_worker")).__dict__
    key = ("encoder", hash(spec), remembered)
    if key not in state:
        state[key] = Encoder(spec, remembered)
    return state[key]
