"""Operator 2: BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent byte symbols that occurs inside no vocabulary token can never be merged across, whatever
the merge ranks are. Every such pair therefore marks a certain cut: the fragments on both sides are encoded on
their own by the vocabulary's merges, and their ids are concatenated. Words met before come from a bounded cache of the
worker.

Defined results: a null text counts as empty; an empty text, or one of white space alone, has no ids, and the decoded
text is empty. Repeated rows give repeated rows; columns other than the two named are not looked at. Strings of the
vocabulary's special tokens in a text become their ids, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from sluice.llm._common import map_arrow, narrow, texts

#: Words a worker keeps; beyond it the cache is emptied and fills anew.
CACHE_ENTRIES = 400_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable bytes stand for themselves, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class ForcedBoundaryBPE:
    """BPE of one vocabulary file with word ends, lower case and no decoder."""

    END = "</w>"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern: str = split["pattern"]["Regex"]
        self._narrow = re.compile(self._narrow_pattern()).findall
        self.symbol = byte_symbols()
        self.inside, self.inside_end = self._adjacent()
        self._word: dict[str, bytes] = {}
        self._token_bytes = [self.token.get(i, "").encode() for i in range(max(self.token) + 1)]
        merges = [tuple(p) for p in pairs]
        self._ending = Tokenizer(models.BPE(self.vocab, merges, end_of_word_suffix=self.END))
        self._inner = Tokenizer(models.BPE(self.vocab, merges))

    def _narrow_pattern(self) -> str:
        """The file's pattern for texts below U+0100, with the properties written out as characters.

        Letters go first: no alternative before them can begin with one."""
        low = [chr(c) for c in range(0x100)]
        letters, numbers = ("".join(re.escape(c) for c in low if regex.match(rf"\p{{{p}}}", c)) for p in "LN")
        first = r"[\p{L}]+|"
        pattern = first + self.pattern.replace(first, "")
        return pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", r"\t-\r \x85\xa0")

    def _adjacent(self) -> tuple[set[str], set[str]]:
        """Adjacent symbols inside tokens; apart, those whose second symbol ends a word."""
        inside, inside_end = set(), set()
        for t in self.vocab:
            ends = t.endswith(self.END)
            core = t[: -len(self.END)] if ends else t
            for i in range(len(core) - 1):
                (inside_end if ends and i == len(core) - 2 else inside).add(core[i : i + 2])
        return inside, inside_end

    def cuts(self, word: str) -> list[int]:
        """Certain cuts of a word in byte symbols: no token holds the two symbols around any of them."""
        last = len(word) - 2
        return [i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in (self.inside_end if i == last else self.inside)]

    def _fragments(self, fragments: set[tuple[str, bool]]) -> dict[tuple[str, bool], bytes]:
        """Ids of fragments, each encoded on its own; the flag: its last symbol ends the word."""
        out = {}
        for model, ends in ((self._ending, True), (self._inner, False)):
            if some := [f for f, e in fragments if e == ends]:
                for f, got in zip(some, model.encode_batch_fast(some, add_special_tokens=False), strict=True):
                    out[f, ends] = array("I", got.ids).tobytes()
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words as little-endian 32-bit integers: split at certain cuts, encode the fragments, concatenate."""
        symbol, whole, split = self.symbol, {}, {}
        for w in words:
            symbols = w if w.isascii() and w.isalnum() else "".join([symbol[b] for b in w.encode()])
            if cuts := self.cuts(symbols):
                at = [0, *cuts, len(symbols)]
                split[w] = [(symbols[i:j], j == len(symbols)) for i, j in zip(at, at[1:], strict=False)]
            else:
                whole[w] = symbols
        ids = self._fragments({(s, True) for s in whole.values()} | {f for fs in split.values() for f in fs})
        return {w: ids[s, True] for w, s in whole.items()} | {w: b"".join([ids[f] for f in fs]) for w, fs in split.items()}

    def normal(self, text: str) -> str:
        """NFC and lower case; below U+0100 every character is its own composed form."""
        return text.lower() if narrow(text) else self.library.normalizer.normalize_str(text)

    def words(self, text: str) -> list[str]:
        """The words of normalised text. Common alphabets take a class of fixed ranges, which is faster."""
        if narrow(text):
            return self._narrow(text)
        return self._wide().findall(text)

    @lru_cache(maxsize=1)  # noqa: B019  one encoder a process
    def _wide(self) -> regex.Pattern:
        """The file's pattern, without letters and numbers that are newer than the library's tables."""
        letters = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0x100, 0xD800), *range(0xE000, 0x110000)])))
        at, new = 0, []
        kept = {span for _, span in self.library.pre_tokenizer.pre_tokenize_str(" ".join(f"a{c}b" if c.isalpha() else f"{c}!" for c in letters))}
        for c in letters:
            n = 3 if c.isalpha() else 2
            if (at, at + 3) not in kept if n == 3 else (at, at + 2) in kept:
                new.append(c)
            at += n + 1
        outside = "".join(f"\\U{ord(c):08x}" for c in new)
        known = self.pattern.replace("[\\p{L}]+", f"[[\\p{{L}}]--[{outside}]]+").replace("[\\p{N}]", f"[[\\p{{N}}]--[{outside}]]").replace("[^\\s\\p{L}\\p{N}]+", f"[[^\\s\\p{{L}}\\p{{N}}]||[{outside}]]+") if new else self.pattern
        return regex.compile(known, regex.V1)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ids: list[bytes] = []
        for k, piece in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if k % 2:
                ids.append(np.array([self.special[piece]], "<u4").tobytes())
            elif piece:
                words = self.words(self.normal(piece))
                got = [*map(self._word.get, words)]
                if None in got:
                    new = self._learn({w for w, g in zip(words, got, strict=True) if g is None})
                    if len(self._word) > CACHE_ENTRIES:
                        self._word.clear()
                    got = [g if g is not None else new[w] for w, g in zip(words, got, strict=True)]
                    self._word |= {w: g for w, g in new.items() if len(w) <= 64}
                ids += got
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8: this vocabulary file names no decoder, so tokens are joined by a space."""
        return b" ".join([*map(self._token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())])


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``ids`` (binary: little-endian unsigned 32-bit), ``decoded`` (the text of those ids)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(vocabulary)
        got = [bpe.encode(t) for t in texts(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(got, pa.binary()), pa.array([bpe.decode(x).decode() for x in got], pa.string())], names=[id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df, [df[id_col].alias(id_col), df[text_col].alias("__text")], run, f"{id_col} {kind}, ids binary, decoded string")


def digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and ``ids`` if they are asked for; texts stay in the worker."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(vocabulary)
        sha = hashlib.sha256
        n, a, b, every = [], [], [], []
        for t in texts(batch.column(1)):
            ids = bpe.encode(t)
            n.append(len(ids) // 4)
            a.append(sha(ids).hexdigest())
            b.append(sha(bpe.decode(ids)).hexdigest())
            every.append(ids)
        more = [pa.array(every, pa.binary())] if with_ids else []
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *more], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df, [df[id_col].alias(id_col), df[text_col].alias("__text")], run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{', ids binary' if with_ids else ''}")
