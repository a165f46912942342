"""BPE encoding and decoding.

Encoder: Aho-Corasick finds, for each place of a word, the longest token that starts there; a
backtracking walk takes it if it is compatible with the token before, and the next shorter prefix
token otherwise.  Two tokens are compatible if merging their concatenation by rank would keep the
border between them; that is decided from the merge tree and kept in a pair table.  The result is
exactly that of applying the merges by rank, in time linear in the word.

Decoder: one buffer with the strings of all tokens and a table of offsets into it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from .common import id_text, map_batches

#: Tokenizer files above this size aren't shipped to executors.
MAX_FILE = 64 << 20
#: Entries of the pair table, which is emptied when full, and of each of the word cache's two generations.
MAX_PAIRS, MAX_WORDS, LONGEST_CACHED = 1 << 19, 1 << 18, 48

END = "\U0010ffff"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class WordBpe:
    """A byte-level BPE tokenizer with word ends, read from the JSON text of its file."""

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        model, pre = d["model"], d["pre_tokenizer"]
        kinds = [p["type"] for p in pre.get("pretokenizers", [])]
        steps = [n["type"] for n in (d["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["Split", "ByteLevel"] or steps != ["NFC", "Replace", "Lowercase"] or d["decoder"] or not model["end_of_word_suffix"]:
            raise ValueError("this file describes another kind of tokenizer")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"]):
            raise ValueError("added tokens with options aren't supported")
        suffix = model["end_of_word_suffix"]
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bytes = byte_alphabet()
        # Code points that this Python doesn't know yet may be letters to the tokenizer's own tables.
        known = [unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)]
        starts = [c for c in range(0x110000) if not known[c] and (c == 0 or known[c - 1])]
        stops = [c for c in range(0x110000) if not known[c] and (c == 0x10FFFF or known[c + 1])]
        self.unassigned = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, stops, strict=True)) + "]")
        self.unusual = re.compile("[^\\x00-\u036f\u0400-\u052f\u2010-\u2027\u20ac]")  # a quick look before that long class
        self.library = tokenizers.Tokenizer.from_str(spec)

        size = max([*vocab.values(), *self.added.values()]) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.pairs: dict[int, int] = {}
        rank = {}
        for n, (a, b) in enumerate(merges):
            t, a, b = vocab[a + b], vocab[a], vocab[b]
            if t in rank or t < max(a, b):
                raise ValueError("ids must follow the order of the merges")
            rank[t] = n
            self.left[t], self.right[t] = a, b
            self.pairs[a << 32 | b] = t
        if sorted(rank, key=rank.get) != sorted(rank):
            raise ValueError("ids must follow the order of the merges")

        # The word end is a character of its own here, which only occurs together with the one before.
        self.length = [0] * size
        spelled = {}
        for s, t in vocab.items():
            s = s[: -len(suffix)] + END if s.endswith(suffix) else s
            spelled[s] = t
            self.length[t] = len(s)
        self.find = ahocorasick.Automaton()
        for s, t in spelled.items():
            self.find.add_word(s, t)
        self.find.make_automaton()
        self.shorter = [-1] * size
        for s, t in spelled.items():
            for n in range(len(s) - 1, 0, -1):
                if (p := spelled.get(s[:n])) is not None:
                    self.shorter[t] = p
                    break

        # Offset table: all strings in one buffer, with the space that follows a token and, after them, without it.
        strings = [""] * size
        for s, t in [*vocab.items(), *self.added.items()]:
            strings[t] = s
        self.size, self.strings = size, pa.array([x + " " for x in strings] + strings, pa.large_string())
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def fits(self, a: int, b: int) -> bool:
        """Does merging by rank keep the border between tokens a and b?"""
        key = a << 32 | b
        if (known := self.compatible.get(key)) is not None:
            return known
        limit, x, y, out = 1 << 62, a, b, None
        while out is None:
            if self.pairs.get(x << 32 | y, limit) < limit:
                out = False
            elif x > y:
                limit, x = x, self.right[x]
                if x == limit:
                    limit, y = y + 1, self.left[y]
                    out = True if y + 1 == limit else None
            else:
                limit, y = y + 1, self.left[y]
                if y + 1 == limit:
                    limit, x = x, self.right[x]
                    out = True if x == limit else None
        if len(self.compatible) >= MAX_PAIRS:
            self.compatible.clear()
        self.compatible[key] = out
        return out

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one word of normalised text."""
        return self.encode_spelled("".join(map(self.bytes.__getitem__, word.encode())) + END)

    def encode_spelled(self, spelled: str) -> list[int]:
        """Tokens of a word in the byte alphabet, with its end."""
        n, longest = len(spelled), [-1] * len(spelled)
        length, shorter, fits = self.length, self.shorter, self.fits
        for end, t in self.find.iter(spelled):
            start = end - length[t] + 1
            if longest[start] < 0 or length[longest[start]] < length[t]:
                longest[start] = t
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token] if token >= 0 else -1
            if token >= 0 and open_at[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif token >= 0 and shorter[token] >= 0:
                token = shorter[token]
            else:  # no token can start here after the one before
                open_at[at] = 0
                if not out:
                    raise ValueError("the vocabulary doesn't cover this word")
                token = out.pop()
                at -= length[token]

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # character by character: no rule for a sigma at a word's end
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str, out: list[int]) -> None:
        """Append the ids of a whole text."""
        known = self.known
        parts = self.specials.split(text) if self.specials and "<" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part])
                continue
            if not part.isascii() and self.unusual.search(part) and self.unassigned.search(part):
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out += self.encode_spelled(w + END)
                continue
            for w in self.words.findall(self.normalise(part)):
                ids = known.get(w)
                if ids is None:
                    ids = self.older.get(w) or self.encode_word(w)
                    if len(w) <= LONGEST_CACHED:
                        if len(known) >= MAX_WORDS:
                            self.older = known
                            self.known = known = {}
                        known[w] = ids
                out += ids

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of consecutive runs of ids, which end at ``ends``: token strings joined by a space."""
        which = ids.astype(np.int64)
        which[ends[ends > np.concatenate([[0], ends[:-1]])] - 1] += self.size
        taken = self.strings.take(pa.array(which))
        _, offsets, data = taken.buffers()
        stops = np.frombuffer(offsets, np.int64, len(which) + 1)
        at = np.concatenate([[0], stops[ends]]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(at), data).cast(pa.string())


@lru_cache(maxsize=2)
def loaded(spec: str) -> WordBpe:
    return WordBpe(spec)


def read_spec(path: str) -> str:
    """The tokenizer file, read on the driver; its size is checked before it is broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(MAX_FILE + 1)
    if len(spec) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    return spec


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: ``doc_id, ids array<int>, decoded string``.

    One map over the rows, without a shuffle.  Null and empty texts give no ids and an empty string;
    repeated rows are encoded each; an empty table gives an empty result.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(spec.value)
        flat: list[int] = []
        ends = []
        for text in batch.column("text").to_pylist():
            bpe.encode(text, flat)
            ends.append(len(flat))
        ids, ends = np.array(flat, np.int32), np.array(ends, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, bpe.decode_all(ids, ends)], ["doc_id", "ids", "decoded"])

    return map_batches(id_text(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded string")
