"""Token counts of a unigram vocabulary, without the tokens.

Aho-Corasick enumerates every piece that ends at each place; the Viterbi step keeps the best score
and the number of pieces on its path, no back pointers.  Ties are decided as the tokenizer does: the
path whose last piece starts first stays, and a later one must be strictly better.  A character
without a piece of its own costs ten less than the worst piece and counts its bytes.

The text is cut where no piece can cross, and the counts of short chunks are cached.
"""

from __future__ import annotations

import hashlib
import pickle

import ahocorasick
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import id_text, map_batches

#: What stands for a space; what an unknown character costs below the worst piece.
SPACE, PENALTY = "▁", 10.0
MAX_FILE, MAX_CHUNKS, LONGEST_CACHED = 64 << 20, 1 << 18, 48


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, in the order of their ids."""
    with open(path, "rb") as f:
        blob = f.read(MAX_FILE + 1)
    if len(blob) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    m = sentencepiece.SentencePieceProcessor(model_proto=blob)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("a piece goes on after a space")
        line = "\n" if not any("\n" in p and len(p) > 1 for p, _ in pieces) else ""
        self.chunks = regex.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n" if line else ""))
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def chunk(self, s: str) -> int:
        """Pieces on the best path through a chunk."""
        n = len(s)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        at, score, pieces, single = 0, None, 0, False

        def close(upto: int) -> None:
            """Settle the places after ``at`` up to ``upto``, with the unknown character as the last choice."""
            nonlocal at, score, pieces, single
            while at < upto:
                if at:
                    if not single and (score is None or best[at - 1] + self.unknown > score):
                        score, pieces = best[at - 1] + self.unknown, count[at - 1] + len(s[at - 1].encode())
                    best[at], count[at] = score, pieces
                at, score, pieces, single = at + 1, None, 0, False

        for end, (length, value) in self.find.iter(s):  # by end, then from the longest to the shortest
            if end + 1 != at:
                close(end + 1)
            start = end + 1 - length
            if score is None or best[start] + value > score:
                score, pieces = best[start] + value, count[start] + 1
            single = single or length == 1
        close(n + 1)
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a whole text; an empty one has none."""
        if not text:
            return 0
        known, total = self.known, 0
        for c in self.chunks.findall(SPACE + text.replace(" ", SPACE)):
            k = known.get(c)
            if k is None:
                k = self.older.get(c) or self.chunk(c)
                if len(c) <= LONGEST_CACHED:
                    if len(known) >= MAX_CHUNKS:
                        self.older = known
                        self.known = known = {}
                    known[c] = k
            total += k
        return total


_live: dict[str, Counter] = {}


def counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of every whole text, in one map without a shuffle.

    The vocabulary and its scores are those of the model file at ``path``.  Null and empty texts have
    no tokens; repeated rows are counted each; an empty table gives an empty result.
    """
    blob = pickle.dumps(read_pieces(path))
    tag, sent = hashlib.sha256(blob).hexdigest(), docs.sparkSession.sparkContext.broadcast(blob)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if tag not in _live:
            _live.clear()
            _live[tag] = Counter(pickle.loads(sent.value))
        n = [_live[tag].count(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return map_batches(id_text(docs, id_col, text_col), run, "doc_id long, n_tokens long")
