"""Token counts by a count-only Viterbi.

A unigram tokenizer splits a text at spaces, marks each part's beginning with
U+2581 and takes, of all ways to cut the part into vocabulary pieces, the one
of the highest summed score.  Here an Aho-Corasick automaton over the
vocabulary lists all matches in a part by their end, and a dynamic programme
carries only the best score and its number of pieces: no lattice, no pieces.

Tie rules, as in the public unigram implementation this agrees with: of equal
scores for one end the earliest start, thus the longest piece, stays; a
character without a piece of its own may be taken as unknown at the lowest
score less 10; adjoining unknowns are one piece, or with byte fallback one
piece for each byte.

Parts repeat, so each task keeps a bounded table of counts by part.  The
vocabulary, a parameter, is the only thing sent to the executors (a list of
pieces, whose number is fixed by the tokenizer).

Defined cases: null or empty text has 0 tokens; a text of any length is
counted whole; null or repeated doc_ids are counted row by row.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 400_000
DEFAULT_MODEL = os.environ.get("MEMLAKE_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores in id order, the unknown piece's id, and whether bytes stand in for unknown characters."""

    pieces: tuple[tuple[str, float], ...]
    unknown: int
    byte_fallback: bool


def load_model(path: str = DEFAULT_MODEL) -> Vocabulary:
    """The pieces and scores of a sentencepiece file, read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    return Vocabulary(tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(n)), sp.unk_id(), any(sp.is_byte(i) for i in range(n)))


class Counter:
    """Counts the pieces of texts; one per task."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary.pieces) - UNKNOWN_PENALTY
        self.bytes = vocabulary.byte_fallback
        # a line feed in no piece is unknown wherever it stands; whole scores add up exactly in any order
        self.lines_apart = self.bytes and all("\n" not in p for p, _ in vocabulary.pieces) and all(float(s).is_integer() for _, s in vocabulary.pieces)
        self.known: dict[str, tuple[float, int]] = {}
        self.inside: dict[str, tuple[float, int]] = {}
        self.cache = cache

    def part(self, text: str) -> tuple[float, int]:
        """Best score of a marked part, and its number of pieces."""
        n = len(text)
        score: list[float | None] = [None] * (n + 1)
        count, unknown, single = [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        matches = self.automaton.iter(text)
        end, (length, value) = next(matches, (n, (0, 0.0)))
        for i in range(n):
            best, take, one = None, 0, False
            # matches that end here, the longest first; an equal score does not displace it
            found = []
            while end == i:
                found.append((length, value))
                end, (length, value) = next(matches, (n, (0, 0.0)))
            found.sort(reverse=True)
            for length_, value_ in found:
                s = score[i + 1 - length_] + value_
                if best is None or s > best:
                    best, take = s, length_
                one = one or length_ == 1
            s = score[i] + self.unknown
            if not one and (best is None or s > best):
                score[i + 1], unknown[i + 1] = s, True
                if self.bytes:
                    count[i + 1] = count[i] + len(text[i].encode("utf-8", "surrogatepass"))
                else:
                    count[i + 1] = count[i] + (not unknown[i])
            else:
                score[i + 1], count[i + 1] = best, count[i + 1 - take] + 1
        return score[n], count[n]

    def marked(self, part: str) -> tuple[float, int]:
        got = self.known.get(part)
        if got is None:
            if self.lines_apart and "\n" in part:
                first, *rest = part.split("\n")
                score, count = self.marked(first)
                for line in rest:
                    s, c = self.inner(line) if line else (0.0, 0)
                    score, count = score + self.unknown + s, count + 1 + c
                return score, count
            got = self.part(MARK + part)
            if len(self.known) >= self.cache:
                self.known.clear()
            self.known[part] = got
        return got

    def inner(self, line: str) -> tuple[float, int]:
        got = self.inside.get(line)
        if got is None:
            got = self.part(line)
            if len(self.inside) >= self.cache:
                self.inside.clear()
            self.inside[line] = got
        return got

    def text(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        parts = text.replace(MARK, " ").split(" ")
        if parts[0] == "":
            del parts[0]
        score, count, known = 0.0, 0, self.known
        for p in parts:
            s, c = known.get(p) or self.marked(p)
            score += s
            count += c
        return score, count


def count_tokens(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, n_tokens, score) for every row of docs: one scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(shared.value)
            got = [counter.text(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array([c for _, c in got], pa.int64()), "score": pa.array([s for s, _ in got], pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
