"""Token counts by a count-only Viterbi over a unigram vocabulary.

Text is cut as the unigram tokenizers with a metaspace pre-tokenizer do: each
space becomes U+2581, one is put in front, and every U+2581 starts a new word.
In a word an Aho-Corasick automaton lists every vocabulary piece by its end,
longest first; the dynamic programme keeps for each position only the best
score and the number of pieces. Tie rules of the tokenizer: a later candidate
replaces an earlier one only with a strictly higher score, candidates for a
position arrive by rising start, a character that is no piece is an unknown
with the lowest score of the vocabulary less 10 and falls back to its UTF-8
bytes, one token a byte. Scores are doubles.

The vocabulary (piece, score) is read once on the driver and broadcast; its
size is that of the file. Defined cases: null and empty texts have 0 tokens
and score 0; repeated rows count alike; extra columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from constella.llm.common import share

SPACE = "▁"


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) in id order from a sentencepiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size())]


def words_of(text: str | None) -> list[str]:
    """The words that the metaspace rule makes of a text."""
    if not text:
        return []
    s = text.replace(" ", SPACE)
    return [SPACE + w for w in (s[1:] if s[0] == SPACE else s).split(SPACE)]


class Viterbi:
    """The automaton and a bounded table of words already counted. Shared as a
    broadcast, it stays with a Python worker from task to task."""

    def __init__(self, pieces: list[tuple[str, float]], remember: int = 500_000):
        self.pieces, self.remember = pieces, remember
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(score for _, score in pieces) - 10.0
        self.automaton, self.counts, self.scores = None, {}, {}

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "counts": {}, "scores": {}}

    def matches(self, word: str):
        """(last position, (length, score)) of every piece in the word, by
        rising end, longest first."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for piece, score in self.pieces:
                self.automaton.add_word(piece, (len(piece), score))
            self.automaton.make_automaton()
        return self.automaton.iter(word)

    def best(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of a word."""
        n = len(word)
        score, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
        if self.singles.issuperset(word):
            for last, (length, piece) in self.matches(word):
                s = score[last + 1 - length] + piece
                if s > score[last + 1]:
                    score[last + 1], count[last + 1] = s, count[last + 1 - length] + 1
            return count[n], score[n]
        done = 0  # positions up to here are final
        for last, (length, piece) in self.matches(word):
            done = self._unknowns(word, score, count, done, last)
            s = score[last + 1 - length] + piece
            if s > score[last + 1]:
                score[last + 1], count[last + 1] = s, count[last + 1 - length] + 1
        self._unknowns(word, score, count, done, n)
        return count[n], score[n]

    def _unknowns(self, word, score, count, done, upto) -> int:
        """Offers the unknown character, last of all, to the positions after
        ``done`` up to ``upto``."""
        for i in range(done, upto):
            if word[i] not in self.singles and score[i] + self.unknown > score[i + 1]:
                score[i + 1] = score[i] + self.unknown
                count[i + 1] = count[i] + len(word[i].encode("utf-8", "surrogatepass"))
        return max(done, upto)

    def totals(self, text: str | None) -> tuple[int, float, int]:
        words = words_of(text)
        counts, scores = self.counts, self.scores
        if len(counts) > self.remember:
            counts.clear()
            scores.clear()
        for w in set(words).difference(counts):
            counts[w], scores[w] = self.best(w)
        return sum(map(counts.__getitem__, words)), sum(map(scores.__getitem__, words)), len(words)


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, score (of the best segmentation), n_pretokens."""
    shared = share(docs.sparkSession, Viterbi(read_pieces(vocabulary)))

    def run(batches):
        model = shared()
        for batch in batches:
            rows = [model.totals(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([r[0] for r in rows], pa.int64()),
                "score": pa.array([float(r[1]) for r in rows], pa.float64()),
                "n_pretokens": pa.array([r[2] for r in rows], pa.int64())})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, score double, n_pretokens long")
