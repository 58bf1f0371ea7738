"""Count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary matches of a stretch of text by their ends; dynamic programming carries the
best score and the number of pieces to every end and builds no tokens. Tie rules are those of the usual unigram
decoders: matches that end at a place are tried from the earliest start on, and a later one must be strictly better;
a character without a one-character piece may stand as unknown at the smallest piece score less 10; unknown characters
become their UTF-8 bytes (``byte_fallback``) or are fused to one piece per run.

Text gets one space in front, and spaces become U+2581. Where no piece holds U+2581 behind another character, no piece
crosses the start of a word, so the best path is the sum of those of the words and their counts are remembered (up to
``MEMO`` words a worker). Other vocabularies are decoded over the whole text.

Null and empty texts have no pieces. Repeated rows are counted again; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from drawloom.llm.common import map_batches, texts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 400_000
COUNTS = "doc_id long, n_chars long, n_pieces long, n_unknown long, score double"
_WORDS = re.compile(" +[^ ]*")
_COUNTERS: dict[tuple[str, bool], Counter] = {}


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Text pieces and their scores of a sentencepiece model file; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.singles = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.byte_fallback = byte_fallback
        self.by_word = SPACE in self.automaton and not any(SPACE in piece.lstrip(SPACE) for piece, _ in vocabulary)
        self.memo: dict[str, tuple[int, int, float]] = {}

    def stretch(self, text: str) -> tuple[int, int, float]:
        """Pieces, unknown characters and score of the best path."""
        if not self.singles.issuperset(text):
            return self.stretch_with_unknown(text)
        best, pieces = [], []
        at, top, count = -1, 0.0, 0
        for end, (length, score) in self.automaton.iter(text):  # by end, the longest match first
            if end != at:
                best.append(top)
                pieces.append(count)
                at = end
                top, count = best[end + 1 - length] + score, pieces[end + 1 - length] + 1
            else:
                value = best[end + 1 - length] + score
                if value > top:
                    top, count = value, pieces[end + 1 - length] + 1
        return count, 0, top

    def stretch_with_unknown(self, text: str) -> tuple[int, int, float]:
        n = len(text)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(text):
            matches[end + 1].append(match)
        best, pieces, unknown, open_run = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, start, single = None, 0, False
            for length, score in matches[end]:
                value = best[end - length] + score
                if top is None or value > top:
                    top, start = value, end - length
                single = single or length == 1
            last = end - 1
            if not single and (top is None or best[last] + self.unknown > top):
                best[end] = best[last] + self.unknown
                more = len(text[last].encode()) if self.byte_fallback else 0 if open_run[last] else 1
                pieces[end], unknown[end], open_run[end] = pieces[last] + more, unknown[last] + 1, True
            else:
                best[end], pieces[end], unknown[end] = top, pieces[start] + 1, unknown[start]
        return pieces[n], unknown[n], best[n]

    def count(self, text: str) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        if not self.by_word:
            return self.stretch(SPACE + text.replace(" ", SPACE))
        text = text.replace(SPACE, " ")
        plain = "  " not in text and text[0] != " " and text[-1] != " "
        words = text.split(" ") if plain else [w[1:] for w in _WORDS.findall(" " + text)]
        memo = self.memo
        found = list(map(memo.get, words))
        if None in found:
            for k, known in enumerate(found):
                if known is None:
                    word = words[k]
                    found[k] = known = self.stretch(SPACE + word.replace(" ", SPACE))
                    if len(memo) < MEMO and len(word) < 40:
                        memo[word] = known
        pieces, unknown, score = zip(*found, strict=True)
        return sum(pieces), sum(unknown), sum(score)


def count_tokens(docs: DataFrame, model_path: str, byte_fallback: bool = True) -> DataFrame:
    """Pieces of every whole text (``COUNTS``), without building tokens."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = model_path, byte_fallback
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(read_vocabulary(model_path), byte_fallback)
        whole = texts(batch, "text")
        pieces, unknown, score = zip(*map(_COUNTERS[key].count, whole), strict=True)
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array(map(len, whole), pa.int64()), pa.array(pieces, pa.int64()), pa.array(unknown, pa.int64()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COUNTS.split(", ")])

    return map_batches(docs.select("doc_id", "text"), one, COUNTS)
