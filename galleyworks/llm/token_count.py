"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic
programming carries, for each end, the best score, its number of tokens and whether it ends in an
unknown piece, and no segmentation. Tie rules are those of the unigram tokenizer model: of equally
good paths the one whose last piece is longest stays; a character without a piece of its own costs
the lowest score less 10; neighbouring unknown characters fuse; an unknown run counts its UTF-8
bytes where the vocabulary has all byte pieces.

A text is cut wherever no piece can span: before each run of word-begin marks. A part is counted once
and kept in a table of bounded size. Sums of whole scores (as ranks are) are exact. With fractional scores
the library's sums run through the whole text and are rounded on the way; a part keeps the least margin by which any of its choices was made, and a text in which
rounding could turn a choice is counted in one go, with the sums of the library in its order. So is every text if a piece of the
vocabulary spans the begin of a word. Null and empty texts have 0 tokens. Every text is read whole; repeated rows count alike;
an empty table gives an empty result; other columns pass through, but for one of the name of the result.
"""

from __future__ import annotations

from sys import getsizeof

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of all parts whose counts a worker keeps, what one takes besides its text, and characters of one that is kept.
KEPT, KEPT_EACH, LONGEST_KEPT = 64 << 20, 240, 256
#: More than the relative error of a sum.
ROUNDING = 2.0**-52


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with scores, and whether all 256 byte pieces are there, of a model file; control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, n_bytes = [], 0
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            n_bytes += 1
        elif not (model.is_control(i) or model.is_unknown(i)):
            pieces.append((model.id_to_piece(i), float(model.get_score(i))))
    return pieces, n_bytes == 256


class WordCounter:
    """Numbers of tokens of texts in a vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_known: bool):
        import ahocorasick

        self.exact = all(s == int(s) for _, s in pieces)
        self.cuttable = not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.most = max(abs(self.unknown), *(abs(s) for _, s in pieces))
        self.bytes_known = bytes_known
        self.kept: dict[str, tuple[int, float]] = {}
        self.room = KEPT

    def part(self, part: str) -> tuple[int, float]:
        """Tokens and margin of a part, kept for the next time."""
        if (found := self.kept.get(part)) is None:
            found = self.count(part)
            if len(part) <= LONGEST_KEPT:
                self.room -= getsizeof(part) + KEPT_EACH
                if self.room < 0:
                    self.kept.clear()
                    self.room = KEPT
                self.kept[part] = found
        return found

    def count(self, text: str) -> tuple[int, float]:
        """Tokens on the best path through text, and the least margin between a path and another to the same place."""
        n, margin = len(text), float("inf")
        score, tokens, open_run = [0.0], [0], [False]
        pos, best, at, single = 1, None, 0, False

        def close() -> None:
            """Settle the end `pos`, all of whose pieces have been seen, and go to the next."""
            nonlocal pos, best, at, single, margin
            unknown = False
            if not single:
                c = score[pos - 1] + self.unknown
                if best is not None:
                    margin = min(margin, abs(c - best))
                if best is None or c > best:
                    best, at, unknown = c, pos - 1, True
            if not unknown:
                tokens.append(tokens[at] + 1)
            elif self.bytes_known:
                tokens.append(tokens[at] + len(text[at].encode("utf-8", "surrogatepass")))
            else:
                tokens.append(tokens[at] + (not open_run[at]))
            score.append(best)
            open_run.append(unknown)
            pos, best, single = pos + 1, None, False

        for last, (size, s) in self.automaton.iter(text):  # by end; longest first for each
            while pos <= last:
                close()
            c = score[pos - size] + s
            if best is None:
                best, at = c, pos - size
            else:
                margin = min(margin, abs(c - best))
                if c > best:
                    best, at = c, pos - size
            if size == 1:
                single = True
        while pos <= n:
            close()
        return tokens[n], margin

    def whole(self, text: str) -> int:
        """Tokens of a text after the mark is put before it and in place of each space."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.cuttable:
            return self.count(marked)[0]
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            parts = list(runs(marked))
        else:
            parts = [MARK + w for w in text.split(" ")]
        total, least = 0, float("inf")
        for part in parts:
            n, margin = self.part(part)
            total += n
            least = min(least, margin)
        if not self.exact and len(parts) > 1 and least <= 4 * len(marked) ** 2 * self.most * ROUNDING:
            return self.count(marked)[0]
        return total


def runs(marked: str):
    """The parts of a text: a run of marks and what follows it."""
    a, n = 0, len(marked)
    while a < n:
        b = a
        while b < n and marked[b] == MARK:
            b += 1
        b = marked.find(MARK, b)
        b = n if b < 0 else b
        yield marked[a:b]
        a = b


_loaded: dict[str, WordCounter] = {}


def with_token_count(df: DataFrame, vocabulary: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each whole text; the vocabulary file is sent to the executors."""
    file = vocabulary.rsplit("/", 1)[-1]
    df.sparkSession.sparkContext.addFile(vocabulary)

    @F.arrow_udf("long")
    def tokens(column: pa.Array) -> pa.Array:
        if file not in _loaded:
            _loaded[file] = WordCounter(*read_vocabulary(SparkFiles.get(file)))
        count = _loaded[file].whole
        return pa.array([count(t.as_py() or "") for t in column], pa.int64())

    return df.withColumn(name, tokens(F.col(text)))
