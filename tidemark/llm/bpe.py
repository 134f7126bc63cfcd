"""Exact encoding and decoding for SentencePiece models of merge type.

A text is encoded left to right instead of by a queue of merges: the longest matching piece is
tried first, a piece may follow another only if no merge would have crossed their border, and a
position from which no piece leads on is noted as failed and never tried again. The one sequence
in which all neighbours are compatible is what merging gives.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, in_slices

MARK = "▁"
#: Words whose ids a worker remembers, in each of two generations: when the younger is full, the
#: older one goes and the younger takes its place. A word takes about 200 bytes.
REMEMBERED_WORDS = 300_000
REMEMBERED_PAIRS = 150_000
#: Texts that show whether a model normalises, prefixes and falls back as this module does.
PROBES = ("", " ", "a", "  a  b ", "a\nb\t", "é́ ﬁ Ａ", "日本 \U0001f600", "<s></s>", f"x{MARK} y")


class PieceCodec:
    """Encoder and decoder with the pieces of a model file.

    Made for models that leave text as it is, mark spaces, put one mark in front and fall back to
    bytes; any other model is refused when it is loaded.
    """

    def __init__(self, model_file: str, remembered_words: int | None = None):
        self.most_words = remembered_words or REMEMBERED_WORDS
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [
            i
            for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.ids = {self.pieces[i]: i for i in plain}
        # Merges happen in the order of falling scores; equal scores are one rank.
        scores = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self.rank = {i: scores[model.get_score(i)] for i in plain}
        self.letters = letters = frozenset(c for piece in self.ids for c in piece)
        if len(self.bytes) != 256 or any(c not in self.ids for c in letters):
            raise ValueError("the model needs byte fallback and a piece for each of its letters")
        self.first: dict[int, int] = {}
        self.last: dict[int, int] = {}
        self.length = [len(piece) for piece in self.pieces]
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            made = self._merged(piece)
            # A piece that merging never makes is not a candidate; letters need not be looked for.
            if made is not None and len(piece) > 1:
                self.first[i], self.last[i] = made
                self.matcher.add_word(piece, (len(piece) - 1, i))
        self.matcher.make_automaton()
        self.shorter = {i: self._prefix(piece) for piece, i in self.ids.items()}
        # A space mark never follows another letter in a piece, nor is a line end part of one, so
        # a text may be cut there and its words encoded one by one.
        if any(MARK in piece.lstrip(MARK) or "\n" in piece for piece in self.ids):
            self.words = re.compile("(?s).+")
        else:
            self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.unknown = re.compile("([^" + re.escape("".join(sorted(letters))) + "])")
        self.shown: list[str] = [p.replace(MARK, " ") for p in self.pieces]
        for i in range(size):
            if model.is_unknown(i):
                self.shown[i] = " ⁇ "
            elif model.is_control(i):
                self.shown[i] = ""
        self.high = {i for value, i in self.bytes.items() if value >= 128}
        self.value = {i: value for value, i in self.bytes.items()}
        for value, i in self.bytes.items():
            if value < 128:
                self.shown[i] = chr(value)
        # Ids as packed numbers, two bytes each where that is enough.
        self.packed = "H" if size <= 1 << 16 else "I"
        self.number = [str(i) for i in range(size)]
        self.remembered: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        if any(self.encode(t) != model.encode(t) or self.decode(model.encode(t)) != model.decode(model.encode(t)) for t in PROBES):
            raise ValueError("the model normalises text in a way that is not supported")

    def _merged(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge completes `piece`; None if merging does not make it whole."""
        parts = [self.ids[c] for c in piece]
        made = (-1, -1)
        while len(parts) > 1:
            best, at = math.inf, -1
            for k in range(len(parts) - 1):
                whole = self.ids.get(self.pieces[parts[k]] + self.pieces[parts[k + 1]])
                if whole is not None and self.rank[whole] < best:
                    best, at = self.rank[whole], k
            if at < 0:
                return None
            made = (parts[at], parts[at + 1])
            parts[at : at + 2] = [self.ids[self.pieces[made[0]] + self.pieces[made[1]]]]
        return made

    def _prefix(self, piece: str) -> int:
        """The longest usable piece that `piece` begins with, itself excluded; -1 if there is none."""
        for n in range(len(piece) - 1, 0, -1):
            i = self.ids.get(piece[:n], -1)
            if i >= 0 and (n == 1 or i in self.first):
                return i
        return -1

    def compatible(self, a: int, b: int) -> bool:
        """Whether `b` may follow `a`: re-merges both and looks for a merge across their border.

        The two are taken apart in the reverse order of their making, so that each pair of border
        pieces is one that stood side by side. A merge across the border would have come first if
        its rank is lower than that of the merges which took up the border pieces; among equal
        ranks the leftmost merge comes first.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        pieces, rank, ids = self.pieces, self.rank, self.ids
        x, y, x_gone, y_gone = a, b, math.inf, math.inf
        fits = True
        while True:
            across = ids.get(pieces[x] + pieces[y])
            if across is not None and rank[across] < x_gone and rank[across] <= y_gone:
                fits = False
                break
            x_made = rank[x] if x in self.last else -1
            y_made = rank[y] if y in self.first else -1
            if x_made < 0 and y_made < 0:
                break
            if x_made > y_made:
                x, x_gone = self.last[x], x_made
            else:
                y, y_gone = self.first[y], y_made
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = fits
        return fits

    def _encode_known(self, text: str) -> list[int]:
        """Ids of a text all of whose letters have pieces."""
        longest = [self.ids[c] for c in text]
        # Matches come in the order of their ends, so the last one from a place is the longest.
        for end, (back, i) in self.matcher.iter(text):
            longest[end - back] = i
        size = len(text)
        if self.length[longest[0]] == size:
            return [longest[0]]
        length, shorter, pairs = self.length, self.shorter, self.pairs
        out: list[int] = []
        at, failed, piece, last = 0, 0, longest[0], -1
        while at < size:
            while piece >= 0:
                end = at + length[piece]
                if not failed >> end & 1:
                    if last < 0:
                        break
                    fits = pairs.get((last, piece))
                    if fits or fits is None and self.compatible(last, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at, last = end, piece
                piece = longest[at] if at < size else -1
            else:
                failed |= 1 << at
                gone = out.pop()
                at -= length[gone]
                last = out[-1] if out else -1
                piece = shorter[gone]
        return out

    def _word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            if self.letters.issuperset(word):
                ids = self._encode_known(word)
            else:
                ids = []
                # Every second part is a letter without a piece.
                for k, part in enumerate(self.unknown.split(word)):
                    if k % 2:
                        ids += [self.bytes[x] for x in part.encode("utf-8", "replace")]
                    elif part:
                        ids += self._encode_known(part)
            found = array(self.packed, ids).tobytes()
        if len(word) <= 64:
            if len(self.remembered) >= self.most_words:
                self.remembered, self.older = {}, self.remembered
            self.remembered[word] = found
        return found

    def packed_ids(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.empty(0, dtype=self.packed)
        word, known = self._word, self.remembered.get
        # A word's ids are never empty, so what is not found is not remembered.
        found = b"".join([known(w) or word(w) for w in self.words.findall(MARK + text.replace(" ", MARK))])
        return np.frombuffer(found, dtype=self.packed)

    def encode(self, text: str) -> list[int]:
        return self.packed_ids(text).tolist()

    def forget(self) -> None:
        """Give the memory of remembered words back."""
        self.remembered, self.older, self.pairs = {}, {}, {}

    def decode(self, ids: Sequence[int]) -> str:
        if self.high.isdisjoint(ids):
            text = "".join([self.shown[i] for i in ids])
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                if i in self.value:
                    run.append(self.value[i])
                    continue
                if run:
                    parts.append(_utf8(bytes(run)))
                    run.clear()
                parts.append(self.shown[i])
            text = "".join(parts) + _utf8(bytes(run))
        # The mark that was put in front goes; control pieces before it do not show.
        leading = next((i for i in ids if self.shown[i]), None)
        return text[1:] if leading is not None and self.pieces[leading].startswith(MARK) else text


def _utf8(data: bytes) -> str:
    """The text of `data`; every byte that is not part of a whole letter becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def codec(model_file: str, remembered_words: int = REMEMBERED_WORDS) -> PieceCodec:
    """One codec per worker, model and size of memory."""
    return PieceCodec(model_file, remembered_words)


def encode_column(
    docs: DataFrame, model_file: str, text: str = "text", out: str = "ids", remembered_words: int = REMEMBERED_WORDS
) -> DataFrame:
    """`docs` with the ids of column `text` in `out`, a column of this name replaced; null text has none."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = codec(model_file, remembered_words)
        for texts in batches:
            parts = [pa.array([], pa.list_(pa.int32()))]
            for part in in_slices(texts):
                found = [pieces.packed_ids(t or "") for t in part]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                parts.append(pa.ListArray.from_arrays(ends, np.concatenate(found).astype(np.int32)))
            yield pa.concat_arrays(parts)
        pieces.forget()
        give_back()

    return docs.withColumn(out, ids(F.col(text)))


def decode_column(
    docs: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded", remembered_words: int = REMEMBERED_WORDS
) -> DataFrame:
    """`docs` with the text of the ids in column `ids` in `out`; null ids give empty text."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # The same as in encoding, so that a worker holds one.
        pieces = codec(model_file, remembered_words)
        for rows in batches:
            parts = [pa.array([], pa.string())]
            for part in in_slices(rows):
                parts.append(pa.array(["" if row is None else pieces.decode(row) for row in part], pa.string()))
            yield pa.concat_arrays(parts)

    return docs.withColumn(out, text(F.col(ids)))


def token_digest(docs: DataFrame, model_file: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The whole text is encoded (null counts as empty, and has no ids) and its ids are decoded again.
    Only doc_id and text are read; repeated rows are all kept. The model file must be found under
    the same path on every executor.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = codec(model_file)
        for texts in batches:
            rows = []
            for text in texts:
                ids = pieces.encode(text or "")
                rows.append(
                    (
                        len(ids),
                        sha256(",".join([pieces.number[i] for i in ids]).encode()).hexdigest(),
                        sha256(pieces.decode(ids).encode()).hexdigest(),
                    )
                )
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(F.col("text")).alias("_d")).select("doc_id", "_d.*")
