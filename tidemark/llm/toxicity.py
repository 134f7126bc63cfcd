"""Toxicity classifier: a support vector machine on a gap-weighted subsequence kernel.

Words are compared by the letter sequences they share, gaps allowed, so an insult with letters
put in, left out or spaced out still resembles itself. Words are mapped to Nyström features of
chosen landmark words, a linear machine gives each word a margin, and a text's margins are
calibrated to a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fit_logistic, fold, give_back, in_slices, labelled_sample, logistic, positive_share

#: Letters of a shared subsequence; how much each letter of its span counts; sharpening power.
ORDER = 3
DECAY = 0.9
POWER = 3
#: Words longer than this are looked at in windows of this length that overlap by half.
WINDOW = 24
LANDMARKS = 128
#: Standard errors by which a landmark must be more frequent in toxic texts.
LEAST_EXCESS = 2.0
#: In the calibration a clean text weighs as much as this many toxic ones, for most texts are clean.
CLEAN_WEIGHT = 3.0
#: Disguised forms of a landmark together weigh this much of the landmark in training.
DISGUISED_WEIGHT = 1.0
#: Texts whose new words are looked at together.
TEXTS_AT_ONCE = 256
#: Training takes at most this many texts of either class, of at most so many characters each.
PER_CLASS = 1500
MAX_CHARS = 8_000
#: Words without a margin that a worker remembers, in each of two generations.
REMEMBERED_WORDS = 100_000

#: Characters written in place of letters.
LOOKALIKES = str.maketrans("01345@$", "oieasas")
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][\s.*_-]+){3,}[^\W\d_](?!\S)")
NOT_LETTERS = re.compile(r"[\W\d_]+")
LETTER_BITS = np.uint64(61)


def plain_words(text: str) -> set[str]:
    """The distinct words of a text in lower case; letters standing apart are also joined."""
    text = text.lower()
    words = set(text.split())
    for run in SPACED.findall(text):
        words.add(NOT_LETTERS.sub("", run))
    return words


def letters_of(word: str) -> str:
    """The letters of a word, look-alikes inside it read as letters; marks around it are dropped."""
    return NOT_LETTERS.sub("", word.strip("#*$%&|<>!?.,;:\"'()[]{}-_+=/\\~`").translate(LOOKALIKES))


def _codes(words: Sequence[str], pad: int) -> np.ndarray:
    """Code points, one row a word of at most WINDOW letters, filled up with `pad`."""
    width = max(map(len, words), default=1) or 1
    points = np.array(words, dtype=f"U{width}").view(np.int32).reshape(len(words), width)
    return np.where(points == 0, pad, points)


def _decay(n: int) -> np.ndarray:
    at = np.arange(n)
    gap = at[None, :] - at[:, None] - 1
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0.0).astype(np.float32)


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The kernel of each pair of rows of `s` and `t`: the sum over common subsequences of ORDER
    letters of DECAY to the power of both their spans, summed over all places."""
    same = (s[:, :, None] == t[:, None, :]).astype(np.float32) * DECAY**2
    ends, down, right = same, _decay(s.shape[1]).T, _decay(t.shape[1])
    for _ in range(ORDER - 1):
        ends = same * (down @ ends @ right)
    return ends.sum(axis=(1, 2), dtype=np.float64)


def _self_kernel(words: Sequence[str]) -> np.ndarray:
    return subsequence_kernel(_codes(words, -1), _codes(words, -2))


def _masks(words: Sequence[str]) -> np.ndarray:
    """A bit for every letter a word has."""
    sizes = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    bits = np.left_shift(np.uint64(1), points % LETTER_BITS)
    return np.bitwise_or.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]))


@dataclass
class KernelMachine:
    """Landmarks, the weight of each in a word's margin, and the calibration of a text's margins."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    calibration: tuple[float, ...]
    prior: float
    _clean: set[str] = field(default_factory=set, repr=False)
    _older: set[str] = field(default_factory=set, repr=False)
    _found: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if self.landmarks:
            self._codes = _codes(self.landmarks, -2)
            self._norms = np.sqrt(_self_kernel(self.landmarks))
            self._masks = _masks(self.landmarks)
            self._sizes = np.array([len(w) for w in self.landmarks])
            self._spare = (np.bitwise_count(self._masks) >= 5).astype(np.uint8)

    def similar(self, words: Sequence[str]) -> np.ndarray:
        """Sharpened, normalised kernel of every word with every landmark.

        It is taken as 0 where a word lacks more than one of a landmark's letters (any, if the
        landmark has fewer than five), or is shorter by more than two; the sharpened kernel is
        next to nothing there, and most words need no more.
        """
        out = np.zeros((len(words), len(self.landmarks)))
        if not words:
            return out
        lacking = np.bitwise_count(self._masks[None, :] & ~_masks(words)[:, None])
        sizes = np.array([len(w) for w in words])
        row, col = np.nonzero((lacking <= self._spare) & (sizes[:, None] >= self._sizes[None, :] - 2))
        used, row_of = np.unique(row, return_inverse=True)
        if not len(used):
            return out
        chosen = [words[i] for i in used]
        norms = np.concatenate([_self_kernel(chosen[at : at + 1024]) for at in range(0, len(chosen), 1024)])
        norms = np.sqrt(np.maximum(norms, 1e-12))
        codes = _codes(chosen, -1)
        # Words of like length together, so that little is filled up.
        order = np.argsort(sizes[row], kind="stable")
        for at in range(0, len(order), 1024):
            part = order[at : at + 1024]
            longest, widest = sizes[row[part]].max(), self._sizes[col[part]].max()
            k = subsequence_kernel(codes[row_of[part], :longest], self._codes[col[part], :widest])
            out[row[part], col[part]] = (k / norms[row_of[part]] / self._norms[col[part]]) ** POWER
        return out

    def word_margins(self, words: Sequence[str]) -> list[float]:
        """The margin of each word; that of its best window for a long one."""
        pieces, owner = [], []
        for i, word in enumerate(words):
            core = letters_of(word)
            if len(core) < ORDER:
                continue
            for at in range(0, max(1, len(core) - WINDOW // 2), WINDOW // 2):
                pieces.append(core[at : at + WINDOW])
                owner.append(i)
        best = np.full(len(words), self.bias)
        for at in range(0, len(pieces), 8192):
            margins = self.similar(pieces[at : at + 8192]) @ self.weights + self.bias
            np.maximum.at(best, owner[at : at + 8192], margins)
        return best.tolist()

    def look_up(self, bags: Sequence[set[str]]) -> list[list[float]]:
        """The positive margins among the words of each bag."""
        fresh = set().union(*bags) - self._clean
        known = {w for w in fresh if w in self._found}
        fresh -= known
        # Words about to leave the memory are kept if they are used.
        self._remember(fresh & self._older)
        fresh -= self._clean
        margins = dict.fromkeys(known, 0.0)
        words = sorted(fresh)
        clean = set(words)
        for word, margin in zip(words, self.word_margins(words)):
            if margin > 0:
                margins[word] = self._found[word] = margin
                clean.discard(word)
        for word in known:
            margins[word] = self._found[word]
        self._remember(clean)
        if len(self._found) > REMEMBERED_WORDS:
            self._found.clear()
        return [[margins[w] for w in sorted(margins.keys() & bag)] for bag in bags]

    def _remember(self, words: set[str]) -> None:
        if len(self._clean) > REMEMBERED_WORDS:
            self._older, self._clean = self._clean, set()
        self._clean |= words

    def forget(self) -> None:
        """Give the memory of words back."""
        self._clean, self._older, self._found = set(), set(), {}

    def features(self, texts: Sequence[str]) -> np.ndarray:
        """For each text its largest margin, the sum of its margins, and its length."""
        found = self.look_up([plain_words(t) for t in texts])
        return np.array(
            [(max(m, default=0.0), math.log1p(sum(m)), math.log1p(len(t)) / 10) for t, m in zip(texts, found)]
        ).reshape(-1, 3)

    def scores(self, texts: Sequence[str | None]) -> list[float]:
        """The score of each whole text; `prior` for texts without a character."""
        if not self.landmarks:
            return [self.prior] * len(texts)
        out: list[float] = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts[at : at + TEXTS_AT_ONCE]
            z = self.features([t or "" for t in part]) @ np.array(self.calibration[:-1]) + self.calibration[-1]
            out += [logistic(x) if t else self.prior for x, t in zip(z.tolist(), part)]
        return out

    def __getstate__(self) -> dict:
        return {"args": (self.landmarks, self.weights, self.bias, self.calibration, self.prior)}

    def __setstate__(self, state: dict) -> None:
        self.__init__(*state["args"])


def _squared_hinge(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, the bias last.

    Each row of `x` stands for examples of both classes, with the weights `toxic` and `clean`.
    """
    x = np.column_stack([x, np.ones(len(x))])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    up, down = toxic, clean
    for _ in range(30):
        w = np.linalg.solve((x * (up + down)[:, None]).T @ x + penalty, x.T @ (up - down))
        margin = x @ w
        now = np.where(margin < 1, toxic, 0), np.where(margin > -1, clean, 0)
        if (now[0] == up).all() and (now[1] == down).all():
            break
        up, down = now
    return w


def disguised(word: str) -> set[str]:
    """The word with a letter put in, or one doubled, after any but its last letter."""
    return {word[:k] + c + word[k:] for k in range(1, len(word)) for c in ("x", "h", word[k])}


def train(rows: Sequence[tuple[str, int]], prior: float | None = None) -> KernelMachine:
    """A machine from labelled texts; with a class missing every score is `prior`, by default the
    share of toxic rows."""
    rows = [(t, y) for t, y in dict.fromkeys(rows) if t]
    n_toxic = sum(y for _, y in rows)
    if prior is None:
        prior = 0.0 if not rows else n_toxic / (len(rows) + 2)
    if not n_toxic or n_toxic == len(rows):
        return KernelMachine([], np.zeros(0), 0.0, (), prior)
    seen_in = (Counter(), Counter())
    for text, label in rows:
        seen_in[label].update({core for w in plain_words(text) if len(core := letters_of(w)[:WINDOW]) >= ORDER})
    clean, toxic = seen_in
    n_clean = len(rows) - n_toxic
    # How much more often a word stands in toxic texts, in standard errors; ties by the word.
    def excess(w: str) -> float:
        a, b = (toxic[w] + 0.5) / (n_toxic + 1), (clean[w] + 0.5) / (n_clean + 1)
        return (a - b) / math.sqrt(a * (1 - a) / n_toxic + b * (1 - b) / n_clean)

    ranked = sorted((w for w in toxic if toxic[w] >= 2), key=lambda w: (-excess(w), w))
    landmarks = [w for w in ranked[:LANDMARKS] if excess(w) >= LEAST_EXCESS] or ranked[:10]
    if not landmarks:
        return KernelMachine([], np.zeros(0), 0.0, (), prior)
    draft = KernelMachine(landmarks, np.zeros(len(landmarks)), 0.0, (), prior)
    # Nyström: features in which the products of landmarks are their kernels.
    values, vectors = np.linalg.eigh(draft.similar(landmarks) + 1e-6 * np.eye(len(landmarks)))
    # What the screen takes as 0 can make the matrix slightly indefinite.
    values = np.maximum(values, 1e-3)
    root = vectors @ np.diag(values**-0.5) @ vectors.T
    # A word of toxic texts counts as far as it is more frequent there than in clean ones. Words
    # that resemble no landmark are one point, as they have all but the same features.
    words = sorted(set(toxic) | set(clean))
    points, shares = [np.zeros((1, len(landmarks)))], [np.zeros((1, 2))]
    for at in range(0, len(words), 2048):
        part = words[at : at + 2048]
        near = draft.similar(part)
        a = np.array([toxic[w] for w in part]) / n_toxic
        b = np.array([clean[w] for w in part]) / n_clean
        share = np.column_stack([np.maximum(a - b, 0), b])
        like = (near > 0.01).any(axis=1)
        points.append(near[like])
        shares.append(share[like])
        shares[0] += share[~like].sum(axis=0)
    # Written with a letter put in or doubled, a landmark is as toxic as the landmark itself.
    for word in landmarks:
        forms = sorted(disguised(word))
        points.append(draft.similar(forms))
        weight = max(toxic[word] / n_toxic - clean[word] / n_clean, 0) * DISGUISED_WEIGHT / len(forms)
        shares.append(np.tile([weight, 0.0], (len(forms), 1)))
    share = np.concatenate(shares)
    w = _squared_hinge(np.concatenate(points) @ root, share[:, 0], share[:, 1], ridge=0.01)
    machine = KernelMachine(landmarks, root @ w[:-1], float(w[-1]), (), prior)
    seen = np.concatenate(
        [machine.features([t for t, _ in rows[at : at + TEXTS_AT_ONCE]]) for at in range(0, len(rows), TEXTS_AT_ONCE)]
    )
    machine.calibration = tuple(fit_logistic(seen, np.array([y for _, y in rows]), weight_0=CLEAN_WEIGHT).tolist())
    return machine


def scorer(machine: KernelMachine) -> Column:
    """The score of column `text`, computed over the whole text."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([x for part in in_slices(texts, TEXTS_AT_ONCE) for x in machine.scores(part)], pa.float64())
        machine.forget()
        give_back()

    return score(F.col("text"))


def trained_machine(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> KernelMachine:
    """A machine from a bounded sample of the labelled rows outside the held-out fold."""
    keep = fold("doc_id", folds) != held_out
    prior = positive_share(labels, "toxic", keep, 0)
    return train(labelled_sample(docs, labels, "toxic", keep, PER_CLASS, MAX_CHARS), prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """The toxicity of every document: doc_id, held_out, score (higher: toxic likelier), predicted.

    Labels are learnt from rows outside the held-out fold only. Null and empty texts get the share
    of toxic rows among all those labels, however many there are. Only doc_id and text of `docs` are
    read; repeated rows are scored alike.
    """
    machine = trained_machine(docs, labels, folds, held_out)
    scored = docs.select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), scorer(machine).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
