"""Reading level of documents: a linear pairwise ranker calibrated by isotonic regression.

Syntax and vocabulary features are counted over the whole text, in Arrow batches: a dozen regular
expressions over each text in the JVM cost several times as much. The ranker learns from pairs of graded documents which of two reads harder (logistic loss on feature
differences, so only the order of grades counts); isotonic regression of "level k or above" on its
score then gives the score from which a document is more likely than not of level k.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.runtime import Stage

#: Graded rows the model is fitted on, at most; all of them up to that.
FIT_ROWS = 20_000
#: Pairs of graded rows.
PAIRS = 200_000
RIDGE = 1e-3

# English and Indonesian word lists and endings.
LINKING = (
    "although|whenever|whether|which|because|while|before|after|unless|insofar|notwithstanding|presupposing|whereupon|whereas|if|"
    "ketika|meskipun|karena|apakah|setelah|sebelum|selain|kendati|sejauh|sehingga|apabila|supaya|jika|kalau|dengan|maka|niscaya|serta|maupun|beserta"
)
PLAIN = "i|you|we|they|my|it|he|she|go|aku|kamu|kita|kami|dia|ibu|mau|ada|yuk|lagi"
INDONESIAN = "yang|dan|di|itu|ini|dari|ke|pada|untuk|dengan|akun|ada|dia|kita|kami|aku|mau|antara|atau|tidak"
ENGLISH = "the|a|is|of|and|to|it|in|by|at|that|which|i|you|we|my|they|another|your"
NOUN_ENDINGS = "tion|sion|ity|isation|ance|ence|asi|itas|isme|ability|ship"
ADJECTIVE_ENDINGS = "al|ic|ical|ial|ive|ous|ional|ik|if|is"


_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?]+(?=\s|$)|\n+")
_LISTS = [frozenset(words.split("|")) for words in (LINKING, PLAIN, INDONESIAN, ENGLISH)]
_NOUN, _ADJECTIVE = tuple(NOUN_ENDINGS.split("|")), tuple(ADJECTIVE_ENDINGS.split("|"))
#: Words whose traits a worker keeps.
KEPT = 200_000


def _traits(word: str) -> list[float]:
    n = len(word)
    return [n, *[float(n >= k) for k in (5, 7, 9, 11, 13)], float(word.endswith(_NOUN)), float(n >= 7 and word.endswith(_ADJECTIVE)), *[float(word in s) for s in _LISTS]]


class Features:
    """Feature vectors of texts: shares by word of word lengths, endings and word lists, commas, and words a sentence.

    A word's traits are worked out once and kept, so a text costs one pass and a sum over its distinct words.
    """

    def __init__(self):
        self._at: dict[str, int] = {}
        self._rows = np.zeros((1024, len(_traits(""))))

    def _index(self, word: str) -> int:
        i = self._at[word] = len(self._at)
        if i == len(self._rows):
            self._rows = np.concatenate((self._rows, np.zeros_like(self._rows)))
        self._rows[i] = _traits(word)
        return i

    def of(self, text: str | None) -> np.ndarray:
        """Zeros for a text without words, null included."""
        text = text or ""
        counts = Counter(_WORD.findall(text.lower()))
        if len(self._at) + len(counts) > KEPT:
            self._at.clear()
        at = self._at
        index = [at[w] if w in at else self._index(w) for w in counts]
        n = max(1, counts.total())
        sums = np.fromiter(counts.values(), float, len(counts)) @ self._rows[index] if index else np.zeros(self._rows.shape[1])
        sentences = sum(len(s.split(None, 3)) >= 3 for s in _STOP.split(text))
        return np.concatenate((sums / n, [text.count(",") / n, math.log(n / max(1, sentences))]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = Features()
    for batch in batches:
        rows = [made.of(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, x) of documents(doc_id, text)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(_features, f"doc_id {kind}, x array<double>")


@dataclass
class Ranker:
    """Score = weights . (x - mean) / scale; levels[i] holds from score cuts[i - 1] on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    levels: list[int]
    cuts: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def level(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.levels)[np.searchsorted(np.array(self.cuts), self.score(x), side="right")]


def isotonic(score: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pools of adjacent violators: first score, last score and value of each, rising."""
    order = np.argsort(score, kind="stable")
    first, last, value, weight = [], [], [], []
    for i in order:
        first.append(score[i])
        last.append(score[i])
        value.append(float(target[i]))
        weight.append(1.0)
        while len(value) > 1 and (value[-2] >= value[-1] or first[-1] == last[-2]):
            w = weight[-2] + weight[-1]
            value[-2] = (value[-2] * weight[-2] + value[-1] * weight[-1]) / w
            weight[-2], last[-2] = w, last[-1]
            for z in (first, last, value, weight):
                z.pop()
    return np.array(first), np.array(last), np.array(value)


def fit(x: np.ndarray, grades: np.ndarray, pairs: int = PAIRS, seed: int = 5) -> Ranker:
    """Ranker of graded rows. With one grade only, every document gets that grade."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    levels = sorted({int(g) for g in grades})
    weights = np.zeros(x.shape[1])
    if len(levels) == 1:
        return Ranker(mean, scale, weights, levels, [])
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    a, b = rng.integers(len(x), size=(2, pairs))
    above = grades[a] > grades[b]
    apart = z[a[above]] - z[b[above]]
    for _ in range(25):  # Newton steps of the regularised logistic loss
        p = 1 / (1 + np.exp(np.clip(apart @ weights, -30, 30)))
        step = np.linalg.solve((apart * (p * (1 - p))[:, None]).T @ apart / len(apart) + RIDGE * np.eye(len(weights)), apart.T @ p / len(apart) - RIDGE * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    score, cuts = z @ weights, []
    for level in levels[1:]:
        first, last, value = isotonic(score, (grades >= level).astype(float))
        at = int(np.searchsorted(value, 0.5))
        cut = first[0] if at == 0 else np.inf if at == len(value) else (last[at - 1] + first[at]) / 2
        cuts.append(max(cut, cuts[-1] if cuts else -np.inf))
    return Ranker(mean, scale, weights, levels, cuts)


def reading_levels(documents: DataFrame, grades: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score, level) of every row of ``documents(doc_id, text)``.

    ``grades(doc_id, level)`` may grade a document more than once; null grades, and those of
    documents that are not there, are left out. The model is fitted on at most ``fit_rows`` graded rows (those with
    the smallest hash of doc_id). Score and level are null if nothing is graded. Null text counts as empty.
    """
    stage = Stage(documents.sparkSession, "readability")
    x = stage.put(features(documents))
    graded = grades.where("level is not null").select("doc_id", F.col("level").cast("int").alias("level")).join(x.select("doc_id"), "doc_id", "left_semi")
    # ids are chosen before any feature is joined: at most fit_rows rows are broadcast and come to the driver
    chosen = stage.put(graded.orderBy(F.xxhash64("doc_id"), "doc_id", "level").limit(fit_rows))
    sample = x.join(F.broadcast(chosen), "doc_id").select("x", "level").toPandas()
    if not len(sample):
        return x.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("level"))
    model = fit(np.stack(sample["x"].to_numpy()), sample["level"].to_numpy())
    slope = model.weights / model.scale
    score = sum((F.col("x")[i] * float(s) for i, s in enumerate(slope)), F.lit(float(-model.mean @ slope)))
    level = F.lit(model.levels[0])
    for k, cut in zip(model.levels[1:], model.cuts):
        if np.isfinite(cut):
            level = F.when(F.col("score") >= float(cut), F.lit(k)).otherwise(level)
    return x.select("doc_id", score.alias("score")).withColumn("level", level.cast("long"))
