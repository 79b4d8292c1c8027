"""Toxicity by multiple-instance learning: sentences scored from document labels.

A document is a bag of sentences.  A sentence is toxic with probability
p = sigmoid(bias + sum of the weights of its words), and a document with the
noisy-or of its sentences, 1 - prod(1 - p).  Only documents have labels, so the
weights are fitted through the noisy-or; labels are taken to be flipped at times, at
two rates that are fitted as well and are no part of a score.  ``locate`` gives the
sentences to which a document owes its score.

Fitting runs on the driver over at most ``sample`` labelled documents of at most
``sample_chars`` characters, those with the smallest hashes of doc_id, and over the
``vocabulary`` words that tell labels apart best.  The model is a word-to-weight
table of that bounded size, which goes to the executors; documents are scored where
they are read, whole, without a shuffle.

Words are runs of letters, lower-cased; digits and marks separate words, so that
symbols hung on a word do not hide it.  A word counts as itself and, for languages
that inflect and compound, as its proper beginnings of 3 to 7 letters.  Sentences end
at ``. ! ?`` and line feeds.

Defined results: a null or empty text is one empty sentence; a null doc_id is never
held out; repeated rows are all scored alike; with no labels of one kind the model
has no words and scores are all sigmoid(bias); an empty table gives an empty
result; other columns than doc_id and text (doc_id and toxic in labels) are ignored;
null labels are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\n]+")


#: Lengths of beginnings; and how a beginning is written, so that it is no word.
BEGINNINGS, MARK = range(3, 8), "-"
#: Words whose summed weights a process remembers at most.
MEMORY = 200_000


@dataclass(frozen=True)
class Fitting:
    sample: int = 8000
    sample_chars: int = 20_000
    vocabulary: int = 3000
    least_documents: int = 5
    steps: int = 400
    rate: float = 0.1
    ridge: float = 5e-5
    first_bias: float = -6.0


def features(word: str) -> list[str]:
    return [word, *[word[:k] + MARK for k in BEGINNINGS if k < len(word)]]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = Fitting.first_bias
    known: dict[str, float] = field(default_factory=dict, compare=False)

    def weight(self, word: str) -> float:
        """The summed weights of a word's features."""
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            out = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return out

    def evidence(self, lowered: str) -> float:
        """The summed weights of the different words of a sentence."""
        return sum(map(self.weight, set(WORD.findall(lowered))))


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, stripped; one empty sentence if there is none."""
    return [s for s in map(str.strip, SENTENCE_END.split(text or "")) if s] or [""]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, fitting: Fitting) -> DataFrame:
    """At most ``sample`` labelled texts for fitting: (text, toxic)."""
    order = F.xxhash64("doc_id")
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    some = known.orderBy(order, "doc_id", "toxic").limit(fitting.sample)
    texts = docs.select("doc_id", "text").where(F.length("text") <= fitting.sample_chars).join(F.broadcast(some), "doc_id")
    return texts.orderBy(order, "doc_id", "text", "toxic").limit(fitting.sample).select("text", "toxic")


def fit(rows: list[tuple[str, int]], fitting: Fitting = Fitting()) -> Model:
    """Fit words' weights and the bias by gradient steps through the noisy-or."""
    labels = np.array([y for _, y in rows], float)
    if not 0 < labels.sum() < len(labels):
        return Model()
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for (text, _), y in zip(rows, labels, strict=True):
        seen[int(y)].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    n = np.array([len(labels) - labels.sum(), labels.sum()])
    contrast = {}
    for word in seen[1].keys() | seen[0].keys():
        a, b = seen[0][word], seen[1][word]
        if a + b >= fitting.least_documents:
            p = (a + b) / n.sum()
            contrast[word] = abs(b / n[1] - a / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-12)
    words = sorted(contrast, key=lambda w: (-contrast[w], w))[: fitting.vocabulary]
    index = {w: k for k, w in enumerate(words)}
    known: dict[str, list[int]] = {}

    def numbers(word: str) -> list[int]:
        if word not in known:
            known[word] = [index[f] for f in features(word) if f in index]
        return known[word]

    held, sizes = [], []
    for text, _ in rows:
        bag = [[k for w in set(WORD.findall(s.lower())) for k in numbers(w)] for s in sentences(text)]
        held += bag
        sizes.append(len(bag))
    of_doc = np.repeat(np.arange(len(rows)), sizes)
    at = np.repeat(np.arange(len(held)), [len(x) for x in held])
    word = np.array([k for x in held for k in x], int)
    w, bias, flips = np.zeros(len(words)), fitting.first_bias, np.array([-2.0, -2.0])
    first, second = np.zeros(len(w) + 3), np.zeros(len(w) + 3)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, fitting.steps + 1):
        p = sigmoid(bias + np.bincount(at, w[word], len(held)))
        clean = np.exp(np.bincount(of_doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(rows)))
        gone, lost = sigmoid(flips) / 2  # rates of labels 1 on clean and 0 on toxic documents
        said = gone + (1 - gone - lost) * (1 - clean)
        d_said = (said - labels) / np.maximum(said * (1 - said), 1e-6) / len(rows)
        d_sentence = (d_said * (1 - gone - lost) * clean)[of_doc] * p
        slopes = sigmoid(flips) * (1 - sigmoid(flips)) / 2
        grad = np.concatenate(
            [
                np.bincount(word, d_sentence[at], len(w)) + fitting.ridge * w,
                [d_sentence.sum(), (d_said * clean).sum() * slopes[0], -(d_said * (1 - clean)).sum() * slopes[1]],
            ]
        )
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = fitting.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias, flips = w - move[:-3], bias - move[-3], flips - move[-2:]
    return Model({x: float(v) for x, v in zip(words, w, strict=True) if abs(v) > 0.05}, float(bias))


def sentence_scores(text: str | None, model: Model) -> list[tuple[str, float]]:
    out = []
    for s in sentences(text):
        z = model.bias + model.evidence(s.lower())
        out.append((s, float(1 / (1 + np.exp(-np.clip(z, -30, 30))))))
    return out


def document_score(text: str | None, model: Model) -> float:
    """The noisy-or of a text's sentences."""
    z = np.array([model.bias + model.evidence(s.lower()) for s in sentences(text)])
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores = np.array([document_score(t, model) for t in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= 0.5).astype("i4"))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence number, sentence, score) of the sentences that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = [
                (doc_id, k, s, p)
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for k, (s, p) in enumerate(sentence_scores(text, model))
                if p >= least
            ]
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.float64()), strict=True)], names=["doc_id", "number", "sentence", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, number int, sentence string, score double")


def train(docs: DataFrame, labels: DataFrame, fitting: Fitting = Fitting()) -> Model:
    return fit([(r.text, int(r.toxic)) for r in sample(docs, labels, fitting).collect()], fitting)
