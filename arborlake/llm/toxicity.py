"""Toxicity by a counterfactually regularised linear classifier.

Features of a text are the distinct lower-case words and the beginnings of words
(``PREFIXES`` letters), as present or absent, so length and repetition do not count. A
logistic regression is fitted on labelled rows with both classes weighing the same. For
labelled sentences that mention an identity term, the term is swapped for the other terms
of its group, and the squared change of the score is penalised: a term gets no weight of
its own from the company that it keeps, and neutral mentions are not taken for abuse.

The fit uses at most ``SAMPLE_ROWS`` labelled rows of each class, those with the smallest
hash of their id; features are chosen and weighted in one task on that bounded sample. The
model (at most ``MOST_FEATURES`` weights) is broadcast and scoring is local to a row.
Labels, language, source and id are not inputs of a score.

Defined results: NULL and empty texts have the score of no feature; ids that are labelled
twice count as toxic if one label says so; NULL labels are no labels; without labels of
both classes every score is 0; repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.store import fresh_name

#: Bound of the labelled rows of each class that the fit reads.
SAMPLE_ROWS = 4000
MOST_FEATURES = 4096
#: A feature is used if it is in so many texts, and its share differs by so many deviations.
LEAST_TEXTS = 4
LEAST_DEVIATIONS = 4.0
PREFIXES = (4, 5, 6)
RIDGE = 0.003
FAIRNESS = 1.0
ROUNDS = 400
REJECT_SCORE = 0.7
#: Words whose features a scoring task remembers; bounds its memory only.
REMEMBERED = 1 << 18

#: Identity terms by group; a term is swapped within its group.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "sikh", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "locals", "citizens"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "turkish"),
    ("deaf", "blind", "disabled", "paralyzed", "autistic"),
    ("old", "young", "elderly", "teenage"),
)
_OTHERS = {t: [o for o in group if o != t] for group in IDENTITY_TERMS for t in group}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> tuple[str, ...]:
    """A word and its beginnings; a beginning is marked so that it is not taken for a word."""
    return (word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def swaps(text: str) -> Iterator[tuple[set[str], set[str]]]:
    """Words of each sentence that mentions an identity term, and of its swapped form."""
    lowered = text.lower()
    if not any(t in lowered for t in _OTHERS):
        return
    for sentence in _SENTENCE.split(lowered):
        words = set(_WORD.findall(sentence))
        for term in words & _OTHERS.keys():
            for other in _OTHERS[term]:
                yield words, (words - {term}) | {other}


class FeatureNumbers(dict):
    """Features by name, numbered as they are met; a name is held once, however many texts have it."""

    def __init__(self):
        super().__init__()
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str) -> np.ndarray:
        """The numbers of the distinct features of a text."""
        found: set[int] = set()
        for word in words_of(text):
            own = self.known.get(word)
            if own is None:
                own = self.known[word] = tuple(self.setdefault(f, len(self)) for f in word_features(word))
            found.update(own)
        return np.fromiter(found, np.int32, len(found))


class Rows:
    """Sparse rows of zeros and ones."""

    def __init__(self, rows: Sequence[Sequence[int] | np.ndarray], width: int):
        self.width = width
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.at = np.fromiter((c for r in rows for c in r), np.int32, int(self.sizes.sum()))
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), self.sizes)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.at], len(self.sizes))

    def transposed_times(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, values[self.owner], self.width)


def fit(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Weights of the features; the intercept has the empty name."""
    toxic = np.array(labels) == 1
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    if not n_toxic or not n_clean:
        return {}
    numbers = FeatureNumbers()
    features = [numbers.of(t) for t in texts]
    counts = np.zeros((2, len(numbers)), np.int64)
    for own, is_toxic in zip(features, toxic, strict=True):
        counts[int(is_toxic), own] += 1
    ranked = []
    for name, a, b in zip(numbers, counts[1].tolist(), counts[0].tolist(), strict=True):
        if a + b < LEAST_TEXTS:
            continue
        share = (a + b + 1) / (n_toxic + n_clean + 2)
        spread = math.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
        deviations = abs(a / n_toxic - b / n_clean) / spread
        # mentions of groups are in the model whatever they go with: the penalty holds them down
        if deviations >= LEAST_DEVIATIONS or name in _OTHERS:
            ranked.append((name not in _OTHERS, -deviations, name))
    chosen = {name: k for k, (_, _, name) in enumerate(sorted(ranked)[:MOST_FEATURES])}
    width = len(chosen)
    if not width:
        return {"": 0.0}
    by_name = np.array([chosen[name] for name in sorted(chosen)])
    order = np.full(len(numbers), -1)
    order[[numbers[name] for name in sorted(chosen)]] = np.arange(width)
    del numbers, ranked, counts
    # columns of a row by name, whatever order its words were met in: sums keep their last bits
    rows = Rows([by_name[np.sort(at[at >= 0])] for at in (order[own] for own in features)], width)
    del features
    ids = lambda words: {chosen[f] for w in words for f in word_features(w) if f in chosen}
    # only what a swap loses and wins is held
    pairs = [(sorted(a - b), sorted(b - a)) for a, b in ((ids(a), ids(b)) for t in texts for a, b in swaps(t)) if a != b]
    lost, won = Rows([a for a, _ in pairs], width), Rows([b for _, b in pairs], width)
    importance = np.where(toxic, 0.5 / n_toxic, 0.5 / n_clean)
    weights, bias = np.zeros(width), 0.0
    fast, fast_bias, momentum = weights.copy(), bias, 1.0
    pace = 4.0 / (1 + rows.sizes.max() + 8 * FAIRNESS * (1 + max([len(a) + len(b) for a, b in pairs], default=0)))
    for _ in range(ROUNDS):
        score = 1 / (1 + np.exp(-np.clip(rows.times(fast) + fast_bias, -40, 40)))
        gap = (score - toxic) * importance
        slope = rows.transposed_times(gap) + RIDGE * fast / 10
        if pairs:
            change = (lost.times(fast) - won.times(fast)) * (2 * FAIRNESS / len(pairs))
            slope += lost.transposed_times(change) - won.transposed_times(change)
        after, after_bias = fast - pace * slope, fast_bias - pace * gap.sum()
        ahead = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        fast = after + (momentum - 1) / ahead * (after - weights)
        fast_bias = after_bias + (momentum - 1) / ahead * (after_bias - bias)
        weights, bias, momentum = after, after_bias, ahead
    return {"": float(bias)} | {name: float(weights[k]) for name, k in chosen.items()}


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``rows`` labelled documents of each class.

    An id that repeats gives one row, with the least of its texts.
    """
    named = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    named = named.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = [
        named.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for kind in (0, 1)
    ]
    # at most two times ``rows`` ids
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def fitted(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Weights from the labelled rows; pass only labels that the fit may see."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in b.to_pylist()]
        found.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
        model = fit([r["text"] or "" for r in found], [r["toxic"] for r in found])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(model), pa.string()), pa.array(list(model.values()), pa.float64())], names=["name", "weight"]
        )

    model = labelled_sample(documents, labels, rows).repartition(1).mapInArrow(train, "name string, weight double")
    return {r["name"]: r["weight"] for r in model.collect()}


def score_column(text: Column, model: dict[str, float], broadcast) -> Column:
    """Score between 0 and 1; ``broadcast`` holds the model."""
    if not model:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = broadcast.value
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            scores = []
            for value in batch.to_pylist():
                present: set[str] = set()
                for word in words_of(value or ""):
                    own = known.get(word)
                    if own is None:
                        own = tuple(f for f in word_features(word) if f in weights)
                        if len(known) < REMEMBERED:
                            known[word] = own
                    if own:
                        present.update(own)
                total = weights[""] + math.fsum(weights[f] for f in present)
                scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, total)))))
            yield pa.array(scores, pa.float64())

    return scored(text)


def scorer(documents: DataFrame, labels: DataFrame):
    """A function from a text column to its score, fitted on the labels."""
    model = fitted(documents, labels)
    broadcast = documents.sparkSession.sparkContext.broadcast(model)
    return lambda text: score_column(text.cast("string"), model, broadcast)


def without_toxic(documents: DataFrame, labels: DataFrame, limit: float = REJECT_SCORE) -> DataFrame:
    """The rows that score below the limit, with all their columns."""
    name = fresh_name(documents, stem="score")
    scored = documents.withColumn(name, scorer(documents, labels)(F.col("text")))
    return scored.where(F.col(name) < limit).drop(name)
