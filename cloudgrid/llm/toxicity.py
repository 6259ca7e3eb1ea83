"""Toxicity by subword embeddings and a linear softmax.

A word's vector is the mean of the vectors of its hashed character n-grams and of
itself; a text's is the mean over its distinct words and PAD empty ones; a linear layer with softmax
gives the class. Executors turn the sampled texts into weighted bags of buckets;
vectors and layer are learnt together from these, in numpy on the driver, by
Adam over all of them at once. A misspelt word shares most of its n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, map_rows, materialise, partitions, rows_of
from .words import WORDS, held_out, letter_words, ngrams, sample_groups, word_batches

BUCKETS, LENGTHS, SEED = 1 << 17, (3, 4, 5), 5
DIMENSIONS, STEPS, RATE, Z = 8, 150, 0.2, 5.5
#: Words with a zero vector that each text's mean also holds, so that one odd word in a short text weighs little.
PAD = 100
#: Labelled texts of each class to learn from, on average at most, and n-gram buckets with a vector at most.
MAX_TEXTS, MAX_NGRAMS = 2000, 4096
#: Tasks that count the sampled texts' n-grams at most.
PARTS = 32
THRESHOLD = 0.3


@dataclass
class Model:
    """What scoring needs: the layer's difference between the classes, applied to each bucket's vector, and its bias."""

    weight: np.ndarray
    bias: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self._logits(words[at : at + WORDS]) for at in range(0, len(words), WORDS)])

    def _logits(self, words: list[str]) -> np.ndarray:
        bucket, owner = ngrams(words, LENGTHS, BUCKETS)
        return np.bincount(owner, self.weight[bucket], len(words)) / np.bincount(owner, minlength=len(words))

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits + self.bias, -60, 60)))


def _sums(rows: np.ndarray, weights: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the weighted sum of value vectors."""
    return np.stack([np.bincount(rows, weights * values[:, k], n) for k in range(values.shape[1])], axis=1)


def bag(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(distinct words, buckets, weights): the text's sum of word vectors is the weighted sum of its buckets' vectors."""
    words = list(dict.fromkeys(letter_words(text)))
    weight = np.zeros(BUCKETS)
    for at in range(0, len(words), WORDS):
        some = words[at : at + WORDS]
        bucket, owner = ngrams(some, LENGTHS, BUCKETS)
        weight += np.bincount(bucket, (1.0 / np.bincount(owner, minlength=len(some)))[owner], BUCKETS)
    found = np.flatnonzero(weight)
    return len(words), found, weight[found]


def telling(in_all: np.ndarray, in_one: np.ndarray, n: int, ones: int, most: int) -> np.ndarray:
    """Buckets, ascending, whose share of documents differs between the classes by at least Z standard errors; the most telling ones.

    in_all, in_one: documents with each bucket, and those of them of class 1; n, ones: documents.
    """
    share = in_all / n
    error = np.sqrt(share * (1 - share) * (1 / ones + 1 / (n - ones)))
    gap = np.abs(in_one / ones - (in_all - in_one) / (n - ones))
    fit = np.flatnonzero((in_all >= 3) & (gap >= Z * error))
    best = np.argsort(-gap[fit] / np.maximum(error[fit], 1e-12), kind="stable")[:most]
    return np.sort(fit[best])


def train_bags(labels: np.ndarray, sizes: np.ndarray, doc: np.ndarray, bucket: np.ndarray, weights: np.ndarray, steps: int = STEPS, odds: float | None = None) -> Model:
    """Minimise the class-balanced cross entropy over documents of both classes.

    sizes: distinct words of each document; (doc, bucket, weights): their bags, of
    the buckets that get vectors. Other buckets keep zero vectors, so that texts
    of many words aren't learnt by heart. A row weighs as the root of its number
    of distinct words, so short ones don't rule. Half of odds, the classes' log
    odds before sampling (here, if not given), goes into the bias.
    """
    y = labels.astype(np.int64)
    odds = float(np.log(y.sum() / (len(y) - y.sum()))) if odds is None else odds
    names, bucket = np.unique(bucket, return_inverse=True)
    if not len(names):
        return Model(np.zeros(BUCKETS), odds)
    weight = np.sqrt(np.maximum(1, sizes))
    weight = np.where(y == 1, weight / weight[y == 1].sum(), weight / weight[y == 0].sum()) / 2
    target = np.eye(2)[y]
    share = weights / (sizes + PAD)[doc]
    rng = np.random.default_rng(SEED)

    p = {"e": np.zeros((len(names), DIMENSIONS)), "w": rng.normal(0, 1, (DIMENSIONS, 2)), "b": np.zeros(2)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in "mv")
    for step in range(1, steps + 1):
        x = _sums(doc, share, p["e"][bucket], len(y))
        z = x @ p["w"] + p["b"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        dz = (q / q.sum(axis=1, keepdims=True) - target) * weight[:, None]
        g = {"e": _sums(bucket, share, (dz @ p["w"].T)[doc], len(names)), "w": x.T @ dz, "b": dz.sum(axis=0)}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-12)
    out = np.zeros(BUCKETS)
    out[names] = p["e"] @ (p["w"][:, 1] - p["w"][:, 0])
    return Model(out, float(p["b"][1] - p["b"][0]) + odds / 2)


def one_class(labels: list[int]) -> Model:
    """What is learnt without rows of both classes: their share."""
    return Model(np.zeros(BUCKETS), 60.0 if sum(labels) else -60.0)


def train(texts: list[str], labels: list[int], steps: int = STEPS, odds: float | None = None, max_ngrams: int = MAX_NGRAMS) -> Model:
    """The model of texts at hand, as fit() makes it of tables."""
    if len(set(labels)) < 2:
        return one_class(labels)
    y, bags = np.array(labels, np.int64), [bag(t) for t in texts]
    every = np.concatenate([b for _, b, _ in bags])
    label_of = np.repeat(y, [len(b) for _, b, _ in bags])
    names = telling(np.bincount(every, minlength=BUCKETS), np.bincount(every, label_of, BUCKETS), len(y), int(y.sum()), max_ngrams)
    return _train(y, [(n, *_chosen(b, w, names)) for n, b, w in bags], steps, odds)


def _chosen(bucket, weights, names):
    keep = np.isin(bucket, names)
    return bucket[keep], weights[keep]


def _train(y, bags, steps, odds) -> Model:
    doc = np.repeat(np.arange(len(bags)), [len(b) for _, b, _ in bags])
    bucket, weights = (np.concatenate([np.zeros(0, t), *(x[k] for x in bags)]) for k, t in ((1, np.int64), (2, np.float64)))
    return train_bags(y, np.array([n for n, _, _ in bags], np.float64), doc, bucket.astype(np.int64), weights, steps, odds)


def fit(documents: DataFrame, labels: DataFrame, max_texts: int = MAX_TEXTS, max_ngrams: int = MAX_NGRAMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from a random part of the labelled rows, as many of each class.

    Labels of one id that repeat with one value count once; a null label, id or
    text is none. The sampled ids, at most two times max_texts on average, are
    broadcast to fetch their texts, which stay on executors: these count how many
    documents of each class have a bucket, and then send the driver the bags over
    the max_ngrams most telling buckets at most, so texts may be of any length.
    Without rows of both classes the share of the one is learnt.
    """
    known = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null").distinct()
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = sample_groups(known, "label", n, max_texts, ["id", "label"], SEED)
    own = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = own.join(F.broadcast(chosen), "id").select("id", "label", "text")
    sample = materialise(rows.repartition(min(PARTS, partitions(documents.sparkSession))))  # two passes follow

    def counts(batches):
        n, ones = np.zeros(BUCKETS + 1, "<i8"), np.zeros(BUCKETS + 1, "<i8")  # the last place: documents
        for _, label, text in rows_of(batches):
            has = np.append(bag(text)[1], BUCKETS)
            n[has] += 1
            ones[has] += label
        if n[-1]:
            yield n.tobytes(), ones.tobytes()

    got = map_rows(sample, counts, "n binary, ones binary").collect()  # a row for each of PARTS tasks
    in_all, in_one = (sum((np.frombuffer(r[k], "<i8") for r in got), np.zeros(BUCKETS + 1, np.int64)) for k in ("n", "ones"))
    total, ones = int(in_all[-1]), int(in_one[-1])
    if not 0 < ones < total:
        return one_class([1] if ones else [0])
    names = telling(in_all[:-1], in_one[:-1], total, ones, max_ngrams)

    def bags(batches):
        for doc, label, text in rows_of(batches):
            size, found, weights = bag(text)
            found, weights = _chosen(found, weights, names)
            yield doc, label, size, found.astype("<i4").tobytes(), weights.astype("<f8").tobytes()

    made = sorted(map(tuple, map_rows(sample, bags, "id string, label int, size int, bucket binary, weights binary").collect()))  # in one order, so that sums are the same each time
    read = [(size, np.frombuffer(b, "<i4"), np.frombuffer(w, "<f8")) for _, _, size, b, w in made]
    return _train(np.array([r[1] for r in made], np.int64), read, STEPS, float(np.log(n[1] / n[0])) if len(n) == 2 else None)


def score(df: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of each row.

    A null or empty text, or one without words, is scored by the bias alone.
    Repeated rows and null ids stay as they are. Other columns are ignored. An
    empty table gives no rows.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for row, s in scored(batches, model):
            yield row[0], s, int(s >= threshold)

    return map_rows(own, run, f"id {own.schema[0].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def scored(batches, model: Model):
    """(row, score) for each row of Arrow batches that end in text."""
    for b in word_batches(batches):
        n = len(b.rows)
        logits = model.word_logits(b.words) if b.words else np.zeros(0)
        doc = np.repeat(np.arange(n), np.diff(b.bounds))
        pair = np.unique(doc * max(1, len(b.words)) + b.at)  # distinct words of each text
        doc, word = np.divmod(pair, max(1, len(b.words)))
        mean = np.bincount(doc, logits[word], n) / (np.bincount(doc, minlength=n) + PAD)
        yield from zip(b.rows, model.score(mean).tolist(), strict=True)


def keep_clean(df: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the threshold.

    Each row is judged by its text alone: repeated rows and null ids stay or go by
    it, and a null or empty text by the bias. An empty table gives no rows.
    """
    return filter_rows(df, text_col, lambda batch: [s < threshold for _, s in scored([batch], model)])


def learn_and_score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): score() with a model of the labelled rows that are not held out."""
    model = fit(documents, labels.where(~held_out("doc_id")))
    return score(documents, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
