"""Language spans of mixed texts.

Script ranges say which languages a word can be in, hashed character n-grams
give each of those a log likelihood, and Viterbi with a switching penalty finds
the most likely sequence of languages over the words of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, map_rows
from .words import WORDS, held_out, ngrams, sample_groups, word_batches

BUCKETS, LENGTHS, SEED = 1 << 16, (1, 2, 3, 4), 11
#: Nats that a change of language costs.
SWITCH = 12.0
#: Labelled texts to learn from, over all languages, on average at most, and languages at most.
MAX_TEXTS, MAX_LANGS = 4000, 200
#: Tasks that count their n-grams.
PARTS = 32
#: Languages that use a script for less than this share of their letters are no candidates in it.
SCRIPT_SHARE = 0.001
UND = "und"

#: First code points of script ranges, from the Unicode block list. Fixed values.
SCRIPTS = (
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"),
    (0x0B80, "Tamil"),
    (0x0C00, "Telugu"),
    (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"),
    (0x0E00, "Thai"),
    (0x0E80, "Lao"),
    (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x13A0, "Other"),
    (0x1780, "Khmer"),
    (0x1800, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Han"),
    (0xAC00, "Hangul"),
    (0xD800, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"),
    (0xFE00, "Other"),
    (0xFF66, "Kana"),
    (0xFFA0, "Hangul"),
    (0xFFE0, "Other"),
    (0x20000, "Han"),
    (0x30000, "Other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_CODES = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def word_scripts(words: list[str]) -> np.ndarray:
    """Script number of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _CODES[np.searchsorted(_STARTS, first, side="right") - 1]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # log probability of each n-gram bucket in each language
    allowed: np.ndarray  # script x language

    def scores(self, words: list[str]) -> np.ndarray:
        """Log posterior of each language for each word; half of the n-grams' sum, since they overlap."""
        return self.both(words)[0]

    def both(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """scores(), and how much likelier each language makes the word's n-grams than chance does, in nats."""
        parts = [self._both(words[at : at + WORDS]) for at in range(0, len(words), WORDS)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _both(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bucket, owner = ngrams(words, LENGTHS, BUCKETS)
        order = np.argsort(owner, kind="stable")
        summed = np.add.reduceat(self.table[bucket[order]], np.searchsorted(owner[order], np.arange(len(words)))).astype(np.float64)
        gain = summed + np.bincount(owner, minlength=len(words))[:, None] * np.log(BUCKETS)
        total = summed / 2
        allowed = self.allowed[word_scripts(words)]
        total = np.where(allowed | ~allowed.any(axis=1, keepdims=True), total, total.min(axis=1, keepdims=True) - 50)
        return total - np.logaddexp.reduce(total, axis=1, keepdims=True), gain


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_texts: int = MAX_TEXTS, max_langs: int = MAX_LANGS) -> Model:
    """Learn from a random part of the rows with a language, an equal number for each.

    Of more than max_langs values of lang_col the most frequent are learnt (of
    equally frequent ones the first by name). Executors count n-grams; what the
    driver holds is a number for each bucket and language, whatever the texts'
    length. Rows with a null language or text are left out; ids may be null or
    repeat. Without rows no language is learnt.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    langs = sorted(counts)
    chosen = sample_groups(rows.where("text is not null"), "lang", counts, max_texts / max(1, len(langs)), ["id", "text"], SEED)
    both = np.zeros((BUCKETS + len(_NAMES), len(langs)))
    for r in ngram_counts(chosen, langs).collect():
        both[np.frombuffer(r["bucket"], "<i4"), langs.index(r["lang"])] += np.frombuffer(r["n"], "<i8")
    counts, letters = both[:BUCKETS], both[BUCKETS:]
    table = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * BUCKETS)).astype(np.float32)
    return Model(langs, table, letters / np.maximum(1, letters.sum(axis=0)) >= SCRIPT_SHARE)


def ngram_counts(rows: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, bucket binary, n binary) of rows (id, lang, text): how often each n-gram bucket occurs; from BUCKETS on, the letters of each script.

    Rows are dealt by language, so there are fewer than PARTS rows more than languages, each of one number for a bucket at most.
    """

    def run(batches):
        found: dict[str, np.ndarray] = {}
        for b in word_batches(batches):
            of = [r[0] for r in b.rows]
            row = np.repeat([langs.index(lang) for lang in of], np.diff(b.bounds))
            for lang in set(of):
                times = np.bincount(b.at[row == langs.index(lang)], minlength=len(b.words))
                n = found.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), "<i8"))
                for at in range(0, len(b.words), WORDS):
                    words, often = b.words[at : at + WORDS], times[at : at + WORDS]
                    bucket, owner = ngrams(words, LENGTHS, BUCKETS)
                    n[:BUCKETS] += np.bincount(bucket, often[owner], BUCKETS).astype(np.int64)
                    letters = np.fromiter(map(len, words), np.int64, len(words)) * often
                    n[BUCKETS:] += np.bincount(word_scripts(words), letters, len(_NAMES)).astype(np.int64)
        for lang, n in found.items():
            seen = np.flatnonzero(n)
            yield lang, seen.astype("<i4").tobytes(), n[seen].tobytes()

    salt = F.pmod(F.xxhash64("id", "text"), F.lit(-(-PARTS // max(1, len(langs)))))
    return map_rows(rows.repartition(PARTS, "lang", salt).select("lang", "text"), run, "lang string, bucket binary, n binary")


def viterbi(s: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word.

    First the best single language is tried: if no stretch gains more from other
    languages than the switches into and out of it cost, no path beats it.
    """
    n, k = s.shape
    one = int(s.sum(axis=0).argmax())
    if k == 1:
        return np.zeros(n, np.int64)
    gain = np.delete(s, one, axis=1).max(axis=1) - s[:, one]
    run = np.concatenate([[0.0], np.cumsum(gain)])
    if run.max() <= switch and run[-1] - run.min() <= switch and (run - np.minimum.accumulate(run)).max() <= 2 * switch:
        return np.full(n, one)
    back, v = np.empty((n, k), np.int32), s[0].copy()
    stay = np.arange(k)
    for t in range(1, n):
        best = int(v.argmax())
        moved = v < v[best] - switch
        back[t] = np.where(moved, best, stay)
        v = np.where(moved, v[best] - switch, v) + s[t]
    path = np.empty(n, np.int64)
    path[-1] = int(v.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def paths(batches, model: Model, switch: float) -> Iterator[tuple]:
    """(row, letters in each word, path, gain over chance along it) for each row of Arrow batches that end in text."""
    for b in word_batches(batches):
        scores, gains = model.both(b.words) if b.words and model.langs else (np.zeros((len(b.words), 0)),) * 2
        size = np.fromiter(map(len, b.words), np.int64, len(b.words))
        for i, row in enumerate(b.rows):
            at = b.at[b.bounds[i] : b.bounds[i + 1]]
            path = viterbi(scores[at], switch) if len(at) and model.langs else np.zeros(0, np.int64)
            yield row, size[at], path, float(gains[at[: len(path)], path].sum())


def label_spans(df: DataFrame, model: Model, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, spans array<struct<first, last, lang>>) of each row.

    Words are runs of letters, counted from 0; spans cover them all. lang_pred is
    the language of most letters (of equal ones the first by name), score their
    share. A null text or one without a letter is 'und' with score 0 and no
    spans, and so is every text if no language was learnt. Repeated rows and null
    ids stay as they are. Other columns are ignored. An empty table gives no rows.
    """

    def spans(path):
        cuts = np.flatnonzero(np.diff(path)) + 1
        firsts, lasts = [0, *cuts.tolist()], [*(cuts - 1).tolist(), len(path) - 1]
        return [{"first": a, "last": z, "lang": model.langs[path[a]]} for a, z in zip(firsts, lasts, strict=True)]

    return _label(df, model, switch, id_col, text_col, lambda path: (spans(path) if len(path) else [],), ", spans array<struct<first:int,last:int,lang:string>>")


def identify(df: DataFrame, model: Model, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """label_spans() without the spans."""
    return _label(df, model, switch, id_col, text_col, lambda path: (), "")


def main_language(model: Model, size: np.ndarray, path: np.ndarray) -> tuple[str, float]:
    if not len(path):
        return UND, 0.0
    letters = np.bincount(path, size, len(model.langs))
    return model.langs[int(letters.argmax())], float(letters.max() / letters.sum())


def keep_identified(df: DataFrame, model: Model, min_score: float = 0.3, switch: float = SWITCH, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that are in a learnt language.

    The main language's share of the letters must be min_score or more, and the
    languages found must make the text's n-grams likelier than chance, which those
    of unlearnt languages and of random letters aren't. A clean text with a line or
    two of another language stays; one that is null, without a letter, or of scraps
    of many languages goes. Each row is judged by itself: repeated rows and null ids
    stay or go by their texts, whatever their length. An empty table gives no rows.
    """

    def decide(batch):
        for _, size, path, gain in paths([batch], model, switch):
            lang, score = main_language(model, size, path)
            yield lang != UND and score >= min_score and gain > 0

    return filter_rows(df, text_col, lambda batch: list(decide(batch)))


def _label(df, model, switch, id_col, text_col, more, fields):
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for row, size, path, _ in paths(batches, model, switch):
            yield row[0], *main_language(model, size, path), *more(path)

    return map_rows(own, run, f"id {own.schema[0].dataType.simpleString()}, lang_pred string, score double{fields}").withColumnRenamed("id", id_col)


def learn_and_identify(documents: DataFrame) -> DataFrame:
    """identify() with a model of the rows that are not held out; adds held_out, doc_id's remainder."""
    model = fit(documents.where(~held_out("doc_id")))
    return identify(documents, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
