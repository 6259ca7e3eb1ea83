"""Quality rules as a short-circuit cascade of column expressions.

Base counts are computed for every row. The rules after them only decide: each
rule's cost and share of rejections are estimated on a sample, and the rules are
put into one CASE in order of rejections per cost, so a row leaves at the first
rule that rejects it. The order never changes a verdict, whatever the sample holds.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, text_of

WINDOW = 8
#: Plain passes over a text that one by a regular expression takes as long as.
REGEX = 8


@dataclass(frozen=True)
class Rule:
    """rejects: a Boolean expression over text and the base counts; a null does not reject."""

    name: str
    rejects: str

    @property
    def work(self) -> str:
        """What the rule takes for a row, in passes over a character, as an expression: its steps over the text, weighted by kind, and one for the rest."""
        per_char = REGEX * len(re.findall(r"regexp_\w+\(", self.rejects)) + len(re.findall(r"\b(?:length|replace|translate)\(", self.rejects))
        return f"1 + {per_char}D * length(text)"


#: Rows that these reject are junk by surface form in any language.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("repeated_lines", "5 * n_dup_lines > 2 * n_lines"),
    Rule("exclamations", "4 * (length(text) - length(replace(text, '!!', '!'))) > n_words"),
    Rule("capitals", "length(regexp_replace(text, '[^\\\\p{Lu}]+', '')) > 0.6 * greatest(20, length(regexp_replace(text, '[^\\\\p{L}]+', '')))"),
    Rule("wordless", "regexp_count(text, '(?:^|[ \\\\t-\\\\r])[^ \\\\t-\\\\r\\\\p{L}]+(?=[ \\\\t-\\\\r]|\\\\z)') > 0.4 * n_words"),
    Rule("stutters", "regexp_count(text, '(?<![^ \\\\t-\\\\r])([^ \\\\t-\\\\r]++)(?=[ \\\\t-\\\\r]+\\\\1(?![^ \\\\t-\\\\r]))') > 0.4 * n_words"),
)


@dataclass(frozen=True)
class Estimate:
    """cost: the rule's mean work; rejected: its share of the rows that pass the base test."""

    rule: Rule
    cost: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / self.cost


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and base_failed.

    Windows of eight words are compared by 64-bit hashes of word hashes. A row
    without a repeated window, which a hash set tells, is done; the others sort
    their windows by hash, so any text takes n log n steps. A null text counts
    as an empty one, of no words.
    """
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\x20\x09-\x0d]"))
    df = df.withColumn("_words", F.array_remove(F.split(text, WORD_GAP), ""))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.regexp_replace(text, WORD_GAP, "")).cast("bigint"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint"),
            "_lines": lines,
            "_h": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words")
    windows = F.transform(F.slice("_h", 1, F.greatest(F.lit(0), F.size("_h") - (WINDOW - 1))), lambda x, i: F.xxhash64(x, *(F.get("_h", i + k) for k in range(1, WINDOW))))
    df = df.withColumns({"n_lines": F.size("_lines").cast("bigint"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"), "_w": windows}).drop("_lines", "_h")
    df = df.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("_w")) == F.size("_w"), F.lit(0)).otherwise(_covered(F.col("_w"))).cast("bigint")).drop("_w")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(p, same), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(_let(pairs, repeated), start, step)["n"]


def few_files(df: DataFrame, most: int, seed: int) -> DataFrame:
    """df over most of its files, chosen at random, where it is a plain scan of more; else df as it is."""
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return df
    names = sorted(df.inputFiles())
    if len(names) <= most:
        return df
    chosen = random.Random(seed).sample(names, most)
    # Spark skips the other files; it writes a path without a host with one slash or three
    return df.where(F.col("_metadata.file_path").isin(chosen + [c.replace(":///", ":/", 1) for c in chosen if ":///" in c]))


def estimate(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, files: int = 16, seed: int = 3, text_col: str = "text") -> list[Estimate]:
    """Cost and share of rejections of each rule on about sample_rows rows, best first.

    The rows are a random part of a few files of df; only they are counted, in one
    pass without a shuffle of texts. Rules see those that pass the base test. A
    rule's cost is the mean of its work over them: wall-clock times of so short
    jobs are mostly noise, while this is the same from run to run. Equal ranks go by
    cost, then by name. Without rows every rule rejects nothing.
    """
    part = few_files(df, files, seed).select(text_of(text_col).alias("text"))
    n = part.count()
    some = part if n <= sample_rows else part.sample(sample_rows / n, seed)
    columns = [c for k, r in enumerate(rules) for c in (F.coalesce(F.expr(r.rejects), F.lit(False)).alias(f"_hit{k}"), F.expr(r.work).alias(f"_work{k}"))]
    seen = F.col("base_failed").alias("_failed")
    got = base_counts(some).select(seen, *columns).persist()  # a filter below the cache would repeat the counts' expressions
    try:
        passed = got.where("not _failed")
        means = passed.agg(*(F.avg(F.col(f"_hit{k}").cast("double")) for k in range(len(rules))), *(F.avg(f"_work{k}") for k in range(len(rules)))).first()
    finally:
        got.unpersist()
    found = [Estimate(r, means[len(rules) + k] or 1.0, means[k] or 0.0) for k, r in enumerate(rules)]
    return sorted(found, key=lambda e: (-e.rank, e.cost, e.rule.name))


def cascade(order: list[Rule]) -> tuple[Column, Column]:
    """(kept, first rejecting rule or null): one CASE, which stops at the first rule that holds."""
    if not order:
        return F.lit(True), F.lit(None).cast("string")
    rejected = F.lit(None).cast("string")
    for rule in reversed(order):
        rejected = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(rejected)
    return rejected.isNull(), rejected


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines).

    Each row is judged by itself: repeated rows get the same verdict, null ids
    are kept as they are, and a null or empty text fails the base test. Other
    columns are ignored. An empty table gives no rows.
    """
    order = [e.rule for e in estimate(df, rules, sample_rows, text_col=text_col)]
    kept, _ = cascade(order)
    counted = base_counts(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")))
    counted = counted.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(kept))
    return counted.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


#: The same for DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM t
),
b AS (
  SELECT doc_id, text, ws, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines
  FROM w
),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], chr(32)) AS g FROM (SELECT doc_id, ws, unnest(range(1, n_words - 6)) AS i FROM b)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM r, range(0, 8) AS s(k) GROUP BY doc_id),
f AS (SELECT b.*, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN c USING (doc_id)),
h AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (
    10 * n_symbols > n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 5 * n_dup_lines > 2 * n_lines
    OR 4 * (length(text) - length(replace(text, '!!', '!'))) > n_words
    OR length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > 0.6 * greatest(20, length(regexp_replace(text, '[^\p{L}]+', '', 'g')))
    OR len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) > 0.4 * n_words
    OR len(list_filter(range(2, n_words + 1), lambda i: ws[i] = ws[i - 1])) > 0.4 * n_words
  ) AS kept, n_lines
FROM h
"""
