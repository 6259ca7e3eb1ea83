from collections import Counter

import duckdb
import pytest

from cloudgrid.llm import quality

WORDS = "The quick brown fox jumps over the lazy dog while seven wizards quietly boxed five liquid jugs near a river bank today".split()


def texts():
    clean = " ".join(WORDS)
    return [
        (1, clean),
        (2, None),
        (3, ""),
        (4, " \t\n\x0b\x0c\r "),
        (5, clean + " " + clean),
        (6, "\n".join([clean] * 5)),
        (7, " ".join(w + "###" for w in WORDS)),
        (8, " ".join(w.upper() + "!!" for w in WORDS)),
        (9, " | ".join(WORDS)),
        (10, "a " * 5000),
        (11, "é́漢字 \x00 \u00a0x \u2028y " * 9 + clean),
        (11, "é́漢字 \x00 \u00a0x \u2028y " * 9 + clean),
        (None, clean),
        (12, " ".join(WORDS[:8] + WORDS[12:] + WORDS[:8] + WORDS[10:12])),
        (13, " ".join(str(k % 977) for k in range(30_000))),
        (14, " ".join("abcdefgh")),
        (15, " ".join(w for w in WORDS for _ in range(3))),
    ]


def brute(text):
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_counts_and_verdicts(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in texts()], "doc_id bigint, text string, n_words bigint")
    got = quality.judge(df).collect()
    want = Counter((i, *brute(t)) for i, t in texts())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    kept = {r.doc_id for r in got if r.kept}
    assert {1, None} <= kept and not kept & {2, 3, 4, 5, 6, 7, 8, 9, 10, 14, 15}


def test_sql_agrees(spark):
    df = spark.createDataFrame(list(dict(texts()).items()), "doc_id bigint, text string")  # ids once: the SQL joins by them
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.execute(quality.SQL).fetchall()
    assert Counter(map(tuple, quality.judge(df).collect())) == Counter(want)


def test_cascade_order_never_changes_a_verdict(spark):
    df = quality.base_counts(spark.createDataFrame(texts(), "doc_id bigint, text string"))
    verdict = lambda rules: sorted(map(str, df.select("doc_id", quality.cascade(list(rules))[0].alias("kept")).collect()))
    assert verdict(quality.RULES) == verdict(quality.RULES[::-1])
    assert df.where(~quality.cascade([])[0]).count() == 0


def test_estimates_are_ordered_by_rejections_per_cost(spark):
    df = quality.base_counts(spark.createDataFrame(texts() * 20, "doc_id bigint, text string"))
    found = quality.estimate(df)
    assert {e.rule for e in found} == set(quality.RULES)
    assert [e.rank for e in found] == sorted((e.rank for e in found), reverse=True)
    assert next(e.rejected for e in found if e.rule.name == "symbols") > 0
    cost = {e.rule.name: e.cost for e in found}
    assert cost["symbols"] == cost["word_length"] < cost["exclamations"] < cost["wordless"] < cost["capitals"]


def test_native_plan(spark):
    plan = quality.judge(spark.createDataFrame(texts(), "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("n", [7, 8, 9])
def test_window_edges(spark, n):
    t = " ".join(["a"] * n)
    row = quality.judge(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).first()
    assert row.n_repeat_words == brute(t)[4]


def test_order_is_the_same_each_time(spark):
    df = spark.createDataFrame(texts() * 20, "doc_id bigint, text string")
    orders = {tuple(e.rule.name for e in quality.estimate(df)) for _ in range(3)}
    assert len(orders) == 1


def test_sample_reads_few_files(spark, tmp_path):
    df = spark.createDataFrame(texts() * 20, "doc_id bigint, text string").repartition(12)
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    few = quality.few_files(read, 3, seed=1)
    assert len(few.select("_metadata.file_path").distinct().collect()) == 3 < 12
    assert quality.few_files(read.distinct(), 3, seed=1).count() == read.distinct().count()
    assert len(quality.estimate(read, files=3)) == len(quality.RULES)
    assert len(quality.estimate(read.limit(0))) == len(quality.RULES)
