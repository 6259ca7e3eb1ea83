"""Operators 5 and 7 against plain versions: integers modulo 2**64, dictionaries and whole dynamic programmes."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from cloudgrid.llm import langid, toxicity, words

M = (1 << 64) - 1
PRIME, TURN = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
rng = random.Random(8)
PARTS = {"aa": ["ka", "lo", "mi", "ten", "ru"], "bb": ["ka", "schü", "ert", "ung", "mi"], "cc": ["про", "ста", "ние"], "dd": ["κα", "λο", "μι", "τε"]}
BAD = ["grumblor", "snarkwit"]


def sentence(lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def place(h, n, buckets):
    h = ((h ^ n) * TURN) & M
    return (h ^ (h >> 32)) % buckets


def grams(word, lengths, buckets):
    marked, found = [ord(c) for c in f"<{word}>"], []
    for at in range(len(marked)):
        h = 0
        for n in range(1, min(max(lengths), len(marked) - at) + 1):
            h = ((h + marked[at + n - 1]) * PRIME) & M
            h ^= h >> 29
            if n in lengths:
                found.append(place(h, n, buckets))
    whole = 0
    for at, c in enumerate(marked):
        p = ((c + 1) * pow(PRIME, (len(marked) - at) % 61 + 1, 1 << 64)) & M
        whole += (p ^ (p >> 31)) * PRIME
    return [*found, place(whole & M, 0, buckets)]


def tokens(text):
    return [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(c.isalpha() for c in w)]


def script(word):
    return unicodedata.name(word[0]).split()[0]


@pytest.mark.parametrize(("lengths", "buckets"), [((1, 2, 3, 4), 1 << 16), ((3, 4, 5), 1 << 17), ((2,), 97)])
def test_ngrams(lengths, buckets):
    some = ["a", "ab", "über", "слово", "x" * 200, *tokens(sentence("bb", 40))]
    bucket, owner = words.ngrams(some, lengths, buckets)
    for k, w in enumerate(some):
        assert sorted(bucket[owner == k].tolist()) == sorted(grams(w, lengths, buckets))


class Plain:
    def __init__(self, rows):
        """rows: (text, lang)."""
        self.langs = sorted({lang for _, lang in rows if lang})
        self.counts, letters = defaultdict(Counter), defaultdict(Counter)
        for text, lang in rows:
            for w in tokens(text) if lang else ():
                self.counts[lang].update(grams(w, langid.LENGTHS, langid.BUCKETS))
                letters[lang][script(w)] += len(w)
        self.total = {x: sum(self.counts[x].values()) + 0.1 * langid.BUCKETS for x in self.langs}
        self.uses = {x: {s for s, n in letters[x].items() if n >= langid.SCRIPT_SHARE * sum(letters[x].values())} for x in self.langs}

    def word(self, w):
        raw = [sum(math.log((self.counts[x][g] + 0.1) / self.total[x]) for g in grams(w, langid.LENGTHS, langid.BUCKETS)) / 2 for x in self.langs]
        fits = [script(w) in self.uses[x] for x in self.langs]
        if any(fits):
            raw = [s if f else min(raw) - 50 for s, f in zip(raw, fits, strict=True)]
        top = max(raw)
        return [s - top - math.log(sum(math.exp(t - top) for t in raw)) for s in raw]

    def label(self, text):
        ws = tokens(text)
        if not ws:
            return "und", 0.0
        known = {w: self.word(w) for w in set(ws)}
        k, best, back = range(len(self.langs)), list(known[ws[0]]), []
        for w in ws[1:]:
            came = [max(k, key=lambda a, b=b: (best[a] - langid.SWITCH * (a != b), a == b)) for b in k]
            best = [best[a] - langid.SWITCH * (a != b) + known[w][b] for b, a in enumerate(came)]
            back.append(came)
        at = max(k, key=lambda b: best[b])
        path = [at]
        for came in reversed(back):
            at = came[at]
            path.append(at)
        size = Counter()
        for x, w in zip(reversed(path), ws, strict=True):
            size[self.langs[x]] += len(w)
        lang = min(size, key=lambda x: (-size[x], x))
        return lang, size[lang] / sum(size.values())


def test_languages_against_a_plain_version(spark):
    rows = [(k, sentence(lang, rng.randint(2, 40)), lang) for k, lang in enumerate(list(PARTS) * 25)]
    rows += [(200 + k, f"{sentence('aa', 25)} {sentence(x, 30)}. {sentence('aa', 9)}", None) for k, x in enumerate(["bb", "cc", "dd", "bb", "bb"] * 3)]
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "12 ³ _ !", "cc"), (303, sentence("bb", 9000), None), (304, sentence("cc", 30) + " kaкa", None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id bigint, text string, lang string, lang_pred string, score int").repartition(3)
    train = docs.where(~words.held_out("doc_id"))
    model = langid.fit(train)
    plain = Plain([(r.text, r.lang) for r in train.collect()])
    assert model.langs == plain.langs
    got = langid.identify(docs, model).collect()
    want = {i: plain.label(t) for i, t, _ in rows}
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1])
    assert any(0 < s < 1 for _, s in want.values())  # some texts are mixed


@pytest.fixture(scope="module")
def rated(spark):
    rows = []
    for k in range(300):
        t = sentence(rng.choice(["aa", "bb"]), rng.randint(5, 80)).split()
        if k % 3 == 0:
            t.insert(rng.randrange(len(t)), rng.choice(BAD))
        rows.append((k, " ".join(t), int(k % 3 == 0)))
    return rows


def test_toxicity_against_a_plain_version(spark, rated):
    more = [(900, None), (901, ""), (902, "12 !"), (903, "grumblorr " + sentence("aa", 20_000)), (904, "grumblorr grumblorr " + sentence("cc", 3)), (0, rated[0][1]), (None, "snarkwit")]
    rows = [(i, t) for i, t, _ in rated] + more
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id bigint, text string, score double, predicted string").repartition(3)
    labels = spark.createDataFrame([(i, y, 1.0) for i, _, y in rated], "doc_id bigint, toxic int, score double")
    model = toxicity.fit(docs, labels)
    weight = model.weight.tolist()

    def plain(text):
        own = set(tokens(text))
        logits = [sum(weight[g] for g in gs) / len(gs) for w in own for gs in [grams(w, toxicity.LENGTHS, toxicity.BUCKETS)]]
        return 1 / (1 + math.exp(-(math.fsum(logits) / (len(own) + toxicity.PAD) + model.bias)))

    got = sorted((str(r.doc_id), r.score) for r in toxicity.score(docs, model).collect())
    want = sorted((str(i), plain(t)) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)


def test_fit_on_executors_is_training_at_hand(spark, rated):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rated], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rated], "doc_id bigint, toxic int")
    far = toxicity.fit(docs, labels)
    known = sorted(rated, key=lambda r: str(r[0]))
    ones = sum(y for _, _, y in known)
    near = toxicity.train([t for _, t, _ in known], [y for _, _, y in known], odds=math.log(ones / (len(known) - ones)))
    assert far.bias == pytest.approx(near.bias) and np.allclose(far.weight, near.weight)
