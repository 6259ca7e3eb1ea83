import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgrid.llm import url_filter as uf

RULES = [uf.PathRule(*r) for r in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))]
URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "http://EXAMPLE.com/en/1?x=://y",
    "http://www.Example.com/en/a#b",
    "http://notexample.com/en/",
    "https://a.b.net/es/1",
    "https://net/fr/",
    "https://a.net/fr",
    "https://a.net?/fr/",
    "x://É.com/Ü/",
    "http://com",
    "http://com/",
    "http://a.com\n/x",
] + [f"http://h{k}.example.net/{lang}/{k}?ref=x" for k in range(40) for lang in ("es", "fr", "en")]
URLS += [f"https://h{k}.shop.com/{lang}/{k}?ref=x" for k in range(40) for lang in ("de", "fr")]
URLS += [f"https://s{k}.site.org/{p}/{k}" for k in range(30) for p in ("es", "fr", "de")]


def brute(u):
    at = u.find("://") if u else -1
    if at < 0:
        return "", "", None
    rest = u[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(r.rule), r.rule) for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fit)[1] if fit else None


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS)] + [(0, None, "x"), (5, URLS[5], "x"), (None, URLS[-1], "x")]
    return spark.createDataFrame(rows, "page_id bigint, url string, host string")


def test_listed_rules(pages):
    got = uf.judge(pages, RULES).collect()
    want = [(p.page_id, *brute(p.url)) for p in pages.collect()]
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter(want)
    verdicts = {r.rule: r.verdict for r in got if r.rule}
    assert verdicts == {r.rule: r.verdict for r in RULES if r.rule in verdicts}
    assert all(r.verdict == "allow" for r in got if not r.host)


@pytest.mark.parametrize("z", [0.0, 3.0])
def test_mined_rules_against_brute_force(pages, spark, z):
    host, path = uf.split_url(F.col("url"))
    df = pages.select("url", host.alias("host"), path.alias("path"))
    rows = df.select("url", "host", uf.url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("t")).collect()
    tokens = {r.url: frozenset(r.t) for r in rows}
    listed = [(tokens[p.url], next(r.verdict for r in RULES if r.rule == brute(p.url)[2])) for p in pages.collect() if brute(p.url)[2]]
    support = max(0.01, 10 / len(listed))
    mined = {}
    for size in range(1, max(len(t) for t, _ in listed) + 1):
        for items in {c for t, _ in listed for c in combinations(sorted(t), size)}:
            both = [v for t, v in listed if t >= set(items)]
            hit, base = both.count("block"), [v for _, v in listed].count("block") / len(listed)
            lift = hit / max(1, len(both)) - base
            if hit >= support * len(listed) - 1e-9 and hit / len(both) >= 0.8 and lift > 0 and lift >= z * (base * (1 - base) / len(both)) ** 0.5:
                mined[frozenset(items)] = hit / len(both)
    expect = {u: any(m <= t for m in mined) for u, t in tokens.items()}
    got = uf.judge(pages, RULES, min_z=z).where("rule is null and host <> ''").collect()
    assert any(r.verdict == "block" for r in got) and any(r.verdict == "allow" for r in got)
    urls = {p.page_id: p.url for p in pages.collect() if p.page_id is not None}
    for r in got:
        u = urls[r.page_id] if r.page_id is not None else URLS[-1]
        assert (r.verdict == "block") == expect[u], u
        assert (r.mined is None) == (r.verdict == "allow") and set(r.mined or ()) <= tokens[u]


def test_nothing_labelled_and_empty(spark, pages):
    assert uf.judge(pages, []).where("verdict <> 'allow'").count() == 0
    assert uf.judge(pages.limit(0), RULES).count() == 0


def test_combinations_against_brute_force(spark):
    """Rules of several tokens: no token by itself tells, only pairs and triples do."""
    rng, words = random.Random(2), "abcdefgh"
    urls = []
    for k in range(400):
        some = sorted(rng.sample(words, rng.randint(2, 5)))
        bad = {"a", "b"} <= set(some) or {"c", "d", "e"} <= set(some)
        urls.append(f"http://{'example.net/es' if bad else 'example.com'}/{'/'.join(some)}")
    rules = [uf.PathRule("allow", "com/"), uf.PathRule("block", "net/es/")]
    rows = [(k, u) for k, u in enumerate(urls)] + [(1000 + k, f"http://h{k}.org/" + "/".join(rng.sample(words, 3))) for k in range(100)]
    labelled = [(frozenset("p:" + w for w in u.split("/")[3:] if len(w) == 1), "/es/" in u) for u in urls]
    base, mined = sum(v for _, v in labelled) / len(labelled), []
    for size in range(1, 6):
        for items in combinations(["p:" + w for w in words], size):
            both = [v for t, v in labelled if t >= set(items)]
            share = sum(both) / max(1, len(both))
            if sum(both) >= 10 and share >= 0.8 and share - base >= 3 * (base * (1 - base) / len(both)) ** 0.5:
                mined.append(frozenset(items))
    assert max(map(len, mined)) >= 3
    got = uf.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules).where("page_id >= 1000").collect()
    for r in got:
        held = {"p:" + w for w in r.path.split("/") if w}
        assert (r.verdict == "block") == any(m <= held for m in mined)
    assert {r.verdict for r in got} == {"allow", "block"}


def test_long_paths_and_urls(spark):
    """A long path in many labelled rows is one item; paths that differ a little are bounded by MAX_ITEMS."""
    path = "/".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(k, f"http://a{k % 5}.net/es/{path}") for k in range(30)] + [(100 + k, f"http://a.com/{'x' if k % 2 else 'y'}/{k}") for k in range(60)]
    words = path.split("/")
    rows += [(200 + k, "http://" + ("b.net/es/" if k % 2 else "b.com/") + "/".join(w + "q" for j, w in enumerate(words[:40]) if j != k)) for k in range(40)]
    rows += [(300, "http://c.org/z/" + path), (301, "http://c.org/z/"), (302, "http://c.org/" + "long/" * 200_000)]
    got = {r.page_id: r for r in uf.judge(spark.createDataFrame(rows, "page_id bigint, url string"), RULES).collect()}
    assert len(got) == len(rows) and got[300].verdict == "block" and got[301].verdict == got[302].verdict == "allow"
    assert len(got[302].path) == 1_000_001


def test_one_verdict_alone_teaches_nothing(spark):
    rows = [(k, f"http://a.net/es/p/{k}") for k in range(50)] + [(99, "http://a.org/es/p/1")]
    assert uf.judge(spark.createDataFrame(rows, "page_id bigint, url string"), RULES).where("page_id = 99").first().verdict == "allow"


def test_a_rule_of_many_tokens(spark):
    """13 words together are a rule, any 12 of them aren't."""
    words = [f"w{chr(97 + k)}" for k in range(13)]
    path = lambda lost: "/".join(w for j, w in enumerate(words) if j != lost)
    rows = [(k, f"http://a.net/es/{path(None)}/x{chr(97 + k)}") for k in range(20)]
    rows += [(100 + k, f"http://a.com/{path(k % 13)}") for k in range(78)]
    rows += [(1000, f"http://h.org/{path(None)}")] + [(1001 + k, f"http://h.org/{path(k)}") for k in range(13)]
    got = {r.page_id: r for r in uf.judge(spark.createDataFrame(rows, "page_id bigint, url string"), RULES).where("page_id >= 1000").collect()}
    assert got[1000].verdict == "block" and set(got[1000].mined) == {"p:" + w for w in words} and got[1000].confidence == 1.0
    assert all(got[1001 + k].verdict == "allow" for k in range(13))


@pytest.mark.parametrize("limit", [3, 12])
def test_long_rows_against_brute_force(spark, monkeypatch, limit):
    """Only the two tokens of least blocked share tell, in rows of up to 15 items, projected down to limit."""
    monkeypatch.setattr(uf, "MAX_ITEMS", limit)
    rng, words = random.Random(4), [f"w{chr(97 + k)}" for k in range(15)]
    urls, labelled = [], []
    for k in range(260):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        some = [w for w, here in zip(words, [a, b] + [rng.random() < 0.85 for _ in words[2:]]) if here]
        bad = a and b or not a and not b and rng.random() < 0.9
        urls.append(f"http://{'example.net/es' if bad else 'example.com'}/{'/'.join(some)}")
        labelled.append((sum(1 << words.index(w) for w in some), bad))
    n, blocked = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
    for mask, bad in labelled:
        n[mask], blocked[mask] = n[mask] + 1, blocked[mask] + bad
    for j in range(15):  # rows that have all of a set
        for c in (n, blocked):
            c.reshape(-1, 2, 1 << j)[:, 0] += c.reshape(-1, 2, 1 << j)[:, 1]
    base, share = blocked[0] / n[0], blocked / np.maximum(n, 1)
    rules = np.flatnonzero((blocked >= 10) & (share >= 0.8) & (share - base >= 3 * np.sqrt(base * (1 - base) / np.maximum(n, 1))))
    assert 3 in rules and 1 not in rules and 2 not in rules
    rows = list(enumerate(urls)) + [(1000 + k, f"http://h{k}.org/" + "/".join(rng.sample(words, rng.randint(2, 14)))) for k in range(120)]
    got = uf.judge(spark.createDataFrame(rows, "page_id bigint, url string"), [uf.PathRule("allow", "com/"), uf.PathRule("block", "net/es/")]).where("page_id >= 1000").collect()
    minimal = [r for r in rules if not any((r & o) == o for o in rules if o != r)]
    for r in got:
        held = sum(1 << words.index(w) for w in r.path.split("/") if w)
        fits = [m for m in minimal if (m & held) == m]
        assert (r.verdict == "block") == bool(fits)
        if fits:
            assert sum(1 << words.index(t[2:]) for t in r.mined) in fits and r.confidence == pytest.approx(max(share[m] for m in fits))
    assert {r.verdict for r in got} == {"allow", "block"}
