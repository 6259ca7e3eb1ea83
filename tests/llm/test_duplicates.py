import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgrid.llm import components, count_tree, fingerprints, jaccard_join
from cloudgrid.llm.shingles import shingle_hashes

rng = random.Random(9)


def words(n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def corpus():
    passage = words(40)
    base = [words(rng.choice([3, 5, 8, 60, 200])) for _ in range(30)]
    rows = [" ".join(b) for b in base]
    for b in base * 3:
        c = list(b)
        for _ in range(rng.randint(0, max(1, len(c) // 25))):
            c[rng.randrange(len(c))] = words(1)[0]
        rows.append(" ".join(c))
    chain = words(100)
    for k in range(8):  # each links with the next, not with the first
        rows.append(" ".join(chain[k * 4 : k * 4 + 60]))
    rows += [" ".join(words(30) + passage + words(30)) for _ in range(15)]
    rows += ["A B c D e", "a b C d e", "a b c d", "É b c d e f", "é b c d e f", "", " \t\n", None, "x", "x", "x y"]
    rows += [" ".join(words(5000))] * 2
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)] + [(None, rows[0]), (0, rows[0])]


def brute(rows, width=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    least = {i: i for i in sets if i is not None}
    links = [(a, b) for a in least for b in least if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return Counter((i, len(sets[i]), least.get(i)) for i, _ in rows)


@pytest.mark.parametrize("block", [3, 1024])
def test_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, component_id int").repartition(5)
    want = brute(rows)
    assert Counter(map(tuple, jaccard_join.join(df).collect())) == want
    assert any(i != c for i, _, c in want if i is not None)


def test_join_sql(spark):
    rows = [r for r in corpus() if r[0] is not None][:-1]
    con = duckdb.connect()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    con.register("documents", df.toArrow())
    assert Counter(con.execute(jaccard_join.SQL).fetchall()) == Counter(map(tuple, jaccard_join.join(df).collect()))


def test_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id bigint")
    kept = jaccard_join.keep_one(df)
    assert kept.schema["text"] == df.schema["text"] and set(kept.columns) == {"text", "doc_id"}
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in brute(rows) if i == c or i is None}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard_join.join(df).count() == 0 and jaccard_join.keep_one(df).count() == 0


def test_many_near_copies(spark):
    base = words(120)
    rows = []
    for k in range(300):
        c = list(base)
        c[k % 120] = f"edit{k}"
        rows.append((k, " ".join(c)))
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_all_pairs(seed):
    r = np.random.default_rng(seed)
    sets = []
    for _ in range(40):
        s = r.integers(0, 2**63, r.integers(1, 400)).astype(np.uint64)
        sets += [np.unique(s), np.unique(np.concatenate([s[: int(len(s) * r.uniform(0.6, 1))], r.integers(0, 2**63, 5).astype(np.uint64)]))]
    n = np.array(list(map(len, sets)))
    counts = np.stack([count_tree.count_vector(s) for s in sets])
    overlap = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    for i in range(0, 80, 7):
        for j in range(80):
            assert overlap(i, j) <= count_tree.bound(counts[i], counts[j])
    verify = lambda i, j: bool(count_tree.enough(overlap(i, j), n[i], n[j], 75))
    edges = count_tree.CountTree(counts, n).forest(75, verify)
    found, want = count_tree.Sets(80), count_tree.Sets(80)
    for i, j in edges:
        assert verify(i, j)
        found.join(i, j)
    for i in range(80):
        for j in range(i):
            if verify(i, j):
                want.join(i, j)
    same = lambda s: {(i, j) for i in range(80) for j in range(i) if s.find(i) == s.find(j)}
    assert same(found) == same(want)


def test_full_counts_bound_nothing_away():
    h = np.arange(100_000, dtype=np.uint64)  # all in one group
    v = count_tree.count_vector(h)
    assert v.max() == count_tree.FULL and count_tree.bound(v, v) >= 100_000


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 3)] + [(k, k + 1) for k in range(100, 160)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    want = {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7} | dict.fromkeys(range(100, 161), 100)
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def jaccard(a, b):
    x, y = (set(shingle_hashes(t.encode()).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_edit_neighbours(spark, monkeypatch, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = [(k * 3, " ".join(words(rng.choice([0, 1, 4, 50, 300]))) + "é漢") for k in range(60)] + [(500, None), (501, ""), (-4, "minus")]
        df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id bigint, text string, range bigint").repartition(3)
        got = {r.doc_id: r for r in fingerprints.edit_neighbours(df).collect()}
        import hashlib

        order = sorted(rows, key=lambda r: -r[0])
        for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
            t, u, r = t or "", u or "", got[i]
            cut = len(t) // 3
            edited = t[: len(t) - cut] + u[:cut]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert abs(r.near_edited - jaccard(t, edited)) < 0.2 and abs(r.near_next - jaccard(t, u)) < 0.2
            assert r.fingerprint == str(fingerprints.BottomK.of(t.encode()))
        assert len(got) == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_edit_neighbours_of_ids_with_many_rows(spark, parts):
    """Null, the lowest id and one other id have most rows; each is cut by its texts and the order stays whole."""
    rows = [(k, " ".join(words(12))) for k in range(20)] + [(k, " ".join(words(9))) for k in (None, 7, -(1 << 63)) for _ in range(60)] + [(7, "same " * 30), (None, None)] * 15
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        hashed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
        got = Counter(map(tuple, fingerprints.edit_neighbours(df).select("doc_id", "n_chars", "edited_sha256").collect()))
        dealt = fingerprints._cuts(df.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("tie")), parts)[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    low, high = -(1 << 63), (1 << 63) - 1
    tie = lambda r: r.h & high if r.doc_id is None else r.h | low
    line = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), tie(r)))
    edited = lambda a, b: a[: len(a) - len(a) // 3] + b[: len(a) // 3]
    want = Counter((a.doc_id, len(a.text), hashlib.sha256(edited(a.text, b.text).encode()).hexdigest()) for a, b in zip(line, line[1:] + line[:1], strict=True))
    assert got == want
    assert parts == 1 or len(dealt) < parts
    assert parts < 8 or len(dealt) >= 5


def test_edit_neighbours_of_odd_tables(spark):
    f = lambda rows: fingerprints.edit_neighbours(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert f([]) == []
    (one,) = f([(1, "a b c d e f")])
    assert one.near_next == 1.0
    assert len(f([(1, "x"), (1, "x"), (1, "y"), (None, "z"), (None, None), (2, "q")])) == 6
    assert len(f([(None, "a"), (None, "b")])) == 2


def test_sketches_merge_and_estimate():
    a, b = (np.unique(np.random.default_rng(s).integers(0, 2**63, 6000).astype(np.uint64) * np.uint64(2)) for s in (1, 2))
    x, y = np.concatenate([a, b[::2]]), b
    make = lambda h: fingerprints.BottomK(128, np.sort(h)[:128])
    p, q = make(np.unique(x)), make(y)
    assert p.merge(q).hashes.tolist() == np.unique(np.concatenate([x, y]))[:128].tolist()
    assert abs(p.resemblance(q) - 3000 / 12000) < 0.13 and abs(q.containment(p) - 0.5) < 0.25
    assert abs(p.distinct() / 9000 - 1) < 0.3
    assert str(fingerprints.BottomK.parse(str(p))) == str(p)
    empty = fingerprints.BottomK.of(b"")
    assert empty.resemblance(empty) == 1.0 and empty.resemblance(p) == 0.0 and empty.containment(p) == 1.0 and empty.distinct() == 0


def test_merge_parts_natively(spark):
    rows = [(k % 2, " ".join(words(400))) for k in range(6)] + [(0, ""), (2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.merge_parts(fingerprints.sketch(df), "doc_id").collect()}
    for g in (0, 1):
        want = None
        for i, t in rows:
            if i == g:
                s = fingerprints.BottomK.of((t or "").encode())
                want = want.merge(s) if want else s
        assert got[g] == str(want)


def plain_sketch(text, k=128, width=5):
    """Bottom-k in plain integers: word hashes, folded over a window, mixed; the k smallest distinct ones."""
    import xxhash

    odd = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
    full, found = 1 << 64, set()
    hashes = [xxhash.xxh64_intdigest(w) for w in text.encode().split()]
    size = min(width, len(hashes))
    for i in range(len(hashes) - size + 1 if hashes else 0):
        v = size
        for j in range(size):
            v = (v + hashes[i + j]) * odd[j] % full
            v ^= v >> 29
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 % full
        v = (v ^ v >> 27) * 0x94D049BB133111EB % full
        found.add(v ^ v >> 31)
    return sorted(found)[:k]


def plain_likeness(x, y, k=128):
    union = sorted(set(x) | set(y))[:k]
    return sum(v in x and v in y for v in union) / len(union) if union else 1.0


def test_fingerprints_against_a_plain_sketch(spark):
    import base64

    rows = [(k, " ".join(words(n))) for k, n in enumerate([0, 1, 4, 5, 6, 40, 200, 3000, 20_000])] + [(50, "é漢 " * 9), (51, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fingerprint string")
    got = {r.doc_id: r for r in fingerprints.edit_neighbours(df).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        cut = len(t) // 3
        own, edited, following = (plain_sketch(x) for x in (t, t[: len(t) - cut] + u[:cut], u))
        encode = lambda h: "128:" + base64.b64encode(b"".join(v.to_bytes(8, "little") for v in h)).decode()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (encode(own), encode(edited))
        assert got[i].near_edited == plain_likeness(own, edited) and got[i].near_next == plain_likeness(own, following)
