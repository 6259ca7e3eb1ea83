import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloudgrid.llm import byte_bpe, packing, pieces, token_files

P = pytest.importorskip("public_tokenizers")
ALPHABET = "ab  \n\n\t\r.,!'s\x01é́<|endoftext|>1２　\x1c'LL"
rng = random.Random(5)
TEXTS = ["", " ", "\n", "a", " a", "a ", "a\n\nb", "a  b", "a \rb", "it's DON'T", "Ωσς ß", "<|endoftext|> x", "é", "日本 語", "x" * 3000]
TEXTS += ["a <|endoftext|> b", "a<|endoftext|><|startoftext|>b c", "A <|EndOfText|> b", "foo\n<|startoftext|> bar"]
TEXTS += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(400)]
TEXTS += [" ".join(rng.choice(["foo", "bar,", "it's", "\x01", "Aé"]) for _ in range(rng.randint(1, 3000))) for _ in range(3)]


def rows():
    return [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, None, "x"), (None, "null id", "x"), (3, TEXTS[3], "x"), (10**12, None, "x"), (-5, "negative", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id bigint, text string, ids string").repartition(3)


def tokenizer(name, special_as_text=False):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = special_as_text
    return t


@pytest.mark.parametrize("name, mode", [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "word"), ("word_bpe_49k.json", "whole")])
@pytest.mark.parametrize("as_text", [False, True])
def test_pieces_give_the_same_ids(name, mode, as_text):
    t, e = tokenizer(name, as_text), pieces.tokenizers_encoder(pieces.read_model(P.path(name)), mode, as_text)
    for _ in range(2):
        for text, got in zip(TEXTS, e.encode(TEXTS), strict=True):
            assert pieces.array(e.code, got).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_piece_table(monkeypatch):
    for name, n in (("HOT", 20), ("RECENT", 30), ("PACKED", 200)):
        monkeypatch.setattr(pieces, name, n)
    table, ids = pieces.PieceTable(), {f"w{k}": b"%d" % k for k in range(1000)}
    for _ in range(3):
        for at in range(0, 1000, 7):
            some = [f"w{k}" for k in range(at, min(1000, at + 7))]
            found = table.get(some)
            assert all(v is None or v == ids[p] for p, v in zip(some, found, strict=True))
            table.add({p: ids[p] for p, v in zip(some, found, strict=True) if v is None})
            if len(table.high) < 200:
                assert table.get(some) == [ids[p] for p in some]
    assert table.get(["w1"]) == [b"1"] and len(table.high) <= 250


@given(st.lists(st.integers(0, 10**6), max_size=2000))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.int64))
    ef = token_files.EliasFano.encode(values)
    assert ef.values().tolist() == values.tolist()
    assert [ef.select(i) for i in range(0, len(values), 37)] == values[::37].tolist()
    if len(values) > 100:
        assert ef.n_bytes * 8 <= len(values) * (3 + np.log2(max(2, values[-1] / len(values)))) + 8 * (64 + len(ef.samples))
    with pytest.raises(IndexError):
        ef.select(len(values))
    for v in (0, 7, 500_000, *values[::50].tolist()):
        assert ef.rank(v) == np.searchsorted(values, v, side="right")


def test_shards_are_read_by_select(tmp_path, monkeypatch):
    """No table of all bounds: values() isn't called, whatever the stretches are."""
    monkeypatch.setattr(token_files.EliasFano, "values", None)
    docs = [None, None, -3, -3, 0, 5, 1 << 40]
    lengths = [1, 4, 1, 300, 2, 7, 1]
    ids = np.arange(sum(lengths), dtype="<u2")
    path = str(tmp_path / "x.tok")
    token_files.write_file(path, token_files.shard_bytes(docs, np.cumsum(lengths), [ids.tobytes()], 2))
    for stretch in (1, 5, 1000):
        monkeypatch.setattr(token_files, "STRETCH", stretch)
        shard = token_files.Shard(path)
        got = list(shard.documents())
        assert [d for d, _, _ in got] == docs and [len(x) for _, _, x in got] == lengths
        assert np.concatenate([x for _, _, x in got]).tolist() == ids.tolist()
        shard.close()


def test_token_files(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 5000)
    manifest = token_files.write(docs, pieces.read_model(P.path("byte_bpe_50k.json")), 2, mode="byte_level")
    t = tokenizer("byte_bpe_50k.json")
    got = {}
    for r in token_files.read(manifest).collect():
        got[r.start] = r
    start = 0
    for doc in sorted((r for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0)):
        if doc[0] is None:
            start = None
        elif start is None:
            start = sum(len(t.encode(x[1] or "", add_special_tokens=False).ids) + 1 for x in rows() if x[0] is None)
        if start is not None:
            ids = t.encode(doc[1] or "", add_special_tokens=False).ids + [2]
            assert got[start].doc_id == doc[0] and got[start].ids == ids
            start += len(ids)
    assert len(got) == len(rows()) and got[0].doc_id is None
    total = manifest.groupBy().sum("n_ids", "n_docs").first()
    assert tuple(total) == (start, len(rows())) and manifest.count() > 1
    digests = token_files.read_digests(manifest).collect()
    assert {(r.start, r.n_tokens, r.ids_crc32) for r in digests} == {(s, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for s, r in got.items()}
    some = got[max(s for s in got if s < start // 2)]
    assert token_files.read_one(spark, manifest, some.start).tolist() == some.ids


def test_token_files_empty(spark, docs):
    manifest = token_files.write(docs.limit(0), pieces.read_model(P.path("byte_bpe_50k.json")), 2)
    assert manifest.count() == 0 and token_files.read(manifest).count() == 0


def test_byte_bpe_like_tiktoken(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    model = byte_bpe.serialise(ranks)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in byte_bpe.encode(docs, model, P.PATTERN).collect())
    assert got == Counter((i, tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows())
    for r in byte_bpe.digests(docs, model, P.PATTERN).where("doc_id = 9").collect():
        ids = own.encode_ordinary(TEXTS[9])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TEXTS[9].encode()).hexdigest())


@settings(deadline=None)  # the first example loads the model
@given(st.text())
def test_byte_bpe_round_trip(text):
    bpe = byte_bpe.worker_bpe(MODEL, P.PATTERN)
    (ids,) = bpe.encode([text.encode("utf-8", "ignore").decode()])
    assert bpe.decode(ids) == text.encode("utf-8", "ignore")


MODEL = byte_bpe.serialise(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0, b"b": 2})


@pytest.mark.parametrize("n, bits", [(2, 4), (3, 3)])
def test_hilbert_walks_to_neighbours(n, bits):
    axes = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
    keys = packing.hilbert(axes, bits)
    assert sorted(keys.tolist()) == list(range(1 << n * bits))
    walk = axes[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("length", [8, 64, 4096])
def test_packing(docs, length):
    t = tokenizer("word_bpe_49k.json")
    got = packing.pack(docs, pieces.read_model(P.path("word_bpe_49k.json")), 2, 49408, length, "word").collect()
    sequences = defaultdict(list)
    for r in got:
        assert len(r.ids) == 2 * r.length and r.length > 0
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and (at == length or at & (at - 1) == 0)
    want = Counter()
    for i, text, _ in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want[i] += len(ids)
        if i is not None and i != 3:
            own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
            assert b"".join(r.ids for r in own) == np.array(ids, "<u2").tobytes()
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
            assert {r.doc_tokens for r in own} == {len(ids)}
    have = Counter()
    for r in got:
        have[r.doc_id] += r.length
    assert have == want


def test_packing_puts_copies_together(spark):
    base = [f"word{k} common text number {k}" for k in range(60)]
    df = spark.createDataFrame([(j * 60 + k, t) for j in range(3) for k, t in enumerate(base)], "doc_id bigint, text string")
    got = packing.tokens(df, pieces.read_model(P.path("word_bpe_49k.json")), 2, 49408, "word").collect()
    key = {r.id: r.key for r in got}
    assert all(key[k] == key[k + 60] == key[k + 120] for k in range(60))
    assert packing.pack(df.limit(0), pieces.read_model(P.path("word_bpe_49k.json")), 2, 49408).count() == 0


def test_a_full_piece_table_keeps_what_was_met_again(monkeypatch):
    for name, n in (("HOT", 5), ("RECENT", 20), ("PACKED", 300)):
        monkeypatch.setattr(pieces, name, n)
    rng, t, kept = random.Random(3), pieces.PieceTable(), []
    ids = lambda p: p.encode() * (len(p) % 4)
    often = [f"o{k}" for k in range(60)]
    for k in range(400):
        asked = list(dict.fromkeys([*rng.sample(often, 12), *(f"x{k}-{j}" for j in range(6))]))
        got = t.get(asked)
        assert all(g is None or g == ids(p) for g, p in zip(got, asked, strict=True))
        kept.append(sum(g is not None for g in got[:12]))
        t.add({p: ids(p) for p, g in zip(asked, got, strict=True) if g is None})
        assert len(t.high) <= 300 + 60 and len(t.blob) == t.size.sum()
    assert sum(kept[100:]) > 0.95 * 12 * 300  # once in, the frequent ones stay
