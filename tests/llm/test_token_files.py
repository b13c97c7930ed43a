import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.common import stored
from tidemark.llm.token_files import WaveletFile, read_token_files, write_file, write_token_files
from tidemark.llm.units import UnitEncoder

from .conftest import edge_rows

tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
TEXTS = ["", " ", "  a b", "a  b \n c", "\n\n a's 'x \x1c z", "\xa0 foo  bar", "a\r\n  b ", "<|endoftext|> x", " \x1c a", "é é ́", "Stop. Go, now... THE End.", "can't won't I'LL", "日本語 text 123,456.", "x" * 3000]


KINDS = [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)]


PLAIN = {}


def plain(path, texts):
    """Ids of a tokenizer as its file makes it, by whole texts."""
    t = PLAIN.setdefault(path, Tokenizer.from_file(path))
    return [np.array(x.ids, np.uint32).tobytes() for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def same(e, texts):
    ids, ends = e.encode(pa.array(texts, pa.string()))
    got = [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    for text, x, y in zip(texts, got, plain(e.path, texts), strict=True):
        assert x == y, repr(text)


@pytest.mark.parametrize(("name", "drops"), KINDS)
def test_texts_with_added_tokens(name, drops):
    e, r = UnitEncoder(tokenizers.path(name), drops), np.random.default_rng(4)
    added = ["<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "<|", "<|endoftext", "endoftext|>", " <|endoftext|> ", "<|endoftext|><|endoftext|>"]
    parts = [*added, "a", " b", "The end.", "\n\n", "  ", "é", "I'm", "<", "|>"]
    texts = ["".join(r.choice(parts, r.integers(1, 9))) for _ in range(400)]
    same(e, [*TEXTS, *added, *texts, None, ""])
    for t in added:
        same(e, [t])
    assert any(np.frombuffer(x, np.uint32).max(initial=0) >= 49_406 for x in plain(e.path, texts)), "added tokens have ids of their own"


@pytest.mark.parametrize(("name", "drops"), KINDS)
def test_units_give_the_library_s_ids(name, drops):
    e = UnitEncoder(tokenizers.path(name), drops, memo_bytes=2000)
    texts = [*TEXTS, None, *(t or "" for _, t in edge_rows())]
    same(e, texts)
    for t in texts:  # with a warm memo, one by one
        same(e, [t])
    same(e, [])


def character(r):
    """Any character but surrogates; often ASCII, white space of any kind, letters that change when folded, marks, or what stands between units."""
    return r.choice([lambda: chr(r.randrange(32, 127)), lambda: chr(r.choice([*range(0x250), *range(0x300, 0x370), *range(0x1E00, 0x2100)])), lambda: r.choice(" .,'  \n\t\x1c\x85\xa0\u2003\u2028\u3000"), lambda: r.choice("İıſKÅßẞǅﬀꙮ\u0307\u0331\u0301²Ⅷ٣日🙂"), lambda: chr(r.choice([r.randrange(0x250, 0xD800), r.randrange(0xE000, 0x110000)]))])()


ENCODERS = {}


@pytest.mark.parametrize(("name", "drops"), KINDS)
@given(st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_units_of_any_text(name, drops, r):
    e = ENCODERS.setdefault(name, UnitEncoder(tokenizers.path(name), drops, memo_bytes=20_000))
    same(e, ["".join(character(r) for _ in range(r.randrange(15))) for _ in range(30)])


@pytest.mark.parametrize(("name", "drops"), KINDS)
def test_units_of_every_letter_before_marks(name, drops):
    e = UnitEncoder(tokenizers.path(name), drops)
    same(e, [f"{x}{chr(c)}{y}" for c in range(0x21, 0x250) for x, y in (("", "."), ("a", ","), (" b", "'s "), ("", "\u0331"))])


@pytest.mark.parametrize("n", [0, 1, 5, 70_000])
def test_wavelet_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).astype(np.int64) % 50_257
    f = WaveletFile(write_file(np.array([7, 9]), np.array([n // 2, n - n // 2]), ids))
    assert (f.ids() == ids).all() and f.doc_ids.tolist() == [7, 9] and f.ends.tolist() == [n // 2, n]
    for i in range(0, n, max(1, n // 7)):
        assert f.access(i) == ids[i]
        token = int(ids[i])
        assert f.rank(token, i) == int((ids[:i] == token).sum())
        assert f.count(token) == int((ids == token).sum())
        assert f.select(token, f.rank(token, i)) == i
    assert list(f.doc_ids) == [7, 9] and not f.null.any()
    assert f.count(50_256 if n < 5 else 65_000) == int((ids == 50_256).sum() if n < 5 else 0)
    if n == 70_000:
        assert list(f.occurrences(77)) == np.flatnonzero(ids == 77).tolist()
        with pytest.raises(IndexError):
            f.select(65_000, 0)


def test_files_against_the_library(spark, edge, none):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = read_token_files(stored(write_token_files(edge, path, shard_tokens=500), "files")).collect()
    start, want = 0, []
    for doc, text in sorted(edge_rows(), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert read_token_files(stored(write_token_files(none, path), "files")).count() == 0


def test_planes_follow_the_vocabulary():
    ids = np.array([0, 70_000, 5, 131_071])
    f = WaveletFile(write_file(np.array([1]), np.array([4]), ids))
    assert f.planes == 17 and f.ids().tolist() == ids.tolist() and f.access(1) == 70_000 and f.count(5) == 1
    with pytest.raises(ValueError):
        write_file(np.array([1]), np.array([4]), ids, planes=16)
    assert WaveletFile(write_file(np.array([1]), np.array([0]), ids[:0], planes=16)).ids().tolist() == []
