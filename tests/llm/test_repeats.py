import hashlib
import os
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import substrings, suffixes
from tidemark.llm.near_dedup import drop_near_duplicates
from tidemark.llm.windows import covered, placed_runs, runs, words

from .conftest import LONG, edge_rows


@given(st.binary(max_size=300), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_suffix_array_and_prefixes(data, alphabet):
    data = bytes(b % alphabet for b in data)
    a = np.frombuffer(data, np.uint8)
    order, words = suffixes.suffix_array(a)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    order, words = suffixes.suffix_array(a, 64)
    got = suffixes.common_prefixes(a, order, words, 40, stride=4)
    for k in range(1, len(data)):
        x, y = data[order[k - 1] :], data[order[k] :]
        n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert got[k] == min(n, 40)


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_runs_hold_every_window_that_may_repeat(docs):
    n, k = 8, 3
    h = np.array([x * 7919 + 1 for d in docs for x in d], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum([len(d) for d in docs], dtype=np.int64)
    anchor, start, count, own, again = runs(h, ends, n, k)
    at, place = {}, Counter()
    for m, s, c, o, g in zip(anchor.tolist(), start.tolist(), count.tolist(), own.tolist(), again.tolist(), strict=True):
        for i in range(s, s + c):
            at[o, i - (ends[o] - len(docs[o]))] = (m, g)
        place[m] += 1
    windows = {(d, i): tuple(x[i : i + n]) for d, x in enumerate(docs) for i in range(len(x) - n + 1)}
    assert set(at) == set(windows)
    seen = Counter(windows.values())
    for where, w in windows.items():
        if seen[w] > 1:
            m, g = at[where]
            assert place[m] > 1 or g


def words_left(rows, n):
    seen = Counter()
    split = [(t or "").encode().split() for _, t in rows]
    for w in split:
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        hit = [i for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1]
        gone = covered(np.array(hit, np.int64), np.ones(len(hit), np.int64), n, len(w))
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((doc, len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 3])
def test_words_against_brute_force(spark, edge, none, batches):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.cut_repeats(edge, batches).collect())
    assert got == words_left(edge_rows(), 35)
    assert substrings.cut_repeats(none).count() == 0


def test_index_meets_old_and_new_compacts_and_opens(spark):
    row = lambda i, t: spark.createDataFrame([(i, t)], "doc_id long, text string")
    index = substrings.FingerprintIndex(spark, fan_in=2)
    assert index.add(row(1, LONG)).count() == 0
    assert index.add(row(2, "nothing to see")).count() == 0
    before = index.entries().count()
    assert index.add(row(3, "x " + LONG)).count() > 0
    assert len(index.runs) == 1 and index.entries().count() > before
    # another session of work
    again = substrings.FingerprintIndex.open(spark, index.path)
    assert (again.runs, again.fan_in, again.n, again.k, again.state) == (index.runs, 2, 35, 6, index.state)
    assert again.add(row(4, LONG + " y")).count() > 0 and again.add(row(5, "z " * 20)).count() == 0
    assert len(substrings.FingerprintIndex.open(spark, index.path).runs) == len(again.runs)
    with pytest.raises(ValueError):
        substrings.FingerprintIndex.open(spark, again.path + "/" + again.runs[0])
    again.drop()


def test_the_query_compacts(spark, edge, monkeypatch):
    seen, compact = [], substrings.FingerprintIndex.compact
    monkeypatch.setattr(substrings.FingerprintIndex, "compact", lambda self: (seen.append(len(self.runs)), compact(self)))
    substrings.cut_repeats(edge).count()
    assert seen == [3]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x1cé日", max_size=60)), max_size=6), st.booleans(), st.integers(0, 2))
@settings(max_examples=150, deadline=None)
def test_word_hashes(texts, lower, skip):
    texts = [t and t.replace("日", "日" * 100) for t in texts]
    h, ends = words(pa.array(texts, pa.string())[skip:], lower)
    split = [(t or "").encode().lower().split() if lower else (t or "").encode().split() for t in texts[skip:]]
    flat = [w for x in split for w in x]
    assert ends.tolist() == np.cumsum([len(x) for x in split]).astype(int).tolist()
    assert len(h) == len(flat) and len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def test_rows_keep_clashing_columns(spark):
    rows = [(1, LONG, 1, "a", "b", "c", 7), (2, "x " + LONG, 2, "d", "e", "f", 8), (3, None, 3, "g", "h", "i", 9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _runs int, mark string, runs string, row string, n_chars long")
    got = {tuple(r) for r in substrings.drop_repeats(docs).collect()}
    assert got == {(2, "x", 2, "d", "e", "f", 1), (3, None, 3, "g", "h", "i", 9)}
    assert {tuple(r) for r in drop_near_duplicates(docs).collect()} == {rows[0], rows[2]}


def test_drop_repeats_keeps_clean_rows(spark, edge):
    out = {(r.doc_id, r.text) for r in substrings.drop_repeats(edge).collect()}
    assert {(2, ""), (1, None), (15, "a\n\n b  c"), (14, "row twice")} <= out
    assert not {d for d, _ in out} & {6, 7, 10} and (8, "tail") in out and (9, "head words before and after") in out
    assert substrings.drop_repeats(edge).columns == edge.columns


def bytes_left(rows, n):
    seen, out = set(), []
    order = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    done = {}
    for key in order:
        b = key[1].encode()
        hit = []
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            hit += [i] if w in seen else []
            seen.add(w)
        gone = covered(np.array(hit, np.int64), np.ones(len(hit), np.int64), n, len(b))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        done[key] = (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    for d, t in rows:
        out.append((d, *done[d, t or ""]))
    return Counter(out)


@pytest.mark.parametrize("most", [20_000, 2])
def test_bytes_against_brute_force(spark, edge, most, monkeypatch):
    whole = suffixes.late_windows
    monkeypatch.setattr(suffixes, "late_windows", lambda docs, n: whole(docs, n, shard_segments=most, shard_bytes=2000))
    rows = edge_rows() + [(20 + i, f"{i} before {LONG[:150]} {i * 37} after {i} {LONG[20:190]}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.cut_repeats(docs).collect())
    assert got == bytes_left(rows, 100)


def test_bytes_of_nothing(spark, none):
    assert suffixes.cut_repeats(none).count() == 0


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_equal_windows_have_their_anchor_at_one_place(docs):
    n, k = 8, 3
    h = np.array([x * 7919 + 1 for d in docs for x in d], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    symbols = [x for d in docs for x in d]
    seen, double = {}, set()
    anchor, start, count, _, again, at = placed_runs(h, np.cumsum([len(d) for d in docs], dtype=np.int64), n, k)
    for m, s, c, g, a in zip(anchor.tolist(), start.tolist(), count.tolist(), again.tolist(), at.tolist(), strict=True):
        double |= {m} if g else set()
        assert g or c - 1 <= a <= n - k
        for i in range(c):
            seen.setdefault((m, tuple(symbols[s + i : s + i + n])), set()).add(a - i)
    assert all(len(places) == 1 for (m, _), places in seen.items() if m not in double)


def test_only_segments_that_may_repeat_are_sorted(spark, monkeypatch):
    sorted_, whole = [], suffixes.stored

    def spy(df, name, **options):
        out = whole(df, name, **options)
        if name == "owners":
            sorted_.extend(r.doc_id for r in out.collect())
        return out

    monkeypatch.setattr(suffixes, "stored", spy)
    r = np.random.default_rng(5)
    noise = lambda size: "".join(map(chr, r.integers(97, 123, size)))
    phrase, passage = noise(40), noise(110)
    rows = [(d, noise(150) + phrase + noise(150)) for d in range(20)] + [(20, noise(90) + passage + noise(90)), (21, noise(70) + passage + noise(120))]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == bytes_left(rows, 100) and set(sorted_) == {20, 21}


def test_shuffle_files_go_with_their_step(spark, edge, monkeypatch):
    roots = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for r in roots for _, _, names in os.walk(r) for f in names if f.startswith("shuffle_")}
    left, whole, before = [], suffixes.stored, files()

    def spy(df, name, **options):
        out = whole(df, name, **options)
        suffixes.release(spark)
        until = time.time() + 5  # they are removed in the background
        while files() - before and time.time() < until:
            time.sleep(0.1)
        left.append((name, len(files() - before)))
        return out

    monkeypatch.setattr(suffixes, "stored", spy)
    assert suffixes.cut_repeats(edge).count() == edge.count()
    assert len(left) > 7 and not [x for x in left if x[1]]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
