import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.common import stored
from tidemark.llm.packing import bin_types, cut_pieces, improve, least_bins, longest_first, pack, places, plan_bins

from .conftest import edge_rows

tokenizers = pytest.importorskip("public_tokenizers")


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12), st.sampled_from([bin_types, longest_first]))
@settings(max_examples=150, deadline=None)
def test_plan_holds_every_piece_once(histogram, start):
    first = start(histogram, 50)
    plan = improve(first, 50)
    held = Counter()
    for b, copies in plan.items():
        assert sum(b) <= 50 and copies > 0
        for n in b:
            held[n] += copies
    assert held == Counter(histogram)
    assert least_bins(plan, 50) <= sum(plan.values()) <= sum(first.values())
    if sum(plan.values()) < sum(first.values()):
        assert sum(sum(b) ** 2 * c for b, c in plan.items()) > sum(sum(b) ** 2 * c for b, c in first.items())
    for n, rows in places(plan).items():
        assert rows[0, 0] == 0


@pytest.mark.parametrize(("start", "bins"), [([(4,), (6,)], 1), ([(5, 3), (6, 2), (4,)], 2)])
def test_moves_and_exchanges_empty_bins(start, bins):
    assert sum(improve(Counter(start), 10).values()) == bins


def test_search_saves_bins_of_a_best_fit_plan():
    r = np.random.default_rng(1)
    for low, high in ((1200, 2800), (900, 2048), (20, 3000)):
        h = Counter(r.integers(low, high, 2000).tolist())
        first = bin_types(h, 4096)
        found = improve(first, 4096)
        assert least_bins(first, 4096) <= sum(found.values()) < sum(first.values())
        assert sum(plan_bins(h, 4096).values()) <= min(sum(found.values()), sum(longest_first(h, 4096).values()))


def test_pack_leaves_other_columns_alone(spark):
    rows = [(i, 0, k, 5 + i % 3, f"r{i}", 7, 8, 9, 10, 11) for k, i in enumerate(range(30))]
    pieces = spark.createDataFrame(rows, "doc_id long, part int, nth long, length long, before string, _rank int, _place int, sequence_id int, p int, n int")
    got = pack(pieces, 16)
    assert set(got.columns) == {*pieces.columns, "offset"}
    assert {(r.doc_id, r.before, r["_rank"], r["_place"], r.p, r.n) for r in got.collect()} == {(r[0], r[4], 7, 8, 10, 11) for r in rows}


def test_pack_against_the_library(spark, edge, none):
    from tokenizers import Tokenizer

    path, cap = tokenizers.path("word_bpe_49k.json"), 512
    t = Tokenizer.from_file(path)
    rows = pack(stored(cut_pieces(edge, path, cap, 1, True), "pieces"), cap).collect()
    want = Counter()
    for doc, text in edge_rows():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), cap):
            part = ids[k : k + cap]
            want[doc, k // cap, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    total = sum(r.length for r in rows)
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= cap
    assert len(bins) <= -(-total // cap) + 2
    assert pack(stored(cut_pieces(none, path, cap, 1, True), "pieces"), cap).count() == 0
