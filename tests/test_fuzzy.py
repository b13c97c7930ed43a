"""Similar titles against all pairs, at small sizes of cells too."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import title_fingerprint
from tidemark.operators import fuzzy as Z
from tidemark.plans.catalog import story_records


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id string, title string")


@pytest.fixture(scope="module")
def edited():
    """Titles with copies in title case, with a wrong character in every 8, with words swapped, cut or added, and short ones."""
    r, rows = random.Random(3), {}
    for k in range(40):
        words = ["".join(r.choices("abcdeilmnorst", k=r.randint(5, 9))) for _ in range(12)]
        t = " ".join(words)
        swapped, cut = [*words[:4], words[5], words[4], *words[6:]], words[:11]
        rows |= {f"{k:03}a": t, f"{k:03}b": t.title(), f"{k:03}c": "".join("#" if i % 8 == 7 else c for i, c in enumerate(t)), f"{k:03}d": " ".join(swapped), f"{k:03}e": " ".join(cut)}
        rows |= {f"{k:03}f": "".join(r.choices("abcdei ", k=r.randint(2, 30))), f"{k:03}g": "é" * r.randint(1, 9) + "ab" * r.randint(0, 9)}
    taken = {}
    return {i: t for i, t in rows.items() if taken.setdefault(t, i) == i} | {"n": None, "o": ""}


@pytest.mark.parametrize(("least", "crowded"), [(0.85, 2_000), (0.85, 7), (0.93, 2_000), (0.6, 50)])
def test_pairs_are_those_of_all_pairs(spark, edited, monkeypatch, least, crowded):
    monkeypatch.setattr(Z, "CROWDED", crowded)
    got = {(x.a, x.b): x.ratio for x in Z.fuzzy_pairs(frame(spark, edited), least).collect()}
    want = {(a, b): round(ratio(edited[a], edited[b]), 6) for a, b in combinations(sorted(edited), 2) if edited[a] and edited[b] and ratio(edited[a], edited[b]) >= least}
    assert got == want and len(want) > 60


@pytest.mark.parametrize("crowded", [2_000, 5])
def test_best_matches_between_two_tables(spark, edited, monkeypatch, crowded):
    monkeypatch.setattr(Z, "CROWDED", crowded)
    left = {i: t for i, t in edited.items() if i[-1] in "adg"}
    right = {i: t for i, t in edited.items() if i[-1] in "bcef"} | {"x" + i: t for i, t in left.items() if i[0] == "0" and i[-1] == "a"}
    got = {x.id: (x.match, x.ratio) for x in Z.best_match(frame(spark, left), frame(spark, right), 0.88).collect()}
    want = {}
    for i, t in left.items():
        hits = [(-round(ratio(t, u), 6), j) for j, u in right.items() if t and u and ratio(t, u) >= 0.88]
        if hits:
            want[i] = (min(hits)[1], -min(hits)[0])
    assert got == want and len(want) > 40


def test_record_titles_and_how_many_are_compared(spark, sf_dir):
    t = story_records(spark, sf_dir).groupBy(title_fingerprint("title", V.TITLE_STOPWORDS).alias("title")).agg(F.min("record_id").alias("id")).select("id", "title")
    rows = {r.id: r.title for r in t.collect() if r.title}
    got = {(r.a, r.b) for r in Z.fuzzy_pairs(t, 0.85).collect()}
    want = {(a, b) for a, b in combinations(sorted(rows), 2) if ratio(rows[a], rows[b]) >= 0.85}
    compared = Z.candidates(Z.signed(t), 0.85).count()
    print(f"{len(rows)} titles, {compared} of {len(rows) * (len(rows) - 1) // 2} pairs compared, {len(want)} similar")
    assert got == want and want
    assert compared < 0.1 * len(rows) * (len(rows) - 1) / 2


def test_a_pair_that_may_reach_the_ratio_has_a_common_gram():
    assert [Z.gram_size(r) for r in (0.5, 0.85)] == [1, 2]
    assert Z.least_common(10, 20, 0.85, 2) == 0 and Z.least_common(80, 80, 0.85, 2) == 68 - 25


def test_few_pairs_leave_the_cells_that_are_not_similar(spark, edited):
    some = {i: t for i, t in edited.items() if t and i[-1] in "abcde"}
    similar = sum(ratio(some[a], some[b]) >= 0.85 for a, b in combinations(sorted(some), 2))
    t = Z.signed(frame(spark, some))
    assert "c" not in t.columns  # counts are made in the cells and go through no join
    assert similar <= Z.candidates(t, 0.85).count() <= 1.25 * similar


def test_no_match_is_longer_than_the_common_subsequence():
    r = random.Random(8)
    for _ in range(300):
        a, b = ("".join(r.choices("abcé日", k=r.randint(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        m = sum(block.size for block in SequenceMatcher(None, a, b).get_matching_blocks())
        assert Z.common_length(masks, len(a), b) == row[-1] >= m


def test_a_title_goes_out_once_for_each_of_few_parts(spark, edited, monkeypatch):
    monkeypatch.setattr(Z, "CROWDED", 2)
    dealt, spread = [], Z.spread
    monkeypatch.setattr(Z, "spread", lambda rows, *c: (dealt.append(rows.count()) if c == ("cell",) else None, spread(rows, *c))[1])
    t = Z.signed(frame(spark, edited))
    Z.candidates(t, 0.85)
    assert len(dealt) == 1 and dealt[0] <= 32 * t.count()
