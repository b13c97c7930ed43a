import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.simhash import link, simhash_components

from .conftest import edge_rows


def brute(rows):
    fps = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[a : a + 3]) for a in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return fps


def groups(fps, most):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_engine_hash_is_the_contract_s(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_edges_against_brute_force(spark, edge, none):
    rows = edge_rows()
    fps = brute(rows)
    group = groups(fps, 3)
    least = {}
    for (doc, _), g in zip(rows, group, strict=True):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    want = sorted((str(doc), f"{fp:016x}", str(least.get(g))) for (doc, _), fp, g in zip(rows, fps, group, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_components(edge).collect()) == want
    assert simhash_components(none).count() == 0


def test_links_of_crowded_fingerprints(spark):
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(0, 1 << 63, 12)]
    fps = set(base)
    for b in base[:4]:  # crowds of many fingerprints in one ball, chains included
        for _ in range(60):
            fps.add(b ^ sum(1 << int(k) for k in r.choice(64, int(r.integers(1, 5)), replace=False)))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x, x) for x in signed], "node long, l0 long")
    found = {x.node: x.component for x in link(nodes, 1, 32, 1, 3).collect()}
    got, want = [found.get(x, x) for x in signed], groups(fps, 3)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_take_no_round(spark, monkeypatch):
    from tidemark.llm import components as module

    written, plain = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: written.append(name) or plain(df, name))
    edges = spark.createDataFrame([(100, 100 + i) for i in range(1, 9)] + [(3, 2)], "a long, b long")
    got = {x.node: x.component for x in components(edges).collect()}
    assert got == {**{100 + i: 100 for i in range(9)}, 2: 2, 3: 2} and len(written) == 1


def test_near_duplicates_against_jaccard(spark, edge, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = t.lower().encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = {d: d for d, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union == 0 or len(sets[i] & sets[j]) >= 0.8 * union:
                p, q = root(a), root(rows[j][0])
                label[max(p, q)] = min(p, q)
    want = {d for d, _ in rows if root(d) != d}
    got = {r.doc_id for r in near_duplicates(docs).collect()}
    assert got == want and want
    # 2 and 3 are copies of 1 (no words), 7 and 13 of 6, 8 and 9 are near 6
    gone = {r.doc_id for r in near_duplicates(edge).collect()}
    assert {2, 3, 7, 8, 13} <= gone and not gone & {1, 4, 5, 6, 10, 11, 12, None, 14}
    assert near_duplicates(none).count() == 0


def test_near_duplicates_of_any_edit(spark):
    """Appended, truncated, replaced and repeated passages spoil 2-word shingles or their numbers; pairs are found all the same."""
    r = np.random.default_rng(11)
    text = lambda n: [f"v{k}" for k in r.integers(0, 50_000, n)]
    rows, want = [], set()
    for k in range(40):
        a = text(300)
        appended, cut, block = a + text(60), a[40:], a[:150] + text(28) + a[178:]
        repeated = a[:30] * 12 + a[30:]
        for n, b in enumerate((appended, cut, block, repeated)):
            x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
            assert len(x & y) >= 0.8 * len(x | y)
            rows.append((100 * k + n + 1, " ".join(b)))
            want.add(100 * k + n + 1)
        rows += [(100 * k, " ".join(a)), (100 * k + 50, " ".join(a[:100] + text(80) + a[180:]))]  # the last is under 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in near_duplicates(docs).collect()} == want


def test_near_duplicates_in_a_chain(spark, monkeypatch):
    """A group of texts of which neighbours are near and the ends are not, beside strangers that share a passage: every link counts, with or without pivots."""
    from tidemark.llm import near_dedup

    r = np.random.default_rng(5)
    text = lambda n: [f"v{k}" for k in r.integers(0, 50_000, n)]
    rows, a = [], text(200)
    for k in range(12):  # a chain: each differs from the one before in a passage
        rows.append((k, " ".join(a)))
        at = 12 * k
        a = a[:at] + text(12) + a[at + 12 :]
    passage = text(60)
    rows += [(100 + k, " ".join(passage + text(40))) for k in range(25)]
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    label = {d: d for d, _ in rows}
    for x in sorted(sets):
        for y in sorted(sets):
            if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) and label[x] != label[y]:
                low, high = sorted((label[x], label[y]))
                label = {d: low if c == high else c for d, c in label.items()}
    want = {d for d, c in label.items() if d != c}
    assert 5 < len(want) < 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for pivots, earlier in ((0, 12), (0, 1), (1, 12)):
        monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
        monkeypatch.setattr(near_dedup, "EARLIER", earlier)
        assert {x.doc_id for x in near_duplicates(docs).collect()} == want


def test_near_dedup_goes_through_fingerprints(spark, monkeypatch):
    from tidemark.llm import near_dedup

    linked, whole = [], near_dedup.link

    def spy(nodes, *rest):
        out = whole(nodes, *rest)
        linked.append((nodes.count(), {r.node for r in out.collect()}))
        return out

    monkeypatch.setattr(near_dedup, "link", spy)
    words = [f"w{i * i % 977}" for i in range(900)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(f"v{i}" for i in range(900))), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()} == {1, 3, 4}
    assert linked[0][0] == 4 and len(linked[0][1]) == 2


def test_the_driver_frees_its_memory_between_rounds(spark, monkeypatch):
    from tidemark.llm import components as rounds
    from tidemark.llm import substrings

    freed = []
    monkeypatch.setattr(substrings, "trim", lambda: freed.append(1))
    path = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    assert {tuple(r) for r in rounds.components(path).collect()} == {(i, 0) for i in range(13)}
    assert freed


def test_what_explode_makes_is_not_broadcast(spark, monkeypatch):
    from tidemark.llm import simhash as S

    plans, stored = {}, S.stored
    monkeypatch.setattr(S, "stored", lambda df, name, **o: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), stored(df, name, **o))[1])
    r = np.random.default_rng(4)
    base = [int(x) for x in r.integers(0, 1 << 62, 40)]
    rows = [(f, f) for f in sorted({b ^ (1 << int(k)) for b in base for k in r.choice(62, 4)} | {b ^ 3 << 60 for b in base} | set(base))]
    nodes = S.stored(spark.createDataFrame(rows, "node long, l0 long"), "nodes")
    assert link(nodes, 1, 32, 1, 3).count() > len(base)
    assert "hits" in plans and not any("Broadcast" in p for name, p in plans.items() if name in ("hits", "mixed"))
