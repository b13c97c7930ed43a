import json
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import ContainmentIndex, _Memo, contamination, drop_contaminated, words_of
from tidemark.llm.tool_calls import link_tool_calls, op3_tool_calls
from tidemark.llm.toxicity import THRESHOLD, drop_toxic, held_out, toxicity, train

from .conftest import LONG, edge_rows

TOOLS = {"find": {"q": ("string", True), "n": ("integer", False)}, "add": {"xs": ("array", True)}}


def calls(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")


def results(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, call_id string, content string")


def test_calls_are_linked_ordered_and_checked(spark):
    c = calls(spark, [
        (1, 1, "a", "find", '{"q": "x", "n": 2}', ["b"]), (1, 2, "b", "add", '{"xs": [3, {"z": 1, "a": 2}]}', None), (1, 3, "c", "find", '{"n": "2", "k": 1}', ["a", "b", "a"]),
        (1, 4, "d", "nope", "{}", ["zz", "d"]), (1, 5, "e", "add", "not json", ["f"]), (1, 6, "f", "add", "[1]", ["e"]), (1, 7, "g", "find", '{"q": "y"}', ["f"]),
        (2, 1, "a", "find", None, []), (2, 2, "a", "find", '{"q": null}', ["a"]), (None, 1, "a", "find", '{"q": "x"}', ["b"]), (3, 1, None, "find", '{"q": "x", "n": 2.5}', []),
    ])
    r = results(spark, [(1, 8, "a", "second"), (1, 7, "a", "first"), (2, 9, "zz", "lost"), (None, 1, "a", "lost too"), (1, 9, "c", None)])
    got = {(x.conv_id, x.turn, x.call_id, x.status): x for x in link_tool_calls(c, r, TOOLS).collect()}
    one = lambda *k: got[k]
    assert one(1, 1, "a", "linked").step == 1 and one(1, 1, "a", "linked").n_results == 2 and one(1, 1, "a", "linked").errors == ""
    assert one(1, 1, "a", "linked").message == '{"arguments":{"n":2,"q":"x"},"depends_on":["b"],"id":"a","name":"find","result":"first","step":1}'
    assert json.loads(one(1, 2, "b", "no_result").message)["arguments"] == {"xs": [3, {"a": 2, "z": 1}]} and '{"a":2,"z":1}' in one(1, 2, "b", "no_result").message
    assert one(1, 3, "c", "linked").step == 2 and one(1, 3, "c", "linked").errors == "n: no integer; q: missing; k: unknown"
    assert one(1, 4, "d", "no_result").errors == "tool: unknown nope; needs: unknown d; needs: unknown zz" and one(1, 4, "d", "no_result").step == 0
    for k in ("e", "f", "g"):
        x = next(v for key, v in got.items() if key[2] == k)
        assert x.step is None and "needs: cycle" in x.errors
    assert "arguments: no JSON object" in one(1, 5, "e", "no_result").errors and "arguments: no JSON object" in one(1, 6, "f", "no_result").errors
    assert one(2, 1, "a", "no_result").errors.startswith("arguments: no JSON object") and one(2, 2, "a", "no_result").errors == "q: no string; needs: unknown a"
    assert one(None, 1, "a", "no_result").step == 0 and one(3, 1, None, "no_result").errors == "n: no integer"
    assert one(2, 9, "zz", "orphan_result").step is None and one(None, 1, "a", "orphan_result").errors == "result: no call"
    assert len(got) == 13
    assert link_tool_calls(c.limit(0), r.limit(0), TOOLS).count() == 0


def test_long_chain(spark):
    c = calls(spark, [(1, i, f"c{i}", "find", '{"q": "x"}', [f"c{i - 1}"] if i else []) for i in range(7)])
    assert {x.call_id: x.step for x in link_tool_calls(c, results(spark, []), TOOLS).collect()} == {f"c{i}": i for i in range(7)}


def test_conversations_have_every_case(spark, sf_dir):
    rows = op3_tool_calls(spark, sf_dir).collect()
    assert {r.status for r in rows} >= {"linked"} and {"", "exact: no boolean", "items: missing"} <= {r.errors for r in rows} and max(r.step or 0 for r in rows) >= 1


def test_plan_is_native(spark, sf_dir):
    plan = op3_tool_calls(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "ShuffledHashJoin" in plan


def brute(docs, items, n=5):
    def grams(t):
        w = words_of(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()), w

    out = set()
    for d, t in docs:
        _, w = grams(t)
        for i, x in items:
            want, iw = grams(x)
            k = min(n, len(iw))
            have = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if k else set()
            if want and len(want & have) >= 0.8 * len(want):
                out.add((d, i))
    return out


def test_contamination_against_brute_force(spark, sf_dir, edge, none):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in contamination(docs, items, block=15).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]) and got
    own = [(1, LONG), (2, None), (3, ""), (4, "one two"), (5, "Nonumy, eirmod: TEMPOR invidunt ut labore et"), (6, "again again again again again again"), (None, LONG), (7, "w0 w7919 w5831 w3743 w1655 w9574 w7486")]
    bench = spark.createDataFrame(own, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contamination(edge, bench).collect()} == brute(edge_rows(), own)
    assert contamination(none, bench).count() == 0 and contamination(edge, bench.limit(0)).count() == 0
    kept = drop_contaminated(edge, bench)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in edge_rows()} - {d for d, _ in brute(edge_rows(), own)}


def test_items_deep_in_long_documents():
    r = np.random.default_rng(1)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(k, " ".join(r.choice(vocabulary, int(r.integers(12, 70))))) for k in range(60)]
    index, texts = ContainmentIndex(items), []
    for k, item in items:
        w = list(r.choice(vocabulary, 6000))
        w[int(r.integers(0, 5900)) : 0] = item.split()
        texts.append(" ".join(w))
    assert {(n, m) for n, m, *_ in index.search(texts, _Memo())} >= {(k, k) for k, _ in items}


def test_toxicity_on_held_out_rows(spark):
    r = np.random.default_rng(2)
    calm = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(1500):
        w = list(r.choice(calm, int(r.integers(5, 60))))
        bad = i % 6 == 0
        if bad:
            w[int(r.integers(0, len(w)))] = str(r.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, None, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    got = toxicity(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).collect()
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 4 == 2}
    truth = {i: y for i, _, y in rows}
    out = [(truth[x.doc_id], x.predicted) for x in got if x.held_out]
    hits = sum(a and b for a, b in out)
    assert 2 * hits / (sum(a for a, _ in out) + sum(b for _, b in out)) > 0.9
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= THRESHOLD) for x in got)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {x.doc_id for x in got if not x.predicted}


def test_thresholds_by_one_rule():
    from tidemark.llm.toxicity import BINS, TextCNN

    def cuts(n, langs=(0,)):
        """n rows of label 1 over 0.6 and 9 n of label 0 under 0.5, in each language."""
        m = TextCNN()
        counts = {}
        for x in langs:
            one, zero = np.zeros(BINS, int), np.zeros(BINS, int)
            one[1200], zero[900] = n, 9 * n
            counts |= {(x, 1): one, (x, 0): zero}
        m.calibrate(counts)
        return m.cuts

    for n in (1, 5, 19, 20, 21, 500):  # no step anywhere
        assert all(0.45 < c < 0.6 for c in cuts(n).values())
    m = TextCNN()
    few, many = np.zeros(BINS, int), np.zeros(BINS, int)
    few[400], many[1600] = 2, 400
    m.calibrate({(0, 1): many, (0, 0): np.roll(many, -1000), (1, 1): few, (1, 0): few})
    assert m.cuts[0] > m.cuts[1] > 0.2  # a language with few rows stays near the common cut
    m.calibrate({})
    assert all(abs(c - 0.5) < 1e-9 for c in m.cuts.values())


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(6, 1, 0), (8, None, 1), (9, 0, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        model = train(edge, known)
        got = toxicity(edge, model).collect()
        assert len(got) == len(edge_rows()) and all(0 <= x.score <= 1 for x in got)
        assert len({x.score for x in got if x.doc_id in (1, 2, 3)}) == 1
    assert toxicity(none, train(none, labels.limit(0))).count() == 0


def test_items_of_few_shingles_are_never_missed():
    from tidemark.llm.decontaminate import ContainmentIndex, _Memo

    r = np.random.default_rng(2)
    text = lambda n: " ".join(f"u{k}" for k in r.integers(0, 100_000, n))
    items = [text(n) for n in (5, 6, 7, 8) for _ in range(500)] + ["a b " * 40 + text(1)]
    docs = [f"{text(23)} {x} {text(30)}" for x in items]
    got = ContainmentIndex(list(enumerate(items))).search(docs, _Memo())
    assert {(n, m) for n, m, *_ in got} == {(n, n) for n in range(len(items))}


def test_turns_of_other_roles_are_no_calls(spark):
    from tidemark.llm.tool_calls import turns_as_calls

    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, None, "n"), (1, 2, "user", "u"), (1, 3, "assistant", "a"), (1, 4, "tool", "t")], "conv_id long, turn long, role string, text string")
    calls, results = turns_as_calls(turns)
    assert [r.turn for r in calls.collect()] == [2] and [r.turn for r in results.collect()] == [3]
