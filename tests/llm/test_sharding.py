"""Best-fit-decreasing plans against a plain pass over single groups, and the laws of the shards."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.sharding import Rooms, assign, level, op13_shards, pack_groups, write_shards


def plain(sizes, capacity):
    """Best fit of single groups in the order given: the bins' fills, by bin."""
    rooms = []
    for size in sizes:
        fits = [(room, k) for k, room in enumerate(rooms) if room >= size]
        if not fits:
            rooms.append(capacity)
            fits = [(capacity, len(rooms) - 1)]
        room, k = min(fits)
        rooms[k] = room - size
    return [capacity - r for r in rooms]


def fills(runs, bins):
    out = [0] * bins
    for size, n, k in runs:
        out[k] += size * n
    return out


@pytest.mark.parametrize("seed", range(30))
def test_runs_are_what_single_groups_give(seed):
    rng = random.Random(seed)
    capacity = rng.choice([50, 100, 1000])
    sizes = sorted((min(capacity, max(1, int(rng.paretovariate(0.8) * 5))) for _ in range(rng.choice([1, 30, 400]))), reverse=True)
    runs, bins = pack_groups(sorted(Counter(sizes).items(), reverse=True), capacity)
    assert fills(runs, bins) == plain(sizes, capacity)
    assert Counter(s for s, n, _ in runs for _ in range(n)) == Counter(sizes)
    assert pack_groups(sorted(Counter(sizes).items(), reverse=True), capacity, bins - 1) is None


@pytest.mark.parametrize("seed", range(20))
def test_levelled_shards_are_near_equal(seed):
    rng = random.Random(seed)
    sizes = [int(rng.lognormvariate(5, 1.5)) + 16 for _ in range(5_000)]
    big = [sum(sizes) // 3] * (seed % 3)
    k = rng.choice([1, 7, 40])
    runs = level(sorted(Counter(sizes + big).items(), reverse=True), k)
    full = sorted(fills(runs, k), reverse=True)
    alone = [x for x in full if x in big][: k - 1]
    others = full[len(alone) :]
    assert sum(full) == sum(sizes + big) and max(others) - min(others) <= max(17, max(others) // 100)


def test_level_of_few_groups():
    assert fills(level([(9, 1), (5, 2)], 4), 4) == [9, 5, 5, 0]
    assert level([], 4) == [] and fills(level([(3, 10)], 4), 4) in ([9, 9, 9, 3], [9, 9, 6, 6])


def test_rooms_as_a_sorted_list():
    rng, rooms, have = random.Random(1), Rooms(), []
    for number in range(3_000):
        if rng.random() < 0.6:
            rooms.add(room := rng.randrange(50), number)
            have.append((room, number))
        else:
            size = rng.randrange(60)
            want = min((x for x in have if x[0] >= size), default=None)
            assert rooms.take(size) == want
            if want:
                have.remove(want)


def check(rows, docs, shards):
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t or "")
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs)
    slots, where, size = defaultdict(list), defaultdict(set), [0] * shards
    for r in rows:
        t = texts[r.doc_id][0]
        assert r.size == len(t.encode()) + 16
        slots[r.shard].append(r.slot)
        where[t].add(r.shard)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()), "slots are gapless"
    assert all(len(s) == 1 for s in where.values()), "equal texts share a shard"
    groups = Counter()
    for i, t in docs:
        groups[t or ""] += len((t or "").encode()) + 16
    assert sorted(size) == sorted(fills(level(sorted(Counter(groups.values()).items(), reverse=True), shards), shards))
    return size


def test_edge_rows(spark, edge, none):
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    rows = assign(edge.withColumns({"shard": F.lit("clash"), "_nth2": F.lit("x")}).repartition(4), 5)
    assert {"lang", "source", "text", "_nth2"} <= set(rows.columns)
    check(rows.collect(), docs, 5)
    assert assign(none, 5).count() == 0
    one = assign(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"), 3).collect()
    assert {(r.size, r.shard) for r in one} == {(16, 0)} and {r.slot for r in one} == {0, 1}


def test_a_hot_group_and_its_shard(spark):
    docs = [(i, "the same text again and again" if i % 3 == 0 else f"text {i} " + "x" * (i % 97)) for i in range(3_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    size = check(assign(frame, 8).collect(), docs, 8)
    assert check(assign(frame, 8, heavy=1).collect(), docs, 8) == check(assign(frame, 8, heavy=10_000).collect(), docs, 8)
    others = sorted(size)[:-1]
    assert max(others) - min(others) <= 200


def test_whole_table(spark, sf_dir, duck):
    df = op13_shards(spark, sf_dir)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    docs, rows = duck.execute("SELECT doc_id, text FROM documents").fetchall(), df.collect()
    size = check(rows, docs, 40)
    crc = {i: zlib.crc32((t or "").encode()) for i, t in docs}
    assert all(r.text_crc32 == crc[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in rows) and sum(size) == sum(r.size for r in rows)


def test_written_shards(spark, edge, tmp_path):
    write_shards(edge, f"file://{tmp_path}/shards", 3)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == edge.count() and back.select("shard").distinct().count() == 3
    assert sorted(r.text or "" for r in back.collect()) == sorted(r.text or "" for r in edge.collect())
