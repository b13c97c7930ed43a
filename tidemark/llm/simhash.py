"""SimHash fingerprints and their links by multi-index hashing.

A fingerprint is cut into segments.  Two fingerprints that differ in at most r bits differ in at most r // m bits of one
of m segments, so a fingerprint finds its partners by looking up, for each segment, all values in a small Hamming ball
around its own, and then comparing whole fingerprints.

Equal fingerprints are one node.  A segment value that several nodes share is first compared by its least and greatest
node only; what these links join is one component, and only nodes of different components are compared further.  So no
link is lost, and a large group is never expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, discard, lean, ship, sized, slices, stored, table
from .components import components
from .substrings import release


def fingerprint(joined: bytes, lengths: np.ndarray, shingle: int, seeds: tuple[int, ...]) -> list[int]:
    """64 bits for each seed, of the space-joined words of a text whose word lengths are given."""
    import xxhash

    if not len(lengths):
        return [0] * len(seeds)
    ends = np.cumsum(lengths + 1) - 1
    k = min(shingle, len(lengths))
    spans = list(zip((ends - lengths).tolist(), ends[k - 1 :].tolist(), strict=False))
    out = []
    digest = xxhash.xxh64_intdigest
    for seed in seeds:
        counts, n = np.zeros(64, np.int64), len(spans)
        for i in range(0, n, 1 << 14):
            h = np.array([digest(joined[a:b], seed) for a, b in spans[i : i + (1 << 14)]], "<u8")
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """doc_id, content long (a hash of the lower-cased words) and a long lane for each seed: l0, l1 ...

    A-Z of whole texts are lower-cased; fewer words than a shingle are one shingle, no words (or null) give zero.
    """
    ship(docs.sparkSession)

    def run(batches):
        import xxhash

        for batch in batches:
            for i, j in slices(batch):
                some = batch.slice(i, j - i)
                content, lanes = [], []
                for text in some.column("text").to_pylist():
                    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                    joined = b" ".join(w)
                    content.append(xxhash.xxh64_intdigest(joined, 7))
                    lanes.append(fingerprint(joined, np.fromiter(map(len, w), np.int64, len(w)), shingle, seeds))
                a = np.array(lanes, np.uint64).reshape(-1, len(seeds)).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.array(content, np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(a[:, k])) for k in range(len(seeds)))], names=["doc_id", "content", *(f"l{k}" for k in range(len(seeds)))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, content long" + "".join(f", l{k} long" for k in range(len(seeds))))


def distance(lanes: int, x: str, y: str) -> Column:
    """Differing bits of two structs of lanes."""
    return sum((F.bit_count(F.col(f"{x}.l{k}").bitwiseXOR(F.col(f"{y}.l{k}"))) for k in range(1, lanes)), F.bit_count(F.col(f"{x}.l0").bitwiseXOR(F.col(f"{y}.l0"))))


def _ball(masks: Column, own: Column, tag: Column) -> Column:
    return F.transform(masks, lambda m: F.struct((own.bitwiseXOR(m) + tag).alias("key"), (m == 0).alias("exact")))


def probes(nodes: DataFrame, lanes: int, bits: int, radius: int) -> DataFrame:
    """A row (key, exact, me) for each segment and each value within the radius (0 or 1) of the segment's own."""
    if radius not in (0, 1):
        raise ValueError("radius is 0 or 1")
    masks = F.array(*(F.lit(m).cast("long") for m in [0, *([1 << i for i in range(bits)] if radius else [])]))
    balls = []
    for lane in range(lanes):
        for s in range(64 // bits):
            own = F.shiftrightunsigned(F.col(f"l{lane}"), s * bits).bitwiseAND(F.lit((1 << bits) - 1))
            tag = F.lit(((lane * (64 // bits) + s) << bits)).cast("long")
            balls.append(_ball(masks, own, tag))
    me = F.struct("node", *(f"l{k}" for k in range(lanes)))
    return nodes.select(me.alias("me"), F.explode(F.concat(*balls)).alias("p")).select("p.key", "p.exact", "me")


def link(nodes: DataFrame, lanes: int, bits: int, radius: int, most: int, verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of nodes that have links: at most `most` differing bits, and `verify` keeps the pair.

    nodes: unique `node` and lanes, stored.  verify takes and returns pairs (a, b).
    """
    count = nodes.count()
    ball = probes(nodes, lanes, bits, radius)
    # what stands under a key exactly: the least and the greatest node, and how many
    held = ball.where("exact").groupBy("key").agg(F.min("me").alias("low"), F.max("me").alias("high"), F.count(F.lit(1)).alias("n"))
    hits = ball.join(apart(held), "key")
    deep = F.col("n") > 2
    hits = hits.where("n > 1 OR me.node <> low.node").select("key", "exact", "me", deep.alias("deep"), F.when(F.col("me.node") != F.col("low.node"), F.col("low")).alias("low"), F.when((F.col("n") > 1) & (F.col("me.node") != F.col("high.node")), F.col("high")).alias("high"))
    hits = stored(sized(hits, count, 2_000), "hits")

    def near(pairs: DataFrame) -> DataFrame:
        close = pairs.where(distance(lanes, "x", "y") <= most)
        found = close.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        return verify(found) if verify else found

    first = hits.select(F.col("me").alias("x"), F.explode(F.array("low", "high")).alias("y")).where("y IS NOT NULL")
    edges = stored(sized(near(first), count), "links")
    release(nodes.sparkSession)
    found = components(edges)
    many = hits.where("deep").select("key", "exact", "me")
    if not many.isEmpty():
        label = found.select(F.col("node").alias("_node"), "component")
        many = many.join(apart(label), F.col("me.node") == F.col("_node"), "left").select("key", "exact", "me", F.coalesce("component", "me.node").alias("label"))
        mixed = many.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("key")
        many = stored(sized(many.join(apart(mixed), "key"), count, 2_000), "mixed")
        if not many.isEmpty():
            sides = many.select("key", "label").distinct().join(apart(many.where("exact").select("key", F.col("label").alias("other")).distinct()), "key").where("label <> other")
            pairs = many.join(apart(sides), ["key", "label"]).select("key", F.col("me").alias("x"), "other").join(apart(many.where("exact").select("key", F.col("me").alias("y"), F.col("label").alias("other"))), ["key", "other"]).select("x", "y")
            links = stored(sized(near(pairs), count), "links")
            release(nodes.sparkSession)
            # what is found so far is stars already
            found = components(found.where("node <> component").toDF("a", "b").unionByName(links))
    discard(hits)
    release(nodes.sparkSession)  # plans and shuffle files of the rounds
    return found


def simhash_components(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the least doc_id reachable over links of at most `most` <= 3 bits.

    Every row of docs gives a row: null and empty texts have fingerprint zero; repeated rows link like copies; a null
    doc_id has a row but is never a component's name unless the component has no other.  Empty tables give no row.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments of 32 bits and a ball of radius 1 find up to 3 bits")
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(marked.groupBy("l0").agg(F.min("doc_id").alias("first")).withColumn("node", F.col("l0")), "nodes")
    found = link(nodes.select("node", "l0"), 1, 32, 1, most)
    count = nodes.count()
    named = nodes.join(apart(found, count), "node", "left").select("l0", "first", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = stored(sized(named.join(apart(least, count), "component").select("l0", "component_id"), count), "components")
    discard(nodes)
    return marked.select("doc_id", "l0").join(apart(by_print, count), "l0").select("doc_id", F.lpad(F.lower(F.hex("l0")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op4: fingerprints of all documents and the components of their links."""
    return simhash_components(table(spark, sf_dir, "documents"))
