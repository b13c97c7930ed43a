"""Chunks as folds over arrays of paragraphs and sentences; line differences in Arrow batches."""

from __future__ import annotations

import sys
from difflib import unified_diff

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import vocab as V

NO_TEXTS = "array<string>"


def paragraphs(text: Column) -> Column:
    """Trimmed stretches between blank lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def _grown(done: Column, last: Column) -> Column:
    return F.concat(done, F.array(last))


def _by_sentences(paragraph: Column, most: int, enough: int) -> Column:
    """Sentences joined until a chunk has `enough` characters, or the next would make it longer than `most`."""
    # not F.trim itself: transform would give it the index, as the characters to trim
    sentences = F.filter(F.transform(F.split(paragraph, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")

    def step(state: Column, s: Column) -> Column:
        joined = F.when(state["open"] == "", s).otherwise(F.concat(state["open"], F.lit(" "), s))
        over = (state["open"] != "") & (F.length(joined) > most)
        full = F.length(joined) >= enough
        return F.struct(F.when(over, _grown(state["done"], state["open"])).when(full, _grown(state["done"], joined)).otherwise(state["done"]).alias("done"), F.when(over, s).when(full, "").otherwise(joined).alias("open"))

    start = F.struct(F.array().cast(NO_TEXTS).alias("done"), F.lit("").alias("open"))
    return F.aggregate(sentences, start, step, lambda x: F.when(x["open"] == "", x["done"]).otherwise(_grown(x["done"], x["open"])))


def sentence_chunks(text: Column, most: int = 1200, enough: int = 800) -> Column:
    """Paragraphs of at most `most` characters; longer ones by sentences."""
    return F.flatten(F.transform(paragraphs(text), lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(_by_sentences(p, most, enough))))


def tail(text: Column, size: int) -> Column:
    """The last `size` characters, from the next word on where they begin within one."""
    end = F.substring(text, -size, size)
    split = (F.length(text) > size) & F.substring(text, -size - 1, 2).rlike(r"^[\p{L}\p{N}]{2}$")
    return F.regexp_replace(F.when(split, F.regexp_replace(end, r"^[\p{L}\p{N}]+", "")).otherwise(end), r"^\s+|\s+$", "")


def overlap_chunks(text: Column, title: Column, most: int = 9000, overlap: int = 800) -> Column:
    """Chunks of whole paragraphs; each after the first begins with the tail of the one before, itself led by a tail.

    Chunks have a header with their number, of which the room is taken off `most`.
    """
    head, rest = V.CHUNK_HEADER.format(i="\0", n="\1", t="\2").split("\2")
    before, middle, after = head.replace("\1", "\0").split("\0")
    room = F.greatest(F.lit(V.CHUNK_LEAST), F.lit(most - V.CHUNK_SPARE - len(before) - len(middle) - len(after) - len(rest) - 2) - F.length(title))

    def pack(state: Column, p: Column) -> Column:
        last = F.try_element_at(state, F.lit(-1))
        fits = (F.size(state) > 0) & (F.length(last) + 2 + F.length(p) <= room)
        return F.when(fits, _grown(F.slice(state, F.lit(1), F.greatest(F.size(state) - 1, F.lit(0))), F.concat(last, F.lit("\n\n"), p))).otherwise(_grown(state, p))

    def lead(state: Column, body: Column) -> Column:
        end = F.when(F.size(state) > 0, tail(F.try_element_at(state, F.lit(-1)), overlap)).otherwise("")
        return _grown(state, F.when(end == "", body).otherwise(F.concat(end, F.lit("\n\n"), body)))

    none = F.array().cast(NO_TEXTS)
    led = F.aggregate(F.aggregate(paragraphs(text), none, pack), none, lead)
    count = F.size(led).cast("string")
    return F.transform(led, lambda body, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(middle), count, F.lit(after), title, F.lit(rest), body))


@F.pandas_udf(T.StructType([T.StructField("added", T.IntegerType()), T.StructField("removed", T.IntegerType())]))
def line_diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Lines that a unified diff adds and removes."""
    rows = []
    for x, y in zip(a, b, strict=True):
        lines = [d for d in unified_diff((x or "").splitlines(), (y or "").splitlines(), lineterm="", n=0) if not d.startswith(("+++", "---"))]
        rows.append((sum(d[0] == "+" for d in lines), sum(d[0] == "-" for d in lines)))
    return pd.DataFrame(rows, columns=["added", "removed"])


def ordered_distinct(c: Column, most: int) -> Column:
    """Trimmed values without blanks, first of each that agrees but for case, at most so many."""
    low = lambda x: F.lower(F.trim(x))
    clean = F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != ""))
    lows = F.transform(clean, low)
    return F.slice(F.transform(F.filter(clean, lambda x, i: F.array_position(lows, low(x)) == i + 1), lambda x: F.trim(x)), 1, most)


# the functions above travel to executors by value, so these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
