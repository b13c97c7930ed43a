"""Queries over stores: what is written to the shared folder as JSON lines, CSV, texts and sidecars is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import vocab as V
from tidemark.operators import maintenance as M
from tidemark.operators.records import DRAFTS_SQL, _list, drafts
from tidemark.sources import stores as S

from .catalog import query, story_records

_STORED = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("topics", T.ArrayType(T.StringType()))])


@query("S1, S2, S3, S13, S14", """SELECT 'appended' AS what, count(*) AS n, md5(string_agg(record_id || title || array_to_string(topics, ','), '' ORDER BY record_id)) AS content FROM records UNION ALL SELECT 'objects', count(*), NULL FROM records
 UNION ALL SELECT 'broken', 2, NULL UNION ALL SELECT 'overwritten', count(*), md5(string_agg(record_id || title || array_to_string(topics, ','), '' ORDER BY record_id)) FROM records WHERE priority = 'High'""", on_records=True)
def jsonl_store(r: DataFrame) -> DataFrame:
    """A store of records: appended in two parts, with broken lines besides, read, and overwritten by what is read from itself."""
    spark, path, odd = r.sparkSession, S.scratch_path(r.sparkSession, "records"), S.scratch_path(r.sparkSession, "odd")
    rows = r.select("record_id", "title", "topics", "priority")
    S.append_jsonl(rows.where("priority = 'High'"), path)
    S.append_jsonl(rows.where("priority <> 'High'"), path)
    lines = spark.read.text(path).unionByName(spark.createDataFrame([("",), ("  ",), ("{broken",), ("[1, 2]",)], "value string"))
    lines.write.text(odd)
    wide = T.StructType([*_STORED.fields, T.StructField("priority", T.StringType())])
    content = lambda df: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_id", F.concat("record_id", "title", F.array_join("topics", ",")).alias("t")))), lambda x: x["t"]), ""))
    one = lambda what, df, c=None: df.agg(F.count(F.lit(1)).alias("n"), (content(df) if c else F.max(F.lit(None).cast("string"))).alias("content")).select(F.lit(what).alias("what"), "n", "content")
    appended = one("appended", S.read_jsonl(spark, path, _STORED), True)
    objects = one("objects", S.read_objects(spark, odd, _STORED))
    broken = S.read_jsonl(spark, odd, _STORED, report=True).agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("n"), F.max(F.when(F.col("_corrupt_record").isNotNull(), F.col("record_id"))).alias("content")).select(F.lit("broken").alias("what"), "n", "content")
    appended, objects, broken = (spark.createDataFrame(x.collect(), x.schema) for x in (appended, objects, broken))  # a row each, before the store changes
    S.overwrite_jsonl(S.read_jsonl(spark, path, wide).where("priority = 'High'"), path)
    return appended.unionByName(objects).unionByName(broken).unionByName(one("overwritten", S.read_jsonl(spark, path, _STORED), True))


@query("S4", "SELECT kind, entry, value FROM (VALUES " + ", ".join(f"('country', '{c}', '{r}')" for c, r in V.COUNTRY_REGIONS.items()) + ", " + ", ".join(f"('alias', '{a}', '{r}')" for a, r in V.REGION_ALIASES.items()) + ", " + ", ".join(f"('footprint_region', '{r}', '{r}')" for r in V.REGIONS) + ") AS t(kind, entry, value)")
def dimension_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension table as a CSV with a byte-order mark, blanks around names and a column found by its prefix, dealt out by row type."""
    path = S.scratch_path(spark, "dimension")
    lines = ["﻿ country , entry,region,market, relevant to whom ,display "]
    lines += [f"country,{c},,{'' if c == r else r},{r if c == r else ''}," for c, r in V.COUNTRY_REGIONS.items()] + [f"alias,{a},,,,{r}" for a, r in V.REGION_ALIASES.items()] + [f"footprint_region,{r},,,," for r in V.REGIONS]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    rows = S.read_dimension(spark, path, {"country": "kind", "entry": "entry", "region": "region", "market": "market", "relevant": "relevant", "display": "display"})
    parts = [df.select(F.lit(k).alias("kind"), "entry", "value") for k, df in S.dispatch(rows, "kind").items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("S5, O10, J6, M8, S21", """WITH f AS (SELECT source_type || '.md' AS file, source_type, count(*) AS n FROM records GROUP BY source_type), s AS (SELECT file, 'side-' || n AS run_id FROM f WHERE length(source_type) % 2 = 0), i AS (SELECT row_number() OVER (ORDER BY file) AS pos, file, 'run-' || n AS run_id FROM f WHERE length(source_type) % 3 <> 0)
 SELECT 'metadata' AS kind, f.file, coalesce(s.run_id, i.run_id, (SELECT arg_max(run_id, pos) FROM i)) AS value FROM f LEFT JOIN s ON s.file = f.file LEFT JOIN i ON i.file = f.file
 UNION ALL SELECT 'index_without_file', file, NULL FROM i WHERE length(file) % 5 = 0 UNION ALL SELECT 'sidecar_without_file', file, NULL FROM s WHERE length(file) % 5 = 0""", on_records=True)
def brief_files(r: DataFrame) -> DataFrame:
    """Sidecars and an index of briefs, written and read; each brief's run, and rows whose text is gone."""
    from pyspark.sql import Window

    spark, path, index = r.sparkSession, S.scratch_path(r.sparkSession, "sidecars"), S.scratch_path(r.sparkSession, "index")
    f = r.groupBy("source_type").agg(F.count(F.lit(1)).alias("n")).withColumn("file", F.concat("source_type", F.lit(".md")))  # a row for each publisher
    f.where(F.length("source_type") % 2 == 0).select("file", F.concat(F.lit("side-"), F.col("n").cast("string")).alias("run_id")).write.json(path)
    baseline = S.scratch_path(spark, "baseline")
    f.where(F.length("source_type") % 3 != 0).select(F.row_number().over(Window.orderBy("file")).alias("pos"), "file", F.concat(F.lit("run-"), F.col("n").cast("string")).alias("run_id")).write.json(baseline)
    schema = "pos int, file string, run_id string"
    S.seed(spark, index, baseline, schema)
    if S.seed(spark, index, baseline, schema):
        raise ValueError("a store that has rows is not to be seeded")
    side, rows = spark.read.schema("file string, run_id string").json(path), spark.read.schema(schema).json(index)
    texts = f.where(F.length("file") % 5 != 0).select("file")
    meta = M.metadata_for(f.select("file"), side, rows).select(F.lit("metadata").alias("kind"), "file", F.col("run_id").alias("value"))
    return meta.unionByName(M.orphans(rows, texts, side).select("kind", "file", F.lit(None).cast("string").alias("value")))


@query("S6, S7", """SELECT 'text' AS kind, md5(string_agg(record_id || ': ' || title, chr(10) ORDER BY record_id) || chr(10)) AS value FROM records WHERE priority = 'High' AND confidence = 'High' UNION ALL SELECT 'latest', 'found' UNION ALL SELECT 'previous', 'none'""", on_records=True)
def whole_texts(r: DataFrame) -> DataFrame:
    """A brief written as one text, found by its name, and the newest file and the one before."""
    spark, path = r.sparkSession, S.scratch_path(r.sparkSession, "texts")
    r.where("priority = 'High' AND confidence = 'High'").select("record_id", F.concat("record_id", F.lit(": "), "title").alias("value")).orderBy("record_id").select("value").coalesce(1).write.option("lineSep", "\n").text(path)
    name = S.latest_file(spark, path).first()["path"]
    text = S.read_texts(spark, path, name).select(F.lit("text").alias("kind"), F.md5("text").alias("value"))
    state = lambda kind, skip: S.latest_file(spark, path, skip).agg(F.when(F.count(F.lit(1)) > 0, "found").otherwise("none").alias("value")).select(F.lit(kind).alias("kind"), "value")
    return text.unionByName(state("latest", 0)).unionByName(state("previous", 1))


@query("S16, S17", _SQL := """SELECT record_id, array_to_string(list_filter(topics, lambda x: x <> ''), '; ') AS topics, coalesce(nullif(array_to_string(list_filter(regions, lambda x: x <> ''), '; '), ''), '') AS regions, title FROM records""", on_records=True)
def csv_export(r: DataFrame) -> DataFrame:
    """Records as a quoted CSV with lists as text and columns in the order of their names, read back."""
    path = S.scratch_path(r.sparkSession, "export")
    null = "\t"  # no title has a tab, as words end there
    S.write_csv(r.select("record_id", "topics", "regions", "title"), path, null)
    back = S.read_csv(r.sparkSession, path, null)
    return back.select("record_id", F.coalesce("topics", F.lit("")).alias("topics"), F.coalesce("regions", F.lit("")).alias("regions"), "title")


def _contract_sql() -> str:
    checks = []
    for field, rule in S.CONTRACT.items():
        is_list = rule["type"].startswith("array")
        if not rule.get("null"):
            checks.append((field, "null", f"{field} IS NULL"))
        if "values" in rule:
            checks.append((field, "value", f"len(list_filter({field}, lambda x: NOT list_contains({_list(rule['values'])}, x))) > 0" if is_list else f"NOT list_contains({_list(rule['values'])}, {field})"))
        if "items" in rule:
            checks.append((field, "items", f"len({field}) NOT BETWEEN {rule['items'][0]} AND {rule['items'][1]}"))
    return " UNION ALL ".join(f"SELECT record_id, '{f}' AS field, '{w}' AS why FROM drafts WHERE {c}" for f, w, c in checks)


@query("S24", DRAFTS_SQL.rstrip() + "\n" + _contract_sql())
def contract_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of drafts that are not what the contract of a record says."""
    return S.broken_contract(drafts(story_records(spark, sf_dir)))
