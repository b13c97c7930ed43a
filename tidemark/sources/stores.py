"""Readers and writers of record stores: JSON lines, dimension tables, briefs, flat exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import vocab as V

STRINGS = T.ArrayType(T.StringType())
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "title", "source_type", "publish_date", "publish_date_confidence", "original_url", "actor_type", "priority", "confidence", "review_status", "notes", "created_at")]
    + [T.StructField(n, STRINGS) for n in ("government_entities", "companies_mentioned", "topics", "keywords", "country_mentions", "regions_mentioned", "regions_relevant", "evidence_bullets", "key_insights")]
    + [T.StructField("mentions_our_company", T.BooleanType())]
)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD, report: bool = False) -> DataFrame:
    """Objects of a JSON-lines store; blank and malformed lines are skipped, or, with report, kept in _corrupt_record with their file."""
    if not report:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path).withColumn("_file", F.col("_metadata.file_name"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder: spark.checkpoint.dir, or the warehouse's where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/stores/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: made once, lineage cut, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_objects(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Rows of a JSON-lines store that are objects: blank lines, broken ones and other values are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    objects = lines.where(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"))
    return objects.select(F.from_json("value", schema).alias("r")).select("r.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows; a row without any value is no object and is left out."""
    df.where(~F.forall(F.array(*(F.col(f"`{c}`").isNull() for c in df.columns)), lambda x: x)).write.mode("append").json(path)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    """Write beside the store, move the old one aside and the new one in, and only then delete: a failure loses neither."""
    spark = df.sparkSession
    staged, aside = (f"{path.rstrip('/')}.{k}-{uuid.uuid4().hex}" for k in ("new", "old"))
    df.write.json(staged)
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(place(path))
    if there and not fs.rename(place(path), place(aside)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(place(staged), place(path)):
        if there:
            fs.rename(place(aside), place(path))
        raise OSError(f"{staged} can't be moved to {path}")
    if there:
        fs.delete(place(aside), True)


def dispatch(rows: DataFrame, kind: str) -> dict[str, DataFrame]:
    """Rows of a dimension table by their type: country (entry to relevant, else market, else region), alias and footprint_region."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    of = lambda k: rows.where((F.trim(kind) == k) & blank("entry").isNotNull())
    return {
        "country": of("country").select(blank("entry").alias("entry"), F.coalesce(blank("relevant"), blank("market"), blank("region")).alias("value")).where("value IS NOT NULL"),
        "alias": of("alias").select(blank("entry").alias("entry"), blank("display").alias("value")).where("value IS NOT NULL"),
        "footprint_region": of("footprint_region").select(blank("entry").alias("entry"), F.coalesce(blank("display"), blank("entry")).alias("value")),
    }


def read_dimension(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV with a header; BOM and blanks around names go, and columns are found by the prefix of their names."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    clean = {c.replace("﻿", "").strip().lower(): c for c in raw.columns}
    picked = []
    for prefix, name in columns.items():
        match = next((c for low, c in clean.items() if low.startswith(prefix.lower())), None)
        if match is None:
            raise ValueError(f"no column begins with {prefix}")
        picked.append(F.trim(F.col(f"`{match}`")).alias(name))
    return raw.select(*picked)


def read_texts(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """name and text of whole files; of the file alone whose name, with or without its ending, or path is `wanted`."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("_path"))
    if wanted is not None:
        last = wanted.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]
        files = files.where((F.col("name") == last) | (F.regexp_replace("name", r"\.[^.]*$", "") == last))
    return files.drop("_path")


def read_sidecars(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object for each file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def latest_file(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """The newest file by (time, path), or the one before it; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.orderBy(F.desc("modificationTime"), F.desc("path")).offset(skip).limit(1)


def flatten(df: DataFrame) -> DataFrame:
    """Lists as text joined by "; ", structs as columns with dotted names made flat; columns in order of their names."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            out.append(F.array_join(F.filter(F.col(f.name).cast(STRINGS), lambda x: x != ""), "; ").alias(f.name))
        elif isinstance(f.dataType, T.StructType):
            out += [F.col(f"{f.name}.{g.name}").cast("string").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        else:
            out.append(F.col(f.name))
    flat = df.select(*out)
    return flat.select(*sorted(flat.columns))


#: Quotes are doubled, and blanks and control characters at a value's ends stay, which the writer would trim.
_CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str, null: str = "") -> None:
    """df flattened, all values quoted; `null` stands for nulls, which an empty text can't be told from by default."""
    flatten(df).write.mode("overwrite").options(**_CSV, quoteAll="true", nullValue=null).csv(path)


def read_csv(spark: SparkSession, path: str, null: str = "") -> DataFrame:
    """What write_csv() wrote with the same `null`, values without line breaks, as texts."""
    return spark.read.options(**_CSV, emptyValue="", nullValue=null).csv(path)


def seed(spark: SparkSession, store: str, baseline: str, schema: T.StructType | str = RECORD) -> bool:
    """Copy the baseline where the store is empty or absent; tells whether it did."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and not spark.read.schema(schema).json(store).isEmpty():
        return False
    overwrite_jsonl(spark.read.schema(schema).json(baseline), store)
    return True


#: What a record's fields have to be: type, allowed values, least and greatest number of items, and whether it may be null.
CONTRACT: dict[str, dict] = {
    "title": {"type": "string"},
    "source_type": {"type": "string", "values": V.SOURCE_TYPES},
    "publish_date": {"type": "string", "null": True},
    "publish_date_confidence": {"type": "string", "values": V.LEVELS},
    "original_url": {"type": "string", "null": True},
    "actor_type": {"type": "string", "values": V.ACTOR_TYPES},
    "mentions_our_company": {"type": "boolean"},
    "topics": {"type": "array<string>", "values": V.TOPICS, "items": (1, 4)},
    "keywords": {"type": "array<string>", "items": (3, 15)},
    "regions_mentioned": {"type": "array<string>", "values": V.REGIONS, "items": (0, 15)},
    "evidence": {"type": "array<string>", "items": (2, 4)},
    "insights": {"type": "array<string>", "items": (2, 4)},
    "priority": {"type": "string", "values": V.LEVELS},
    "confidence": {"type": "string", "values": V.LEVELS},
    "review_status": {"type": "string", "values": V.REVIEW_STATES},
}


def broken_contract(df: DataFrame) -> DataFrame:
    """(record_id, field, why) of fields that are null without leave, hold other values, or have too few or too many items.

    A table that lacks a field, or has it with another type, raises.
    """
    kinds = dict(df.dtypes)
    for field, rule in CONTRACT.items():
        if kinds.get(field) != rule["type"]:
            raise ValueError(f"{field} is {kinds.get(field)}, not {rule['type']}")
    def outside(values: list[str]):
        return lambda x: ~x.isin(values)

    checks = []
    for field, rule in CONTRACT.items():
        c, is_list = F.col(field), rule["type"].startswith("array")
        say = lambda condition, why, field=field: F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(why).alias("why")))
        if not rule.get("null"):
            checks.append(say(c.isNull(), "null"))
        if "values" in rule:
            checks.append(say(F.exists(c, outside(rule["values"])) if is_list else ~c.isin(rule["values"]), "value"))
        if "items" in rule:
            checks.append(say(~F.size(c).between(*rule["items"]) & c.isNotNull(), "items"))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select("record_id", F.explode(found).alias("f")).select("record_id", "f.field", "f.why")
