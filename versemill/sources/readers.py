"""Sources. Fetching from the network stays outside: what it lands in a folder is read here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versemill.functions.lexical import Lexicon

BUNDLE = "bundle int, generated string, chapters array<struct<n:int,name:string,title:string,verses:int>>, verses array<struct<id:string,ch:int,n:int,speaker:string,devanagari:string,iast:string,meaning:string,takeaway:string>>, feelings array<struct<name:string,line:string,verses:array<string>>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names anything, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def optional(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """A source that may be missing: then an empty frame of the schema (SRC13, SRC14)."""
    if not exists(spark, path):
        return spark.createDataFrame([], T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
    return records(spark, path, schema) if kind == "json" else spark.read.schema(schema).format(kind).load(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents, one or an array a file; unknown keys are ignored (SRC7, FN-J1)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, sha256, chars) of landed text or HTML files, invalid bytes replaced (SRC1-SRC6, SRC8, FN-H1)."""
    raw = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select("name", text.alias("text"), F.sha2(F.col("content"), 256).alias("sha256"), F.length(text).alias("chars"))


def missing_pages(landed: DataFrame, first: int, last: int) -> DataFrame:
    """(page) of a range that no landed file is named for (SRC3)."""
    have = landed.select(F.regexp_extract("name", "([0-9]+)", 1).try_cast("int").alias("page")).distinct()
    return landed.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("page")).join(have, "page", "left_anti")


def readings(landed: DataFrame) -> DataFrame:
    """(id, first, second, speaker) of witness pages: lines with a reference like Bhg_01.012a at their end, tags stripped,
    the later of two readings of one place standing; a line "X uvāca" before a place names its speaker (SRC9)."""
    lines = landed.select("name", F.posexplode(F.split(F.regexp_replace("text", "<[^>]+>", ""), "\n")).alias("k", "line"))
    ref = r"Bhg_([0-9]{2})\.([0-9]{3})([ac])"
    cut = lines.where(F.col("line").rlike(ref)).select(
        "name", "k", F.concat_ws(":", F.regexp_extract("line", ref, 1).cast("int"), F.regexp_extract("line", ref, 2).cast("int")).alias("id"), F.regexp_extract("line", ref, 3).alias("half"), F.trim(F.regexp_replace("line", r"[ /|]*" + ref + ".*$", "")).alias("reading"))
    said = lines.where(F.col("line").rlike(r"uvāca\s*$")).select("name", (F.col("k") + 1).alias("k"), F.trim(F.regexp_replace("line", r"\s*uvāca\s*$", "")).alias("speaker"))
    met = cut.join(said, ["name", "k"], "left")
    last = lambda h: F.max_by(F.when(F.col("half") == h, F.col("reading")), F.when(F.col("half") == h, F.struct("name", "k")))
    return met.groupBy("id").agg(last("a").alias("first"), last("c").alias("second"), F.max("speaker").alias("speaker"))


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """One row: a content bundle with its nested tables (SRC10)."""
    return records(spark, path, BUNDLE)


def bundle_tables(one: DataFrame) -> dict[str, DataFrame]:
    """The bundle's tables, exploded."""
    return {name: one.select(F.inline(name)) for name in ("chapters", "verses", "feelings")}


def bundle_faults(one: DataFrame, version: int = 1) -> DataFrame:
    """(id, check, detail) of what makes a bundle unfit (DQ15): version, counts, contiguity, ids, blanks, references."""
    wrong = one.where(~F.coalesce(F.col("bundle") == version, F.lit(False)))
    return _fault(wrong, "bundle", "version", F.col("bundle")).unionByName(bundle_table_faults(bundle_tables(one)))


def _fault(rows: DataFrame, key: str, check: str, detail: Column) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("id"), F.lit(check).alias("check"), detail.cast("string").alias("detail"))


def bundle_table_faults(t: dict[str, DataFrame]) -> DataFrame:
    """The same of a bundle's tables: chapters, verses and feelings."""
    v, c = t["verses"], t["chapters"]
    sizes = v.groupBy("ch").agg(F.count("*").alias("k"), F.count_distinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    met = c.select(F.col("n").alias("ch"), "verses").join(sizes, "ch", "full")
    refs = t["feelings"].select("name", F.explode("verses").alias("ref")).join(v.select(F.col("id").alias("ref")), "ref", "left_anti")
    parts = [
        _fault(met.where("not (verses <=> k)"), "ch", "count", F.coalesce("k", F.lit(0))),
        _fault(sizes.where("lo <> 1 or hi <> k or d <> k"), "ch", "contiguity", F.col("hi")),
        _fault(v.where("not (id <=> concat(ch, ':', n))"), "id", "id", F.concat_ws(":", "ch", "n")),
        _fault(v.where("coalesce(trim(devanagari), '') = '' or coalesce(trim(meaning), '') = ''"), "id", "blank", F.lit("text")),
        _fault(refs, "name", "reference", F.col("ref")),
    ]
    return reduce(DataFrame.unionByName, parts)


LEXICON = "aliases map<string,string>, families map<string,array<string>>, archaic map<string,string>, concepts map<string,array<string>>, terms map<string,array<string>>"


def lexicon(spark: SparkSession, path: str) -> Lexicon:
    """An edition's word lists from one JSON document; lists it does not name, or a missing file, leave the built-in ones (SRC14)."""
    row = optional(spark, path, LEXICON).first()
    own = {k: v for k, v in (row.asDict() if row else {}).items() if v is not None}
    if "families" in own:
        own["forms"] = {form: name for name, forms in own.pop("families").items() for form in forms}
    return Lexicon(**{k: {x: tuple(y) if isinstance(y, list) else y for x, y in v.items()} for k, v in own.items()})
