"""The dataset document: one JSON object with metadata and a list per relation."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telar.schemas import REFERENCES, SECTIONS, key_of
from telar.session import checkpoint


class DatasetError(ValueError):
    pass


class DatasetMissing(DatasetError):
    pass


class DatasetUnreadable(DatasetError):
    pass


def _document(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise DatasetMissing(path)
    return spark.read.option("wholetext", True).text(path)


def section_names(spark: SparkSession, path: str) -> set[str]:
    """Names at the top of the document; other errors are told apart."""
    raw = _document(spark, path)
    names = raw.select(F.json_object_keys("value").alias("k")).first()
    if names is None or names.k is None:
        raise DatasetUnreadable(f"{path} is no JSON object")
    return set(names.k)


def read_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A DataFrame per section, with the section's declared types.

    Spark drops unknown fields silently, so column sets are compared first: the document
    must have exactly the declared columns. Values that don't fit their type fail the read
    (a boolean is no number), and so do instants without a zone.
    """
    names = section_names(spark, path)
    if missing := sorted(set(SECTIONS) - names):
        raise DatasetError(f"sections missing: {', '.join(missing)}")
    schema = T.StructType([T.StructField(s, T.ArrayType(t)) for s, t in SECTIONS.items()])
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if faults := column_faults(spark, path) + naive_instants(spark, path):
        raise DatasetError("; ".join(faults))
    doc = checkpoint(doc)  # the document is one row, which each section would parse anew
    return {s: doc.select(F.explode(s).alias("x")).select("x.*") for s in SECTIONS}


def column_faults(spark: SparkSession, path: str) -> list[str]:
    """Columns that rows lack or have in excess, by section; distinct key sets only reach the driver."""
    raw = _document(spark, path)
    loose = T.StructType([T.StructField(s, T.ArrayType(T.StringType())) for s in SECTIONS])
    doc = raw.select(F.from_json("value", loose).alias("d"))
    keys = [doc.select(F.lit(s).alias("s"), F.explode(f"d.{s}").alias("x")).select("s", F.array_join(F.sort_array(F.json_object_keys("x")), ",").alias("k")).distinct() for s in SECTIONS]
    found = []
    for r in reduce(DataFrame.unionByName, keys).collect():
        have, want = set((r.k or "").split(",")), set(SECTIONS[r.s].fieldNames())
        if have != want:
            found.append(f"{r.s}: missing {sorted(want - have)}, unexpected {sorted(have - want)}")
    return sorted(found)


def naive_instants(spark: SparkSession, path: str) -> list[str]:
    """Columns with instants that name no zone, which would mean another instant in another session."""
    timed = {s: [f.name for f in t.fields if isinstance(f.dataType, T.TimestampType)] for s, t in SECTIONS.items()}
    loose = T.StructType([T.StructField(s, T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in cs]))) for s, cs in timed.items() if cs])
    doc = _document(spark, path).select(F.from_json("value", loose).alias("d"))
    zoned = r"(Z|[+-]\d\d(:?\d\d)?)$"
    naive = [F.exists(F.col(f"d.{s}.{c}"), lambda x: ~x.rlike(zoned)).alias(f"{s}.{c}") for s, cs in timed.items() for c in cs]
    found = doc.select(*naive).first().asDict()
    return sorted(f"{name}: instants without a zone" for name, bad in found.items() if bad)


def metadata_faults(spark: SparkSession, path: str, expected: dict[str, object]) -> list[str]:
    """Metadata values that differ from the approved ones; one small object, read on the driver."""
    text = _document(spark, path).select(F.get_json_object("value", "$.metadata").alias("m")).first().m
    have = json.loads(text) if text else {}
    return [f"metadata {k}: {have.get(k)!r}" for k, v in sorted(expected.items()) if have.get(k) != v]


def dataset_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """seccion, regla, filas: repeated keys and references without a parent."""
    parts = []
    for s, df in tables.items():
        k = key_of(s)
        parts.append(df.groupBy(*k).count().filter("count > 1").agg(F.count("*").alias("filas")).select(F.lit(s).alias("seccion"), F.lit("clave_repetida").alias("regla"), "filas"))
    for s, c, parent, key in REFERENCES:
        gone = tables[s].select(F.col(c).alias("k")).filter("k is not null").join(tables[parent].select(F.col(key).alias("k")).distinct(), "k", "left_anti")
        parts.append(gone.agg(F.count("*").alias("filas")).select(F.lit(s).alias("seccion"), F.lit(f"{c} -> {parent}").alias("regla"), "filas"))
    return reduce(DataFrame.unionByName, parts).filter("filas > 0")


def declared_totals_differ(tables: dict[str, DataFrame], declared: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Sections whose declared number of rows isn't the real one."""
    have = {s: tables[s].count() for s in declared}
    return {s: (declared[s], have[s]) for s in declared if declared[s] != have[s]}
