"""Loading a dataset document into stored relations: all checks first, then what is missing, or nothing."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from telar.operators.merging import load_conflicts
from telar.schemas import SECTIONS, key_of
from telar.sources import dataset
from telar.sources.sinks import Published


def load_dataset(spark: SparkSession, path: str, store: Published, metadata: dict[str, object] | None = None, declared: dict[str, int] | None = None) -> dict[str, int]:
    """Rows inserted per section. Raises DatasetError, and changes nothing, if any check fails.

    metadata and declared: values and numbers of rows that the document must have. Rows
    whose key is stored with the same values are left alone; one stored with other values
    stops the load, which names the fields that differ and never the values. After the
    load each section's keys must all be stored.
    """
    faults = dataset.metadata_faults(spark, path, metadata or {})
    tables = dataset.read_dataset(spark, path)
    faults += [f"{s}: {have} rows of {want} declared" for s, (want, have) in dataset.declared_totals_differ(tables, declared or {}).items()]
    faults += [f"{r.seccion} {r.regla}: {r.filas} rows" for r in dataset.dataset_violations(tables).collect()]
    if faults:
        raise dataset.DatasetError("; ".join(faults))
    with store.writing() as write:
        missing, counts = {}, {}
        for s in SECTIONS:
            held, key = write.read(s), key_of(s)
            if held is None:
                missing[s], counts[s] = tables[s], tables[s].count()
                continue
            k = F.to_json(F.struct(*key))  # keys of several columns as one
            own, old = tables[s].withColumn("_k", k), held.withColumn("_k", k)
            columns = [c for c in tables[s].columns if c not in key]
            if columns:
                differ = load_conflicts(old, own, "_k", columns).groupBy("columnas").count().orderBy("columnas").collect()
                faults += [f"{s}: {r['count']} rows differ in {r.columnas}" for r in differ]
            new = own.join(old.select("_k"), "_k", "left_anti").drop("_k")
            counts[s] = new.count()
            if counts[s]:
                missing[s] = new
        if faults:
            raise dataset.DatasetError("; ".join(faults))

        def check(written: dict) -> list[str]:
            lost = {s: tables[s].join(written[s], key_of(s), "left_anti").count() for s in SECTIONS}
            return [f"{s}: {n} keys not stored" for s, n in lost.items() if n]

        if missing:
            write.publish({}, missing, check)
    return counts
