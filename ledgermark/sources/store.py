"""The stored catalog: a folder of Parquet for each base relation, by the schema version that wrote it.

Facts lie in buckets of filers, sorted by filer and filing day, so that plans by filer read them without a shuffle and a
filter on days or filers skips what it does not need.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgermark.schemas import FACT, FILER, FILING, PRICE, SCHEMA_VERSION
from ledgermark.schemas import schema as columns

from ledgermark.tables import materialise

from . import sinks
from .adapter import Store

RELATIONS = {"filer": FILER, "filing": FILING, "fact": FACT, "price": PRICE}
VERSION, WRITTEN = "schema_version", "written_by"
BUCKETS = 64


@dataclass(frozen=True)
class Step:
    """A schema version and the column that it added to a relation, with the value that older rows are read with."""

    version: int
    relation: str
    column: str
    kind: str
    default: object = None


#: Steps from the first version on, in order.
STEPS: tuple[Step, ...] = ()


def _marked(spark: SparkSession, path: str, version: int) -> None:
    spark.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{path}/{VERSION}")


def create(spark: SparkSession, path: str) -> Store:
    """A catalog without rows, of the current version. A catalog that is there already is an error."""
    for name, schema in RELATIONS.items():
        spark.createDataFrame([], schema).write.mode("error").parquet(f"{path}/{name}")
    _marked(spark, path, SCHEMA_VERSION)
    return open_store(spark, path)


def version_of(spark: SparkSession, path: str) -> int:
    """The newest version that a catalog was marked with."""
    return spark.read.schema("version int").parquet(f"{path}/{VERSION}").agg(F.max("version")).first()[0]


def open_store(spark: SparkSession, path: str, steps: tuple[Step, ...] = STEPS) -> Store:
    """The relations of a catalog, of this version or an older one; columns that older rows lack have their step's default.
    A newer catalog is refused: what this code does not know of it would be lost on writing."""
    known = max([SCHEMA_VERSION, *[s.version for s in steps]])
    version = version_of(spark, path)
    if version > known:
        raise ValueError(f"{path} has schema version {version}; this code knows {known}")
    return Store(**{name: _read(spark, path, name, schema, steps) for name, schema in RELATIONS.items()})


def migrate(spark: SparkSession, path: str, steps: tuple[Step, ...] = STEPS) -> list[int]:
    """Take a catalog through the versions above its own, in order, each marked as it is passed; these versions. Steps only add
    columns, so files stay as they are and are read with defaults: a migration that breaks off goes on where it was."""
    at = version_of(spark, path)
    todo = sorted({SCHEMA_VERSION, *[s.version for s in steps]})
    passed = [v for v in range(at + 1, max(todo) + 1)]
    for v in passed:
        _marked(spark, path, v)
    return passed


def append(spark: SparkSession, path: str, name: str, rows: DataFrame, steps: tuple[Step, ...] = STEPS) -> None:
    """Add rows to a relation as the catalog's version has it: their own columns, and for those they lack the defaults."""
    version = version_of(spark, path)
    added = [s for s in steps if s.relation == name and s.version <= version]
    own = [F.col(f.name) for f in RELATIONS[name]]
    own += [(F.col(s.column) if s.column in rows.columns else F.lit(s.default)).cast(s.kind).alias(s.column) for s in added]
    rows.select(*own).write.mode("append").parquet(f"{path}/{name}/{WRITTEN}={version}")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def _read(spark: SparkSession, path: str, name: str, schema: StructType, steps: tuple[Step, ...]) -> DataFrame:
    """Rows of all versions. Files that lie beside the versions' folders are the first version's."""
    added = [s for s in steps if s.relation == name]
    wide = StructType([*schema.fields, *[columns(f"{s.column} {s.kind}")[0] for s in added], columns(f"{WRITTEN} int")[0]])
    first, later = _there(spark, f"{path}/{name}/*.parquet"), _there(spark, f"{path}/{name}/{WRITTEN}=*")
    if not first and not later:
        raise ValueError(f"{path} has no {name}")
    out = spark.read.schema(schema).parquet(f"{path}/{name}/*.parquet") if first else spark.createDataFrame([], schema)
    out = out.select("*", *[F.lit(s.default).cast(s.kind).alias(s.column) for s in added])
    if later:
        # a null in a row that was written with the column is a null; only rows from before it have the default
        rows = spark.read.schema(wide).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/{WRITTEN}=*")
        for s in added:
            rows = rows.withColumn(s.column, F.when(F.col(WRITTEN) < s.version, F.lit(s.default).cast(s.kind)).otherwise(F.col(s.column)))
        rows = rows.drop(WRITTEN)
        out = out.unionByName(rows) if first else rows
    return out


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    return jvm, jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())


def rewrite(spark: SparkSession, path: str, name: str, rows: DataFrame) -> None:
    """Put ``rows`` in a relation's place. They may come from the relation itself: they are written beside it first, and the old
    folder goes only when they are whole. (``recover`` ends what a driver that died left between the two.)"""
    version = version_of(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/{name}.next/{WRITTEN}={version}")
    jvm, fs = _fs(spark, path)
    fs.delete(jvm(f"{path}/{name}"), True)
    fs.rename(jvm(f"{path}/{name}.next"), jvm(f"{path}/{name}"))


def recover(spark: SparkSession, path: str) -> list[str]:
    """Relations that a broken rewrite had taken away and that now have their new rows; unfinished ones are dropped."""
    jvm, fs = _fs(spark, path)
    done = []
    for name in RELATIONS:
        following = jvm(f"{path}/{name}.next")
        if fs.exists(following):
            if fs.exists(jvm(f"{path}/{name}")):
                fs.delete(following, True)
            else:
                fs.rename(following, jvm(f"{path}/{name}"))
                done.append(name)
    return done


def ingest(spark: SparkSession, path: str, filers: DataFrame, filings: DataFrame, facts: DataFrame) -> dict[str, int]:
    """Merge filers, filings and facts into a catalog: new facts are appended, filers and filings rewritten; rows of each after it.
    The same rows once more change nothing. Facts come last, so that an ingest which breaks off is made good by the next."""
    held = open_store(spark, path)
    filer, filing, new = sinks.ingest(held.filer, held.filing, held.fact, filers, filings, facts)
    new = materialise(new, "new-facts")  # read before anything is written
    rewrite(spark, path, "filer", materialise(filer.select(*FILER.fieldNames()), "filers"))
    rewrite(spark, path, "filing", materialise(filing.select(*FILING.fieldNames()), "filings"))
    if not new.isEmpty():
        append(spark, path, "fact", new)
    now = open_store(spark, path)
    return {"filer": now.filer.count(), "filing": now.filing.count(), "fact": now.fact.count(), "new_facts": new.count()}


def settle(spark: SparkSession, store: Store, path: str, buckets: int = BUCKETS) -> None:
    """Lay out a store's facts below ``path`` in buckets of filers, sorted by filer and filing day. Rows are dealt out by filer
    first, so that each bucket is one file; facts that are dealt out by filer already are written from where they lie (one file
    for each bucket, if there are as many parts)."""
    table = f"settled_{uuid.uuid4().hex}"
    facts = store.fact.select(*FACT.fieldNames())
    if not store.by_filer:
        facts = facts.repartition(buckets, "cik")
    facts.write.bucketBy(buckets, "cik").sortBy("cik", "filed_date").option("path", path).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the table's files stay: its place is its own


def settled(spark: SparkSession, store: Store, path: str, buckets: int = BUCKETS) -> Store:
    """``store`` with the facts that ``settle`` laid out below ``path``, so that plans by filer do not shuffle them."""
    table = f"facts_{uuid.uuid4().hex}"
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FACT)
    spark.sql(f"CREATE TABLE {table} ({kinds}) USING parquet CLUSTERED BY (cik) SORTED BY (cik, filed_date) INTO {buckets} BUCKETS LOCATION '{path}'")
    return Store(store.filer, store.filing, spark.table(table), store.price, by_filer=True)
