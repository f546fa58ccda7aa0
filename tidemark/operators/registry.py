"""A schema registry: versions of a subject, compatibility rules, and reading data of one version with another.

A field is (name, type, optional, has_default, default_value). Having no default and having null as
default differ, so has_default is a column of its own. Registered versions are few and live on the
driver; the compatibility check and the reader are expressions over DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("BACKWARD", "FORWARD", "FULL")
FIELD_SCHEMA = "name string, type string, optional boolean, has_default boolean, default_value string"


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    optional: bool = False
    has_default: bool = False
    default: str | None = None


@dataclass(frozen=True)
class Result:
    ok: bool
    id: int | None = None
    version: int | None = None
    reasons: tuple[str, ...] = ()


@dataclass
class Version:
    subject: str
    version: int
    id: int
    fields: tuple[Field, ...]


def fields_frame(spark: SparkSession, fields: tuple[Field, ...]) -> DataFrame:
    return spark.createDataFrame([(f.name, f.type, f.optional, f.has_default, f.default) for f in fields], FIELD_SCHEMA)


def problems(old: DataFrame, new: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """(*by, name, direction, problem): what the rules find between two versions' fields, by one full outer join.

    BACKWARD (new reads old): an added field without a default, a changed type. FORWARD (old reads
    new): a changed type, a removed field whose old definition had no default.
    """
    o = old.select(*by, "name", F.col("type").alias("old_type"), F.col("has_default").alias("old_default"))
    n = new.select(*by, "name", F.col("type").alias("new_type"), F.col("has_default").alias("new_default"))
    both = o.join(n, [*by, "name"], "full")
    added = F.col("old_type").isNull() & ~F.coalesce("new_default", F.lit(False))
    removed = F.col("new_type").isNull() & ~F.coalesce("old_default", F.lit(False))
    changed = F.col("old_type") != F.col("new_type")
    found = F.array_compact(F.array(
        F.when(added, F.struct(F.lit("BACKWARD").alias("direction"), F.lit("added without default").alias("problem"))),
        F.when(changed, F.struct(F.lit("BACKWARD").alias("direction"), F.lit("type changed").alias("problem"))),
        F.when(changed, F.struct(F.lit("FORWARD").alias("direction"), F.lit("type changed").alias("problem"))),
        F.when(removed, F.struct(F.lit("FORWARD").alias("direction"), F.lit("removed without default").alias("problem"))),
    ))
    return both.select(*by, "name", F.explode(found).alias("p")).select(*by, "name", "p.direction", "p.problem")


@dataclass
class Registry:
    spark: SparkSession
    versions: list[Version] = field(default_factory=list)

    def latest(self, subject: str) -> Version | None:
        return max((v for v in self.versions if v.subject == subject), key=lambda v: v.version, default=None)

    def by_id(self, ident: int) -> Version:
        for v in self.versions:
            if v.id == ident:
                return v
        raise KeyError(f"no schema has id {ident}")

    def check(self, subject: str, fields: tuple[Field, ...], mode: str) -> tuple[str, ...]:
        """Reasons against the latest version, backward ones first; none for a subject's first version."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        last = self.latest(subject)
        if last is None:
            return ()
        found = problems(fields_frame(self.spark, last.fields), fields_frame(self.spark, fields))
        wanted = found if mode == "FULL" else found.where(F.col("direction") == mode)
        rows = wanted.orderBy("direction", "name", "problem").collect()  # at most a few a field
        return tuple(f"{r.direction}: {r.name} {r.problem}" for r in rows)

    def register(self, subject: str, fields: tuple[Field, ...], mode: str = "BACKWARD") -> Result:
        """Adds a version if it is compatible with the latest; ids are global from 1, a refusal uses none."""
        reasons = self.check(subject, fields, mode)
        if reasons:
            return Result(False, reasons=reasons)
        last = self.latest(subject)
        added = Version(subject, last.version + 1 if last else 1, len(self.versions) + 1, tuple(fields))
        self.versions.append(added)
        return Result(True, added.id, added.version)


def produce(df: DataFrame, ident: int, data: str = "data") -> DataFrame:
    """Envelope: the data map with its writer's schema id."""
    return df.withColumn("schema_id", F.lit(ident)).select("schema_id", *[c for c in df.columns if c != data], data)


def consume(df: DataFrame, registry: Registry, reader: Version, data: str = "data") -> DataFrame:
    """Reader fields from the map: a present value, null included, as it is; else the default; others dropped.

    Unknown schema ids fail the query. Values are not coerced.
    """
    known = F.col("schema_id").isin([v.id for v in registry.versions])
    checked = F.when(known, F.col(data)).otherwise(F.raise_error(F.concat(F.lit("no schema has id "), F.col("schema_id").cast("string"))).cast("map<string,string>"))
    columns = [F.when(F.map_contains_key("_d", F.lit(f.name)), F.element_at("_d", F.lit(f.name))).otherwise(F.lit(f.default)).alias(f.name) for f in reader.fields]
    return df.withColumn("_d", checked).select(*[c for c in df.columns if c not in ("schema_id", data)], *columns)
