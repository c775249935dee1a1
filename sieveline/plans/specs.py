"""Declarative dataset specs: scan → filter → derive → rename → label.

A spec holds names and SQL expressions only; ``build_dataset`` turns it into one
projection over the source scan, so filters and column selection reach the file
reader.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class DatasetSpec:
    datapred: str
    task: str  # 'classification' or 'regression'
    label: str  # SQL expression over the source (and derived) columns
    concepts: dict[str, str]  # source column → concept name, in concept order
    derive: dict[str, str] = field(default_factory=dict)  # new column → SQL expression
    where: str | None = None
    drop_missing: bool = False
    numeric: tuple[str, ...] | None = None  # concepts; None = decided by column type
    group: str | None = None
    fill_missing: bool = False  # missing feature values become 0


def _q(c: str):
    return F.col(f"`{c}`")


def build_dataset(df: DataFrame, spec: DatasetSpec, row_id: str, selected: list[str] | None = None) -> DataFrame:
    """``row_id, label[, group_id], concepts...``.

    ``selected`` keeps the given concepts in the given order (all when None).
    """
    if spec.drop_missing:
        df = df.na.drop("any")
    if spec.where:
        df = df.filter(spec.where)
    for name, expression in spec.derive.items():
        df = df.withColumn(name, F.expr(expression))
    by_concept = {concept: source for source, concept in spec.concepts.items()}
    wanted = list(by_concept) if selected is None else selected
    missing = [c for c in wanted if c not in by_concept]
    if missing:
        raise ValueError(f"unknown concepts: {missing}")
    if not wanted:
        raise ValueError("no concepts selected")
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for concept in wanted:
        source = by_concept[concept]
        c = _q(source)
        if spec.fill_missing and isinstance(types[source], T.NumericType):
            c = F.coalesce(c, F.lit(0).cast(types[source]))
        columns.append(c.alias(concept))
    head = [_q(row_id).alias("row_id"), F.expr(spec.label).cast("double").alias("label")]
    if spec.group:
        head.append(_q(spec.group).cast("double").alias("group_id"))
    return df.select(*head, *columns)


def concept_kinds(df: DataFrame, spec: DatasetSpec) -> dict[str, str]:
    """concept → 'numeric' | 'categorical', by the spec's list or by column type."""
    out = {}
    for f in df.schema.fields:
        if f.name in set(spec.concepts.values()):
            if spec.numeric is not None:
                out[f.name] = "numeric" if f.name in spec.numeric else "categorical"
            else:
                out[f.name] = "numeric" if isinstance(f.dataType, T.NumericType) else "categorical"
    return out


def concept_table(spark, spec: DatasetSpec, kinds: dict[str, str] | None = None) -> DataFrame:
    """(datapred, pos, concept, kind) of a spec."""
    numeric = spec.numeric or ()
    rows = [
        (spec.datapred, i, c, (kinds or {}).get(c) or ("numeric" if c in numeric else "categorical"))
        for i, c in enumerate(spec.concepts.values())
    ]
    return spark.createDataFrame(rows, "datapred string, pos int, concept string, kind string")


def exclude_columns(columns: list[str], excluded) -> list[str]:
    drop = set(excluded)
    return [c for c in columns if c not in drop]


def select_in_source_order(source: list[str], selected) -> list[str]:
    """The selected names in the order of the source, not of the selection."""
    keep = set(selected)
    return [c for c in source if c in keep]


def label_codes(df: DataFrame, definitions: DataFrame, codes: list[str]) -> DataFrame:
    """(pos, code, concept, kind) per code, from the first definition of each code.

    ``definitions`` has (line, code, type_code, description); the concept is
    ``description (code)`` and type code 'C' means categorical.
    """
    wanted = df.sparkSession.createDataFrame(list(enumerate(codes)), "pos int, code string")
    first = definitions.groupBy("code").agg(
        F.min_by(F.struct("type_code", "description"), "line").alias("_d")
    )
    return wanted.join(first, "code").select(
        "pos", "code", F.concat(F.col("_d.description"), F.lit(" ("), "code", F.lit(")")).alias("concept"),
        F.when(F.col("_d.type_code") == "C", "categorical").otherwise("numeric").alias("kind"),
    )
