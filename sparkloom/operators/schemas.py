"""Schema evolution: compatibility, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_WIDER = {("int", "bigint"), ("int", "double"), ("float", "double"), ("bigint", "double"), ("smallint", "int"), ("tinyint", "int"), ("date", "timestamp")}


def problems(writer: StructType, reader: StructType, path: str = "") -> list[str]:
    """Why rows written with one schema can't be read with another; empty if they can. A field that the writer lacks must be nullable;
    types may widen; extra fields are ignored."""
    out, written = [], {f.name: f for f in writer}
    for f in reader:
        name = f"{path}{f.name}"
        if f.name not in written:
            if not f.nullable:
                out.append(f"{name} is required and missing")
            continue
        old = written[f.name].dataType
        if isinstance(old, StructType) and isinstance(f.dataType, StructType):
            out += problems(old, f.dataType, name + ".")
        elif old != f.dataType and (old.simpleString(), f.dataType.simpleString()) not in _WIDER:
            out.append(f"{name} was {old.simpleString()} and is {f.dataType.simpleString()}")
    return out


def matrix(versions: dict[str, StructType]) -> dict[tuple[str, str], bool]:
    return {(w, r): not problems(versions[w], versions[r]) for w in versions for r in versions}


def backward_report(old: StructType, new: StructType) -> dict[str, list[str]]:
    return {"removed": sorted({f.name for f in old} - {f.name for f in new}), "newly_required": sorted(f.name for f in new if not f.nullable and f.name not in {g.name for g in old})}


def as_version(df: DataFrame, schema: StructType) -> DataFrame:
    """df read with another schema: missing fields are null, types widen, others are left out."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules (each a condition that should hold) that a row breaks; an unknown answer breaks a rule."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
