"""Metadata predicates given as a dictionary, compiled to one column expression.

    {"lang": "en", "n_chars": {"$gte": 100, "$lt": 900}, "tags": {"$contains": "x"}}

Conditions on fields and operators on a field must all hold. A field that is absent is
null. Equality and $ne treat null as a value; the order comparisons and $contains
reject null. An operator that is not known passes everything, unless strict.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("$gte", "$lte", "$gt", "$lt", "$contains", "$ne")


class TypedFields:
    """Fields that are columns of a DataFrame."""

    def __init__(self, df: DataFrame):
        self.df, self.types = df, {f.name: f.dataType for f in df.schema.fields}

    def equal(self, name: str, operand: Any) -> Column:
        if name not in self.types:
            return F.lit(operand is None)
        return F.col(name).isNull() if operand is None else F.col(name).eqNullSafe(F.lit(operand))

    def compared(self, name: str, op: str, operand: Any) -> Column:
        if name not in self.types or operand is None:
            return F.lit(False)
        c, v = F.col(name), F.lit(operand)
        return {"$gte": c >= v, "$lte": c <= v, "$gt": c > v, "$lt": c < v}[op]

    def contains(self, name: str, operand: Any) -> Column:
        kind = self.types.get(name)
        if isinstance(kind, T.ArrayType) and operand is not None:
            return F.array_contains(name, operand)
        if isinstance(kind, T.StringType) and isinstance(operand, str):
            return F.contains(F.col(name), F.lit(operand))
        return F.lit(False)


class VariantFields:
    """Fields of a VARIANT column that holds a JSON document. A comparison whose types
    differ is null and so rejects."""

    def __init__(self, column: str):
        self.column = column

    def _as(self, name: str, operand: Any) -> Column:
        kind = "boolean" if isinstance(operand, bool) else "double" if isinstance(operand, (int, float)) else "string"
        value = F.try_variant_get(F.col(self.column), f"$['{name}']", kind)
        if kind == "string":  # a number is not equal to its text
            return F.when(F.schema_of_variant(F.try_variant_get(F.col(self.column), f"$['{name}']", "variant")) == "STRING", value)
        return value

    def equal(self, name: str, operand: Any) -> Column:
        whole = F.try_variant_get(F.col(self.column), f"$['{name}']", "variant")
        if operand is None:
            return whole.isNull() | F.is_variant_null(whole)
        return self._as(name, operand).eqNullSafe(F.lit(operand))

    def compared(self, name: str, op: str, operand: Any) -> Column:
        if operand is None:
            return F.lit(False)
        c, v = self._as(name, operand), F.lit(operand)
        return {"$gte": c >= v, "$lte": c <= v, "$gt": c > v, "$lt": c < v}[op]

    def contains(self, name: str, operand: Any) -> Column:
        kind = "boolean" if isinstance(operand, bool) else "double" if isinstance(operand, (int, float)) else "string"
        members = F.array_contains(F.try_variant_get(F.col(self.column), f"$['{name}']", f"array<{kind}>"), operand)
        within = F.contains(self._as(name, operand), F.lit(operand)) if isinstance(operand, str) else F.lit(False)
        return F.coalesce(members, within)


def predicate(filters: dict[str, Any] | None, fields: TypedFields | VariantFields, strict: bool = False) -> Column | None:
    """The filters as one boolean column, or None if there are none."""
    if not filters:
        return None
    whole = F.lit(True)
    for name, condition in filters.items():
        if not isinstance(condition, dict):
            whole = whole & fields.equal(name, condition)
            continue
        for op, operand in condition.items():
            if op in ("$gte", "$lte", "$gt", "$lt"):
                whole = whole & F.coalesce(fields.compared(name, op, operand), F.lit(False))
            elif op == "$contains":
                whole = whole & F.coalesce(fields.contains(name, operand), F.lit(False))
            elif op == "$ne":
                whole = whole & ~fields.equal(name, operand)
            elif strict:
                raise ValueError(f"unknown filter operator {op!r}; known are {', '.join(OPERATORS)}")
    return whole
