"""Declarative rewrites: rules of a match and the data to set, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def apply_rules(df: DataFrame, rules: list[dict], group: str | None = None) -> DataFrame:
    """Rules in order; each sets its Data on rows whose fields equal its Match, all compared as strings.

    A scalar is overwritten, an array grows, a map takes the entries over.  A
    rule of another group, or that names a column the frame lacks in its match,
    changes nothing; unknown columns of its data are left out.
    """
    for rule in rules:
        if group is not None and rule.get("Group", group) != group:
            continue
        match = rule.get("Match", {})
        if any(k not in df.columns for k in match):
            continue
        hit = F.lit(True)
        for k, v in match.items():
            hit = hit & F.coalesce(F.col(k).cast("string") == F.lit(str(v)), F.lit(False))
        changes = {}
        for k, v in rule.get("Data", {}).items():
            if k not in df.columns:
                continue
            kind = df.schema[k].dataType
            if isinstance(kind, T.ArrayType):
                new = F.concat(F.coalesce(F.col(k), F.array().cast(kind)), F.array(*[F.lit(x) for x in (v if isinstance(v, list) else [v])]).cast(kind))
            elif isinstance(kind, T.MapType):
                added = F.create_map(*[F.lit(x) for pair in v.items() for x in pair]).cast(kind)
                # entries of the rule win over what is there
                held = F.map_filter(F.coalesce(F.col(k), F.create_map().cast(kind)), lambda x, _: ~F.array_contains(F.map_keys(added), x))
                new = F.map_concat(held, added)
            else:
                new = F.lit(v).cast(kind)
            changes[k] = F.when(hit, new).otherwise(F.col(k))
        df = df.withColumns(changes) if changes else df
    return df
