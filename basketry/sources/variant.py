"""JSON lines of any shape: parsed once into a variant, their fields and types found by an aggregate, nothing of a line lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with ``_variant``, the whole of each line, and ``_broken``, the text of a line that is no JSON."""
    v = F.try_parse_json(value)
    return lines.withColumns({"_variant": v, "_broken": F.when(v.isNull(), F.col(value))}).drop(value)


def fields(rows: DataFrame) -> DataFrame:
    """(field, type, rows) of the top-level fields of parsed lines: a type that holds all values, VARIANT where they differ; nested
    objects and arrays with theirs. What new fields and types a delivery brings is its difference from this of the rows before."""
    each = rows.select("_variant").where("_variant is not null").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_variant").outer()))
    return each.where("key is not null").groupBy(F.col("key").alias("field")).agg(F.schema_of_variant_agg("value").alias("type"), F.count("*").alias("rows"))


def typed(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Parsed lines with a column for each path of ``schema`` (``props.k``, ``tags[0]``), ``_rescued`` and ``_variant``.

    A value that does not fit its type is null in its column and kept in ``_rescued``, a map of paths to JSON; fields that the
    schema does not name stay in ``_variant``. Columns are named by their paths, with underscores.
    """
    at = {path: F.try_variant_get("_variant", f"$.{path}", "variant") for path in schema}
    values = {path: F.try_variant_get("_variant", f"$.{path}", kind) for path, kind in schema.items()}
    unfit = [F.when(at[p].isNotNull() & ~F.is_variant_null(at[p]) & values[p].isNull(), F.struct(F.lit(p), F.to_json(at[p]))) for p in schema]
    rescued = F.map_from_entries(F.array_compact(F.array(*unfit)))
    rest = [c for c in rows.columns if c != "_variant"]
    named = [v.alias(p.replace(".", "_").replace("[", "_").replace("]", "")) for p, v in values.items()]
    return rows.select(*rest, *named, F.when(F.size(rescued) > 0, rescued).alias("_rescued"), "_variant")
