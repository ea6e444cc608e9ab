"""JSON that is not as it should be: typed fields, what else there is, and a quarantine for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BROKEN, NOT_AN_OBJECT, MISSING = "not JSON", "not an object", "nothing"


def parse_tolerant(rows: DataFrame, json_col: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` plus the fields of ``schema``, ``others`` and ``fault``.

    schema: top-level fields and their types ('k bigint, tags array<string>'). A field that is absent or null is null.
    others: the object's other fields, by name, as JSON texts; null where there are none. fault: why a row is not good, else null: there is
    no text, it is not JSON, it is not an object, a field is not of its type, or a required field is absent or null (the
    first such field, in order of the schema). Faulty rows keep what could be read. Columns of the added names are replaced.

    The text is parsed once, into a variant, of which the fields are cut; nothing is read twice to learn a schema.
    """
    fields = StructType.fromDDL(schema).fields
    added = [*(f.name for f in fields), "others", "fault"]
    rest = rows.drop(*(c for c in added if c != json_col))
    v = F.col("__loomframe_json")
    # As the one element of an array, as the parser does not mind what follows a value.
    text = F.coalesce(F.trim(F.col(json_col).cast("string")), F.lit(""))
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = F.try_variant_get("__loomframe_json", "$[1]", "variant").isNull()
    first = F.try_variant_get("__loomframe_json", "$[0]", "variant")
    raw = rest.withColumn("__loomframe_json", alone).withColumn("__loomframe_json", F.when(single, first))
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    at = lambda name: "$['" + name + "']"
    typed = {f.name: F.try_variant_get(v, at(f.name), f.dataType.simpleString()) for f in fields}
    value = lambda f: F.try_variant_get(v, at(f.name), "variant")
    there = lambda f: value(f).isNotNull() & ~F.is_variant_null(value(f))
    every = F.from_json(F.to_json(v), "map<string,variant>")
    left = F.map_filter(every, lambda k, _: ~k.isin([f.name for f in fields]))
    others = F.when(is_object, F.transform_values(left, lambda _, x: F.to_json(x)))
    fault = F.when(text == "", MISSING).when(v.isNull(), BROKEN).when(~is_object, NOT_AN_OBJECT)
    for f in fields:
        fault = fault.when(there(f) & typed[f.name].isNull(), f"{f.name} is not {f.dataType.simpleString()}")
        if f.name in required:
            fault = fault.when(~there(f), f"{f.name} is missing")
    parsed = raw.withColumns({"__loomframe_fault": fault, "__loomframe_others": others, **{f"__loomframe_{i}": typed[f.name] for i, f in enumerate(fields)}})
    kept: list[Column] = [F.col(c) for c in rest.columns if c not in added]
    told = F.when(F.size("__loomframe_others") > 0, F.col("__loomframe_others")).alias("others")
    return parsed.select(*kept, *[F.col(f"__loomframe_{i}").alias(f.name) for i, f in enumerate(fields)], told, F.col("__loomframe_fault").alias("fault"))


def split_quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without ``fault``, faulty rows) of ``parse_tolerant``: filters of one plan, so each sink that is written reads the input once."""
    return parsed.where("fault is null").drop("fault"), parsed.where("fault is not null")


def fault_counts(parsed: DataFrame) -> DataFrame:
    """``(fault, n)``: how many rows have each fault; good ones under null."""
    return parsed.groupBy("fault").agg(F.count(F.lit(1)).alias("n"))
