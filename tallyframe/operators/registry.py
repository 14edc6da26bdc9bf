"""Schemas of datasets inferred from a sample, and datasets that can be bridged."""

from __future__ import annotations

import pathlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds by file suffix, fields that bridge, words that show entities.
KINDS = {".pdf": "pdf", ".csv": "csv", ".json": "json", ".xlsx": "excel"}
BRIDGES = ["school_code", "udise_code", "school_id", "district", "mandal", "division", "go_number", "policy_id", "circular_id", "department", "office", "institution_id", "date", "year", "academic_year"]
ENTITY_WORDS = {
    "school": ["school", "institution"], "district": ["district", "mandal"], "go": ["go.", "g.o.", "government order"], "policy": ["policy", "scheme"],
    "teacher": ["teacher", "faculty"], "student": ["student", "pupil"], "enrollment": ["enrollment", "enrolment"], "infrastructure": ["infrastructure", "building", "classroom"],
}
# The known datasets and what they can be bridged by.
KNOWN = [("scert", ["school_code", "district"]), ("cse", ["district", "policy_number"]), ("udise", ["udise_code", "district"]), ("ap_go", ["go_number", "district", "department"])]


def field_type(value: object) -> str:
    """Booleans are integers here, as integers are tested first."""
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        if value.isdigit():
            return "string_numeric"
        return "date" if "date" in value.lower() or (len(value) == 10 and "/" in value) else "string"
    return "unknown"


def inferred(path: str, sample: dict[str, object]) -> dict[str, object]:
    """The schema of a file from its name and one record."""
    where = pathlib.PurePath(path)
    kind, low = KINDS.get(where.suffix.lower(), "unknown"), str(sample).lower()
    entities = [e for e, words in ENTITY_WORDS.items() if any(w in low for w in words)] or ["document"]
    fields = {k.lower().replace(" ", "_"): field_type(v) for k, v in sample.items()}
    bridges = [f for f in fields if any(b in f for b in BRIDGES)]
    if kind == "pdf":
        method = "table_extraction" if "table" in low or len(low.split("\n")) > 20 else "nlp_extraction"
    else:
        method = "structured" if kind in ("csv", "json", "excel") else "nlp_extraction"
    return {"name": "_".join([where.stem, *sorted(entities)[:2]]), "source_type": kind, "entity_types": entities, "key_fields": fields, "bridge_potential": bridges, "extraction_method": method}


def value_kinds(records: DataFrame) -> DataFrame:
    """``path, field, kind`` of every field of every record (``path, json``); nulls have no kind."""
    parsed = records.select("path", F.parse_json("json").alias("v"))
    each = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer())).select("path", F.regexp_replace(F.lower("key"), " ", "_").alias("field"), F.schema_of_variant("value").alias("t"), F.try_variant_get("value", "$", "string").alias("s"))
    text = F.when(F.col("s").rlike("^[0-9]+$"), "string_numeric").when(F.lower("s").contains("date") | ((F.length("s") == 10) & F.col("s").contains("/")), "date").otherwise("string")
    kind = F.when(F.col("t").isin("BIGINT", "BOOLEAN"), "integer").when(F.col("t").startswith("DECIMAL") | F.col("t").isin("DOUBLE", "FLOAT"), "float").when(F.col("t") == "STRING", text).when(F.col("t") != "VOID", "unknown")
    return each.select("path", "field", kind.alias("kind"))


def field_profiles(records: DataFrame) -> DataFrame:
    """``path, field, kind, null_share`` over all records of each file.

    A field of one kind has that; integers beside floats are floats, any other mixture strings, nulls alone are
    unknown. Absent fields count as nulls. Kinds are summed before anything is shuffled by file.
    """
    counts = value_kinds(records).groupBy("path", "field").agg(F.count("kind").alias("n"), F.collect_set("kind").alias("kinds"))
    sizes = records.groupBy("path").agg(F.count(F.lit(1)).alias("size"))
    numbers = F.size(F.array_except("kinds", F.array(F.lit("integer"), F.lit("float")))) == 0
    kind = F.when(F.size("kinds") == 0, "unknown").when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).when(numbers, "float").otherwise("string")
    return counts.join(sizes, "path").select("path", "field", kind.alias("kind"), (1 - F.col("n") / F.col("size")).alias("null_share"))


def profiled(records: DataFrame) -> DataFrame:
    """The schema of every file from its name and all of its records (``path, json``):
    ``path, name, source_type, entity_types, fields, bridge_potential, method``.

    A word that shows an entity counts in any record, in names of fields or values. ``fields`` are ``name:kind``.
    """
    low = F.lower("json")
    found = [F.max(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])).alias(f"is_{e}") for e, words in ENTITY_WORDS.items()]
    files = records.groupBy("path").agg(*found, F.max(F.contains(low, F.lit("table")) | (F.size(F.split(low, r"\\n")) > 20)).alias("tabular"))
    fields = field_profiles(records).groupBy("path").agg(F.array_sort(F.collect_list(F.concat_ws(":", "field", "kind"))).alias("fields"))
    some = F.array_compact(F.array(*[F.when(F.col(f"is_{e}"), e) for e in ENTITY_WORDS]))
    entities = F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("document")))
    file = F.substring_index("path", "/", -1)
    suffix = F.lower(F.regexp_extract(file, r"(\.[^.]*)$", 1))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), suffix), F.lit("unknown"))
    method = F.when(F.col("source_type") == "pdf", F.when(F.col("tabular"), "table_extraction").otherwise("nlp_extraction")).when(F.col("source_type").isin("csv", "json", "excel"), "structured").otherwise("nlp_extraction")
    names = F.transform("fields", lambda f: F.substring_index(f, ":", 1))
    bridges = F.filter(names, lambda f: reduce(Column.__or__, [F.contains(f, F.lit(b)) for b in BRIDGES]))
    both = files.join(fields, "path", "left").withColumns({"entity_types": entities, "source_type": kind})
    name = F.concat_ws("_", F.regexp_replace(file, r"\.[^.]*$", ""), F.slice(F.array_sort("entity_types"), 1, 2))
    return both.select("path", name.alias("name"), "source_type", "entity_types", "fields", F.coalesce(bridges, F.array().cast("array<string>")).alias("bridge_potential"), method.alias("method"))


def save(schemas: DataFrame, where: str) -> None:
    """Whole records of the registry, one JSON line each."""
    schemas.write.mode("overwrite").json(where)


def load(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema("path string, name string, source_type string, entity_types array<string>, fields array<string>, bridge_potential array<string>, method string").json(where)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "name string, bridge_potential array<string>")


def compatible(schemas: DataFrame) -> DataFrame:
    """``a, b, fields``: pairs of datasets with common bridge fields, by a join on the field."""
    fields = schemas.select("name", F.explode("bridge_potential").alias("field"))
    other = fields.withColumnRenamed("name", "b")
    return fields.join(other, "field").where("name < b").groupBy(F.col("name").alias("a"), "b").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
