"""JSON payloads in, JSON matches out.

A payload is a JSON object ``{"descriptions": [ {...}, ... ]}``.  Payloads arrive
as a column of JSON text (one document per row, e.g. ``spark.read.text`` over
JSON-lines files), so many payloads are parsed in parallel; one payload is one
request and stays a bounded unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchfold.operators.validate import quoted
from matchfold.schema import ATTRIBUTES

TEXT_FIELDS = ("id", "source", "datetime", *ATTRIBUTES)
RAW_DESCRIPTION = T.StructType([T.StructField(f, T.StringType(), True) for f in TEXT_FIELDS])
PAYLOAD_SCHEMA = T.StructType([T.StructField("descriptions", T.ArrayType(RAW_DESCRIPTION), True)])

PAYLOAD_ERROR = "Unable to read JSON payload"


def typed_datetime(c: Column) -> Column:
    """Text timestamp -> TIMESTAMP_NTZ without any time zone (a DST gap in the
    session zone cannot shift it); unparsable text becomes NULL (then fails V2)."""
    return c.try_cast("timestamp_ntz")


def parse_description_text(df: DataFrame, text_col: str = "value", type_errors: bool = False) -> DataFrame:
    """S1 (JSON-lines form): one description object per row of text.

    ``type_errors`` adds the V4 column of that name, which validation rejects rows by."""
    if type_errors:
        df = df.withColumn("type_errors", field_type_errors(F.try_parse_json(F.col(text_col))))
    parsed = df.select(F.from_json(F.col(text_col), RAW_DESCRIPTION).alias("_d"), *[c for c in df.columns if c != text_col])
    return parsed.select(
        *[c for c in parsed.columns if c != "_d"],
        *[
            (typed_datetime(F.col(f"_d.{f}")) if f == "datetime" else F.col(f"_d.{f}")).alias(f)
            for f in TEXT_FIELDS
        ],
    )


def parse_payload_text(df: DataFrame, text_col: str = "value") -> DataFrame:
    """Parse payload documents; ``payload_error`` is set when the text is not
    JSON or has no ``descriptions`` array."""
    v = F.try_parse_json(F.col(text_col))
    parsed = F.from_json(F.col(text_col), PAYLOAD_SCHEMA)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    found = F.try_variant_get(v, "$.descriptions", "variant")
    is_array = F.schema_of_variant(found).startswith("ARRAY")
    error = (
        F.when(v.isNull(), F.lit(PAYLOAD_ERROR))
        .when(~is_object, not_of_type(v, "object"))
        .when(found.isNull(), F.lit("'descriptions' is a required property"))
        .when(~is_array, not_of_type(found, "array"))
    )
    return df.withColumn("payload", parsed).withColumn("payload_error", error)


def not_of_type(value: Column, kind: str) -> Column:
    """The message for a JSON value (a variant) of another type; strings and words as Python prints them."""
    text = F.when(F.schema_of_variant(value) == "STRING", quoted(F.try_variant_get(value, "$", "string"))).otherwise(_python_word(F.to_json(value)))
    return F.concat(text, F.lit(f" is not of type '{kind}'"))


def _python_word(json: Column) -> Column:
    """JSON's null, true and false as the messages print them."""
    return F.when(json == "null", "None").when(json == "true", "True").when(json == "false", "False").otherwise(json)


def field_type_errors(element: Column) -> Column:
    """V4 on raw JSON: every present description key must be a JSON string."""
    checks = []
    for f in ("id", *ATTRIBUTES):
        raw = F.try_variant_get(element, f"$.{f}", "variant")
        kind = F.schema_of_variant(raw)
        checks.append(
            F.when(
                raw.isNotNull() & (kind != F.lit("STRING")),
                F.struct(
                    F.lit(f).alias("field"),
                    F.concat(_python_word(F.to_json(raw)), F.lit(" is not of type 'string'")).alias("message"),
                ),
            )
        )
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def expand_payloads(df: DataFrame, text_col: str = "value", key_col: str | None = None) -> DataFrame:
    """Payload documents -> one typed row per description, with its position
    ``_pos`` inside the payload (for error paths) and ``type_errors`` (V4).

    A payload that cannot be expanded is one row with ``payload_error`` and no position; one of
    no descriptions is a row with neither.  ``item_error`` tells of a description that is no object."""
    keep = [key_col] if key_col else []
    checked = parse_payload_text(df.select(*keep, F.col(text_col).alias("_text")), "_text")
    elements = F.try_variant_get(F.try_parse_json("_text"), "$.descriptions", "array<variant>")
    exploded = checked.select(*keep, "payload_error", F.posexplode_outer(F.when(F.col("payload_error").isNull(), elements)).alias("_pos", "_e"))
    is_object = F.schema_of_variant("_e").startswith("OBJECT")
    return exploded.select(
        *keep,
        "_pos",
        *[
            (
                typed_datetime(F.try_variant_get("_e", f"$.{f}", "string"))
                if f == "datetime"
                else F.try_variant_get("_e", f"$.{f}", "string")
            ).alias(f)
            for f in TEXT_FIELDS
        ],
        field_type_errors(F.col("_e")).alias("type_errors"),
        "payload_error",
        F.when(~is_object, not_of_type(F.col("_e"), "object")).alias("item_error"),
    )


def match_json(df: DataFrame) -> DataFrame:
    """S7 (JSON-lines form): one ``{"id", "match_id", "similarity"}`` object per match,
    NULL fields kept as ``null``."""
    return df.select(
        F.to_json(
            F.struct("id", "match_id", "similarity"), {"ignoreNullFields": "false"}
        ).alias("json")
    )


def matches_to_json(df: DataFrame, request_col: str) -> DataFrame:
    """S7 (document form): one ``{"matches": [...]}`` document per request, matches in the order of ids (O1).

    Each request is one bounded group (its own payload), never the whole batch."""
    item = F.struct("id", "match_id", "similarity")
    return df.groupBy(request_col).agg(
        F.to_json(
            F.struct(F.sort_array(F.collect_list(item)).alias("matches")), {"ignoreNullFields": "false"}
        ).alias("json")
    )
