"""Schemas and the attribute priority order."""

from pyspark.sql import types as T

# The six identifying attributes in priority order (highest first).
# The position (1..6) is also the digit position in the similarity string.
ATTRIBUTES = (
    "companies_house_id",
    "duns_number",
    "company_name",
    "contact_email",
    "cdms_ref",
    "postcode",
)

DESCRIPTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), True),
        T.StructField("source", T.StringType(), True),
        T.StructField("datetime", T.TimestampNTZType(), True),
    ]
    + [T.StructField(a, T.StringType(), True) for a in ATTRIBUTES]
)

# One mapping table per attribute: attribute value -> cluster.
MAPPING_SCHEMA = T.StructType(
    [
        T.StructField("value", T.StringType(), False),
        T.StructField("prev_match_id", T.LongType(), False),
        T.StructField("match_id", T.LongType(), False),
        T.StructField("source", T.StringType(), True),
        T.StructField("datetime", T.TimestampNTZType(), True),
    ]
)

MATCH_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), True),
        T.StructField("match_id", T.LongType(), True),
        T.StructField("similarity", T.StringType(), False),
    ]
)

DNB_MATCH_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), True),
        T.StructField("match_id", T.StringType(), True),
        T.StructField("similarity", T.StringType(), False),
    ]
)

# Long form of the whole state, used for inspection and comparison.
STATE_LONG_COLUMNS = ("attribute", "value", "prev_match_id", "match_id", "source", "datetime")
