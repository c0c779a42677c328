"""Company descriptions derived from the driver's tables (orders left join part).

The test tables hold no companies, so a deterministic description set is derived
from ``orders`` and ``part``; every order yields one description.  The same text
(with a dialect-specific timestamp) is the DuckDB oracle's input, see
``matchfold.plans.duckdb_sql.DESCRIPTIONS_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The derivation rule of the description fixture (shared with the oracle).
DERIVED_COLUMNS = [
    'CAST(o.o_orderkey AS STRING) AS id',
    "CASE o.o_orderkey % 4 WHEN 0 THEN 'dit.datahub' WHEN 1 THEN 'dit.export-wins' WHEN 2 THEN 'companies_house.companies' ELSE 'dnb.companies.uk' END AS source",
    'timestampadd(MICROSECOND, o.o_orderkey, CAST(o.o_orderdate AS TIMESTAMP_NTZ)) AS datetime',
    "CASE WHEN o.o_custkey % 11 = 0 THEN 'NotRegis' WHEN o.o_orderkey % 3 = 0 THEN concat('AB', lpad(CAST(o.o_custkey AS STRING), CAST(greatest(6, length(CAST(o.o_custkey AS STRING))) AS INT), '0')) END AS companies_house_id",
    "CASE WHEN o.o_orderkey % 4 = 1 THEN concat('D', CAST((o.o_custkey + o.o_orderkey % 2) AS STRING)) END AS duns_number",
    "CASE WHEN o.o_orderkey % 5 <> 4 THEN concat('The ', p.p_name, ' ', CAST(o.o_custkey % 997 AS STRING), CASE o.o_orderkey % 6 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ' LIMITED' WHEN 2 THEN ' (UK) & Co. plc' WHEN 3 THEN ' - duplicate' WHEN 4 THEN ' t/a Shop' ELSE '' END) END AS company_name",
    "CASE WHEN o.o_orderkey % 7 < 3 THEN concat('u', CAST(o.o_orderkey AS STRING), '@C', CAST(o.o_custkey % 800 AS STRING), '.example.com') END AS contact_email",
    "CASE WHEN o.o_orderkey % 8 = 2 THEN concat('ORG-', CAST(o.o_custkey * 7 AS STRING)) END AS cdms_ref",
    "CASE WHEN o.o_orderkey % 2 = 0 THEN concat('SW', CAST(o.o_custkey % 90 AS STRING), ' ', CAST(o.o_custkey % 9 AS STRING), 'RP') END AS postcode",
]
# The timestamp is the one dialect-specific column (Spark form above).
SPARK_DATETIME = DERIVED_COLUMNS[2]

FIRST_BATCH = "o.o_orderkey % 10 < 5"


def derived_descriptions(spark: SparkSession, sf_dir: str, batch: int | None = None) -> DataFrame:
    """Raw (un-normalised) descriptions.  ``batch`` 1/2 selects the two-batch split
    used to exercise updates on existing state; None gives every order."""
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").alias("o")
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_name").alias("p")
    if batch == 1:
        orders = orders.where(F.expr(FIRST_BATCH))
    elif batch == 2:
        orders = orders.where(~F.expr(FIRST_BATCH))
    # merged: a broadcast of a large ``part`` would be built by the driver, and the normalisation that
    # follows would run in as few tasks as the file has row groups
    joined = orders.join(part.hint("merge"), F.col("p.p_partkey") == F.col("o.o_custkey"), "left")
    return joined.select(*[F.expr(e) for e in DERIVED_COLUMNS])


# Flaws put into the derived descriptions, so that every validation rule meets
# rows that break it (shared with the oracle).  ``n`` is the order's key.
FLAWED_COLUMNS = [
    "n",
    "CASE WHEN n % 13 = 0 THEN NULL WHEN n % 17 = 0 THEN '' ELSE id END AS id",
    "CASE WHEN n % 19 = 0 THEN NULL ELSE source END AS source",
    "CASE WHEN n % 23 = 0 THEN NULL ELSE datetime END AS datetime",
    "CASE WHEN n % 9 = 0 THEN substr(companies_house_id, 1, 7) WHEN n % 9 = 3 THEN concat('9', companies_house_id) WHEN n % 18 = 6 THEN concat('a', chr(39), chr(9)) ELSE companies_house_id END AS companies_house_id",
    "CASE WHEN n % 12 = 5 THEN '' ELSE duns_number END AS duns_number",
    "CASE WHEN n % 29 = 0 THEN '' ELSE company_name END AS company_name",
    "CASE WHEN n % 14 = 1 THEN concat('x', chr(39), 'y', chr(34), 'z') WHEN n % 14 = 8 THEN concat('b', chr(92), 's', chr(10)) WHEN n % 21 = 2 THEN 'a@b' ELSE contact_email END AS contact_email",
    "CASE WHEN n % 16 = 2 THEN '' ELSE cdms_ref END AS cdms_ref",
    "CASE WHEN n % 10 = 4 THEN '' ELSE postcode END AS postcode",
]

# Texts that stand for JSON values which are no strings, and where they go.
JSON_MARKS = {"#number": "5", "#true": "true", "#null": "null", "#list": "[1]"}
MARKED_COLUMNS = {
    "company_name": "CASE WHEN n % 31 = 0 THEN '#number' ELSE company_name END",
    "duns_number": "CASE WHEN n % 37 = 0 THEN '#true' ELSE duns_number END",
    "postcode": "CASE WHEN n % 41 = 0 THEN '#null' ELSE postcode END",
    "cdms_ref": "CASE WHEN n % 43 = 0 THEN '#list' ELSE cdms_ref END",
}

# What becomes of a payload's text, by payload_id % 7 (others stay as they are).
BROKEN_PAYLOADS = {
    0: "substr(value, 1, length(value) - 2)",
    1: "'[]'",
    2: "'{\"descriptions\": {}}'",
    3: "'{\"other\": []}'",
    4: "'{\"descriptions\": null}'",
}


def flawed_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived descriptions with flaws, and their key ``n``."""
    return derived_descriptions(spark, sf_dir).withColumn("n", F.col("id").cast("long")).select(*[F.expr(e) for e in FLAWED_COLUMNS])
