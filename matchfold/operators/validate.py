"""Validation of descriptions as a data-quality operator (V1-V9).

Instead of rejecting a whole request on the first failure, every row gets an
``errors`` array of ``struct<path, message>`` (rule order); ``split_valid``
returns the valid and the rejected rows, ``assert_valid`` gives the
all-or-nothing behaviour and raises with the first message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchfold.functions import patterns as P
from matchfold.schema import ATTRIBUTES

# Required keys per mode, JSON-schema property order, length rules.
REQUIRED = {"match": ("id",), "update": ("id", "datetime", "source")}
PROPERTY_ORDER = ("id", "company_name", "companies_house_id", "duns_number", "contact_email", "postcode", "cdms_ref")
MIN_LENGTH_ONE = ("id", "company_name", "duns_number", "postcode", "cdms_ref")
ANY_OF_FIRST = "company_name"  # reported when none of the six attributes is present


class ValidationError(ValueError):
    def __init__(self, message: str, path: str):
        super().__init__(message)
        self.path = path


def quoted(c: Column) -> Column:
    """Python ``repr`` of a string as used in the messages: single quotes, or double
    quotes when the text holds a single quote and no double quote; backslash and
    the common control characters escaped."""
    esc = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for ch, rep in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        esc = F.replace(esc, F.lit(ch), F.lit(rep))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def _err(cond: Column, path: Column, message: Column) -> Column:
    return F.when(cond, F.struct(path.alias("path"), message.alias("message")))


def description_errors(df: DataFrame, mode: str = "match", index_col: str | None = None) -> Column:
    """Column of all rule violations of a row, in rule order."""
    if mode not in REQUIRED:
        raise ValueError(f"mode must be one of {sorted(REQUIRED)}")
    cols = set(df.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in cols else F.lit(None).cast("string")

    idx = F.col(index_col).cast("string") if index_col else F.lit("")
    base = F.concat(F.lit("/descriptions/"), idx) if index_col else F.lit("/descriptions")
    checks = []
    typed = F.coalesce("type_errors.field", F.array().cast("array<string>")) if "type_errors" in cols else None

    def missing(name: str) -> Column:
        """No such key; a key with null or another value that is no text is present (and of the wrong type)."""
        return col(name).isNull() if typed is None else col(name).isNull() & ~F.array_contains(typed, name)

    for name in REQUIRED[mode]:
        checks.append(_err(missing(name), base, F.lit(f"'{name}' is a required property")))
    no_attribute = F.lit(True)
    for name in ATTRIBUTES:
        no_attribute = no_attribute & missing(name)
    checks.append(_err(no_attribute, base, F.lit(f"'{ANY_OF_FIRST}' is a required property")))
    for name in PROPERTY_ORDER:
        c = col(name)
        path = F.concat(base, F.lit(f"/{name}"))
        if name in MIN_LENGTH_ONE:
            checks.append(_err(F.char_length(c) < 1, path, F.concat(quoted(c), F.lit(" is too short"))))
        if name == "companies_house_id":
            n = P.COMPANIES_HOUSE_ID_LENGTH
            checks.append(_err(F.char_length(c) < n, path, F.concat(quoted(c), F.lit(" is too short"))))
            checks.append(_err(F.char_length(c) > n, path, F.concat(quoted(c), F.lit(" is too long"))))
        if name == "contact_email":
            checks.append(
                _err(
                    ~c.rlike(P.EMAIL_PATTERN),
                    path,
                    F.concat(quoted(c), F.lit(f" does not match {P.EMAIL_PATTERN!r}")),
                )
            )
    found = F.filter(F.array(*checks), lambda e: e.isNotNull())
    if "type_errors" in cols:  # V4, as found in the JSON before values became text
        of_type = F.transform(
            F.coalesce("type_errors", F.array().cast("array<struct<field:string,message:string>>")),
            lambda e: F.struct(F.concat(base, F.lit("/"), e["field"]).alias("path"), e["message"].alias("message")),
        )
        found = F.concat(found, of_type)
    return found


def validate_descriptions(df: DataFrame, mode: str = "match", index_col: str | None = None) -> DataFrame:
    """Adds ``errors`` (empty array for a valid row)."""
    return df.withColumn("errors", description_errors(df, mode, index_col))


def split_valid(df: DataFrame, mode: str = "match", index_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    checked = validate_descriptions(df, mode, index_col)
    valid = checked.where(F.size("errors") == 0).drop("errors")
    rejected = checked.where(F.size("errors") > 0)
    return valid, rejected


def assert_valid(df: DataFrame, mode: str = "match", index_col: str | None = None) -> DataFrame:
    """All-or-nothing: raise ``ValidationError`` with the first error, else return df."""
    _, rejected = split_valid(df, mode, index_col)
    position = F.col(index_col) if index_col else F.lit(0)
    first = rejected.agg(F.min(F.struct(position.alias("i"), F.col("errors")[0].alias("e"))).alias("f")).first()["f"]
    if first:
        raise ValidationError(first.e.message, first.e.path)
    return df


def request_errors(rows: DataFrame, request_col: str, mode: str = "match") -> DataFrame:
    """``(request, path, message)``: the one error that rejects a request, for each request that has any.

    ``rows`` are expanded payloads (``expand_payloads``).  The error nearest to the top of the payload
    counts; on a level the rule that one of several properties must be there comes last; then
    the first description and rule (V8)."""
    of_row = validate_descriptions(rows, mode, index_col="_pos")
    where = F.concat(F.lit("/descriptions/"), F.col("_pos").cast("string"))
    one = lambda path, message: F.array(F.struct(path.alias("path"), message.alias("message")))
    errors = (
        F.when(F.col("payload_error").isNotNull(), one(F.lit(""), F.col("payload_error")))
        .when(F.col("_pos").isNull(), F.array().cast("array<struct<path:string,message:string>>"))
        .when(F.col("item_error").isNotNull(), one(where, F.col("item_error")))
        .otherwise(F.col("errors"))
    )
    each = of_row.select(request_col, "_pos", F.posexplode(errors).alias("_rule", "_e")).select(request_col, "_pos", "_rule", "_e.*")
    depth = F.char_length("path") - F.char_length(F.replace("path", F.lit("/"), F.lit("")))
    weak = F.col("message") == F.lit(f"'{ANY_OF_FIRST}' is a required property")
    first = F.min(F.struct(depth.alias("depth"), weak.alias("weak"), "_pos", "_rule", "path", "message")).alias("f")
    return each.groupBy(request_col).agg(first).select(request_col, "f.path", "f.message")
