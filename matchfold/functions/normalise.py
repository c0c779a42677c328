"""Attribute normalisation as built-in column expressions (JVM-side, codegen'd).

Every function takes and returns a ``Column`` so it composes into one projection;
``normalise_descriptions`` applies all of them to a description DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchfold.functions import patterns as P
from matchfold.schema import ATTRIBUTES


#: What a match of the legal-form and of the noise patterns can begin with.  Most positions of a name fail
#: this one test instead of every alternative in turn; it excludes no match.
_LEGAL_START = r"(?=[\s:\[\]()'*&,;\"lt])"
_NOISE_START = r"(?=[\s._(*\-dutil]|.?\d{5})"


def _re(pattern: str, start: str = "") -> Column:
    return F.lit(f"{P.JAVA_FLAGS}{start}(?:{pattern})")


def _fallback_lower(cleaned: Column, raw: Column) -> Column:
    """An empty clean-up result falls back to the raw value; then lower-case.

    ``nullif(cleaned, '')`` would expand to ``if(cleaned = '', null, cleaned)`` and,
    inside the source-dependent CASE, the regex chain would run twice per row
    (no common-subexpression elimination in conditional branches).  Wrapping the
    value in a one-element array and dropping '' references it exactly once."""
    kept = F.try_element_at(F.array_remove(F.array(cleaned), F.lit("")), F.lit(1))
    return F.lower(F.coalesce(kept, raw))


def norm_companies_house_id(c: Column | str = "companies_house_id") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    low = F.lower(c)
    return F.when(low.isin(*P.INVALID_COMPANIES_HOUSE_IDS), F.lit(None).cast("string")).otherwise(low)


def norm_duns_number(c: Column | str = "duns_number") -> Column:
    # Taken as given (not lower-cased).
    return F.col(c) if isinstance(c, str) else c


def norm_name_ch(c: Column | str = "company_name") -> Column:
    """Strict rule: blank out legal forms/punctuation, squeeze dots and blanks."""
    c = F.col(c) if isinstance(c, str) else c
    step = F.regexp_replace(c, _re(P.NAME_LEGAL, _LEGAL_START), F.lit(" "))
    step = F.regexp_replace(step, _re(P.NAME_SQUEEZE), F.lit(""))
    return _fallback_lower(step, c)


def norm_name_general(c: Column | str = "company_name") -> Column:
    """General rule: strict rule plus removal of trailing remarks and noise."""
    c = F.col(c) if isinstance(c, str) else c
    step = F.regexp_replace(c, _re(P.NAME_LEGAL_GENERAL, _LEGAL_START), F.lit(" "))
    step = F.regexp_replace(step, _re(P.NAME_NOISE, _NOISE_START), F.lit(""))
    step = F.regexp_replace(step, _re(P.NAME_SQUEEZE), F.lit(""))
    return _fallback_lower(step, c)


def norm_company_name(name: Column | str = "company_name", source: Column | str = "source") -> Column:
    name = F.col(name) if isinstance(name, str) else name
    source = F.col(source) if isinstance(source, str) else source
    general = source.isNull() | source.startswith(P.GENERAL_NAME_SOURCE_PREFIX)
    return F.when(general, norm_name_general(name)).otherwise(norm_name_ch(name))


def norm_contact_email(c: Column | str = "contact_email") -> Column:
    """Domain part only: second '@'-separated field ('' when there is no '@')."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.split_part(c, F.lit("@"), F.lit(2)))


def norm_cdms_ref(c: Column | str = "cdms_ref") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, F.lit("[^0-9]"), F.lit(""))


def norm_postcode(c: Column | str = "postcode") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.replace(c, F.lit(" "), F.lit("")))


def normalise_descriptions(df: DataFrame) -> DataFrame:
    """One projection: id/source/datetime passed through, six attributes normalised.

    Extra input columns are dropped; missing attribute columns become NULL.
    """
    cols = set(df.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in cols else F.lit(None).cast("string")

    exprs = {
        "companies_house_id": norm_companies_house_id(col("companies_house_id")),
        "duns_number": norm_duns_number(col("duns_number")),
        "company_name": norm_company_name(col("company_name"), col("source")),
        "contact_email": norm_contact_email(col("contact_email")),
        "cdms_ref": norm_cdms_ref(col("cdms_ref")),
        "postcode": norm_postcode(col("postcode")),
    }
    passthrough = [col(c).alias(c) for c in ("id", "source", "datetime")]
    extra = [F.col(c) for c in df.columns if c.startswith("_")]  # internal row keys survive
    return df.select(*passthrough, *[exprs[a].alias(a) for a in ATTRIBUTES], *extra)
