"""Raw descriptions for tests, by named fields."""

from __future__ import annotations

from datetime import datetime, timedelta

from matchfold.schema import ATTRIBUTES, DESCRIPTION_SCHEMA

START = datetime(2019, 1, 1)
FIELDS = dict(zip(("register", "dnb", "name", "email", "crm", "postcode"), ATTRIBUTES))


def about(at: int | str, **known: str) -> dict:
    """One description, made so many hours after START or at a date."""
    when = START + timedelta(hours=at) if isinstance(at, int) else datetime.fromisoformat(at)
    return {"datetime": when, **{FIELDS[k]: v for k, v in known.items()}}


def descriptions(spark, rows, source="dit.datahub"):
    """A DataFrame of them, with the ids 1, 2, ..."""
    return spark.createDataFrame(
        [(str(i), source, r["datetime"], *[r.get(a) for a in ATTRIBUTES]) for i, r in enumerate(rows, 1)], DESCRIPTION_SCHEMA
    )
