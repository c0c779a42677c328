"""matchfold: incremental rule-based entity resolution of company records on Spark.

Public API (lazy DataFrames unless stated):

* ``normalise_descriptions(df)``         -- attribute normalisation
* ``validate_descriptions(df, mode)``    -- data-quality check (``errors`` column)
* ``update_mappings(state, batch)``      -- fold a normalised batch into the six mappings
* ``match(state, batch, dnb=False)``     -- read-only cluster lookup
* ``MappingState`` / ``empty_state``     -- the state value
* ``StateStore``                         -- versioned Parquet state
* ``stream_updates``                     -- Structured Streaming driver
* ``resolve``                            -- one request: validate, update and/or match
"""

from matchfold.schema import ATTRIBUTES, DESCRIPTION_SCHEMA, MAPPING_SCHEMA
from matchfold.functions.normalise import normalise_descriptions
from matchfold.operators.validate import assert_valid, split_valid, validate_descriptions
from matchfold.operators.state import MappingState, empty_state
from matchfold.operators.update import update_mappings
from matchfold.operators.match import match
from matchfold.sources.store import StateStore
from matchfold.streaming.stream import stream_updates
from matchfold.plans.api import resolve, resolve_requests

__all__ = [
    "ATTRIBUTES",
    "DESCRIPTION_SCHEMA",
    "MAPPING_SCHEMA",
    "normalise_descriptions",
    "validate_descriptions",
    "split_valid",
    "assert_valid",
    "MappingState",
    "empty_state",
    "update_mappings",
    "match",
    "StateStore",
    "stream_updates",
    "resolve",
    "resolve_requests",
]
