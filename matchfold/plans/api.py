"""One call per request: validate, normalise, optionally update, optionally match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchfold.functions.normalise import normalise_descriptions
from matchfold.operators.match import match
from matchfold.operators.materialise import materialise
from matchfold.operators.state import MappingState
from matchfold.operators.update import update_mappings
from matchfold.operators.validate import assert_valid, request_errors, split_valid
from matchfold.sources.payload import expand_payloads, matches_to_json
from matchfold.sources.store import StateStore

MATCH_MODES = ("none", "match", "dnb")


def check_mode(mode: str) -> str:
    """V9: one match mode; 'match and dnb at once' cannot be expressed."""
    if mode not in MATCH_MODES:
        raise ValueError(f"match mode must be one of {MATCH_MODES}, got {mode!r}")
    return mode


def resolve(
    target: StateStore | MappingState,
    descriptions: DataFrame,
    update: bool = True,
    mode: str = "match",
    on_invalid: str = "fail",
    batch_id: int | None = None,
) -> tuple[StateStore | MappingState, DataFrame | None]:
    """Process one request of raw descriptions.

    ``on_invalid='fail'`` rejects the whole request on the first error (raises
    ``ValidationError``); ``'drop'`` processes the valid rows only.  Returns the
    (new) state -- the store itself when a store is given -- and the match result
    (``None`` for ``mode='none'``).
    """
    check_mode(mode)
    rule_mode = "update" if update else "match"
    if on_invalid == "fail":
        valid = assert_valid(descriptions, rule_mode)
    elif on_invalid == "drop":
        valid, _ = split_valid(descriptions, rule_mode)
    else:
        raise ValueError("on_invalid must be 'fail' or 'drop'")
    batch = normalise_descriptions(valid)
    if isinstance(target, StateStore):
        state = target.update(batch, batch_id=batch_id) if update else target.load()
        out_target: StateStore | MappingState = target
    else:
        state = update_mappings(target, batch) if update else target
        out_target = state
    if mode == "none":
        return out_target, None
    return out_target, match(state, batch, dnb=(mode == "dnb"))


def resolve_requests(
    target: StateStore | MappingState,
    payloads: DataFrame,
    request_col: str = "request",
    text_col: str = "value",
    update: bool = False,
    mode: str = "match",
    batch_id: int | None = None,
) -> tuple[StateStore | MappingState, DataFrame | None, DataFrame]:
    """Process many requests, each a row of JSON text with its own (distinct, non-null) key.

    One broken description rejects its request and no other.  Returns the (new) state, one
    ``(request, json)`` document per accepted request (None for ``mode='none'``) and
    ``(request, path, message)`` of the rejected ones.  With ``update`` the descriptions of all accepted
    requests are folded as one batch.
    """
    check_mode(mode)
    rows = materialise(expand_payloads(payloads, text_col, request_col).withColumnRenamed(request_col, "_request"), "requests")
    rejected = materialise(request_errors(rows, "_request", "update" if update else "match"), "rejected")
    accepted = rows.join(rejected.select("_request"), "_request", "left_anti")
    described = accepted.where(F.col("_pos").isNotNull()).drop("type_errors", "payload_error", "item_error", "_pos")
    batch = normalise_descriptions(described)
    rejects = rejected.withColumnRenamed("_request", request_col)
    if isinstance(target, StateStore):
        state = target.update(batch, batch_id=batch_id) if update else target.load()
        out_target: StateStore | MappingState = target
    else:
        state = update_mappings(target, batch) if update else target
        out_target = state
    if mode == "none":
        return out_target, None, rejects
    found = matches_to_json(match(state, batch, dnb=(mode == "dnb"), request="_request"), "_request")
    # a request of no descriptions has an answer, too
    answers = accepted.select("_request").distinct().join(found, "_request", "left")
    answers = answers.select(F.col("_request").alias(request_col), F.coalesce("json", F.lit('{"matches":[]}')).alias("json"))
    return out_target, answers, rejects
