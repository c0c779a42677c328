from matchfold.sources.fixtures import derived_descriptions, load_table
from matchfold.sources.payload import expand_payloads, match_json, matches_to_json, parse_description_text, parse_payload_text
from matchfold.sources.store import StateStore

__all__ = [
    "derived_descriptions",
    "load_table",
    "expand_payloads",
    "match_json",
    "matches_to_json",
    "parse_description_text",
    "parse_payload_text",
    "StateStore",
]
