"""Fixed vocabularies: patterns of findings, role words, weak words, words of suppression, and labels."""

from __future__ import annotations

# Fixed values that results depend on, in the order of their numbers or of the alphabet.
PATTERNS = (
    "NOMINAL_BOUNDARY", "DISCRIMINATED_UNION", "CLOSED_FAMILY_DISPATCH", "CONFIG_CONTRACTS", "ABC_TEMPLATE_METHOD", "AUTO_REGISTER_META", "TYPE_LINEAGE", "DUAL_AXIS_RESOLUTION", "VIRTUAL_MEMBERSHIP",
    "DYNAMIC_INTERFACE", "SENTINEL_TYPE_MARKER", "TYPE_NAMESPACE_INJECTION", "BIDIRECTIONAL_LOOKUP", "AUTHORITATIVE_SCHEMA", "STAGED_ORCHESTRATION", "AUTHORITATIVE_CONTEXT", "NOMINAL_STRATEGY_FAMILY",
    "DESCRIPTOR_DERIVED_VIEW", "NOMINAL_INTERFACE_WITNESS", "NOMINAL_WITNESS_CARRIER", "LOCAL_VALUE_AUTHORITY",
)
ROLE_WORDS = ("family", "format", "id", "key", "kind", "mode", "name", "role", "step_id", "token", "type", "value")
WEAK_WORDS = ("kind", "name", "type", "value")
SUPPRESSING_WORDS = ("stop", "stopword", "stopwords", "weak")


def with_plurals(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(sorted({*words, *(f"{w}s" for w in words)}))
