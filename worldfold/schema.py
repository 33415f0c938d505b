"""The assertion log: columns, vocabularies and the families of attributes."""

from __future__ import annotations

LOG = "seq long, id string, world_id string, entity string, attribute string, value_type string, value string, valid_from double, valid_to double, frame string, status string, confidence double, asserted_at long"
FIELDS = tuple(part.split()[0] for part in LOG.split(", "))

ENTITY_ID = "^[a-z][a-z0-9_]*:[a-z0-9_:]+$"
STATUSES = ("stated", "observed", "inferred", "assumed", "generated", "retracted")
VALUE_TYPES = ("entity", "literal", "unresolved", "delta")
CONTAINMENT = ("in", "within", "held_by", "worn_by", "carried_by")
LATERAL = ("connects_to", "adjacent_to")
SET_VALUED = ("name", "alias", "connects_to", "adjacent_to", "maybe_same_as", "same_as", "distinct_from", "aka")
STRUCTURAL = ("kind", "caused_by", "part_of", *LATERAL, *CONTAINMENT)
META = ("retracts", "source", "resolved_by", "canonicalized_from", "source_valid_from", "correction_proposal", "justified_by", "superseded_by", "world_defining")
NAMES = ("name", "alias")
#: Every containment attribute of an entity folds to one key.
CONTAINED = "__containment__"
#: Evidence rank of a status.
RANKS = {"stated": 3, "observed": 3, "generated": 2, "inferred": 1, "assumed": 0}
DECLARED = ("arity", "relation_family", "fold_policy", "structural")
