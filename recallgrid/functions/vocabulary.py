"""Closed vocabularies of the project's data, and loosely used words with the term each stands for."""

from __future__ import annotations

#: The terms of closed fields.
EVIDENCE = ("explicit", "strong_inference", "weak_inference")
PERSISTENCE = ("transient", "active", "durable", "historical", "archived")
SALIENCE = ("minor", "normal", "important", "critical")
KNOWLEDGE_KINDS = ("knows", "believes", "suspects", "assumes", "uncertain")
OPERATIONS = ("add", "set", "revise", "remove", "transition")
KNOWLEDGE_OPERATIONS = ("add", "revise", "remove")
COMMITMENT_TRANSITIONS = ("made", "active", "kept", "broken", "released", "obsolete", "superseded", "unknown")
THREAD_TRANSITIONS = ("open", "active", "advanced", "resolved", "reopened", "abandoned", "unknown")
DOMAINS = ("general", "relationship", "romantic", "sexual", "family", "social", "physical", "career", "education", "competition", "world", "location", "temporal", "resource", "other")
RELATIONSHIP_DIMENSIONS = (
    "formal_status", "domestic_status", "emotional_closeness", "trust", "current_conflict", "romantic_attraction", "romantic_intent", "sexual_attraction", "sexual_intent", "physical_affection", "romantic_history",
    "sexual_history", "exclusivity", "boundary", "reconciliation",
)
TEMPORAL_KINDS = ("exact", "relative", "approximate", "ordering", "deadline")
LOCATION_KINDS = ("scene", "presence", "residence", "workplace", "destination", "relocation")
REGISTER_KINDS = ("event_result", "amendment", "snapshot", "generic")

TERMS = {
    "thread_transition": THREAD_TRANSITIONS,
    "domain": DOMAINS,
    "temporal_kind": TEMPORAL_KINDS,
    "salience": SALIENCE,
    "knowledge_kind": KNOWLEDGE_KINDS,
    "knowledge_operation": KNOWLEDGE_OPERATIONS,
    "state_operation": OPERATIONS,
    "relationship_operation": OPERATIONS,
    "relationship_dimension": RELATIONSHIP_DIMENSIONS,
    "commitment_transition": COMMITMENT_TRANSITIONS,
    "location_kind": LOCATION_KINDS,
    "persistence": PERSISTENCE,
}

#: Loosely used words by field, and the terms they stand for.
ALIASES = {
    "thread_transition": {"opened": "open", "progressed": "advanced", "completed": "resolved", "closed": "resolved", "still-open": "active", "initiated": "open", "maintained": "active"},
    "domain": {"boundary": "relationship"},
    "temporal_kind": {
        "historical": "relative", "scene_timestamp": "exact", "timestamp": "exact", "elapsed": "relative", "time-marker": "exact", "scene_time": "exact", "scene-time": "exact", "time-of-day": "exact",
    },
    "salience": {"low": "minor", "medium": "normal", "moderate": "normal", "high": "important"},
    "knowledge_kind": {
        "fact": "knows", "confirmed_fact": "knows", "observes": "knows", "interpersonal": "knows", "character": "knows", "assessment": "believes", "character-assessment": "believes", "character_insight": "believes",
        "interpretation": "believes",
    },
    "knowledge_operation": {"confirmed": "add", "learned": "add", "learn": "add", "establish": "add", "established": "add", "formed": "add", "set": "add", "updated": "revise"},
    "state_operation": {"update": "revise", "maintain": "set"},
    "relationship_operation": {"confirm": "set"},
    "relationship_dimension": {},
    "commitment_transition": {
        "open": "active", "opened": "active", "initiated": "made", "advanced": "made", "created": "made", "fulfilled": "kept", "completed": "kept", "satisfied": "kept", "expired": "obsolete", "not_triggered": "obsolete",
        "pending": "active", "unresolved": "active",
    },
    "location_kind": {
        "travel_route": "scene", "origin_point": "scene", "arrival_point": "scene", "indoor": "scene", "interior": "scene", "estate": "scene", "primary": "scene", "room": "scene", "transit": "scene", "prior-scene": "scene",
        "present": "presence",
    },
    "persistence": {
        "session": "active", "current": "active", "pending": "active", "permanent": "durable", "persistent": "durable", "scene": "transient", "ephemeral": "transient", "temporary": "transient",
    },
}

#: Further words that only some providers' outputs use.
PROVIDER_ALIASES = {
    "knowledge_kind": {"observation": "knows"},
    "knowledge_operation": {"update": "revise", "maintain": "revise", "observe": "add"},
    "state_operation": {"increase": "revise", "decrease": "revise", "increment": "revise", "decrement": "revise", "persist": "set", "preserve": "set"},
    "relationship_dimension": {"physical_comfort": "physical_affection", "rapport": "emotional_closeness", "mutual respect": "trust", "recognition": "trust"},
    "relationship_operation": {"established": "set"},
    "temporal_kind": {"timer": "exact"},
    "location_kind": {"sublocation": "scene", "referenced": "scene"},
    "persistence": {"stable": "durable", "episodic": "transient", "situational": "transient", "ongoing": "active"},
}

#: Words too common to search for.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "for", "from", "had", "has", "have", "he", "her", "him", "his", "i", "if", "in", "is", "it", "me", "my", "of", "on", "or", "our", "she", "so", "that", "the",
    "their", "them", "they", "this", "to", "was", "we", "were", "what", "when", "where", "who", "why", "with", "you", "your",
)


def aliases(field: str, provider: bool = True) -> dict[str, str]:
    """The words that stand for a term of the field, with those of some providers only on request."""
    return ALIASES[field] | (PROVIDER_ALIASES.get(field, {}) if provider else {})
