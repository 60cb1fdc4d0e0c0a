"""Regex fact extraction over cleaned text.

Each field is an ordered ladder of patterns where the first pattern that
matches wins — a lazy ``CASE WHEN t RLIKE p1 THEN ... WHEN t RLIKE p2``.
Patterns run in Java regex with ``(?U)`` so ``\\s``/``\\d`` are Unicode-aware
like Python's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    AI_MIN_KEY_FACTS, AI_MIN_TEXT_LENGTH, CLASSIC_LOCATION_PATTERNS, HYBRID_PATTERNS, KEY_VALUE_PATTERNS,
    MISSION_PATTERNS, NO_LOCATION,
)
from ..functions.text import py_strip, title_case

U = "(?U)"


def first_match(text: Column, patterns, strip: bool = True, flags: str = "") -> Column:
    """Group 1 of the first pattern that matches ``text`` (stripped), NULL if
    none matches."""
    expr = None
    for p in patterns:
        rx = U + flags + p
        val = F.regexp_extract(text, rx, 1)
        if strip:
            val = py_strip(val)
        expr = F.when(text.rlike(rx), val) if expr is None else expr.when(text.rlike(rx), val)
    return expr


def _truthy_count(cols) -> Column:
    return sum(F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0) for c in cols)


def hybrid_facts(text, fix_case: bool = False) -> Column:
    """X1+X2: struct(founded, employees, location, mission, industry, ceo,
    confidence) from the hybrid ladders on lower-cased text. The CEO ladder
    needs capitals, so on lower-cased text it never matches (kept, Q1);
    ``fix_case=True`` runs it on the original text instead."""
    t = F.col(text) if isinstance(text, str) else text
    low = F.lower(t)
    founded = first_match(low, HYBRID_PATTERNS["founded"])
    employees = first_match(low, HYBRID_PATTERNS["employees"])
    location = first_match(low, HYBRID_PATTERNS["location"])
    ceo = first_match(t if fix_case else low, HYBRID_PATTERNS["ceo"])
    n = _truthy_count([founded, employees, location, ceo])
    conf = F.when(n >= 3, "high").when(n >= 1, "medium").otherwise("low")
    return F.struct(founded.alias("founded"), employees.alias("employees"),
                    location.alias("location"), F.lit(None).cast("string").alias("mission"),
                    F.lit(None).cast("string").alias("industry"), ceo.alias("ceo"),
                    conf.alias("confidence"))


def split_facts(text) -> Column:
    """founded/employees/location (first pattern each) and the mission
    ladder; confidence "high" iff founded was found, else "medium"."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    founded = first_match(low, HYBRID_PATTERNS["founded"][:1], strip=False)
    employees = first_match(low, HYBRID_PATTERNS["employees"][:1], strip=False)
    location = first_match(low, HYBRID_PATTERNS["location"][:1])
    mission = first_match(low, MISSION_PATTERNS)
    return F.struct(founded.alias("founded"), employees.alias("employees"),
                    location.alias("location"), mission.alias("mission"),
                    F.when(founded.isNotNull(), "high").otherwise("medium").alias("confidence"))


def basic_facts(text) -> Column:
    """founded/employees/location, no confidence."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.struct(first_match(low, HYBRID_PATTERNS["founded"][:1], strip=False).alias("founded"),
                    first_match(low, HYBRID_PATTERNS["employees"][:1], strip=False).alias("employees"),
                    first_match(low, HYBRID_PATTERNS["location"][:1]).alias("location"),
                    F.lit(None).cast("string").alias("mission"))


def classic_location(text) -> Column:
    """Case-insensitive location ladder, default "No location found"."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.coalesce(first_match(t, CLASSIC_LOCATION_PATTERNS, flags="(?i)"), F.lit(NO_LOCATION))


def ai_gate(facts: Column, text, force_ai: bool = False) -> Column:
    """F11 (+Q3 labels): struct(used, reason). AI is used when confidence is
    low, the text is shorter than 500 characters, or fewer than two of
    founded/employees/location were found."""
    t = F.col(text) if isinstance(text, str) else text
    key = _truthy_count([facts["founded"], facts["employees"], facts["location"]])
    low = facts["confidence"] == "low"
    use = F.lit(bool(force_ai)) | low | (F.length(t) < AI_MIN_TEXT_LENGTH) | (key < AI_MIN_KEY_FACTS)
    reason = (F.when(use & low, "Low confidence programmatic results")
              .when(use, "Forced by parameter").otherwise("Programmatic results were sufficient"))
    return F.struct(use.alias("used"), reason.alias("reason"))


def key_values_array(text, k: int = 10, max_key_values: int = 10) -> Column:
    """X5 as one per-row expression: every match of the 11 ordered v4
    patterns on the lower-cased text (pattern order, then match order),
    stripped, longer than one character, Python-title-cased, distinct
    (key, value) keeping the first occurrence, then the first
    ``min(k, max_key_values)`` — ``array<struct<key, value>>``. No explode,
    shuffle or window: the page row carries its own key/values."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)

    def tag_with(key):  # one-argument lambda per pattern (a 2-arg one gets the index)
        return lambda v: F.struct(F.lit(key).alias("key"), py_strip(v).alias("value"))

    parts = [F.transform(F.regexp_extract_all(low, F.lit(U + pat), 1), tag_with(key))
             for pat, key in KEY_VALUE_PATTERNS]
    kept = F.filter(F.flatten(F.array(*parts)), lambda kv: F.length(kv["value"]) > 1)
    titled = F.transform(kept, lambda kv: F.struct(kv["key"].alias("key"), title_case(kv["value"]).alias("value")))
    return F.slice(F.array_distinct(titled), 1, min(k, max_key_values))


def key_values(df: DataFrame, text: str, k: int = 10, max_key_values: int = 10) -> DataFrame:
    """X5 as rows ``(page_id, ord, key, value)``."""
    arr = df.select("page_id", F.posexplode(key_values_array(text, k, max_key_values)).alias("pos", "kv"))
    return arr.select("page_id", (F.col("pos") + 1).cast("int").alias("ord"),
                      F.col("kv.key").alias("key"), F.col("kv.value").alias("value"))
