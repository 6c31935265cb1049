"""Scalar text rules: slugs, redaction, trimming, durations, lists, branches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLUG_LENGTH = 63
# What a slug may hold, and what a credential looks like.
SLUG_OTHER = r"[^a-z0-9_-]+"
SLUG_VALID = r"^[a-z0-9][a-z0-9_-]{0,62}$"
USERINFO = r"(https?://)[^/@\s]+:[^/@\s]+@"
GITHUB_TOKEN = r"\b(?:ghp|gho|ghs|ghu|github_pat)_[A-Za-z0-9_]{20,}\b"
GITLAB_TOKEN = r"\bglpat-[A-Za-z0-9_.-]{10,}\b"


def slugify(text: Column) -> Column:
    """Lower-case id of at most 63 characters, `repo` where nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), SLUG_OTHER, "-"), "-+", "-")
    cut = F.left(F.regexp_replace(dashed, "^[-_]+|[-_]+$", ""), F.lit(SLUG_LENGTH))
    return F.when(cut == "", "repo").otherwise(cut)


def render_slug(template: Column, owner: Column, name: Column, full: Column) -> Column:
    """Fill `{owner}`, `{name}` and `{full}` of a slug template."""
    filled = F.replace(F.replace(F.replace(template, F.lit("{owner}"), owner), F.lit("{name}"), name), F.lit("{full}"), full)
    return slugify(filled)


def typed_slug(text: Column) -> Column:
    """The slug offered while typing: starts with a letter or digit, may be empty."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), SLUG_OTHER, "-"), "-+", "-")
    trimmed = F.regexp_replace(dashed, "^[-_]+|[-_]+$", "")
    return F.left(F.regexp_replace(trimmed, "^[^a-z0-9]+", ""), F.lit(SLUG_LENGTH))


def slug_valid(slug: Column) -> Column:
    return slug.rlike(SLUG_VALID)


def redact(text: Column) -> Column:
    """Hide user info in URLs and provider tokens."""
    text = F.regexp_replace(text, USERINFO, "$1***:***@")
    return F.regexp_replace(F.regexp_replace(text, GITHUB_TOKEN, "***"), GITLAB_TOKEN, "***")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_error(text: Column, length: int) -> Column:
    """Error text without surrounding blanks, cut to `length`; null becomes empty."""
    return F.left(strip(F.coalesce(text, F.lit(""))), F.lit(length))


def parse_duration(text: Column) -> Column:
    """Seconds in `30s`, `5m`, `2h`, `1d` or a bare number; blank is 0."""
    clean = F.lower(strip(text))
    number = F.regexp_extract(clean, "^([0-9]+)", 1).cast("bigint")
    unit = F.regexp_extract(clean, "^[0-9]+(.)$", 1)
    factor = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    return F.when(clean == "", 0).otherwise(number * factor)


def split_list(text: Column, delimiter: str) -> Column:
    """Items of a delimited text, blanks dropped; null is the empty list."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[" + delimiter + "]"), lambda x: x != "")


def effective_branch(override: Column, reported: Column) -> Column:
    """The configured branch, else the provider's, else `main`; blank clears."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(override), filled(reported), F.lit("main"))


def filled(text: Column) -> Column:
    """Whether a nullable setting holds anything."""
    return F.coalesce(text != "", F.lit(False))
