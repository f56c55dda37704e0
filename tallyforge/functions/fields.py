"""Derived columns of task, pair and document records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"^[\s\x{1c}-\x{1f}\x{85}\x{a0}]+|[\s\x{1c}-\x{1f}\x{85}\x{a0}]+$"
EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
#: Span of each head-count range.
HEADCOUNT_MIDPOINTS = {"15_to_80": 48, "80_to_200": 140, "200_to_500": 350, "500_to_2000": 1250, "200_plus": 500, "2000_plus": 3000}


def stripped(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, SPACE, "")


def candidate_text(c: Column) -> Column:
    """Subject and body on two lines; a missing struct or field is empty."""
    return stripped(F.concat(F.coalesce(c["subject"], F.lit("")), F.lit("\n"), F.coalesce(c["body"], F.lit(""))))


def input_text(inp: Column) -> Column:
    """Signal line and the contents of the thread, in lower case."""
    turns = F.array_join(F.transform(F.coalesce(inp["prior_thread"], F.array()), lambda t: F.coalesce(t["content"], F.lit(""))), " ")
    return F.lower(stripped(F.concat(F.coalesce(inp["signal_brief"]["signal_line"], F.lit("")), F.lit(" "), turns)))


def family_key(metadata: Column, source_mode: Column) -> Column:
    """Seed task, else the sorted probe ids, else category and mode; one key for splitting and decontamination alike."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    probes = F.array_sort(F.array_compact(F.coalesce(metadata["week10_probe_ids"], F.array())))
    return (
        F.when(blank(metadata["scaled_from_task_id"]) != "", F.concat(F.lit("seed::"), metadata["scaled_from_task_id"]))
        .when(F.size(probes) > 0, F.concat(F.lit("probe::"), F.array_join(probes, "|")))
        .otherwise(F.concat(F.lit("fallback::"), blank(metadata["failure_category"]), F.lit("::"), blank(source_mode)))
    )


def iso_date(c: Column) -> Column:
    """The date of an ISO string; anything else is null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def token_estimate(c: Column) -> Column:
    """A quarter of the length, rounded up; at least one for any text."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("int")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normal_subject(c: Column) -> Column:
    """One reply or forward mark and extra blanks removed, at most 255 characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), r"^(re|fwd)\s*:\s*", ""), r"\s+", " "), F.lit(255))


def stable_key(*parts: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of NUL-terminated parts."""
    return F.left(F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\0"))]), 256), F.lit(24))


def redacted(c: Column) -> Column:
    """Mail addresses, then international numbers; only in texts that have an at sign or begin with a plus."""
    out = F.regexp_replace(F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"), r"\+\d{7,15}", "[phone]")
    return F.when(c.contains("@") | c.startswith("+"), out).otherwise(c)


def english_list(labels: Column) -> Column:
    """a / a and b / a, b, and c."""
    n = F.size(labels)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.element_at(labels, 1))
        .when(n == 2, F.array_join(labels, " and "))
        .otherwise(F.concat(F.array_join(F.slice(labels, 1, n - 1), ", "), F.lit(", and "), F.element_at(labels, -1)))
    )
