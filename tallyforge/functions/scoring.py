"""Rule checks as column builders. Each takes the input, the candidate answer and returns the check's failures; none: it passed.

A registry maps check names to builders, so a rubric's list of names is dispatched inside one projection, without Python code per
row and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.fields import candidate_text, stripped

# fixed values: phrases, hints and openers that the checks look for
BANNED = [
    "world-class", "top talent", "A-players", "rockstar", "ninja", "wizard", "skyrocket", "supercharge", "10x", "I hope this email finds you well", "just following up", "circling back",
    "quick question", "quick chat", "synergize", "synergy", "leverage", "ecosystem", "game-changer", "disruptor", "paradigm shift", "do not miss out", "per my last email",
]
BOOKING_HINTS = ["calendar", "book", "schedule", "cal.com/"]
AFFIRMATIVE = ["we can", "we could", "can cover", "can support", "can deliver", "can start"]
COMMITMENT = ["committed", "limited availability", "not available", "on hold"]
SENIORITY = {"junior": "junior_0_2_yrs", "mid": "mid_2_4_yrs", "senior": "senior_4_plus_yrs"}
FILLER = r"(?i)^(i hope this (email|message|note) finds you|just (wanted|reaching out)|hope you('re| are) (doing )?well|greetings,|dear (sir|madam)|my name is \w+ and i)"
SUPERLATIVE = r"(?i)\b(world[- ]class|best[- ]in[- ]class|top[- ]tier|supercharge|unmatched|unparalleled|industry[- ]leading|cutting[- ]edge|game[- ]changer|revolutionary|transformative)\b"

Check = Callable[[Column, Column], Column]


def _body(out: Column) -> Column:
    return F.coalesce(out["body"], F.lit(""))


def _any(text: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | text.contains(p)
    return hit


def banned_hits(text: Column, phrases: list[str] = BANNED) -> Column:
    """The phrases of the list that stand in the text as whole words; each is looked for only where one pattern for all of them hits."""
    each = F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b{p}\b"), p) for p in phrases]))
    return F.when(text.rlike(rf"(?i)\b(?:{'|'.join(phrases)})\b"), each).otherwise(F.array().cast("array<string>"))


def grounded_tokens(inp: Column, out: Column) -> Column:
    """Distinct tokens of the signal line, long or with a digit, that the body holds as substrings."""
    line, body = F.coalesce(inp["signal_brief"]["signal_line"], F.lit("")), F.lower(_body(out))
    tokens = F.transform(F.regexp_extract_all(line, F.lit(r"[A-Za-z0-9$]+"), F.lit(0)), lambda t: F.lower(t))
    return F.array_distinct(F.filter(tokens, lambda t: ((F.length(t) >= 4) | t.rlike("[0-9]")) & F.contains(body, t)))


def capacity_reason(stacks: Column, request: Column) -> Column:
    """Why a request can't be met, by the first rule that fails; null: it can."""
    held = F.try_element_at(stacks, F.lower(F.trim(request["stack"])))
    available, note = F.coalesce(held["available_engineers"], F.lit(0)), F.lower(F.coalesce(held["note"], F.lit("")))
    level = F.coalesce(request["seniority"], F.lit(""))
    keys = F.create_map(*[F.lit(x) for kv in SENIORITY.items() for x in kv])
    key = F.try_element_at(keys, F.lower(level))
    count = request["requested_count"]
    return (
        F.when(request["stack"].isNull() | count.isNull(), "malformed")
        .when(held.isNull(), "absent")
        .when(_any(note, COMMITMENT), "committed")
        .when(available < count, "count")
        .when((level != "") & key.isNull(), "unknown seniority")
        .when((level != "") & (F.coalesce(F.try_element_at(held["seniority_mix"], key), F.lit(0)) < count), "seniority")
        .when(request["lead_days"].isNotNull() & (F.coalesce(held["time_to_deploy_days"], F.lit(0)) > request["lead_days"]), "lead time")
    )


def banned_phrase_check(inp: Column, out: Column) -> Column:
    return F.transform(banned_hits(candidate_text(out)), lambda p: F.concat(F.lit("banned: "), p))


def signal_grounding_check(inp: Column, out: Column) -> Column:
    """Two distinct tokens are needed; without a signal line nothing is grounded."""
    return F.array_compact(F.array(F.when(F.size(grounded_tokens(inp, out)) < 2, "not grounded")))


def booking_stage_check(inp: Column, out: Column, hints: list[str] = BOOKING_HINTS) -> Column:
    """A firm's own booking address is a further hint that its caller adds."""
    early = F.coalesce(inp["thread_stage"], F.lit("")) != "ready_to_schedule"
    return F.array_compact(F.array(F.when(_any(F.lower(_body(out)), hints) & early, "booking before its stage")))


def bench_capacity_check(inp: Column, out: Column) -> Column:
    """Requests that can't be met although the body affirms their count; malformed requests fail as they are."""
    body, stacks = F.lower(_body(out)), inp["bench_summary"]["stacks"]
    affirms = _any(body, AFFIRMATIVE)

    def failure(r: Column) -> Column:
        reason = capacity_reason(stacks, r)
        said = F.regexp_like(body, F.concat(F.lit(r"\b"), r["requested_count"].cast("string"), F.lit(r"\b"))) & affirms
        return F.when((reason == "malformed") | said, reason)

    some = stacks.isNotNull() & (F.size(F.coalesce(inp["capacity_request"], F.array())) > 0)
    return F.when(some, F.array_compact(F.transform(inp["capacity_request"], failure))).otherwise(F.array().cast("array<string>"))


def format_check(inp: Column, out: Column, subject: int = 60, words: int = 120) -> Column:
    body = _body(out)
    return F.array_compact(
        F.array(
            F.when(F.length(F.coalesce(out["subject"], F.lit(""))) > subject, "subject length"),
            F.when(F.size(F.regexp_extract_all(body, F.lit(r"\S+"), F.lit(0))) > words, "body words"),
            F.when(stripped(body).rlike(FILLER), "filler opener"),
            F.when(body.rlike(SUPERLATIVE), "unsupported superlative"),
        )
    )


CHECKS: dict[str, Check] = {f.__name__: f for f in (banned_phrase_check, signal_grounding_check, booking_stage_check, bench_capacity_check, format_check)}


def score(inp: Column, out: Column, requested: Column, checks: dict[str, Check] = CHECKS) -> Column:
    """struct<passed, total, score, failed>: the requested checks in their order; an unknown one fails; without subject and body
    nothing is checked."""
    passes = {k: F.size(f(inp, out)) == 0 for k, f in checks.items()}

    def one(name: Column) -> Column:
        ok = F.lit(False)
        for k, p in passes.items():
            ok = F.when(name == k, p).otherwise(ok)
        return ok

    names = F.when(out["subject"].isNotNull() & out["body"].isNotNull(), F.coalesce(requested, F.array())).otherwise(F.array().cast("array<string>"))
    failed = F.filter(names, lambda n: ~F.coalesce(one(n), F.lit(False)))
    total, bad = F.size(names), F.size(failed)
    return F.struct((total - bad).alias("passed"), total.alias("total"), F.when(total > 0, F.bround((total - bad) / total, 4)).otherwise(0.0).alias("score"), failed.alias("failed"))
