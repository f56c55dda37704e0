"""Problem 2: prompt and response pairs whose response is defective.

Each response gets one defect at most, the first that holds of: it says nothing; it repeats its prompt; it declines; it isn't in
the prompt's language; it stops early. Copy, language and termination are checks of the pair itself. Refusals come from clusters:
the sentences of all responses, here called openings, without names and numbers, are sets of five-word shingles; MinHash buckets
propose pairs, which are verified (Jaccard 0.8 or more) and closed into connected components. A cluster is a refusal template if its
wording and its recurrence together speak for it: wording by a small model of declining sentences (refusals), averaged over the cluster's
records; recurrence by how much better its prompts fit a draw from all prompts than a choice of its own, so that what is said to
unrelated prompts alike counts for, and what goes with some kinds of prompt counts against. A record refuses if an opening of it is in a
refusing cluster.

Defined results: a null response says nothing; a null prompt can neither be copied nor set a language; null ids are ignored; of
repeats of an id the smallest texts count; texts are read whole.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.groupsplit import connected
from tallyforge.llm.languages import Languages, trained
from tallyforge.llm.refusals import Wording
from tallyforge.operators.stats import log_gamma
from tallyforge.session import Scratch

COPY_SHARE = 0.72
SHINGLE, NEAR = 5, (4, 5)
#: Sets of fewer shingles are near no other set.
LEAST = 4
#: Bands of minima: a pair at the threshold misses all of them with a chance of 3 in a million.
BANDS, ROWS = 24, 4
KIND_WORDS = 3
#: How much a cluster's own choice of prompts may differ from all prompts, and the bounds of what recurrence may say.
SPREAD, AGAINST, FOR = 2.0, -8.0, 3.0
#: A cluster refuses from these log odds on; those of worse wording than this can't reach them.
REFUSES = 0.5

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
FENCE = re.compile(r"```[\w-]*")
TAG = re.compile(r"</?[a-zA-Z][^<>]{0,40}>")
LABEL = re.compile(r"(?im)^[\s>*#\-|]*(?:subject|verdict|reason|answer|response|output|note|score|rating|re|body|reply)\s*:")
QUOTED = re.compile(r"[\"“«„]([^\"“”«»„]{3,}?)[\"”»“]")
OPEN_QUOTE = re.compile(r"[\"“«„][^\"“”«»„]{3,}$")
SENTENCE = re.compile(r"[^.!?\n。！？]+[.!?。！？]*")

# fixed values: words that fill an answer which says nothing, bare verdicts, and the parts of a mail around its text
FILLERS = frozenset("null none nil n a na nan undefined blank empty no output response answer text content provided available given tbd todo placeholder insert here lorem ipsum void missing unknown error verdict reason subject score note".split())
VERDICTS = frozenset("pass fail yes no true false ok okay accept reject accepted rejected approve approved good bad ja nein oui non sí si".split())
GREETINGS = frozenset("hello hi dear hey there all team hola bonjour hallo guten tag buenos días".split())
CLOSINGS = frozenset("best regards kind thanks cheers sincerely yours grüße viele cordialement saludos thank you mit freundlichen grüßen warm many".split())
LEADING = re.compile(r"(?i)^[\s\]})>,.:;|*#\-]*(?:(?:sure|certainly|of course|okay|question|prompt|task|input|instruction|answer|response)\s*[!:.,]+\s*)*")
TRAILING = re.compile(r"(?i)\s*(?:answer|response|output|reply)\s*:?\s*$")

def unwrapped(response: str) -> tuple[str, bool | None]:
    """(the text inside of fences and JSON, whether the JSON is whole; None: no JSON)."""
    s = FENCE.sub(" ", response).strip()
    at = min((i for i in (s.find("{"), s.find("[")) if i >= 0), default=-1)
    if at < 0 or re.search(r"[^\W_]", s[:at]):
        return response, None
    try:
        value = json.loads(s[at:])
    except ValueError:
        whole = False
        if s[at:] in ("{}", "[]"):
            whole = True
        elif s[at] == "[":
            return response, None
        return " ".join(re.findall(r'"((?:[^"\\]|\\.)*)', s[at:])), whole
    out: list[str] = []

    def walk(v, key=""):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, k)
        elif isinstance(v, list):
            for x in v:
                walk(x)
        elif v is not None and str(v).strip():
            out.append(str(v))

    walk(value)
    return "\n".join(out), True


def words(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("’", "'"))


def is_empty(text: str) -> bool:
    bare = LABEL.sub(" ", TAG.sub(lambda m: " " if not re.search(r"\b(?:no|output|none|null)\b", m.group()) else m.group(), text))
    w = words(bare)
    if len(w) <= 3 and any(x in VERDICTS or x.isdigit() for x in w) and not ("no" in w and len(w) > 1 and all(x in FILLERS for x in w)):
        return False
    return not [x for x in w if x not in FILLERS and x not in GREETINGS and x not in CLOSINGS]


def copy_share(prompt: str, text: str) -> float:
    """Share of the response's four-letter grams that its prompt has; of what stands outside of quotes, where that says something."""
    text = TRAILING.sub("", LEADING.sub("", text))
    outside = QUOTED.sub(" ", text)
    if outside != text and len(words(outside)) >= 6:
        text = outside
    said, asked = " ".join(words(text)), " ".join(words(prompt))
    n = len(said) - 3
    if n < 16:
        return 0.0
    known = set(asked.split(" "))
    mine = said.split(" ")
    if sum(w in known for w in mine) < 0.2 * len(mine):  # so few common words can't make up the share
        return 0.0
    own = {asked[i : i + 4] for i in range(len(asked) - 3)}
    return sum(said[i : i + 4] in own for i in range(n)) / n


#: A response is in another language than its prompt from this much more likelihood on, in all and by word.
OTHER, OTHER_A_WORD = 20.0, 1.0


def in_other_language(told: Languages, prompt: str, text: str) -> bool:
    """Whether a text's likeliest language isn't its prompt's; what it quotes isn't its own."""
    own, _ = told.told(prompt)
    if own is None:
        return False
    bare = OPEN_QUOTE.sub(" ", QUOTED.sub(" ", text))
    if len(words(bare)) < 3:
        bare = text
    top, score = told.told(bare)
    if top is None or top == own:
        return False
    more = score[top] - score.get(own, 0.0)
    return more >= OTHER and more >= OTHER_A_WORD * len(words(bare))


def is_truncated(response: str, json_whole: bool | None) -> bool:
    s = response.strip().strip("​﻿").rstrip()
    if json_whole is False or s.count("```") % 2:
        return True
    if json_whole:
        return False
    lines = [x.strip() for x in s.split("\n") if x.strip()]
    if not lines:
        return False
    last = lines[-1]
    w = words(s)
    if len(w) <= 3 and any(x in VERDICTS or x.isdigit() for x in w) or re.search(r"(?i)\b(?:verdict|answer|rating|result|score)\s*[:=]\s*(?:pass|fail|yes|no|accept\w*|reject\w*|\d+(?:\s*/\s*\d+)?)$", last):
        return False
    if last.startswith("|"):
        cells = [x.count("|") for x in lines if x.startswith("|")]
        return not last.endswith("|") or len(cells) > 1 and cells[-1] < cells[0]
    if re.fullmatch(r"(?:\(?\d+[.)]|[-*•])", last) and len(lines) > 1:
        return True
    straight = s.count('"')
    if straight % 2 or s.count("“") + s.count("„") > s.count("”") + s.count("“") * (s.count("„") > 0) or s.count("«") > s.count("»"):
        return True
    if s.count("(") > s.count(")") or s.count("[") > s.count("]"):
        return True
    if re.search(r"(?:\.\.\.|…)$", last):
        return len(w) > 1
    if re.search(r"[.!?。！？️\U0001F300-\U0001FAFF][\"'”’»)\]*_`]*$", last):
        return False
    if re.search(r"[,;:\-–—(/&]$", last):
        return not (last.endswith(",") and len(words(last)) <= 3 and len(lines) > 1 and words(last) and words(last)[0] in CLOSINGS)
    if len(lines) > 1:
        for back in lines[-4:-1]:
            bw = words(back)
            if bw and len(bw) <= 3 and all(x in CLOSINGS for x in bw) and len(words(last)) <= 6:
                return False
        # items without full stops: the last is whole if it is built as the one before, which isn't a bare verdict
        item = re.compile(r"(?:[-*•]|\d+[.)])\s+(.+)")
        one, two = item.fullmatch(lines[-2]), item.fullmatch(last)
        if one and two and not re.search(r"[.!?]$", one[1]) and not any(x in VERDICTS for x in words(one[1])[-1:]) and (":" in one[1]) <= (":" in two[1]):
            return False
    if re.fullmatch(r"[-*•]?\s*\w{1,12}:\s*(?:pass|fail|yes|no|\d+(?:\s*/\s*\d+)?)", last, re.I):
        return False
    return True


def openings(text: str) -> list[str]:
    """Each sentence once: its words without names and numbers."""
    out: dict[str, None] = {}
    for m in SENTENCE.finditer(QUOTED.sub(" ", text)):
        tokens = WORD.findall(m.group().replace("’", "'"))
        if len(tokens) < 2:
            continue
        kept = [t.lower() for i, t in enumerate(tokens) if (i == 0 or not t[0].isupper() or t in ("I", "I'm", "I'd", "I'll")) and not t[0].isdigit()]
        if len(kept) >= 2:
            out[" ".join(kept)] = None
    return list(out)


def prompt_kind(prompt: str) -> int:
    """What a prompt asks for, told by its first KIND_WORDS words without names and numbers."""
    first = next(iter(openings(prompt)), "").split(" ")
    return xxhash.xxh64_intdigest(" ".join(first[:KIND_WORDS])) >> 1


FEATURES = "record_kind string, record_id long, defect string, foreign boolean, cut boolean, kind long, openings array<string>"


def _features(batches):
    told = trained()
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for prompt, response in zip(b.column("prompt").to_pylist(), b.column("response").to_pylist(), strict=True):
            defect, foreign, cut, said = None, False, False, []
            prompt = prompt or ""
            text, whole = unwrapped(response or "")
            if is_empty(text):
                defect = "empty"
            elif prompt and copy_share(prompt, text) >= COPY_SHARE:
                defect = "copied_prompt"
            else:
                said = openings(text)
                foreign = in_other_language(told, prompt, text)
                cut = is_truncated(response, whole)
            for c, v in zip(cols, (defect, foreign, cut, prompt_kind(prompt), said), strict=True):
                c.append(v)
        kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column("record_kind"), b.column("record_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["record_kind", "record_id", "defect", "foreign", "cut", "kind", "openings"])


def shingles(opening: str) -> set[int]:
    """Hashes of the runs of SHINGLE words; a shorter opening is one run."""
    w = opening.split(" ")
    return {xxhash.xxh64_intdigest(" ".join(w[i : i + SHINGLE])) >> 1 for i in range(max(1, len(w) - SHINGLE + 1))}


def _signed(wording):
    rng = np.random.default_rng(17)
    a = rng.integers(1, 1 << 61, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    c = rng.integers(0, 1 << 61, BANDS * ROWS, dtype=np.uint64)

    def run(batches):
        sounds = wording.value
        for b in batches:
            sets, keys, odds, ids = [], [], [], []
            for o in b.column("opening").to_pylist():
                s = shingles(o)
                sets.append(sorted(s))
                ids.append(xxhash.xxh64_intdigest(repr(sets[-1])) >> 1)
                odds.append(sounds(o))
                if len(s) < LEAST:
                    keys.append([])
                    continue
                v = np.fromiter(s, np.uint64, len(s))
                mixed = v[None, :] * a[:, None] + c[:, None]
                low = (mixed ^ (mixed >> np.uint64(31))).min(axis=1).reshape(BANDS, ROWS)
                keys.append([xxhash.xxh64_intdigest(low[i].tobytes(), seed=i) >> 1 for i in range(BANDS)])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("opening"), pa.array(ids, pa.int64()), pa.array(sets, longs), pa.array(keys, longs), pa.array(odds, pa.float64())], ["opening", "node", "shingles", "keys", "wording"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of the proposed pairs whose sets of shingles are near."""
    p, q = NEAR
    x = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    y = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    shared = F.size(F.array_intersect("su", "sv"))
    return pairs.join(x, "u").join(y, "v").where(q * shared >= p * (F.size("su") + F.size("sv") - shared)).select("u", "v")


def near_links(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): verified links that connect what MinHash buckets hold together. sets: (node, shingles, keys), one row a node.

    In a bucket each node is compared with its smallest. Only nodes that aren't near that one are compared with the bucket's others:
    two nodes near the smallest are connected already, so a bucket of copies with small edits takes one pass and no link is lost.
    """
    entries = scratch.keep(sets.select("node", F.explode("keys").alias("key")))
    lead = entries.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    star = scratch.keep(entries.join(lead, "key").where("node != lead"))
    first = scratch.keep(_verified(star.select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct(), sets))
    apart = star.join(first, (star["node"] == first["u"]) & (star["lead"] == first["v"]), "left_anti")
    others = star.select("key", F.col("node").alias("other"))
    more = apart.join(others, "key").where("node != other").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
    return first.unionByName(_verified(more, sets))


def clusters(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(opening, cluster, wording, n) of every opening: its cluster, the log odds that it declines, and its records."""
    each = found.select("kind", F.explode("openings").alias("opening"))
    seen = scratch.keep(each.groupBy("opening").agg(F.count("*").alias("n")))
    wording = found.sparkSession.sparkContext.broadcast(Wording())
    signed = scratch.keep(seen.select("opening").mapInArrow(_signed(wording), "opening string, node long, shingles array<long>, keys array<long>, wording double"))
    sets = scratch.keep(signed.where("size(keys) > 0").dropDuplicates(["node"]).select("node", "shingles", "keys"))
    roots = connected(near_links(sets, scratch), scratch)
    return signed.join(roots, "node", "left").select("opening", F.coalesce("root", "node").alias("cluster"), "wording").join(seen, "opening")


def recurrence(said: DataFrame, kinds: DataFrame) -> DataFrame:
    """(cluster, recurs): log odds that a cluster's prompts are a draw from all of them against a choice of its own.

    said: (cluster, kind), a row a record; kinds: (kind, share) of all records. The choice is a Dirichlet mixture about the shares.
    """
    n, own = F.col("n"), F.col("share") * SPREAD
    by = said.groupBy("cluster", "kind").agg(F.count("*").cast("double").alias("n")).join(kinds, "kind")
    of = by.groupBy("cluster").agg(F.sum(n * F.log("share") - log_gamma(n + own) + log_gamma(own)).alias("draw"), F.sum("n").alias("n"))
    return of.select("cluster", (F.col("draw") + log_gamma(F.col("n") + SPREAD) - math.lgamma(SPREAD)).alias("recurs"))


def refusal_openings(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(opening) of refusing clusters."""
    of = scratch.keep(clusters(found, scratch))
    sound = of.groupBy("cluster").agg((F.sum(F.col("wording") * F.col("n")) / F.sum("n")).alias("wording")).where(F.col("wording") > REFUSES - FOR)
    open_ = scratch.keep(of.join(sound.select("cluster"), "cluster", "left_semi").select("opening", "cluster"))
    said = found.select("record_kind", "record_id", "kind", F.explode("openings").alias("opening")).join(open_, "opening").select("record_kind", "record_id", "kind", "cluster").distinct()
    total = found.groupBy("kind").agg(F.count("*").alias("m"))
    all_ = found.agg(F.count("*").alias("m")).first().m
    odds = recurrence(said, total.select("kind", (F.col("m") / max(1, all_)).alias("share")))
    refusing = sound.join(odds, "cluster").where(F.col("wording") + F.greatest(F.lit(AGAINST), F.least(F.lit(FOR), F.col("recurs"))) >= REFUSES)
    return open_.join(refusing.select("cluster"), "cluster", "left_semi").select("opening")


def defects(records: DataFrame) -> DataFrame:
    """records: (record_kind, record_id, prompt, response). Returns (record_kind, record_id, defect) of the defective ones."""
    scratch = Scratch(records.sparkSession, "defects")
    one = records.where("record_id IS NOT NULL").groupBy("record_kind", "record_id").agg(F.min("prompt").alias("prompt"), F.min("response").alias("response"))
    found = scratch.keep(one.mapInArrow(_features, FEATURES))
    refusing = refusal_openings(found, scratch)
    first = found.where("defect IS NULL").select("record_kind", "record_id", F.explode("openings").alias("opening"))
    declined = first.join(refusing, "opening", "left_semi").select("record_kind", "record_id", F.lit(True).alias("declined")).distinct()
    named = found.join(declined, ["record_kind", "record_id"], "left")
    defect = F.coalesce("defect", F.when(F.col("declined"), "refusal").when(F.col("foreign"), "other_language").when(F.col("cut"), "truncated"))
    return named.select("record_kind", "record_id", defect.alias("defect")).where("defect IS NOT NULL")


def defect_report(found: DataFrame) -> DataFrame:
    return found.groupBy("record_kind", "defect").agg(F.count("*").alias("records"))
