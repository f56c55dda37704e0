"""Problem 9: personal items in free text, replaced by typed placeholders.

A semi-Markov conditional random field: candidate segments get a score from features of the whole span and of its surroundings, text
outside of segments scores nothing, and a dynamic program over the segments' ends finds the best set of segments that don't overlap,
so that boundaries and types are chosen together. Segments are bounded by their form, not by a count of letters: a name has up to
three capitalised words with an initial and a particle, a street up to four words, numbers and mail addresses may be of any length.
Every pair of capitalised words is a candidate name. The weights are trained here, by the likelihood of labelled sentences that a small
grammar of general office prose writes; nothing of the corpus is read for it but the table of known names. How usual a word is, and
whether it is usually written with a capital, comes from a public tokenizer's vocabulary.

Defined results: null and empty texts hold nothing; an item that stands twice in a text comes out once, and every place of it is
replaced; rows stay rows; an empty name table leaves the form of words and the surroundings to tell names; more than MAX_NAMES known
names are refused with an error.
"""

from __future__ import annotations

import base64
import math
import os
import random
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "phone", "id_number", "address", "name")
#: The table of known names is held by every worker; a larger one is refused.
MAX_NAMES = 100_000
VOCABULARY = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# fixed values: words that announce numbers of persons and of things, and words before and after names
PHONE_WORDS = frozenset("tel telephone phone mobile cell cellphone whatsapp fax call ring text dial line direct hotline number t m p f teléfono telefono numéro numero móvil portable téléphone handy telefon rufnummer unter anschluss reach".split())
ID_WORDS = frozenset("ssn social security soc sec passport travel document national identity insurance tax taxpayer nino ni personal licence license driver driving id residence permit citizen dni nie pasaporte ausweisnummer reisepass steuer".split())
ID_TAILS = frozenset("ssn number no nr id document passport nino licence license card dni nie pasaporte reisepass ausweisnummer".split())
THING_WORDS = frozenset("order sku ticket run node build case file invoice version range batch part tracking serial room rank score post entry reference purchase release step item page week sprint budget log line parcel article lot flight bug commit job host port receipt booking model row code shelf barcode isbn meter bestellung rechnung commande facture pedido factura".split())
TITLES = frozenset("mr mrs ms miss dr prof herr frau madame monsieur mme señor señora sr sra sir signora don".split())
GREETINGS = frozenset("dear hi hello hey hola bonjour hallo tag días dias morning liebe lieber cher chère estimado estimada ciao tardes welcome".split())
CLOSINGS = frozenset("best thanks cheers regards grüße grüßen cordialement saludos sincerely gruß saludo atentamente truly you".split())
#: Greetings and titles stand before a name and aren't part of it.
NEVER_FIRST = GREETINGS | TITLES
CUES = NEVER_FIRST | {w.capitalize() for w in NEVER_FIRST} | {w.upper() for w in NEVER_FIRST}
PARTICLES = "van der|van den|van de|von der|de la|de los|van|von|de|del|di|da|du|la|le|el|bin|al"
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Drive|Dr|Boulevard|Blvd|Terrace|Ter|Way|Place|Pl|Square|Sq|Close|Crescent|Highway|Hwy|Parkway|Pkwy|Row|Walk|Hill|Alley|Quay|Wharf|Mews|Grove|Gardens|Park|Circle|Loop|Trail|Bridge|Gate|Green|Rise|View|Path|Bend|Crossing|Esplanade|Parade|Promenade"
STREET_WORDS = frozenset(STREETS.split("|"))
BEFORE_STREET = frozenset("rue avenue boulevard place chemin quai allée impasse cours route Rue Avenue Boulevard Place Chemin Quai Allée Impasse Cours Route".split())
AFTER_STREET = frozenset("calle avenida plaza paseo camino via viale piazza rua carrer Calle Avenida Plaza Paseo Camino Via Viale Piazza Rua Carrer".split())
JOINED = ("straße", "strasse", "str.", "weg", "platz", "gasse", "allee")
APART = frozenset("Straße Strasse Str Weg Platz Gasse Allee Ring Damm Ufer".split())

GAP = r"[^\S\n]+"
UPPER = "[A-ZÀ-ÖØ-ÞĀ-ɏͰ-ЯẀ-ỿ]"
CAP = rf"{UPPER}[^\W\d_]*+"
AT = r"(?:[^\S\n]*(?:@|[(\[{<][^\S\n]*at[^\S\n]*[)\]}>])[^\S\n]*|[^\S\n]+at[^\S\n]+)"
DOT = r"(?:\.|[^\S\n]*[(\[{<][^\S\n]*dot[^\S\n]*[)\]}>][^\S\n]*|[^\S\n]+dot[^\S\n]+)"
MAILLIKE = re.compile(r"(?i)@|[(\[{<][^\S\n]*at\b|\sat[^\S\n]+[\w-]+(?:\.\w|[^\S\n]+dot\b)")
EMAIL = re.compile(rf"(?i)(?<![\w.+%\-])[^\W_][\w.+%\-]*+{AT}[^\W_](?:[^\W_]|-)*+(?:{DOT}[^\W_](?:[^\W_]|-)*+)+")
WINDOW = re.compile(r"[+(]{0,2}\d[\d \t\xa0().\-–/+]{5,}\d")
NUMBER = re.compile(r"(?<![\w@.\-/])(?:\+|\()?\+?\d++(?:\)?[^\S\n]?[.\-–/(]?[^\S\n]?\(?\d++)*+")
CODED = re.compile(r"(?<![\w\-])[A-Z]{2}[^\S\n]?\d\d[^\S\n]?\d\d[^\S\n]?\d\d[^\S\n]?[A-D](?!\w)|(?<![\w\-])(?=[A-Z0-9]*[A-Z])(?=(?:[A-Z]*\d){4})[A-Z0-9]{6,}+(?!\w)|(?<![\w\-])(?:[A-Z]-\d{6,}(?:-[A-Z0-9])?|[A-Z]\d{3}(?:-\d{3,4}){2})(?![\w\-])")
CODELIKE = re.compile(r"[A-Z][ \-]?\d\d|\d\d[A-Z]|[A-Z]\d[A-Z]")
ADDRESSES = [
    re.compile(rf"\d(?<![\w.\-][\s\S])\d{{0,4}}[a-zA-Z]?(?:{GAP}{CAP}){{1,4}}?{GAP}(?:{STREETS})(?!\w)"),
    re.compile(rf"(?i:\d(?<![\w.\-][\s\S])\d{{0,4}}[a-z]?,?{GAP}(?:rue|avenue|boulevard|place|chemin|quai|allée|impasse|cours|route)(?:{GAP}(?:de la|de l['’]|du|des|de|d['’]))?{GAP}?)(?:{CAP})(?:[\- ]{CAP})*"),
    re.compile(rf"(?<!\w)(?i:calle|avenida|plaza|paseo|camino|via|viale|piazza|rua|carrer)(?:{GAP}(?:de la|de los|del|de|da|do))?(?:{GAP}{CAP}){{1,4}},?{GAP}\d{{1,5}}[a-zA-Z]?(?!\w)"),
    re.compile(rf"{UPPER}(?<!\w[\s\S])[^\W\d_]{{2,}}(?i:straße|strasse|str\.|weg|platz|gasse|allee){GAP}?\d{{1,5}}[a-zA-Z]?(?!\w)"),
    re.compile(rf"{UPPER}(?<!\w[\s\S])[^\W\d_]*+{GAP}(?:Straße|Strasse|Str\.|Weg|Platz|Gasse|Allee|Ring|Damm|Ufer){GAP}\d{{1,5}}[a-zA-Z]?(?!\w)"),
]
FAMILY = rf"[^\W\d_]+(?:-[^\W\d_]+|['’](?={UPPER})[^\W\d_]+)*"
# a lookbehind after the first letter lets the search run from one capital to the next
CAPPED = re.compile(rf"(?P<word>{UPPER}(?<![\w@+/][\s\S])[^\W\d_]*+(?:-{CAP})*)(?![\w@])(?:(?=(?:{GAP}(?P<initial>{UPPER})\.?(?={GAP}))?(?P<particle>{GAP}(?i:{PARTICLES})(?={GAP}))?{GAP}(?P<family>(?={UPPER}){FAMILY})(?:{GAP}(?P<third>(?={UPPER}){FAMILY}))?))?")
AFTER = re.compile(rf"(?:{GAP}(?P<initial>[^\W\d_])\.?(?={GAP}))?(?P<particle>{GAP}(?:{PARTICLES})(?={GAP}))?{GAP}(?P<family>[^\W\d_]+(?:-[^\W\d_]+)*)")
WORDS = re.compile(r"[^\W\d_]+")
ALNUM = re.compile(r"\w+")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]")


def plain(word: str) -> str:
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def usual_words(paths: tuple[str, ...] = VOCABULARY) -> tuple[frozenset[str], frozenset[str]]:
    """(usual words, words usually written with a capital) of public byte-level vocabularies, by the better rank of both spellings."""
    best: dict[str, dict[bool, int]] = defaultdict(dict)
    for path in paths:
        for i, row in enumerate(open(path, "rb")):
            word = base64.b64decode(row.split()[0]).decode("utf-8", "ignore")
            if word[:1] == " " and len(word) > 2 and word[1:].isalpha() and word[2:].islower():
                at = best[word[1:].lower()]
                at[word[1].isupper()] = min(i, at.get(word[1].isupper(), i))
    capital = frozenset(w for w, at in best.items() if at.get(True, 1 << 30) < at.get(False, 1 << 30))
    return frozenset(best) - capital, capital


class Gazetteer:
    """Known names, the endings that family names share more than given names do and the other way round, and usual words."""

    def __init__(self, given: list[str], family: list[str], usual: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())):
        self.given = {plain(g) for g in given if g}
        self.family = {plain(f) for f in family if f}
        self.common, self.proper = usual
        count = lambda names, n: Counter(x[-n:] for x in names if len(x) > n)
        least_f, least_g = max(2, len(self.family) // 100), max(2, len(self.given) // 100)
        self.family_ends = {e for n in (3, 4, 5) for e, k in count(self.family, n).items() if k >= least_f}
        self.given_ends = {e for e, k in count(self.given, 2).items() if k >= least_g}
        self.held: dict[str, tuple[str, str, str, str]] = {}

    def of(self, word: str) -> tuple[str, str, str, str]:
        """(as a given name, as a family name, how usual, in lower case) of a word; what is held is bounded."""
        got = self.held.get(word)
        if got is None:
            if len(self.held) > 200_000:
                self.held.clear()
            got = self.held[word] = (self._given(word), self._family(word), self._usual(word), word.lower())
        return got

    def _family(self, word: str) -> str:
        parts = [plain(p) for p in word.split("-")]
        if all(p in self.family for p in parts):
            return "known"
        if any(p in self.family for p in parts) or any(p[-n:] in self.family_ends for p in parts for n in (5, 4, 3) if len(p) > n + 1):
            return "like"
        return "no"

    def _given(self, word: str) -> str:
        p = plain(word)
        return "known" if p in self.given else "like" if p[-2:] in self.given_ends and 4 <= len(p) <= 8 else "no"

    def _usual(self, word: str) -> str:
        low = word.lower()
        if low in self.common or len(low) < 2 or low[-1] == "s" and low[:-1] in self.common:
            return "common"
        return "proper" if low in self.proper else "rare"


def _case(w: str) -> str:
    return "lower" if w.islower() else "upper" if w.isupper() and len(w) > 1 else "title" if w[:1].isupper() else "other"


def _left(text: str, start: int) -> list[str]:
    """Up to four tokens before a place in its line, nearest first, ^ where the line begins."""
    low = max(text.rfind("\n", 0, start) + 1, start - 48)
    toks = TOKEN.findall(text[low:start].lower())
    return [*reversed(toks[-4:]), *["^"] * 4][:4]


def _right(text: str, end: int) -> list[str]:
    cut = text.find("\n", end, end + 30)
    toks = TOKEN.findall(text[end : cut if cut >= 0 else end + 30].lower())
    return [*toks[:3], *["$"] * 3][:3]


def _context(text: str, start: int, end: int) -> tuple[list[str], list[str], list[str]]:
    left, right = _left(text, start), _right(text, end)
    words = [w for w in left if w[:1].isalpha()]
    out = [f"l1={left[0]}", f"r1={right[0]}"]
    out += [f"lw={w}" for w in words[:2]] + [f"r2={right[0]} {right[1]}"]
    return left, right, out


def _number_features(text: str, m: re.Match, s: str) -> list[str]:
    left, right, out = _context(text, m.start(), m.end())
    groups = re.findall(r"\d+", s)
    digits = sum(map(len, groups))
    ahead = WORDS.findall(text[max(text.rfind("\n", 0, m.start()) + 1, m.start() - 30) : m.start()].lower())[-4:]
    near, nearest = set(ahead), ahead[-1] if ahead else ""
    sep = "".join(sorted(set(re.sub(r"[\d+]", "", s))))
    shape = "-".join(str(len(g)) for g in groups[:6])
    phonew, idw, idtail, thing = bool(near & PHONE_WORDS), bool(near & ID_WORDS), nearest in ID_TAILS, nearest in THING_WORDS
    out += [
        f"digits={min(digits, 17)}", f"groups={min(len(groups), 6)}", f"shape={shape}", f"sep={sep}", f"plus={s[0] == '+'}", f"paren={'(' in s}", f"zero={groups[0][0] == '0'}", f"zeros={groups[0][:2] == '00'}",
        f"phonew={phonew}", f"idw={idw}", f"idw&tail={idw and idtail}", f"thingw={thing}", f"thing2={bool(near & THING_WORDS)}", f"phonew&thing={phonew}{thing}", f"idtail={idtail}",
        f"start={left[0] in '^|('}", f"lone={left[0] == '^' and right[0] == '$'}", f"seen={phonew}{idw}{thing}", f"sepshape={sep}{min(len(groups), 6)}{min(digits, 17)}", f"lone&shape={left[0] in '^|('}{shape}", f"nolabel={not (phonew or idw or thing)}&plus={s[0] == '+'}&zero={groups[0][0] == '0'}",
    ]
    if len(groups) == 4 and set(sep) == {"."} and all(len(g) <= 3 for g in groups):
        out.append("dotted")
    if re.fullmatch(r"(19|20)\d\d-\d\d-\d\d|\d\d?[./]\d\d?[./](19|20)?\d\d", s):
        out.append("date")
    return out


Span = tuple[int, int, str, list[str]]


class Candidates:
    def __init__(self, names: Gazetteer):
        self.names = names

    def spans(self, text: str) -> list[Span]:
        out: list[Span] = []
        add = lambda a, b, kind, f: out.append((a, b, kind, [f"{kind}|{x}" for x in f]))
        words = set(ALNUM.findall(text))
        if MAILLIKE.search(text):
            self._mails(text, add)
        for window in WINDOW.finditer(text):
            self._numbers(text, window, add)
        for m in CODED.finditer(text) if CODELIKE.search(text) else ():
            f = _number_features(text, m, m.group())
            shape = re.sub("[A-Z]", "A", re.sub(r"[0-9]", "9", m.group()))
            add(m.start(), m.end(), "id_number", ["coded", f"coded={shape}", f"letters={shape.replace('9', '')}", f"coded&thing={next((w for w in _left(text, m.start()) if w.isalpha()), '') in THING_WORDS}", *f])
        if words & STREET_WORDS:
            self._address(text, 0, add)
        if words & BEFORE_STREET:
            self._address(text, 1, add)
        if words & AFTER_STREET:
            self._address(text, 2, add)
        if any(x in text for x in JOINED):
            self._address(text, 3, add)
        if words & APART:
            self._address(text, 4, add)
        self._names(text, words, add)
        return out

    def _mails(self, text: str, add) -> None:
        for m in EMAIL.finditer(text):
            _, right, f = _context(text, m.start(), m.end())
            low = m.group().lower()
            how = "@" if "@" in low else "wrapped" if re.search(r"[(\[{<]\s*at", low) else "at"
            dot = "word" if re.search(r"\bdot\b", low) else "."
            host = re.split(AT, low, maxsplit=1)[-1]
            end = re.split(r"[^\w\-]+", low)[-1]
            add(m.start(), m.end(), "email", [f"how={how}", f"how={how}&dot={dot}", f"picture={end in ('png', 'jpg', 'jpeg', 'gif', 'svg', 'webp', 'pdf')}", f"host={host[:1].isdigit()}", f"alpha={end.isalpha()}", f"slash={right[0] == '/'}", f"short={len(end)}&how={how}", *f[:1]])

    def _numbers(self, text: str, window: re.Match, add) -> None:
        for m in NUMBER.finditer(text, window.start(), window.end()):
            s = m.group()
            if s[0] == "(" and s.count("(") > s.count(")"):
                m = NUMBER.match(text, m.start() + 1, window.end())
                if not m:
                    continue
                s = m.group()
            if sum(c.isdigit() for c in s) < 7 or text[m.end() : m.end() + 1].isalpha() or text[m.end() : m.end() + 1] == "@":
                continue
            f = _number_features(text, m, s)
            add(m.start(), m.end(), "phone", f)
            add(m.start(), m.end(), "id_number", f)

    def _address(self, text: str, form: int, add) -> None:
        for m in ADDRESSES[form].finditer(text):
            _, right, f = _context(text, m.start(), m.end())
            usual = self.names.of(right[0])[2] if right[0].isalpha() else right[0]
            after = text[m.end() + 1 : m.end() + 3] if text[m.end() : m.end() + 1] in " ." else ""
            say = [f"form={form}", f"next={usual}&cap={after[:1].isupper()}", f"words={m.group().count(' ')}", f"word={m.group().rsplit(None, 1)[-1] if form == 0 else form}", *f[:2]]
            add(m.start(), m.end(), "address", say)
            if form == 0 and text[m.end() : m.end() + 1] == "." and re.search(r"(?:St|Blvd|Ave|Rd|Ln|Dr|Ct|Pl|Sq|Hwy|Pkwy|Ter)$", m.group()):
                short = m.group().split()[-1]
                go = "dots" if after[:1] in ".,)" else "ends" if not after.strip() or after[1:2].isupper() or after[:1] == "\n" else "on"
                add(m.start(), m.end() + 1, "address", [f"form={form}", "dotted", f"dotted={short}", f"dot&{go}", *f[:1]])

    def _names(self, text: str, words: set[str], add) -> None:
        g, firsts, found, cued = self.names, set(), [], not CUES.isdisjoint(words)
        for m in CAPPED.finditer(text):
            w, family = m["word"], m["family"]
            given, _, usual, low = g.held.get(w) or g.of(w)
            a = m.start()
            before = text[a - 1 : a] if a else ""
            alone = False
            if family is None and given != "known" and low not in firsts:
                if before in ("", "\n", "\t", "-", "*", ">") or text[a - 2 : a - 1] in ("\n", "-", "*", ">"):
                    alone = text[m.end() : m.end() + 2].rstrip(" \r,!")[:1] in ("", "\n")
                if not alone and not cued:
                    continue
            if not w[0].isupper() or before == "." and text[a - 2 : a - 1].strip() or text[m.end() : m.end() + 1] == "_":
                continue
            if family and len(family) > 1 and len(w) > 1 and family[0].isupper() and not (given != "known" and low in NEVER_FIRST):
                _, kin, rank, _ = g.of(family)
                found.append((a, m.end("family"), w, family, m["initial"], m["particle"], None))
                if m["third"] and not m["initial"] and m["third"][0].isupper():
                    found.append((a, m.end("third"), w, m["third"], None, m["particle"], family))
                if (given != "no" or usual != "common") and (kin != "no" or rank != "common"):
                    firsts.add(low)
            if len(w) < 2:
                continue
            if given != "known" and low not in firsts and not alone:
                if not cued:
                    continue
                last = text[max(text.rfind("\n", 0, a) + 1, a - 24) : a].rstrip(" \t.").rsplit(" ", 1)[-1].lower()
                if last not in NEVER_FIRST:
                    continue
            found.append((a, m.end(), w, None, None, None, None))
        odd = words - g.common - g.proper
        for w in [w for w in odd | (words & g.given) if w.islower() and w.isalpha() and g.of(w)[0] != "no"]:
            a = text.find(w)
            while a >= 0:
                end = a + len(w)
                tail = AFTER.match(text, end) if not (text[a - 1 : a].isalnum() and a or text[end : end + 1].isalnum()) else None
                if tail and tail["family"].islower() and len(tail["family"]) > 1:
                    (given, _, usual, low), (_, kin, rank, _) = g.of(w), g.of(tail["family"])
                    if kin != "no" and (given == "known" or kin == "known" or usual == rank == "rare"):
                        found.append((a, tail.end(), w, tail["family"], tail["initial"], tail["particle"], None))
                a = text.find(w, end)
        for a, b, w, family, initial, particle, middle in found:
            given, _, usual, low = g.of(w)
            left, right = _left(text, a), _right(text, b)
            case = _case(w)
            line = text.rfind("\n", 0, a)
            title = left[0] in TITLES or (left[0] == "." and left[1] in TITLES)
            ahead = text[max(0, line - 40) : line].rsplit("\n", 1)[-1].strip(" ,\r").lower().split(" ")[-1] if line >= 0 and left[0] == "^" else ""
            cue = "title" if title else "greeting" if left[0] in GREETINGS else "closing" if ahead in CLOSINGS else "line" if left[0] == "^" else "begin" if left[0] in ".!?" else "text"
            whole = left[0] == "^" and right[0] == "$"
            step = text[b : b + 2]
            follow = g.of(right[0])[2] if step[:1] == " " and step[1:].isupper() else "other"
            before = "cap" if a > 1 and text[a - 1] == " " and left[0][:1].isalpha() and text[a - 1 - len(left[0]) : a - len(left[0])].isupper() else "no"
            f = ["bias", f"cue={cue}", f"follow={follow}", f"before={before}&cue={cue}", f"whole={whole}", f"l1={left[0]}", f"l2={left[0]} {left[1]}", f"r1={right[0]}", f"r2={right[0]} {right[1]}", f"case={case}"]
            if family is None:
                seen = low in firsts
                stop = right[0] in ",$" or (right[0] in ".!:" and right[1] == "$")
                f = [f"single|{x}" for x in [*f, f"known={given}", f"usual={usual}", f"cue={cue}&known={given}", f"cue={cue}&usual={usual}", f"seen={seen}", f"seen={seen}&known={given}", f"cue={cue}&stop={stop}&known={given}", f"cue={cue}&whole={whole}&known={given}", f"r={right[0]}&known={given}", f"l={left[0]}&known={given}", f"seen={seen}&cue={cue}&r={right[0]}"]]
            else:
                _, kin, rank, _ = g.of(family)
                both = f"{given}{kin}"
                f = [f"full|{x}" for x in [*f, f"both={both}", f"both={both}&case={case}", f"usual={usual}{rank}", f"usual={usual}{rank}&{both}", f"cue={cue}&usual={usual}", f"cue={cue}&both={both}", f"cue={cue}&usual={usual}{rank}&both={both}", f"family={_case(family)}{case}", f"initial={initial is not None}", f"particle={particle is not None}&{kin}{rank}", f"third={middle is not None}", f"follow={follow}&kin={kin}", f"follow={follow}&rank={rank}", f"r={right[0]}&kin={kin}", f"l={left[0]}&usual={usual}{rank}"]]
                if usual == "common" and given == "no":
                    f.append(f"full|first={low}")
                if kin == "no":
                    f.append(f"full|last={family.lower()}")
                if middle is not None:
                    f += [f"full|middle={'&'.join(g.of(middle)[:3])}", f"full|three={usual}{g.of(middle)[2]}{rank}"]
                elif follow != "other":
                    f.append(f"full|next={'&'.join(g.of(right[0])[:3])}")
            add(a, b, "name", f)


def best(spans: list[Span], score) -> list[Span]:
    """The segments of greatest total score that don't overlap: one pass over their ends."""
    good = sorted(((b, a, i) for i, (a, b, _, _) in enumerate(spans)), key=lambda x: (x[0], x[1]))
    ends, total, back = [0], [0.0], [(-1, 0)]
    for b, a, i in good:
        s = score(i)
        if s <= 0:
            continue
        at = bisect_right(ends, a) - 1
        if total[at] + s > total[-1]:
            if ends[-1] == b:
                total[-1], back[-1] = total[at] + s, (i, at)
            else:
                ends.append(b)
                total.append(total[at] + s)
                back.append((i, at))
    out, k = [], len(ends) - 1
    while k > 0:
        i, k = back[k]
        out.append(spans[i])
    return out[::-1]


def _marginals(spans: list[Span], scores: list[float]) -> list[float]:
    """Probability of each segment under the field: forward and backward sums over the sorted boundaries."""
    points = sorted({x for a, b, _, _ in spans for x in (a, b)})
    at = {p: i for i, p in enumerate(points)}
    by_end, by_start = defaultdict(list), defaultdict(list)
    for i, (a, b, _, _) in enumerate(spans):
        by_end[at[b]].append((at[a], scores[i]))
        by_start[at[a]].append((at[b], scores[i]))
    add = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
    n = len(points)
    fore, behind = [0.0] * n, [0.0] * n
    for k in range(n):
        fore[k] = add([fore[k - 1] if k else 0.0, *(fore[j] + s for j, s in by_end[k])])
    for k in range(n - 1, -1, -1):
        behind[k] = add([behind[k + 1] if k + 1 < n else 0.0, *(behind[j] + s for j, s in by_start[k])])
    return [math.exp(min(0.0, fore[at[a]] + s + behind[at[b]] - fore[-1])) for (a, b, _, _), s in zip(spans, scores, strict=True)]


def train(sentences: list[tuple[str, set[tuple[int, int, str]]]], names: Gazetteer, epochs: int = 3, seed: int = 1) -> dict[str, float]:
    """Adaptive stochastic gradient of the conditional likelihood, with a small ridge."""
    make, number = Candidates(names), {}
    data = []
    for text, gold in sentences:
        if spans := make.spans(text):
            data.append((spans, [[number.setdefault(f, len(number)) for f in fs] for *_, fs in spans], [(a, b, kind) in gold for a, b, kind, _ in spans]))
    weight, squares = [0.0] * len(number), [1.0] * len(number)
    rng, at = random.Random(seed), weight.__getitem__
    for _ in range(epochs):
        rng.shuffle(data)
        for spans, features, gold in data:
            scores = [sum(map(at, fs)) for fs in features]
            for fs, y, p in zip(features, gold, _marginals(spans, scores), strict=True):
                g = y - p
                if abs(g) > 1e-3:
                    for f in fs:
                        squares[f] += g * g
                        weight[f] += 0.3 * (g - 1e-3 * weight[f]) / math.sqrt(squares[f])
    return {f: weight[i] for f, i in number.items() if abs(weight[i]) > 1e-4}


class Tagger:
    def __init__(self, names: Gazetteer, weights: dict[str, float]):
        self.make, self.weights = Candidates(names), weights

    def items(self, text: str | None) -> list[tuple[int, int, str]]:
        if not text:
            return []
        spans, get = self.make.spans(text), self.weights.get
        return [(a, b, k) for a, b, k, _ in best(spans, lambda i: sum(get(f, 0.0) for f in spans[i][3]))]

    def redact(self, text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, b, k in self.items(text):
            out += [text[at:a], f"[{k.upper()}]"]
            at = b
        return "".join([*out, text[at:]])


def fit(known: DataFrame, sentences: int = 16000, seed: int = 1, vocabulary: tuple[str, ...] = VOCABULARY) -> tuple[Gazetteer, dict[str, float]]:
    """known: (name_part, name_text), a reference table of at most MAX_NAMES rows. sentences: how many labelled ones are written.
    vocabulary: files of public byte-level vocabularies; those that are missing leave words unusual."""
    from tallyforge.llm.pii_grammar import labelled

    rows = known.select("name_part", "name_text").where("name_text IS NOT NULL").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} known names")
    given = sorted(r.name_text for r in rows if r.name_part == "given")
    family = sorted(r.name_text for r in rows if r.name_part == "family")
    names = Gazetteer(given, family, usual_words(tuple(p for p in vocabulary if os.path.exists(p))))
    weights = train(labelled(given, family, sentences, seed), names, seed=seed)
    names.held = {}
    return names, weights


def _tagger(df: DataFrame, known: DataFrame, **how):
    return df.sparkSession.sparkContext.broadcast(fit(known, **how))


def find(df: DataFrame, text: str, id_col: str, known: DataFrame, **how) -> DataFrame:
    """(id, pii_kind, surface): each distinct item of a text."""
    model = _tagger(df, known, **how)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        tagger = Tagger(*model.value)
        for b in batches:
            at, kinds, surfaces = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, s in sorted({(k, t[a:z]) for a, z, k in tagger.items(t)}):
                    at.append(i)
                    kinds.append(k)
                    surfaces.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(surfaces, pa.string())], ["id", "pii_kind", "surface"])

    return df.select(df[id_col].alias("id"), df[text].alias("text")).mapInArrow(run, f"id {kind}, pii_kind string, surface string")


def redact(df: DataFrame, text: str, id_col: str, known: DataFrame, **how) -> DataFrame:
    """(id, text) with placeholders."""
    model = _tagger(df, known, **how)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        tagger = Tagger(*model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tagger.redact(t) for t in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return df.select(df[id_col].alias("id"), df[text].alias("text")).mapInArrow(run, f"id {kind}, text string")
