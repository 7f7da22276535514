"""Personal information in free text: overlapping candidate spans, boosted trees on format and context, redaction.

High-recall generators propose spans of each kind; trees, one set per kind, score them from their format, their
neighbours and how common their words are over all texts; spans above the calibrated threshold are kept, the
likelier and longer first where they overlap. The trees are fitted on examples written by ``pii_examples`` (no
labelled texts exist), the word statistics come from all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlode.llm.boosting import BoostedTrees
from memlode.llm.given_names import full_names, plain
from memlode.runtime import kept

KINDS = ("email", "phone", "id_number", "address", "name")
# Addresses of long numbers or many words have trees of their own; and the kind that each set of trees stands for.
LONG = len(KINDS)
STANDS_FOR = (*range(len(KINDS)), 3)
PLACEHOLDERS = {kind: f"[{kind.upper()}]" for kind in KINDS}

# Fixed values, from general knowledge: words before a number that say what it is, or that it is something else.
PHONE_CUES = {"phone", "call", "text", "mobile", "tel", "telephone", "cell", "reach", "fax", "ring", "dial", "sms", "whatsapp", "landline", "hotline", "voicemail", "clinic", "office", "back"}
ID_CUES = {"ssn", "social", "security", "tax", "id", "steuernummer", "dni", "nif", "nie", "passport", "licence", "license", "insurance", "identity", "national", "steuer", "tin", "ausweis", "permit"}
OTHER_CUES = {"article", "batch", "budget", "bug", "build", "case", "chapter", "code", "cost", "file", "flight", "invoice", "isbn", "issue", "item", "job", "log", "lot", "model", "note", "number", "order", "page", "parcel", "part", "plan", "port", "price", "record", "ref", "reference", "release", "retry", "room", "sample", "score", "section", "serial", "sku", "thread", "ticket", "track", "version", "window"}
# Fixed values, from general knowledge: titles before names, words before names of things, words after names of organisations, events, goods and ideas.
TITLES = {"dr", "mr", "mrs", "ms", "miss", "prof", "professor", "herr", "frau", "sr", "sra", "señor", "señora", "mme", "monsieur", "madame", "sir", "dame", "captain", "judge", "sister", "father"}
THING_CUES = {"agent", "app", "book", "brand", "café", "cafe", "channel", "company", "cup", "film", "firm", "game", "hotel", "named", "product", "project", "release", "restaurant", "ship", "song", "tag", "team"}
ORG_WORDS = {
    "academy", "agency", "airlines", "airways", "app", "associates", "assoc", "association", "aviation", "award", "bakery", "bank", "band", "books", "brothers", "bros", "camp", "case", "challenge", "championship", "clinic", "club", "co", "college", "committee", "company", "concert", "conference", "construction", "constr", "consulting", "corp", "corporation", "council", "cup", "department", "electronics",
    "energy", "engineering", "eng", "exhibition", "fair", "festival", "foods", "forum", "foundation", "game", "gmbh", "group", "guide", "habit", "holdings", "hospital", "inc", "incorporated", "industries", "institute", "inst", "insurance", "ins", "international", "intl", "kettle", "laboratories", "labs", "law", "league", "library", "limited", "llc", "logistics", "ltd", "machine", "magazine", "manufacturing",
    "marathon", "market", "media", "meetup", "method", "mfg", "ministry", "motors", "museum", "music", "news", "office", "orchestra", "partners", "pharma", "pharmaceuticals", "plc", "press", "principle", "prize", "properties", "publ", "publishing", "records", "report", "restaurant", "school", "services", "society", "software", "solutions", "sons", "square", "studio", "summit", "svcs", "systems", "team", "tech",
    "technologies", "theatre", "theorem", "theory", "thing", "times", "tower", "union", "univ", "university", "works",
}
# Fixed values, from general knowledge: words before a person, prepositions that may stand there, words before places and things, what people do, words in names of places.
PERSON_CUES = {
    "according", "argued", "ask", "asked", "attn", "aunt", "blamed", "boss", "brother", "call", "called", "client", "colleague", "contact", "cousin", "daughter", "dear", "doctor", "emailed", "father", "friend", "heard", "hello", "helped", "hi", "hired", "husband", "interviewed", "introduce", "introduced", "invited", "landlord", "manager", "married", "meet", "met", "mother", "neighbor", "neighbour", "nurse", "owes",
    "partner", "patient", "paid", "phoned", "plumber", "promised", "regards", "remind", "reminded", "saw", "signed", "sister", "son", "spoke", "talked", "teacher", "tell", "tenant", "thank", "thanked", "thanks", "told", "trust", "trusts", "uncle", "visited", "wife", "worked", "works",
}
PERSON_PREPOSITIONS = {"with", "from", "to", "by", "for", "of", "is", "and"}
PARTICLES = {"al", "ben", "bin", "da", "de", "del", "della", "den", "der", "di", "dos", "du", "el", "ibn", "la", "le", "van", "von", "y", "zu"}
THING_LEADS = {"the", "a", "an", "in", "at", "near", "visit", "bought", "buy", "uses", "use", "every", "compare", "through", "via", "on", "into", "inside", "around", "trip", "train", "flight", "sells", "ordered"}
PERSON_VERBS = {"said", "says", "asked", "asks", "told", "tells", "wrote", "writes", "called", "calls", "works", "lives", "lent", "brought", "signed", "picked", "met", "agreed", "thinks", "phoned", "emailed", "joined", "married", "gave", "has", "wants", "likes", "prefers", "who", "moved", "left", "came", "went", "plays", "teaches", "is", "was", "will"}
PLACE_WORDS = {
    "airport", "avenue", "bay", "beach", "bridge", "castle", "church", "city", "coast", "cross", "east", "falls", "fort", "garden", "gate", "harbor", "harbour", "heights", "hill", "hollow", "hotel", "island", "lake", "las", "los", "mount", "mountain", "new", "north", "park", "pier", "point", "port", "quay", "ridge", "river", "road", "saint", "san", "sankt", "santa", "south", "springs", "station", "street", "town", "valley", "village", "west", "wood",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
}
FILE_ENDINGS = {"png", "jpg", "jpeg", "gif", "svg", "webp", "pdf", "md", "txt", "js", "css", "py", "ico"}
STREETS = r"street|st|road|rd|lane|ln|avenue|ave|blvd|boulevard|close|drive|court|ct|terrace|crescent|gardens|row|walk|way|mews|grove|hill"

_WORD = re.compile(r"(?<![^\W_])[^\W\d_](?:[^\W\d_]|[̀-ͯ'’]|-(?=[A-ZÀ-ÖØ-Þ]))*")
_EMAIL = re.compile(r"(?<![\w.+@-])[\w](?:[\w.+'-]*[\w])?(?:@|\s?[(\[]\s?at\s?[)\]]\s?| at (?=[\w-]+\s?[\[(]\s?dot))[\w-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[\w-]+)*", re.I)
_RUN = re.compile(r"[+(]{0,2}(?<![A-Za-z\d_])(?:[A-Za-z]{1,5}[ ]?)?\d[\dA-Za-z]*(?:(?:[ ./-]|\) ?| ?\(|(?<=\)))\(?\d[\dA-Za-z]*\)?)*(?:[ -][A-Za-z]\b(?![\w'’]))?")
# Digits as words, in English, German, Spanish and French.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_SPELLED = re.compile(rf"(?<![^\W_])(?:{'|'.join(_DIGIT_WORDS)})(?:[ ,-]{{1,2}}(?:{'|'.join(_DIGIT_WORDS)})){{5,}}(?![^\W_])", re.I)
_ADDRESSES = tuple(
    re.compile(p, re.I)
    for p in (
        rf"(?:\b(?:flat|apt\.?|apartment|unit|suite)\s+\w{{1,4}},?\s+)?(?<![\w.,:€$£-])\d{{1,4}}[a-z]?,?\s+(?:[^\W\d_]+\s+){{1,2}}(?:{STREETS})\b",
        r"(?:\b(?:flat|apt\.?|apartment|unit|suite)\s+\w{1,4},?\s+)?(?<![\w.,:€$£-])\d{1,4}[a-z]?,?\s+(?:rue|avenue|boulevard|place|chemin|allée)\s+(?:de\s+la\s+|du\s+|des\s+|de\s+l['’]|de\s+|d['’])?[^\W\d_]+",
        r"\b(?:calle|avenida|plaza|paseo|c/|via|viale)\s*(?:de\s+(?:la\s+|los\s+)?)?[^\W\d_]+(?:\s[^\W\d_]+)?,?\s+\d{1,4}\b",
        r"\b[^\W\d_]+(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm)\s+\d{1,4}[a-z]?\b",
        rf"(?:\b(?:flat|apt\.?|apartment|unit|suite)\s+\w{{1,4}},?\s+)?(?<![\w.,:€$£-])\d{{1,6}}[a-z]?,?\s+(?:(?:(?:st|dr|mt|gen|[a-z])\.|[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*|\d{{1,3}}(?:st|nd|rd|th))\s+){{1,5}}?(?:{STREETS})\b",
    )
)
# Words without which an address pattern finds nothing, and ends of words for the fourth.
_STREET_WORDS = (set(STREETS.split("|")), {"rue", "avenue", "boulevard", "place", "chemin", "allée"}, {"calle", "avenida", "plaza", "paseo", "c", "via", "viale"}, set(), set(STREETS.split("|")))
_STREET_ENDS = ("straße", "strasse", "str", "weg", "gasse", "allee", "platz", "ring", "damm")
_TITLE_GAP = re.compile(r"[\s.]*$")


@dataclass
class Words:
    """How often words occur per text, which part of that in lower case, and how many different capitalised words follow them.

    ``follow``: word -> (different capitalised words right after it, times such a word follows, times of these in the
    middle of a sentence), all where the word itself is capitalised. A given name is followed by many different words
    and also in the middle of sentences; a place's name is followed by few, a verb that opens sentences stands at the start.
    """

    rate: dict[str, float]
    lower: dict[str, float]
    follow: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    texts: float = 1.0
    seen: dict[str, tuple] = field(default_factory=dict)

    def facts(self, word: str) -> tuple[float, float, tuple[float, float, float], bool]:
        """``of``, ``of_lower``, ``followed`` and ``rare`` of a word, remembered."""
        known = self.seen.get(word)
        if known is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            known = self.seen[word] = (self.of(word), self.of_lower(word), self.followed(word), self.rare(word))
        return known

    def rare(self, word: str) -> bool:
        """Whether one text in 200 at most has the word in lower case; too few texts can't tell (three over their number bounds the rate of an unseen word)."""
        return self.of_lower(word) <= -2.3 and 3 / self.texts <= 5e-3

    def of(self, word: str) -> float:
        """Logarithm of the rate; whatever is rarer than one in 500 texts counts as unknown."""
        return round(math.log10(max(self.rate.get(word.lower(), 0.0), 2e-3)), 1)

    def of_lower(self, word: str) -> float:
        """The same of lower-case occurrences only."""
        key = word.lower()
        return round(math.log10(max(self.rate.get(key, 0.0) * self.lower.get(key, 0.0), 2e-3)), 1)

    def followed(self, word: str) -> tuple[float, float, float]:
        """(how many different words follow, as a rounded logarithm up to 32; which share of the pairs is different; which share is amid a sentence)."""
        kinds, times, inner = self.follow.get(word.lower(), (0.0, 0.0, 0.0))
        return min(round(math.log2(kinds + 1)), 5), round(kinds / times, 1) if times else -1.0, round(inner / times, 1) if times else -1.0


class NameForms:
    """What a word may be in a name: 1 full or short given name, 3 shortened ('Humb.'), 4 initial, 5 misspelt; 0 nothing."""

    def __init__(self, full: dict[str, set[str]] | None = None):
        known = full_names() if full is None else full
        self.full = set(known)
        self.long = {n for names in known.values() for n in names if len(n) >= 5}
        self.cut = {n[:k] for n in self.long for k in (3, 4, 5)}
        self.near = {v for n in self.long for v in _deletions(n)}
        self.seen: dict[tuple[str, bool], int] = {}

    def kind(self, word: str, dot: bool) -> int:
        known = self.seen.get((word, dot))
        if known is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            known = self.seen[word, dot] = self._kind(plain(word), dot)
        return known

    def _kind(self, key: str, dot: bool) -> int:
        if len(key) == 1:
            return 4
        if dot and key in self.cut:
            return 3
        if key in self.full:
            return 1
        if len(key) >= 4 and (key in self.near or any(v in self.long or v in self.near for v in _deletions(key))):
            return 5
        return 0


def _deletions(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


_CHECK = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed value: check letters of Spanish identity numbers


def _cue(before: list[str]) -> int:
    """The nearest telling word: 1 phone or 2 identity among the last three, 3 something else among the last two, 0 none."""
    for back, word in enumerate(reversed(before[-3:])):
        if word == "number":
            continue
        for code, cues in ((2, ID_CUES), (1, PHONE_CUES), (3, OTHER_CUES)):
            if word in cues and (code != 3 or back < 2):
                return code
    return 3 if "number" in before[-1:] else 0


def _number_features(text: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    groups = re.findall(r"\d+", span)
    digits = sum(map(len, groups))
    marks = re.sub(r"[\w+()]", "", span)
    separator = 0 if not marks else {" ": 1, "-": 2, ".": 3, "/": 4}.get(marks[0], 5) if len(set(marks)) == 1 else 5
    head = re.match(r"[+(]*([A-Za-z]*)", span)[1]
    tail = re.search(r"([A-Za-z]*)\)?$", span)[1]
    letters = sum(c.isalpha() for c in span)
    before = [w.lower() for w in re.findall(r"[^\W\d_]+", text[max(0, start - 28) : start])]
    left, right = text[start - 1 : start], text[end : end + 2]
    joined = 1.0 if left and left in "€$£#_/.-@:\\" and not (left == ":" or left == "/" and text[start - 2 : start - 1] == " ") else 0.0
    after = 1.0 if right[:1] and (right[0] in "_@%" or right[0].isalnum() or right[0] in "-/.,:" and right[1:2].isalnum()) else 0.0
    check = 1.0 if len(groups) == 1 and digits == 8 and len(tail) == 1 and _CHECK[int(groups[0]) % 23] == tail.upper() else 0.0
    sizes = [len(g) for g in groups] + [0, 0, 0]
    zero = 1.0 if groups and groups[0][0] == "0" else 0.0
    close = text.find(")", start) if span[:1] == "(" else -1
    wrapped = 1.0 if span[:2] == "((" or span[:1] == "(" and (close < 0 or close >= end - 1) else 0.0
    return [digits, len(groups), sizes[0], sizes[1], sizes[2], len(groups[-1]) if groups else 0, "+" in span, "(" in span, separator, len(head), len(tail), letters, _cue(before), joined, after, check, len(span), zero, wrapped]


def _caps(word: str) -> float:
    return 2.0 if word.isupper() and len(word) > 1 else 1.0 if word[:1].isupper() else 0.0


def candidates(text: str, words: Words, forms: NameForms) -> list[tuple[int, int, int, list[float]]]:
    """(kind, start, end, features) of every span that might be personal; spans overlap."""
    out: list[tuple[int, int, int, list[float]]] = []
    if "@" in text or "at" in text:
        for m in _EMAIL.finditer(text):
            span = m.group()
            local, _, host = re.split(r"(@|\s?[(\[]\s?at\s?[)\]]\s?| at )", span, maxsplit=1, flags=re.I)
            ending = re.split(r"[.\s\])]+", host.strip())[-1].lower()
            plainly = "@" in span
            dots = len(re.findall(r"\.|dot", host, re.I))
            out.append((0, m.start(), m.end(), [plainly, dots, ending in FILE_ENDINGS, len(ending), ending.isalpha(), len(local), len(host), text[m.end() : m.end() + 1] in ("/", "@")]))
    for m in _RUN.finditer(text):
        start, end = m.span()
        if sum(c.isdigit() for c in m.group()) < 6:
            continue
        # a word before the digits belongs to the run or not: both are proposed
        space = m.group().find(" ")
        head = m.group()[:space] if space > 0 else ""
        starts = [start] if not head.isalpha() else [start + space + 1] if len(head) > 2 else [start, start + space + 1]
        for s in starts:
            for e in {end, end - 2} if re.search(r"[ ][A-Za-z]$", m.group()) else {end}:
                values = _number_features(text, s, e)
                out.append((1, s, e, values))
                out.append((2, s, e, values))
        if m.group()[:2] == "((" or m.group()[:1] == "(":  # brackets around the whole
            s = start + 1
            values = _number_features(text, s, end)
            out.append((1, s, end, values))
            out.append((2, s, end, values))
    tokens = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
    low = [t[0].lower() for t in tokens]
    held = set(low)
    for m in _SPELLED.finditer(text) if sum(w in _DIGIT_WORDS for w in low) >= 6 else ():  # digits as words are judged as the digits they are
        digits = "".join(_DIGIT_WORDS[w] for w in re.findall(r"[^\W\d_]+", m.group().lower()))
        values = _number_features(text[: m.start()] + digits + text[m.end() :], m.start(), m.start() + len(digits))
        out.append((1, *m.span(), values))
        out.append((2, *m.span(), values))
    starts = set()
    for pattern, regex in enumerate(_ADDRESSES):
        if not (any(w.endswith(_STREET_ENDS) for w in held) if pattern == 3 else held & _STREET_WORDS[pattern]):
            continue
        for m in regex.finditer(text):
            if pattern == 4 and m.start() in starts:  # the last pattern is the first one with longer numbers and more words
                continue
            starts.add(m.start())
            inner = [w for w in _WORD.findall(m.group()) if len(w) > 2]
            rarest = min((words.of(w) for w in inner), default=-2.7)
            before = _WORD.findall(text[max(0, m.start() - 20) : m.start()])
            cue = _cue([w.lower() for w in before])
            values = [pattern, rarest, len(inner), len(m.group()), cue == 3, text[m.start() : m.start() + 1].isdigit(), text[m.end() : m.end() + 1] == ":"]
            if pattern == 4:
                values += [len(re.search(r"\d+", m.group())[0]), sum(w[0].isupper() for w in inner) / max(len(inner), 1), max((words.of_lower(w) for w in inner[:-1]), default=-2.7)]
            out.append((LONG if pattern == 4 else 3, m.start(), m.end(), values))
    _names(text, tokens, low, words, forms, out)
    return out


_GAPS = {" ", "  ", ".", ". ", ".  ", "\xa0", "\t"}


def _names(text: str, tokens: list[tuple[str, int, int]], low: list[str], words: Words, forms: NameForms, out: list) -> None:
    """Proposes pairs of words by their form alone; what lists and statistics say of them are features.

    A pair is two words side by side (an initial or particles may stand between) that are both capitalised, or of
    which one is an initial or a cut or listed given name, or that are both rare as words in lower case; also
    'surname, given'.
    """
    if len(tokens) < 2:
        return
    said = [t[0] for t in tokens]
    dots = [text[e : e + 1] == "." for _, _, e in tokens]
    kinds = [forms.kind(w, d) for w, d in zip(said, dots, strict=True)]
    gaps = [text[a[2] : b[1]] for a, b in zip(tokens, tokens[1:])]
    caps = [w[0].isupper() for w in said]

    def add(given: int, surname: int, first: int, last: int, middle: int, comma: bool) -> None:
        word, own = said[surname], said[given]
        if len(word) < 2 or word.islower() and kinds[given] == 4 and len(word) < 4:  # 'I am', 'b is'
            return
        near = first > 0 and _TITLE_GAP.fullmatch(gaps[first - 1]) is not None
        prev = low[first - 1] if near else ""
        before = 1 if prev in TITLES else 2 if prev in THING_CUES else 3 if near and caps[first - 1] and gaps[first - 1] == " " else 0
        close = last + 1 < len(tokens) and gaps[last] in (" ", ".", ". ", " & ", "-")
        after = 0 if not close else 1 if low[last + 1] in ORG_WORDS else 2 if caps[last + 1] and gaps[last][0] != "." else 0
        next_ = words.facts(low[last + 1])[1::-1] if after == 2 else (-9.0, -9.0)
        of_word, of_own = words.facts(low[surname]), words.facts(low[given])
        end = tokens[last][2] + (1 if dots[last] and last == given and kinds[given] in (3, 4) else 0)
        acts = close and gaps[last] == " " and low[last + 1] in PERSON_VERBS
        thing = (low[given] in PLACE_WORDS or low[given] in THING_CUES) + 2 * (low[surname] in PLACE_WORDS or low[surname] in THING_CUES)
        values = [
            kinds[given], given > surname, comma, of_word[0], min(len(word), 9), _caps(word), _caps(own), before, after, of_own[1], min(len(own), 9), dots[given], middle, low[surname] in ORG_WORDS,
            of_word[1], of_own[0], low[given] in ORG_WORDS, thing, cue(first), acts, first > 0 and low[first - 1] in ORG_WORDS, kinds[surname], listed(first, last), *of_own[2], *of_word[2], *next_, low[given] in PERSON_CUES or low[given] in PERSON_VERBS,
        ]
        out.append((4, tokens[first][1], end, values))

    def listed(first: int, last: int) -> bool:
        """Whether the pair stands in a list of given names: 'Robert, Susan and Thomas'."""
        more = last + 2 < len(tokens) and gaps[last] == " " and low[last + 1] in ("and", "or", "und", "y") and gaps[last + 1] == " " and kinds[last + 2] == 1
        return more or first > 0 and gaps[first - 1] == ", " and kinds[first - 1] == 1 or last + 1 < len(tokens) and gaps[last] == ", " and kinds[last + 1] == 1

    def cue(first: int) -> int:
        """What the two words before say: 3 a person follows, 2 a preposition of persons, 1 the sentence opens, -1 a place or thing follows."""
        near = low[first - 1] if first else ""
        gap = gaps[first - 1] if first else ""
        if near in TITLES and _TITLE_GAP.fullmatch(gap):
            return 3
        if not first or len(gap) > 3 or not gap.isspace() and any(c in ".!?\n" for c in gap):
            return 1
        if near in PERSON_CUES:
            return 3
        if near in PERSON_PREPOSITIONS:
            return 3 if first > 1 and low[first - 2] in PERSON_CUES and gaps[first - 2] == " " else 2
        return -1 if near in THING_LEADS or near in THING_CUES else 0

    def shaped(i: int, j: int) -> bool:
        """Two capitalised words, or two words that hardly any text has in lower case."""
        a, b = said[i], said[j]
        if len(a) < 2 or len(b) < 2:
            return False
        if caps[i] and caps[j]:
            return not (a.isupper() and b.isupper() and min(len(a), len(b)) < 4)
        return not caps[i] and not caps[j] and words.facts(low[i])[3] and words.facts(low[j])[3]

    for i, kind in enumerate(kinds):
        if i + 1 < len(tokens) and not kind and low[i] not in PERSON_CUES and low[i] not in TITLES:
            gap = gaps[i]
            if gap in (". ", ".") and caps[i] and caps[i + 1] and 3 <= len(said[i]) <= 5 and not kinds[i + 1]:  # perhaps a given name cut short
                add(i, i + 1, i, i + 1, 0, False)
            if gap in (" ", "  ", "\t", "\xa0", ", "):
                j = i + 1
                if gap == " " and caps[i]:
                    while j < i + 4 and j + 1 < len(tokens) and low[j] in PARTICLES and not caps[j] and gaps[j] == " ":
                        j += 1
                if not kinds[j] and shaped(i, j):
                    add(*((j, i) if gap == ", " else (i, j)), i, j, 0, gap == ", ")
                elif kinds[j] == 4 and j == i + 1 and j + 1 < len(tokens) and gap == " " and gaps[j] in _GAPS and not kinds[j + 1] and shaped(i, j + 1):
                    add(i, j + 1, i, j + 1, 1, False)
        if not kind or kind == 4 and not dots[i] and said[i] in ("a", "e", "i", "o", "y"):  # articles and conjunctions, not initials
            continue
        if i + 1 < len(tokens) and gaps[i] in _GAPS and (gaps[i][0] != "." or kind in (3, 4)):
            j, middle = i + 1, 0
            if kinds[j] == 4 and j + 1 < len(tokens) and gaps[j] in _GAPS:
                j, middle = j + 1, 1
            while caps[i] and middle == 0 and j < i + 4 and j + 1 < len(tokens) and low[j] in PARTICLES and not caps[j] and gaps[j] == " ":
                j += 1
            add(i, j, i, j, middle, False)
            if middle:
                add(i, i + 1, i, i + 1, 0, False)
        if i and (gaps[i - 1] in (", ", ",") or kind != 4 and gaps[i - 1] == " "):
            add(i, i - 1, i - 1, i, 0, "," in gaps[i - 1])


def accepted(found: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) kept of (kind, start, end, probability, above threshold): mail addresses first, names last, likelier and longer before others; none overlapping."""
    kept: list[tuple[int, int, int]] = []
    ranked = sorted((f for f in found if f[4]), key=lambda f: (f[0] != 0, f[0] == 4, -round(f[3], 1), -(f[2] - f[1]), f[1], f[0]))
    for kind, start, end, *_ in ranked:
        if all(end <= s or e <= start for _, s, e in kept):
            kept.append((kind, start, end))
    return sorted(kept, key=lambda k: k[1])


def redact(text: str, spans: Sequence[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its placeholder, everything else unchanged."""
    parts, at = [], 0
    for kind, start, end in spans:
        parts += [text[at:start], PLACEHOLDERS[KINDS[kind]]]
        at = end
    return "".join([*parts, text[at:]])


def find(texts: Sequence[str | None], models: Sequence[BoostedTrees], words: Words, forms: NameForms) -> list[list[tuple[int, int, int]]]:
    """Spans of each text; the candidates of all texts are scored together, kind by kind."""
    proposed = [candidates(t, words, forms) if t else [] for t in texts]
    rows: dict[int, list] = {k: [] for k in range(len(STANDS_FOR))}
    for i, own in enumerate(proposed):
        for kind, start, end, values in own:
            rows[kind].append((i, start, end, values))
    found: list[list] = [[] for _ in texts]
    for kind, own in rows.items():
        if own:
            chance = models[kind].probability(np.array([r[3] for r in own], dtype=float))
            for (i, start, end, _), p in zip(own, chance, strict=True):
                found[i].append((STANDS_FOR[kind], start, end, float(p), p >= models[kind].threshold))
    return [accepted(f) for f in found]


def word_statistics(texts: DataFrame, column: str = "text", rarest: float = 1e-3) -> Words:
    """Rates of the words that at least one in a thousand texts (``rarest``) holds, and what follows capitalised words, over all rows.

    Counts are combined before the shuffle. As a text holds some hundred different words, at most some hundred
    thousand words reach the driver whatever the number of texts; rarer words are unknown words.
    """
    total = max(texts.count(), 1)
    least = max(2, int(total * rarest))
    exploded = texts.select(F.explode(F.split(column, r"[^\p{L}\p{M}]+")).alias("w")).where(F.length("w") > 1)
    counts = exploded.groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("w") == F.lower("w")).alias("low"))
    top = counts.where(F.col("n") >= least).toPandas()
    # runs of capitalised words, with the end of a small word or a comma before them; a word's pairs are it and the next
    runs = F.regexp_extract_all(column, F.lit(r"(?:[\p{Ll},] )?\p{Lu}[\p{L}\p{M}]+(?: \p{Lu}[\p{L}\p{M}]*)+"), F.lit(0))
    inner = F.col("r").rlike(r"^[\p{Ll},] ")
    said = texts.select(F.explode(runs).alias("r")).select(inner.alias("inner"), F.split(F.when(inner, F.substring("r", 3, 1 << 30)).otherwise(F.col("r")), " ").alias("w"))
    pairs = F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("head"), F.slice("w", 2, F.size("w") - 1).alias("tail"))
    flat = said.select("inner", F.posexplode(pairs).alias("at", "p")).where(F.length("p.head") > 1)
    followed = flat.select((F.col("inner") & (F.col("at") == 0)).alias("inner"), "p").groupBy(F.lower("p.head").alias("w"))
    sets = followed.agg(F.approx_count_distinct("p.tail").alias("kinds"), F.count("*").alias("times"), F.count_if("inner").alias("inner")).where(F.col("times") >= least).toPandas()
    return Words(dict(zip(top["w"], top["n"] / total)), dict(zip(top["w"], top["low"] / top["n"])), dict(zip(sets["w"], zip(sets["kinds"].astype(float), sets["times"].astype(float), sets["inner"].astype(float)))), total)


def _mapper(shared, forms: NameForms, each: Callable) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, words = shared.value
        for batch in batches:
            yield each(batch, find([t if isinstance(t, str) else None for t in batch["text"]], models, words, forms))

    return run


def _spans_frame(batch: pd.DataFrame, spans: list) -> pd.DataFrame:
    flat = [(i, KINDS[k], s, e) for i, own in enumerate(spans) for k, s, e in own]
    at = [f[0] for f in flat]
    return pd.DataFrame({"table_name": batch["table_name"].to_numpy(object)[at], "record_id": batch["record_id"].to_numpy(object)[at], "kind": pd.Series([f[1] for f in flat], dtype=object), "start_at": np.array([f[2] for f in flat], dtype=np.int64), "end_at": np.array([f[3] for f in flat], dtype=np.int64)})


def _redacted_frame(batch: pd.DataFrame, spans: list) -> pd.DataFrame:
    return pd.DataFrame({"table_name": batch["table_name"].to_numpy(object), "record_id": batch["record_id"].to_numpy(object), "redacted": np.array([redact(t, own) if isinstance(t, str) else None for t, own in zip(batch["text"], spans, strict=True)], dtype=object), "found": np.array([len(own) for own in spans], dtype=np.int32)})


def _prepared(sources: Sequence[tuple[str, DataFrame]], names: dict[str, set[str]] | None):
    """All texts in one frame (table_name, record_id, text), with the models and word statistics as one broadcast (see ``word_statistics`` for its bound)."""
    from memlode.llm.pii_examples import trained

    texts = kept(reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), "record_id", "text") for name, df in sources]), "texts")
    forms = NameForms(names)
    words = word_statistics(texts.where("text is not null"))
    return texts, texts.sparkSession.sparkContext.broadcast((trained(forms), words)), forms


def personal_spans(sources: Sequence[tuple[str, DataFrame]], names: dict[str, set[str]] | None = None) -> DataFrame:
    """(table_name, record_id, kind, start_at, end_at): every item found, places in code points of the text as given.

    ``sources``: table name and DataFrame (record_id, text) with one row per id. ``names``: given names, lower
    case without accents, as in ``given_names.full_names``. Defined cases: null and empty texts give no row;
    texts are read whole; empty tables give no rows.
    """
    texts, shared, forms = _prepared(sources, names)
    return texts.where("text is not null").mapInPandas(_mapper(shared, forms, _spans_frame), "table_name string, record_id string, kind string, start_at bigint, end_at bigint")


def redacted(sources: Sequence[tuple[str, DataFrame]], names: dict[str, set[str]] | None = None) -> DataFrame:
    """(table_name, record_id, redacted, found): texts with typed placeholders; null texts stay null."""
    texts, shared, forms = _prepared(sources, names)
    return texts.mapInPandas(_mapper(shared, forms, _redacted_frame), "table_name string, record_id string, redacted string, found int")
