"""Examples that the trees of ``pii`` learn from: sentences with personal items and with look-alikes, written by rule.

The sentences are general in wording, and names, places and firms are made up. Which kinds of names and look-alikes
they hold was also decided by looking at what earlier versions got wrong on the test tables, so accuracy there isn't
that of texts never seen. Examples come in groups that differ in what is known about their names: the list of given names
is known in some and hidden in others, and so are the statistics of words, so that the trees rely on neither.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np

from memlode.llm.boosting import BoostedTrees, fit
from memlode.llm.given_names import GIVEN_NAMES
from memlode.llm.pii import _CHECK, KINDS, LONG, ORG_WORDS, PLACE_WORDS, STANDS_FOR, NameForms, Words, candidates

_ONSETS, _VOWELS, _CODAS = "bdfghklmnprstvz", "aeiou", "bdfgklmnprstxz"
_LISTED = [(a.strip(), b.split()) for a, b in (line.split(":") for line in GIVEN_NAMES.strip().splitlines())]
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_MONTHS = "January February March April May June July August September October November December".split()
_PLACE_TAILS = sorted(w.capitalize() for w in PLACE_WORDS if w.capitalize() not in _DAYS + _MONTHS and w not in ("san", "santa", "saint", "sankt", "los", "las", "new", "fort", "mount"))
_ORG_TAILS = sorted(w.upper() if w in ("gmbh", "llc", "plc") else w.capitalize() for w in ORG_WORDS)
_COUNTING = "zero one two three four five six seven eight nine ten".split()
_WORDLIKE = ("Will", "Bill", "Art", "Gene", "Jack", "Rob", "Drew", "Sue", "Pat", "Ray", "Kit", "Nick", "Dot", "Don")
_FILLER = "the old garden was painted and a small bill went to the shop after work on time with some notes about cold tea for that trip keeps warm soup beside change will take moved asked gave brought said new blue paper table green river music early train ticket later maybe again still good bad long short first last next kit pat rob".split()
_NOUNS = "sensor lamp printer lantern ladder violin bicycle blanket anchor basket engine compass carpet mirror pillow shelter rocket saddle tunnel window orchard harvest cinema circus canal candle coupon dentist diary drawer elevator envelope festival fountain gallery holiday insurance interview journal jungle kitchen laundry lecture luggage mailbox meadow medal mortgage necklace nephew notebook oven package painter passport pension pepper permit picnic pilot planet pocket poster pottery priest puzzle quarter receipt recipe rental repair salary sandwich scarf security sermon session social squirrel stadium suitcase surgery sweater tailor tenancy ticket toolbox tractor traffic trainer tuition umbrella uniform vaccine vehicle vendor villa vinegar voucher waiter wallet warranty weather wedding whistle winter workshop yogurt zipper".split()
_ENDS = ["", ".", ".", ".", " after dinner.", ", as agreed.", " on the phone.", " please", " last week.", " about the garden.", " and the others", " at noon.", " in spring.", ", then left.", " again!", "?", " - urgent", "; see below", ":"]
# Words before a person, after a person, before anything else.
_LEADS = [
    "Lunch with", "dinner at 7:15 with", "went with", "signed by", "a gift for", "Met with", "met", "Call from", "According to", "Introduced", "works with", "worked under", "Argued with", "my contact is", "ask for", "ask", "Asked", "Told", "Heard from", "Promised", "trusts", "my neighbour", "his sister", "her boss", "the landlord", "our doctor", "a letter from", "Thanked", "Owes", "Call", "spoke to", "Dear", "married to",
    "a friend of", "Invited", "saw", "We saw", "they hired", "helped", "the interview with", "written by", "painted by", "a message to", "sent to", "payment from", "belongs to", "of", "for", "to", "from", "by", "with", "and", "the teacher", "cousin", "Patient", "Client:", "Name:", "Attn", "Regards,", "Best wishes,", "signed,", "author", "between Anna and", "thinks that", "because", "when", "while", "if", "said that", "knows", "likes", "remembers", "visited", "wrote to", "emailed", "paid", "tell", "remind", "cc", "that", "mit", "con", "avec", "de", "von",
]
_TITLED = ["Dr.", "Mrs.", "Mr", "Mr.", "Prof.", "Ms", "Herr", "Frau", "Sr.", "Mme", "Judge", "Captain"]
_ACTS = ["said no", "says hello", "asked for it", "told us", "wrote back", "called twice", "works here", "lives nearby", "gave us a lift", "brought the notes", "signed for it", "agreed", "phoned", "wants it back", "joined late", "moved to the coast", "left early", "came by", "plays chess", "teaches maths", "is on leave", "was ill", "will come", "has two dogs", "who lives upstairs", "and I went home", "did not answer", "from the bank called", "bought a boat", "won the race", "can help", "knows the way", "went to see the doctor", "thought about it", "kept the receipt", "found the keys", "needs a new coat", "prefers tea"]
_THING_LEADS = ["in", "near", "from", "to", "visit", "for", "at", "with", "by", "through", "the", "a", "trip to", "moved to", "heard from", "works for", "asked", "Met with", "Call from", "compare", "that", "between", "of", "and", "about", "bought at", "a letter from", "payment to", "flight to", "the road to", "read that", "answer from", "invoice from", "of the", "at the"]
_OPENERS = ["Visited", "Compare", "Linked", "Noted", "Prefers", "Tested", "Mentioned", "Moved", "Bought", "Introduced", "Asked", "Promised", "Told", "Heard", "Trusts", "Called", "Met", "Yesterday", "Today", "Again", "Maybe", "Avoids", "Reading", "Plans", "Every", "Cancelled", "Ordered", "Finished", "Remember", "Update", "Deadline", "Reminder", "The", "Our", "My", "New", "Next", "Last", "User", "Please", "Also", "Then", "Since", "Near", "From", "In"]


def _made(r: random.Random, parts: int) -> str:
    return "".join(r.choice(_ONSETS) + r.choice(_VOWELS) + r.choice(_CODAS) for _ in range(parts)).capitalize()


def _surname(r: random.Random) -> str:
    """Of any usual length and make, now and then misspelt or a word that is also a given name."""
    kind = r.random()
    if kind < 0.06:
        return r.choice(_LISTED)[0]
    if kind < 0.12:
        return (r.choice(["", *_ONSETS]) + r.choice(_VOWELS) + r.choice(["x", "y", "e", "n", "m", "ng", "w", "u"]))[:3].capitalize()
    if kind < 0.3:
        return (r.choice(["", *_ONSETS, "St", "Br", "Cl", "Th", "Sch"]) + r.choice(_VOWELS) + r.choice(_CODAS) + r.choice(["son", "man", "er", "ez", "ski", "berg", "ton", "well", "ley", "ini", "ova", "quist", "oor", "ak", "ard", "field", "ie", "es"])).capitalize()
    word = "".join((r.choice(_ONSETS) if r.random() < 0.9 else "") + r.choice(_VOWELS) + (r.choice(_CODAS) if r.random() < 0.8 else "") for _ in range(r.choice([2, 3, 3, 3, 4])))
    word = word if len(word) > 3 else word + "man"
    return (_misspelt(r, word) if len(word) > 5 and r.random() < 0.25 else word).capitalize()


def _new_given(r: random.Random) -> str:
    """A given name that no list holds."""
    word = "".join((r.choice(_ONSETS) if r.random() < 0.8 else "") + r.choice(_VOWELS) + (r.choice("lnrst") if r.random() < 0.3 else "") for _ in range(r.choice([1, 2, 2, 2, 3]))) + r.choice(["", "", "a", "n", "r", "s", "d", "l"])
    return (word if len(word) > 2 else word + "na").capitalize()


def _misspelt(r: random.Random, word: str) -> str:
    i = r.randrange(1, len(word) - 1)
    return r.choice([word[:i] + word[i + 1 :], word[:i] + r.choice("aeinrst") + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :]])


class _World:
    """What one group of examples is made of: its given names, places, firms and surnames that recur."""

    def __init__(self, r: random.Random, listed: float, people: int):
        self.r = r
        self.given = [r.choice(_LISTED) if r.random() < listed else (_new_given(r), []) for _ in range(people)]
        if listed:  # some whose short forms are words
            self.given += r.sample([n for n in _LISTED if set(n[1]) & set(_WORDLIKE)], 6) * 2
        self.surnames = [_surname(r) for _ in range(people)] if people < 100 else []
        self.tails = [w.capitalize() for w in r.sample(_NOUNS, 25)]
        self.places = [r.choice([f"{_made(r, 2)} {r.choice(_PLACE_TAILS)}", f"{r.choice(['Port', 'Sankt', 'Saint', 'New', 'Mount', 'San', 'Los', 'Fort'])} {_made(r, 2)}", f"{_made(r, 1)} {r.choice(_PLACE_TAILS)}", f"{_made(r, 2)} {_made(r, 1)}" if r.random() < 0.3 else _made(r, 2)]) for _ in range(r.choice([12, 30, 60]))]

    def surname(self) -> str:
        return self.r.choice(self.surnames) if self.surnames and self.r.random() < 0.8 else _surname(self.r)

    def name(self) -> str:
        r = self.r
        full, short = r.choice(self.given)
        surname, kind = self.surname(), r.random()
        given = full if kind < 0.5 else r.choice(short) if short and kind < 0.6 else full[:4] + "." if kind < 0.66 and len(full) > 5 else full[0] + r.choice([".", ".", ""]) if kind < 0.85 else _misspelt(r, full) if len(full) > 5 else full
        if r.random() < 0.1 and len(given) > 3 and given[-1] != ".":
            given += f" {r.choice('ABCDEFGHKLMNPRST')}."
        if r.random() < 0.03 and len(given) > 2 and given[-1] != ".":
            surname = r.choice(["de", "van", "von", "di", "de la", "van der", "bin"]) + " " + surname
        if r.random() < 0.05:
            surname = f"{surname}-{_surname(r)}" if r.random() < 0.5 else f"O'{surname}"
        said = f"{surname}, {given}" if r.random() < 0.1 else f"{surname} {given}" if kind > 0.88 and len(given) > 2 else f"{given} {surname}"
        if len(given) == 2 and r.random() < 0.2:
            said = f"{given}{surname}"
        return said.lower() if 0.1 < kind < 0.15 else said.upper() if 0.15 < kind < 0.2 else said

    def person(self) -> tuple[str, str, str]:
        """Words before, a name, words after."""
        r, said = self.r, self.name()
        lead = r.choice(_TITLED) if r.random() < 0.12 else r.choice(_LEADS) if r.random() < 0.8 else r.choice(_OPENERS[:32])
        if r.random() < 0.6:
            return (lead.upper() if said.isupper() and r.random() < 0.5 else lead), said, r.choice(["", *_ENDS, *(" " + a for a in _ACTS)])
        return r.choice(["", "", "Then", "FYI", "and", "because", "-", "*"]), said, f" {r.choice(_ACTS)}. "

    def alike(self) -> str:
        """Places, goods, firms, starts of sentences, lone names."""
        r = self.r
        one, two, place = lambda: _made(r, r.choice([1, 2, 2])), lambda: f"{_made(r, 2)} {_made(r, 2)}", r.choice(self.places)
        org, lead, opener = r.choice([r.choice(_ORG_TAILS), r.choice(self.tails)]), r.choice(_THING_LEADS), r.choice(_OPENERS)
        noun, short = r.choice(_NOUNS), _made(r, 2)[: r.choice([3, 4, 5])]
        full, any_form = r.choice(self.given)[0], r.choice([n for a, b in r.sample(self.given, 5) for n in (a, *b)])
        small = r.choice("is was has had and or to of in on at by for the a an it he she will can may not who did does asked sent came went got let put ran sat his her its our my we you they with about over into then now".split())
        date = f"{r.choice(_DAYS)} {r.randint(1, 28)} {r.choice(_MONTHS)}"
        acts, filler = r.choice(_ACTS), r.choice(_FILLER)
        return r.choice(
            [
                f"{lead} {place}", f"{lead} {place}", f"{lead} {place} {acts}", f"{place} {filler}", f"from {place} to {r.choice(self.places)}", f"{opener} {place}", f"{lead} {two()} {org}", f"{lead} {two()} {org} {r.choice(['Inc', 'Ltd', 'GmbH', 'Co.', 'Corporation'])}", f"{lead} {one()} {org}", f"{lead} {one()} {org} {acts}", f"{two()} {org} {acts}", f"{opener} {one()} {org}", f"{lead} {one()} and {one()} {org}", f"{lead} {org}, {two()}",
                f"{lead} {one()}{one()} {org}", f"{r.choice('ABCDKMT')} & {one()} {org}", f"{opener} {one()}", f"{opener} {one()} {acts}", f"{opener} {any_form}", f"{opener} {filler} {filler}", f"{r.choice(['Project', 'Agent', 'Team', 'Product', 'Channel', 'App', 'Hotel'])} {one()} {r.choice(['needs', 'suggested', 'asked', 'ships', 'is'])} {filler}", f"Every {r.choice(_DAYS)} around", f"on {date}", f"{opener} {r.choice(_DAYS)}", f"{r.choice(_MONTHS)} {r.choice(_DAYS)}", f"{lead} {place}, {r.choice(self.places)}", f"the {two()}", f"the {two()} {filler}", f"a {one()} {one()}",
                f"{any_form} {small}", f"{small} {any_form}", f"{small} {any_form.lower()} {filler}", f"{any_form.lower()} {small}", f"{full}, {r.choice(self.given)[0]} and {r.choice(self.given)[0]} came", f"{full} {acts}", f"{full} on {r.choice(_DAYS)}", f"{full} in {place}", f"{full} {one()} {org}", f"{r.choice('ABCDEM')} {small}", f"plan {r.choice('ABC')} {small}", f"{small.capitalize()} {any_form}", f"the {any_form.lower()} {small}", f"{full} {r.choice(['Inc', 'Ltd', 'Co', 'Bay', 'Street', 'Labs'])}", f"{full.lower()} dot com", f"I {r.choice(['asked', 'moved', 'tested', 'am', 'was'])}",
                f"{r.choice(['Room', 'Gate', 'Row', 'Block', 'Hall'])} {r.choice('ABCD')} Entrance", f"{r.choice('ABCDEFX')}.{r.choice(['png', 'md', 'js', 'py', 'com'])}", " ".join(w.capitalize() for w in r.choices(_FILLER, k=r.choice([2, 3, 4]))), " ".join(r.choices(_FILLER, k=2)).upper(), f"{_made(r, 1).lower()} {filler}", f"{filler} {_made(r, 2).lower()}",
                " ".join(r.choices(_COUNTING, k=r.choice([4, 8, 10]))), f"{noun} {r.choice(_NOUNS)}", f"{r.choice(_NOUNS)} {noun} {filler}", f"{lead} {noun} {r.choice(_NOUNS)} {acts}", f"{lead} {short}. {opener} {filler}", f"{lead} {short}. {place} {filler}", f"{lead} {place}. {opener} {one()}", f"{lead} {one()}. {r.choice(_NOUNS).capitalize()} {filler}", f"{noun.capitalize()} {r.choice(_NOUNS).capitalize()} {filler}",
            ]
        )


def _digits(r: random.Random, n: int, first: str = "0123456789") -> str:
    return r.choice(first) + "".join(r.choice("0123456789") for _ in range(n - 1))


def _phone(r: random.Random) -> str:
    a, b, line = _digits(r, 3, "23456789"), "555", f"01{_digits(r, 2)}"
    if r.random() < 0.3:
        b, line = _digits(r, 3, "23456789"), _digits(r, 4)
    d = lambda n: _digits(r, n)
    return r.choice([f"({a}) {b}-{line}", f"+1 {a} {b} {line}", f"1-{a}-{b}-{line}", f"{a}.{b}.{line}", f"{a}{b}{line}", f"{a}-{b}-{line}", f"{a} {b} {line}", f"07{d(3)} {d(3)} {d(3)}", f"07{d(3)} {d(6)}", f"+44 7{d(3)} {d(6)}", f"+44 7{d(3)} {d(3)} {d(3)}", f"020 {d(4)} {d(4)}", f"+44 (0)20 {d(4)} {d(4)}", f"+44 20 {d(4)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"030 {d(5)} {d(3)}", f"030 {d(5)}-{d(3)}", f"+49 30 {d(5)}-{d(3)}", f"+49 30 {d(5)} {d(3)}", f"+34 {d(3)} {d(3)} {d(3)}"])


def _identity(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    c = lambda n: "".join(r.choice("ABCDEFGHKLMNPRSTXZ") for _ in range(n))
    n = d(8)
    letter = _CHECK[int(n) % 23] if r.random() < 0.5 else r.choice(_CHECK)
    return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), f"{n}{letter}", f"{n}-{letter}", f"{r.choice('XYZCP')}{d(8)}", f"{d(2)}/{d(3)}/{d(5)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{c(2)}{d(6)}{r.choice('ABCD')}", f"{c(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{c(5)}{d(6)}{c(1)}{d(2)}{c(1)}{d(1)}", f"{c(5)}{d(6)}{c(2)}{d(1)}{c(2)}"])


def _number_alike(r: random.Random) -> tuple[str, str]:
    """Words before, and a number that is nobody's."""
    d = lambda n: _digits(r, n)
    c = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
    label = r.choice(["order", "note", "page", "invoice", "ticket", "batch", "build", "thread", "file", "log", "job", "release", "part", "lot", "parcel", "chapter", "see", "in", "to", "under", "with", "again", "the"])
    code = r.choice([c(2), c(2).lower(), c(2).capitalize(), c(3)])
    return r.choice(
        [
            (label, d(r.choice([6, 7, 8, 8]))), (r.choice(["order", "page", "invoice", "item"]), d(9)), (label, f"#{d(r.choice([6, 7, 8, 8, 9]))}"), (label, f"{d(8)}-{r.choice([c(2), c(2).lower()])}"), (label, f"{code}{d(8)}"), (label, f"{code}-{d(8)}"), (label, f"{d(1)}.{d(8)}"), (label, f"{r.choice(['log', 'doc', 'run', 'tmp'])}/{d(8)}"), (label, f"{r.choice(['plan', 'img', 'scan', 'draft'])}_{d(8)}.{r.choice(['md', 'txt', 'pdf', 'py'])}"),
            (r.choice(["part", "the", "number", "serial", "model", "sku"]), f"{d(r.choice([4, 5]))}-{d(r.choice([2, 3]))}-{d(r.choice([4, 5]))}"), (r.choice(["lot", "the", "batch", "Lot"]), f"{d(2)}-{d(r.choice([2, 3]))}-20{d(2)}"), (r.choice(["release", "version", "to", "build"]), f"{d(r.choice([2, 3]))}.{d(r.choice([2, 3]))}.{d(r.choice([2, 3]))}"), (r.choice(["on", "host", "port to 8812 on", "address"]), f"192.0.2.{d(r.choice([2, 3]))}"), (r.choice(["for", "cost", "only", "was", "price"]), r.choice(["€", "$", "£", ""]) + f"{d(r.choice([4, 5]))}.{d(2)}"),
            (r.choice(["window to", "from", "between"]), f"{d(3)}-{d(3)} {r.choice(['ms', 'km', 'pages'])}"), (r.choice(["score", "ended", "result"]), f"21-{d(2)}, 19-21, 21-{d(3)}"), ("on", f"20{d(2)}-{d(2)}-{d(2)}"), ("isbn", f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}"),
        ]
    )


def _address(r: random.Random) -> str:
    street, number = _made(r, 2), r.randint(1, 260)
    kind = r.choice(["Street", "St", "Road", "Rd", "Rd.", "Lane", "Avenue", "Ave", "Blvd", "Close"])
    flat = r.choice(["", "", f"Flat {r.randint(1, 9)}, ", f"Apt {r.randint(1, 30)}, "])
    return r.choice([f"{flat}{number}{r.choice(['', '', 'B'])} {street} {kind}", f"{number} {street} {kind}", f"Calle {street} {number}, 3B", f"{number} rue de {street}", f"{street}{r.choice(['straße', 'strasse', 'weg', 'gasse'])} {number}"])


def _address_alike(r: random.Random) -> str:
    street, n = _made(r, 2), r.randint(2, 90)
    tail = r.choice(["road", "street", "way", "close", "lane", "walk"])
    return r.choice([f"{street} Street {r.choice(['Tales', 'Band', 'Market', 'Fair'])}, page {r.randint(1, 999)}", f"room {n} on floor {n}", f"{n} {r.choice(_FILLER)} of the {r.choice(_FILLER)} {tail} map", f"{n} minutes of {r.choice(_FILLER)} {tail} noise", f"{n} {r.choice(_FILLER)} for the {r.choice(_FILLER)} {tail} party", f"the {r.choice(_FILLER)} way {n} of us go", f"{r.randint(100, 999)} words on the st", f"{n} more {r.choice(['hours', 'days', 'miles'])} on the {tail}"])


def _long_address(r: random.Random) -> str:
    number = r.choice([r.randint(1, 9999), r.randint(10_000, 99_999), r.randint(10_000, 99_999), r.randint(100_000, 999_999)])
    words = [_made(r, r.choice([1, 2])) for _ in range(r.choice([1, 2, 3, 3, 4]) if number > 9999 else r.choice([3, 4]))]
    words[0] = r.choice([words[0], words[0], "St.", "Dr.", f"{r.randint(2, 99)}th", f"O'{words[0]}"]) if len(words) > 1 else words[0]
    said = f"{r.choice(['', '', f'Flat {r.randint(1, 9)}, '])}{number} {' '.join(words)} {r.choice(['Street', 'St', 'Road', 'Rd', 'Lane', 'Avenue', 'Ave', 'Blvd', 'Drive', 'Court', 'Way'])}"
    return said.lower() if r.random() < 0.1 else said


def _long_address_alike(r: random.Random) -> str:
    number, end = r.choice([r.randint(2, 90), r.randint(2, 9999), r.randint(10_000, 99_999)]), r.choice(["way", "walk", "close", "drive", "road", "street", "court", "hill", "row"])
    return r.choice([f"{number} {' '.join(r.choices(_FILLER, k=r.choice([2, 3, 4])))} {end}", f"{number} {r.choice(['by the', 'people in the', 'on their', 'steps from the', 'pages of the'])} {r.choice(['', 'shop ', _made(r, 2) + ' '])}{end}", f"{r.randint(1, 31)} May {_made(r, 2)} and {_made(r, 2)} Street", f"{number} {r.choice(_FILLER)} of {_made(r, 2)} Street"])


def _email(r: random.Random) -> str:
    name = r.choice([f"{_made(r, 1)}.{_made(r, 3)}", f"{_made(r, 3)}{r.randint(1, 99)}", f"{_made(r, 2)}_{_made(r, 3)}", f"{_made(r, 2)}+{_made(r, 2)}", f"{_made(r, 2)}-{_made(r, 1)}", _made(r, 1), f"{r.choice(_ONSETS)}{r.choice(_VOWELS)}+{r.choice(_CODAS)}", f"{r.choice(_ONSETS)}{_made(r, 2)}", r.choice(_ONSETS)]).lower()
    host = r.choice(["example.com", "example.org", "example.net", f"{_made(r, 1).lower()}.test", f"mail.{_made(r, 2).lower()}.example", f"{r.choice(_ONSETS)}{r.choice(_VOWELS)}.org", f"{_made(r, 1).lower()}.co.uk", f"{_made(r, 4).lower()}.{r.choice(['com', 'de', 'fr', 'io'])}"])
    if r.random() < 0.2:
        return r.choice([f"{name}(at){host}", f"{name} [at] {host}", f"{name} at {host.replace('.', ' [dot] ')}", f"{name} at {host.replace('.', ' (dot) ')}"])
    return f"{name}@{host}"


def _email_alike(r: random.Random) -> str:
    return r.choice([f"@{_made(r, 2).lower()}-bot", f"@{_made(r, 2).lower()}/core", f"v{r.randint(1, 400)}@beta", f"logo@{r.randint(1, 4)}x.png", f"icon{r.randint(1, 9)}@2x.jpg", f"@{_made(r, 2).lower()}", "10 kg@home"])


_BEFORE = {
    "phone": ["Phone", "Call back on", "mobile:", "Text", "Reach the office via", "The dentist is at", "tel.", "", "", "Wrote down", "as before:", "hey,", "change the old value to"],
    "id_number": ["SSN", "Tax ID", "passport number:", "Passport no.", "Renew passport", "Driving licence", "National insurance", "DNI", "Steuernummer", "social security number is", "His social:", "", "", "Wrote down", "the paper only reads", "FYI -"],
    "address": ["Lives at", "Moved to", "Ship it to", "home address:", "", "FYI -", "forget"],
    "email": ["Write to", "Contact:", "mail", "Replies go to", "Old login was", "mailto:", "", "FYI -"],
}
_MAKERS = {"phone": _phone, "id_number": _identity, "address": _address, "email": _email}


def written(count: int, seed: int, listed: float = 0.5, people: int = 150) -> list[tuple[str, set[tuple[int, int]]]]:
    """Texts of one group with the (kind, place) of their personal items. ``listed``: part of the given names that the list holds; ``people``: how many there are, and below 100 also how many surnames."""
    r = random.Random(seed)
    world, out = _World(r, listed, people), []
    for _ in range(count):
        text, spans = " ".join(r.choices(_FILLER, k=r.randint(2, 8))).capitalize() + ". ", set()
        for _ in range(r.randint(1, 4)):
            pick = r.random()
            if pick < 0.28:
                lead, said, rest = world.person()
                text += lead + (" " if lead else "")
                spans.add((4, len(text)))
                text += said + rest + " "
            elif pick < 0.5:
                kind = r.choice(sorted(_MAKERS))
                long = kind == "address" and r.random() < 0.4
                item = _long_address(r) if long else _MAKERS[kind](r)
                if kind in ("phone", "id_number") and r.random() < 0.05 and item.replace(" ", "").isdigit():
                    item = " ".join(_COUNTING[int(c)] for c in item if c != " ")
                if r.random() < 0.1:
                    item = item.upper() if r.random() < 0.5 else item.lower()
                lead = r.choice(_BEFORE[kind])
                text += lead + ("" if not lead or lead.endswith("mailto:") else " ") + ("(" if (bracket := r.random() < 0.15) else "")
                spans.add((KINDS.index(kind), len(text)))
                text += item + (")" if bracket else "") + r.choice(_ENDS) + " "
            elif pick < 0.62:
                lead, number = _number_alike(r)
                text += f"{r.choice(['', 'See ', 'Filed with '])}{lead} {number}{r.choice(_ENDS)} "
            else:
                text += (world.alike() if pick < 0.9 else r.choice([_address_alike, _long_address_alike, _email_alike])(r)) + r.choice(_ENDS) + " "
            if r.random() < 0.4:
                text += " ".join(r.choices(_FILLER, k=r.randint(2, 6))).capitalize() + ". "
        out.append((text, spans))
    return out


def statistics(texts: list[str], rarest: float = 1e-3) -> Words:
    """What ``pii.word_statistics`` says of the same texts."""
    every, low, partners = Counter(), Counter(), defaultdict(list)
    for t in texts:
        for w in re.findall(r"[^\W\d_]{2,}", t):
            every[w.lower()] += 1
            low[w.lower()] += w == w.lower()
        for inner, a, b in re.findall(r"((?:[a-zà-öø-ÿß,] )?)((?<![^\W\d_])[A-ZÀ-ÖØ-Þ][^\W\d_]+)(?= ([A-ZÀ-ÖØ-Þ][^\W\d_]*))", t):
            partners[a.lower()].append((b, inner != ""))
    least = max(2, int(len(texts) * rarest))
    often = {w: n for w, n in every.items() if n >= least}
    return Words({w: n / len(texts) for w, n in often.items()}, {w: low[w] / n for w, n in often.items()}, {w: (float(len({b for b, _ in p})), float(len(p)), float(sum(i for _, i in p))) for w, p in partners.items() if len(p) >= least}, len(texts))


# What is known in each group of examples: part of its names that are listed, how many people there are, whether the list is known, whether statistics are.
_GROUPS = (
    (0.9, 150, True, True), (0.5, 70, True, True), (0.0, 200, True, True), (0.5, 15, True, True), (0.5, 120, False, True), (0.6, 40, False, True), (1.0, 20, False, True), (0.5, 90, True, False), (0.0, 60, True, False), (0.5, 200, False, False), (0.1, 60, True, True), (0.0, 150, True, True),
)


@lru_cache(maxsize=2)
def _fitted(count: int, seed: int) -> tuple[BoostedTrees, ...]:
    x: list[list] = [[] for _ in STANDS_FOR]
    y: list[list] = [[] for _ in STANDS_FOR]
    for g, (listed, people, known, counted) in enumerate(_GROUPS):
        examples = written(count // len(_GROUPS), seed + g, listed, people)
        words = statistics([t for t, _ in examples])
        if not counted:  # only what general prose has in lower case
            words = Words({w: v for w, v in words.rate.items() if words.lower[w] > 0.5}, words.lower, {}, words.texts)
        forms = NameForms() if known else NameForms({})
        for text, true in examples:
            for kind, start, _, values in candidates(text, words, forms):
                x[kind].append(values)
                y[kind].append((STANDS_FOR[kind], start) in true)
    made = []
    for kind, (a, b) in enumerate(zip(x, y, strict=True)):
        made.append(fit(np.array(a, dtype=float), np.array(b), trees=120, depth=5, rate=0.2) if kind == 4 else fit(np.array(a, dtype=float), np.array(b)))
    return tuple(made)


def trained(forms: NameForms | None = None, count: int = 14_400, seed: int = 11) -> tuple[BoostedTrees, ...]:
    """Trees for each of ``KINDS`` and for long addresses, fitted on ``count`` written examples; the same on every call."""
    return _fitted(count, seed)
