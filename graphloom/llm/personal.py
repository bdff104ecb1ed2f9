"""Problem 8: personal information in free text, by candidate gradient boosting.

High-recall generators propose overlapping spans (mail addresses, phone numbers, identity numbers, street addresses, names); a
boosted-tree classifier per kind scores each span from its format and its context; thresholds calibrated on held-out rows select
the spans, overlaps are settled, and the text is rebuilt with typed placeholders.

The classifiers are trained here, on labelled sentences that are composed from general phrasings with invented values
(`Training.sentences`, a documented bound), and on the table of name parts, of which only a share is used so that
the models learn to do without it. Search covers every document, whole.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.boosting import Trees, calibrated_threshold

KINDS = ("email", "phone", "id_number", "address", "name")

# --- generators -----------------------------------------------------------------------------------------------------------------

_AT = r"(?:@| @ | ?[\[(]\s?(?i:at)\s?[\])] ?)"
_DOT = r"(?:\.| ?[\[(]\s?(?i:dot)\s?[\])] ?| (?i:dot) )"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
# a bare word `at` makes an address only with a spelled-out dot: "ask Keller at a.keller (at) ..." holds one address, not two
EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9](?:[\w.+%-]*[A-Za-z0-9_])?(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})+| (?i:at) {_LABEL}(?: ?[\[(]?\b(?i:dot)\b[\])]? ?{_LABEL})+)")
NUMBER = re.compile(r"(?<![\w.])(?:\+|\()?\d(?:[ ./()-]{0,2}\d){5,16}(?![\w-])")
CODE = re.compile(r"(?<![\w-])[A-Z]{1,3}[ -]?\d(?:[ -]?\d){4,10}(?:[ -]?[A-Z])?(?![\w-])")
_CAP = r"[^\W\d_a-zà-öø-ÿ][\w'’-]*[^\W_]"
_ROAD = r"(?i:street|st|road|rd|avenue|ave|lane|ln|close|quay|terrace|drive|dr|court|square|way|row|place|boulevard|blvd)"
_TOWN = rf"(?:, ?(?:\d{{4,5}} )?{_CAP}(?: \d{{4,5}})?)"
_FLAT = r"(?:(?i:flat|apt|unit|apartment)\.? \d+[A-Za-z]?)"
ADDRESSES = (
    re.compile(rf"\d{{1,5}}[a-z]? {_CAP}(?: {_CAP})? {_ROAD}\b(?:, ?{_FLAT})?{_TOWN}?"),
    re.compile(rf"(?<!\w){_CAP[:-6]}[\w'’-]*(?i:straße|strasse|weg|platz|gasse|allee) \d+ ?[a-z]?\b{_TOWN}?"),
    re.compile(rf"(?<!\w)(?i:calle|avenida|plaza|via) {_CAP} \d+\b{_TOWN}?"),
    re.compile(rf"(?<![\w-])\d{{1,4}},? (?i:rue|avenue|place|chemin|boulevard) (?i:de la |de |du |des |d['’])?{_CAP}{_TOWN}?"),
)
_FLAT_BEFORE = re.compile(rf"{_FLAT}, ?$")
_NAME = r"[^\W\d_a-zà-öø-ÿ][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_INITIAL = r"[A-Z]\."
_GAP = r"[  ]"
NAMES = tuple(
    re.compile(rf"(?:{p})(?![\w@])")
    for p in (
        rf"{_NAME}{_GAP}{_NAME}",
        rf"{_NAME}{_GAP}(?:{_INITIAL}{_GAP}?){{1,2}}{_NAME}",
        rf"(?:{_INITIAL}{_GAP}?){{1,3}}{_NAME}",
        rf"{_NAME},{_GAP}{_NAME}(?:{_GAP}{_INITIAL}(?!\w))?",
        rf"{_NAME},{_GAP}(?:{_INITIAL}{_GAP}?){{1,2}}",
    )
)
#: Where a name may begin; the patterns above are tried only there.
_CAPITAL = re.compile(r"(?<![\w@.+-])[^\W\d_a-zà-öø-ÿ]")
#: What follows such a place in all of the patterns.
_BEGINS = re.compile(rf"{_NAME},?{_GAP}[^\W\d_a-zà-öø-ÿ]|{_INITIAL}")
#: What a text must hold, in lower case, for an address or a spelled-out mail address to be looked for.
_ROADS = tuple("street|st|road|rd|avenue|ave|lane|ln|close|quay|terrace|drive|dr|court|square|way|row|place|boulevard|blvd".split("|"))
_HINTS = (_ROADS, ("straße", "strasse", "weg", "platz", "gasse", "allee"), ("calle", "avenida", "plaza", "via"), ("rue", "avenue", "place", "chemin", "boulevard"))
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")

#: Titles, and words that often stand with a capital without being part of a name; many may be one, so they are a feature.
TITLES = frozenset("dr prof mr ms mx mrs miss sir herr frau madame monsieur señor señora mme sr sra".split())
PLAIN = frozenset(
    """a about across after agree all also an and any apt as at author avec background before between both but by calle can care choose
    cite comparamos contact contacto copied corresponding cut das de der des die docs documento each edge el en every experiments flat
    follow for forum from given good has have her here highlights his how i if im in is it its la le les lives mailto my name nach
    national new no node not note nous now of on one only or order our passport photos plainly please posting questions quien
    reader recap reach result retrieval return rue run rated réponse sans second see seen seller shard side signed since sin
    some sold ssn still sur suppose take tel telefon teléfono text thanks that the their then there these this thread tax to tras two
    under unlike update user version via warning we wer when where which why wir with without worth would yes you your id ni ausweis
    personalausweis identity insurance personal social security number card buyers test bench answer écrire rückfragen pièce modell knoten model reading proposed
    après ohne code checksum phone telephone mobile fax address adresse anschrift street avenue quay""".split()
)
#: Words that are names as well, for the training sentences.
WORD_NAMES = "page lane close road short side street rose mark may will grant bill frank grace hope hall wood stone field brook king knight peter sean das case rich day".split()
#: Words of the context, by what they speak for.
CUES = {
    "name": "signed author contact contacto annotator am ask parcels user an à von nom de to wrote lives name écrire rückfragen by from".split(),
    "phone": "tel tél telefon teléfono phone telephone mobile call line under fax ring".split(),
    "id_number": "id no number ssn passport identity identidad identité ausweis tax insurance ni social security national personal card pièce documento license".split(),
    "address": "lives live at anschrift adresse address vive en parcels meet wohnt habite to send ship".split(),
    "email": "mailto email mail courriel correo write contact at author".split(),
    "article": "the der das die ein eine le la les un une el los las a an our this".split(),
    "against": "node nodes order code version port host checksum doi benchmark score run range loss hits recall follow docs release size step shard tokens entry page result items weeks points edges members".split(),
}
_SETS = {k: frozenset(v) for k, v in CUES.items()}
_IDENTITY = re.compile(r",? ?(?i:id|ssn|ni|passport|tax|identity|insurance|personal|social|national|ausweis|\d{3})\b")
_FORMATS = (
    re.compile(r"\d{3}-\d{2}-\d{4}"),
    re.compile(r"\d{6}-\d{4}"),
    re.compile(r"\d{3} \d{3} \d{3} \d{3}"),
    re.compile(r"[A-Z]{2} \d\d \d\d \d\d [A-Z]"),
    re.compile(r"[A-Z]{1,2}\d{6,9}"),
    re.compile(r"\+\d[\d -]+"),
    re.compile(r"\(\d{3}\) ?\d{3}[-. ]\d{4}"),
    re.compile(r"\d{3}[-. ]\d{3}[-. ]\d{4}"),
    re.compile(r"0[\d /.-]+"),
    re.compile(r"\d\d(?:\.\d\d){4}"),
    re.compile(r"\d+"),
    re.compile(r"\d{4}-\d{2}-\d{2}.*"),
    re.compile(r"\d+(?:\.\d+){1,3}"),
)

Span = tuple[int, int, str, int]


def candidates(text: str) -> list[Span]:
    """(start, stop, kind, generator) of every proposal; they overlap freely."""
    out: list[Span] = []
    low = text.lower()
    if "@" in text or "[at" in low or "(at" in low or "[ at" in low or "( at" in low or (" at " in low and "dot" in low):
        out += [(m.start(), m.end(), "email", 0) for m in EMAIL.finditer(text)]
    for m in NUMBER.finditer(text):
        a, b = m.span()
        if text[a] == "(" and ")" not in m[0]:
            a += 1
        digits = sum(map(str.isdigit, m[0]))
        if 7 <= digits <= 15:
            out += [(a, b, "phone", 1), (a, b, "id_number", 1)]
    out += [(m.start(), m.end(), "id_number", 2) for m in CODE.finditer(text)]
    for g, (pattern, hints) in enumerate(zip(ADDRESSES, _HINTS)):
        if any(map(low.__contains__, hints)):
            for m in pattern.finditer(text):
                a = m.start()
                if g == 0:
                    if a and (text[a - 1].isalnum() or text[a - 1] in "-_"):
                        continue
                    flat = _FLAT_BEFORE.search(text, max(0, a - 24), a)
                    a = flat.start() if flat else a
                out.append((a, m.end(), "address", 3 + g))
    for start in _CAPITAL.finditer(text):
        a = start.start()
        if _BEGINS.match(text, a):
            for g, pattern in enumerate(NAMES):
                m = pattern.match(text, a)
                if m:
                    out.append((a, m.end(), "name", 10 + g))
    return out


# --- features -------------------------------------------------------------------------------------------------------------------


class Tokens:
    """The words of a text with their places, found once for all of its spans."""

    def __init__(self, text: str):
        spans = [m.span() for m in _WORD.finditer(text)]
        self.text, self.starts, self.ends = text, [a for a, _ in spans], [b for _, b in spans]

    def low(self, i: int, j: int) -> list[str]:
        """The words i to j in lower case."""
        return [self.text[a:b].lower() for a, b in zip(self.starts[i:j], self.ends[i:j])]


class Features:
    """Numbers that describe a span and its surroundings. given, family: known parts of names, lower case."""

    def __init__(self, given: frozenset[str], family: frozenset[str]):
        self.given, self.family, self.known = given, family, given | family

    def of(self, text: str, span: Span, marks: list[int], t: Tokens) -> list[float]:
        """marks: sorted starts of mail-, phone- and number-like proposals of the text."""
        a, b, kind, generator = span
        s = text[a:b]
        i, j = bisect.bisect_left(t.starts, a), bisect.bisect_left(t.starts, b)
        left, right, low = t.low(max(i - 5, bisect.bisect_left(t.starts, a - 60)), i), t.low(j, j + 4), t.low(i, j)
        halves = [q for p in low for q in p.split("-")] if "-" in s else low
        named = kind == "name"
        digits = 0 if named else sum(map(str.isdigit, s))
        letters = sum(map(str.isalpha, s))
        upper = sum(map(str.isupper, s))
        around = [x for x in range(max(0, i - 8), i) if t.starts[x] >= a - 30] + [x for x in range(j, min(j + 8, len(t.starts))) if t.ends[x] <= b + 30]
        caps = sum(text[t.starts[x]].isupper() for x in around)
        before, after = text[max(0, a - 8) : a], text[b : b + 12]
        stripped = before.rstrip("  ").rstrip(".")
        title = bool(left) and left[-1] in TITLES and before[-1:] in (" ", " ") and stripped.lower().endswith(left[-1])
        spot = bisect.bisect_left(marks, b)
        gap = marks[spot] - b if spot < len(marks) else 99
        plain = [p in PLAIN for p in low]
        lead = before[-1:] == "" or before[-1:] == "\n" or (before[-2:-1] in ".!?:" and before[-1:] == " ")
        row = [
            generator,
            b - a,
            digits,
            letters / (b - a),
            upper / max(1, letters),
            len(low),
            s.count(" "),
            s.count("-"),
            s.count("."),
            "," in s,
            "+" in s,
            "(" in s,
            "/" in s,
            "@" in s,
            sum(h in self.given for h in halves),
            sum(h in self.family for h in halves),
            bool(halves) and halves[0] in self.known,
            bool(halves) and halves[-1] in self.known,
            title,
            min(gap, 60),
            caps / max(1, len(around)),
            before[-1:] in "\n" or not before.strip(),
            before[-2:-1] in ".!?" and before[-1:] == " ",
            before[-2:-1] in ":|" or before[-1:] in ':"|',
            before[-2:-1] == ",",
            after[:1] in ",;",
            after[:1] == ".",
            after[:2] in (" <", " (", " |", '",', " a", " ;") or after[:1] in '"|',
            after[:7] == " wrote " or after[:7] == ", lives",
            named and bool(_IDENTITY.match(after.lstrip(", "))),
            sum(plain),
            bool(plain) and plain[0],
            bool(plain) and plain[-1],
            bool(plain) and plain[0] and low[0] not in self.known,
            sum(p in TITLES for p in low),
            lead,
            min((len(p) for p in low), default=0),
        ]
        tail, last = left[-3:], left[-1] if left else ""
        for cue in CUES:
            words = _SETS[cue]
            row.append(last in words)
            row.append(sum(w in words for w in tail))
        row.append(sum(w in _SETS["against"] for w in right[:2]))
        row.append(sum(w in _SETS["name"] for w in right[:2]))
        return row + ([0.0] * len(_FORMATS) if kind not in ("phone", "id_number") else [bool(f.fullmatch(s)) for f in _FORMATS])


# --- training -------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Training:
    """sentences: labelled sentences composed per fit (the bound of the training sample); known: share of name parts whose
    membership in the table is shown; held: share of sentences kept for the thresholds."""

    sentences: int = 9000
    known: float = 0.6
    held: float = 0.3
    seed: int = 20300108


def _invented(r: random.Random) -> str:
    on = "b br d dr f fl g gr h k kl l m n p pl pr qu r s sk st str t tr v vr w z zh".split()
    mid = "a e i o u ae ie io ou".split()
    off = "b d f k l lm m n nd nt r rt s st t th x".split()
    return ("".join(r.choice(on) + r.choice(mid) for _ in range(r.choice((1, 2, 2, 3)))) + r.choice(off)).capitalize()


def _values(r: random.Random, given: list[str], family: list[str]):
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def part(known: list[str]) -> str:
        k = r.random()
        return r.choice(WORD_NAMES).capitalize() if k < 0.07 else r.choice(known) if known and k < 0.77 else _invented(r)

    first = lambda: part(given)
    last = lambda: part(family)

    def name() -> str:
        g, f = first(), last()
        if r.random() < 0.08:
            f = f"{f}-{last()}"
        k = r.random()
        s = f"{g} {f}" if k < 0.5 else f"{f}, {g}" if k < 0.68 else f"{g} {r.choice('ABDEFGHKLMNPRST')}. {f}" if k < 0.82 else f"{g[0]}. {f}" if k < 0.94 else f"{g} {f.upper()}"
        return s.upper() if r.random() < 0.05 else s

    def email() -> str:
        g, f = first().lower(), last().lower()
        local = r.choice((f"{g}.{f}", f"{g[0]}{f}", f"{f}{d(2)}", f"{g}-{f}{d(2)}", f"{f}_{g}", f"{g[0]}.{f}+lists", f"{g}{f}"))
        host = [*(["mail"] if r.random() < 0.3 else []), _invented(r).lower() + r.choice(("", "", "-lab")), *r.choice((["example"], ["test"], ["invalid"], ["example", "org"], ["com"], ["net"]))]
        s = r.choice(
            (
                f"{local}@{'.'.join(host)}",
                f"{local}@{'.'.join(host)}",
                f"{local} @ {'.'.join(host)}",
                f"{local} [at] {' [dot] '.join(host)}",
                f"{local} (at) {'.'.join(host)}",
                f"{local} AT {' DOT '.join(host)}",
            )
        )
        return s.upper() if r.random() < 0.08 else s

    def phone() -> str:
        a, b = r.choice("23456789") + d(2), d(4)
        return r.choice(
            (
                f"+1 {a} 555 {b}", f"+1{a}555{b}", f"({a}) 555-{b}", f"{a}-555-{b}", f"{a}.555.{b}", f"+44 7{d(3)} {d(6)}", f"07{d(3)} {d(6)}", f"0044-7{d(3)}-{d(6)}",
                f"020 7{d(3)} {d(4)}", f"030/{d(8)}", f"+49 30 {d(5)} {d(3)}", f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"01.{d(2)}.{d(2)}.{d(2)}.{d(2)}",
            )
        )

    def id_number() -> str:
        c = lambda: r.choice("ABCEGHJKLMNPRTVWXYZ")
        return r.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(6)}-{d(4)}", f"{d(3)} {d(3)} {d(3)} {d(3)}", f"{c()}{c()} {d(2)} {d(2)} {d(2)} {c()}", f"{c()}{c()}{d(7)}"))

    def address() -> str:
        t, w = _invented(r), _invented(r)
        road = r.choice("Street St Road Rd Avenue Ave Lane Close Quay Terrace Boulevard".split())
        n = r.randint(1, 999)
        return r.choice(
            (
                f"{n} {w} {road}, {t}", f"Flat {r.randint(1, 40)}, {n} {w} {road}, {t}", f"{n} {w} {road}", f"{n} {w} {road}, Apt {r.randint(1, 40)}{r.choice('ABC')}, {t} {d(5)}",
                f"{w}straße {n % 99 + 1}{r.choice(('', 'a', 'b'))}, {t}", f"{w}weg {n % 99 + 1}, {d(5)} {t}", f"Calle {w} {n % 150 + 1}, {t}", f"{n % 150 + 1} rue de {w}, {d(5)} {t}",
            )
        )

    return {"name": name, "email": email, "phone": phone, "id_number": id_number, "address": address}


#: Phrasings with slots; {t} is an optional title, {w} an invented word, {P} a common one, {n} a number, {l} a label of an identity number.
PHRASES = (
    "Signed by {t}{name}.", "Best wishes, {t}{name}.", "{t}{name} wrote this from home.", "{t}{name} wrote the report.", "Author: {t}{name} <{email}>.", "Corresponding author: {t}{name} <{email}>.",
    "Questions go to {t}{name} at {email}.", "Write to {t}{name}, email {email}.", "Écrire à {t}{name}, courriel {email}.", "Contacto: {t}{name}, correo {email}.", "Rückfragen bitte an {t}{name} ({email}).",
    '{{"user": "{name}", "contact": "{email}"}}', "Contact | {name} | {email} | {phone} | {address}", "Contact block | {name} | {email} | {phone} | {address} The {w} continues.", "Call {phone} and ask for {t}{name}.",
    "Seller line {phone}, ask for {t}{name}.", "Reach me under {phone} or write to {email}.", "tel:{phone}", "tel:{phone} Our {w} model works.", "mailto:{email}", "Her file lists {l} {id_number} and the phone {phone}.",
    "Please remove my entry; I am {t}{name}, {l} {id_number}.", "I am {t}{name}, {id_number}.", "My {l} is {id_number}.", "Documento de identidad {id_number} de {t}{name}.", "Pièce d'identité {id_number} au nom de {t}{name}.",
    "Antrag von {t}{name}, Ausweis {id_number}.", "{t}{name}, {l} {id_number}.", "Return parcels to {t}{name}, {address}.", "The annotator, {t}{name}, lives at {address}.", "She lives at {address}.", "Meet at {address} on the first evening.",
    "We work with {t}{name} on this.", "Contact {t}{name} or {t}{name}.", "A talk by {name} and {name} in {W}.", "{name} and {name} met in {W}.", "Ship it to {address}.",
    "Telefon: {phone}, Anschrift: {address}.", "Teléfono {phone}, vive en {address}.", "Tél. {phone} ; adresse : {address}.", "Deliver it to {address}.", "We spoke with {t}{name} and {t}{name} yesterday.", "Thanks to {t}{name} for the review.",
)
#: Phrasings without personal information, with look-alikes.
OTHERS = (
    "Node {n8} joins node {n8} at step {n1}.", "Order code {c2}-{n4}-{c1}, size {n3} x {n3} mm.", "Run finished 2030-0{n1}-1{n1} 2{n1}:1{n1}:3{n1} with loss 0.{n6}.", "Checksum {h8}, port 8{n3}, host 192.0.2.{n2}.",
    "Shard range {n4}..{n5} holds {n2},{n3} tokens.", "Cite as doi 10.5555/{w}.203{n1}.{n4} for now.", "Follow @{w}_graphs for release notes of version {n1}.{n2}.{n2}.", "Docs live under https://docs.{w}.example/v{n1}/node/{n5} and mirror weekly.",
    "Retrieval reached hits@{n2} of 0.{n3} and recall@{n2} of 0.{n3}.", "The {p} benchmark and the {p} score disagree.", "Take the main street of the layout, then lane {n1} of the board.", "Choose the label under which {W}, {W} and the {w} all appear next to {W}.",
    "Choose The Label Under Which {W}, {W} And The {W} All Appear Next To {W}.", "Name The Single {W} That {W} Both {W} And {W}, Then Justify {W} Briefly.", "SUPPOSE {U} CITES {U} BUT NEVER {U}, AND THE {U} AROUND {U}.", "Agree with {W}, though {n2} of my {w} still turn odd.",
    "Under {w} {w}, {W} matches {W} while using {n2} times fewer {w}.", "It replaces the older {W} {w}, adds a {w}, and fits any {W} {w}.", "Update, {W} branch: {W} {w} stays.", "Seen at {W}: {W} treats each {w} as one.", "Wer {W} kauft, sieht meist auch {W}.",
    "For {W} only: {W} is compared with {W}, {W} and {W}.", "Between {W} and {W}: nothing changed.", "Version {n2}: {W} {w} was dropped.", "Suppose {W} cites {W} but never {W}, and stop.", "Part no. {n6}-{n4} fits the {w}.", "Ticket {n3}-{n3}-{n4} was closed.",
    "Das Modell {W} sucht zuerst bei {W}.", "Der {W} Knoten verbindet {W} mit einem Nachbarn.", "Le modèle {W} cherche près de {W}.", "El nodo {W} une {W} con {W}.", "Der {W} {W} fehlt noch.", "The {W} {W} comes in two sizes.",
    "Why {W} {P} Beats {P} {W} Here.", "{W} {P} {W} And {W} {P} Once More.", "{P} {W} In {P} {W} {P} Or {W} {P}.", "{Q} {U} {Q} {U} {Q} {U}.", "{U} {Q} AND {Q} {U}: {U} {Q}.", "{P}, {W} stays as it was.", "{U}, {Q}, {Q} {U}.", "{P} {W} was read and {W} {P} was not.",
    "{w} {W} {W} {w} and a {w}.", "The {W} {P} holds {n2} {w}.", "BY {U} {U} {U} FIRST, {U} ANSWERS {n2} OF THE HUNDRED {U} {U} LEFT OPEN BY {U}.", "{U} {U}: {U} {U} STAYS, {U} DOES NOT.", "The {W} Version Of {W} Drops Its {W} And Gains {n2} Hours.", "NEW FOR THIS SEASON: {U} IN {U} {U}, SOLD AS A PAIR WITH THE {U} {U}.",
    "Build {n3}.{n3}.{n4} of the {w}.", "Edge {n7} of shard {n7}.", "In {n4} {W} moved {n3} members to {W}, {W}.", "Dataset {W} {W} has {n5} nodes.", "With {W} {W} the score grew.", "Item {c2}{n7} was restocked.", "Model {c2} {n2} {n2} {n2} {c1} is sold out.", "Order {n3} {n3} {n3} {n3} shipped.",
)
LABELS = ("id", "ID no.", "SSN", "social security no.", "national id", "national identity number", "identity number", "identity card", "passport", "passport no.", "Passport number:", "tax id", "tax number", "NI number", "insurance number", "personal number")


def composed(n: int, given: list[str], family: list[str], seed: int) -> Iterator[tuple[str, set[tuple[int, int, str]]]]:
    """n texts of a few sentences each, with the spans of their personal information."""
    r = random.Random(seed)
    make = _values(r, given, family)
    common = sorted(PLAIN)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    for _ in range(n):
        text, spans = "", set()
        for _ in range(r.randint(2, 4)):
            phrase = r.choice(PHRASES if r.random() < 0.6 else OTHERS)
            for piece in re.split(r"(\{\w+\}|\{\{|\}\})", phrase):
                slot = piece[1:-1] if piece[:1] == "{" and len(piece) > 2 else ""
                if slot in make:
                    value = make[slot]()
                    spans.add((len(text), len(text) + len(value), slot))
                elif slot == "t":
                    value = r.choice(("", "", "", "Dr. ", "Prof. ", "Mr ", "Ms ", "Mx "))
                elif slot == "l":
                    value = r.choice(LABELS)
                elif slot in ("w", "W", "U"):
                    value = _invented(r)
                    value = value.lower() if slot == "w" else value.upper() if slot == "U" else value
                elif slot in ("P", "Q"):
                    value = r.choice(common)
                    value = value.capitalize() if slot == "P" else value.upper()
                elif slot == "p":
                    value = r.choice(given + family) if given or family else _invented(r)
                elif slot[:1] == "n" and slot[1:].isdigit():
                    value = digits(int(slot[1:]))
                elif slot[:1] == "c":
                    value = "".join(r.choice("QXZABK") for _ in range(int(slot[1:])))
                elif slot[:1] == "h":
                    value = "".join(r.choice("0123456789abcdef") for _ in range(int(slot[1:])))
                else:
                    value = {"{{": "{", "}}": "}"}.get(piece, piece)
                text += value
            text += r.choice((" ", " ", "\n", "\n\n"))
        yield text, spans


class Detector:
    """Trained classifiers and thresholds; small, sent to the tasks as it is."""

    def __init__(self, parts: list[tuple[str, str]], t: Training | None = None):
        t = t or Training()
        r = random.Random(t.seed)
        given, family = sorted({p for p, k in parts if k == "given"}), sorted({p for p, k in parts if k == "family"})
        shown = [frozenset(p.lower() for p in ps if r.random() < t.known) for ps in (given, family)]
        learn = Features(*shown)
        rows: dict[str, list[tuple[list[float], int, bool]]] = {k: [] for k in KINDS}
        for i, (text, spans) in enumerate(composed(t.sentences // 3, given, family, t.seed)):
            found = candidates(text)
            marks, tokens = _marks(found), Tokens(text)
            for c in found:
                rows[c[2]].append((learn.of(text, c, marks, tokens), int((c[0], c[1], c[2]) in spans), i % 10 < 10 * t.held))
        self.models, self.thresholds, self.report = {}, {}, {}
        for kind, data in rows.items():
            x, y, held = np.array([d[0] for d in data]), np.array([d[1] for d in data]), np.array([d[2] for d in data])
            model = Trees().fit(x[~held], y[~held])
            p = model.predict(x[held])
            cut = calibrated_threshold(p, y[held])
            self.models[kind], self.thresholds[kind] = model, cut
            hit = p >= cut
            true = (hit & (y[held] > 0)).sum()
            self.report[kind] = (float(true / max(1, hit.sum())), float(true / max(1, (y[held] > 0).sum())))
        self.features = Features(frozenset(p.lower() for p in given), frozenset(p.lower() for p in family))

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """For each text its settled spans in order."""
        proposals = [candidates(t) if t else [] for t in texts]
        by_kind: dict[str, list[tuple[int, Span, list[float]]]] = {k: [] for k in KINDS}
        for i, (text, found) in enumerate(zip(texts, proposals)):
            if not found:
                continue
            marks, tokens = _marks(found), Tokens(text)
            for c in found:
                by_kind[c[2]].append((i, c, self.features.of(text, c, marks, tokens)))
        chosen: list[list[tuple[int, float, int, int, str]]] = [[] for _ in texts]
        for kind, data in by_kind.items():
            if data:
                p = self.models[kind].predict(np.array([d[2] for d in data]))
                for (i, (a, b, _, _), _), score in zip(data, p):
                    if score >= self.thresholds[kind]:
                        chosen[i].append((a - b, -score, a, b, kind))
        out = []
        for spans in chosen:
            taken: list[tuple[int, int, str]] = []
            for _, _, a, b, kind in sorted(spans):
                at = bisect.bisect_left(taken, (a,))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                    taken.insert(at, (a, b, kind))
            out.append(taken)
        return out


def _marks(found: list[Span]) -> list[int]:
    return sorted({a for a, _, k, _ in found if k != "name"})


# --- operators ------------------------------------------------------------------------------------------------------------------

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
BATCH = 256


def _detected(id_col: str, text_col: str, detector: Detector, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                ids, texts = b.column(id_col)[lo : lo + BATCH].to_pylist(), b.column(text_col)[lo : lo + BATCH].to_pylist()
                found = detector.find(texts)
                if redact:
                    new = []
                    for t, spans in zip(texts, found):
                        pieces, at = [], 0
                        for a, z, kind in spans:
                            pieces += [t[at:a], PLACEHOLDERS[kind]]
                            at = z
                        new.append(None if t is None else "".join(pieces) + t[at:])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(new, pa.string()), pa.array([len(f) for f in found], pa.int32())], names=["doc_id", "text", "replaced"])
                else:
                    rows = [(i, k, t[a:z], a) for i, t, spans in zip(ids, texts, found) for a, z, k in spans]
                    cols = list(zip(*rows)) or [[], [], [], []]
                    types = [pa.int64(), pa.string(), pa.string(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "kind", "found_text", "start"])

    return run


def name_parts(table: DataFrame) -> list[tuple[str, str]]:
    """The parts of names, at most 100,000 rows of them (a dictionary; more rows are an error, not a cut)."""
    rows = table.select("name_part", "part_kind").where("name_part is not null and part_kind in ('given', 'family')").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 name parts; the dictionary is broadcast and must stay small")
    return [(r[0], r[1]) for r in rows]


@lru_cache(maxsize=4)
def _fitted(parts: tuple[tuple[str, str], ...], t: Training) -> Detector:
    """One fit per set of name parts and training; it does not depend on the documents."""
    return Detector(list(parts), t)


def fitted(parts: DataFrame, t: Training | None) -> Detector:
    return _fitted(tuple(sorted(name_parts(parts))), t or Training())


def personal_spans(docs: DataFrame, parts: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: Training | None = None) -> DataFrame:
    """doc_id, kind, found_text, start of every selected span. Null and empty texts have none; repeated documents give rows each."""
    return docs.select(id_col, text_col).mapInArrow(_detected(id_col, text_col, fitted(parts, t), False), "doc_id long, kind string, found_text string, start int")


def redacted(docs: DataFrame, parts: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: Training | None = None) -> DataFrame:
    """doc_id, text with typed placeholders, number of replaced spans; one row per input row, null texts stay null."""
    return docs.select(id_col, text_col).mapInArrow(_detected(id_col, text_col, fitted(parts, t), True), "doc_id long, text string, replaced int")
