"""License scan (operator 3): Aho-Corasick notices and licence expressions.

A text is lower-cased (A-Z only) and cut into words; one automaton then finds every
notice phrase and every identifier tag in the word stream. What follows the place of a
tag and a colon or equals sign is read as a licence expression: a shunting-yard parser turns it into postfix order
(``with`` binds tighter than ``and``, ``and`` tighter than ``or``) and evaluates it.

Defined results: a null or empty text has no words, no places and score 0; repeated
rows give repeated results; ``doc_id`` may be null; all other columns are ignored.
After a tag the longest expression of known identifiers counts; a tag that none follows,
as with NONE and NOASSERTION, has no labels and is weak evidence.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame

from .common import ascii_lower, map_texts

#: Fixed by the contract: phrase to label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: The method's own notices: phrase to label and the weight of the evidence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "bsd license": ("bsd", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc0": ("cc0", 0.6),
    "bsd 2 clause": ("bsd", 0.8),
    "bsd 3 clause": ("bsd", 0.8),
    "gpl v2": ("gpl", 0.8),
    "gpl v3": ("gpl", 0.8),
    "gplv2": ("gpl", 0.8),
    "gplv3": ("gpl", 0.8),
    "lgpl v3": ("lgpl", 0.8),
    "apache 2 0": ("apache", 0.8),
    "license mit": ("mit", 0.6),
    "licensed under mit": ("mit", 0.7),
    "under the mit": ("mit", 0.6),
    "boost software license": ("bsl", 0.8),
    "zlib license": ("zlib", 0.7),
    "isc license": ("isc", 0.7),
    "the unlicense": ("unlicense", 0.6),
    "public domain": ("public-domain", 0.4),
    "all rights reserved": ("proprietary", 0.5),
}
#: Identifier tags, as words; a colon or an equals sign has to follow.
TAGS = ("spdx license identifier", "spdx licence identifier", "license expression", "licence expression", "packagelicensedeclared", "packagelicenseconcluded", "licenseconcluded", "licenseinfoinfile")
BASE_WEIGHT, TAG_WEIGHT, BARE_TAG_WEIGHT = 0.7, 0.95, 0.2
#: Identifiers, lower-cased: families with versions and variants, single ones, and those that documents define.
KNOWN = re.compile(
    r"(?:[al]?gpl-[0-9](?:\.[0-9])?(?:-only|-or-later)?\+?|gpl|lgpl|agpl|apache-[0-9]\.[0-9]|mit(?:-[a-z0-9-]+)?|bsd-[0-9]-clause(?:-[a-z0-9-]+)?|0bsd|bsd|mpl-[0-9]\.[0-9](?:-[a-z-]+)?|epl-[0-9]\.[0-9]|eupl-[0-9]\.[0-9]|cddl-[0-9]\.[0-9]|cecill-[0-9a-z.]+|afl-[0-9]\.[0-9]|osl-[0-9]\.[0-9]|artistic-[0-9]\.[0-9](?:-[a-z0-9]+)?|cc-by(?:-nc)?(?:-nd|-sa)?-[0-9]\.[0-9](?:-[a-z]+)?|cc0-1\.0|ofl-[0-9]\.[0-9](?:-[a-z-]+)?|bsl-1\.0|ms-[pr]l|isc|zlib|unlicense|wtfpl|beerware|postgresql|python-2\.0(?:\.1)?|psf-2\.0|ncsa|x11|curl|libpng(?:-2\.0)?|openssl|ruby|php-3\.01?|vim|w3c|unicode-3\.0|blueoak-1\.0\.0|upl-1\.0|hpnd|ijg|json"
    r"|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+)\+?"
)
EXCEPTION = re.compile(r"[a-z0-9.+-]*exception[a-z0-9.+-]*|linux-syscall-note")
#: Licence identifiers by family, longest family first; what none matches keeps its name.
FAMILIES = ("cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by", "lgpl", "agpl", "gpl", "apache", "mit", "mpl", "bsd", "epl", "isc", "cc0", "unlicense")
PERMISSIVE = {"apache", "mit", "bsd", "isc", "cc0", "unlicense", "cc-by"}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SIGN = re.compile(r"""["'\x20\t]*[:=]""")
LINE_END = re.compile(r"[\r\n]|\Z")
PART = re.compile(r"[()]|[a-z0-9.+:-]+")
#: Bytes of the lower-cased word stream: word bytes as they are, all others a blank.
STREAM = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@cache
def automaton() -> ahocorasick.Automaton:
    found: dict[str, list] = {}
    for phrase, label in BASE.items():
        found.setdefault(phrase, []).append(("base", label, BASE_WEIGHT))
    for phrase, (label, weight) in NOTICES.items():
        found.setdefault(phrase, []).append(("notice", label, weight))
    for phrase in TAGS:
        found.setdefault(phrase, []).append(("tag", "", len(phrase.split())))
    a = ahocorasick.Automaton()
    for phrase, hits in found.items():
        a.add_word(f" {phrase} ", (len(phrase) + 1, hits))
    a.make_automaton()
    return a


def postfix(parts: list[str]) -> list[str]:
    """Shunting-yard; raises ValueError where parentheses or operands don't fit."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True
    for part in parts:
        if part in PRECEDENCE:
            if operand:
                raise ValueError("operator without operand")
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[part]:
                out.append(waiting.pop())
            waiting.append(part)
            operand = True
        elif part == "(":
            if not operand:
                raise ValueError("missing operator")
            waiting.append(part)
        elif part == ")":
            if operand:
                raise ValueError("empty parentheses")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("unbalanced")
            waiting.pop()
        else:
            if not operand:
                raise ValueError("missing operator")
            out.append(part)
            operand = False
    if operand or "(" in waiting:
        raise ValueError("incomplete")
    return out + waiting[::-1]


def family(identifier: str) -> str:
    return next((f for f in FAMILIES if identifier.startswith(f)), identifier)


def evaluate(expression: str) -> tuple[frozenset[str], bool]:
    """The licences an expression names, and whether permissive ones alone can satisfy it.

    ``or`` needs one side to be permissive, ``and`` both; ``with`` adds an exception
    to a licence and changes neither.
    """
    stack: list[tuple[frozenset[str], bool]] = []
    for part in postfix(PART.findall(expression)):
        if part not in PRECEDENCE:
            stack.append((frozenset([part]), family(part) in PERMISSIVE))
            continue
        right, left = stack.pop(), stack.pop()
        if part == "with":
            stack.append(left)
        else:
            stack.append((left[0] | right[0], (left[1] or right[1]) if part == "or" else (left[1] and right[1])))
    return stack.pop()


def longest(parts: list[str]) -> int:
    """How many parts, from the first on, make up the longest expression of known identifiers."""
    depth, operand, best, before = 0, True, 0, ""
    for i, part in enumerate(parts, 1):
        if (part in PRECEDENCE or part == ")") == operand:
            break
        if part not in PRECEDENCE and part not in "()" and not (EXCEPTION if before == "with" else KNOWN).fullmatch(part):
            break
        before = part
        if part == "(":
            depth += 1
        elif part == ")":
            if not depth:
                break
            depth -= 1
        else:
            operand = part in PRECEDENCE
        if not operand and not depth:
            best = i
    return best


def signed(lowered: str, tags: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of tags, as numbers of their first and last words, those that a sign follows: where they begin and it ends."""
    first, last = ({x: i for i, x in enumerate(side)} for side in zip(*tags))
    spans = [[0, 0] for _ in tags]
    for k, m in enumerate(WORD.finditer(lowered)):
        if k in first:
            spans[first[k]][0] = m.start()
        if k in last:
            spans[last[k]][1] = m.end()
    return [(a, m.end()) for a, b in spans if (m := SIGN.match(lowered, b))]


def expressions(lowered: str, tags: list[tuple[int, int]]) -> list[tuple[str, frozenset[str], bool]]:
    """Each tag's expression, its licences and value; comment ends and prose after it are cut off."""
    found = []
    for (_, at), (following, _) in zip(tags, [*tags[1:], (len(lowered), 0)]):
        end = LINE_END.search(lowered, at, following)
        parts = PART.findall(lowered, at, end.start())
        if n := longest(parts):
            found.append((told := " ".join(parts[:n]), *evaluate(told)))
    return found


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions."""
    words = text.encode("utf-8", "surrogatepass").translate(STREAM).split()
    stream = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    starts, base, labels, rest, tags = [], set(), set(), 1.0, []
    at = word = 0  # the last hit's start, and the words before it
    for end, (back, hits) in automaton().iter(stream):
        start = end - back
        word += stream.count(" ", at, start) if start >= at else -stream.count(" ", start, at)
        at = start
        for kind, label, weight in hits:
            if kind == "tag":
                tags.append((word, word + weight - 1))
                continue
            rest *= 1 - weight
            if kind == "base":
                starts.append(word)
                base.add(label)
            else:
                labels.add(label)
    told = []
    if tags:
        lowered = ascii_lower(text)
        placed = signed(lowered, tags)
        found = expressions(lowered, placed)
        rest *= (1 - TAG_WEIGHT) ** len(found) * (1 - BARE_TAG_WEIGHT) ** (len(placed) - len(found))
        for expression, licences, permissive in found:
            labels |= {family(x) for x in licences}
            told.append((expression, permissive))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 - rest, told)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<struct<expression: string, permissive: boolean>>"


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: base places, labels, score and evaluated expressions."""
    return map_texts(docs, lambda ids, texts: [ids, *zip(*map(scan, texts))], SCHEMA)
