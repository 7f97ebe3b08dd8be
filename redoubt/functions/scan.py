"""The Arrow scan: all rules over a batch of texts in one pass."""

from __future__ import annotations

import base64
import hashlib
import re

import regex

from . import checks
from .rules import HONORIFICS, NUMBER_WORDS, SPACE, STATES, VERIFIED, Rule

WINDOW, SUPPORT_CAP, SUPPRESS = 48, 0.30, 0.35

# Guards: cheap expressions one of which each text must hold for its rules to run; any other guard is a literal.
_GUARDS = {
    "digit": re.compile("[0-9]"),
    "upper": re.compile("A[KS]IA"),
    "host": re.compile(r"\.(?:internal|local|corp|lan|intranet|home)", re.I),
    "cloud": re.compile(r"s3:|gs:|amazonaws|windows\.net", re.I),
    "honorific": re.compile(rf"(?:{HONORIFICS})\.?\s"),
    "legal": re.compile(r"\s(?:Ltd|Limited|LLC|L\.L\.C|Inc|Corp|PLC|plc|LLP|GmbH|AG|S\.A|SARL|B\.V|N\.V|Pty|Pte|A/S|AB|Oy)"),
    "state": re.compile(rf",\s*(?:{STATES})\b"),
    "comma_place": re.compile(r",\s*(?:[A-Z]{1,2}[0-9]|[0-9]{4}|[A-Z][a-z]+\s+(?:Kingdom|States))"),
    "pairs": re.compile("[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"),
    "run24": re.compile("[A-Za-z0-9+/]{24}"),
    "run25": re.compile("[A-Za-z0-9]{25}"),
}
_LOWER_WORD = re.compile("[a-z]+")


def _spoken(low: str) -> bool:
    """Whether a text holds three number words at all."""
    return sum(w in NUMBER_WORDS for w in _LOWER_WORD.findall(low)) > 2


def translate(pattern: str) -> str:
    """The rule dialect for Python: \\s and [^\\S\\n] spelled out, in and outside classes."""
    pattern = pattern.replace(r"[^\S\n]", "[" + SPACE.replace("\\t-\\r", "\\t\\x0b-\\r") + "]")
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def compile_rule(rule: Rule):
    """Python's own engine where it can; the other where Unicode classes or look-behind of any length are asked for."""
    source = translate(rule.pattern)
    flags = re.M if "m" in rule.flags else 0
    if "u" not in rule.flags:
        try:
            return re.compile(source, flags | re.A | (re.I if "i" in rule.flags else 0))
        except re.error:
            pass
    wide = regex.V0 | (regex.M if "m" in rule.flags else 0) | (regex.I if "i" in rule.flags else 0)
    if "u" in rule.flags:  # only \p is Unicode; \d, \w and \b stay ASCII
        source = source.replace(r"\w", "A-Za-z0-9_") if r"[,\w]" in source or r"[\w/]" in source else source
        return regex.compile(source, wide)
    return regex.compile(source, wide | regex.A)


def finding_id(*parts, prefix: str = "f_") -> str:
    raw = hashlib.sha256(" ".join(map(str, parts)).encode()).digest()
    return prefix + base64.b32encode(raw)[:16].decode().lower()


def haystack(text: str, start: int, end: int, size: int = WINDOW) -> str:
    return re.sub(r"[_-]+", " ", (text[max(0, start - size) : start] + " " + text[end : end + size]).lower())


def has_term(term: str, hay: str) -> bool:
    """A single-word term must stand alone where it first occurs; a longer one may stand anywhere."""
    at = hay.find(term)
    if at < 0 or not (term.isascii() and term.isalnum()):
        return at >= 0
    around = hay[at - 1 : at] + hay[at + len(term) : at + len(term) + 1]
    return not any(c.isascii() and c.isalnum() for c in around)


def cues(terms: tuple[str, ...], hay: str) -> list[str]:
    return [t for t in terms if has_term(t, hay)]


def context(rule: Rule, text: str, start: int, end: int) -> tuple[float, list] | None:
    """The confidence gained and its evidence, or None if the rule needs a cue and has none."""
    hay = haystack(text, start, end) if rule.supports or rule.suppresses else ""
    near = {"support": cues(rule.supports, hay), "suppress": cues(rule.suppresses, hay)}
    if rule.require and not near["support"]:
        return None
    worth = {"support": min(SUPPORT_CAP, len(near["support"]) * rule.support_weight), "suppress": -SUPPRESS * len(near["suppress"])}
    evidence = [(f"context:{side}", "nearby: " + ", ".join(found[:3]), worth[side]) for side, found in near.items() if found]
    return sum(w for _, _, w in evidence), evidence


class Scanner:
    """All rules over one text after another.

    A rule runs only on texts that hold what it can't do without: its guard, one
    of its literals, and if it needs a cue, the words of one.  Rules of one
    expression share its matches.
    """

    def __init__(self, rules: list[Rule], least: float = 0.15):
        self.least = least
        self.groups: dict[tuple, list[int]] = {}
        for i, r in enumerate(rules):
            self.groups.setdefault((r.pattern, r.flags), []).append(i)
        self.rules = rules
        self.compiled = {key: compile_rule(rules[own[0]]) for key, own in self.groups.items()}
        self.checks = [checks.CHECKS[r.check] if isinstance(r.check, str) else r.check for r in rules]
        self.norms = [checks.NORMS[r.norm] if isinstance(r.norm, str) else r.norm for r in rules]
        # A cue may stand on both sides of the value, so each of its words is looked for alone.
        self.cues = [[t.split(" ") for t in r.supports] if r.require else None for r in rules]

    def _may_hold(self, text: str):
        """A test of rules, by number, for this text."""
        low = text.lower()
        plain = re.sub(r"[_-]+", " ", low)
        held: dict[str, bool] = {}

        def guard(g: str) -> bool:
            if g not in held:
                held[g] = _spoken(low) if g == "spoken" else bool(_GUARDS[g].search(text)) if g in _GUARDS else g in text
            return held[g]

        def test(i: int) -> bool:
            rule, words = self.rules[i], self.cues[i]
            if rule.needs and not any(x in low for x in rule.needs):
                return False
            return (not rule.guard or guard(rule.guard)) and (words is None or any(all(w in plain for w in term) for term in words))

        return test

    def scan(self, node_id: str, text: str) -> list[tuple]:
        """``(id, rule_id, type, start, end, value, normalized, confidence, evidence)`` in rule order."""
        found: dict[int, list[tuple]] = {}
        test = self._may_hold(text)
        for key, own in self.groups.items():
            live = [i for i in own if test(i)]
            for m in self.compiled[key].finditer(text) if live else ():
                for i in live:
                    if one := self._score(i, node_id, text, m):
                        found.setdefault(i, []).append(one)
        return [f for i in sorted(found) for f in found[i]]

    def _score(self, i: int, node_id: str, text: str, m) -> tuple | None:
        """The finding of a rule's match, None if it is too weak."""
        rule, value = self.rules[i], m[self.rules[i].group]
        if not value:
            return None
        # The place of a group is that of its text's first occurrence in the match.
        start = m.start() + (m[0].find(value) if rule.group else 0)
        end = start + len(value)
        confidence, evidence = rule.base, [(f"pattern:{rule.id}", rule.type, rule.base)]
        if self.checks[i]:
            gain = self.checks[i](value, m, rule.gain)
            if gain is None:
                return None
            confidence = min(VERIFIED, confidence + gain)
            evidence.append((f"check:{rule.check if isinstance(rule.check, str) else 'own'}", "valid", gain))
        scored = context(rule, text, start, end)
        if scored is None:
            return None
        confidence = min(1.0, max(0.0, confidence + scored[0]))
        if confidence < self.least:
            return None
        return finding_id(rule.id, node_id, start, value), f"pattern:{rule.id}", rule.type, start, end, value, self.norms[i](value), confidence, evidence + scored[1]
