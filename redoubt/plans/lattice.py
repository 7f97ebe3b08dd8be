"""The marking lattice: join, domination, order, markings as text.

Assertions are ``(level id, {group id: tuple of value ids})``.  These run on the
driver or inside a task for the few declared markings; derived markings of a
corpus are aggregated by ``operators.classify`` in DataFrame operations.
"""

from __future__ import annotations

import re

from .policies import Group, Policy

Assertion = tuple[str, dict[str, tuple[str, ...]]]


def unit(policy: Policy) -> Assertion:
    return policy.bottom.id, {}


def _ordered(group: Group, ids: set[str]) -> tuple[str, ...]:
    return tuple(v.id for v in group.values if v.id in ids)


def expand(group: Group, ids) -> set[str]:
    by = {v.id: v.expands for v in group.values}
    return {m for i in ids for m in (by.get(i) or (i,))}


def collapse(group: Group, ids: set[str]) -> set[str]:
    left = set(ids)
    for v in group.values:
        if v.expands and set(v.expands) <= left:
            left = left - set(v.expands) | {v.id}
    return left


def _combine(group: Group, a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    if group.union:
        return _ordered(group, {*a, *b})
    if not a and not b:
        return ()
    both = collapse(group, expand(group, a or group.defaults) & expand(group, b or group.defaults))
    return () if group.defaults and both == set(group.defaults) else _ordered(group, both)


def dominate(policy: Policy, assertion: Assertion) -> Assertion:
    level, marks = assertion
    gone = {d for ids in marks.values() for i in ids for d in policy.value(i).dominates}
    kept = {g: tuple(i for i in ids if i not in gone) for g, ids in marks.items()}
    return level, {g: ids for g, ids in kept.items() if ids}


def join(policy: Policy, a: Assertion, b: Assertion) -> Assertion:
    level = max((a[0], b[0]), key=lambda x: policy.level(x).rank)
    marks = {g.id: _combine(g, a[1].get(g.id, ()), b[1].get(g.id, ())) for g in policy.groups}
    return dominate(policy, (level, {g: ids for g, ids in marks.items() if ids}))


def join_all(policy: Policy, assertions, mode: str = "parity") -> Assertion:
    """``parity`` folds from the unit, so an intersection group falls back to its
    defaults; ``narrowing`` folds from the first assertion and keeps what all share."""
    rest = list(assertions)
    out = rest.pop(0) if mode == "narrowing" and rest else unit(policy)
    for x in rest:
        out = join(policy, out, x)
    return out


def dominated_by(policy: Policy, a: Assertion, b: Assertion) -> bool:
    """Whether b restricts at least as much as a; of permissions, fewer restrict more and none is the defaults' restriction."""
    if policy.level(a[0]).rank > policy.level(b[0]).rank:
        return False
    for g in policy.groups:
        x, y = set(a[1].get(g.id, ())), set(b[1].get(g.id, ()))
        if g.union and not x <= y:
            return False
        if not g.union and y and x and not expand(g, y) <= expand(g, x) or not g.union and y and not x:
            return False
    return True


def equal(policy: Policy, a: Assertion, b: Assertion) -> bool:
    return dominated_by(policy, a, b) and dominated_by(policy, b, a)


def prune(policy: Policy, assertion: Assertion) -> tuple[Assertion, list[str]]:
    level, marks = assertion
    rank = policy.level(level).rank
    bad = [i for ids in marks.values() for i in ids if (m := policy.value(i).minimum) and policy.level(m).rank > rank]
    kept = {g: tuple(i for i in ids if i not in bad) for g, ids in marks.items()}
    return (level, {g: ids for g, ids in kept.items() if ids}), bad


def render(policy: Policy, assertion: Assertion, style: str = "banner") -> str:
    full = style == "banner"
    level = policy.level(assertion[0])
    parts = [level.name if full else level.short]
    for g in policy.groups:
        ids = assertion[1].get(g.id, ())
        if ids:
            parts.append(g.prefix + g.separator.join(policy.value(i).name if full else policy.value(i).short for i in ids) + g.suffix)
    body = policy.separator.join(parts)
    body = body.upper() if policy.uppercase else body
    return body if full else policy.delimiters[0] + body + policy.delimiters[1]


_SPLIT = re.compile(r"[\s/,;()\[\]]")


def _token(text: str) -> str:
    return re.sub(r"\s+", " ", text.upper()).strip()


def _lexicon(policy: Policy) -> list[tuple[str, str, str, str]]:
    out = [(_token(t), "level", x.id, "") for x in policy.levels for t in {x.name, x.short}]
    for g in policy.groups:
        out += [(_token(t), "value", v.id, g.id) for v in g.values for t in {v.name, v.short}]
        out += [(_token(t), "affix", g.id, "") for t in (g.prefix, g.suffix) if _token(t)]
    return sorted(out, key=lambda x: (-len(x[0]), x[0]))


def parse(policy: Policy, text: str) -> tuple[Assertion, list[str], bool]:
    """``(assertion, segments that aren't understood, whether a level was named)``: longest lexeme first, the highest level stays."""
    a, z = policy.delimiters
    text = text.strip()
    if text.startswith(a) and text.endswith(z):
        text = text[len(a) : len(text) - len(z)]
    text, lexicon = _token(text), _lexicon(policy)
    level, named, found, unknown, at = policy.bottom.id, False, {}, [], 0
    while at < len(text):
        if _SPLIT.match(text[at]):
            at += 1
            continue
        for token, kind, key, group in lexicon:
            end = at + len(token)
            if text.startswith(token, at) and (end >= len(text) or _SPLIT.match(text[end])):
                if kind == "level":
                    level = key if not named or policy.level(key).rank > policy.level(level).rank else level
                    named = True
                elif kind == "value":
                    found.setdefault(group, set()).add(key)
                at = end
                break
        else:
            stop = _SPLIT.search(text, at)
            end = stop.start() if stop else len(text)
            unknown.append(text[at:end])
            at = end
    marks = {g.id: _ordered(g, found[g.id]) for g in policy.groups if found.get(g.id)}
    return dominate(policy, (level, marks)), unknown, named


def compare(policy: Policy, declared: Assertion, derived: Assertion) -> dict:
    d, r = policy.level(declared[0]), policy.level(derived[0])
    missing, unsupported = [r.name] if r.rank > d.rank else [], [d.name] if d.rank > r.rank else []
    for g in policy.groups:
        x, y = declared[1].get(g.id, ()), derived[1].get(g.id, ())
        missing += [policy.value(i).name for i in y if i not in x]
        unsupported += [policy.value(i).name for i in x if i not in y]
    return {"under_marked": not dominated_by(policy, derived, declared), "over_marked": not dominated_by(policy, declared, derived), "missing": missing, "unsupported": unsupported}
