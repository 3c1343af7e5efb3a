"""Literals that every match of a pattern holds, derived from the pattern, so that most texts are told clean by substring tests alone."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser  # type: ignore[attr-defined]

#: Strings that a run of characters is spelled out into, at most.
MOST_STRINGS = 600

Sets = list[frozenset[str]]


_DIGIT = re.compile(r"(?![0-9])\d")


def fold(text: str) -> str:
    """``text`` in lower case, with the letters that patterns without case take for i and s, and all digits as ASCII digits."""
    if text.isascii():
        return text.lower()
    return _DIGIT.sub(lambda m: str(int(m.group())), text).replace("İ", "i").replace("ı", "i").replace("ſ", "s").lower()


def _exact(items) -> set[str] | None:
    """All strings that a part of a pattern matches, if they are few."""
    out = {""}
    for op, av in items:
        if op is C.LITERAL:
            more = {fold(chr(av))}
        elif op is C.IN and all(o is C.LITERAL for o, _ in av):
            more = {fold(chr(a)) for _, a in av}
        elif op is C.IN and av == [(C.CATEGORY, C.CATEGORY_DIGIT)]:
            more = set("0123456789")
        elif op is C.SUBPATTERN:
            more = _exact(av[3])
        elif op is C.BRANCH:
            parts = [_exact(b) for b in av[1]]
            more = None if None in parts else set().union(*parts)  # type: ignore[arg-type]
        elif op is C.MAX_REPEAT and tuple(av[:2]) == (0, 1):
            inner = _exact(av[2])
            more = None if inner is None else inner | {""}
        elif op is C.AT:
            continue
        else:
            return None
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _weight(strings: frozenset[str]) -> tuple[int, int]:
    return min(map(len, strings)), -len(strings)


def _sets(items) -> Sets:
    """Sets of literals; every match of the part holds one of each set. Literals have no spaces: what is quoted is read as a space."""
    out: Sets = []
    runs = {""}

    def flush(then: frozenset[str] = frozenset({""})) -> None:
        nonlocal runs
        if len(runs) == 1:
            out.extend(frozenset({w}) for w in next(iter(runs)).split())
        else:
            words = {max(r.split(), key=len, default="") for r in runs}
            if "" not in words:
                out.append(frozenset(w for w in words if not any(o != w and o in w for o in words)))
        runs = set(then)

    for item in items:
        op, av = item
        if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        more = _exact([item])
        if more is not None and len(runs) * len(more) <= MOST_STRINGS:
            runs = {a + b for a in runs for b in more}
        elif op is C.MAX_REPEAT and av[0] > 0 and (inner := _exact(av[2])) is not None and len(inner) == 1:
            times = inner.pop() * av[0]
            runs = {r + times for r in runs}
            flush(frozenset({times}))
        else:
            flush()
            if op is C.SUBPATTERN:
                out += _sets(av[3])
            elif op is C.MAX_REPEAT and av[0] > 0:
                out += _sets(av[2])
            elif op is C.BRANCH and all(parts := [_sets(b) for b in av[1]]):
                out.append(frozenset().union(*(max(p, key=_weight) for p in parts)))
    flush()
    return out


def alternatives(items) -> list[Sets]:
    """The sets of each alternative of a parsed pattern."""
    solid = [i for i in items if i[0] not in (C.AT, C.ASSERT, C.ASSERT_NOT)]
    if len(solid) == 1 and solid[0][0] is C.SUBPATTERN:
        return alternatives(solid[0][1][3])
    if len(solid) == 1 and solid[0][0] is C.BRANCH:
        return [a for b in solid[0][1][1] for a in alternatives(b)]
    return [_sets(items)]


class Cues:
    """Tells whether a folded text may hold a match of some patterns; true wherever there is one."""

    def __init__(self, *patterns: re.Pattern[str]) -> None:
        alone: set[str] = set()
        self.joint: list[Sets] = []
        for rx in patterns:
            for sets in alternatives(_parser.parse(rx.pattern, rx.flags)):
                if not sets:
                    raise ValueError(f"an alternative without a literal in {rx.pattern[:80]}")
                sets = sorted(set(sets), key=len)
                if len(sets) == 1 and len(sets[0]) == 1:
                    alone |= sets[0]
                    continue
                marks = [frozenset(next((c for c in s if not c.isalnum()), s[0]) for s in strings) for strings in sets]
                # the few marks of many strings are looked for first
                self.joint.append([m for m, strings in zip(marks, sets) if 4 * len(m) < len(strings)] + sets)
        self.alone = tuple(sorted(alone))

    def near(self, low: str) -> bool:
        for c in self.alone:
            if c in low:
                return True
        for sets in self.joint:
            for strings in sets:
                for c in strings:
                    if c in low:
                        break
                else:
                    break
            else:
                return True
        return False
