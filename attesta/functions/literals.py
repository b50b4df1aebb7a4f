"""What every match of a pattern has to hold, so that patterns meet only the texts that can match."""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser
from collections.abc import Iterable


#: Letters that other characters than their capitals stand for where case doesn't count (dotless i, Kelvin, long s).
_AMBIGUOUS = "iks"


def required(pattern: str, any_case: bool = False) -> frozenset[str] | None:
    """Literals of which each match of the pattern holds one at least; None if there are none such, or it can't be read.

    With any_case, or where the pattern says so itself, they stand in the text's lower case.
    """
    try:
        tree = _parser.parse(pattern)
    except re.error:
        return None
    return _required(tree, any_case or bool(tree.state.flags & re.IGNORECASE))


def _letter(c: str, any_case: bool) -> str | None:
    """c as it stands in a text that it matches (in its lower case, with any_case), if that is one character."""
    if not any_case or c.lower() == c.upper():
        return c
    return c.lower() if c.isascii() and c.lower() not in _AMBIGUOUS else None


def _required(items, any_case: bool) -> frozenset[str] | None:
    found, run = [], ""
    for kind, value in [*items, (None, None)]:
        if kind is op.LITERAL and (c := _letter(chr(value), any_case)):
            run += c
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if kind is op.SUBPATTERN and not value[1]:
            found.append(_required(value[3], any_case))
        elif kind is op.ATOMIC_GROUP:
            found.append(_required(value, any_case))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            found.append(_required(value[2], any_case))
        elif kind is op.BRANCH:
            each = [_required(b, any_case) for b in value[1]]
            found.append(frozenset().union(*each) if all(each) else None)
    some = [f for f in found if f]
    return max(some, key=lambda f: (min(map(len, f)), -len(f))) if some else None


def trie(words: Iterable[str]) -> str:
    """A pattern that finds a text with one of the words; common beginnings stand once, so each character is looked at by few branches."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if not w:
            return ""
        heads.setdefault(w[0], []).append(w[1:])
    parts = [(c, re.escape(c) + (trie(tails) if "" not in tails else "")) for c, tails in sorted(heads.items())]
    step = 8 if len(parts) > 16 else len(parts)  # of many beginnings a character is first compared with ranges
    groups = [parts[k : k + step] for k in range(0, len(parts), step)]
    either = lambda ps: ps[0] if len(ps) == 1 else f"(?:{'|'.join(ps)})"
    within = lambda g: f"(?=[{re.escape(g[0][0])}-{re.escape(g[-1][0])}])" if len(groups) > 1 else ""
    return either([within(g) + either([p for _, p in g]) for g in groups])
