"""Finding checkable tokens: every rule's matches, then a greedy choice among overlapping ones."""

from __future__ import annotations

from typing import NamedTuple

from .languages import RuleSet


class Token(NamedTuple):
    kind: str
    start: int
    end: int


def candidates(text: str, rules: RuleSet) -> list[tuple[int, int, int, str]]:
    """(start, -length, -rank, kind) of every capture that isn't blank or listed as no token."""
    out, plain = [], text.isascii()
    for needs, group in rules.by_need:
        if not needs.search(text):
            continue
        for rule in group:
            if (plain and rule.wide) or (rule.words and not rule.words.search(text)):
                continue
            for m in rule.regex.finditer(text):
                start, end = m.span(rule.group)
                if 0 <= start < end and text[start:end].strip() and text[start:end] not in rule.reject:
                    out.append((start, start - end, -rule.rank, rule.kind))
    return out


def extract(text: str, rules: RuleSet) -> list[Token]:
    """Non-overlapping tokens: earliest first, then longest, then the higher rank, then by kind."""
    out: list[Token] = []
    reach = 0
    for start, less, _, kind in sorted(candidates(text, rules)):
        if start >= reach:
            reach = start - less
            out.append(Token(kind, start, reach))
    return out
