"""Pieces of SQL for the engine that checks results; its patterns know neither Unicode classes nor look-ahead."""

from __future__ import annotations

import re

WS = r"[\t\n\x0b\f\r \x{85}\p{Z}]"
NOT_WS = r"[^\t\n\x0b\f\r \x{85}\p{Z}]"
NOT_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]"


def re2(pattern: str) -> str:
    """``pattern`` with Unicode classes spelled out and boundaries as characters; for tests of occurrence."""
    out = pattern.replace(r"(?=[^a-zA-Z]|$)", r"(?:[^a-zA-Z]|$)")
    out = re.sub(r"\\b(?=\||\)|$)", lambda _: f"(?:{NOT_WORD}|$)", out)
    out = out.replace(r"\b", f"(?:^|{NOT_WORD})")
    return out.replace(r"\s", WS).replace(r"\S", NOT_WS).replace(r"\d", r"\p{Nd}")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column: str, pattern: str, dotall: bool = False) -> str:
    return f"coalesce(regexp_matches({column}, {lit(re2(pattern))}, {lit('is' if dotall else 'i')}), false)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"
