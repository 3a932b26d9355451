"""Pieces of DuckDB SQL that say what the text kernel's columns say."""

from __future__ import annotations

from quillmere.functions import text as T

WS = r"[ \t\n\r\f]+"


def lst(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"


def fields(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}'), lambda w: w <> '')"


def n_words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[^ \t\n\r\f]+'))"


def tokens(n: str) -> str:
    return f"ceil(({n})::DOUBLE * 1.3::DOUBLE)::BIGINT"


def sentences(x: str) -> str:
    # a piece runs to a mark that is followed by space, break, tab or the end
    pieces = rf"regexp_extract_all({x}, '(?s)(?:[^.?!]|[.?!]+[^.?! \n\t])*(?:[.?!]+|$)')"
    return f"list_filter(list_transform({pieces}, lambda s: {trim('s')}), lambda s: s <> '')"


def no_specials(x: str) -> str:
    return f"translate({x}, '{T.SPECIALS}', '')"


def any_of(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


def count_of(x: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, '{p.replace(chr(39), chr(39) * 2)}')::INT" for p in phrases) + ")"


def distinct(x: str) -> str:
    """Order-preserving distinct."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def regex(p: str) -> str:
    """A pattern with ASCII word bounds for RE2: look-around becomes \\b, which is ASCII there."""
    return p.replace(T.B0, r"\b").replace(T.B1, r"\b")


def find_all(x: str, p: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{regex(p)}'), lambda s: {trim('s')})"


def matches(x: str, p: str) -> str:
    return f"regexp_matches({x}, '{regex(p)}')"


def rounded(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"
