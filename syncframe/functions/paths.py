"""Paths, patterns over them and names derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART, META = ".fs-part-", ".fs-meta-"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def components(path: Column) -> Column:
    return F.split(path, "/")


def depth(path: Column) -> Column:
    return F.size(components(path)).cast("long")


def base_name(path: Column) -> Column:
    return F.element_at(components(path), -1)


def prefixes(path: Column) -> Column:
    """Every leading path, the path itself last."""
    parts = components(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def ancestors(path: Column) -> Column:
    """The proper ancestors, the topmost first."""
    every = prefixes(path)
    return F.slice(every, F.lit(1), F.size(every) - 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def glob_to_regex(pattern: str) -> str | None:
    """An anchored regular expression for a shell pattern, or None for a malformed one.

    ``*`` and ``?`` do not cross ``/``, ``[...]`` is a class (``^`` negates), ``\\`` escapes."""
    out, i = "", 0
    quote = lambda c: c if c.isalnum() or c in "_/ -" else "\\" + c if ord(c) < 128 else c
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out += quote(pattern[i])
        elif c == "[":
            i += 1
            negated = i < len(pattern) and pattern[i] == "^"
            i += negated
            items, closed = "", False
            while i < len(pattern):
                if pattern[i] == "]" and items:
                    closed = True
                    break
                ends = []
                for _ in range(2):
                    if pattern[i : i + 1] == "\\":
                        i += 1
                    if i >= len(pattern) or (pattern[i] in "-]" and pattern[i - 1 : i] != "\\"):
                        return None
                    ends.append(pattern[i])
                    i += 1
                    if pattern[i : i + 1] != "-":
                        break
                    if len(ends) == 1:
                        i += 1
                if len(ends) == 2 and ends[0] > ends[1]:
                    return None
                items += "-".join("\\" + e if not e.isalnum() else e for e in ends)
            if not closed:
                return None
            out += f"[{'^' if negated else ''}{items}]"
        else:
            out += quote(c)
        i += 1
    return f"^(?:{out})$"


def segments_regex(pattern: str) -> str | None:
    """Like ``glob_to_regex`` with a segment ``**`` that stands for any number of segments, also none."""
    parts = pattern.strip("/").split("/")
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += "(?:[^/]+/)*[^/]+" if last else "(?:[^/]+/)*"
        else:
            regex = glob_to_regex(part)
            if regex is None:
                return None
            out += regex[1:-1] + ("" if last else "/")
    return f"^{out}$"


def _any_part(path: Column, regex: str) -> Column:
    return F.exists(components(path), lambda part: part.rlike(regex))


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches: with a ``/`` the whole path, without it any component."""
    found = F.lit(False)
    for pattern in patterns:
        regex = glob_to_regex(pattern)
        if regex is not None:
            found = found | (path.rlike(regex) if "/" in pattern else _any_part(path, regex))
    return found


def matches_or_below(path: Column, patterns: list[str]) -> Column:
    """Whether the path or one of its ancestors is matched, so that a match prunes a subtree."""
    found = F.lit(False)
    for pattern in patterns:
        regex = glob_to_regex(pattern)
        if regex is not None and "/" in pattern:
            found = found | path.rlike(f"{regex[:-1]}(?:/|$)")
        elif regex is not None:
            found = found | _any_part(path, regex)
    return found


def path_reason(path: Column) -> Column:
    """Why a relative path is not acceptable; null if it is."""
    parts = components(path)
    return (
        F.when(path.isNull() | (path == ""), "empty").when(path == ".", F.lit(None))
        .when(F.octet_length(path) > 4096, "too long").when(F.instr(path, "\0") > 0, "nul byte")
        .when(path.startswith("/"), "absolute")
        .when(F.exists(parts, lambda p: p.isin("", ".", "..")), "component")
        .when(F.exists(parts, lambda p: F.octet_length(p) > 255), "component too long")
    )


def hidden(path: Column, markers: tuple[str, ...] = (PART, META)) -> Column:
    """Whether a component starts with a dot or holds a marker of unfinished transfers."""
    found = F.exists(components(path), lambda p: p.startswith("."))
    for marker in markers:
        found = found | F.contains(path, F.lit(marker))
    return found


def is_resume_state(path: Column, markers: tuple[str, ...] = (PART, META)) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(base_name(path), F.lit(marker))
    return found


def part_path(final: Column, nonce: Column, marker: str = PART) -> Column:
    return F.concat(final, F.lit(marker), nonce)


def meta_path(final: Column, nonce: Column) -> Column:
    return F.concat(final, F.lit(META), nonce, F.lit(".json"))


def part_final(path: Column, marker: str = PART) -> Column:
    """The final path of a part file, by its last marker; null if it has none."""
    return F.nullif(F.regexp_extract(path, f"^(.*){marker.replace('.', '[.]')}[^/]*$", 1), F.lit(""))


def part_nonce(path: Column, marker: str = PART) -> Column:
    return F.nullif(F.regexp_extract(path, f"^.*{marker.replace('.', '[.]')}([^/]*)$", 1), F.lit(""))


def has_control(text: Column) -> Column:
    """C0 controls and DEL."""
    return text.rlike(r"[\x00-\x1f\x7f]")


def host_of(address: Column) -> Column:
    return F.regexp_extract(address, r"^\[?([^\]]*?)\]?(?::([0-9]+))?$", 1)


def port_of(address: Column, default: int) -> Column:
    return F.coalesce(F.regexp_extract(address, r":([0-9]+)$", 1).try_cast("int"), F.lit(default))
