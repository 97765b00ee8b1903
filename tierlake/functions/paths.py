"""Paths, links and globs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_path(path: Column) -> Column:
    """Leading slash, no trailing or doubled slash; empty becomes the root."""
    single = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(path, F.lit(""))), "/+", "/")
    return F.when(single == "/", single).otherwise(F.regexp_replace(single, "/$", ""))


def clean_path(path: str) -> str:
    """The same on the driver, for a path given as an argument."""
    return "/" + "/".join(part for part in path.split("/") if part)


def parent_path(path: Column) -> Column:
    """Directory that holds a path; NULL for the root."""
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path == "/", F.lit(None).cast("string")).when(up == "", F.lit("/")).otherwise(up)


def last_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column) -> Column:
    """All directories above a path, from the first level down, without the root."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))


def prefixes(text: Column, separator: str) -> Column:
    """Every prefix of a separated name, the name itself last."""
    parts = F.split(text, "[" + separator + "]")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator),
    )


def below(path: Column, parent: str) -> Column:
    """Path strictly under a parent; the prefix is literal."""
    return (path != "/") if parent == "/" else F.startswith(path, F.lit(parent + "/"))


def link_type(ref: Column) -> Column:
    target_part = F.substr(ref, F.lit(8))
    return (
        F.when(F.startswith(ref, F.lit("target:")) & (target_part != ""), F.lit("target"))
        .when(ref.rlike("^poller:[^/]+/.+$"), F.lit("poller"))
    )


def link_target(ref: Column) -> Column:
    rest = F.substr(ref, F.lit(8))
    return F.when(link_type(ref) == "target", rest).when(
        link_type(ref) == "poller", F.substring_index(rest, "/", 1)
    )


def link_poller(ref: Column) -> Column:
    return F.when(link_type(ref) == "poller", F.regexp_replace(ref, "^poller:[^/]+/", ""))


# A regular expression that matches no text.
NOTHING = "(?!)"


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell glob; wildcards stop at a slash.

    A backslash makes the next character a plain one, also inside brackets.
    A pattern with an open bracket, or a backslash at its end, matches nothing.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            found = _glob_class(pattern, i)
            if found is None:
                return NOTHING
            text, i = found
            out.append(text)
        elif c == "\\":
            if i == len(pattern):
                return NOTHING
            out.append(_plain(pattern[i]))
            i += 1
        else:
            out.append(_plain(c))
    return "^" + "".join(out) + "$"


def _plain(c: str) -> str:
    return c if c.isalnum() or c in "_/ " else "\\" + c


def _glob_class(pattern: str, i: int) -> tuple[str, int] | None:
    """The bracket that opened before place i as a character class, and the place after it; None if it stays open."""
    out = ["["]
    if pattern[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = i
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and i > first:
            return "".join(out) + "]", i + 1
        if c == "\\":
            i += 1
            c = pattern[i : i + 1]
            if not c:
                return None
            out.append(_plain(c))
        else:
            out.append(c if c == "-" else _plain(c))
        i += 1
    return None


def glob_match(value: Column, pattern: str) -> Column:
    """Glob match; a pattern without * or ? is plain equality."""
    if "*" not in pattern and "?" not in pattern:
        return value == F.lit(pattern)
    return value.rlike(glob_regex(pattern))
