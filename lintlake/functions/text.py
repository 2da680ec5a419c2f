"""Text patterns with one meaning in Spark (Java) and in the oracle (RE2).

Patterns are written as in ECMAScript: ``\\w`` and ``\\b`` are ASCII, ``\\s`` has all Unicode white
space, ``.`` stops at line ends, ``$`` is the very end of the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, for use inside a class.
SPACE = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_LINE = r"[^\n\r\x{2028}\x{2029}]"
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def _translate(pattern: str, boundary: str) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            d = pattern[i + 1]
            if d == "s":
                out.append(SPACE if inside else f"[{SPACE}]")
            elif d == "S" and not inside:
                out.append(f"[^{SPACE}]")
            elif d == "b" and not inside:
                out.append(boundary)
            else:
                out.append(c + d)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "." and not inside:
            c = _LINE
        elif c == "$" and not inside:
            c = r"\z"
        out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str) -> str:
    return _translate(pattern, _BOUNDARY)


def java_lines(pattern: str) -> str:
    """A pattern in which ``^`` and ``$`` (but for ``[\\w$]``) stand at every line's ends: ASCII words and Java's own meaning otherwise."""
    return pattern.replace(r"\b", _BOUNDARY)


def re2(pattern: str) -> str:
    return _translate(pattern, r"\b")


def needed(pattern: str) -> list[str]:
    """The two longest texts that each match of ``pattern`` holds, of those outside groups; none if none is sure."""
    if pattern.startswith("(?i)"):
        return []
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c, literal = pattern[i], ""
        i += 1
        if c == "\\":
            literal = "" if pattern[i].isalnum() else pattern[i]
            i += 1
        elif c == "[":
            i += pattern[i] in "^]"
            while pattern[i] != "]":
                i += 1 + (pattern[i] == "\\")
            i += 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return []
        elif c == "{":
            i = pattern.index("}", i) + 1
        elif c not in "^$.|*+?":
            literal = c
        if depth or not literal:
            runs, run = [*runs, run], ""
        elif pattern[i : i + 1] in ("*", "?", "{"):
            runs, run = [*runs, run], ""
        else:
            run += literal
    return sorted({r for r in [*runs, run] if r}, key=lambda r: (-len(r), r))[:2]


def may_match(text: Column, pattern: str) -> Column:
    """False only where the pattern can't match: what each match must hold is looked for."""
    return reduce(Column.__and__, [F.contains(text, F.lit(part)) for part in needed(pattern)], F.lit(True))


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern matches; only texts that may_match() are searched, since most lines don't and a search for a fixed text is cheap."""
    found = text.rlike(java(pattern))
    return may_match(text, pattern) & found if needed(pattern) else found


def position(text: Column, pattern: str) -> Column:
    """Place of the first match, from 1; 0 if there is none."""
    at = F.regexp_instr(text, F.lit(java(pattern)))
    return F.when(~may_match(text, pattern), 0).otherwise(at) if needed(pattern) else at


def group(text: Column, pattern: str, n: int = 1) -> Column:
    return F.regexp_extract(text, java(pattern), n)


#: The characters of SPACE.
_SPACES = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(_SPACES))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def quote(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quote(re2(pattern))})"


def sql_position(text: str, pattern: str) -> str:
    flags = ""
    if pattern.startswith("(?i)"):
        flags, pattern = "(?i)", pattern[4:]
    return f"(length(regexp_extract({text}, {quote(f'(?s){flags}^(.*?)(?:{re2(pattern)})')}, 1)) + 1)"


def sql_group(text: str, pattern: str, n: int = 1) -> str:
    return f"regexp_extract({text}, {quote(re2(pattern))}, {n})"


def sql_trim_start(text: str) -> str:
    return f"regexp_replace({text}, {quote(f'^[{SPACE}]+')}, '')"


def sql_trim(text: str) -> str:
    return f"regexp_replace({text}, {quote(rf'^[{SPACE}]+|[{SPACE}]+\z')}, '', 'g')"


def sql_count_of(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, {quote(part)}, ''))) // {len(part)})"
