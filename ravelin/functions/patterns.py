"""Rule patterns are written in the RE2 dialect; this maps them to Java patterns for ``rlike``.

A pattern RE2 does not accept never matches, so :func:`java_pattern` returns ``None`` for it.
"""

from __future__ import annotations

import re

# POSIX class names and their Java spelling.
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "ascii": r"\p{ASCII}",
    "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}",
    "graph": r"\p{Graph}",
    "lower": r"\p{Lower}",
    "print": r"\p{Print}",
    "punct": r"\p{Punct}",
    "space": r"\p{Space}",
    "upper": r"\p{Upper}",
    "word": r"\w",
    "xdigit": r"\p{XDigit}",
}
_MAX_REPEAT = 1000
_FLAGS = re.compile(r"\(\?([imsU]*(?:-[imsU]+)?)([:)])")
_REPEAT = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")


def _bracket(pattern: str, start: int) -> tuple[str, int] | None:
    """A character class from ``[`` on: its Java form and the position after it."""
    out, i = "[", start + 1
    if pattern[i : i + 1] == "^":
        out, i = out + "^", i + 1
    first = True
    while i < len(pattern):
        char = pattern[i]
        if char == "]" and not first:
            return out + "]", i + 1
        first = False
        posix = _POSIX.match(pattern, i)
        if posix:
            if posix[2] not in POSIX_CLASSES:
                return None
            named = POSIX_CLASSES[posix[2]]
            out += f"[^{named}]" if posix[1] else named
            i = posix.end()
        elif char == "\\":
            if i + 1 >= len(pattern):
                return None
            out += pattern[i : i + 2]
            i += 2
        else:
            out += "\\" + char if char in "[]&" else char
            i += 1
    return None


def java_pattern(pattern: str) -> str | None:
    """The equivalent Java pattern, or ``None`` when RE2 would reject it."""
    out: list[str] = []
    i, repeatable, multiline = 0, False, False
    while i < len(pattern):
        char = pattern[i]
        rest = pattern[i:]
        if char == "\\":
            following = rest[1:2]
            if not following or following in "123456789GXRZkhHN" or (following.isalpha() and following in "ceijlmoquyEIJKLMOUVY"):
                return None
            if following == "Q":
                end = pattern.find("\\E", i + 2)
                quoted = pattern[i + 2 : end if end >= 0 else len(pattern)]
                out.append(re.sub(r"([^\w\s])", r"\\\1", quoted))
                i = end + 2 if end >= 0 else len(pattern)
            elif following in "pP" and rest[2:3] == "{":
                end = pattern.find("}", i)
                if end < 0:
                    return None
                name = pattern[i + 3 : end]
                negated = name.startswith("^")
                name = name.lstrip("^")
                kind = "P" if (following == "P") != negated else "p"
                out.append(rf"\{kind}{{{name if len(name) < 3 else 'Is' + name}}}")
                i = end + 1
            elif following in "pP":
                out.append(pattern[i : i + 3])
                i += 3
            else:
                out.append(rest[:2])
                i += 2
            repeatable = True
        elif char == "[":
            bracket = _bracket(pattern, i)
            if bracket is None:
                return None
            out.append(bracket[0])
            i, repeatable = bracket[1], True
        elif char == "(":
            named = re.match(r"\(\?P?<([A-Za-z_]\w*)>", rest)
            flags = _FLAGS.match(rest)
            if named:
                out.append("(")
                i += named.end()
            elif flags:
                if "U" in flags[1]:
                    return None
                on = flags[1].split("-")[0]
                multiline = multiline or "m" in on
                out.append(flags[0])
                i += flags.end()
            elif rest.startswith("(?"):
                return None
            else:
                out.append("(")
                i += 1
            repeatable = False
        elif char == "$":
            out.append("$" if multiline else r"\z")
            i, repeatable = i + 1, True
        elif char in "*+?" or (char == "{" and _REPEAT.match(rest)):
            if not repeatable:
                return None
            counted = _REPEAT.match(rest) if char == "{" else None
            if counted:
                bounds = [int(b) for b in counted.groups() if b]
                if max(bounds) > _MAX_REPEAT or (len(bounds) == 2 and bounds[0] > bounds[1]):
                    return None
            token = counted[0] if counted else char
            i += len(token)
            if pattern[i : i + 1] == "?":
                token, i = token + "?", i + 1
            out.append(token)
            repeatable = False
        else:
            out.append("\\" + char if char in "{}" else char)
            i += 1
            repeatable = char != "|"
    text = "".join(out)
    try:
        re.compile(re.sub(r"\\[pP](?:\{\w+\}|\w)", r"\\w", pattern_for_check(text)))
    except re.error:
        return None
    return "(?d)" + text


def pattern_for_check(text: str) -> str:
    """Java-only spellings replaced, so that Python can check brackets and ranges."""
    return re.sub(r"\(\?[ims]*-?[ims]*\)", "", text.replace(r"\z", r"\Z").replace(r"[^\w]", r"\W"))
