"""Patterns of matchers: their dialect has no look-around, no back references and no possessive repetition.

java_pattern() turns one into a Java pattern that matches whole values, and rejects what the dialect lacks; finite_set()
gives the strings that a pattern accepts if they are few.
"""

from __future__ import annotations

import re
import warnings
from functools import lru_cache

#: Most strings that a pattern is expanded to.
MOST_LITERALS = 256
_SPACE = r"\t\n\f\r "
#: Escapes that mean another thing to Java.
_ESCAPES = {"s": f"[{_SPACE}]", "S": f"[^{_SPACE}]", "v": r"\x0B", "a": r"\x07"}
_CLASS_ESCAPES = {"s": _SPACE, "v": r"\x0B", "a": r"\x07"}
_ALLOWED = set("dDwWsSbBAzQEpPxtnfrva") | set("0")
_POSIX = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r ", "punct": r"!-/:-@\[-`{-~", "word": r"0-9A-Za-z_", "xdigit": "0-9A-Fa-f", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "print": " -~", "graph": "!-~", "ascii": r"\x00-\x7F"}


@lru_cache(4096)
def java_pattern(pattern: str) -> str:
    """ValueError if the pattern isn't of the dialect."""
    out, i, n, depth, quoted, repeat = [], 0, len(pattern), 0, False, False
    while i < n:
        c, was_repeat = pattern[i], repeat
        repeat = False
        if quoted:
            if pattern.startswith(r"\E", i):
                quoted = False
                i += 2
                continue
            out.append(re.escape(c) if not c.isalnum() else c)
        elif c == "\\":
            if i + 1 >= n:
                raise ValueError("trailing backslash at end of pattern")
            e = pattern[i + 1]
            i += 1
            if e == "Q":
                quoted = True
            elif e in _ESCAPES:
                out.append(_ESCAPES[e])
            elif e.isalnum() and e not in _ALLOWED or e.isdigit() and e != "0":
                raise ValueError(f"invalid escape sequence \\{e}")
            else:
                out.append("\\" + e)
                if e in "pPx" and i + 1 < n and pattern[i + 1] == "{":
                    end = pattern.find("}", i)
                    if end < 0:
                        raise ValueError("missing closing }")
                    out.append(pattern[i + 1 : end + 1])
                    i = end
        elif c == "[":
            text, i = _character_class(pattern, i)
            out.append(text)
        elif c == "(":
            depth += 1
            if pattern.startswith("(?", i):
                rest = pattern[i + 2 :]
                if m := re.match(r"P?<([A-Za-z_]\w*)>", rest):
                    out.append(f"(?<{m[1].replace('_', 'U')}>")
                    i += 1 + m.end()
                elif m := re.match(r"([ims]*(?:-[ims]+)?)([:)])", rest):
                    out.append(f"(?{m[0]}")
                    i += 1 + m.end()
                    depth -= m[2] == ")"
                else:
                    raise ValueError("invalid or unsupported Perl syntax")
            else:
                out.append("(")
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise ValueError("unexpected )")
            out.append(c)
        elif c in "*+?" or c == "{" and re.match(r"\{\d+(,\d*)?\}", pattern[i:]):
            if was_repeat and c != "?" or was_repeat == 2:
                raise ValueError("invalid nested repetition operator")
            if not out or out[-1] in ("(", "|") and not was_repeat:
                raise ValueError("missing argument to repetition operator")
            repeat = 2 if was_repeat else 1
            if c == "{":
                end = pattern.index("}", i)
                out.append(pattern[i : end + 1])
                i = end
            else:
                out.append(c)
        elif c == "{":
            out.append(r"\{")
        elif c == "$":
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    if depth:
        raise ValueError("missing closing )")
    text = "".join(out)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(re.sub(r"\\[pP](\{[^}]*\}|.)", "x", text).replace(r"\z", r"\Z").replace("(?<", "(?P<"))
    except re.error as e:
        raise ValueError(str(e)) from None
    return rf"(?d)\A(?:{text})\z"


def _character_class(pattern: str, i: int) -> tuple[str, int]:
    """A bracketed class from place i, and the place of its end."""
    begin = i
    out, i = "[", i + 1
    if pattern[i : i + 1] == "^":
        out, i = out + "^", i + 1
    first = True
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and not first:
            return out + "]", i
        first = False
        if m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:]):
            if m[2] not in _POSIX:
                raise ValueError(f"invalid character class range: {m[0]}")
            out += f"[^{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]]
            i += m.end()
            continue
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            if e.isalnum() and (e not in _ALLOWED or e in "bBAzQE"):
                raise ValueError(f"invalid escape sequence \\{e}")
            out += _CLASS_ESCAPES.get(e, f"[^{_SPACE}]" if e == "S" else "\\" + e)
            i += 2
            continue
        out += "\\" + c if c in "[]&" else c
        i += 1
    raise ValueError(f"missing closing ]: {pattern[begin:]}")


@lru_cache(4096)
def finite_set(pattern: str) -> frozenset[str] | None:
    """All strings that a pattern accepts, if it is made of literals, groups, alternatives and small classes; else None."""
    java_pattern(pattern)
    if re.search(r"\\[^.\\|()\[\]{}*+?^$-]|\(\?|[*+?{^$.](?<!\\.)", pattern):
        return None
    try:
        found, end = _alternatives(pattern, 0)
    except OverflowError:
        return None
    return frozenset(found) if end == len(pattern) else None


def _alternatives(p: str, i: int) -> tuple[list[str], int]:
    every: list[str] = []
    now = [""]
    while i < len(p) and p[i] != ")":
        if p[i] == "|":
            every, now, i = every + now, [""], i + 1
            continue
        if p[i] == "(":
            options, i = _alternatives(p, i + 1)
            i += 1
        elif p[i] == "[":
            options, i = _members(p, i)
        else:
            i += p[i] == "\\"
            options, i = [p[i]], i + 1
        if len(now) * len(options) > MOST_LITERALS:
            raise OverflowError
        now = [a + b for a in now for b in options]
    every += now
    if len(every) > MOST_LITERALS:
        raise OverflowError
    return every, i


def _members(p: str, i: int) -> tuple[list[str], int]:
    end = p.find("]", i + 2)
    inner = p[i + 1 : end]
    if end < 0 or inner.startswith("^") or "\\" in inner or "[" in inner:
        raise OverflowError
    out, k = [], 0
    while k < len(inner):
        if inner[k + 1 : k + 2] == "-" and k + 2 < len(inner):
            a, b = ord(inner[k]), ord(inner[k + 2])
            if b - a > MOST_LITERALS:
                raise OverflowError
            out += [chr(c) for c in range(a, b + 1)]
            k += 3
        else:
            out.append(inner[k])
            k += 1
    return out, end + 1
