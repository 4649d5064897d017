r"""X-29: expansion of LaTeX macros, and the list of those that a text uses.

Recognised definitions: ``\newcommand``, ``\renewcommand`` (a name with or without braces, an optional number of arguments, a braced
body), ``\newenvironment`` and ``\renewenvironment`` (begin and end bodies). ``\def`` and default arguments are not. ``@`` is a
letter between ``\makeatletter`` and ``\makeatother`` and in definitions. A comment runs to the end of its line and takes the white
space after it along. An argument is a braced group or one token; blanks count only before the first. Expansion that goes
deeper than ``DEPTH`` fails; on failure a text stays as it is, and the list is empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 20
DEFINES = ("newcommand", "renewcommand", "newenvironment", "renewenvironment")


class MacroError(ValueError):
    pass


@dataclass(frozen=True)
class Macro:
    name: str
    arity: int
    body: tuple[str, ...]
    end: tuple[str, ...] | None = None

    def shown(self) -> str:
        count = f"[{self.arity}]" if self.arity else ""
        return f"\\newcommand{{\\{self.name}}}{count}{{{joined(self.body)}}}"


_TOKENS = {at: re.compile(rf"\\(?:{letters}+|.)|%[^\n]*\n?[ \t]*|.", re.S) for at, letters in ((False, "[A-Za-z]"), (True, "[A-Za-z@]"))}


def tokens(text: str, at_letter: bool = False) -> list[str]:
    """Control words and symbols, comments, and single characters."""
    out, at = [], 0
    while at < len(text):
        m = _TOKENS[at_letter].match(text, at)
        token = m[0]
        out.append(token)
        at = m.end()
        if token == "\\makeatletter":
            at_letter = True
        elif token == "\\makeatother":
            at_letter = False
    return out


def is_word(token: str) -> bool:
    return len(token) > 1 and token[0] == "\\" and (token[1].isalpha() or token[1] == "@")


def is_comment(token: str) -> bool:
    return token[:1] == "%"


def joined(parts) -> str:
    """Text from tokens; a space parts a control word from a letter that would lengthen it."""
    out = []
    for token in parts:
        if out and is_word(out[-1]) and token[:1].isalpha():
            out.append(" ")
        out.append(token)
    return "".join(out)


def _blank(parts: list[str], at: int) -> int:
    while at < len(parts) and (parts[at].isspace() or is_comment(parts[at])):
        at += 1
    return at


def _group(parts: list[str], at: int) -> tuple[list[str], int]:
    """The content of the group that opens at ``at``, and the place after it."""
    depth = 0
    for k in range(at, len(parts)):
        depth += (parts[k] == "{") - (parts[k] == "}")
        if not depth:
            return parts[at + 1 : k], k + 1
    raise MacroError("a group does not close")


def _argument(parts: list[str], at: int, first: bool) -> tuple[list[str], int]:
    if first:
        at = _blank(parts, at)
    if at >= len(parts):
        raise MacroError("an argument is missing")
    return _group(parts, at) if parts[at] == "{" else ([parts[at]], at + 1)


def definitions(text: str) -> dict[str, Macro]:
    """The macros that a text defines; of several definitions of a name the last counts. Environments stand under ``env:name``."""
    parts, at, found = tokens(text, True), 0, {}
    while at < len(parts):
        word = parts[at][1:] if is_word(parts[at]) else ""
        at += 1
        if word not in DEFINES:
            continue
        try:
            k = _blank(parts, at)
            star = k < len(parts) and parts[k] == "*"
            name, k = _argument(parts, k + star, True)
            name = "".join(name).strip().lstrip("\\")
            k, arity = _blank(parts, k), 0
            if k < len(parts) and parts[k] == "[":
                close = parts.index("]", k)
                arity, k = int("".join(parts[k + 1 : close])), _blank(parts, close + 1)
            if k >= len(parts) or parts[k] != "{":
                continue  # a default argument
            body, k = _group(parts, k)
            plain = tuple(t for t in body if not is_comment(t))
            if word.endswith("environment"):
                end, k = _argument(parts, k, True)
                found[f"env:{name}"] = Macro(name, arity, plain, tuple(t for t in end if not is_comment(t)))
            else:
                found[name] = Macro(name, arity, plain)
            at = k
        except (MacroError, ValueError):
            continue
    return found


def _filled(body, arguments: list[list[str]]) -> list[str]:
    out, at = [], 0
    while at < len(body):
        if body[at] == "#" and at + 1 < len(body):
            digit = body[at + 1]
            if not digit.isdigit() or not 1 <= int(digit) <= len(arguments):
                raise MacroError(f"no argument #{digit}")
            out.extend(arguments[int(digit) - 1])
            at += 2
        else:
            out.append(body[at])
            at += 1
    return out


def _expanded(parts: list[str], macros: dict[str, Macro], used: dict[str, Macro], depth: int) -> list[str]:
    if depth > DEPTH:
        raise MacroError("macros are nested too deeply")
    out, at = [], 0
    while at < len(parts):
        token = parts[at]
        macro = macros.get(token[1:]) if is_word(token) else None
        at += 1
        if macro is None and token in ("\\begin", "\\end") and at < len(parts) and parts[at] == "{":
            name, after = _group(parts, at)
            macro = macros.get("env:" + "".join(name))
            if macro is not None:
                used.setdefault(macro.shown(), macro)
                arguments, at = [], after
                if token == "\\begin":
                    for k in range(macro.arity):
                        argument, at = _argument(parts, at, not k)
                        arguments.append(argument)
                out.extend(_expanded(_filled(macro.body if token == "\\begin" else macro.end, arguments), macros, used, depth + 1))
                continue
        if macro is None:
            out.append(token)
            continue
        used.setdefault(macro.shown(), macro)
        arguments = []
        for k in range(macro.arity):
            argument, at = _argument(parts, at, not k)
            arguments.append(argument)
        out.extend(_expanded(_filled(macro.body, arguments), macros, used, depth + 1))
    return out


def expand(macros: str | None, text: str | None) -> tuple[str | None, str]:
    """(``text`` with the macros expanded, the definitions that it uses, in order of use)."""
    if not text or not macros:
        return text, ""
    try:
        used: dict[str, Macro] = {}
        known = definitions(macros)
        return (joined(_expanded(tokens(text), known, used, 0)) if known else text), "\n\n".join(used).strip()
    except (MacroError, RecursionError):
        return text, ""


def _udf(which: int):
    @F.udf("string", useArrow=True)
    def run(macros, text):
        return expand(macros, text)[which]

    return run


def expand_macros(macros: Column | str, text: Column | str) -> Column:
    """The text with the macros expanded, or as it is if that fails."""
    return _udf(0)(macros, text)


def used_macros(macros: Column | str, text: Column | str) -> Column:
    """The definitions that the text uses, directly or through others; empty if expansion fails."""
    return _udf(1)(macros, text)


__all__ = ["Macro", "MacroError", "definitions", "expand", "expand_macros", "tokens", "used_macros"]
