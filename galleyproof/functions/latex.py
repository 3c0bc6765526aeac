"""Brace-aware reading of LaTeX formulas, in plain Python for Arrow batches: regular expressions alone can't count depth."""

from __future__ import annotations

import re

Macros = dict[str, tuple[int, str]]

# Wrappers inside a formula, displayed environments of one row and of several, parts of a formula that say nothing.
WRAPPERS = ["aligned", "gathered", "cases", "split", "multlined", "alignedat"]
ONE_ROW = ["equation", "multline"]
MANY_ROWS = ["align", "eqnarray", "gather"]
SILENT = r"\\(?:label|tag)\{[^}]*\}|\\nonumber|&"

_WRAPPED = re.compile(rf"\\begin\{{({'|'.join(WRAPPERS)})\}}(?:\[[^\]]*\])?(.*?)\\end\{{\1\}}", re.S)
_FORMS = [
    (re.compile(r"(?<!\\)\$\$(?P<body>.*?)(?<!\\)\$\$", re.S), False),
    (re.compile(r"(?<!\\)\\\[(?P<body>.*?)\\\]", re.S), False),
    *((re.compile(rf"\\begin\{{(?P<env>{env}\*?)\}}(?P<body>.*?)\\end\{{(?P=env)\}}", re.S), many) for names, many in ((ONE_ROW, False), (MANY_ROWS, True)) for env in names),
]
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_BRACE = re.compile(r"\\.|[{}]", re.S)
_ROW = re.compile(r"(?P<end>\\\\)(?:\[[^\]]*\])?|\\.|[{}]", re.S)
_EQUALS = re.compile(r"\\[A-Za-z]+|(?P<open>[{(\[])|(?P<close>[})\]])|(?P<equals>(?<![:=])=(?!=))")
_DEFINITION = [
    re.compile(r"\\(?:new|renew|provide)command\*?\s*(?:\{\s*\\(?P<braced>[A-Za-z]+)[^{}]*\}|\\(?P<bare>[A-Za-z]+))\s*(?:\[(?P<arity>\d)\])?\s*(?:\[[^\]]*\])?\s*(?=\{)"),
    re.compile(r"\\def\s*\\(?P<bare>[A-Za-z]+)(?P<places>(?:#\d)*)\s*(?=\{)"),
]
_CALL = re.compile(r"\\([A-Za-z]+)")
_ARGUMENT = re.compile(r"\s*(?:(?P<group>\{)|(?P<token>\\[A-Za-z]+|[^\\\s]))")


def group_end(tex: str, start: int) -> int:
    """The place after the brace that closes the one at ``start``; -1 if none does."""
    depth = 0
    for m in _BRACE.finditer(tex, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth and m[0] == "}":
            return m.end()
    return -1


def rows(body: str) -> list[str]:
    r"""Parts of a formula between line breaks outside braces; a break's length, as in ``\\[1ex]``, goes with it."""
    out, at, depth = [], 0, 0
    for m in _ROW.finditer(body):
        if m["end"] and not depth:
            out.append(body[at : m.start()])
            at = m.end()
        depth = max(0, depth + {"{": 1, "}": -1}.get(m[0], 0))
    return [*out, body[at:]]


def alignment_rows(body: str, deep: int = 3) -> list[tuple[int, str]]:
    """(number, text) of the rows of a formula, out of up to ``deep`` wrappers and without alignment marks at their edges; blank rows go, unless all are blank."""
    inner = body
    for _ in range(deep):
        inner = _WRAPPED.sub(lambda m: m[2], inner, count=1)
    found = [(n, re.sub(r"^\s*&\s*|\s*&\s*$", "", row.strip())) for n, row in enumerate(rows(inner)) if row.strip()]
    return found or [(0, body)]


def equations(tex: str) -> list[tuple[int, int, str, str]]:
    """(start, row, source, body) of all displayed formulas, in the order of the text."""
    tex, out = _COMMENT.sub("", tex), []
    for form, many in _FORMS:
        for m in form.finditer(tex):
            for n, line in enumerate(rows(m["body"]) if many else [m["body"]]):
                if line.strip() or not many:
                    out += [(m.start(), n + k, m[0], row) for k, row in alignment_rows(line)]
    return sorted(out, key=lambda x: x[:2])


def equalities(body: str) -> list[tuple[str, str]]:
    """Neighbours in a chain of equalities, at signs outside of braces, brackets and parentheses."""
    body = re.sub(SILENT, " ", body)
    parts, at, depth = [], 0, 0
    for m in _EQUALS.finditer(body):
        if m["equals"] and not depth:
            parts.append(body[at : m.start()].strip())
            at = m.end()
        depth = max(0, depth + bool(m["open"]) - bool(m["close"]))
    parts.append(body[at:].strip())
    return [(a, b) for a, b in zip(parts, parts[1:]) if a and b]


def macros(tex: str) -> Macros:
    """Number of arguments and body of each macro; the last definition wins, primitive ones over commands."""
    out: Macros = {}
    for form in _DEFINITION:
        for m in form.finditer(tex):
            got, end = m.groupdict(), group_end(tex, m.end())
            if end > 0:
                places = [int(x) for x in re.findall(r"\d", got.get("places") or "")]
                out[got.get("braced") or m["bare"]] = (max([int(got.get("arity") or 0), *places]), tex[m.end() + 1 : end - 1])
    return out


def _call(tex: str, m: re.Match, known: Macros) -> tuple[int, str] | None:
    """Where a macro's call ends and what it stands for; None for another command and where an argument is missing."""
    if m[1] not in known:
        return None
    arity, body = known[m[1]]
    at, given = m.end(), []
    for _ in range(arity):
        a = _ARGUMENT.match(tex, at)
        if not a:
            return None
        at = group_end(tex, a.start("group")) if a["group"] else a.end()
        if at < 0:
            return None
        given.append(tex[a.start("group") + 1 : at - 1] if a["group"] else a["token"])
    return at, re.sub(r"#([1-9])", lambda x: given[int(x[1]) - 1] if int(x[1]) <= len(given) else "", body)


def _once(tex: str, known: Macros, all_calls: bool) -> str:
    calls = list(_CALL.finditer(tex))
    if not all_calls:  # the first call of the longest name only
        calls = sorted((m for m in calls if m[1] in known), key=lambda m: (-len(m[1]), m[1], m.start()))
    out, done = [], 0
    for m in calls:
        if m.start() >= done and (got := _call(tex, m, known)):
            out += [tex[done : m.start()], got[1]]
            done = got[0]
            if not all_calls:
                break
    return "".join(out) + tex[done:]


def expand(tex: str, known: Macros, passes: int = 5, all_calls: bool = True) -> tuple[str, str | None]:
    """tex with its macros expanded, or as it was with a note where that doesn't settle or leaves braces unbalanced.

    Each pass expands all calls, or just one with ``all_calls=False``, as the checked behaviour has it.
    """
    now = tex
    for _ in range(passes):
        new = _once(now, known, all_calls)
        if new == now:
            break
        now = new
    else:
        if _once(now, known, all_calls) != now or not all_calls:
            return tex, f"macro expansion did not converge after {passes} passes"
    opened, closed = now.count("{"), now.count("}")
    if opened != closed:
        return tex, f"macro expansion produced unbalanced braces ({opened} open, {closed} close)"
    return now, None


_ENTRY = re.compile(r"@(?P<kind>[A-Za-z]+)\s*(?=\{)")
_FIELD = re.compile(r"[\s,]*(?P<name>[A-Za-z][\w-]*)\s*=\s*(?:(?P<open>\{)|\"(?P<quoted>[^\"]*)\"|(?P<bare>[^\s,{}]+))")


def bib_entries(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """Key, kind and fields (lower-case names) of each entry of BibTeX text, in order; one whose brace doesn't close is left out."""
    out = []
    for m in _ENTRY.finditer(text):
        end = group_end(text, m.end())
        key, comma, _ = text[m.end() + 1 : end].partition(",") if end > 0 else ("", "", "")
        if not comma or m["kind"].lower() in ("comment", "string", "preamble"):
            continue
        values, at = {}, m.end() + 1 + len(key)
        while f := _FIELD.match(text, at, end - 1):
            at = group_end(text, f.start("open")) if f["open"] else f.end()
            if at < 0:
                break
            values[f["name"].lower()] = text[f.start("open") + 1 : at - 1] if f["open"] else f["quoted"] if f["quoted"] is not None else f["bare"]
        out.append((key.strip(), m["kind"].lower(), values))
    return out
