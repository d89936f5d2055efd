"""The lexical state of source lines: what stands in strings and comments, how deep brackets are open, where statements begin."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: What may begin something else than plain code, by language.
_TOKENS = {
    "python": re.compile(r'"""|\'\'\'|["\'#()\[\]{}]'),
    "go": re.compile(r"//|/\*|[\"'`()\[\]{}]"),
    "javascript": re.compile(r"//|/\*|[\"'`/()\[\]{}]"),
}
_TOKENS["typescript"] = _TOKENS["javascript"]
#: Ends of what may span lines, by what began it; each with what is to be read over.
_ENDS = {'"""': re.compile(r'\\.|"""'), "'''": re.compile(r"\\.|'''"), '"': re.compile(r'\\.|"'), "'": re.compile(r"\\.|'"), "/*": re.compile(r"\*/"), "`": re.compile(r"\\.|`|\$\{"), "raw": re.compile("`")}
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: After these a slash begins a regular expression.
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+<>~^*%-]|=>|\b(?:return|typeof|case|in|of|do|else))\s*$")
#: A statement goes on after lines with such an end, and in lines with such a beginning.
_OPEN_END = re.compile(r"(?:[=,.?:&|^%~]|(?<!\+)\+|(?<!-)-|=>|\b(?:extends|implements|return|default|export|async|function|class|func|type|interface))$")
_GOES_ON = re.compile(r"[)\]}{.?:=&|,;]|(?:extends|implements)\b")
#: At the margin these begin a declaration, however many brackets a broken one before it left open.
_FRESH = {"python": re.compile(r"(?:async\s+)?def\s|class\s|@\w"), "go": re.compile(r"(?:func|type|package|import|var|const)\b")}
_BLOCK = re.compile(r"(?:[\w)\]>\"]|=>)\s*\{$")
_DECORATOR = re.compile(r"@[\w.$]+(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?\s*")
_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
HEAD_LINES, HEAD_CHARS = 20, 1_000
#: What the patterns of ends look at: longer than the longest of their words.
TAIL = 16

#: A hollow line is blank and stands in a comment that began on a line of its own.
BLANK, HOLLOW, COMMENT, DECORATOR, CODE = "blank", "hollow", "comment", "decorator", "code"


@dataclass
class State:
    """Between two characters: the brackets open, what has begun and not ended, the depths of ${ in templates."""

    depth: int = 0
    inside: str = ""
    #: Whether the comment that is open began on a line of its own.
    own: bool = True
    templates: list[int] = field(default_factory=list)


def _masked(line: str, language: str, state: State) -> tuple[str, bool, int]:
    """(the line's code with its strings emptied and without comments, whether it holds a comment, the least depth); moves state to the line's end."""
    code, at, comment, low = [], 0, state.inside == "/*", state.depth
    tokens = _TOKENS[language]
    while at < len(line) or state.inside:
        if state.inside:
            end = next((m for m in _ENDS[state.inside].finditer(line, at) if m[0][0] != "\\" or state.inside == "raw"), None)
            if end is None:
                if state.inside in ('"', "'") and (len(line) - len(line.rstrip("\\"))) % 2 == 0:
                    state.inside = ""
                break
            at = end.end()
            if end[0] == "${":
                state.templates.append(state.depth)
                state.depth += 1
            state.inside = ""
            continue
        m = tokens.search(line, at)
        if m is None:
            code.append(line[at:])
            break
        code.append(line[at : m.start()])
        token, at = m[0], m.end()
        if token in "([{":
            state.depth += 1
            code.append(token)
        elif token in ")]}":
            state.depth = max(0, state.depth - 1)
            low = min(low, state.depth)
            if token == "}" and state.templates and state.templates[-1] == state.depth:
                state.templates.pop()
                state.inside = "`"
            else:
                code.append(token)
        elif token in ("#", "//"):
            comment = True
            break
        elif token == "/*":
            state.inside, comment, state.own = "/*", True, not "".join(code).strip()
        elif token == "/":
            regex = _REGEX.match(line, m.start()) if _BEFORE_REGEX.search("".join(code)[-TAIL:]) else None
            code.append('""' if regex else "/")
            at = regex.end() if regex else at
        elif token in ('"', "'"):
            # A quote that nothing closes on its line is no string, unless the line says that it goes on.
            closed = any(e[0][0] != "\\" for e in _ENDS[token].finditer(line, at))
            if closed or line.endswith("\\"):
                code.append('""')
                state.inside = token
        else:
            code.append('""')
            state.inside = "raw" if token == "`" and language == "go" else token
    return "".join(code), comment, low


#: (role, depth at its start, least depth in it, indent, head): head is the code of the statement that begins here, or null.
Line = tuple[str, int, int, int, str | None]


def code_lines(language: str, lines: list[str]) -> list[Line]:
    """What each line of a file is. A role is blank, hollow, comment, decorator or code; a comment that begins after code is code to its end."""
    state, out, codes, depths, firsts = State(), [], [], [], []
    before, backslash = "", False
    for line in lines:
        indent = len(line) - len(line.lstrip())
        began, own = state.inside, state.own
        if state.depth and not began and not indent and language in _FRESH and _FRESH[language].match(line):
            state.depth, state.templates, before, backslash = 0, [], "", False
        depth = state.depth
        code, comment, low = _masked(line, language, state)
        bare = code.strip()
        if not line.strip():
            role = HOLLOW if began == "/*" and own else BLANK
        elif bare or began not in ("", "/*") or not comment:
            role = CODE
        else:
            role = CODE if began == "/*" and not own else COMMENT
        first = role == CODE and bool(bare) and not began and not backslash
        if language == "python":
            first = first and not depth
        else:
            first = first and not _GOES_ON.match(bare) and not _OPEN_END.search(before)
        if role == CODE:
            before, backslash = bare[-TAIL:] or before, bare.endswith("\\") and language == "python"
        codes.append(bare)
        depths.append((depth, state.depth))
        firsts.append(first)
        out.append([role, depth, low, indent, None])
    for i, first in enumerate(firsts):
        if first:
            out[i][4] = _head(i, codes, depths, firsts, out)
    return [tuple(x) for x in out]


def _head(i: int, codes: list[str], depths: list[tuple[int, int]], firsts: list[bool], out: list[list]) -> str | None:
    """The code of the statement from line i, up to a block that opens, without decorators; null, and their lines marked, if it is decorators alone."""
    depth = depths[i][0]
    if codes[i].startswith("@"):
        end = i
        while depths[end][1] > depth and end + 1 < len(codes):
            end += 1
        text, before = " ".join(codes[i : end + 1]), ""
        while text != before:
            before, text = text, re.sub(r"\([^()]*\)", "", text)
        if re.fullmatch(r"(?:@[\w.$]+\s*)+", text):
            for k in range(i, end + 1):
                out[k][0] = DECORATOR
            return None
    parts, size = [], 0
    for k in range(i, min(len(codes), i + HEAD_LINES)):
        if k > i and firsts[k] and depths[k][0] <= depth:
            break
        parts.append(codes[k])
        size += len(codes[k])
        if (codes[k].endswith("{") and _BLOCK.search(codes[k][-TAIL:])) or (codes[k].endswith(";") and depths[k][1] == depth) or size > HEAD_CHARS:
            break
    text = " ".join(filter(None, parts))
    while (m := _DECORATOR.match(text)) is not None:
        text = text[m.end() :]
    return text


def markdown_lines(lines: list[str]) -> list[Line]:
    """Headings as lines of code: their level as depth, their title, links as their text, as head. Those inside fenced code do not count."""
    out, fence = [], ""
    for line in lines:
        mark = _FENCE.match(line)
        heading = _HEADING.match(line) if not fence and not mark else None
        if mark and not fence:
            fence = mark[1]
        elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and line.strip() == mark[1]:
            fence = ""
        role = BLANK if not line.strip() else CODE
        out.append((role, len(heading[1]), 0, 0, _LINK.sub(r"\1", heading[2]).strip()) if heading else (role, 0, 0, 0, None))
    return out


def read_lines(language: str | None, lines: list[str]) -> list[Line]:
    """What each line is, by the file's language; in an unknown one nothing begins."""
    if language in _TOKENS:
        return code_lines(language, lines)
    if language == "markdown":
        return markdown_lines(lines)
    return [(CODE if line.strip() else BLANK, 0, 0, 0, None) for line in lines]
