"""Functions of sources in languages with braces: their names, where they stand, and which hold a mark."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from tallyspark.functions.lexing import literals

_COMMENT = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)"
_STRING, _CHAR = r'"(?:[^"\\\n]|\\(?s:.))*+"?', r"'(?:[^'\\\n]|\\(?s:.))*+'?"
_PREPROCESSOR = r"^[ \t]*#(?:[^\n\\]|\\(?s:.))*+"
#: Numbers come before quotes: C++ and Java put signs into them.
_NUMBER = r"\b\d[\w']*"
#: Comments and literals of each language; Rust has a lexer of its own.
_OPENS = {
    "c": re.compile("|".join((_COMMENT, _PREPROCESSOR, _STRING, _CHAR)), re.MULTILINE),
    "cpp": re.compile("|".join((_COMMENT, _PREPROCESSOR, r'R"([^()\\\s]{0,16})\((?s:.*?)(?:\)\1"|\Z)', _NUMBER, _STRING, _CHAR)), re.MULTILINE),
    "go": re.compile("|".join((_COMMENT, r"`[^`]*+`?", _STRING, _CHAR))),
    "java": re.compile("|".join((_COMMENT, r'"""(?s:\\.|.)*?(?:"""|\Z)', _STRING, _CHAR))),
    "js": re.compile("|".join((_COMMENT, "`", _STRING, _CHAR, r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*"))),
}
_OPENS["ts"] = _OPENS["js"]
#: What a slash must follow to open a regular expression and not to divide.
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else|void|delete|await|yield))\s*$")
_TEMPLATE = re.compile(r"\\.|`|\$\{|[{}]", re.DOTALL)

#: Words before a parenthesis that name no function, and those that make what follows a value.
_CONTROL = frozenset("if for while switch catch with return function synchronized try else do super this sizeof defined".split())
_NO_NAME = frozenset("__attribute__ __declspec alignas noexcept decltype requires explicit throw throws __asm__".split())
_VALUE = re.compile(r"\b(?:return|throw|new|else|case|delete|co_return|co_yield)\b|(?<!operator)(?<![=!<>])=(?!=)|->")
_TYPE = re.compile(r"\b(?:class|record|enum|interface)\s+[\w$]+\s*$")
_C_NAME = re.compile(r"(?:[\w~]+\s*(?:<[^<>]*>)?\s*::\s*)*(?:operator\s*(?:[^\s\w()]{1,3}|\w+)?|~?\w+)\s*(?:<[^<>]*>)?\s*$")
_RUST, _GO = re.compile(r"\bfn\s+(?:r#)?(\w+)"), re.compile(r"^func\s+(?:\([^()]*\)\s*)?(\w+)", re.MULTILINE)
_ARROW = re.compile(r"([\w$#]+)\s*(?::[^=,;]*)?[=:]\s*(?:async\b\s*)?(?:<[^<>]*>\s*)?$")
_ARROW_ONE = re.compile(r"([\w$#]+)\s*=\s*(?:async\s+)?[\w$]+\s*=>\s*$")
_JS_NAME = re.compile(r"([\w$#]+)\s*(?:<[^<>]*>\s*)?$")
_JS_VALUE = re.compile(r"([\w$#]+)\s*[=:]\s*(?:async\s+)?function\b\s*\*?\s*$")


def _template_end(src: str, at: int) -> int:
    """Where the template that opened before ``at`` ends; expressions in it may hold templates."""
    inside = ["`"]
    while inside and (m := _TEMPLATE.search(src, at)):
        at, sign, top = m.end(), m[0], inside[-1]
        if sign == "`":
            inside.pop() if top == "`" else inside.append("`")
        elif sign == "${" and top == "`" or sign == "{" and top != "`":
            inside.append("{")
        elif sign == "}" and top != "`":
            inside.pop()
    return len(src) if inside else at


def spans(src: str, language: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every comment and literal; what is not closed reaches to the end of its line or of the source."""
    if language == "rust":
        yield from literals(src)
        return
    opens, at = _OPENS[language], 0
    while m := opens.search(src, at):
        start, at = m.span()
        if m[0] == "`":
            at = _template_end(src, at)
        elif m[0][0] == "/" and m[0][:2] not in ("//", "/*") and not _BEFORE_REGEX.search(src[max(0, start - 40) : start]):
            at = start + 1
            continue
        if not m[0][0].isdigit():
            yield start, at


def _groups(head: str) -> list[tuple[int, int]]:
    """The outermost parentheses of a head."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"[()]", head):
        if m[0] == "(":
            start, depth = (m.start() if not depth else start), depth + 1
        elif depth:
            depth -= 1
            if not depth:
                out.append((start, m.end()))
    return out


def _declared(head: str, language: str) -> tuple[str, int] | None:
    """(name, where it stands) of the function whose body the brace after ``head`` opens."""
    if language in ("rust", "go"):
        found = list((_RUST if language == "rust" else _GO).finditer(head))
        return (found[-1][1], found[-1].start()) if found else None
    groups = _groups(head)
    if language in ("js", "ts"):
        one = _ARROW_ONE.search(head)
        if one or not groups:
            return (one[1], one.start()) if one else None
        start, end = groups[-1]
        before, arrow = head[:start], head.rstrip().endswith("=>")
        if not re.fullmatch(r"\s*(?::[^;]*?)?(?:=>)?\s*", head[end:]):
            return None
        m = _ARROW.search(before) if arrow else _JS_VALUE.search(before) or _JS_NAME.search(before)
        if not m or not arrow and (m[1] in _CONTROL or re.search(r"\bnew\s+[\w$.]*$", before)):
            return None
        return m[1], m.start()
    if language == "java" and head.rstrip().endswith("->"):
        return None
    before, done = "", 0
    for start, end in groups:
        # what stands outside of parentheses
        before, done = before + head[done:start], end
        m = _C_NAME.search(before)
        if not m or before[: m.start()].endswith("@"):
            continue
        name = re.sub(r"\s+|<[^<>]*>", "", m[0])
        if name in _NO_NAME or re.search(r"@[\w.]*$", before):
            continue
        if name.split("::")[-1] in _CONTROL or _VALUE.search(before) or language == "java" and _TYPE.search(before):
            return None
        return ("operator()" if name == "operator" else name), start - len(m[0].lstrip())
    return None


def marked_functions(src: str, language: str, marks: tuple[str, ...]) -> list[tuple[str, int, str]]:
    """(name, line, signature) of the functions whose own code holds one of the marks, in the order of
    the marks; each once. A mark in a closure counts for the function around it, one in a comment or a
    literal for none, unless the mark opens that itself. Lines count from 1."""
    taken = list(spans(src, language))
    starts, code, done = [s for s, _ in taken], [], 0
    for start, end in taken:
        code += [src[done:start], re.sub(r"[^\n]", " ", src[start:end])]
        done = end
    code = "".join([*code, src[done:]])

    def stands_free(at: int) -> bool:
        k = bisect_right(starts, at) - 1
        return k < 0 or at >= taken[k][1] or at == taken[k][0]

    places = sorted({m.start() for mark in marks for m in re.finditer(re.escape(mark), src) if stands_free(m.start())})
    if not places:
        return []
    continues = {"cpp": r"\s*(?:,\s*[\w:<>]+\s*)?", "go": r"\s*", "ts": r"\s*"}.get(language)
    # a block: brackets open around it, where its head begins, its function
    blocks, owners, pieces, base, head, last = [], [], [], 0, 0, None
    found, k = {}, 0
    for m in re.finditer(r"[()\[\]{};,]|\Z", code):
        sign, at = m[0], m.start()
        while k < len(places) and places[k] < at:
            if owners:
                found.setdefault(owners[-1])
            k += 1
        if sign in ("(", "["):
            pieces.append(at + 1)
        elif sign in (")", "]"):
            if len(pieces) > base:
                pieces.pop()
        elif sign == ",":
            if len(pieces) > base:
                pieces[-1] = at + 1
        elif sign == ";":
            if len(pieces) == base:
                head, last = at + 1, None
        elif sign == "{":
            begin = pieces[-1] if len(pieces) > base else head
            own = _declared(code[begin:at], language)
            if own:
                line = max(code.rfind("\n", 0, begin + own[1]) + 1, begin)
                own = (own[0], begin + own[1], line, at)
            elif continues and last and re.fullmatch(continues, code[begin:at]):
                own = last
            blocks.append((len(pieces), head, own))
            if own:
                owners.append(own)
            base, head, last = len(pieces), at + 1, None
        elif sign == "}" and blocks:
            outer, its_head, own = blocks.pop()
            if own:
                owners.pop()
            del pieces[outer:]
            base = blocks[-1][0] if blocks else 0
            head, last = (its_head, None) if outer > base else (at + 1, own)
    ends = [m.start() for m in re.finditer("\n", src)]
    return [(name, bisect_left(ends, at) + 1, " ".join(src[line:end].split())) for name, at, line, end in found]
