"""PHP 8: a tokenizer and a recursive-descent parser; what stands outside `<?php ... ?>` is plain text and always valid."""

from __future__ import annotations

import re

from quarry.llm.grammars.common import Bad, remember

_OPEN = re.compile(r"<\?(?:php(?=\s|\Z)|=)", re.I)
_KEYWORDS = frozenset(
    "abstract and as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum exit eval extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield array die __halt_compiler".split()
)
#: Keywords that are names where no keyword can stand.
_SOFT = frozenset("enum readonly match".split())
_TOKEN = re.compile(
    r"""(?P<s>\s+|(?://|\#(?!\[))(?:(?!\?>)[^\n])*|/\*[\s\S]*?\*/)"""
    r"""|(?P<v>\$[^\W\d]\w*)"""
    r"""|(?P<i>\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*)"""
    r"""|(?P<n>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)"""
    r"""|(?P<q>'(?:[^'\\]|\\[\s\S])*'|"(?:[^"\\]|\\[\s\S])*"|`(?:[^`\\]|\\[\s\S])*`)"""
    r"""|(?P<h><<<[ \t]*(?P<hq>["']?)(?P<hn>[A-Za-z_]\w*)(?P=hq)\r?\n)"""
    r"""|(?P<x>\?>\n?)"""
    r"""|(?P<p>\?->|->|=>|::|\.\.\.|\*\*=|\?\?=|<<=|>>=|<=>|===|!==|<>|\+\+|--|&&|\|\||\?\?|\*\*|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|\#\[|\((?:int|integer|bool|boolean|float|double|string|array|object|unset|binary)\)|[-{}()\[\];,<>+*/%&|^!~?:=.@$])""",
    re.I,
)
_CLOSE = {")": "(", "]": "[", "}": "{"}


class _Signs(dict):
    def __missing__(self, kind: str) -> str:
        sign = self[kind] = chr(0x100 + len(self))
        return sign


_SIGN = _Signs()
_BINARY = frozenset("+ - * / % ** . << >> < > <= >= == != === !== <> <=> && || & | ^ ?? and or xor instanceof".split())
_ASSIGN = frozenset("= += -= *= /= .= %= **= ??= &= |= ^= <<= >>=".split())
_UNARY = frozenset("! ~ + - @ & ++ -- clone print".split())
_TYPE_NAMES = frozenset("i array callable static".split())
_MODIFIERS = frozenset("public private protected static abstract final readonly var".split())
_MEMO: dict = {}
LONG = 60


class Parser:
    def __init__(self, text: str) -> None:
        self.k: list[str] = []
        self.first: list[bool] = []
        self.match: dict[int, int] = {}
        self.read(text)
        self.end = len(self.k)
        self.signs = "".join([_SIGN[k + "\n"] if f else _SIGN[k] for k, f in zip(self.k, self.first, strict=True)])
        self.k += ["end"] * 3
        self.first += [True] * 3

    def read(self, text: str) -> None:
        k, first, stack, end, pos = self.k, self.first, [], len(text), 0
        while True:
            m = _OPEN.search(text, pos)
            if m is None:
                break
            if k:
                k.append("html")
                first.append(True)
            if m.group().endswith("="):
                k.append("echo")
                first.append(True)
            pos, line = m.end(), True
            while pos < end:
                m = _TOKEN.match(text, pos)
                if m is None:
                    raise Bad
                g = m.lastgroup
                w = m.group()
                pos = m.end()
                if g == "s":
                    line = line or "\n" in w
                    continue
                if g == "i":
                    low = w.lower()
                    kind = low if low in _KEYWORDS else "i"
                elif g == "p":
                    kind = "cast" if w[0] == "(" and len(w) > 1 else w
                    if kind in ("(", "[", "{", "#["):
                        stack.append(("[" if kind == "#[" else kind, len(k)))
                    elif kind in _CLOSE:
                        if not stack or stack[-1][0] != _CLOSE[kind]:
                            raise Bad
                        self.match[stack.pop()[1]] = len(k)
                elif g == "x":
                    k.append(";")
                    first.append(line)
                    break
                elif m.group("h"):
                    stop = re.compile(rf"^[ \t]*{m.group('hn')}\b", re.M).search(text, pos)
                    if stop is None:
                        raise Bad
                    kind, pos = "q", stop.end()
                else:
                    kind = {"v": "v", "n": "n", "q": "q"}[g]
                    if kind == "n" and (text[pos : pos + 1].isalpha() or text[pos : pos + 1] == "_"):
                        raise Bad
                k.append(kind)
                first.append(line)
                line = False
            else:
                break
        if stack:
            raise Bad

    def need(self, p: int, kind: str) -> int:
        if self.k[p] != kind:
            raise Bad
        return p + 1

    def name(self, p: int) -> int:
        if self.k[p] == "i" or self.k[p] in _SOFT:
            return p + 1
        raise Bad

    def word(self, p: int) -> int:
        """A name where keywords may serve as names."""
        if self.k[p] == "i" or self.k[p] in _KEYWORDS:
            return p + 1
        raise Bad

    def semicolon(self, p: int) -> int:
        return self.need(p, ";")

    def line_end(self, p: int, end: int) -> int:
        while p < end:
            p = self.match.get(p, p) + 1
            if self.first[p]:
                break
        return min(p, end)

    def several(self, p: int, end: int, one, mark: str) -> None:
        while p < end:
            j = self.line_end(p, end)
            key = None
            if j - p <= LONG:
                key = (mark, self.signs[p:j], self.signs[j : j + 1])
                if key in _MEMO:
                    p = j
                    continue
            while p < j:
                p = one(p)
            if p == j and key is not None:
                remember(_MEMO, key)
        if p != end:
            raise Bad

    def script(self) -> None:
        self.several(0, self.end, self.statement, "s")

    def block(self, p: int) -> int:
        self.need(p, "{")
        close = self.match[p]
        self.several(p + 1, close, self.statement, "s")
        return close + 1

    def until(self, p: int, *stops: str) -> int:
        while self.k[p] not in stops:
            if self.k[p] == "end":
                raise Bad
            p = self.statement(p)
        return p

    def attributes(self, p: int) -> int:
        while self.k[p] == "#[":
            p = self.match[p] + 1
        return p

    def branch(self, p: int, closing: str) -> int:
        """The body of a loop, also in the form with a colon."""
        if self.k[p] == ":":
            return self.semicolon(self.until(p + 1, closing) + 1)
        return self.statement(p)

    def statement(self, p: int) -> int:
        k, n = self.k[p], self.k[p + 1]
        if k == "{":
            return self.block(p)
        if k in (";", "html"):
            return p + 1
        if k == "#[":
            return self.statement(self.attributes(p)) if self.k[self.attributes(p)] not in ("fn",) else self.semicolon(self.expression(p))
        if k == "v" or n == "::" and k in _KEYWORDS:
            return self.semicolon(self.expression(p))
        if k == "if":
            p = self.parens(p + 1)
            if self.k[p] == ":":
                p = self.until(p + 1, "elseif", "else", "endif")
                while self.k[p] == "elseif":
                    p = self.until(self.need(self.parens(p + 1), ":"), "elseif", "else", "endif")
                if self.k[p] == "else":
                    p = self.until(self.need(p + 1, ":"), "endif")
                return self.semicolon(self.need(p, "endif"))
            p = self.statement(p)
            while self.k[p] == "elseif":
                p = self.statement(self.parens(p + 1))
            return self.statement(p + 1) if self.k[p] == "else" else p
        if k == "while":
            return self.branch(self.parens(p + 1), "endwhile")
        if k == "do":
            return self.semicolon(self.parens(self.need(self.statement(p + 1), "while")))
        if k == "for":
            self.need(p + 1, "(")
            close, p = self.match[p + 1], p + 2
            for stop in (";", ";", ")"):
                while self.k[p] != stop:
                    p = self.expression(p)
                    if self.k[p] == ",":
                        p += 1
                    elif self.k[p] != stop:
                        raise Bad
                p += 1
            if p != close + 1:
                raise Bad
            return self.branch(p, "endfor")
        if k == "foreach":
            self.need(p + 1, "(")
            close = self.match[p + 1]
            p = self.need(self.expression(p + 2), "as")
            p = self.expression(p)
            if self.k[p] == "=>":
                p = self.expression(p + 1)
            if p != close:
                raise Bad
            return self.branch(close + 1, "endforeach")
        if k == "switch":
            p = self.parens(p + 1)
            closing = "}" if self.k[p] == "{" else "endswitch"
            p = p + 1 if self.k[p] in ("{", ":") else self.need(p, "{")
            while self.k[p] != closing:
                if self.k[p] == "case":
                    p = self.expression(p + 1)
                else:
                    p = self.need(p, "default")
                if self.k[p] not in (":", ";"):
                    raise Bad
                p = self.until(p + 1, "case", "default", closing)
            return p + 1 if closing == "}" else self.semicolon(p + 1)
        if k == "try":
            p = self.block(p + 1)
            if self.k[p] not in ("catch", "finally"):
                raise Bad
            while self.k[p] == "catch":
                self.need(p + 1, "(")
                close = self.match[p + 1]
                q = self.name(p + 2)
                while self.k[q] == "|":
                    q = self.name(q + 1)
                if self.k[q] == "v":
                    q += 1
                if q != close:
                    raise Bad
                p = self.block(close + 1)
            return self.block(p + 1) if self.k[p] == "finally" else p
        if k in ("return", "break", "continue"):
            return self.semicolon(p + 1 if n == ";" else self.expression(p + 1))
        if k in ("echo",):
            return self.semicolon(self.listed(p + 1))
        if k in ("global", "unset"):
            return self.semicolon(self.listed(p + 1)) if k == "global" else self.semicolon(self.arguments(p + 1))
        if k == "static" and n == "v":
            p += 1
            while True:
                p = self.need(p, "v")
                if self.k[p] == "=":
                    p = self.expression(p + 1)
                if self.k[p] != ",":
                    return self.semicolon(p)
                p += 1
        if k == "function" and (n in ("i", "&") or n in _SOFT) and self.k[p + 2 + (n == "&")] == "(":
            p += 1 + (n == "&")
            return self.block(self.result(self.params(self.name(p))))
        if k in ("abstract", "final", "class", "readonly", "interface", "trait", "enum") and (n == "i" or n in ("class", "abstract", "final", "readonly") or n in _SOFT):
            return self.klass(p)
        if k == "namespace" and n in ("i", "{"):
            p = p + 2 if n == "i" else p + 1
            return self.block(p) if self.k[p] == "{" else self.semicolon(p)
        if k == "use":
            return self.use(p + 1)
        if k == "const":
            p += 1
            while True:
                p = self.expression(self.need(self.word(p), "="))
                if self.k[p] != ",":
                    return self.semicolon(p)
                p += 1
        if k == "declare":
            p = self.arguments(p + 1)
            return p + 1 if self.k[p] == ";" else self.branch(p, "enddeclare")
        if k == "goto":
            return self.semicolon(self.name(p + 1))
        if k == "i" and n == ":" and self.k[p + 2] != ":":
            return p + 2
        if k == "__halt_compiler":
            return self.end
        return self.semicolon(self.expression(p))

    def use(self, p: int) -> int:
        if self.k[p] in ("function", "const"):
            p += 1
        while True:
            p = self.name(p)
            if self.k[p] == "{":
                raise Bad
            if self.k[p] == "as":
                p = self.name(p + 1)
            if self.k[p] != ",":
                return self.semicolon(p)
            p += 1

    def klass(self, p: int) -> int:
        while self.k[p] in ("abstract", "final", "readonly"):
            p += 1
        kind = self.k[p]
        if kind not in ("class", "interface", "trait", "enum"):
            raise Bad
        p = self.name(p + 1)
        if kind == "enum" and self.k[p] == ":":
            p = self.type(p + 1)
        return self.class_body(p)

    def class_body(self, p: int) -> int:
        if self.k[p] == "extends":
            p = self.names(p + 1)
        if self.k[p] == "implements":
            p = self.names(p + 1)
        self.need(p, "{")
        close = self.match[p]
        self.several(p + 1, close, self.member, "c")
        return close + 1

    def names(self, p: int) -> int:
        p = self.name(p)
        while self.k[p] == ",":
            p = self.name(p + 1)
        return p

    def member(self, p: int) -> int:
        p = self.attributes(p)
        k = self.k
        if k[p] == "use":
            p = self.names(p + 1)
            return self.match[p] + 1 if k[p] == "{" else self.semicolon(p)
        if k[p] == "case":
            p = self.word(p + 1)
            return self.semicolon(self.expression(p + 1) if k[p] == "=" else p)
        start = p
        while k[p] in _MODIFIERS:
            p += 1
        if k[p] == "const":
            p += 1
            if k[p + 1] != "=":
                p = self.type(p)
            while True:
                p = self.expression(self.need(self.word(p), "="))
                if k[p] != ",":
                    return self.semicolon(p)
                p += 1
        if k[p] == "function":
            p += 1
            if k[p] == "&":
                p += 1
            p = self.result(self.params(self.word(p)))
            return self.block(p) if k[p] == "{" else self.semicolon(p)
        if p == start:
            raise Bad
        if k[p] != "v":
            p = self.type(p)
        while True:
            p = self.need(p, "v")
            if k[p] == "=":
                p = self.expression(p + 1)
            if k[p] != ",":
                return self.semicolon(p)
            p += 1

    def type(self, p: int) -> int:
        k = self.k
        if k[p] == "?":
            p += 1
        while True:
            if k[p] == "(":
                close = self.match[p]
                if self.type(p + 1) != close:
                    raise Bad
                p = close + 1
            elif k[p] in _TYPE_NAMES:
                p += 1
            else:
                raise Bad
            if k[p] == "|" or (k[p] == "&" and k[p + 1] not in ("v", "...", "&")):
                p += 1
                continue
            return p

    def result(self, p: int) -> int:
        return self.type(p + 1) if self.k[p] == ":" else p

    def params(self, p: int) -> int:
        self.need(p, "(")
        close, k = self.match[p], self.k
        p += 1
        while p < close:
            p = self.attributes(p)
            while k[p] in ("public", "private", "protected", "readonly"):
                p += 1
            if k[p] not in ("v", "&", "..."):
                p = self.type(p)
            if k[p] == "&":
                p += 1
            if k[p] == "...":
                p += 1
            p = self.need(p, "v")
            if k[p] == "=":
                p = self.expression(p + 1)
            if p < close:
                p = self.need(p, ",")
        return close + 1

    def parens(self, p: int) -> int:
        self.need(p, "(")
        close = self.match[p]
        if self.expression(p + 1) != close:
            raise Bad
        return close + 1

    def listed(self, p: int) -> int:
        p = self.expression(p)
        while self.k[p] == ",":
            p = self.expression(p + 1)
        return p

    def arguments(self, p: int) -> int:
        self.need(p, "(")
        close, k = self.match[p], self.k
        p += 1
        if k[p] == "..." and p + 1 == close:
            return close + 1
        while p < close:
            if k[p] == "...":
                p += 1
            elif (k[p] == "i" or k[p] in _KEYWORDS) and k[p + 1] == ":" and k[p + 2] != ":":
                p += 2
            p = self.expression(p)
            if p < close:
                p = self.need(p, ",")
        return close + 1

    def items(self, p: int) -> int:
        """An array or list, from its opening bracket on; gaps are allowed as lists have them."""
        close, k = self.match[p], self.k
        p += 1
        while p < close:
            if k[p] == ",":
                p += 1
                continue
            p = self.expression(p + 1 if k[p] == "..." else p)
            if k[p] == "=>":
                p = self.expression(p + 1)
            if p < close:
                p = self.need(p, ",")
        return close + 1

    def expression(self, p: int) -> int:
        k = self.k
        p = self.operand(p)
        while True:
            o = k[p]
            if o in _BINARY:
                p = self.operand(p + 1)
            elif o in _ASSIGN:
                if k[p - 1] not in ("v", "]", ")", "}", "i") and k[p - 1] not in _KEYWORDS:
                    raise Bad
                p = self.operand(p + 2 if o == "=" and k[p + 1] == "&" else p + 1)
            elif o == "?":
                if k[p + 1] == ":":
                    p = self.operand(p + 2)
                else:
                    p = self.need(self.expression(p + 1), ":")
                    p = self.operand(p)
            else:
                return p

    def operand(self, p: int) -> int:
        k = self.k
        while k[p] in _UNARY or k[p] == "cast":
            p += 1
        if k[p] in ("throw", "include", "include_once", "require", "require_once"):
            return self.expression(p + 1)
        if k[p] == "yield":
            p += 1
            if k[p] in (";", ")", ",", "]"):
                return p
            if k[p] == "i":
                p += k[p + 1] not in ("(", "::", ";", ")", ",", "->", "[")
            p = self.expression(p)
            return self.expression(p + 1) if k[p] == "=>" else p
        p = self.tail(self.primary(p))
        if k[p] in ("++", "--"):
            p += 1
        return p

    def primary(self, p: int) -> int:
        k = self.k
        t = k[p]
        if t in ("v", "n", "q", "i"):
            return p + 1
        if t == "$":
            p += 1
            while k[p] == "$":
                p += 1
            if k[p] == "{":
                close = self.match[p]
                if self.expression(p + 1) != close:
                    raise Bad
                return close + 1
            return self.need(p, "v")
        if t == "(":
            return self.parens(p)
        if k[p + 1] == "::" and t in _KEYWORDS:
            return p + 1  # a keyword here is taken for a class name, whatever its case
        if t == "[":
            return self.items(p)
        if t in ("array", "list") and k[p + 1] == "(":
            return self.items(p + 1)
        if t in ("isset", "empty", "eval", "unset"):
            return self.arguments(p + 1)
        if t in ("exit", "die"):
            return self.arguments(p + 1) if k[p + 1] == "(" else p + 1
        if t == "new":
            p = self.attributes(p + 1)
            if k[p] in ("class", "readonly"):
                p = self.need(p + (k[p] == "readonly"), "class")
                if k[p] == "(":
                    p = self.arguments(p)
                return self.class_body(p)
            if k[p] in ("i", "static") or k[p] in _SOFT:
                p += 1
            elif k[p] == "v":
                p += 1
                while k[p] in ("->", "?->", "::", "["):
                    if k[p] == "[":
                        p = self.items(p)
                    elif k[p + 1] in ("v", "i"):
                        p += 2
                    else:
                        raise Bad
            else:
                p = self.parens(p)
            return self.arguments(p) if k[p] == "(" else p
        if t == "match" and k[p + 1] == "(":
            p = self.parens(p + 1)
            self.need(p, "{")
            close = self.match[p]
            p += 1
            while p < close:
                if k[p] == "default" and k[p + 1] in ("=>", ","):
                    p += 1
                else:
                    p = self.expression(p)
                    while k[p] == "," and k[p + 1] != "=>":
                        p = self.expression(p + 1)
                if k[p] == ",":
                    p += 1
                p = self.expression(self.need(p, "=>"))
                if p < close:
                    p = self.need(p, ",")
            return close + 1
        if t == "#[":
            return self.primary(self.attributes(p))
        if t == "static" and k[p + 1] in ("function", "fn"):
            return self.primary(p + 1)
        if t == "fn":
            p += 1 + (k[p + 1] == "&")
            p = self.need(self.result(self.params(p)), "=>")
            return self.expression(p)
        if t == "function":
            p += 1 + (k[p + 1] == "&")
            p = self.params(p)
            if k[p] == "use":
                self.need(p + 1, "(")
                close, p = self.match[p + 1], p + 2
                while p < close:
                    p = self.need(p + (k[p] == "&"), "v")
                    if p < close:
                        p = self.need(p, ",")
                p = close + 1
            return self.block(self.result(p))
        if t == "static" or t in _SOFT or t == "namespace":
            return p + 1
        raise Bad

    def tail(self, p: int) -> int:
        k = self.k
        while True:
            o = k[p]
            if o == "(":
                p = self.arguments(p)
            elif o == "[":
                close = self.match[p]
                if p + 1 != close and self.expression(p + 1) != close:
                    raise Bad
                p = close + 1
            elif o in ("->", "?->"):
                p += 1
                if k[p] == "{":
                    close = self.match[p]
                    if self.expression(p + 1) != close:
                        raise Bad
                    p = close + 1
                elif k[p] == "v":
                    p += 1
                elif k[p] == "$":
                    p = self.primary(p)
                else:
                    p = self.word(p)
            elif o == "::":
                p += 1
                if k[p] == "{":
                    p = self.match[p] + 1
                elif k[p] in ("v", "$"):
                    p = self.primary(p)
                else:
                    p = self.word(p)
            else:
                return p


def check(text: str) -> None:
    """Raises Bad if the text is not valid PHP."""
    Parser(text).script()
