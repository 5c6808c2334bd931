"""ECMAScript modules, TypeScript and TypeScript with JSX: a tokenizer and a recursive-descent parser.

Tokens are reduced to kinds, one sign each, so that a line of a form seen before is known to be valid without
parsing it again. Only syntax is checked: neither names nor types are resolved.
"""

from __future__ import annotations

import re

from quarry.llm.grammars.common import Bad, remember

_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
#: Words that mean something in places and are names elsewhere.
_CONTEXTUAL = frozenset("abstract accessor as assert asserts async await constructor declare from get global infer interface is keyof let module namespace never of out override private protected public readonly require satisfies set static type unique yield".split())
_NAME = r"[A-Za-z_$ª-￿\U00010000-\U0010ffff][\w$‌‍]*"
_PATTERN = (
    r"""[ \t]*(?:(?P<s>[ \t\r\n\f\v   ﻿]+|//[^\n  ]*|/\*[\s\S]*?\*/)"""
    r"""|(?P<i>@NAME@)"""
    r"""|(?P<n>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)"""
    r"""|(?P<q>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"""
    r"""|(?P<p>\.\.\.|=>|\*\*=|\?\?=|&&=|\|\|=|<<=|===|!==|\?\.(?!\d)|\?\?|&&|\|\||\*\*|\+\+|--|<<|<=|==|!=|\+=|-=|\*=|%=|&=|\|=|\^=|[-{}()\[\];,<>+*%&|^!~?:=.@])"""
    r"""|(?P<d>/)|(?P<t>`)|(?P<h>\#!?[\w$]*)|(?P<x>[\s\S]))"""
)
_TOKEN = re.compile(_PATTERN.replace("@NAME@", _NAME))
#: The same where the text is ASCII only.
_ASCII = re.compile(_PATTERN.replace("@NAME@", r"[A-Za-z_$][A-Za-z0-9_$]*"), re.ASCII)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JSX_TEXT = re.compile(r"[^{}<>]*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_JSX_ATTR = re.compile(r"\s*(?:(?P<name>[A-Za-z_$][\w$:.-]*)(?P<eq>\s*=\s*(?:(?P<str>\"[^\"]*\"|'[^']*')|(?P<brace>\{)|(?P<tag><)))?|(?P<spread>\{)|(?P<close>/?>))")
_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*")
#: Tokens after which a slash or a `<` begins an operand.
_OPERAND_NEXT = frozenset("( [ { } ; , < > + * % & | ^ ! ~ ? : = - ... => **= ??= &&= ||= <<= === !== ?? && || ** << <= == != += -= *= %= &= |= ^= >= /".split()) | frozenset(
    "return typeof instanceof in of new delete void throw case do else yield await default extends".split()
)
_CLOSE = {")": "(", "]": "[", "}": "{", "T)": "(T", "X)": "(X", "J}": "{J"}


class _Signs(dict):
    """A sign for each kind, kept for the process."""

    def __missing__(self, kind: str) -> str:
        sign = self[kind] = chr(0x100 + len(self))
        return sign


_SIGN = _Signs()


class Tokens:
    """kinds, places and line starts of a text's tokens, and the partner of each bracket.

    Kinds: i name, n number, q string, r regular expression, # private name, keywords and punctuation themselves;
    (T and T) enclose a template's substitutions, (X and X) a JSX element's containers, each in {J and J}.
    `angled` tells that a `<` stands where JSX begins an element; else the tokens are the same with JSX and without.
    Text that has no tokens is `bad`. `valid` has what a parse as JavaScript (False) or TypeScript (True) came to."""

    def __init__(self, text: str, jsx: bool) -> None:
        self.text, self.jsx = text, jsx
        self.kind: list[str] = []
        self.at: list[int] = []
        self.first: list[bool] = []
        self.stack: list[tuple[str, int]] = []
        self.match: dict[int, int] = {}
        self.angled = self.bad = False
        self.valid: dict[bool, bool] = {}
        pos = text.index("\n") if text.startswith("#!") and "\n" in text else 0
        try:
            self.bad = self.run(pos, None) != len(text) or bool(self.stack)
        except Bad:
            self.bad = True
        if not self.bad:
            self.signs = "".join([_SIGN[k + "\n"] if f else _SIGN[k] for k, f in zip(self.kind, self.first, strict=True)])

    def put(self, kind: str, pos: int, first: bool) -> None:
        n = len(self.kind)
        if kind in ("(", "[", "{", "(T", "(X", "{J"):
            self.stack.append((kind, n))
        elif kind in _CLOSE:
            if not self.stack or self.stack[-1][0] != _CLOSE[kind]:
                raise Bad
            k = self.stack.pop()[1]
            self.match[k] = n
        self.kind.append(kind)
        self.at.append(pos)
        self.first.append(first)

    def run(self, pos: int, until: str | None) -> int:
        """Reads tokens; with `until` it ends before the brace that closes a substitution or container."""
        text, kind, stack, depth, line = self.text, self.kind, self.stack, len(self.stack), False
        end, token = len(text), (_ASCII if text.isascii() else _TOKEN).finditer
        append, at, first = kind.append, self.at.append, self.first.append
        while pos < end:
            for m in token(text, pos):
                g = m.lastgroup
                if g == "s":
                    if not line and "\n" in m[0]:
                        line = True
                    continue
                pos, w = m.start(g), m[g]
                if g == "i":
                    append(w if w in _RESERVED or w in _CONTEXTUAL else "i")
                elif g == "p":
                    if w in "([{":
                        stack.append((w, len(kind)))
                    elif w in ")]}":
                        if w == "}" and until is not None and len(stack) == depth:
                            return pos
                        if not stack or stack[-1][0] != _CLOSE[w]:
                            raise Bad
                        self.match[stack.pop()[1]] = len(kind)
                    elif w == "<" and (self.jsx or not self.angled) and self.operand() and (text[pos + 1 : pos + 2].isalpha() or text[pos + 1 : pos + 2] in (">", "_")) and not self.generic(pos):
                        self.angled = True
                        if self.jsx:
                            pos = self.element(pos, line)
                            break
                    append(w)
                elif g == "n":
                    if text[m.end() : m.end() + 1].isalnum() or text[m.end() : m.end() + 1] in ("_", "$") and m.end() < end:
                        raise Bad
                    if len(w) > 1 and w[0] == "0" and w[1].isdigit():
                        raise Bad
                    append("n")
                elif g == "q":
                    append("q")
                elif g == "d":
                    if self.operand():
                        r = _REGEX.match(text, pos)
                        if r is None:
                            raise Bad
                        append("r")
                        at(pos)
                        first(line)
                        pos = r.end()
                        break
                    if text[pos + 1 : pos + 2] == "=":
                        append("/=")
                        at(pos)
                        first(line)
                        pos += 2
                        break
                    append("/")
                elif g == "t":
                    pos = self.template(pos, line)
                    break
                else:
                    if g == "x" or len(w) < 2 or w[1] == "!":
                        raise Bad
                    append("#")
                at(pos)
                first(line)
                line = False
            else:
                pos = end
            line = False
        if until is not None:
            raise Bad
        return pos

    def operand(self) -> bool:
        """True if an operand, not an operator, comes next."""
        if not self.kind:
            return True
        k = self.kind[-1]
        if k in ("}", "{J"):
            return True
        if k == ")":
            return False
        return k in _OPERAND_NEXT

    def generic(self, pos: int) -> bool:
        """In TSX, `<T,>` and `<T extends` begin a generic arrow function."""
        return bool(re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\s)").match(self.text, pos))

    def template(self, pos: int, line: bool) -> int:
        self.put("(T", pos, line)
        pos += 1
        while True:
            pos = _CHUNK.match(self.text, pos).end()
            c = self.text[pos : pos + 1]
            if c == "`":
                self.put("T)", pos, False)
                return pos + 1
            if c != "$":
                raise Bad
            self.put("{J", pos, False)
            pos = self.run(pos + 2, "}")
            self.put("J}", pos, False)
            pos += 1

    def container(self, pos: int) -> int:
        """A braced expression of JSX, from the brace on."""
        self.put("{J", pos, False)
        pos = self.run(pos + 1, "}")
        self.put("J}", pos, False)
        return pos + 1

    def element(self, pos: int, line: bool) -> int:
        """A JSX element or fragment, from `<` on."""
        text = self.text
        self.put("(X", pos, line)
        pos = _SPACE.match(text, pos + 1).end()
        m = _JSX_NAME.match(text, pos)
        name = m.group() if m else ""
        if m:
            pos = m.end()
        while True:
            a = _JSX_ATTR.match(text, _SPACE.match(text, pos).end())
            if a is None:
                raise Bad
            pos = a.end()
            if a.group("close"):
                closed = a.group("close") == "/>"
                break
            if not name:
                raise Bad
            if a.group("brace") or a.group("spread"):
                pos = self.container(pos - 1)
            elif a.group("tag"):
                pos = self.element(pos - 1, False)
        while not closed:
            pos = _JSX_TEXT.match(text, pos).end()
            c = text[pos : pos + 1]
            if c == "{":
                pos = self.container(pos)
            elif c == "<":
                at = _SPACE.match(text, pos + 1).end()
                if text[at : at + 1] == "/":
                    m = re.compile(r"/\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(text, at)
                    if m is None or (m.group(1) or "") != name:
                        raise Bad
                    pos = m.end()
                    closed = True
                else:
                    pos = self.element(pos, False)
            else:
                raise Bad
        self.put("X)", pos, False)
        return pos


_BINARY = frozenset("+ * / % ** - << <= == != === !== & | ^ && || ?? in instanceof <".split())
_ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
_UNARY = frozenset("! ~ + - ++ -- typeof void delete await".split())
_NAMES = _CONTEXTUAL | {"i"}
_MODIFIERS = frozenset("public private protected static abstract readonly override declare async accessor get set".split())
_STARTS = frozenset("i n q r # ( [ { (T (X ! ~ + - ++ -- typeof void delete await new function class this super null true false import < / async yield".split()) | _CONTEXTUAL
_MEMO: dict = {}
#: Lines of more tokens are not kept.
LONG = 60


class Parser:
    def __init__(self, tokens: Tokens, ts: bool) -> None:
        self.k = [*tokens.kind, "end", "end", "end"]
        self.first = [*tokens.first, True, True, True]
        self.match, self.at, self.signs = tokens.match, [*tokens.at, -1, -1, -1], tokens.signs
        self.ts, self.end = ts, len(tokens.kind)
        self.text, self.ambient = tokens.text, False
        #: What may stand here: return, await, continue, break, super; then the labels around, and how many labelled jumps were met.
        self.around, self.labels, self.jumps = (False, True, False, False, False), (), 0

    def need(self, p: int, kind: str) -> int:
        if self.k[p] != kind:
            raise Bad
        return p + 1

    def name(self, p: int) -> int:
        if self.k[p] not in _NAMES:
            raise Bad
        return p + 1

    def semicolon(self, p: int) -> int:
        if self.k[p] == ";":
            return p + 1
        if self.k[p] in ("}", "end", "J}") or self.first[p]:
            return p
        raise Bad

    def line_end(self, p: int, end: int) -> int:
        match, first = self.match, self.first
        while p < end:
            p = match.get(p, p) + 1
            if first[p]:
                break
        return min(p, end)

    def several(self, p: int, end: int, one, mark: str) -> int:
        """Statements or members up to `end`, known lines skipped."""
        while p < end:
            j = self.line_end(p, end)
            key = None
            if j - p <= LONG:
                key = (mark, self.ts, self.ambient, self.around, self.signs[p:j], self.signs[j : j + 1])
                if key in _MEMO:
                    p = j
                    continue
            jumps = self.jumps
            while p < j:
                p = one(p)
            if p == j and key is not None and jumps == self.jumps:
                remember(_MEMO, key)
        if p != end:
            raise Bad
        return p

    def inside(self, around: tuple, part, p: int, labels: tuple = ()) -> int:
        """part(p) where other things may stand than here."""
        outer, self.around = self.around, around
        kept, self.labels = self.labels, labels
        try:
            return part(p)
        finally:
            self.around, self.labels = outer, kept

    def code(self, p: int, waits: bool, above: bool) -> int:
        """The body of a function: return may stand there, await in an async one, super in a method."""
        return self.inside((True, waits, False, False, above), self.block, p)

    def repeated(self, p: int) -> int:
        """The statement of a loop."""
        r, w, _, _, s = self.around
        return self.inside((r, w, True, True, s), self.statement, p, self.labels)

    def label(self, p: int) -> str:
        return re.compile(r"[\w$]*").match(self.text, self.at[p]).group()

    def module(self) -> None:
        self.several(0, self.end, self.top, "m")

    def top(self, p: int) -> int:
        k = self.k[p]
        if k == "import" and self.k[p + 1] not in ("(", "."):
            return self.imports(p)
        if k == "export":
            return self.exports(p)
        return self.statement(p)

    def imports(self, p: int) -> int:
        k = self.k
        p += 1
        if k[p] == "q":
            return self.attributes(p + 1)
        if self.ts and k[p] == "type" and k[p + 1] in (_NAMES | {"{", "*"}) and not (k[p + 1] == "from" and k[p + 2] == "q"):
            p += 1
        if k[p] in _NAMES:
            p += 1
            if self.ts and k[p] == "=":
                return self.semicolon(self.expression(p + 1) if k[p + 1] != "require" else self.expression(p + 1))
            if k[p] == ",":
                p += 1
                if k[p] not in ("{", "*"):
                    raise Bad
        if k[p] == "*":
            p = self.name(self.need(p + 1, "as"))
        elif k[p] == "{":
            p = self.specifiers(p)
        p = self.need(p, "from")
        return self.attributes(self.need(p, "q"))

    def attributes(self, p: int) -> int:
        if self.k[p] in ("with", "assert") and self.k[p + 1] == "{":
            p = self.match[p + 1] + 1
        return self.semicolon(p)

    def specifiers(self, p: int) -> int:
        close = self.match[p]
        p += 1
        while p < close:
            if self.ts and self.k[p] == "type" and self.k[p + 1] not in (",", "as", "}"):
                p += 1
            p = self.word(p)
            if self.k[p] == "as":
                p = self.word(p + 1)
            if p < close:
                p = self.need(p, ",")
        return close + 1

    def word(self, p: int) -> int:
        if self.k[p] in _NAMES or self.k[p] in _RESERVED or self.k[p] == "q":
            return p + 1
        raise Bad

    def exports(self, p: int) -> int:
        k = self.k
        p += 1
        if k[p] == "default":
            p += 1
            if k[p] == "function" or (k[p] == "async" and k[p + 1] == "function" and not self.first[p + 1]):
                return self.function(p, named=False)
            if k[p] in ("class", "@") or (self.ts and k[p] == "abstract" and k[p + 1] == "class"):
                return self.klass(self.decorators(p), named=False)
            if self.ts and k[p] == "interface":
                return self.statement(p)
            return self.semicolon(self.assignment(p))
        if k[p] == "*":
            p += 1
            if k[p] == "as":
                p = self.word(p + 1)
            return self.attributes(self.need(self.need(p, "from"), "q"))
        if self.ts and k[p] == "type" and k[p + 1] in ("{", "*"):
            p += 1
            if k[p] == "*":
                return self.attributes(self.need(self.need(p + 1, "from"), "q"))
        if k[p] == "{":
            p = self.specifiers(p)
            if k[p] == "from":
                return self.attributes(self.need(p + 1, "q"))
            return self.semicolon(p)
        if self.ts and k[p] == "=":
            return self.semicolon(self.expression(p + 1))
        if self.ts and k[p] == "as" and k[p + 1] == "namespace":
            return self.semicolon(self.name(p + 2))
        if self.ts and k[p] == "import":
            return self.imports(p)
        if k[p] in ("var", "let", "const", "function", "class", "async", "@") or self.ts and k[p] in ("interface", "type", "enum", "namespace", "module", "declare", "abstract"):
            return self.statement(p)
        raise Bad

    def block(self, p: int) -> int:
        self.need(p, "{")
        close = self.match[p]
        self.several(p + 1, close, self.statement, "s")
        return close + 1

    def decorators(self, p: int) -> int:
        while self.k[p] == "@":
            p += 1
            p = self.parens(p) if self.k[p] == "(" else self.call(self.name(p))
        return p

    def statement(self, p: int) -> int:
        k = self.k[p]
        n = self.k[p + 1]
        if k == "{":
            return self.block(p)
        if k == ";":
            return p + 1
        if k in ("const", "var") or (k == "let" and (n in _NAMES or n in ("[", "{"))):
            if self.ts and k == "const" and n == "enum":
                return self.enum(p + 1)
            return self.semicolon(self.declarators(p + 1, const=k == "const"))
        if k == "if":
            p = self.statement(self.parens(p + 1))
            return self.statement(p + 1) if self.k[p] == "else" else p
        if k == "return":
            if not self.around[0]:
                raise Bad
            p += 1
            if self.k[p] not in (";", "}", "end") and not self.first[p]:
                p = self.expression(p)
            return self.semicolon(p)
        if k == "for":
            return self.loop(p)
        if k == "while":
            return self.repeated(self.parens(p + 1))
        if k == "do":
            p = self.repeated(p + 1)
            p = self.parens(self.need(p, "while"))
            return p + 1 if self.k[p] == ";" else p
        if k == "throw":
            if self.first[p + 1]:
                raise Bad
            return self.semicolon(self.expression(p + 1))
        if k == "try":
            p = self.block(p + 1)
            if self.k[p] not in ("catch", "finally"):
                raise Bad
            if self.k[p] == "catch":
                p += 1
                if self.k[p] == "(":
                    close = self.match[p]
                    q = self.annotation(self.binding(p + 1))
                    if q != close:
                        raise Bad
                    p = close + 1
                p = self.block(p)
            return self.block(p + 1) if self.k[p] == "finally" else p
        if k == "switch":
            return self.switch(p)
        if k == "function" or (k == "async" and n == "function" and not self.first[p + 1]):
            return self.function(p)
        if k in ("class", "@"):
            return self.klass(self.decorators(p))
        if k in ("break", "continue"):
            p += 1
            if self.k[p] in _NAMES and not self.first[p]:
                self.jumps += 1
                if self.label(p) not in self.labels or k == "continue" and not self.around[2]:
                    raise Bad
                p += 1
            elif not self.around[3 if k == "break" else 2]:
                raise Bad
            return self.semicolon(p)
        if k == "debugger":
            return self.semicolon(p + 1)
        if k in _NAMES and n == ":":
            self.jumps += 1
            return self.inside(self.around, self.statement, p + 2, (*self.labels, self.label(p)))
        if self.ts:
            q = self.declaration(p, k, n)
            if q:
                return q
        if k in ("import", "export") and n not in ("(", "."):
            raise Bad
        return self.semicolon(self.expression(p))

    def declaration(self, p: int, k: str, n: str) -> int:
        """TypeScript's own statements; 0 if it is none."""
        if k == "interface" and n in _NAMES and not self.first[p + 1]:
            p = self.parameters_of_type(p + 2)
            if self.k[p] == "extends":
                p = self.types(p + 1)
            return self.type_members(p)
        if k == "type" and n in _NAMES and not self.first[p + 1]:
            p = self.need(self.parameters_of_type(p + 2), "=")
            return self.semicolon(self.type(p))
        if k == "enum":
            return self.enum(p)
        if k in ("namespace", "module") and (n in _NAMES or n == "q") and not self.first[p + 1]:
            p += 2
            while self.k[p] == ".":
                p = self.name(p + 1)
            if self.k[p] != "{":
                return self.semicolon(p)
            return self.space(p)
        if k == "global" and n == "{":
            return self.space(p + 1)
        if k == "abstract" and n == "class":
            return self.klass(p)
        if k == "declare" and (n in ("const", "let", "var", "function", "class", "enum", "namespace", "module", "type", "interface", "abstract", "global", "async")):
            if n in ("const", "let", "var") and self.k[p + 2] != "enum":
                return self.semicolon(self.declarators(p + 2, const=False))
            outer, self.ambient = self.ambient, True
            p = self.statement(p + 1)
            self.ambient = outer
            return p
        return 0

    def space(self, p: int) -> int:
        """The block of a namespace."""
        close = self.match[p]
        self.inside((False, False, False, False, False), lambda q: self.several(q, close, self.top, "m"), p + 1)
        return close + 1

    def enum(self, p: int) -> int:
        p = self.name(self.need(p, "enum"))
        self.need(p, "{")
        close = self.match[p]
        p += 1
        while p < close:
            p = self.expression_in(p, "[", "]") if self.k[p] == "[" else self.word(p)
            if self.k[p] == "=":
                p = self.assignment(p + 1)
            if p < close:
                p = self.need(p, ",")
        return close + 1

    def declarators(self, p: int, const: bool, loop: bool = False) -> int:
        while True:
            pattern = self.k[p] in ("[", "{")
            p = self.binding(p)
            if self.ts and self.k[p] == "!":
                p += 1
            p = self.annotation(p)
            if self.k[p] == "=":
                p = self.assignment(p + 1, loop)
            elif (const or pattern) and not loop and not self.ambient:
                raise Bad
            if self.k[p] != ",":
                return p
            p += 1

    def binding(self, p: int) -> int:
        k = self.k[p]
        if k in _NAMES:
            return p + 1
        if k == "[":
            close = self.match[p]
            p += 1
            while p < close:
                if self.k[p] == ",":
                    p += 1
                    continue
                if self.k[p] == "...":
                    p += 1
                p = self.default(self.binding(p))
                if p < close:
                    p = self.need(p, ",")
            return close + 1
        if k == "{":
            close = self.match[p]
            p += 1
            while p < close:
                if self.k[p] == "...":
                    p = self.binding(p + 1)
                else:
                    short = self.k[p] in _NAMES
                    p = self.key(p)
                    if self.k[p] == ":":
                        p = self.binding(p + 1)
                    elif not short:
                        raise Bad
                    p = self.default(p)
                if p < close:
                    p = self.need(p, ",")
            return close + 1
        raise Bad

    def default(self, p: int) -> int:
        return self.assignment(p + 1) if self.k[p] == "=" else p

    def key(self, p: int) -> int:
        k = self.k[p]
        if k == "[":
            return self.expression_in(p, "[", "]")
        if k in _NAMES or k in _RESERVED or k in ("q", "n", "#"):
            return p + 1
        raise Bad

    def expression_in(self, p: int, opening: str, _: str) -> int:
        self.need(p, opening)
        close = self.match[p]
        if self.expression(p + 1) != close:
            raise Bad
        return close + 1

    def parens(self, p: int) -> int:
        return self.expression_in(p, "(", ")")

    def loop(self, p: int) -> int:
        p += 1
        if self.k[p] == "await":
            if not self.around[1]:
                raise Bad
            p += 1
        self.need(p, "(")
        close = self.match[p]
        p += 1
        k = self.k
        if k[p] in ("var", "const") or (k[p] == "let" and (k[p + 1] in _NAMES or k[p + 1] in ("[", "{"))):
            p = self.declarators(p + 1, const=False, loop=True)
        elif k[p] != ";":
            p = self.expression(p, loop=True)
        if k[p] in ("of", "in"):
            p = self.expression(p + 1) if k[p] == "in" else self.assignment(p + 1)
        else:
            p = self.need(p, ";")
            if k[p] != ";":
                p = self.expression(p)
            p = self.need(p, ";")
            if p != close:
                p = self.expression(p)
        if p != close:
            raise Bad
        return self.repeated(close + 1)

    def switch(self, p: int) -> int:
        p = self.parens(p + 1)
        self.need(p, "{")
        r, w, c, _, s = self.around
        return self.inside((r, w, c, True, s), self.cases, p, self.labels)

    def cases(self, p: int) -> int:
        close = self.match[p]
        p += 1
        while p < close:
            if self.k[p] == "case":
                p = self.need(self.expression(p + 1), ":")
            elif self.k[p] == "default":
                p = self.need(p + 1, ":")
            else:
                raise Bad
            while p < close and self.k[p] not in ("case", "default"):
                p = self.statement(p)
        return close + 1

    def function(self, p: int, named: bool = True) -> int:
        waits = self.k[p] == "async"
        p = self.need(p + waits, "function")
        if self.k[p] == "*":
            p += 1
        if self.k[p] in _NAMES:
            p += 1
        elif named:
            raise Bad
        p = self.result(self.params(self.parameters_of_type(p)))
        if self.ts and self.k[p] != "{":
            return self.semicolon(p)
        return self.code(p, waits, False)

    def params(self, p: int) -> int:
        self.need(p, "(")
        close = self.match[p]
        p += 1
        while p < close:
            p = self.decorators(p)
            if self.ts:
                while self.k[p] in _MODIFIERS and self.k[p + 1] not in (",", ")", ":", "=", "?"):
                    p += 1
                if self.k[p] == "this":
                    p = self.annotation(p + 1)
                    if p < close:
                        p = self.need(p, ",")
                    continue
            rest = self.k[p] == "..."
            p = self.binding(p + rest)
            if self.ts and self.k[p] == "?":
                p += 1
            p = self.default(self.annotation(p))
            if p < close:
                p = self.need(p, ",")
                if rest:
                    raise Bad
        return close + 1

    def annotation(self, p: int) -> int:
        return self.type(p + 1) if self.ts and self.k[p] == ":" else p

    def result(self, p: int) -> int:
        if not (self.ts and self.k[p] == ":"):
            return p
        p += 1
        if self.k[p] == "asserts" and self.k[p + 1] in (_NAMES | {"this"}) and not self.first[p + 1]:
            p += 2
            return self.type(p + 1) if self.k[p] == "is" else p
        if self.k[p] in (_NAMES | {"this"}) and self.k[p + 1] == "is" and not self.first[p + 1]:
            return self.type(p + 2)
        return self.type(p)

    def klass(self, p: int, named: bool = True) -> int:
        if self.k[p] == "abstract":
            p += 1
        p = self.need(p, "class")
        if self.k[p] in _NAMES and not (self.k[p] == "implements"):
            p += 1
        elif named:
            raise Bad
        p = self.parameters_of_type(p)
        if self.k[p] == "extends":
            p = self.call(self.primary(p + 1))
            if self.ts and self.k[p] == "<":
                p = self.arguments_of_type(p)
        if self.ts and self.k[p] == "i" and self.text.startswith("implements", self.at[p]):
            p = self.types(p + 1)
        self.need(p, "{")
        close = self.match[p]
        self.several(p + 1, close, self.member, "c")
        return close + 1

    def member(self, p: int) -> int:
        k = self.k
        if k[p] == ";":
            return p + 1
        p = self.decorators(p)
        if k[p] == "static" and k[p + 1] == "{":
            return self.inside((False, False, False, False, True), self.block, p + 1)
        waits = False
        words = _MODIFIERS if self.ts else frozenset(("static", "async", "get", "set", "accessor"))
        while k[p] in words and k[p + 1] not in ("(", "=", ";", ":", "}", "?", "!", "<") and not (self.first[p + 1] and k[p] in ("get", "set", "async", "accessor")):
            waits = waits or k[p] == "async"
            p += 1
        if k[p] == "*":
            p += 1
        if self.ts and k[p] == "[" and k[p + 1] in _NAMES and k[p + 2] == ":":
            close = self.match[p]
            if self.type(p + 3) != close:
                raise Bad
            return self.semicolon(self.annotation(close + 1))
        p = self.key(p)
        if self.ts and k[p] in ("?", "!"):
            p += 1
        if k[p] in ("(", "<"):
            p = self.result(self.params(self.parameters_of_type(p)))
            if self.ts and k[p] != "{":
                return self.semicolon(p)
            return self.code(p, waits, True)
        return self.semicolon(self.inside((False, False, False, False, True), self.default, self.annotation(p)))

    def expression(self, p: int, loop: bool = False) -> int:
        p = self.assignment(p, loop)
        while self.k[p] == ",":
            p = self.assignment(p + 1, loop)
        return p

    def arrow(self, p: int) -> int:
        """The place behind an arrow function that begins here, or 0."""
        k = self.k
        q = p
        waits = False
        if k[q] == "async" and not self.first[q + 1] and (k[q + 1] in _NAMES or k[q + 1] in ("(", "<")):
            q += 1
            waits = True
        if k[q] in _NAMES and k[q + 1] == "=>":
            return self.body(q + 2, waits)
        if self.ts and k[q] == "<":
            try:
                q = self.parameters_of_type(q)
            except Bad:
                return 0
        if k[q] != "(" or q not in self.match:
            return 0
        after = self.match[q] + 1
        if k[after] == "=>":
            if self.first[after]:
                raise Bad
            return self.body(self.params(q) + 1, waits)
        if self.ts and k[after] == ":":
            try:
                r = self.result(self.params(q))
                if k[r] == "=>":
                    return self.body(r + 1, waits)
            except Bad:
                return 0
        return 0

    def body(self, p: int, waits: bool) -> int:
        return self.inside((True, waits, False, False, self.around[4]), self.block if self.k[p] == "{" else self.assignment, p)

    def assignment(self, p: int, loop: bool = False) -> int:
        k = self.k
        if k[p] in ("(", "async", "<") or (k[p] in _NAMES and k[p + 1] == "=>"):
            q = self.arrow(p)
            if q:
                return q
        if k[p] == "yield" and k[p + 1] not in ("=", ".", "("):
            p += 1
            if k[p] == "*":
                return self.assignment(p + 1, loop)
            if self.first[p] or k[p] in (")", "]", "}", ",", ";", "end", ":", "J}"):
                return p
            return self.assignment(p, loop)
        start = p
        p = self.binary(p, loop)
        if k[p] == "?":
            p = self.assignment(p + 1)
            return self.assignment(self.need(p, ":"), loop)
        if k[p] in _ASSIGN:
            if not self.assignable(start, p):
                raise Bad
            return self.assignment(p + 1, loop)
        return p

    def assignable(self, start: int, p: int) -> bool:
        last = self.k[p - 1]
        if self.k[start] in ("{", "[", "("):
            return True
        if self.k[start] in ("n", "q", "r", "function", "class", "(X") and p == start + 1:
            return False
        return last in _NAMES or last in _RESERVED or last in ("]", "#", "!", ")", ">") and not (last == ")" and self.k[start] != "(" and not self.ts)

    def binary(self, p: int, loop: bool = False) -> int:
        k = self.k
        if k[p] == "#" and k[p + 1] == "in":
            p += 1
        else:
            p = self.unary(p)
        while True:
            o = k[p]
            if o == "in" and loop:
                return p
            if o in _BINARY:
                p = self.unary(p + 1)
            elif o == ">":
                p += 1
                while k[p] == ">" and self.at[p] == self.at[p - 1] + 1:
                    p += 1
                if k[p] in ("=", "==") and self.at[p] == self.at[p - 1] + 1:
                    if k[p - 2] == ">" and self.at[p - 1] == self.at[p - 2] + 1 and k[p] == "=":
                        return self.assignment(p + 1)
                    p += 1
                p = self.unary(p)
            elif self.ts and o in ("as", "satisfies") and not self.first[p]:
                p = p + 2 if k[p + 1] == "const" else self.type(p + 1)
            else:
                return p

    def unary(self, p: int) -> int:
        k = self.k
        while k[p] in _UNARY and not (k[p] == "await" and k[p + 1] in ("=", ",", ")", ";", ".", "=>")):
            if k[p] == "await" and not self.around[1]:
                raise Bad
            p += 1
        if self.ts and k[p] == "<":
            p = self.unary(self.need(self.type(p + 1), ">"))
            return p
        p = self.call(self.primary(p))
        if k[p] in ("++", "--") and not self.first[p]:
            if self.k[p - 1] in ("n", "q", "r"):
                raise Bad
            p += 1
        return p

    def call(self, p: int) -> int:
        k = self.k
        while True:
            o = k[p]
            if o == ".":
                p += 1
                if k[p] in _NAMES or k[p] in _RESERVED or k[p] == "#":
                    p += 1
                else:
                    raise Bad
            elif o == "(":
                p = self.arguments(p)
            elif o == "[":
                p = self.expression_in(p, "[", "]")
            elif o == "?.":
                p += 1
                if k[p] == "(":
                    p = self.arguments(p)
                elif k[p] == "[":
                    p = self.expression_in(p, "[", "]")
                elif k[p] in _NAMES or k[p] in _RESERVED or k[p] == "#":
                    p += 1
                else:
                    raise Bad
            elif o == "(T":
                p = self.holes(p)
            elif self.ts and o == "!" and not self.first[p] and k[p + 1] not in ("i",):
                p += 1
            elif self.ts and o == "<" and not self.first[p]:
                try:
                    q = self.arguments_of_type(p)
                except Bad:
                    return p
                if k[q] in ("(", "(T", ")", "]", ",", ";", ":", "}", "end", ".", "?.", "=", "J}") or self.first[q]:
                    p = q
                else:
                    return p
            else:
                return p

    def arguments(self, p: int) -> int:
        close = self.match[p]
        p += 1
        while p < close:
            if self.k[p] == "...":
                p += 1
            p = self.assignment(p)
            if p < close:
                p = self.need(p, ",")
        return close + 1

    def holes(self, p: int) -> int:
        """The substitutions of a template or the containers of an element."""
        close = self.match[p]
        jsx = self.k[p] == "(X"
        p += 1
        while p < close:
            if self.k[p] == "(X":
                p = self.holes(p)
                continue
            self.need(p, "{J")
            end = self.match[p]
            if p + 1 == end:
                if not jsx:
                    raise Bad
            else:
                q = p + 2 if jsx and self.k[p + 1] == "..." else p + 1
                if self.expression(q) != end:
                    raise Bad
            p = end + 1
        return close + 1

    def primary(self, p: int) -> int:
        k = self.k[p]
        if k in ("i", "n", "q", "r", "this", "null", "true", "false") or k == "super" and self.around[4]:
            return p + 1
        if k == "(":
            return self.parens(p)
        if k == "[":
            close = self.match[p]
            p += 1
            while p < close:
                if self.k[p] == ",":
                    p += 1
                    continue
                if self.k[p] == "...":
                    p += 1
                p = self.assignment(p)
                if p < close:
                    p = self.need(p, ",")
            return close + 1
        if k == "{":
            return self.literal(p)
        if k in ("(T", "(X"):
            return self.holes(p)
        if k == "function" or (k == "async" and self.k[p + 1] == "function" and not self.first[p + 1]):
            q = p + (k == "async")
            p = q + 1
            if self.k[p] == "*":
                p += 1
            if self.k[p] in _NAMES:
                p += 1
            return self.code(self.result(self.params(self.parameters_of_type(p))), k == "async", False)
        if k in ("class", "@"):
            return self.klass(self.decorators(p), named=False)
        if k == "new":
            if self.k[p + 1] == ".":
                return self.name(p + 2) if self.k[p + 2] in _NAMES else self.need(p + 2, "target")
            p = self.primary(p + 1)
            while self.k[p] in (".", "[") or (self.ts and self.k[p] == "!" and not self.first[p]):
                if self.k[p] == ".":
                    p = self.word(p + 1) if self.k[p + 1] != "#" else p + 2
                elif self.k[p] == "[":
                    p = self.expression_in(p, "[", "]")
                else:
                    p += 1
            if self.ts and self.k[p] == "<":
                try:
                    p = self.arguments_of_type(p)
                except Bad:
                    return p
            return self.arguments(p) if self.k[p] == "(" else p
        if k == "import":
            if self.k[p + 1] == "(":
                return self.arguments(p + 1)
            return self.name(self.need(p + 1, "."))
        if k in _CONTEXTUAL:
            return p + 1
        raise Bad

    def literal(self, p: int) -> int:
        close = self.match[p]
        p += 1
        k = self.k
        while p < close:
            if k[p] == "...":
                p = self.assignment(p + 1)
            else:
                waits = False
                if k[p] in ("get", "set", "async") and k[p + 1] not in (",", ":", "(", "}", "=", "<") and not (k[p] == "async" and self.first[p + 1]):
                    waits = k[p] == "async"
                    p += 1
                if k[p] == "*":
                    p += 1
                short = k[p] in _NAMES
                p = self.key(p)
                if k[p] in ("(", "<"):
                    p = self.code(self.result(self.params(self.parameters_of_type(p))), waits, True)
                elif k[p] == ":":
                    p = self.assignment(p + 1)
                elif short:
                    p = self.default(p)
                else:
                    raise Bad
            if p < close:
                p = self.need(p, ",")
        return close + 1

    # Types.

    def parameters_of_type(self, p: int) -> int:
        if not (self.ts and self.k[p] == "<"):
            return p
        p += 1
        while True:
            while self.k[p] in ("const", "in", "out") and self.k[p + 1] in _NAMES:
                p += 1
            p = self.name(p)
            if self.k[p] == "extends":
                p = self.type(p + 1)
            if self.k[p] == "=":
                p = self.type(p + 1)
            if self.k[p] == ",":
                p += 1
                if self.k[p] == ">":
                    return p + 1
                continue
            return self.need(p, ">")

    def arguments_of_type(self, p: int) -> int:
        self.need(p, "<")
        p = self.types(p + 1)
        return self.need(p, ">")

    def types(self, p: int) -> int:
        p = self.type(p)
        while self.k[p] == ",":
            p = self.type(p + 1)
        return p

    def type(self, p: int) -> int:
        k = self.k
        q = p
        if k[q] == "abstract" and k[q + 1] == "new":
            q += 1
        if k[q] == "new":
            q += 1
        if k[q] == "<" or (k[q] == "(" and q in self.match and k[self.match[q] + 1] == "=>"):
            q = self.params(self.parameters_of_type(q))
            q = self.need(q, "=>")
            return self.result_type(q)
        if k[p] in ("|", "&"):
            p += 1
        p = self.operand_type(p)
        while k[p] in ("|", "&"):
            p = self.operand_type(p + 1)
        if k[p] == "extends" and not self.first[p]:
            r = self.type(p + 1)
            if k[r] == "?":
                r = self.need(self.type(r + 1), ":")
                return self.type(r)
            raise Bad
        return p

    def result_type(self, p: int) -> int:
        if self.k[p] in (_NAMES | {"this"}) and self.k[p + 1] == "is":
            return self.type(p + 2)
        return self.type(p)

    def operand_type(self, p: int) -> int:
        k = self.k
        while k[p] in ("keyof", "unique", "readonly") and (k[p + 1] in _NAMES or k[p + 1] in ("(", "[", "{", "typeof", "this", "q")) and not self.first[p + 1]:
            p += 1
        if k[p] == "infer" and k[p + 1] in _NAMES:
            p += 2
        elif k[p] == "typeof":
            p += 1
            p = self.arguments(p + 1) if k[p] == "import" else p + 1
            while k[p] == ".":
                p = self.word(p + 1)
            if k[p] == "<":
                p = self.arguments_of_type(p)
        elif k[p] == "import":
            p = self.arguments(p + 1)
            while k[p] == ".":
                p = self.word(p + 1)
            if k[p] == "<":
                p = self.arguments_of_type(p)
        elif k[p] == "(":
            close = self.match[p]
            if k[close + 1] == "=>":
                return self.type(p)
            if self.type(p + 1) != close:
                raise Bad
            p = close + 1
        elif k[p] == "[":
            close = self.match[p]
            p += 1
            while p < close:
                if k[p] == "...":
                    p += 1
                if k[p] in _NAMES and (k[p + 1] == ":" or (k[p + 1] == "?" and k[p + 2] == ":")):
                    p += 2 + (k[p + 1] == "?")
                p = self.type(p)
                if k[p] == "?":
                    p += 1
                if p < close:
                    p = self.need(p, ",")
            p = close + 1
        elif k[p] == "{":
            p = self.type_members(p)
        elif k[p] in ("q", "n", "true", "false", "null", "this", "void"):
            p += 1
        elif k[p] == "-" and k[p + 1] == "n":
            p += 2
        elif k[p] == "(T":
            close = self.match[p]
            p += 1
            while p < close:
                if self.type(p + 1) != self.match[p]:
                    raise Bad
                p = self.match[p] + 1
            p = close + 1
        elif k[p] in _NAMES:
            p += 1
            while k[p] == ".":
                p = self.word(p + 1)
            if k[p] == "<" and not self.first[p]:
                p = self.arguments_of_type(p)
        else:
            raise Bad
        while k[p] == "[" and not self.first[p]:
            close = self.match[p]
            if p + 1 != close and self.type(p + 1) != close:
                raise Bad
            p = close + 1
        return p

    def type_members(self, p: int) -> int:
        self.need(p, "{")
        close = self.match[p]
        k = self.k
        p += 1
        while p < close:
            if k[p] in ("+", "-"):
                p += 1
            while k[p] in ("readonly", "get", "set") and k[p + 1] not in ("(", ":", "?", ",", ";", "<", "}"):
                p += 1
            if k[p] == "[" and k[p + 1] in _NAMES and k[p + 2] in (":", "in"):
                end = self.match[p]
                q = self.type(p + 3)
                if k[q] == "as":
                    q = self.type(q + 1)
                if q != end:
                    raise Bad
                p = end + 1
            elif k[p] in ("(", "<"):
                pass
            elif k[p] == "new" and k[p + 1] in ("(", "<"):
                p += 1
            else:
                p = self.key(p)
            if k[p] in ("+", "-"):
                p += 1
            if k[p] == "?":
                p += 1
            if k[p] in ("(", "<"):
                p = self.params(self.parameters_of_type(p))
            p = self.result(p)
            if p < close:
                if k[p] in (";", ","):
                    p += 1
                elif not self.first[p]:
                    raise Bad
        return close + 1


_LAST: dict[bool, Tokens] = {}


def tokens(text: str, jsx: bool) -> Tokens:
    """The tokens of a text; those last read, with JSX or without, serve again, each for the other where no `<` tells them apart."""
    for kept in (_LAST.get(jsx), _LAST.get(not jsx)):
        if kept is not None and kept.text == text and (kept.jsx == jsx or not kept.angled):
            return kept
    _LAST.pop(jsx, None)
    _LAST[jsx] = Tokens(text, jsx)
    return _LAST[jsx]


def check(text: str, lang: str) -> None:
    """Raises Bad if the text is not a valid js, ts or tsx module; ts and tsx are one grammar where their tokens are the same."""
    read, ts = tokens(text, lang == "tsx"), lang != "js"
    if not read.bad and ts not in read.valid:
        try:
            Parser(read, ts).module()
            read.valid[ts] = True
        except Bad:
            read.valid[ts] = False
    if read.bad or not read.valid[ts]:
        raise Bad
