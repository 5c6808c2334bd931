"""Bash: words with their quotes and substitutions, lists, pipelines and compound commands."""

from __future__ import annotations

import re

from quarry.llm.grammars.common import Bad

_BLANK = re.compile(r"(?:[ \t]|\\\n)+")
_WORD_PLAIN = re.compile(r"[^\s'\"\\$`&|;<>()]+")
_NAME = re.compile(r"[A-Za-z_]\w*(?=\[|\+?=)|[A-Za-z_]\w*")
_ASSIGN = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=")
_REDIRECT = re.compile(r"(?:\d+|\{\w+\})?(?:<<<|<<-?|<>|<&|>&|>>|>\||&>>|&>|<|>)")
_DOUBLE = re.compile(r"[^\"\\$`]+|\\[\s\S]")
_RESERVED = frozenset("then else elif fi do done esac in }".split())
_FUNCTION = re.compile(r"function[ \t]+([^\s(){}<>;&|\"'$`]+)[ \t]*(?:\([ \t]*\))?")
_NAMED = re.compile(r"([^\s(){}<>;&|\"'$`=]+)[ \t]*\([ \t]*\)")
_KEYWORD = re.compile(r"(?:if|then|elif|else|fi|for|while|until|do|done|case|esac|in|select|function|time|coproc)(?![^\s;&|()<>])|[{}!](?=[\s;&|()<>]|\Z)|\[\[(?=\s)")
_SIMPLE = re.compile(r"[A-Za-z_][\w.-]*(?:[ \t]+(?:[\w./:@%+,=-]+|\"[^\"\\$`\n]*(?:\$(?:\w+|\{\w+\})[^\"\\$`\n]*)*\"|'[^'\n]*'|\$\w+|\$\{\w+\}))*[ \t]*(?:;?[ \t]*)(?=\n|\Z)")


class Parser:
    def __init__(self, text: str) -> None:
        self.t = text
        self.n = len(text)
        self.heredocs: list[tuple[str, bool]] = []

    def blank(self, p: int) -> int:
        m = _BLANK.match(self.t, p)
        p = m.end() if m else p
        if self.t.startswith("#", p) and (p == 0 or self.t[p - 1] in " \t\n;&|()"):
            e = self.t.find("\n", p)
            p = self.n if e < 0 else e
        return p

    def newline(self, p: int) -> int:
        """Past a line break and the here-documents that begin on the line before it."""
        p += 1
        for word, tabs in self.heredocs:
            while True:
                if p >= self.n:
                    break
                e = self.t.find("\n", p)
                e = self.n if e < 0 else e
                line = self.t[p:e].rstrip("\r")
                p = min(self.n, e + 1)
                if (line.lstrip("\t") if tabs else line) == word:
                    break
        self.heredocs.clear()
        return p

    def gap(self, p: int) -> int:
        """Blanks, comments and line breaks."""
        while True:
            p = self.blank(p)
            if p < self.n and self.t[p] in "\n":
                p = self.newline(p)
            elif self.t.startswith("\r\n", p):
                p = self.newline(p + 1)
            else:
                return p

    def keyword(self, p: int) -> str:
        m = _KEYWORD.match(self.t, p)
        return m.group() if m else ""

    def script(self) -> None:
        p = self.items(0, ())
        if p != self.n:
            raise Bad

    def items(self, p: int, stop: tuple[str, ...], close: str = "") -> int:
        """Commands up to a keyword of `stop` or the sign `close`, which is left."""
        p = self.gap(p)
        count = 0
        while p < self.n:
            if close and self.t.startswith(close, p):
                break
            k = self.keyword(p)
            if k and k in stop:
                break
            if k in _RESERVED:
                raise Bad
            p = self.blank(self.pipeline(p))
            count += 1
            c = self.t[p : p + 1]
            if c == "":
                break
            if self.t.startswith(("&&", "||"), p):
                p = self.gap(p + 2)
                if p >= self.n or (close and self.t.startswith(close, p)):
                    raise Bad
                continue
            if c == "\r" and self.t.startswith("\r\n", p):
                p = self.gap(p)
            elif c == "\n":
                p = self.gap(p)
            elif c == ";" and not self.t.startswith(";;", p):
                p = self.gap(p + 1)
                if self.t.startswith(";", p) and not self.t.startswith(";;", p):
                    raise Bad
            elif c == "&":
                p = self.gap(p + 1)
                if self.t.startswith(("&", ";"), p):
                    raise Bad
            elif close and self.t.startswith(close, p) or self.t.startswith(";;", p) and "esac" in stop:
                break
            else:
                raise Bad
        if not count and (stop and stop != ("esac",) or close == ")"):
            if close != ")" or stop:
                raise Bad
        return p

    def pipeline(self, p: int) -> int:
        while self.keyword(p) in ("!", "time") and self.keyword(p):
            p = self.blank(p + len(self.keyword(p)))
        p = self.command(p)
        while True:
            q = self.blank(p)
            if self.t.startswith("|&", q):
                p = self.command(self.gap(q + 2))
            elif self.t.startswith("|", q) and not self.t.startswith("||", q):
                p = self.command(self.gap(q + 1))
            else:
                return p

    def command(self, p: int) -> int:
        t = self.t
        if p >= self.n:
            raise Bad
        k = self.keyword(p)
        if k and k not in ("in",):
            if k == "if":
                p = self.after(self.items(p + 2, ("then",)), "then")
                while True:
                    p = self.items(p, ("elif", "else", "fi"))
                    k = self.keyword(p)
                    p += len(k)
                    if k == "elif":
                        p = self.after(self.items(p, ("then",)), "then")
                    elif k == "else":
                        p = self.after(self.items(p, ("fi",)), "fi")
                        break
                    elif k == "fi":
                        break
                    else:
                        raise Bad
                return self.redirects(p)
            if k in ("while", "until"):
                p = self.after(self.items(p + 5, ("do",)), "do")
                return self.redirects(self.after(self.items(p, ("done",)), "done"))
            if k in ("for", "select"):
                p = self.blank(p + len(k))
                if t.startswith("((", p):
                    p = self.arithmetic(p + 2)
                else:
                    m = _NAME.match(t, p)
                    if not m:
                        raise Bad
                    p = self.gap(m.end())
                    if self.keyword(p) == "in":
                        p = self.blank(p + 2)
                        while p < self.n and t[p] not in "\n;\r":
                            p = self.blank(self.word(p))
                p = self.blank(p)
                if t.startswith(";", p):
                    p += 1
                p = self.gap(p)
                if self.keyword(p) == "{":
                    return self.redirects(self.after(self.items(p + 1, ("}",)), "}"))
                return self.redirects(self.after(self.items(self.after(p, "do"), ("done",)), "done"))
            if k == "case":
                return self.case(p)
            if k == "{":
                return self.redirects(self.after(self.items(p + 1, ("}",)), "}"))
            if k == "[[":
                return self.redirects(self.test(p + 2))
            if k == "function":
                m = _FUNCTION.match(t, p)
                if not m:
                    raise Bad
                return self.body(self.gap(m.end()))
            if k == "coproc":
                return self.command(self.blank(p + 6))
            raise Bad
        if t.startswith("((", p):
            try:
                return self.redirects(self.arithmetic(p + 2))
            except Bad:
                pass
        if t[p] == "(":
            q = self.items(p + 1, (), ")")
            if not t.startswith(")", q) or q == self.gap(p + 1):
                raise Bad
            return self.redirects(q + 1)
        m = _SIMPLE.match(t, p)
        if m and m.end() > p:
            e = m.end()
            while e > p and t[e - 1] in " \t;":
                e -= 1
            return e
        m = _NAMED.match(t, p)
        if m:
            return self.body(self.gap(m.end()))
        return self.simple(p)

    def body(self, p: int) -> int:
        if self.keyword(p) in ("{", "if", "for", "while", "until", "case", "[[", "select") or self.t.startswith("(", p):
            return self.command(p)
        raise Bad

    def after(self, p: int, word: str) -> int:
        if self.keyword(p) != word:
            raise Bad
        return p + len(word)

    def simple(self, p: int) -> int:
        t = self.t
        seen = 0
        while True:
            p = self.blank(p)
            if p >= self.n or t[p] in "\n;&|)" and not _REDIRECT.match(t, p) or t.startswith("\r\n", p):
                break
            r = _REDIRECT.match(t, p)
            if r and not t.startswith(("<(", ">("), p):
                p = self.redirect(p)
            elif t[p] == "(":
                raise Bad
            else:
                a = _ASSIGN.match(t, p)
                if a and t.startswith("(", a.end()):
                    p = self.array(a.end() + 1)
                else:
                    p = self.word(p)
            seen += 1
        if not seen:
            raise Bad
        return p

    def array(self, p: int) -> int:
        while True:
            p = self.gap(p)
            if p >= self.n:
                raise Bad
            if self.t[p] == ")":
                return p + 1
            p = self.word(p)

    def redirects(self, p: int) -> int:
        while True:
            q = self.blank(p)
            if not _REDIRECT.match(self.t, q):
                return p
            p = self.redirect(q)

    def redirect(self, p: int) -> int:
        m = _REDIRECT.match(self.t, p)
        q = self.blank(m.end())
        e = self.word(q)
        if "<<" in m.group() and "<<<" not in m.group():
            self.heredocs.append((re.sub(r"[\\'\"]", "", self.t[q:e]), m.group().endswith("-")))
        return e

    def word(self, p: int) -> int:
        t, start = self.t, p
        while p < self.n:
            m = _WORD_PLAIN.match(t, p)
            if m:
                p = m.end()
                continue
            c = t[p]
            if c == "\\":
                p += 2
            elif c == "'":
                e = t.find("'", p + 1)
                if e < 0:
                    raise Bad
                p = e + 1
            elif c == '"':
                p = self.double(p + 1)
            elif c == "$":
                p = self.dollar(p)
            elif c == "`":
                p = self.backquote(p)
            elif c in "<>" and t.startswith("(", p + 1):
                p = self.substitution(p + 2)
            elif c == "(" and p > start and t[p - 1] in "?*+@!":
                p = self.pattern(p + 1)
            else:
                break
        if p == start:
            raise Bad
        return min(p, self.n)

    def pattern(self, p: int) -> int:
        while p < self.n and self.t[p] != ")":
            p = p + 1 if self.t[p] in "| " else self.word(p)
        if p >= self.n:
            raise Bad
        return p + 1

    def double(self, p: int) -> int:
        t = self.t
        while p < self.n:
            m = _DOUBLE.match(t, p)
            if m:
                p = m.end()
            elif t[p] == '"':
                return p + 1
            elif t[p] == "$":
                p = self.dollar(p)
            else:
                p = self.backquote(p)
        raise Bad

    def backquote(self, p: int) -> int:
        m = re.compile(r"(?:[^`\\]|\\[\s\S])*").match(self.t, p + 1)
        if not self.t.startswith("`", m.end()):
            raise Bad
        Parser(re.sub(r"\\([`\\$])", r"\1", m.group())).script()
        return m.end() + 1

    def dollar(self, p: int) -> int:
        t = self.t
        if t.startswith("$((", p):
            try:
                return self.arithmetic(p + 3)
            except Bad:
                return self.substitution(p + 2)
        if t.startswith("$(", p):
            return self.substitution(p + 2)
        if t.startswith("${", p):
            p += 2
            while p < self.n and t[p] != "}":
                c = t[p]
                if c == "'" :
                    e = t.find("'", p + 1)
                    p = e + 1 if e >= 0 else p + 1
                elif c == '"':
                    p = self.double(p + 1)
                elif c == "$":
                    p = self.dollar(p)
                elif c == "`":
                    p = self.backquote(p)
                else:
                    p += 2 if c == "\\" else 1
            if p >= self.n:
                raise Bad
            return p + 1
        if t.startswith("$'", p):
            m = re.compile(r"(?:[^'\\]|\\[\s\S])*'").match(t, p + 2)
            if not m:
                raise Bad
            return m.end()
        return p + 1

    def substitution(self, p: int) -> int:
        kept, self.heredocs = self.heredocs, []
        p = self.items(p, (), ")")
        self.heredocs = kept
        if not self.t.startswith(")", p):
            raise Bad
        return p + 1

    def arithmetic(self, p: int) -> int:
        depth, t = 0, self.t
        while p < self.n:
            c = t[p]
            if c == "(":
                depth += 1
            elif c == ")":
                if depth == 0:
                    if t.startswith("))", p):
                        return p + 2
                    raise Bad
                depth -= 1
            elif c == "$":
                p = self.dollar(p)
                continue
            elif c == '"':
                p = self.double(p + 1)
                continue
            p += 1
        raise Bad

    def test(self, p: int) -> int:
        t, last, depth = self.t, "", 0
        seen = 0
        while True:
            p = self.gap(p)
            if p >= self.n:
                raise Bad
            if t.startswith("]]", p) and (p + 2 >= self.n or t[p + 2] in " \t\n;&|)<>\r"):
                if not seen or depth or last == "op":
                    raise Bad
                return p + 2
            if t.startswith(("&&", "||"), p):
                if last == "op":
                    raise Bad
                p, last = p + 2, "op"
            elif t[p] in "()":
                depth += 1 if t[p] == "(" else -1
                p += 1
            elif t[p] in "<>":
                p += 1
            elif t.startswith("=~", p):
                p = self.blank(p + 2)
                while p < self.n and not t[p].isspace():
                    p = self.word(p) if t[p] in "'\"$`" else p + (2 if t[p] == "\\" else 1)
                last = ""
            else:
                p, last = self.word(p), ""
            seen += 1

    def case(self, p: int) -> int:
        t = self.t
        p = self.gap(self.word(self.blank(p + 4)))
        p = self.gap(self.after(p, "in"))
        while True:
            if self.keyword(p) == "esac":
                return self.redirects(p + 4)
            if t.startswith("(", p):
                p = self.blank(p + 1)
            while True:
                p = self.blank(self.word(p))
                if t.startswith("|", p):
                    p = self.blank(p + 1)
                    continue
                break
            if not t.startswith(")", p):
                raise Bad
            p = self.items(p + 1, ("esac",))
            if t.startswith(";;", p):
                p += 2
                if t.startswith("&", p):
                    p += 1
                p = self.gap(p)
            elif self.keyword(p) != "esac":
                raise Bad


def check(text: str) -> None:
    """Raises Bad if `bash -n` would refuse the text."""
    Parser(text).script()
