"""Parses the regular expressions that rules are written in: enough of the syntax to derive what a match must hold.

    ("chars", set or None)   one character of an ASCII set, or of one that isn't listed (None)
    ("seq", nodes)           one after another
    ("alt", nodes)           one of them
    ("rep", node, low, high) repeated; high None has no bound

Anchors are empty sequences. What isn't understood, back references and look-arounds for instance, is an error; Python's own compiler runs the expression in any case.
"""

from __future__ import annotations

MANY = 64  # characters of a set that is listed


class Parser:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, expected: str = "") -> str:
        c = self.peek()
        if not c or (expected and c != expected):
            raise ValueError(f"at {self.at} of {self.text!r}: {expected or 'more'} expected")
        self.at += 1
        return c

    def branches(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        nodes = []
        while self.peek() not in ("", "|", ")"):
            nodes.append(self.repeated(self.atom()))
        return ("seq", nodes)

    def atom(self):
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                self.take()
                self.take(":")
            inner = self.branches()
            self.take(")")
            return inner
        if c == "[":
            return self.set()
        if c == "\\":
            return self.escape(inside=False)
        if c == ".":
            return ("chars", None)
        if c in "^$":
            return ("seq", [])
        if c in "*+?{":
            raise ValueError(f"nothing to repeat at {self.at} of {self.text!r}")
        return ("chars", {c} if c.isascii() else None)

    def escape(self, inside: bool):
        c = self.take()
        if c == "x":
            c = chr(int(self.take() + self.take(), 16))
        elif c in "nrtfv":
            c = {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v"}[c]
        elif c in "bBAZ" and not inside:
            return ("seq", [])
        elif c in "dDsSwW":
            return ("chars", None)
        elif c.isalnum():
            raise ValueError(f"\\{c} isn't understood")
        return ("chars", {c} if c.isascii() else None)

    def set(self):
        listed, known = set(), self.peek() != "^"
        if not known:
            self.take()
        first = True
        while first or self.peek() != "]":
            first = False
            low = self.member()
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                high = self.member()
                if low is None or high is None:
                    raise ValueError(f"a range of classes in {self.text!r}")
                if ord(high) - ord(low) >= MANY:
                    known = False
                else:
                    listed |= {chr(i) for i in range(ord(low), ord(high) + 1)}
            elif low is None:
                known = False
            else:
                listed.add(low)
        self.take("]")
        return ("chars", listed if known and all(c.isascii() for c in listed) else None)

    def member(self) -> str | None:
        c = self.take()
        if c != "\\":
            return c
        chars = self.escape(inside=True)[1]
        return next(iter(chars)) if chars else None

    def repeated(self, node):
        while self.peek() and self.peek() in "*+?{":
            c = self.take()
            if c == "{":
                body = ""
                while self.peek() != "}":
                    body += self.take()
                self.take()
                low, comma, high = body.partition(",")
                bounds = (int(low or 0), int(high) if high else (None if comma else int(low)))
            else:
                bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            if self.peek() and self.peek() in "?+":  # lazy or possessive: the same matches as far as a query goes
                self.take()
            node = ("rep", node, *bounds)
        return node


def parse(pattern: str):
    parser = Parser(pattern)
    node = parser.branches()
    if parser.at < len(pattern):
        raise ValueError(f"unbalanced ) in {pattern!r}")
    return node
