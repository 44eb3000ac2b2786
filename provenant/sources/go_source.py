"""What a Go file tells. Test files (_test.go) are left out by the caller."""

from __future__ import annotations

import re
from typing import Any

from provenant.functions import constants as C
from provenant.sources.clike import Construct, Source
from provenant.sources.python_source import Extract

LEVELS = {m: level for level, methods in C.GO_LEVELS.items() for m in methods}
_VERB = re.compile(C.GO_FORMAT_VERB)
_FIELD_METHODS = {"Error"}
_KEYWORDS = {"if", "for", "switch", "select", "func", "return", "go", "defer", "range", "case", "else", "var", "const", "type"}
#: Tokens after which a line end closes a statement.
_ENDS = {")", "]", "}", "return", "break", "continue", "fallthrough", "++", "--"}


class _Go(Source):
    def __init__(self, source: str) -> None:
        super().__init__(source, script=False)
        self.find_constructs()

    def body_of(self, k: int) -> int | None:
        """The { that opens a body after token k, past brackets, function literals, and types in braces."""
        while k < len(self.t):
            text = self.at(k)
            if text == "{":
                if self.at(k - 1) in ("interface", "struct"):
                    k = self.match.get(k, k) + 1
                    continue
                return k
            if text in ("(", "["):
                k = self.match.get(k, k) + 1
                continue
            if text == "func":
                inner = self.body_of(k + 1)
                if inner is None:
                    return None
                k = self.match.get(inner, inner) + 1
                continue
            k += 1
        return None

    def statement_end(self, k: int) -> int:
        while k < len(self.t):
            if self.t[k].kind == "mark" and self.at(k) in "([{":
                k = self.match.get(k, k)
            nxt = self.t[k + 1] if k + 1 < len(self.t) else None
            ends = self.t[k].kind != "mark" or self.at(k) in _ENDS
            if nxt is None or nxt.text in (";", "}") or ends and nxt.line > self.t[k].line:
                return k
            k += 1
        return len(self.t) - 1

    def find_constructs(self) -> None:
        add = self.constructs.append
        for k, tok in enumerate(self.t):
            if tok.kind != "word" or self.at(k - 1) == ".":
                continue
            if tok.text == "func":
                self.function(k)
            elif tok.text in ("if", "for", "switch", "select"):
                body = self.body_of(k + 1)
                if body is None:
                    continue
                last = self.match.get(body, body)
                while tok.text == "if" and self.at(last + 1) == "else":
                    nxt = self.body_of(last + 2)
                    if nxt is None:
                        break
                    last = self.match.get(nxt, nxt)
                add(Construct(tok.text, k, last))
            elif tok.text in ("defer", "go"):
                add(Construct(tok.text, k, self.statement_end(k)))

    def function(self, k: int) -> None:
        """A declaration, a method (with its receiver) or a literal, whose name is that of the variable it begins."""
        body = self.body_of(k + 1)
        named = self.is_word(k + 1) and self.at(k + 2) in ("(", "[")
        method = self.at(k + 1) == "(" and k + 1 in self.match and self.is_word(self.match[k + 1] + 1) and self.at(self.match[k + 1] + 2) == "("
        top = k == 0 or self.t[k].line > self.t[k - 1].line and self.at(k - 1) not in ("=", ":=", ",", "(", "{")
        if named or method and top:
            last = self.match.get(body, body) if body is not None else k
            name_at = k + 1 if named else self.match[k + 1] + 1
            receiver = None
            if not named:
                words = [j for j in range(k + 2, self.match[k + 1]) if self.is_word(j)]
                receiver = self.text(words[1] if len(words) > 1 else words[0], self.match[k + 1] - 1) if words else None
            args = name_at + 1 if self.at(name_at + 1) == "(" else self.match.get(name_at + 1, name_at) + 1
            self.constructs.append(Construct("func", k, last, self.at(name_at), {"receiver": receiver, "args": args, "body": body}))
        elif body is not None:
            name = self.at(k - 2) if self.at(k - 1) == ":=" and self.is_word(k - 2) else None
            if name and self.at(k - 3) == ",":
                j = k - 3
                while self.at(j) == "," and self.is_word(j - 1):
                    name, j = self.at(j - 1), j - 2
            self.constructs.append(Construct("literal", k, self.match.get(body, body), name, {"body": body}))

    def string(self, first: int, last: int) -> str:
        """Template of an expression."""
        parts = self.split(first, last, "+")
        if len(parts) > 1:
            return "".join(self.string(a, b) for a, b in parts)
        tok = self.t[first]
        if first == last:
            if tok.kind == "string":
                return _VERB.sub("{}", tok.text.strip('"'))
            if tok.kind == "raw":
                return _VERB.sub("{}", tok.text.strip("`"))
            if tok.kind == "word":
                return "{}"
        if tok.kind == "word" and self.at(last) == ")":
            call = self.match.get(last, first)
            if self.at(call - 1).endswith(("Sprintf", "Errorf")) and (args := self.split(call + 1, last - 1)):
                return self.string(*args[0])
        return "{}" if tok.kind in ("word", "mark") else _VERB.sub("{}", self.text(first, last).strip('"').strip("`"))

    def context(self, k: int) -> dict[str, Any]:
        name, receiver, closure, owner = None, None, False, None
        kinds = set()
        for c in self.around(k):
            if c.kind == "func":
                if not name:
                    name, owner = c.name, c
                    receiver = c.detail["receiver"] and c.detail["receiver"].lstrip("*")
            elif c.kind == "literal":
                closure = True
                name = name or c.name
            else:
                kinds.add(c.kind)
        whole = f"{receiver}.{name}" if receiver and name else name
        return {
            "function": whole or "<module>", "scope": whole, "receiver_type": receiver, "in_if_block": "if" in kinds, "in_loop": "for" in kinds,
            "in_switch": "switch" in kinds, "in_select": "select" in kinds, "in_defer": "defer" in kinds, "in_goroutine": "go" in kinds,
            "in_closure": closure, "signature": self.signature(owner) if owner else None,
        }

    def signature(self, fn: Construct) -> dict[str, Any]:
        a = fn.detail["args"]
        b = self.match.get(a, a)
        params, waiting = [], []
        groups = self.split(a + 1, b - 1)
        typed = any(g[1] > g[0] and self.is_word(g[0]) and self.at(g[0] + 1) not in (".", "[") for g in groups)
        for first, last in groups:
            if not typed:
                params.append({"name": "_", "type_hint": self.text(first, last), "default": None})
            elif first == last:
                waiting.append(self.at(first))
            else:
                kind = self.text(first + 1, last)
                params += [{"name": n, "type_hint": kind, "default": None} for n in (*waiting, self.at(first))]
                waiting = []
        body = fn.detail["body"]
        result = self.text(b + 1, body - 1) if body is not None and body > b + 1 else None
        return {"parameters": params, "return_type": result, "is_async": False, "decorators": []}

    def nested(self, start: int, end: int) -> bool:
        """Whether a call is one whole argument of another."""
        if self.at(start - 1) not in ("(", ",") or self.at(end + 1) not in (",", ")"):
            return False
        outer = next((o for o in range(start - 1, -1, -1) if self.at(o) == "(" and self.match.get(o, -1) > end), None)
        return outer is not None and (self.is_word(outer - 1) and self.at(outer - 1) not in _KEYWORDS or self.at(outer - 1) in (")", "]"))

    def calls(self) -> list[tuple[int, int, int]]:
        """(name, open, close) of all calls."""
        return [(k - 1, k, self.match[k]) for k in range(1, len(self.t)) if self.at(k) == "(" and k in self.match and self.is_word(k - 1) and self.at(k - 1) not in _KEYWORDS and self.at(k - 2) != "func"]


def _sites(go: _Go) -> list[dict[str, Any]]:
    chosen: dict[int, tuple[bool, int, int, int]] = {}
    for name, open_, close in go.calls():
        method = go.at(name)
        if go.at(name - 1) != "." or method not in LEVELS and method not in C.GO_CHAIN_ENDS:
            continue
        start = go.operand_start(name - 1)
        package = go.at(start) if start == name - 2 else ""
        if package == C.GO_FIELD_PACKAGE and method in _FIELD_METHODS:
            continue
        if package in C.GO_NON_LOG_PACKAGES and not (package == "fmt" and method in ("Print", "Printf", "Println")):
            continue
        if go.nested(start, close):
            continue
        end, line = method in C.GO_CHAIN_ENDS, go.t[name].line
        if line in chosen and chosen[line][0]:
            continue
        chosen[line] = (end, name, open_, close)
    out = []
    for line, (end, name, open_, close) in sorted(chosen.items()):
        method = go.at(name)
        args = go.split(open_ + 1, close - 1)
        message = go.string(*args[0]) if args else "(zerolog.Send)" if method == "Send" else "(no message)"
        out.append({"class_name": None, "level": _chain_level(go, name) if end else LEVELS[method], "message_template": message, "line": line, "column": go.t[name].column, "source_rank": 0, **go.context(name)})
    return out


def _chain_level(go: _Go, name: int) -> str:
    """Level of a chain that ends here: of the nearest level method before, info if there is none within 20 steps."""
    k = name - 1
    for _ in range(10):
        if go.at(k) != "." or go.at(k - 1) != ")":
            break
        k = go.match.get(k - 1, 0) - 1
        if go.at(k) in C.GO_CHAIN_LEVELS:
            return C.GO_CHAIN_LEVELS[go.at(k)]
        k -= 1
    return "info"


def _models(go: _Go) -> list[dict[str, Any]]:
    out = []
    for k in range(1, len(go.t) - 1):
        if go.at(k) == "struct" and go.at(k + 1) == "{" and go.is_word(k - 1) and go.at(k - 1) not in _KEYWORDS and (go.at(k - 2) in ("type", "(") or go.t[k - 2].line < go.t[k - 1].line):
            fields, j, last = [], k + 2, go.match.get(k + 1, k + 1)
            while j < last:
                e = go.statement_end(j)
                tag = go.at(e).strip("`") if go.t[e].kind == "raw" else None
                stop = e - 1 if tag is not None else e
                names = [go.at(j)]
                while go.at(j + 1) == "," and go.is_word(j + 2):
                    j += 2
                    names.append(go.at(j))
                if j < stop and go.is_word(j) and go.at(j + 1) != ".":
                    kind = go.text(j + 1, stop)
                else:
                    kind = go.text(j, stop)
                    names = [kind.lstrip("*")]
                fields += [{"name": n, "type_hint": kind, "default": tag} for n in names]
                j = e + 1 + (go.at(e + 1) == ";")
            out.append({"name": go.at(k - 1), "line": go.t[k - 1].line, "base_classes": [], "fields": fields})
    return out


def _imports(go: _Go) -> list[str]:
    found = set()
    for k in range(len(go.t)):
        if go.at(k) == "import" and (k == 0 or go.t[k - 1].line < go.t[k].line):
            last = go.match.get(k + 1, k + 2) if go.at(k + 1) == "(" else k + 2
            found |= {t.text.strip('"`') for t in go.t[k + 1 : last + 1] if t.kind in ("string", "raw")}
    return sorted(found)


def _function_name(c: Construct) -> str:
    receiver = c.detail.get("receiver")
    return f"{receiver.lstrip('*')}.{c.name}" if receiver else c.name


def _calls(go: _Go) -> list[tuple[str, str]]:
    """Calls by the declaration that holds them; those of variables at the top of the file belong to <module>."""
    out = set()
    for name, open_, close in go.calls():
        callee = go.at(name)
        owner = [c for c in go.around(name) if c.kind == "func"]
        if owner and name <= owner[-1].detail["args"] or callee in C.GO_CALL_SKIP or any(c.detail["args"] == open_ for c in go.constructs if c.kind == "func"):
            continue
        if not owner and not any(c.kind == "literal" for c in go.around(name)):
            continue
        if go.at(name - 1) == ".":
            start = go.operand_start(name - 1)
            if start == name - 2 and go.at(start) in C.GO_PACKAGE_SKIP:
                continue
        out.add((_function_name(owner[-1]) if owner else "<module>", callee))
    return sorted(out)


def extract(source: str) -> Extract:
    go = _Go(source)
    functions = [_function_name(c) for c in go.constructs if c.kind == "func"]
    return Extract(_sites(go), _models(go), _imports(go), functions, _calls(go))
