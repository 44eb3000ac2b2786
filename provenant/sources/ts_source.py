"""What a TypeScript or JavaScript file tells."""

from __future__ import annotations

import re
from typing import Any

from provenant.functions import constants as C
from provenant.sources.clike import Construct, Source
from provenant.sources.python_source import Extract

LEVELS = {m: level for level, methods in C.TS_LEVELS.items() for m in methods}
_FIELD = re.compile(r"\$\{[^}]*\}")
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "function", "with", "await", "typeof", "new", "super", "import", "case", "of", "in", "do", "else", "delete", "void", "throw", "yield", "async"}
_MODIFIERS = {"async", "static", "public", "private", "protected", "readonly", "get", "set", "override", "abstract", "declare", "export", "default", "*"}


class _Ts(Source):
    def __init__(self, source: str) -> None:
        super().__init__(source, script=True)
        self.classes: list[Construct] = []
        for k, tok in enumerate(self.t):
            if tok.text == "class" and tok.kind == "word" and self.at(k - 1) != ".":
                body = next((j for j in range(k + 1, len(self.t)) if self.at(j) == "{"), None)
                if body is not None:
                    name = self.at(k + 1) if self.is_word(k + 1) and self.at(k + 1) != "extends" else None
                    self.classes.append(Construct("class", k, self.match.get(body, body), name, {"body": body}))
        self.constructs += self.classes
        for k in range(len(self.t)):
            self.construct(k)

    def after(self, k: int) -> int:
        """Last token of the statement or block that begins at token k."""
        if self.at(k) == "{":
            return self.match.get(k, k)
        while k + 1 < len(self.t) and self.at(k) != ";" and self.at(k + 1) not in ("}", ")"):
            if self.t[k].kind == "mark" and self.at(k) in "([{":
                k = self.match.get(k, k)
                if k + 1 < len(self.t) and self.t[k + 1].line > self.t[k].line and self.at(k + 1) not in (".", "?.", "else"):
                    return k
                continue
            k += 1
            if self.t[k].line > self.t[k - 1].line and self.t[k - 1].kind != "mark" and self.at(k) not in (".", "?.", "+"):
                return k - 1
        return k

    def construct(self, k: int) -> None:
        tok = self.t[k]
        add = self.constructs.append
        if tok.kind == "mark":
            if tok.text == "=>":
                self.arrow(k)
            return
        if tok.kind != "word" or self.at(k - 1) in (".", "?."):
            return
        if tok.text in ("if", "for", "while", "switch", "catch") and (self.at(k + 1) in ("(", "{") or self.at(k + 1) == "await"):
            open_ = k + 1 if self.at(k + 1) != "await" else k + 2
            last = self.after((self.match.get(open_, open_) + 1) if self.at(open_) == "(" else open_)
            while tok.text == "if" and self.at(last + 1) == "else":
                last = self.after(last + 2) if self.at(last + 2) != "if" else self.after(self.match.get(last + 3, last + 3) + 1)
            add(Construct(tok.text, k, last))
        elif tok.text == "do" and self.at(k + 1) == "{":
            add(Construct("while", k, self.match.get(k + 1, k + 1)))
        elif tok.text == "try" and self.at(k + 1) == "{":
            last = self.match.get(k + 1, k + 1)
            while self.at(last + 1) in ("catch", "finally"):
                body = next((j for j in range(last + 2, len(self.t)) if self.at(j) == "{"), last + 2)
                last = self.match.get(body, body)
            add(Construct("try", k, last))
        elif tok.text == "function":
            name_at = k + 1 + (self.at(k + 1) == "*")
            name = self.at(name_at) if self.is_word(name_at) else None
            args = next((j for j in range(name_at, min(name_at + 40, len(self.t))) if self.at(j) == "("), None)
            body = self.body_after(args)
            if body is not None:
                kind = "function" if name and not self.in_expression(k) else "expression"
                if not name and self.at(k - 1 - (self.at(k - 1) == "async")) == "=":
                    name = self.declared(k - 1 - (self.at(k - 1) == "async"))
                add(Construct(kind, k, self.match.get(body, body), name, {"args": args, "body": body, "async": self.at(k - 1) == "async"}))
        elif self.at(k + 1) in ("(", "<") and tok.text not in _CONTROL:
            self.method(k)

    def in_expression(self, k: int) -> bool:
        before = self.at(k - 1) if self.at(k - 1) != "async" else self.at(k - 2)
        return before in ("=", "(", ",", ":", "return", "=>", "[", "&&", "||", "?", "!", "new")

    def body_after(self, args: int | None) -> int | None:
        """The { of a body after its parameters, past a return type."""
        if args is None or args not in self.match:
            return None
        k = self.match[args] + 1
        if self.at(k) == "{":
            return k
        if self.at(k) != ":":
            return None
        k += 1
        while k < len(self.t) and self.at(k) not in (";", "=>", "="):
            if self.at(k) == "{":
                if self.at(k - 1) in (":", "|", "&", "<", ","):
                    k = self.match.get(k, k) + 1
                    continue
                return k
            k = self.match.get(k, k) + 1 if self.at(k) in ("(", "[") else k + 1
        return None

    def method(self, k: int) -> None:
        holder = next((c for c in self.classes if c.detail["body"] < k < c.last and not any(o.detail["body"] < k < o.last and o.first > c.first for o in self.classes)), None)
        if holder is None:
            return
        depth = [j for j in range(holder.detail["body"], k) if self.at(j) in ("{", "(", "[") and self.t[j].kind == "mark" and self.match.get(j, -1) > k]
        if len(depth) != 1:
            return
        args = k + 1
        if self.at(args) == "<":  # type parameters
            args = next((j + 1 for j in range(k + 2, min(k + 40, len(self.t))) if self.at(j) == ">" and self.at(j + 1) == "("), None)
        body = self.body_after(args) if self.at(k - 1) != ":" else None
        if body is None:
            return
        j, is_async = k - 1, False
        while self.at(j) in _MODIFIERS:
            is_async |= self.at(j) == "async"
            j -= 1
        self.constructs.append(Construct("method", k, self.match.get(body, body), self.at(k), {"args": args, "body": body, "async": is_async, "decorators": self.decorators(j)}))

    def decorators(self, k: int) -> list[str]:
        """Decorators that end at token k, in order."""
        out = []
        while k > 0:
            last = k
            k = self.match[k] - 1 if self.at(k) == ")" and k in self.match else k
            while self.at(k - 1) == "." and self.is_word(k - 2):
                k -= 2
            if self.at(k).startswith("@") and len(self.at(k)) > 1:
                out.append(self.text(k, last)[1:])
                k -= 1
            elif self.at(k - 1) == "@":
                out.append(self.text(k, last))
                k -= 2
            else:
                break
        return out[::-1]

    def declared(self, equals: int) -> str | None:
        """Name of the variable or property before an equals sign, past its type."""
        k = equals - 1
        while k > 0 and self.at(k) not in ("const", "let", "var", ";", "{", "}", ","):
            if self.at(k) in (")", "]", "}", ">") and k in self.match:
                k = self.match[k]
            k -= 1
        if self.at(k) in ("const", "let", "var", ",") and self.is_word(k + 1):
            return self.at(k + 1)
        return None

    def arrow(self, k: int) -> None:
        before = k - 1
        if self.at(before) == ")" and before in self.match:
            args = self.match[before]
        elif self.is_word(before) and self.at(before - 1) not in (":", "|", "&", ">", "."):
            args = before
        else:  # a return type stands between
            close = next((j for j in range(before, max(before - 40, -1), -1) if self.at(j) == ":" and self.at(j - 1) == ")"), None)
            if close is None or close - 1 not in self.match:
                return
            args = self.match[close - 1]
        is_async = self.at(args - 1) == "async"
        lead = args - 1 - is_async
        name = self.declared(lead) if self.at(lead) == "=" else self.at(lead - 1).strip("\"'") if self.at(lead) == ":" and (self.is_word(lead - 1) or self.t[lead - 1].kind == "string") else None
        bound = "variable" if self.at(lead) == "=" and name else "pair" if name else None
        body = k + 1
        if self.at(body) == "{":
            last = self.match.get(body, body)
        else:
            last = body
            while last + 1 < len(self.t) and self.at(last + 1) not in (",", ")", "]", "}", ";"):
                last += 1
                if self.at(last) in ("(", "[", "{"):
                    last = self.match.get(last, last)
            if self.at(body) in ("(", "["):
                last = max(last, self.match.get(body, body))
        self.constructs.append(Construct("arrow", args - is_async, last, name, {"args": args, "body": body, "async": is_async, "bound": bound}))

    def string(self, first: int, last: int) -> str:
        parts = self.split(first, last, "+")
        if len(parts) > 1:
            return "".join(self.string(a, b) for a, b in parts)
        tok = self.t[first]
        if first == last and tok.kind == "string":
            return tok.text[1:-1]
        if first == last and tok.kind == "raw":
            return _FIELD.sub("{}", tok.text.strip("`"))
        if tok.kind == "number" and first == last or tok.kind == "word":
            return "{}"
        return self.text(first, last)

    def context(self, k: int) -> dict[str, Any]:
        name, cls, closure, owner, is_async, kinds = None, None, False, None, False, set()
        for c in self.around(k):
            if c.kind in ("function", "method", "arrow", "expression"):
                if name:
                    closure = True
                else:
                    name, owner, is_async = c.name, c, is_async or c.detail["async"]
            elif c.kind == "class":
                cls = cls or c.name
            else:
                kinds.add(c.kind)
        whole = f"{cls}.{name}" if cls and name else name
        return {
            "class_name": cls, "function": whole or "<module>", "scope": name, "in_try_except": bool(kinds & {"try", "catch"}), "in_catch": "catch" in kinds,
            "in_if_block": "if" in kinds, "in_loop": bool(kinds & {"for", "while"}), "in_switch": "switch" in kinds,
            "is_async": is_async, "in_closure": closure, "signature": self.signature(owner, is_async) if owner else None,
        }

    def signature(self, fn: Construct, is_async: bool) -> dict[str, Any]:
        a = fn.detail["args"]
        params = []
        if self.at(a) != "(":
            groups = [(a, a)]
        else:
            groups = self.split(a + 1, self.match.get(a, a) - 1)
        for first, last in groups:
            while self.at(first) in _MODIFIERS and first < last:
                first += 1
            colon = self.split(first, last, ":")
            equals = self.split(first, last, "=")
            left = self.text(first, (colon[0][1] if len(colon) > 1 else equals[0][1]))
            hint = self.text(colon[1][0], self.split(colon[1][0], last, "=")[0][1]) if len(colon) > 1 else None
            params.append({"name": left, "type_hint": hint, "default": None})
        close = self.match.get(a, a)
        body, result = fn.detail["body"], None
        end = body - 1 if fn.kind != "arrow" else body - 2
        if self.at(close + 1) == ":" and self.at(a) == "(":
            result = self.text(close + 2, end)
        return {"parameters": params, "return_type": result, "is_async": is_async, "decorators": fn.detail.get("decorators", [])}

    def calls(self) -> list[tuple[int, int, int]]:
        heads = {c.detail["args"] for c in self.constructs if c.kind in ("function", "method", "expression")}
        return [(k - 1, k, self.match[k]) for k in range(1, len(self.t)) if self.at(k) == "(" and k in self.match and k not in heads and self.is_word(k - 1) and self.at(k - 1) not in _CONTROL]


def _sites(ts: _Ts) -> list[dict[str, Any]]:
    out, seen = [], set()
    for name, open_, close in ts.calls():
        line = ts.t[name].line
        args = ts.split(open_ + 1, close - 1)
        if ts.at(name - 1) not in (".", "?.") or ts.at(name) not in LEVELS or not args or line in seen:
            continue
        seen.add(line)
        out.append({"level": LEVELS[ts.at(name)], "message_template": ts.string(*args[0]), "line": line, "column": ts.t[name].column, "source_rank": 0, **ts.context(name)})
    return out


def _models(ts: _Ts) -> list[dict[str, Any]]:
    out = []
    for k in range(len(ts.t) - 1):
        if ts.at(k) not in ("interface", "type") or not ts.is_word(k) or not ts.is_word(k + 1):
            continue
        body = next((j for j in range(k + 2, len(ts.t)) if ts.at(j) in ("{", ";", "(")), None)
        if body is None or ts.at(body) != "{" or ts.at(k) == "type" and ts.at(body - 1) != "=":
            continue
        bases = []
        if ts.at(k) == "interface" and "extends" in (heads := [ts.at(j) for j in range(k + 2, body)]):
            start = k + 3 + heads.index("extends")
            bases = [ts.at(a) for a, b in ts.split(start, body - 1) if a == b]
        fields, j, last = [], body + 1, ts.match.get(body, body)
        while j < last:
            stop = j
            while stop + 1 < last and ts.at(stop + 1) not in (";", ","):
                stop = ts.match.get(stop, stop) if ts.at(stop) in ("(", "[", "{") else stop
                if ts.t[stop + 1].line > ts.t[stop].line and ts.at(stop) not in (":", "|", "&", "=>"):
                    break
                if stop + 1 < last and ts.at(stop + 1) not in (";", ","):
                    stop += 1
            start = j + (ts.at(j) == "readonly")
            optional = ts.at(start + 1) == "?"
            colon = start + 1 + optional
            if (ts.is_word(start) or ts.t[start].kind == "string") and ts.at(start + 1) != "(":
                kind = ts.text(colon + 1, stop) if ts.at(colon) == ":" else "any"
                fields.append({"name": ts.at(start), "type_hint": kind + " (optional)" * optional, "default": None})
            j = stop + 1
            while ts.at(j) in (";", ","):
                j += 1
        out.append({"name": ts.at(k + 1), "line": ts.t[k + 1].line, "base_classes": bases, "fields": fields})
    return out


def _imports(ts: _Ts) -> list[str]:
    """Module names as written; only double quotes are taken off."""
    found = set()
    for k in range(len(ts.t)):
        if ts.at(k) == "import" and ts.at(k - 1) != ".":
            if ts.at(k + 1) == "(" and ts.t[k + 2].kind == "string":
                found.add(ts.at(k + 2))
                continue
            j = k + 1
            while j < len(ts.t) and ts.t[j].kind != "string" and ts.at(j) != ";":
                j = ts.match.get(j, j) + 1 if ts.at(j) == "{" else j + 1
            if j < len(ts.t) and ts.t[j].kind == "string":
                found.add(ts.at(j))
        elif ts.at(k) == "require" and ts.at(k + 1) == "(" and k + 2 < len(ts.t) and ts.t[k + 2].kind == "string":
            found.add(ts.at(k + 2))
    return sorted(x.strip('"') for x in found)


def _owner_name(ts: _Ts, c: Construct) -> str:
    cls = next((x.name for x in ts.around(c.first) if x.kind == "class" and x.name), None)
    return f"{cls}.{c.name}" if cls else c.name


def _named(c: Construct) -> bool:
    return c.kind in ("function", "method") or c.kind in ("arrow", "expression") and bool(c.name) and c.detail.get("bound", "variable") == "variable"


def _calls(ts: _Ts) -> list[tuple[str, str]]:
    out = set()
    for name, _, _ in ts.calls():
        callee = ts.at(name)
        chain = [c for c in ts.around(name) if c.kind in ("function", "method", "arrow", "expression")]
        named = [c for c in chain if _named(c)]
        if not chain or callee in C.TS_CALL_SKIP:
            continue
        if ts.at(name - 1) in (".", "?."):
            start = ts.operand_start(name - 1)
            if start == name - 2 and ts.at(start) in C.TS_OBJECT_SKIP:
                continue
        if named:
            out.add((_owner_name(ts, named[0]), callee))
        elif ts.at(chain[-1].first - 1) == "default" or ts.at(chain[-1].first - 2) == "default":
            out.add(("<module>", callee))
    for k in range(len(ts.t) - 1):
        if ts.at(k) == "new" and ts.is_word(k + 1) and ts.at(k + 1) not in C.TS_OBJECT_SKIP:
            named = [c for c in ts.around(k) if _named(c)]
            if named:
                out.add((_owner_name(ts, named[0]), ts.at(k + 1)))
    return sorted(out)


def extract(source: str) -> Extract:
    ts = _Ts(source)
    functions = [_owner_name(ts, c) for c in ts.constructs if _named(c)]
    return Extract(_sites(ts), _models(ts), _imports(ts), functions, _calls(ts))
