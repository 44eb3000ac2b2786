"""What a Python file tells: log sites, models, imports, functions and calls, from its syntax tree."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from dataclasses import dataclass, field
from typing import Any

from provenant.functions.constants import PYTHON_CALL_SKIP, PYTHON_LOG_METHODS


@dataclass
class Extract:
    """Rows of one file. calls hold (caller within the module, callee)."""

    sites: list[dict[str, Any]] = field(default_factory=list)
    models: list[dict[str, Any]] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)
    calls: list[tuple[str, str]] = field(default_factory=list)
    error: str | None = None


#: Log calls found in the text alone, whatever the syntax.
_TEXT_CALL = re.compile(r"""(?:logger|log|logging|self\.log(?:ger)?)\s*\.\s*(debug|info|warning|error|critical|exception|fatal|log)\s*\(\s*f?["'](.+?)["']""", re.I)


def text_sites(source: str) -> list[dict[str, Any]]:
    """Sites by pattern: any quote closes, comments and longer names match as well; the line is the receiver's."""
    return [
        {"function": "unknown", "level": m[1].lower(), "message_template": m[2], "line": source.count("\n", 0, m.start()) + 1, "column": 0, "source_rank": 1}
        for m in _TEXT_CALL.finditer(source)
    ]


def _single_string(segment: str) -> bool:
    """Whether a source segment is one string literal, not several next to each other."""
    strings, depth = 0, 0
    try:
        for t in tokenize.generate_tokens(io.StringIO(segment).readline):
            name = tokenize.tok_name[t.type]
            strings += depth == 0 and name in ("STRING", "FSTRING_START")
            depth += (name == "FSTRING_START") - (name == "FSTRING_END")
    except tokenize.TokenError:
        return False
    return strings == 1


def _raw(segment: str) -> str:
    """The inside of one literal as written; interpolations of an f-string become {}."""
    prefix, quote, body = re.match(r"(?s)([A-Za-z]*)('''|\"\"\"|'|\")(.*)\2\Z", segment).groups()
    if "f" not in prefix.lower():
        return body
    out, depth, k = [], 0, 0
    while k < len(body):
        two = body[k : k + 2]
        if not depth and two in ("{{", "}}"):
            out.append(two)
            k += 2
            continue
        if body[k] == "{":
            if not depth:
                out.append("{}")
            depth += 1
        elif body[k] == "}":
            depth -= 1
        elif not depth:
            out.append(body[k])
        k += 1
    return "".join(out)


class _Walker:
    def __init__(self, source: str) -> None:
        self.source, self.out = source, Extract()

    def text(self, node: ast.AST | None) -> str | None:
        return None if node is None else ast.get_source_segment(self.source, node)

    def message(self, node: ast.AST) -> str:
        """Template of a message: both sides of an operator joined, strings as written, all else {}."""
        if isinstance(node, ast.BinOp):
            return self.message(node.left) + self.message(node.right)
        if isinstance(node, ast.JoinedStr) or isinstance(node, ast.Constant) and isinstance(node.value, (str, bytes)):
            segment = self.text(node)
            if segment and _single_string(segment):
                return _raw(segment)
        return "{}"

    def signature(self, fn: ast.FunctionDef | ast.AsyncFunctionDef) -> dict[str, Any]:
        a = fn.args
        positional = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(positional) - len(a.defaults)) + a.defaults
        named = list(zip(positional, defaults))
        if a.vararg:
            named.append((a.vararg, None))
        named += list(zip(a.kwonlyargs, a.kw_defaults))
        if a.kwarg:
            named.append((a.kwarg, None))
        stars = {a.vararg: "*", a.kwarg: "**"}
        params = [{"name": stars.get(p, "") + p.arg, "type_hint": self.text(p.annotation), "default": self.text(d)} for p, d in named if p.arg not in ("self", "cls")]
        return {"parameters": params, "return_type": self.text(fn.returns), "is_async": isinstance(fn, ast.AsyncFunctionDef), "decorators": []}

    def site(self, call: ast.Call, above: list[ast.AST]) -> None:
        name = call.func.attr if isinstance(call.func, ast.Attribute) else call.func.id if isinstance(call.func, ast.Name) else ""
        args = sorted([*call.args, *call.keywords], key=lambda x: (x.lineno, x.col_offset))
        if name not in PYTHON_LOG_METHODS or not args:
            return
        fn = next((x for x in reversed(above) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))), None)
        cls = next((x for x in reversed(above) if isinstance(x, ast.ClassDef)), None)
        has = lambda *kinds: any(isinstance(x, kinds) for x in above)
        end = call.func
        self.out.sites.append({
            "class_name": cls.name if cls else None, "function": fn.name if fn else "<module>", "level": name, "message_template": self.message(args[0]),
            "line": end.end_lineno, "column": end.end_col_offset - len(name.encode()), "source_rank": 0, "scope": fn.name if fn else None,
            "in_try_except": has(ast.Try, ast.TryStar), "in_if_block": has(ast.If), "in_loop": has(ast.For, ast.AsyncFor, ast.While),
            "signature": self.signature(fn) if fn else None,
        })

    def model(self, cls: ast.ClassDef) -> None:
        bases = [self.text(b) for b in cls.bases if isinstance(b, (ast.Name, ast.Attribute))]
        fields = [{"name": self.text(s.target), "type_hint": self.text(s.annotation), "default": self.text(s.value)} for s in cls.body if isinstance(s, ast.AnnAssign)]
        marked = any("dataclass" in (self.text(d) or "") for d in cls.decorator_list)
        if marked or {"BaseModel", "TypedDict"} & set(bases) or fields and cls.name[0].isupper():
            self.out.models.append({"name": cls.name, "line": cls.lineno, "base_classes": bases, "fields": fields})

    def callees(self, fn: ast.FunctionDef | ast.AsyncFunctionDef, caller: str) -> None:
        found = set()
        for stmt in fn.body:
            for x in ast.walk(stmt):
                if isinstance(x, ast.Call):
                    found.add(x.func.attr if isinstance(x.func, ast.Attribute) else x.func.id if isinstance(x.func, ast.Name) else None)
        self.out.calls += [(caller, c) for c in sorted(found - {None} - PYTHON_CALL_SKIP)]

    def walk(self, node: ast.AST, above: list[ast.AST], classes: list[str]) -> None:
        if isinstance(node, ast.Call):
            self.site(node, above)
        elif isinstance(node, ast.Import):
            self.out.imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            self.out.imports.append("." * node.level + (node.module or ""))
        elif isinstance(node, ast.ClassDef):
            self.model(node)
            classes = [*classes, node.name]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.out.functions.append(node.name)
            self.callees(node, ".".join([*classes, node.name]))
        for child in ast.iter_child_nodes(node):
            self.walk(child, [*above, node], classes)


def extract(source: str) -> Extract:
    """Rows of a file. A file that does not parse has an error and the sites that its text shows."""
    walker = _Walker(source)
    try:
        walker.walk(ast.parse(source), [], [])
    except (SyntaxError, ValueError, RecursionError) as problem:
        walker.out = Extract(error=f"{type(problem).__name__}: {problem}")
    out = walker.out
    out.sites.sort(key=lambda s: (s["line"], s["column"]))
    out.sites += text_sites(source)
    out.imports = sorted(set(out.imports))
    return out
