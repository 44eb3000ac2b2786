"""Column functions: identifiers, levels, tags, templates, names and paths. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenant.functions import constants as C


def node_base_id(module: Column, class_name: Column, function: Column, template: Column) -> Column:
    """ll: and the first 12 hex digits of SHA-256 over module:class.function:template; no class counts as empty."""
    whole = F.concat(module, F.lit(":"), F.coalesce(class_name, F.lit("")), F.lit("."), function, F.lit(":"), template)
    return F.concat(F.lit("ll:"), F.substring(F.sha2(whole, 256), 1, 12))


def scope_suffix(file: Column, scope: Column) -> Column:
    """Four hex digits that tell a second node of one base id; a missing scope counts as the word None."""
    return F.substring(F.sha2(F.concat(file, F.lit(":"), F.coalesce(scope, F.lit("None"))), 256), 1, 4)


def mapped_level(method: Column, levels: dict[str, Sequence[str]]) -> Column:
    """Level of a method name; null if it has none."""
    pairs = [x for level, methods in levels.items() for m in methods for x in (F.lit(m), F.lit(level))]
    return F.element_at(F.create_map(*pairs), method)


def redacted(message: Column, patterns: Sequence[str]) -> Column:
    """[REDACTED] for a message that contains any of the patterns, whatever the case."""
    if not patterns:
        return message
    hit = F.exists(F.array(*[F.lit(p.lower()) for p in patterns]), lambda p: F.contains(F.lower(message), p))
    return F.when(hit, F.lit("[REDACTED]")).otherwise(message)


def _any_of(text: Column, words: Sequence[str]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def _tags(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(hit, F.lit(tag)) for tag, hit in rules.items()]), lambda x: x.isNotNull())


def function_tags(function: Column) -> Column:
    return _tags({tag: _any_of(F.lower(function), words) for tag, words in C.FUNCTION_TAGS.items()})


def module_tags(module: Column) -> Column:
    return _tags({tag: _any_of(F.lower(module), words) for tag, words in C.MODULE_TAGS.items()})


def lexical_tags(parents: Column) -> Column:
    hit = lambda words: F.exists(parents, lambda p: _any_of(F.lower(p), words))
    return _tags({tag: hit(words) for tag, words in C.LEXICAL_TAGS.items()})


def message_tags(message: Column) -> Column:
    return _tags({tag: message.rlike(f"(?i)({pattern})") for tag, pattern in C.MESSAGE_TAGS.items()})


def level_tags(level: Column) -> Column:
    low = F.lower(level)
    return _tags({"error": low.isin(*C.ERROR_LEVELS), "debug": low == "debug", "warning": low == "warning"})


def all_tags(existing: Column, function: Column, module: Column, parents: Column, message: Column, level: Column) -> Column:
    """Sorted union of what is there and what the node's parts tell."""
    empty = F.expr("cast(array() as array<string>)")
    found = [F.coalesce(x, empty) for x in (existing, function_tags(function), module_tags(module), lexical_tags(parents), message_tags(message), level_tags(level))]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def template_pattern(template: Column) -> Column:
    """Java regex that matches what a template may have become; null if it has no placeholder.

    Placeholders (and a literal .*?) match anything, line feeds included;
    the rest is quoted.
    """
    wild = F.regexp_replace(F.regexp_replace(template, C.BRACE_FIELD, ".*?"), C.PRINTF_VERB, ".*?")
    quote = lambda p: F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    body = F.array_join(F.transform(F.split(wild, r"\.\*\?", -1), quote), ".*?")
    found = template.rlike(C.BRACE_FIELD) | template.rlike(C.PRINTF_VERB)
    return F.when(found, F.concat(F.lit("(?sd)^"), body, F.lit("$")))


def literal_prefix(template: Column) -> Column:
    """What every text made from a template begins with."""
    return F.regexp_extract(template, r"(?s)^(.*?)(?:\.\*\?|" + C.BRACE_FIELD + "|" + C.PRINTF_VERB + r"|\z)", 1)


def go_function_name(full: Column) -> Column:
    """Receiver.Method or function of a qualified Go name: after the last slash, without package and pointer marks."""
    name = F.substring_index(full, "/", -1)
    name = F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"^[^.]*\.", "")).otherwise(name)
    name = F.replace(name, F.lit("(*"), F.lit(""))
    return F.regexp_replace(name, r"^(.*?)\)\.", "$1.")


def plain_name(name: Column) -> Column:
    """Name without _ and -, lower case, after its last dot: equal for get_user, getUser and api.get-user."""
    return F.substring_index(F.lower(F.regexp_replace(name, "[_-]", "")), ".", -1)


def bare_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def resolved_import(module: Column, imported: Column) -> Column:
    """Absolute name of a relative import; with more dots than the module has parts, just without its dots."""
    rest = F.regexp_replace(imported, r"^\.+", "")
    dots = F.length(imported) - F.length(rest)
    parts = F.split(module, r"\.")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0))), ".")
    near = F.when(rest == "", base).otherwise(F.concat(base, F.lit("."), rest))
    return F.when(~F.startswith(imported, F.lit(".")), imported).when(F.size(parts) >= dots, near).otherwise(rest)


def suffix_of(path: Column) -> Column:
    """Extension with its dot; empty if the last part of the path has none."""
    return F.regexp_extract(path, r"[^/.](\.[^/.]*)$", 1)


def module_path(path: Column, language: Column) -> Column:
    """Python: parts after src, else the last three, dotted. Go: the path without suffix. TS: from the first marker, else the last three."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    parts = F.split(stem, "/")
    last = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3))
    src = F.array_position(parts, "src")
    python = F.array_join(F.when(src > 0, F.slice(parts, src + 1, F.size(parts))).otherwise(last), ".")
    first = F.coalesce(*[F.when(F.array_position(parts, m) > 0, F.array_position(parts, m)) for m in C.TS_MARKERS])
    script = F.array_join(F.when(first.isNotNull(), F.slice(parts, first, F.size(parts))).otherwise(last), "/")
    return F.when(language == "python", python).when(language == "go", stem).otherwise(script)


def found_in(query: str, *columns: Column) -> Column:
    """Whether any of the columns contains the query, whatever the case."""
    return _or([F.contains(F.lower(c), F.lit(query.lower())) for c in columns])


def _or(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
