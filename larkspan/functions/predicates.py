"""Filters as Column factories. Each follows one rule of letter case; none relies on a global setting."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.text import base_name

# The closed vocabularies.
SYMBOL_KINDS = ("Method", "Property", "Field", "Constructor", "Event", "Type")
EDGE_TYPES = ("Calls", "Reads", "Writes", "Implements", "Overrides", "Accesses", "References")
STATUSES = ("Pending", "Analyzed", "Dirty")
LINK_TYPES = ("about", "affects", "related")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def name_matches(column: Column | str, pattern: str, mode: str = "contains") -> Column:
    """exact follows letter case; exactIgnoreCase, contains, prefix and suffix do not. Any other mode is contains."""
    c, low = _c(column), F.lower(_c(column))
    p = pattern.lower()
    rules = {"exact": c == pattern, "exactignorecase": low == p, "prefix": low.startswith(p), "suffix": low.endswith(p)}
    return rules.get(mode.lower(), low.contains(p))


def kind_matches(column: Column | str, kind_filter: str = "all") -> Column:
    """all, type, member, namespace, typeAndMember."""
    kinds = {"type": ("Type",), "member": ("Method", "Property", "Field", "Constructor", "Event"), "namespace": ("Namespace",), "typeandmember": SYMBOL_KINDS}
    wanted = kinds.get(kind_filter.lower())
    return F.lit(True) if wanted is None else _c(column).isin(*wanted)


def partial_name(qualified: Column | str, name: Column | str, search: str) -> Column:
    """The search text as a whole name, before a parameter list or after a dot. As in LIKE, case is ignored and _ and % are wild cards; a plain name must be equal."""
    q = _c(qualified)
    return q.ilike(f"{search}(%") | q.ilike(f"%.{search}(%") | q.ilike(f"%.{search}") | (_c(name) == search)


def glob(value: Column | str, pattern: str | None) -> Column:
    """No pattern fits all, an empty value fits none; with * it is a wild card for the whole value, without it a part of it; letter case is ignored."""
    if not pattern:
        return F.lit(True)
    v = F.coalesce(_c(value), F.lit(""))
    if "*" in pattern:
        return (v != "") & v.rlike("(?is)^" + ".*".join(re.escape(x) for x in pattern.split("*")) + "$")
    return (v != "") & F.lower(v).contains(pattern.lower())


def graph_path(path: Column | str, pattern: str | None, file_only: bool = False) -> Column:
    """The * is dropped and the rest must be part of the path, or of the file's name alone."""
    if not pattern:
        return F.lit(True)
    at = base_name(path) if file_only else _c(path)
    return F.lower(at).contains(pattern.replace("*", "").lower())


def severity_matches(column: Column | str, wanted: str | None) -> Column:
    return F.lower(_c(column)) == wanted.lower() if wanted and wanted.lower() in ("error", "warning", "info") else F.lit(True)


def generated_file(path: Column | str) -> Column:
    return F.coalesce(_c(path).rlike(r"(?i)(\.g|\.g\.i|\.designer)\.cs$"), F.lit(False))


def source_file(path: Column | str, ignore_case: bool = True) -> Column:
    """A source file that is neither generated nor under obj; the scan of a build compares with letter case."""
    p = F.regexp_replace(F.lower(_c(path)) if ignore_case else _c(path), r"\\", "/")
    return ~(p.endswith(".g.cs") | p.endswith(".designer.cs") | (p.contains("/obj/") if ignore_case else F.lit(False)))


def suppression(ident: Column | str, in_source: Column, project_option: Column, enabled_by_default: Column, default_severity: Column) -> Column:
    """Why a diagnostic is suppressed, null if it is not: by a pragma or attribute; by the project, if it sets the id to Suppress or Hidden (letter case ignored); or, for ids that
    begin with CA and for which the project sets nothing (a null option), because the rule is off or hidden by default."""
    by_project = F.lower(project_option).isin("suppress", "hidden")
    by_default = _c(ident).startswith("CA") & project_option.isNull() & (~enabled_by_default | (F.lower(default_severity) == "hidden"))
    return F.when(in_source, "pragma/attribute").when(by_project, "project settings").when(by_default, "disabled by default")


def near_location(line: Column | str, column: Column | str, at_line: int, at_column: int, tolerance: int = 5) -> Column:
    return (_c(line) == at_line) & (F.abs(_c(column) - at_column) <= tolerance)


# Names, beginnings of names and parts of qualified names by which code is entered from outside; and the knowledge categories.
ENTRY_NAMES = ("Main", "RunAsync", "ConfigureServices", "Configure", "Dispose", "DisposeAsync")
ENTRY_PREFIXES = ("On", "get_", "set_")
ENTRY_TYPES = (".Program.", ".Startup.")
CATEGORIES = ("gotcha", "pattern", "architecture", "debugging", "performance", "security", "testing", "workaround", "lesson", "error-resolution", "convention", "instruction")


def entry_point(name: Column | str, qualified: Column | str) -> Column:
    """Symbols that are called from outside the graph, by name or by the type they stand in. The prefix On also takes names like Once."""
    tests = [_c(name).isin(*ENTRY_NAMES), *(_c(name).startswith(p) for p in ENTRY_PREFIXES), *(_c(qualified).contains(t) for t in ENTRY_TYPES)]
    return F.coalesce(reduce(or_, tests), F.lit(False))


def private_name(name: Column | str) -> Column:
    return _c(name).rlike(r"^(_|\p{Ll})")


def test_file(path: Column | str) -> Column:
    return F.lower(_c(path)).contains("test")


def excluded(path: Column | str, type_column: Column | str, files: list[str], types: list[str]) -> Column:
    """Path has one of the parts, or type one of the endings; letter case ignored."""
    out = F.lit(False)
    for f in files:
        out = out | F.lower(_c(path)).contains(f.lower())
    for t in types:
        out = out | F.coalesce(F.lower(_c(type_column)).endswith(t.lower()), F.lit(False))
    return out


def file_matches(path: Column | str, part: str | None) -> Column:
    """Part of the file's name or of its path, letter case ignored."""
    return F.lit(True) if not part else F.lower(base_name(path)).contains(part.lower()) | F.lower(_c(path)).contains(part.lower())


# The marks of a project with a window toolkit.
WPF_MARKS = r"<usewpf>true</usewpf>|presentationcore|presentationframework|\.xaml"


def wpf_project(text: Column | str) -> Column:
    return F.lower(_c(text)).rlike(WPF_MARKS)


def valid_category(column: Column | str, vocabulary: list[str]) -> Column:
    return F.lower(_c(column)).isin(*[v.lower() for v in vocabulary])


def required(args: dict, name: str) -> str:
    """A required text argument, or a ValueError that names it."""
    if not isinstance(v := args.get(name), str) or not v.strip():
        raise ValueError(f"{name} is required")
    return v


def optional(args: dict, name: str, default, kind: type | None = None):  # noqa: ANN001, ANN201
    """An argument or its default where it is absent or null; a ValueError if it is of another kind (by default that of the default). Lists of texts lose their empty ones."""
    v = args.get(name)
    if v is None:
        return default
    wanted = kind or type(default)
    if isinstance(v, bool) != (wanted is bool) or not isinstance(v, (int, float) if wanted is float else wanted):
        raise ValueError(f"{name} must be {wanted.__name__}")
    return [x for x in v if x] if isinstance(v, list) else v


def required_int(args: dict, name: str, least: int) -> int:
    v = args.get(name)
    if isinstance(v, bool) or not isinstance(v, int) or v < least:
        raise ValueError(f"{name} must be a whole number of at least {least}")
    return v


def member_matches(kind: Column | str, name: Column | str, wanted: str = "all") -> Column:
    """Members of the kind (all without one), letter case ignored, without accessors and compiler-made ones."""
    made = _c(name).rlike(r"^(get_|set_|add_|remove_|<)")
    return ~made & (F.lit(True) if wanted.lower() == "all" else F.lower(_c(kind)) == wanted.lower())


def kind_label(kind: Column | str, type_kind: Column | str) -> Column:
    """What a symbol is called: its kind, and for types the kind of type."""
    t = F.lower(_c(type_kind))
    return F.when((_c(kind) == "Type") & t.isin("class", "interface", "struct", "enum", "delegate", "record"), F.initcap(t)).otherwise(_c(kind))
