"""Scalar functions as Column -> Column; none of them leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(text: Column | str) -> Column:
    """First 16 upper-case hexadecimal digits of the SHA-256 of the UTF-8 text."""
    return F.upper(F.substring(F.sha2(_c(text).cast("binary"), 256), 1, 16))


def file_text_hash(text: Column | str) -> Column:
    """content_hash of a file's text, a leading byte-order mark aside."""
    return content_hash(F.regexp_replace(_c(text), "^\\x{FEFF}", ""))


def body_hash(text: Column | str) -> Column:
    """SHA-256 of the text with white space collapsed; '' for an empty text."""
    flat = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return F.when(flat == "", "").otherwise(F.sha2(flat, 256))


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance, letter case ignored."""
    return F.levenshtein(F.lower(_c(a)), F.lower(_c(b)))


def is_subsequence(pattern: str, target: Column | str) -> Column:
    """Whether the characters of the pattern occur in the target in order, letter case ignored."""
    return _c(target).rlike("(?isu)" + ".*".join(re.escape(c) for c in pattern))


def initials(name: Column | str) -> Column:
    """First character and every capital, in lower case."""
    return F.lower(F.array_join(F.regexp_extract_all(_c(name), F.lit(r"(^.|\p{Lu})"), F.lit(1)), ""))


def initials_match(pattern: str, name: Column | str) -> Column:
    return initials(name).startswith(pattern.lower())


def fuzzy_score(pattern: str, name: Column | str) -> Column:
    """Lower is nearer; null where the name is too far away."""
    name, n = _c(name), len(pattern)
    most = max(3, n // 3)
    d, inside, first = edit_distance(F.lit(pattern), name), is_subsequence(pattern, name), initials_match(pattern, name)
    close = d <= most
    return F.when(first & inside, F.lit(-n)).when(inside & close, d - n).when(close, d).when(inside & (F.length(name) <= 2 * n), d)


def suggestion_label(pattern: str, name: Column | str) -> Column:
    d = edit_distance(F.lit(pattern), name)
    return F.when(is_subsequence(pattern, name) & (d > 3), F.lit("subsequence")).otherwise(F.concat(F.lit("distance: "), d.cast("string")))


def constructor_name(qualified: Column | str) -> Column:
    """Ns.Type..ctor(p) as Ns.Type.Type(p); null where nothing stands before .ctor."""
    q = _c(qualified)
    owner = F.regexp_extract(q, r"^(.*?[^.])\.?\.ctor", 1)
    rest = F.regexp_extract(q, r"\.ctor(.*)$", 1)
    return F.when(owner != "", F.concat(owner, F.lit("."), F.element_at(F.split(owner, "[.]"), -1), rest))


def type_name(qualified: Column | str) -> Column:
    """The last but one segment of what stands before the parameters; null without one."""
    parts = F.split(F.substring_index(_c(qualified), "(", 1), "[.]")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def containing_type(qualified: Column | str) -> Column:
    """The last but one dotted part of the whole name, parameters included; '' without one. Dotted parameter types mislead it, as they always did."""
    parts = F.split(_c(qualified), "[.]")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")


def parameters(qualified: Column | str) -> Column:
    """The text between the first ( and the last ), or ''."""
    return F.regexp_extract(_c(qualified), r"(?s)\((.*)\)", 1)


# Folder names that are never a project.
PLAIN_FOLDERS = ("src", "Source", "source", "obj", "bin", "Debug", "Release", "net8.0", "net10.0")


def project_name(path: Column | str, skipped: tuple[str, ...] = PLAIN_FOLDERS) -> Column:
    """The nearest parent folder that looks like a project: not a plain folder, with a dot or longer than two and with a capital first; else the direct parent."""
    folders = F.split(F.regexp_replace(_c(path), r"\\", "/"), "/")
    parents = F.reverse(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))))
    fits = lambda x: ~x.isin(*skipped) & (x.contains(".") | ((F.length(x) > 2) & x.rlike(r"^\p{Lu}")))
    return F.coalesce(F.get(F.filter(parents, fits), F.lit(0)), F.get(parents, F.lit(0)))


def relative_path(path: Column | str, root: str) -> Column:
    """The path below root with / as separator; letter case of the root ignored."""
    p = F.regexp_replace(_c(path), r"\\", "/")
    base = root.replace("\\", "/").rstrip("/")
    below = (F.lower(p) == base.lower()) | F.lower(p).startswith(base.lower() + "/")  # /a/repo2 is not below /a/repo
    return F.when(below, F.regexp_replace(F.substring(p, len(base) + 1, 1 << 30), "^/+", "")).otherwise(p)


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.regexp_replace(_c(path), r"\\", "/"), "/", -1)


def search_terms(query: str) -> list[str]:
    """The words of a full-text query; each is searched as a prefix. Operators of the query language are blanks, and other punctuation splits words too."""
    return [w for w in re.split(r"[\W_]+", re.sub(r'["*():^]', " ", query).lower()) if w]


def tokens(text: Column | str) -> Column:
    """Words of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def occurrences(text: Column, old: Column) -> Column:
    """Non-overlapping occurrences of old; 0 for an empty old."""
    return F.when(F.length(old) > 0, ((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)).cast("int")).otherwise(0)


def text_edit(text: Column | str, old: Column | str, new: Column | str, replace_all: bool = False) -> Column:
    """struct(status, n, text): old replaced by new. CRLF becomes LF. status is not_found, ambiguous (several, and not all are to be replaced) or replaced."""
    lf = lambda x: F.replace(_c(x), F.lit("\r\n"), F.lit("\n"))
    t, o, w = lf(text), lf(old), lf(new)
    n = occurrences(t, o)
    status = F.when(n == 0, "not_found").when((n > 1) & F.lit(not replace_all), "ambiguous").otherwise("replaced")
    return F.struct(status.alias("status"), n.alias("n"), F.when(status == "replaced", F.replace(t, o, w)).otherwise(t).alias("text"))


def using_name(text: Column | str) -> Column:
    """A using directive without its keyword, semicolon and outer blanks."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(_c(text)), "^using ", "")), ";$", ""))


def shortened(text: Column | str, most: int = 100) -> Column:
    return F.when(F.length(_c(text)) > most, F.concat(F.substring(_c(text), 1, most), F.lit("..."))).otherwise(_c(text))


def version_key(version: Column | str) -> Column:
    """The dotted numbers before a -, as an array that compares like the version; null if they are not numbers."""
    head = F.substring_index(_c(version), "-", 1)
    return F.when(head.rlike(r"^\d+(\.\d+){1,3}$"), F.transform(F.split(head, "[.]"), lambda x: x.cast("int")))


def grouped_number(x: Column | str, digits: int = 0) -> Column:
    return F.format_number(_c(x), digits)


def signature(kind: Column, result: Column, name: Column, params: Column, accessors: Column) -> Column:
    """One line for a member or type, by its kind (letter case ignored).

    Methods: result, name and params (array of struct<type, name>); constructors the same without a result; properties: result, name and accessors (array) in braces; events: a leading
    word; fields: result and name; any other kind is a type: the kind in lower case, the name, and the names of params, if any, in angle brackets.
    """
    k = F.lower(kind)
    listed = F.array_join(F.transform(params, lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")
    call = F.concat(name, F.lit("("), listed, F.lit(")"))
    plain = F.concat_ws(" ", result, name)
    made_of = F.when(F.size(params) > 0, F.concat(F.lit("<"), F.array_join(F.transform(params, lambda p: p["name"]), ", "), F.lit(">"))).otherwise(F.lit(""))
    return (
        F.when(k == "method", F.concat_ws(" ", result, call))
        .when(k == "constructor", call)
        .when(k == "property", F.concat(plain, F.lit(" { "), F.array_join(accessors, "; "), F.lit("; }")))
        .when(k == "event", F.concat(F.lit("event "), plain))
        .when(k == "field", plain)
        .otherwise(F.concat(k, F.lit(" "), name, made_of))
    )
