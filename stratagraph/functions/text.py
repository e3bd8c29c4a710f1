"""Scalar functions on names, paths and texts, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), r"^[\s \u0085]+|[\s \u0085]+$", "")


def canonical(c: Column | str) -> Column:
    """Lower case, letters and decimal digits only."""
    return F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{Nd}]", "")


def canonical_text(value: str) -> str:
    return "".join(ch for ch in value.lower() if unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nd")


def qname_tail(c: Column | str) -> Column:
    """What follows the last '.' or '/', or the whole where nothing does."""
    tail = F.regexp_extract(trimmed(c), r"[./]([^./]+)$", 1)
    return F.when(tail != "", tail).otherwise(trimmed(c))


def normalized_token(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]", "")


def normalized_name(c: Column | str) -> Column:
    return F.lower(F.translate(_col(c), "_-", ""))


def without_test_prefix(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"^(Test|Benchmark|Fuzz)", "")


def base_name(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"([^/]*)$", 1)


def file_family(c: Column | str) -> Column:
    """The base name without its extension and a trailing _test."""
    return F.regexp_replace(F.regexp_replace(base_name(c), r"\.[^.]*$", ""), r"_test$", "")


def extension_label(c: Column | str) -> Column:
    """The extension in lower case, or 'none'."""
    ext = F.lower(F.regexp_extract(base_name(c), r"(\.[^.]*)$", 1))
    return F.when(ext.isin("", "."), F.lit("none")).otherwise(ext)


def unix_newlines(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\r\n"), F.lit("\n"))


def line_count(c: Column | str) -> Column:
    """Lines of a text; a newline at the end begins no further line, an empty text has none."""
    text = unix_newlines(c)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0))


def filled_line_count(c: Column | str) -> Column:
    """Lines that hold more than white space."""
    return F.size(F.filter(F.split(unix_newlines(c), "\n"), lambda x: trimmed(x) != ""))


def human_size(c: Column | str) -> Column:
    """Bytes with a unit of 1024: '512 B', '1.5 KB'; halves of a tenth go to the even one."""
    size = _col(c).cast("double")
    out = F.concat(F.format_string("%.0f", size), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(size >= 1024.0**power, F.concat(F.format_string("%.1f", F.rint(size / 1024.0**power * 10) / 10), F.lit(f" {unit}"))).otherwise(out)
    return out


def same_letters_in_order(needle: str, c: Column | str) -> Column:
    """Whether the letters of ``needle`` occur in the text in this order."""
    return F.lit(True) if not needle else _col(c).rlike("(?s)" + ".*".join("\\x{%x}" % ord(ch) for ch in needle))


def short_qname(module: str, c: Column | str) -> Column:
    """A qualified name without its module's prefix."""
    return F.when(_col(c).startswith(module + "/"), F.substring(_col(c), F.lit(len(module) + 2), F.length(_col(c)))).when(
        _col(c).startswith(module + "."), F.substring(_col(c), F.lit(len(module) + 2), F.length(_col(c)))
    ).otherwise(_col(c))


def stable_strings(c: Column | str) -> Column:
    """Trimmed, non-empty, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(_col(c), trimmed), lambda x: x != "")))


def project_id(c: Column | str) -> Column:
    return F.substring(F.sha2(_col(c), 256), 1, 16)


def same_family(a: Column | str, b: Column | str) -> Column:
    """Whether a file and a test file have one name, but for the extension and the test's '_test'."""
    own, other = (F.regexp_replace(base_name(c), r"\.[^.]*$", "") for c in (a, b))
    return (own != "") & (own == F.regexp_replace(other, "_test$", ""))


def name_affinity(name: Column | str, test_name: Column | str) -> Column:
    """Whether the letters and digits of a test's name contain those of a symbol's name."""
    return (_col(test_name) != "") & normalized_token(test_name).contains(normalized_token(name))


def merged_why(left: Column, right: Column) -> Column:
    """Two reasons as one: the longer where it contains the other, else both."""
    return (
        F.when(left == "", right).when((right == "") | left.contains(right), left).when(right.contains(left), right).otherwise(F.concat(left, F.lit("; "), right))
    )


def in_scope(path: Column | str, scope: str) -> Column:
    """Whether a path is a directory or lies below it; '' holds every path."""
    scope = scope.strip().strip("/")
    return _col(path) != "" if not scope else (_col(path) == scope) | _col(path).startswith(scope + "/")


def display_signature(kind: str = "kind", name: str = "name", receiver: str = "receiver", signature: str = "signature") -> Column:
    """The signature as it is shown: with the name, and for types with their keyword."""
    k, n, r, s = (F.col(c) for c in (kind, name, receiver, signature))
    plain = F.when(s != "", s).otherwise(n)
    rest = F.substring(s, F.lit(5), F.length(s))
    bare = s.startswith("func(")
    of_type = F.when((s != "") & (s != n), F.when(s.startswith("type "), s).otherwise(F.concat(F.lit("type "), n, F.lit(" "), s))).when(n != "", F.concat(F.lit("type "), n)).otherwise(plain)
    return (
        F.when((k == "method") & bare & (r != ""), F.concat(F.lit("func ("), r, F.lit(") "), n, rest)).when(k.isin("func", "method") & bare, F.concat(F.lit("func "), n, rest))
        .when(k.isin("struct", "interface", "type", "alias", "class"), of_type).otherwise(plain)
    )
