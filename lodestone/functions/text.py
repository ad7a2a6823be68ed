"""Text functions as native columns: white space, lines, tokens, paths, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense, with the four separators that Java leaves out.
SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def strip_left(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+", "")


def indent(c: Column) -> Column:
    """Characters of leading white space."""
    return F.length(c) - F.length(strip_left(c))


def lines(c: Column) -> Column:
    """Parts between newlines; a trailing empty part stays."""
    return F.split(c, "\n", -1)


def split_lines(c: Column) -> Column:
    """Lines by any Unicode line break; a trailing empty line is none."""
    parts = F.split(c, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def count_lines(c: Column) -> Column:
    """Lines of a text file: \\n, \\r and \\r\\n end one, a last line without an end counts."""
    parts = F.split(c, "\r\n|\r|\n", -1)
    return F.when(c == "", 0).otherwise(F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).cast("long")


def tokens(c: Column) -> Column:
    """Lower-case parts between white space."""
    return F.filter(F.split(F.lower(c), rf"(?U){SPACE}+"), lambda x: x != "")


def decode(content: Column) -> Column:
    """Bytes as UTF-8 with invalid parts left out and line ends as \\n."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case last suffix with its dot; empty for names that only start with one or end in one."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def module_strict(path: Column) -> Column:
    """Dotted module of a .py path; null for others."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.endswith(clean, F.lit(".py")), F.replace(F.substring(clean, F.lit(1), F.length(clean) - 3), F.lit("/"), F.lit(".")))


def module_lenient(path: Column) -> Column:
    """Dotted module of any path; only .py loses its suffix."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.replace(F.when(F.endswith(clean, F.lit(".py")), F.substring(clean, F.lit(1), F.length(clean) - 3)).otherwise(clean), F.lit("/"), F.lit("."))


def uuid5_dns(name: Column) -> Column:
    """Version 5 UUID of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def choice(mapping: dict[str, object], key: Column) -> Column:
    """The mapping's value for a key; null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)
