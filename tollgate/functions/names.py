"""Data set names, instance ids and image paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Instance-id prefix -> image folder, as the published merged
# outcome table uses them.
PREFIX_FOLDERS = {
    "MathVerse": "MathVerse",
    "MathVision": "MathVision",
    "MathVista": "MathVista",
    "OCRBench": "OCRBench",
    "RealWorldQA": "RealWorldQA",
    "MMStar": "MMStar",
    "SEEDBench2_Plus": "SEEDBenchv2Plus",
}

# Further accepted spellings (canonical) -> prefix. Every prefix
# is accepted under its own canonical spelling, too.
EXTRA_ALIASES = {
    "seedbench": "SEEDBench2_Plus",
    "seedbenchv2plus": "SEEDBench2_Plus",
}

# Image file endings, in the order they are tried.
IMAGE_ENDINGS = (".jpg", ".png", ".jpeg", ".webp")

UNKNOWN_FOLDER = "unknown"

# What begins a URI.
SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"


def canonical_name(name: str) -> str:
    """``canonical`` for a driver-side name."""
    return "".join(ch for ch in name.lower() if ch in "abcdefghijklmnopqrstuvwxyz0123456789")


def canonical(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def alias_table(prefixes: Mapping[str, str] = PREFIX_FOLDERS) -> dict[str, str]:
    aliases = {canonical_name(p): p for p in prefixes}
    aliases.update({a: p for a, p in EXTRA_ALIASES.items() if p in prefixes})
    return aliases


def data_set_key(name: str, prefixes: Mapping[str, str] = PREFIX_FOLDERS) -> str:
    """One spelling for all names of a data set: that of its folder, if it is known."""
    known = canonical_name(name)
    prefix = alias_table(prefixes).get(known)
    return canonical_name(prefixes[prefix]) if prefix else known


def data_set_keys(c: Column, prefixes: Mapping[str, str] = PREFIX_FOLDERS) -> Column:
    """``data_set_key`` of a column."""
    folders = {a: canonical_name(prefixes[p]) for a, p in alias_table(prefixes).items()}
    return F.coalesce(_lookup(canonical(c), folders), canonical(c))


def alias_prefix(c: Column, prefixes: Mapping[str, str] = PREFIX_FOLDERS) -> Column:
    """Prefix a data set name stands for; NULL if it is none of the known."""
    return _lookup(canonical(c), alias_table(prefixes))


def longest_prefix(idx: Column, prefixes: Mapping[str, str] = PREFIX_FOLDERS) -> Column:
    """Longest ``p`` with ``idx = p`` or ``idx`` starting with ``p_``; else NULL."""
    out = F.lit(None).cast("string")
    # the last WHEN added is the first tested, so the longest goes on last
    for p in sorted(prefixes, key=len):
        out = F.when((idx == p) | idx.startswith(p + "_"), F.lit(p)).otherwise(out)
    return out


def folder_of(idx: Column, prefixes: Mapping[str, str] = PREFIX_FOLDERS) -> Column:
    found = _lookup(longest_prefix(idx, prefixes), dict(prefixes))
    return F.coalesce(found, F.lit(UNKNOWN_FOLDER))


def image_stem(idx: Column, prefixes: Mapping[str, str] = PREFIX_FOLDERS) -> Column:
    """Image file name without ending: what follows the prefix, or for a bare
    prefix its last ``_`` part; NULL for an unknown prefix."""
    prefix = longest_prefix(idx, prefixes)
    after = F.substring(idx, F.length(prefix) + 2, F.length(idx))
    last_part = F.element_at(F.split(idx, "_"), -1)
    return F.when(prefix.isNull(), F.lit(None)).when(idx == prefix, last_part).otherwise(after)


def default_image_path(
    idx: Column, root: str, prefixes: Mapping[str, str] = PREFIX_FOLDERS
) -> Column:
    """Path taken when no image file is found; empty for an unknown prefix."""
    path = F.concat(
        F.lit(root.rstrip("/") + "/"),
        folder_of(idx, prefixes),
        F.lit("/"),
        image_stem(idx, prefixes),
        F.lit(IMAGE_ENDINGS[0]),
    )
    return F.coalesce(path, F.lit(""))


def resolve_path(path: Column, base: Column) -> Column:
    """Relative path against ``base``; absolute and empty paths stay.

    A path with a scheme (``s3a://``, ``file:``) is absolute. Of a base with one, scheme
    and authority stay as they are and only what follows is cleaned; a relative base
    gives a relative path.
    """
    p = F.coalesce(path, F.lit(""))
    absolute = p.startswith("/") | p.rlike(f"^{SCHEME}")
    joined = F.concat(base, F.lit("/"), p)
    head = F.regexp_extract(joined, rf"^({SCHEME}(?://[^/]*)?)?", 0)
    rest = F.substring(joined, F.length(head) + 1, F.length(joined))
    root = F.when(rest.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.when((p == "") | absolute, p).otherwise(F.concat(head, root, _without_dots(rest)))


def _without_dots(path: Column) -> Column:
    """Parts without ``.`` and empty ones; ``..`` takes its parent away, if there is one."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(
            (part == "..") & ((F.size(acc) > 0) & (F.element_at(acc, -1) != "..") | path.startswith("/")),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        )
        .otherwise(F.concat(acc, F.array(part))),
    )
    return F.array_join(parts, "/")


def _lookup(key: Column, table: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)
