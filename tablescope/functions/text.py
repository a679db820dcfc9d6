"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"(?U)^\s+|\s+$"


def dedup_lines(text: Column, prefix: int = 25, max_chars: int | None = 600) -> Column:
    """Trimmed, non-blank lines, the first per ``prefix`` characters, original order.

    Longer results are cut at the last line break before ``max_chars`` and marked with
    ``...``; ``None`` keeps all. Sorting lines by (prefix, position) makes repeats
    neighbours, so long texts cost n log n, not n squared.
    """
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.struct(
        F.regexp_replace(s, _BLANK, "").alias("line"), i.alias("pos")))
    filled = F.filter(lines, lambda s: s["line"] != "")
    keyed = F.array_sort(F.transform(filled, lambda s: F.struct(
        F.substring(s["line"], 1, prefix).alias("key"), s["pos"].alias("pos"), s["line"].alias("line"))))
    # Pair every line with the key of the line before it in sorted order.
    keys = F.transform(keyed, lambda s: s["key"])
    before = F.concat(F.array(F.lit(None).cast("string")), keys)
    paired = F.arrays_zip(keyed.alias("s"), F.slice(before, 1, F.size(keys)).alias("before"))
    fresh = F.filter(paired, lambda p: p["before"].isNull() | (p["before"] != p["s"]["key"]))
    ordered = F.array_sort(F.transform(fresh, lambda p: F.struct(
        p["s"]["pos"].alias("pos"), p["s"]["line"].alias("line"))))
    joined = F.coalesce(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n"), F.lit(""))
    if max_chars is None:
        return joined
    head = F.substring(joined, 1, max_chars)
    cut = F.regexp_replace(head, r"\n[^\n]*\z", "")
    return F.when(F.length(joined) > max_chars, F.concat(cut, F.lit("\n..."))).otherwise(joined)


def client_key(forwarded: Column, address: Column) -> Column:
    """Private client key: 32 hex digits of the SHA-256 of the first forwarded address.

    Falls back to the peer address, then to ``unknown``.
    """
    first = F.when(F.length(forwarded) > 0, F.trim(F.split(forwarded, ",")[0]))
    who = F.coalesce(first, F.when(F.length(address) > 0, address), F.lit("unknown"))
    return F.substring(F.sha2(who, 256), 1, 32)
