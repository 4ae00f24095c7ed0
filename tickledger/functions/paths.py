"""Request paths and Basic headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: prefix of a Basic header, matched without regard to case
BASIC = "Basic "


def url_path(url: Column) -> Column:
    """Path of an absolute or relative url, without query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def _segments(path: Column) -> Column:
    """Parts of a path after removing empty parts and dots and applying double dots."""
    parts = F.filter(F.split(path, "/", -1), lambda part: (part != "") & (part != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, part: F.when(
            part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        ).otherwise(F.concat(kept, F.array(part))),
    )
    return F.when(path.rlike(r"(?:^|/)\.\.(?:/|$)"), folded).otherwise(parts)


def shift_path(path: Column) -> Column:
    """(head, tail): the first part of the cleaned path, and the rest with a leading slash."""
    parts = _segments(path)
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("head"),
        F.concat(F.lit("/"), F.array_join(F.slice(parts, 2, 1 << 30), "/")).alias("tail"),
    )


def basic_user(header: Column) -> Column:
    """User of a Basic header, or null when the header is not valid.

    The text is cut at the first colon; the part after it is never selected.
    """
    coded = F.substring(header, len(BASIC) + 1, 1 << 30)
    well_formed = coded.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    text = F.when(well_formed, F.unbase64(coded).cast("string"))
    prefix = F.lower(F.substring(header, 1, len(BASIC))) == BASIC.lower()
    return F.when(prefix & (F.instr(text, ":") > 0), F.substring_index(text, ":", 1))
