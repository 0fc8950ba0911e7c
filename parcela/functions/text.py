"""Text clean-up, links and stable ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

# Every blank that is folded to one space. Spark's \s is ASCII
# only, so the Unicode blanks (and U+200B) are listed.
BLANKS = r"[\s\x0b\x1c-\x1f\x85\u00A0\u1680\u2000-\u200B\u2028\u2029\u202F\u205F\u3000]+"


def normalize_text(c: Column | str) -> Column:
    """Fold runs of blanks to one space and strip the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def uuid5_dns(c: Column | str) -> Column:
    """UUID version 5 of the text in the DNS namespace, without a Python UDF."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string").cast("binary")
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_DNS.hex)), text))
    # The variant keeps the two low bits of its hex digit and sets the high one.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def repair_text(c: str, wrong: str, right: str) -> Column:
    """Replace ``wrong`` only in the rows that hold it."""
    col = F.col(c)
    return F.when(col.contains(wrong), F.replace(col, F.lit(wrong), F.lit(right))).otherwise(col)


def absolute_link(c: str) -> Column:
    """Link for display: a missing scheme becomes https."""
    col = F.col(c)
    return F.when(col.startswith("http"), col).otherwise(F.concat(F.lit("https://"), col))


def or_default(c: str, default: str) -> Column:
    """The text, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
