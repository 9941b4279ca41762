"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators that regular expressions leave out.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+\z", "")


def normalize_text(c: Column | str) -> Column:
    """No soft hyphens, runs of white space as one blank, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("­"), F.lit("")), SPACE, " "))


def strip_html(c: Column | str) -> Column:
    """Tags become blanks; script bodies and character references stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"<[^>]+>", " "), SPACE, " "))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(~_col(c).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def join_list(c: Column | str) -> Column:
    """The non-empty items with blanks between; null gives ''."""
    return F.coalesce(F.array_join(F.filter(_col(c), lambda x: x.isNotNull() & (x != "")), " "), F.lit(""))


def join_text(c: Column | str) -> Column:
    """The trimmed non-blank items, one a line."""
    return F.coalesce(F.array_join(F.filter(F.transform(_col(c), strip), lambda x: x.isNotNull() & (x != "")), "\n"), F.lit(""))


def apply_prefix(text: Column, kind: Column, enabled: bool = True) -> Column:
    if not enabled:
        return text
    return F.when(kind.isNull() | (text == ""), text).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("] "), text))


def session_id(c: Column | str) -> Column:
    """Runs of other characters than letters, digits, dot, underscore and hyphen become '_'; an empty id is 'default'."""
    return F.coalesce(F.nullif(F.regexp_replace(strip(F.coalesce(_col(c), F.lit(""))), r"[^a-zA-Z0-9._-]+", "_"), F.lit("")), F.lit("default"))


def preview(c: Column | str, limit: int = 800) -> Column:
    """Line ends escaped, cut at ``limit`` with a mark."""
    value = F.replace(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.left(value, F.lit(limit)), F.lit("...<truncated>")))


def source_key(kind: Column, path: Column) -> Column:
    return F.concat_ws(":", kind, F.replace(path, F.lit("\\"), F.lit("/")))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def utc_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def normalize_bbox(bbox: Column, width: Column, height: Column) -> Column:
    """Thousandths of the page, cut to integers; boxes without four numbers or a page size stay."""
    scale = lambda i, size: (bbox[i].cast("double") * 1000 / size).cast("int")
    fine = bbox.isNotNull() & (F.size(bbox) == 4) & (F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0)
    return F.when(fine, F.array(scale(0, width), scale(1, height), scale(2, width), scale(3, height))).otherwise(bbox)


def sanitize_metadata(c: Column, simple: bool) -> Column:
    """Scalars as they are, anything else as JSON text."""
    return c if simple else F.to_json(c)


def context_block(left: Column, right: Column, left_label: str = "Left context: ", right_label: str = "Right context: ") -> Column:
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    return F.concat_ws("\n", part(left_label, left), part(right_label, right))


def prompt(template: str, **parts: Column) -> Column:
    """``{name}`` in the template replaced by the columns."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def failure_has(message: Column, *parts: str) -> Column:
    """Whether a message holds any of the strings, in any case."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p.lower()))
    return out


def predict_tokens(base: Column, attempt: Column, factor: float = 2.0, most: int = 512) -> Column:
    """Output budget of a retry: geometric growth, or linear where that does not grow, up to ``most``; null for the first attempt."""
    grown = F.bround(base * F.pow(F.lit(factor), attempt)).cast("long")
    grown = F.when(grown <= base, base * (attempt + 1)).otherwise(grown)
    return F.when((attempt > 0) & (base > 0), F.least(F.lit(most).cast("long"), F.greatest(base, grown)))


def token_budget(base: int, attempt: int, factor: float = 2.0, most: int = 512) -> int | None:
    """``predict_tokens`` for a number."""
    if attempt <= 0 or base <= 0:
        return None
    grown = round(base * factor**attempt)
    return min(most, max(base, grown if grown > base else base * (attempt + 1)))


def normalize_weights(dense: float, sparse: float) -> tuple[float, float]:
    """Not below 0 and summing to 1; equal if both are 0."""
    d, s = max(0.0, dense), max(0.0, sparse)
    return (d / (d + s), s / (d + s)) if d + s > 0 else (0.5, 0.5)
