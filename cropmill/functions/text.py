"""Tolerant casts, filters given as text, names, durations and progress lines. Column expressions, and parsers of plan-time literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of a progress line.
PROGRESS = r"(\d+(?:\.\d+)?)%\s+\|\s+(.*?)\s+\|\s+elapsed=(.*?)(?:\s+eta=(.*))?$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(x.cast("string")).isin("true", "1", "yes", "y", "on"), F.lit(False))


def safe_double(x: Column, default: float = 0.0) -> Column:
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(v)


def safe_int(x: Column, default: int = 0) -> Column:
    """Integer part of a number given as text; the default for anything else, infinities included."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v.cast("int"))


def class_ids(text: str | None) -> list[int]:
    """Class ids of a list divided by white space, commas or semicolons; what isn't a finite number is passed over."""
    out = []
    for token in re.split(r"[\s,;]+", text or ""):
        try:
            out.append(int(float(token)))
        except (ValueError, OverflowError):
            continue
    return out


def matches_class(choice: str | None, class_id: Column, class_name: Column) -> Column:
    """A filter given as nothing or ``all``, an id, ``id: name``, or a name in any case."""
    value = (choice or "").strip()
    if not value or value.lower() == "all":
        return F.lit(True)
    value = value.split(":", 1)[0].strip() if ":" in value else value
    if re.fullmatch(r"-*\d+", value):
        return class_id == int(value)
    return F.lower(class_name) == value.lower()


def box_numbers(text: Column) -> Column:
    """The first four integers of a box written as text."""
    return F.slice(F.regexp_extract_all(text, F.lit(r"(-?\d+)"), F.lit(1)).cast("array<int>"), 1, 4)


def slug(name: Column, default: str = "project") -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.trim(name), r"[^0-9A-Za-z가-힣_.-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(default))


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, max(1, most - 3)), F.lit("..."))).otherwise(text)


def relative_path(path: Column, root: str, fallback: str) -> Column:
    """The path below ``root``, or ``fallback`` and its last six parts without colons."""
    base = root.rstrip("/") + "/"
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.replace(p, F.lit(":"), F.lit("")))
    last = F.when(F.size(parts) > 6, F.slice(parts, -6, 6)).otherwise(parts)
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(F.concat(F.lit(fallback + "/"), F.array_join(last, "/")))


def duration_text(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds.cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))


def duration_seconds(text: Column) -> Column:
    """Seconds of a text such as ``1h 02m 03s``; null where there is no such part."""
    amounts = F.regexp_extract_all(text, F.lit(r"(\d+)\s*(h|m|s)"), F.lit(1)).cast("array<long>")
    units = F.regexp_extract_all(text, F.lit(r"(\d+)\s*(h|m|s)"), F.lit(2))
    parts = F.zip_with(amounts, units, lambda a, u: a * F.when(u == "h", 3600).when(u == "m", 60).otherwise(1))
    return F.when(F.size(amounts) > 0, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x))


def progress(line: Column) -> list[Column]:
    """Parts of a progress line ``pct% | message | elapsed=... eta=...``; all null where the line isn't one."""
    text = F.trim(line)
    good = text.rlike(PROGRESS)
    message = F.when(good, F.regexp_extract(text, PROGRESS, 2))
    counts = r"(\d+)\s*/\s*(\d+)"
    eta = F.when(good, F.trim(F.coalesce(F.regexp_extract(text, PROGRESS, 4), F.lit(""))))
    return [F.when(good, F.regexp_extract(text, PROGRESS, 1).cast("double")).alias("pct"), message.alias("message"), F.when(message.rlike(counts), F.regexp_extract(message, counts, 1).cast("long")).alias("done"), F.when(message.rlike(counts), F.regexp_extract(message, counts, 2).cast("long")).alias("total"), F.when(good, F.trim(F.regexp_extract(text, PROGRESS, 3))).alias("elapsed"), eta.alias("eta"), duration_seconds(eta).alias("eta_seconds")]


def action_group(action: Column) -> Column:
    """Review group of an action, by the first of these marks that its name holds."""
    up = F.upper(action)
    return F.when(up.contains("USER_OVERRIDE"), "User keep").when(up.startswith("DROP"), "Drop candidate").when(up.contains("REPRESENTATIVE"), "Representative").when(up.contains("PROTECTED"), "Protected").otherwise("Keep")


# Colours of actions (red, green, blue), by the first mark that holds.
ACTION_COLORS = {"USER_OVERRIDE": (34, 197, 94), "DROP": (248, 113, 113), "PROTECT": (251, 191, 36), "REPRESENTATIVE": (52, 211, 153), "": (125, 211, 252)}


def action_color(action: Column) -> Column:
    """The colour of an action as ``#rrggbb``; ``DROP`` must stand first, other marks anywhere."""
    up = F.upper(F.coalesce(action, F.lit("")))
    out = F.lit("#%02x%02x%02x" % ACTION_COLORS[""])
    for mark, rgb in reversed([x for x in ACTION_COLORS.items() if x[0]]):
        out = F.when(up.startswith(mark) if mark == "DROP" else up.contains(mark), F.lit("#%02x%02x%02x" % rgb)).otherwise(out)
    return out
