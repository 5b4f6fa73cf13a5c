"""Scalar building blocks: predicates on colours and positions, axis maps, rounding, header fields.

All return columns, so they stay inside Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Colour limits, tolerances and default axes of the charts read here.
BLUE, GREEN = (0.45, 0.45, 0.55, 0.50), (0.45, 0.35, 0.45, 0.50)
NEAR = 0.12
HALF_PEN_POINTS, HALF_PEN_KG, PEN_SLACK = 0.72, 0.0389, 1.15
END_OF_FLOW, GATE, STEP = 0.20, 98.0, 0.02
DEFAULT_TOP = 9.0


def rounded(x: Column, places: int) -> Column:
    """Half up by floor, which gives the same double in every engine."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clip(x: Column, low: Column | None, high: Column | None) -> Column:
    """``x`` within bounds; a missing bound doesn't clip, and null stays null."""
    if low is not None:
        x = F.when(x.isNull() | low.isNull(), x).otherwise(F.greatest(x, low))
    if high is not None:
        x = F.when(x.isNull() | high.isNull(), x).otherwise(F.least(x, high))
    return x


def is_blue(r: Column, g: Column, b: Column) -> Column:
    """A flow stroke: blue by level and by dominance over red."""
    return (b > BLUE[2]) & (r < BLUE[0]) & (g < BLUE[1]) & (b - r > BLUE[3])


def is_green(r: Column, g: Column, b: Column) -> Column:
    """A pressure stroke."""
    return (g > GREEN[1]) & (r < GREEN[0]) & (b < GREEN[2]) & (g - r > GREEN[3])


def is_near(c: tuple[Column, Column, Column], target: tuple[float, float, float], tolerance: float = NEAR) -> Column:
    """Each channel within the tolerance of a target colour."""
    close = [F.abs(x - F.lit(t)) <= F.lit(tolerance) for x, t in zip(c, target)]
    return close[0] & close[1] & close[2]


def channels(packed: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a packed 24-bit colour."""
    return F.shiftright(packed, 16).bitwiseAND(255), F.shiftright(packed, 8).bitwiseAND(255), packed.bitwiseAND(255)


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in half degrees (0 to 180) of 8-bit channels; 0 for greys."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, F.lit(0.0)).when(top == r, 60.0 * (g - b) / d).when(top == g, 120.0 + 60.0 * (b - r) / d).otherwise(240.0 + 60.0 * (r - g) / d)
    return F.when(h < 0, h + 360.0).otherwise(h) / 2.0


def saturation(r: Column, g: Column, b: Column) -> Column:
    """Saturation (0 to 255) of 8-bit channels."""
    top = F.greatest(r, g, b)
    return F.when(top == 0, F.lit(0.0)).otherwise((top - F.least(r, g, b)) * 255.0 / top)


def blue_pixel(r: Column, g: Column, b: Column) -> Column:
    """A flow pixel by hue, saturation and value (8-bit channels; fixed limits)."""
    return hue(r, g, b).between(95, 135) & (saturation(r, g, b) >= 60) & (F.greatest(r, g, b) >= 60)


def green_pixel(r: Column, g: Column, b: Column) -> Column:
    """A pressure pixel."""
    return hue(r, g, b).between(40, 90) & (saturation(r, g, b) >= 40) & (F.greatest(r, g, b) >= 40)


def plain_blue(r: Column, g: Column, b: Column) -> Column:
    """A flow pixel by its channels alone, as a check that doesn't share the other's limits."""
    return (b > 150) & (r < 90) & (g < 90)


def plain_green(r: Column, g: Column, b: Column) -> Column:
    return (g > 90) & (r < 90) & (b < 90)


def accepted_upload(name: Column) -> Column:
    """Whether a file's name has an ending that reports come with. A name that only begins with a dot has
    no ending; a null name isn't accepted."""
    ending = F.regexp_extract(F.lower(name), r"[^/\\.][^/\\]*(\.[^./\\]+)$", 1)
    return F.coalesce(ending.isin(".pdf", ".png", ".jpg", ".jpeg"), F.lit(False))


def is_tick_label(text: Column) -> Column:
    """One or two digits, white space around them aside."""
    return F.trim(text).rlike("^[0-9]{1,2}$")


def in_window(x: Column, y: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Half open in x, closed in y."""
    return (x >= x0) & (x < x1) & (y >= y0) & (y <= y1)


def in_closed_window(x: Column, y: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Closed on all sides."""
    return x.between(x0, x1) & y.between(y0, y1)


def in_plot(x: Column, y: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Closed, with one point of room at the right and two at the bottom."""
    return (x >= x0) & (x <= x1 + 1.0) & (y >= y0) & (y <= y1 + 2.0)


def pixel_to_data(x: Column, y: Column, left, right, top, bottom, x_max: float, y_max: float) -> tuple[Column, Column]:
    """Pixel position to axis values (y grows downward), clipped to the axes; 0 for an empty box."""
    w, h = right - left, bottom - top
    t = F.when(w == 0, F.lit(0.0)).otherwise(clip((x - left) / w * x_max, F.lit(0.0), F.lit(x_max)))
    v = F.when(h == 0, F.lit(0.0)).otherwise(clip((bottom - y) / h * y_max, F.lit(0.0), F.lit(y_max)))
    return rounded(t, 4), rounded(v, 4)


def accuracy_pct(median_error: Column, top: Column, bottom: Column) -> Column:
    """Share of the axis that the median error leaves; a missing or zero top is the default top."""
    span = F.coalesce(F.when(top != 0, top), F.lit(DEFAULT_TOP)) - F.coalesce(bottom, F.lit(0.0))
    return F.when(span > 0, rounded(F.greatest(F.lit(0.0), F.lit(100.0) * (F.lit(1.0) - median_error / span)), 2))


def upper_median(x: Column) -> Column:
    """Aggregate: of the sorted values the one at half their number, not an average of two."""
    values = F.array_sort(F.collect_list(x))
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern's group meets first in a text; null where that is nothing. By ``nullif`` Spark matches once
    where ``when`` matches twice."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def either(a: Column, b: Column) -> Column:
    """``a``, or ``b`` where ``a`` is empty. ``a`` stands only where it is always worked out, so Spark shares it."""
    return F.concat(a, F.when(a == "", b).otherwise(F.lit("")))


#: Day, month and year, and hour, minute and seconds, as headers print them.
DMY, HMS = r"([0-9]{1,2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{2,4})", r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"


def iso_date(date: Column) -> Column:
    """Year-month-day of a date that ends a short text; two digits are a year of this century, an empty text is null."""
    padded = F.regexp_replace(F.regexp_replace(date, rf"(?s)^.*?{DMY}$", "$3-0$2-0$1"), "-0([0-9]{2})", "-$1")
    return F.nullif(F.regexp_replace(padded, "^([0-9]{2})-", "20$1-"), F.lit(""))


def header_fields(text: Column) -> dict[str, Column]:
    """Fields of a chart header: animal, date and time (also as printed), weight, farm and codes;
    null where absent. The patterns are fixed values: the labels and forms that reports print. Date and
    time are looked for once in the text, and taken apart in the few characters that are found."""
    sep = r"[:\s]*"
    date = iso_date(either(F.regexp_extract(text, rf"(?iU)data{sep}{DMY}", 0), F.regexp_extract(text, rf"\b{DMY}\b", 0)))
    time = either(F.regexp_extract(text, rf"(?iU)ora{sep}{HMS}", 0), F.regexp_extract(text, r"\b[0-9]{1,2}:[0-9]{2}\b", 0))
    clock = F.regexp_replace(F.nullif(F.regexp_extract(time, "[0-9].*$", 0), F.lit("")), "^([0-9]):", "0$1:")
    weight = F.replace(found(text, rf"(?iU)latte{sep}([0-9.,]+)\s*kg"), F.lit(","), F.lit("."))
    return {
        "animal_id": F.coalesce(found(text, rf"(?iU)animale{sep}([0-9]+)"), found(text, rf"(?iU)\bID{sep}([0-9]+)")),
        "date_iso": date,
        "date_printed": F.regexp_replace(date, "^(.*)-(.*)-(.*)$", "$3.$2.$1"),
        "time_hhmm": F.replace(F.substring(clock, 1, 5), F.lit(":"), F.lit("")),
        "time_full": clock,
        "seconds": found(time, HMS, 3),
        "milk_kg": weight.try_cast("double"),
        "farm": found(text, r"(?iU)numero\s+azienda\s*(\w+)"),
        "gnr": found(text, rf"(?iU)GNR{sep}(\w+)"),
        "bimo": found(text, r"(?iU)BIMO\s*=\s*(\w+)"),
        "le": found(text, r"(?iU)LE\s*=\s*(\w+)"),
    }


def strict_fields(text: Column) -> dict[str, Column]:
    """Fields of a header as a report's own form prints them, for checking what ``header_fields``
    reads: dotted dates with four-digit years, times with seconds, no other labels; null where
    absent. The patterns are fixed values."""
    date = iso_date(F.regexp_extract(text, r"(?U)Data[:\s]*([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})", 0))
    return {
        "animal_id": found(text, r"(?U)Animale[:\s]*([0-9]+)"),
        "date_iso": date,
        "date_printed": F.regexp_replace(date, "^(.*)-(.*)-(.*)$", "$3.$2.$1"),
        "time_full": found(text, r"(?U)Ora[:\s]*([0-9]{2}:[0-9]{2}:[0-9]{2})"),
        "milk_kg": F.replace(found(text, r"(?iU)latte[:\s]*([0-9.,]+)\s*kg"), F.lit(","), F.lit(".")).try_cast("double"),
        "farm": found(text, r"(?U)Numero\s+Azienda\s*(\w+)"),
        "gnr": found(text, r"(?U)GNR[:\s]*(\w+)"),
        "bimo": found(text, r"(?U)BIMO\s*=\s*(\w+)"),
        "le": found(text, r"(?U)LE\s*=\s*(\w+)"),
    }
