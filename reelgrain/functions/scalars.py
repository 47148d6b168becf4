"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\A\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"
#: The usual frame rates.
FRAME_RATES = (23.976, 24.0, 25.0, 29.97, 30.0, 50.0, 59.94, 60.0)


def number(text: Column) -> Column:
    """A finite number that the text spells in full, else null."""
    x = F.when(text.rlike(NUMBER), F.btrim(text).try_cast("double"))
    return F.when(F.abs(x) != float("inf"), x)


def number_kind(text: Column) -> Column:
    """numeric, missing, invalid_numeric (it has digits but is no number) or not_numeric."""
    t = F.lower(F.btrim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin("", "null", "none", "nan", "na", "n/a"), "missing").when(number(text).isNotNull(), "numeric").when(t.rlike(r"[0-9]|\A[+-]?inf(inity)?\z"), "invalid_numeric").otherwise("not_numeric")


def whole_number(text: Column) -> Column:
    x = number(text)
    return F.when(x == F.floor(x), x).cast("bigint")


def truth(text: Column) -> Column:
    t = F.lower(F.btrim(text))
    return F.when(t == "true", True).when(t == "false", False)


def safe_name(text: Column, default: str = "video") -> Column:
    """Other than letters, digits, . _ - become one _; none of ._- at the ends."""
    x = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)\z", 1))


def human_size(size: Column) -> Column:
    """Bytes in the greatest binary unit that keeps one or more of it."""
    x, out = size.cast("double"), F.format_string("%d B", size.cast("bigint"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(x >= 1024.0**power, F.format_string(f"%.2f {unit}", x / 1024.0**power)).otherwise(out)
    return F.when(size.isNotNull(), out)


def human_duration(seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), F.format_string("%.2f seconds", seconds.cast("double")))


def human_bit_rate(rate: Column) -> Column:
    x = rate.cast("double")
    shown = F.when(x >= 1e6, F.format_string("%.2f Mbps", x / 1e6)).when(x >= 1e3, F.format_string("%.2f Kbps", x / 1e3)).otherwise(F.format_string("%.0f bps", x))
    return F.when(x.isNotNull(), shown)


def half_even(x: Column, digits: int) -> Column:
    """Rounded to so many decimals; a tie goes to the even digit."""
    return F.bround(x, digits)


def container_family(name: Column) -> Column:
    """The usual name of a list of format names."""
    parts = F.transform(F.split(name, ","), lambda x: F.btrim(x))
    has = lambda *words: F.arrays_overlap(parts, F.array(*map(F.lit, words)))
    return F.when(has("mov", "mp4"), "MP4/MOV family").when(has("matroska", "webm"), "Matroska/WebM family").when(has("avi"), "AVI").otherwise(name)


def codec_level(level: Column) -> Column:
    """41 is level 4.1; values that are no tenths stay as they are."""
    return F.when(level.between(10, 999), F.format_string("%.1f", level / 10.0)).otherwise(level.cast("string"))


def orientation(width: Column, height: Column) -> Column:
    return F.when(width > height, "landscape").when(height > width, "portrait").when(width == height, "square")


def display_size(width: Column, height: Column, turned: Column) -> Column:
    """Width and height as shown: swapped for a quarter turn."""
    quarter = F.coalesce(turned.isin(90, 270), F.lit(False))
    return F.struct(F.when(quarter, height).otherwise(width).alias("width"), F.when(quarter, width).otherwise(height).alias("height"))


def stream_rotation(tag: Column, side_data: Column) -> Column:
    """Degrees of a stream: its rotate tag, else the first entry of its side data (structs rotation, displaymatrix_rotation) that has any."""
    entry = F.transform(side_data, lambda x: F.coalesce(x["rotation"].try_cast("bigint"), F.bround(x["displaymatrix_rotation"].try_cast("double"), 0).cast("bigint")))
    return rotation(F.coalesce(tag.try_cast("bigint"), F.get(F.filter(entry, lambda x: x.isNotNull()), F.lit(0))))


def short_message(text: Column, most: int = 500) -> Column:
    """One line of at most so many characters."""
    return F.substring(F.btrim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def is_version(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A\d+\.\d+\.\d+\z"), F.lit(False))


def sample_name(label: Column, digest: Column) -> Column:
    """label-sha16, the usual id of a sample."""
    return F.concat(label, F.lit("-"), F.substring(digest, 1, 16))


def change_ratio(before: Column, after: Column, floor: float = 1e-9) -> Column:
    """increase and decrease of an energy, each at least 1 where it has that direction."""
    return F.struct((after / F.greatest(before, F.lit(floor))).alias("increase"), (before / F.greatest(after, F.lit(floor))).alias("decrease"))


def frame_rate(text: Column) -> Column:
    """`a/b` or a number, null where it is not positive."""
    parts = F.split(text, "/")
    x = F.when(F.size(parts) == 2, number(F.get(parts, F.lit(0))) / F.nullif(number(F.get(parts, F.lit(1))), F.lit(0.0))).otherwise(number(text))
    return F.when(x > 0, x)


def unusual_rate(rate: Column, tolerance: float = 0.05) -> Column:
    return rate.isNull() | F.forall(F.array(*map(F.lit, FRAME_RATES)), lambda r: F.abs(rate - r) > tolerance)


def rotation(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two texts of 16 hex digits."""
    half = lambda c, i: F.conv(F.substring(c, i, 8), 16, 10).cast("bigint")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t != "")


def region(text: Column) -> Column:
    """Row and column of region-rRR-cCC."""
    part = lambda i: F.regexp_extract(text, r"\Aregion-r([0-9]+)-c([0-9]+)\z", i).try_cast("int")
    return F.struct(part(1).alias("row"), part(2).alias("column"))


def neighbours(a: Column, b: Column) -> Column:
    return (F.abs(a["row"] - b["row"]) <= 1) & (F.abs(a["column"] - b["column"]) <= 1)


def capped_metrics(m: Column, cap: int = 8) -> Column:
    """A map without nulls, its first entries by key."""
    entries = F.array_sort(F.map_entries(F.map_filter(m, lambda _, v: v.isNotNull())))
    return F.map_from_entries(F.slice(entries, 1, cap))
