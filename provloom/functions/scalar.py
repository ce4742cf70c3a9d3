"""Scalar functions: identity, paths, times, addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Windows variables that stand for a folder; fixed values.
WINDOWS_FOLDERS = {"%systemroot%": r"\windows", "%windir%": r"\windows", r"\systemroot": r"\windows", "%programfiles%": r"\program files"}


def uuid_of_hash(hexed: Column) -> Column:
    """A version 3 uuid from 32 hexadecimal digits: version nibble 3, variant bits 10."""
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(hexed, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.concat(F.lit("3"), F.substring(hexed, 14, 3)), F.concat(variant, F.substring(hexed, 18, 3)), F.substring(hexed, 21, 12))


def name_uuid(text: Column) -> Column:
    """The name-based uuid of a string: its MD5, of UTF-8 bytes, as version 3."""
    return uuid_of_hash(F.md5(text.cast("binary")))


def list_uuid(uuids: Column) -> Column:
    """The name-based uuid of uuids in sorted order: the MD5 of their bytes, the later eight of each before the first eight."""
    def swapped(u: Column) -> Column:
        bare = F.regexp_replace(u, "-", "")
        return F.concat(F.substring(bare, 17, 16), F.substring(bare, 1, 16))

    return uuid_of_hash(F.md5(F.unhex(F.array_join(F.transform(F.array_sort(uuids), swapped), ""))))


def rendered(namespace: Column, uuid: Column, raw: bool = False) -> Column:
    """ns_uuid, with cdm_ before it for raw records; an empty namespace leaves it out."""
    parts = F.array_compact(F.array(F.lit("cdm") if raw else F.lit(None).cast("string"), F.when(namespace != "", namespace), uuid))
    return F.array_join(parts, "_")


def from_rendered(text: Column) -> Column:
    """(namespace, uuid): the last 36 characters are the uuid."""
    head = F.regexp_replace(F.substring(text, F.lit(1), F.greatest(F.length(text) - 36, F.lit(0))), "^cdm_|_$", "")
    return F.struct(F.regexp_replace(head, "^cdm$", "").alias("namespace"), F.right(text, F.lit(36)).alias("uuid"))


def nanos_of(time: Column) -> Column:
    """Nanoseconds of a time stamp in seconds, milli-, micro- or nanoseconds, told apart by range; others are as they are.

    Between 1e9 and 1e10 it counts seconds, then a thousand times as much for each unit.
    """
    found = time
    for low, factor in ((10**15, 10**3), (10**12, 10**6), (10**9, 10**9)):
        found = F.when((time >= low) & (time < low * 10), time * F.lit(factor).cast("long")).otherwise(found)
    return found


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null if it is no dotted quad of 0 to 255."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"\A(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\z")
    return F.when(ok, F.aggregate(F.transform(parts, lambda p: F.try_to_number(p, F.lit("999")).cast("long")), F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def in_cidr(ip: Column, cidr: str) -> Column:
    """Whether an address is in a range like 10.0.0.0/8; null for no address."""
    base, bits = cidr.split("/")
    number = sum(int(p) << s for p, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
    shift = 32 - int(bits)
    return F.shiftright(ipv4_number(ip), shift) == (number >> shift)


def _cut(path: Column) -> Column:
    """Up to the first white space that is neither quoted nor escaped."""
    return F.regexp_extract(path, r"""\A(?:\\.|"[^"]*"?|'[^']*'?|[^\s"'\\])*""", 0)


def normalized_path(path: Column, windows: bool = False) -> Column:
    """A path in its plain form, or null.

    Trimmed; empty and unknown ones are null. The arguments after the first unquoted white space go (for Windows, what
    follows a leading quoted part), outer quotes go; Windows paths are lower-cased, their variables are expanded and drive and device
    prefixes go. Empty and . parts go, .. takes the part before away; a path from the root that leaves it is null, and so is an
    empty relative one.
    """
    text = F.trim(path)
    known = F.when((text != "") & ~F.lower(text).isin("<unknown>", "unknown"), text)
    if windows:
        quoted = F.regexp_extract(known, r'\A"([^"]*)"', 1)
        bare = F.lower(F.when(quoted != "", quoted).otherwise(known))
        for name, folder in WINDOWS_FOLDERS.items():
            bare = F.replace(bare, F.lit(name), F.lit(folder))
        bare, sep = F.regexp_replace(bare, r"\A(?:c:|\\device\\harddiskvolume1)", ""), "\\"
    else:
        bare, sep = F.regexp_replace(_cut(known), r"""\A["'](.*)["']\z""", "$1"), "/"
    root = F.startswith(bare, F.lit(sep))
    parts = F.filter(F.split(bare, re.escape(sep)), lambda p: (p != "") & (p != "."))

    def step(a: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(a["kept"]) > 0) & (F.coalesce(F.try_element_at(a["kept"], F.lit(-1)), F.lit("")) != "..")
        kept = F.when(up, F.slice(a["kept"], 1, F.greatest(F.size(a["kept"]) - 1, F.lit(0)))).otherwise(F.concat(a["kept"], F.array(p)))
        return F.struct(kept.alias("kept"))

    kept = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("kept")), step, lambda a: a["kept"])
    left_root = root & (F.get(kept, F.lit(0)) == "..")
    return F.when(bare.isNull() | F.coalesce(left_root, F.lit(False)), F.lit(None).cast("string")).when(root, F.concat(F.lit(sep), F.array_join(kept, sep))).when(F.size(kept) > 0, F.array_join(kept, sep))


def keyword_match(text: Column, words: list[str]) -> Column:
    """Whether any word contains the text or is contained in it, whatever the case."""
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w) | F.contains(w, low))


def in_day(seconds: Column, day: int, slack: int = 86_400) -> Column:
    """Within a day of the day's start; a zero time is on every day."""
    return (seconds == 0) | F.abs(seconds - day).between(0, slack)


def at_night(seconds: Column, start: int, first: int = 20, last: int = 6) -> Column:
    """Whether the hour, counted from a start, is in the night."""
    hour = F.pmod(F.floor((seconds - start) / 3600), F.lit(24))
    return (hour >= first) | (hour < last)


def at_weekend(seconds: Column) -> Column:
    """Whether the day, counted from the first of 1970, a Thursday, is a Saturday or a Sunday."""
    return F.pmod(F.floor(seconds / 86_400) + 3, F.lit(7)) >= 5
