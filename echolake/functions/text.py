"""Names, dates, coordinates, licences and labels as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def stem(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"(?s)\.[^.]*$", "")


def extension(name: Column | str) -> Column:
    return F.element_at(F.split(_c(name), r"\."), -1)


def sanitize(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r'[<>:"/\\|?*]', "_")


def storage_key(filename: Column, size: Column, spot_hash: Column) -> Column:
    safe = F.regexp_replace(filename, r"[^\p{L}\p{N}._-]", "_")
    return F.when(spot_hash.isNotNull(), F.concat(F.lit("spot_"), spot_hash)).otherwise(F.concat(safe, F.lit("_"), size.cast("string")))


TRACK = r"(?s)^(.+)_(\d+-\d+|\d+|[cC][hH]\d+|[mM][iI][xX])(?: [^_]*)?$"


def track_group(name: Column | str) -> Column:
    """struct(key, label) where the last underscore part names a track (digits, a-b, ChN, MIX); null otherwise."""
    s = stem(name)
    return F.when(s.rlike(TRACK), F.struct(F.regexp_extract(s, TRACK, 1).alias("key"), F.regexp_extract(s, TRACK, 2).alias("label")))


def sequence_number(text: Column) -> Column:
    """struct(prefix, number) of names that end in an underscore and digits; null otherwise."""
    prefix, digits = F.regexp_extract(text, r"(?s)^(.+)_(\d+)$", 1), F.regexp_extract(text, r"(?s)^(.+)_(\d+)$", 2)
    number = digits.try_cast("long")
    return F.when((prefix != "") & number.isNotNull(), F.struct(prefix.alias("prefix"), number.alias("number")))


def utc_offset_minutes(stamp: Column | str) -> Column:
    """Offset written in a timestamp; bare dates have none, and implausible offsets are ignored."""
    v = F.trim(_c(stamp))
    tail = F.regexp_extract(v, r"(?s)^[^T ]*[T ](.*)$", 1)
    sign = F.regexp_extract(tail, r"(?s)^.*([+-])([^+-]*)$", 1)
    off = F.regexp_extract(tail, r"(?s)^.*([+-])([^+-]*)$", 2)
    h = F.regexp_extract(off, r"^(\d+)(?::\d+)?$", 1)
    colon = off.contains(":")
    hours = F.when(colon, F.regexp_extract(off, r"^(\d+):(\d+)$", 1)).when(F.length(off) == 4, F.substring(off, 1, 2)).when(F.length(off) == 2, h)
    minutes = F.when(colon, F.regexp_extract(off, r"^(\d+):(\d+)$", 2)).when(F.length(off) == 4, F.substring(off, 3, 2)).when(F.length(off) == 2, F.lit("0"))
    hh, mm = hours.try_cast("int"), minutes.try_cast("int")
    total = hh * 60 + mm
    return F.when(v.rlike("[zZ]$"), F.lit(0)).when((sign != "") & hh.between(0, 14) & mm.between(0, 59), F.when(sign == "-", -total).otherwise(total))


def timestamp_of(stamp: Column | str) -> Column:
    return F.try_to_timestamp(_c(stamp))


def recording_start(stamp: Column, last_modified: Column, duration_secs: Column, offset_secs: Column | None = None) -> Column:
    """struct(epoch_ms, source): the metadata timestamp, else modification time less duration."""
    meta = F.unix_millis(F.try_to_timestamp(stamp)).cast("double")
    fallback = F.unix_millis(last_modified) - duration_secs * 1000
    shift = (offset_secs if offset_secs is not None else F.lit(0.0)) * 1000
    return F.when(meta.isNotNull(), F.struct((meta + shift).alias("epoch_ms"), F.lit("metadata").alias("source"))).when(
        fallback.isNotNull(), F.struct((fallback + shift).alias("epoch_ms"), F.lit("file_modified").alias("source"))
    )


def date_in_name(name: Column | str) -> Column:
    """First plausible YYYYMMDD[HHMMSS] or YYYYMMDD<sep>HHMMSS run of digits in a name, as ISO text."""
    day = r"(19[9]\d|20\d\d|2100)(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])"
    clock = r"([01]\d|2[0-3])([0-5]\d)([0-5]\d)"
    name = _c(name)
    any_run = F.regexp_substr(name, F.lit(rf"(?<!\d){day}(?:[_\-T ]?{clock})?(?!\d)"))
    d = [F.regexp_extract(any_run, rf"^{day}", i) for i in (1, 2, 3)]
    t = [F.regexp_extract(any_run, rf"{clock}$", i) for i in (1, 2, 3)]
    date = F.concat_ws("-", *d)
    timed = F.length(F.regexp_replace(any_run, r"\D", "")) == 14
    return F.when(any_run.isNotNull() & (any_run != ""), F.when(timed, F.concat(date, F.lit("T"), F.concat_ws(":", *t))).otherwise(date))


def lat_lon(text: Column | str) -> Column:
    v = F.trim(_c(text))
    parts = F.when(v.contains(","), F.split(v, ",")).otherwise(F.split(v, r"\s+"))
    lat, lon = (F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in (0, 1))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def temperature_c(text: Column | str) -> Column:
    v = F.trim(_c(text))
    low = F.lower(v)
    number = F.regexp_extract(v, r"^([0-9.+-]+)", 1).try_cast("double")
    return F.when((v != "") & ~(low.contains("f") & ~low.contains("c")), number)


def clock_seconds(text: Column | str) -> Column:
    """Seconds of s, m:s or h:m:s."""
    parts = F.transform(F.split(_c(text), ":"), lambda p: F.trim(p).try_cast("double"))
    n = F.size(parts)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(n == 1, at(0)).when(n == 2, at(0) * 60 + at(1)).when(n == 3, at(0) * 3600 + at(1) * 60 + at(2))


def catalogue_number(text: Column | str, prefix: str = "XC") -> Column:
    """Number from digits, prefixed digits, or the last segment of an address."""
    v = F.trim(_c(text))
    digits = F.coalesce(_or_null(F.regexp_extract(v, r"^(\d+)$", 1)), _or_null(F.regexp_extract(v, rf"^(?:{prefix}|{prefix.lower()})(\d+)$", 1)),
                        _or_null(F.regexp_extract(v, r"^\w+://[^/]+/(?:.*/)?(\d+)/*$", 1)))
    return digits.try_cast("long")


def licence_label(text: Column | str) -> Column:
    v = _c(text)
    low = F.lower(v)
    tail = F.regexp_extract(v, r"(?i)creativecommons\.org/licenses/+([^/]*)", 1)
    version = F.regexp_extract(v, r"(?i)creativecommons\.org/licenses/+[^/]*/([^/]+)", 1)
    return F.when(low.contains("creativecommons.org/licenses/"), F.concat_ws(" ", F.lit("CC"), F.upper(tail), _or_null(version))).when(low.startswith("cc"), v)


# Display names of standard metadata keys.
KEY_NAMES = {
    "Loc|Lat": "Latitude", "Loc|Lon": "Longitude", "Loc|Elev": "Elevation", "Filter|HP": "High-pass Filter", "Filter|LP": "Low-pass Filter",
    "Species|Auto": "Species (Auto)", "Species|Manual": "Species (Manual)", "Loc Position": "GPS Position", "Loc Elevation": "Elevation",
    "Filter HP": "High-pass Filter (kHz)", "Filter LP": "Low-pass Filter (kHz)", "Species Auto ID": "Species (Auto)",
    "Species Manual ID": "Species (Manual)", "Temperature Int": "Internal Temp", "Temperature Ext": "External Temp", "Model": "Model",
    "Serial": "Serial", "Microphone": "Microphone", "TE": "Time Expansion", "Samplerate": "Sample Rate", "Length": "Length",
}


def key_category(key: Column | str) -> Column:
    """struct(section, name) of a metadata key: standard keys, else prefix and last part around the last bar."""
    k = _c(key)
    known = F.element_at(F.create_map(*[F.lit(x) for kv in KEY_NAMES.items() for x in kv]), k)
    cut = k.contains("|")
    section = F.regexp_replace(F.regexp_extract(k, r"(?s)^(.*)\|[^|]*$", 1), r"\|", " ")
    name = F.element_at(F.split(k, r"\|"), -1)
    std = F.lit("standard")
    return F.struct(F.when(known.isNull() & cut, section).otherwise(std).alias("section"), F.coalesce(known, F.when(cut, name).otherwise(k)).alias("name"))


_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.S)
_OPENER = re.compile(r"[{\[]")


def first_json(text: str) -> str | None:
    """The first balanced object or array, nested to any depth; brackets in strings do not count."""
    best, open_, at = None, [], 0
    while m := (_BRACKET if open_ else _OPENER).search(text, at):
        at, c = m.end(), m.group()
        if c in "{[":
            open_.append((c, m.start()))
        elif c in "}]" and open_[-1][0] == "{["["}]".index(c)]:
            start = open_.pop()[1]
            if not open_:
                return text[start:at]
            if best is None or start < best[0]:
                best = (start, at)
        elif len(c) == 1:  # no match can reach over a wrong bracket or an open quote
            if best:
                break
            open_ = []
    return text[best[0]:best[1]] if best else None


def embedded_json(text: Column | str) -> Column:
    """The first JSON object or array inside a text, or null."""


    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_json, na_action="ignore")

    return F.pandas_udf(run, "string")(_c(text))


def _tenths(x: Column) -> Column:
    """``x`` to one decimal, ties decided by the exact value of ten times x (kept as a sum and its rounding error)."""
    a, b = x * 8, x * 2
    s = a + b
    rest = s - a
    error = (a - (s - rest)) + (b - rest)
    base = F.floor(s)
    tie = (s - base) == 0.5
    return F.when(tie & (error > 0), base + 1.0).when(tie & (error < 0), base).otherwise(F.rint(s)) / 10


def compact_duration(seconds: Column | str) -> Column:
    """45.1s, 5m30s or 9h44m22s."""
    s = F.abs(_c(seconds))
    whole = F.round(s).cast("long")
    minutes, secs = F.floor(whole % 3600 / 60).cast("int"), (whole % 60).cast("int")
    long_ = F.format_string("%dh%02dm%02ds", F.floor(whole / 3600).cast("int"), minutes, secs)
    mid = F.format_string("%dm%02ds", F.floor(whole / 60).cast("int"), secs)
    return F.when(s < 90, F.format_string("%.1fs", _tenths(s))).when(s < 3600, mid).otherwise(long_)


def khz(hz: Column) -> Column:
    k = hz / 1000
    near = F.abs(k - F.round(k)) < 0.05
    return F.when(near, F.round(k).cast("long").cast("string")).otherwise(F.format_string("%.1f", _tenths(k)))


def frequency_range(lo: Column, hi: Column) -> Column:
    return F.when((lo == 0) & (hi == 0), F.lit("—")).otherwise(F.concat(khz(lo), F.lit("–"), khz(hi), F.lit(" kHz")))


def quality_rank(q: Column | str) -> Column:
    t = F.trim(_c(q))
    rank = F.lit(5)
    for i, name in reversed(list(enumerate("ABCDE"))):
        rank = F.when(t == name, i).otherwise(rank)
    return rank


def content_hashes(content: Column, data_offset: Column, data_size: Column, pieces: int = 16, piece: int = 1_000_000) -> Column:
    """struct(full, content, spot): whole bytes, audio bytes, and evenly spaced pieces hashed together."""
    size = F.octet_length(content)
    count = F.least(F.lit(pieces), F.greatest(F.ceil(size / piece), F.lit(1))).cast("int")
    step = F.when(count > 1, (size - piece) / (count - 1)).otherwise(0.0)
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.sha2(F.substr(content, (F.floor(i * step) + 1).cast("int"), F.lit(piece)), 256))
    return F.struct(
        F.sha2(content, 256).alias("full"), F.sha2(F.substr(content, (data_offset + 1).cast("int"), data_size.cast("int")), 256).alias("content"),
        F.sha2(F.concat_ws("", parts), 256).alias("spot"),
    )
