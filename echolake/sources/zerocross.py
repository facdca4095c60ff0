"""Zero-crossing interval files: header fields and interval rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

BATCH_DOTS = 100_000
# Smallest header, file types, plausible clock range, and the status code of switched-off dots.
HEADER_BYTES, FILE_TYPES, CLOCK_RANGE, STATUS_OFF = 281, range(129, 133), (10_000, 60_000), 1


def read_info(raw: bytes) -> tuple[int, int, int]:
    """(data offset, clock resolution, division ratio); raises ValueError on implausible files."""
    if len(raw) < HEADER_BYTES:
        raise ValueError("file too small")
    at = struct.unpack_from("<H", raw)[0]
    if raw[3] not in FILE_TYPES:
        raise ValueError(f"unsupported file type {raw[3]}")
    if at < HEADER_BYTES or at + 6 > len(raw):
        raise ValueError("info pointer out of range")
    data, clock, ratio = struct.unpack_from("<HHB", raw, at)
    if not CLOCK_RANGE[0] <= clock <= CLOCK_RANGE[1]:
        raise ValueError(f"implausible clock {clock}")
    if ratio == 0 or not at + 6 <= data <= len(raw):
        raise ValueError("bad division ratio or data pointer")
    return data, clock, ratio


# Texts of the header by first and last byte; the block of type 132 with time stamp, id code, position and embedded metadata.
TEXTS = {"tape": (0x006, 0x00E), "date": (0x00E, 0x016), "location": (0x016, 0x03E), "species": (0x03E, 0x070), "spec": (0x070, 0x080),
         "note1": (0x080, 0x0C9), "note2": (0x0C9, 0x119)}
STAMPED_TYPE, STAMP, ID_CODE, POSITION, EMBEDDED, EMBEDDED_LEAST = 132, 0x120, (0x12A, 0x130), (0x130, 0x150), 0x150, 12
YEARS = (1990, 2200)


def fixed_text(raw: bytes) -> str:
    """A padded field up to its first zero; bytes that are no printable ASCII read as question marks."""
    return "".join(chr(b) if 32 <= b < 127 else "?" for b in raw.partition(b"\0")[0]).strip()


def time_stamp(raw: bytes) -> tuple[str, int] | None:
    """Seconds as text and microseconds on top of them (hundredths may pass a second); None for an implausible date."""
    year, month, day, hour, minute, second, hundredths, micros = struct.unpack_from("<HBBBBBBH", raw, STAMP)
    if not (YEARS[0] <= year <= YEARS[1] and 1 <= month <= 12 and 1 <= day <= 31):
        return None
    return f"{year:04}-{month:02}-{day:02} {hour:02}:{minute:02}:{second:02}", hundredths * 10_000 + micros


def embedded_pairs(raw: bytes) -> list[dict[str, str]]:
    """Lines of keys and values; a block that is not UTF-8 has none."""
    try:
        lines = raw.rstrip(b"\0").decode().split("\n")
    except UnicodeDecodeError:
        return []
    pairs = (line.partition(":") for line in lines)
    return [{"key": key.strip(), "value": value.strip()} for key, mark, value in pairs if mark]


def read_record(raw: bytes) -> dict:
    """All header fields of a file; raises ValueError on implausible ones."""
    data, clock, ratio = read_info(raw)
    out = {name: fixed_text(raw[a:b]) for name, (a, b) in TEXTS.items()}
    out |= {"file_type": raw[3], "clock": clock, "ratio": ratio, "sensitivity": raw[struct.unpack_from("<H", raw)[0] + 5]}
    if raw[3] >= STAMPED_TYPE and len(raw) >= EMBEDDED:
        out["recorded"], out["recorded_micros"] = time_stamp(raw) or (None, None)
        out["id_code"], out["position"] = (fixed_text(raw[a:b]) for a, b in (ID_CODE, POSITION))
        if data > EMBEDDED + EMBEDDED_LEAST:
            out["metadata"] = embedded_pairs(raw[EMBEDDED:data])
    return out


HEADER_SCHEMA = ("path string, " + ", ".join(f"{name} string" for name in TEXTS) + ", file_type int, clock int, ratio int, sensitivity int, recorded string, "
                 "recorded_micros bigint, id_code string, position string, metadata array<struct<key: string, value: string>>, error string")


def header_rows(files: DataFrame) -> DataFrame:
    """One row of header fields per binary row(path, content); fields of type 132 are null in older types, a bad file gives its error."""
    names = [part.name for part in StructType.fromDDL(HEADER_SCHEMA)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append({"path": path, **read_record(bytes(raw))})
                except ValueError as e:
                    rows.append({"path": path, "error": str(e)})
            yield pd.DataFrame([[row.get(name) for name in names] for row in rows], columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, HEADER_SCHEMA)


def intervals(data: bytes) -> tuple[list[int], list[bool]]:
    """Intervals in clock microseconds and the switched-off flag per dot.

    A byte below 0x80 is a signed 7-bit change of the last interval; 0x80, 0xA0 and 0xC0 open absolute values of two,
    three and four bytes; 0xE0 and above set a status for the next dots.
    """
    ticks: list[int] = []
    off: list[tuple[int, int]] = []
    last = i = 0
    while i < len(data):
        lead = data[i]
        if lead < 0x80:
            last = max(last + (lead - 128 if lead > 63 else lead), 0)
            ticks.append(last)
            i += 1
            continue
        width = (lead - 0x80) // 0x20 + 2 if lead < 0xE0 else 2
        if i + width > len(data):
            break
        if lead >= 0xE0:
            if lead & 0x1F == STATUS_OFF:
                off.append((len(ticks), data[i + 1]))
        else:
            last = int.from_bytes(bytes([lead & 0x1F]) + data[i + 1:i + width], "big")
            ticks.append(last)
        i += width
    flags = [False] * len(ticks)
    for start, count in off:
        flags[start:start + count] = [True] * len(flags[start:start + count])
    return ticks, flags


def absolute(ticks: int) -> bytes:
    """The code of an absolute interval, in two, three or four bytes."""
    for extra, lead in ((1, 0x80), (2, 0xA0), (3, 0xC0)):
        if 0 <= ticks < 0x20 << 8 * extra:
            return (lead << 8 * extra | ticks).to_bytes(extra + 1, "big")
    raise ValueError(f"an interval of {ticks} has no code")


SCHEMA = "path string, idx bigint, ticks bigint, is_off boolean, clock int, ratio int, error string"


def interval_rows(files: DataFrame) -> DataFrame:
    """Rows (path, idx, ticks, is_off, clock, ratio) of binary rows(path, content); a bad file gives one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    data, clock, ratio = read_info(bytes(raw))
                    ticks, flags = intervals(bytes(raw[data:]))
                    for a in range(0, max(len(ticks), 1), BATCH_DOTS):
                        part = ticks[a:a + BATCH_DOTS]
                        yield pd.DataFrame({"path": path, "idx": range(a, a + len(part)), "ticks": part, "is_off": flags[a:a + BATCH_DOTS],
                                            "clock": clock, "ratio": ratio, "error": None})
                except ValueError as e:
                    yield pd.DataFrame({"path": [path], "idx": [0], "ticks": [None], "is_off": [None], "clock": [None], "ratio": [None], "error": [str(e)]})

    return files.select("path", "content").mapInPandas(run, SCHEMA)
