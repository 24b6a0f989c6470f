"""Device files in the public FIT protocol: messages, and sessions, laps, readings, events and devices as rows.

The layout (headers, definitions, base types) and the numbers and scales of the fields are those of the
published protocol and profile. A file is one small binary; files are decoded in parallel, each in one
pass.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = datetime(1989, 12, 31)
#: Base types: number, letter of its layout, value that stands for none. Fixed values.
BASE_TYPES = {
    0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF),
    0x07: ("s", None), 0x88: ("f", None), 0x89: ("d", None), 0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0), 0x0D: ("B", 0xFF), 0x8E: ("q", 2**63 - 1),
    0x8F: ("Q", 2**64 - 1), 0x90: ("Q", 0),
}
#: Messages by number, and their fields: ``number name[/scale[-offset]]``; times end in ``@``. Fixed values.
MESSAGES = {
    0: ("file_id", "0 type;1 manufacturer;2 product;3 serial_number;4 time_created@;8 product_name"),
    7: ("zones_target", "1 max_heart_rate;2 threshold_heart_rate;3 functional_threshold_power"),
    8: ("hr_zone", "254 message_index;1 high_bpm;2 name"),
    9: ("power_zone", "254 message_index;1 high_value;2 name"),
    18: ("session", "253 timestamp@;2 start_time@;3 start_position_lat;4 start_position_long;5 sport;6 sub_sport;7 total_elapsed_time/1000;8 total_timer_time/1000;"
         "9 total_distance/100;11 total_calories;14 avg_speed/1000;15 max_speed/1000;16 avg_heart_rate;17 max_heart_rate;18 avg_cadence;19 max_cadence;20 avg_power;"
         "21 max_power;22 total_ascent;23 total_descent;24 total_training_effect/10;26 num_laps;34 normalized_power;35 training_stress_score/10;"
         "36 intensity_factor/1000;37 left_right_balance;38 end_position_lat;39 end_position_long;45 threshold_power;48 total_work;49 avg_altitude/5-500;"
         "50 max_altitude/5-500;57 avg_temperature;58 max_temperature;64 min_heart_rate;71 min_altitude/5-500;92 avg_fractional_cadence/128;"
         "93 max_fractional_cadence/128;101 avg_left_torque_effectiveness/2;102 avg_right_torque_effectiveness/2;103 avg_left_pedal_smoothness/2;"
         "104 avg_right_pedal_smoothness/2;124 enhanced_avg_speed/1000;125 enhanced_max_speed/1000;137 total_anaerobic_training_effect/10;139 avg_vam/1000"),
    19: ("lap", "253 timestamp@;2 start_time@;7 total_elapsed_time/1000;8 total_timer_time/1000;9 total_distance/100;11 total_calories;13 avg_speed/1000;"
         "14 max_speed/1000;15 avg_heart_rate;16 max_heart_rate;17 avg_cadence;18 max_cadence;19 avg_power;20 max_power;21 total_ascent;22 total_descent;"
         "33 normalized_power;34 left_right_balance;41 total_work"),
    20: ("record", "253 timestamp@;0 position_lat;1 position_long;2 altitude/5-500;3 heart_rate;4 cadence;5 distance/100;6 speed/1000;7 power;9 grade/100;"
         "13 temperature;30 left_right_balance;31 gps_accuracy;33 calories;39 vertical_oscillation/10;40 stance_time_percent/100;41 stance_time/10;"
         "43 left_torque_effectiveness/2;44 right_torque_effectiveness/2;45 left_pedal_smoothness/2;46 right_pedal_smoothness/2;47 combined_pedal_smoothness/2;"
         "53 fractional_cadence/128;67 left_pco;68 right_pco;73 enhanced_speed/1000;78 enhanced_altitude/5-500;81 battery_soc/2;82 motor_power"),
    21: ("event", "253 timestamp@;0 event;1 event_type;3 data;4 event_group"),
    23: ("device_info", "253 timestamp@;0 device_index;1 device_type;2 manufacturer;3 serial_number;4 product;5 software_version/100;6 hardware_version;27 product_name"),
    34: ("activity", "253 timestamp@;0 total_timer_time/1000;1 num_sessions;2 type;3 event;5 local_timestamp@"),
}


def _fields(text: str) -> dict[int, tuple[str, float, float, bool]]:
    out = {}
    for part in text.split(";"):
        number, name = part.split()
        name, _, scaled = name.partition("/")
        scale, _, offset = scaled.partition("-")
        out[int(number)] = (name.rstrip("@"), float(scale or 1), float(offset or 0), name.endswith("@"))
    return out


PROFILE = {number: (name, _fields(text)) for number, (name, text) in MESSAGES.items()}


def _value(raw: bytes, base: int, order: str):
    """The value of a field: null where it is the type's none, a list where it is an array."""
    letter, none = BASE_TYPES.get(base, ("B", 0xFF))
    if letter == "s":
        return raw.split(b"\0", 1)[0].decode("utf-8", "replace") or None
    size = struct.calcsize(letter)
    if not raw or len(raw) % size:
        return None
    values = [None if v == none or v != v else v for v in struct.unpack(f"{order}{len(raw) // size}{letter}", raw)]
    return values[0] if len(values) == 1 else (values if any(v is not None for v in values) else None)


def _read(name_scale: tuple[str, float, float, bool], value):
    _, scale, offset, is_time = name_scale
    if isinstance(value, list):
        return [None if v is None else _read(name_scale, v) for v in value]
    if value is None or isinstance(value, str):
        return value
    if is_time:
        return EPOCH + timedelta(seconds=value)
    return value / scale - offset if scale != 1 or offset else value


def messages(content: bytes) -> Iterator[tuple[str, dict]]:
    """(message, fields) of a file in order; messages and fields outside the profile are passed over, and
    developer fields skipped. Chained files follow one another. Raises ValueError where the content is no such file or ends
    early."""
    at = 0
    while at < len(content):
        if len(content) - at < 12 or content[at + 8 : at + 12] != b".FIT":
            raise ValueError("not a FIT file")
        size = content[at]
        end = at + size + struct.unpack_from("<I", content, at + 4)[0]
        if end > len(content):
            raise ValueError("FIT file ends early")
        yield from _data(content, at + size, end)
        at = end + 2  # past the checksum


def _data(content: bytes, at: int, end: int) -> Iterator[tuple[str, dict]]:
    kinds: dict[int, tuple[int, str, list[tuple[int, int, int]], int]] = {}
    last = None
    while at < end:
        head = content[at]
        at += 1
        if not head & 0x80 and head & 0x40:  # a definition
            order = ">" if content[at + 1] else "<"
            number, count = struct.unpack_from(f"{order}HB", content, at + 2)
            at += 5
            fields = [tuple(content[at + 3 * k : at + 3 * k + 3]) for k in range(count)]
            at += 3 * count
            extra = 0
            if head & 0x20:
                extra = sum(content[at + 1 + 3 * k + 1] for k in range(content[at]))
                at += 1 + 3 * content[at]
            kinds[head & 0x0F] = number, order, fields, extra
            continue
        local = head >> 5 & 0x03 if head & 0x80 else head & 0x0F
        if local not in kinds:
            raise ValueError("FIT data without a definition")
        number, order, fields, extra = kinds[local]
        if at + sum(f[1] for f in fields) + extra > end:
            raise ValueError("FIT file ends early")
        name, known = PROFILE.get(number, (None, {}))
        row = {}
        for field, size, base in fields:
            if field in known or field == 253:
                value = _value(content[at : at + size], base, order)
                if field == 253 and isinstance(value, int):
                    last = value
                if field in known:
                    row[known[field][0]] = _read(known[field], value)
            at += size
        at += extra
        if head & 0x80 and last is not None:  # a time of five bits counted from the last one
            last += (head & 0x1F) - last & 0x1F
            row["timestamp"] = EPOCH + timedelta(seconds=last)
        if name:
            yield name, row


def first_in_zip(content: bytes) -> bytes:
    """The first FIT file of an archive; content that is no archive stays as it is."""
    if content[:2] != b"PK":
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if name.lower().endswith(".fit"):
                return z.read(name)
    raise ValueError("no FIT file in the archive")


ROWS = "file_name string, activity_id string, error string, message string, n int, fields string"


def read_fit(spark: SparkSession, folder: str, pattern: str = "*.{fit,zip}") -> DataFrame:
    """(file_name, activity_id, error, message, n, fields): every message of every file (or of the first
    FIT file in an archive), in order, fields as JSON. A file that cannot be read to its end gives what was read and a row with its error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["file_name"], pdf["content"], strict=True):
                who, out = name.split("_")[0].split(".")[0], []
                try:
                    for n, (kind, row) in enumerate(messages(first_in_zip(bytes(content)))):
                        out.append((name, who, None, kind, n, json.dumps({k: v for k, v in row.items() if v is not None}, default=lambda t: t.isoformat() + "Z")))
                except Exception as e:  # noqa: BLE001
                    out.append((name, who, str(e) or type(e).__name__, None, len(out), None))
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    binary = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = binary.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    return named.mapInPandas(rows, ROWS)


def _columns(message: str) -> str:
    kinds = {"timestamp": "timestamp", "start_time": "timestamp", "product_name": "string", "name": "string"}
    return ", ".join(f"{name} {kinds.get(name, 'double')}" for name, _, _, _ in next(f for m, f in PROFILE.values() if m == message).values())


def of_message(decoded: DataFrame, message: str) -> DataFrame:
    """(file_name, activity_id, n, its fields) of one kind of message; absent fields are null."""
    rows = decoded.where(F.col("message") == message).select("file_name", "activity_id", "n", F.from_json("fields", _columns(message)).alias("x"))
    return rows.select("file_name", "activity_id", "n", "x.*")


def sessions(decoded: DataFrame) -> DataFrame:
    """One row per file: its session's fields, device_* of its first device with a maker, lap1_* of its
    first lap, num_laps and the numbers of readings and events, and its error if any."""
    first = lambda message, keep: of_message(decoded, message).where(keep).groupBy("file_name")
    session = first("session", "true")
    s_names = [c for c in of_message(decoded, "session").columns if c not in ("file_name", "activity_id", "n")]
    session = session.agg(F.max_by(F.struct(*s_names), "n").alias("s"))
    d_names = ("manufacturer", "product", "product_name", "serial_number", "software_version")
    device = first("device_info", "manufacturer is not null or serial_number is not null").agg(F.min_by(F.struct(*d_names), "n").alias("d"))
    l_names = ("total_elapsed_time", "total_distance", "avg_power", "avg_heart_rate", "avg_cadence")
    lap = first("lap", "true").agg(F.min_by(F.struct(*l_names), "n").alias("l"))
    of = lambda message: F.count_if(F.col("message") == message)
    files = decoded.groupBy("file_name", "activity_id").agg(
        F.max("error").alias("fit_parse_error"), of("record").alias("data_points"), of("lap").alias("num_laps"), of("event").alias("num_events")
    )
    joined = files.join(session, "file_name", "left").join(device, "file_name", "left").join(lap, "file_name", "left")
    return joined.select(
        "file_name", "activity_id", "fit_parse_error", "data_points", "num_laps", "num_events", *[F.col(f"s.{c}") for c in s_names if c != "num_laps"],
        *[F.col(f"d.{c}").alias(f"device_{c}") for c in d_names], *[F.col(f"l.{c}").alias(f"lap1_{c}") for c in l_names],
    )
