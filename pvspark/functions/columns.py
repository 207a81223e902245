"""Scalar functions of the archive, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the stored codes, by code.
SEVERITIES = ("NO_ALARM", "MINOR", "MAJOR", "INVALID", "UNDEFINED")
STATUSES = ("NO_STATUS", "DEVICE", "DRIVER", "RECORD", "DB", "CONF", "UNDEFINED", "CLIENT")
REASONS = ("ValueChanged", "Heartbeat", "Initial", "Disconnected", "Reconnected", "AlarmChange", "ArrayChanged", "TableChanged", "ImageFrame", "CustomChanged", "Timeout")
# Scalar types with their widths in bytes.
WIDTHS = {"boolean": 1, "byte": 1, "ubyte": 1, "short": 2, "ushort": 2, "int": 4, "uint": 4, "long": 8, "ulong": 8, "float": 4, "double": 8}


def named(code: Column, names: tuple[str, ...], otherwise: str = "UNDEFINED") -> Column:
    """The name of a code; `otherwise` for codes outside the list and nulls."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), code.cast("int")), F.lit(otherwise))


def severity_name(code: Column) -> Column:
    return named(code, SEVERITIES)


def status_name(code: Column) -> Column:
    return named(code, STATUSES)


def reason_name(code: Column) -> Column:
    return named(code, REASONS)


def alarm_text(severity: Column, status: Column, message: Column) -> Column:
    """SEVERITY/STATUS, and the message where there is one."""
    head = F.concat(severity_name(severity), F.lit("/"), status_name(status))
    return F.when(F.coalesce(F.length(message), F.lit(0)) > 0, F.concat(head, F.lit(": "), message)).otherwise(head)


def to_micros(seconds: Column, nanos: Column) -> Column:
    """Time from seconds and nanoseconds since the epoch, cut to microseconds."""
    return F.timestamp_micros(seconds.cast("bigint") * 1_000_000 + F.floor(nanos.cast("bigint") / 1000)).cast("timestamp_ntz")


def total_nanos(seconds: Column, nanos: Column) -> Column:
    """Nanoseconds since the epoch, as DECIMAL(38,0): they do not fit a long for all seconds that do."""
    return (seconds.cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") + nanos.cast("decimal(10,0)")).cast("decimal(38,0)")


def is_epoch(seconds: Column, nanos: Column) -> Column:
    """Whether a time is the epoch itself, which stands for no time."""
    return (seconds == 0) & (nanos == 0)


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from start to end; 0 if end is earlier."""
    return F.greatest(F.lit(0).cast("long"), F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp")))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def as_double(kind: Column, text: Column) -> Column:
    """A typed scalar as double: numbers as they are, booleans 1 or 0, strings null."""
    return F.when(kind == "boolean", F.when(text == "true", 1.0).when(text == "false", 0.0)).when(kind.isin(*WIDTHS), text.try_cast("double"))


def as_long(value: Column) -> Column:
    """The whole part of a number, toward zero; null for what is no number or does not fit."""
    return F.when(~F.isnan(value), value).try_cast("bigint")


def as_text(kind: Column, text: Column) -> Column:
    """A typed scalar as text: true or false for booleans, digits without sign or zeros before them for integers, strings as they are."""
    whole = kind.isin("byte", "ubyte", "short", "ushort", "int", "uint", "long", "ulong")
    return F.when(kind == "boolean", F.lower(text)).when(whole, text.try_cast("decimal(20,0)").cast("string")).otherwise(text)


def type_class(kind: Column) -> Column:
    """STRUCT<is_integer, is_floating, is_unsigned, exact_in_double, bytes> of a scalar type's name."""
    integer = kind.isin("byte", "ubyte", "short", "ushort", "int", "uint", "long", "ulong")
    floating = kind.isin("float", "double")
    width = F.create_map(*(F.lit(x) for pair in WIDTHS.items() for x in pair))[kind]
    return F.struct(
        integer.alias("is_integer"), floating.alias("is_floating"), kind.isin("ubyte", "ushort", "uint", "ulong").alias("is_unsigned"),
        ((integer & (width < 8)) | floating | (kind == "boolean")).alias("exact_in_double"), F.coalesce(width, F.lit(0)).alias("bytes"),
    )


def enum_label(index: Column, choices: Column) -> Column:
    """The choice at an index; null outside the list."""
    return F.get(choices, index.cast("int"))


def enum_index(label: Column, choices: Column) -> Column:
    """The first index of a choice; null if there is none."""
    at = F.array_position(choices, label)
    return F.when(at > 0, (at - 1).cast("int"))


def enum_text(index: Column, choices: Column) -> Column:
    """label(index), with the bare index where it has no label."""
    return F.coalesce(F.concat(enum_label(index, choices), F.lit("("), index.cast("string"), F.lit(")")), index.cast("string"))


def alert_rank(level: Column) -> Column:
    """0 info, 1 warning, 2 critical; unknown levels count as warning."""
    return F.when(level == "info", 0).when(level == "critical", 2).otherwise(1)


def alert_category(category: Column) -> Column:
    """The category of an alert; unknown ones and nulls count as system."""
    return F.when(category.isin("pv", "ioc", "shard", "system"), category).otherwise("system")


def device_flags(state: Column) -> Column:
    """STRUCT<reachable, healthy> of a device's liveness: reachable unless offline, healthy when online."""
    return F.struct((state != "offline").alias("reachable"), (state == "online").alias("healthy"))


def array_info(kind: Column, values: Column) -> Column:
    """STRUCT<elem_type, n, bytes, numeric> of an array of scalars of a kind; strings have no fixed bytes."""
    width = F.coalesce(F.create_map(*(F.lit(x) for pair in WIDTHS.items() for x in pair))[kind], F.lit(0))
    n = F.coalesce(F.size(values), F.lit(0)).cast("long")
    return F.struct(kind.alias("elem_type"), n.alias("n"), (n * width).cast("long").alias("bytes"), (kind != "string").alias("numeric"))


def matrix_shape(values: Column, dim: Column) -> Column:
    """STRUCT<n_rows, n_columns>: the first two dimensions; of one dimension, or none, a single row."""
    n = F.coalesce(F.size(dim), F.lit(0))
    columns = F.when(n >= 2, F.get(dim, 1)).when(n == 1, F.get(dim, 0)).otherwise(F.size(values))
    return F.struct(F.when(n >= 2, F.get(dim, 0)).otherwise(1).cast("int").alias("n_rows"), columns.cast("int").alias("n_columns"))


def continuum_shape(base: Column, values: Column) -> Column:
    """STRUCT<points, traces>: the base's length, and how many values there are for each of its points."""
    n = F.coalesce(F.size(base), F.lit(0))
    return F.struct(n.alias("points"), F.when(n > 0, F.floor(F.size(values) / n)).otherwise(0).cast("int").alias("traces"))


def table_shape(columns: Column) -> Column:
    """STRUCT<n_rows, n_columns> of an array of columns: the first column's length, 0 without columns."""
    return F.struct(F.coalesce(F.size(F.get(columns, 0)), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.size(columns), F.lit(0)).alias("n_columns"))


def array_l2(a: Column, b: Column) -> Column:
    """Euclidean distance; null if the lengths differ."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(square))


def matrix_cell(values: Column, columns: Column, row: Column, column: Column) -> Column:
    """An element of a row-major matrix; null outside it."""
    return F.when((row >= 0) & (column >= 0) & (column < columns), F.get(values, (row * columns + column).cast("int")))


def continuum_cell(base: Column, values: Column, point: Column, trace: Column) -> Column:
    """The value of a trace at a point; the number of traces is len(values) / len(base)."""
    traces = F.when(F.size(base) > 0, F.floor(F.size(values) / F.size(base)).cast("int")).otherwise(0)
    return F.when((trace >= 0) & (trace < traces) & (point >= 0) & (point < F.size(base)), F.get(values, (point * traces + trace).cast("int")))


def normalize_heartbeat(seconds: Column) -> Column:
    """Null where off (0 or less), one second at least otherwise."""
    return F.when(seconds > 0, F.greatest(F.lit(1.0), seconds))


def normalize_address(text: Column) -> Column:
    """STRUCT<address, error>: a trimmed IPv4 address with its port (5075 if none) or a bracketed IPv6 one; an error for anything else."""
    t = F.trim(text)
    v4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?::(\d{1,5}))?$"
    octets = [F.regexp_extract(t, v4, k).try_cast("int") <= 255 for k in range(1, 5)]
    port = F.coalesce(F.regexp_extract(t, v4, 5).try_cast("int"), F.lit(5075))
    good4 = t.rlike(v4) & octets[0] & octets[1] & octets[2] & octets[3] & port.between(1, 65535)
    v6 = r"^\[[0-9A-Fa-f:.]+\]:(\d{1,5})$"
    good6 = t.rlike(v6) & F.coalesce(F.regexp_extract(t, v6, 1).try_cast("int").between(1, 65535), F.lit(False))
    address = F.when(good4, F.concat(F.regexp_extract(t, r"^[^:]+", 0), F.lit(":"), port.cast("string"))).when(good6, t)
    error = F.when(F.coalesce(t, F.lit("")) == "", "empty").when(t.rlike(r"\s"), "white space").when(t.endswith(":"), "trailing colon").when(address.isNull(), "not an address")
    return F.struct(F.when(error.isNull(), address).alias("address"), error.alias("error"))


def tier_of(start: Column, end: Column) -> Column:
    """raw for spans up to 6 hours, hourly up to 7 days, daily beyond."""
    span = seconds_between(start, end)
    return F.when(span <= 6 * 3600, "raw").when(span <= 7 * 86400, "hourly").otherwise("daily")


def ioc_state(declared: Column, enabled: Column, total: Column, live: Column, lost: Column, gone: Column) -> Column:
    """A device's state from the counts of its signals."""
    return (
        F.when(declared & ~enabled, "DISABLED")
        .when((total == 0) | (gone == total), "IDLE")
        .when((live == 0) & (lost > 0), "DOWN")
        .when(live == 0, "CONNECTING")
        .when(lost > 0, "DEGRADED")
        .otherwise("UP")
    )


def health_score(state: Column, subscribed: Column, connected: Column, last_event: Column, now: Column) -> Column:
    """Share of the time connected, lowered when the last event is old, for archiving signals; fixed values for the other states."""
    age = seconds_between(last_event, now)
    uptime = F.least(F.lit(1.0), seconds_between(F.coalesce(connected, subscribed), now) / F.greatest(F.lit(1.0), seconds_between(subscribed, now)))
    return F.when(state == 3, uptime * F.when(age < 60, 1.0).when(age < 300, 0.5).otherwise(0.1)).when(state == 4, 0.0).when(state == 5, 0.1).otherwise(0.5)


def value_alarm(value: Column, active: Column, lolo: Column, low: Column, high: Column, hihi: Column) -> Column:
    """Severity from thresholds, in this order: lolo, low, hihi, high."""
    return F.when(~active, 0).when(value <= lolo, 2).when(value <= low, 1).when(value >= hihi, 2).when(value >= high, 1).otherwise(0)


def in_control_range(value: Column, low: Column, high: Column) -> Column:
    """Whether a value is in its range; always true where low is not below high."""
    return F.when(low < high, value.between(low, high)).otherwise(True)


def reason_class(reason: Column) -> Column:
    return F.when(reason.isin(2, 3, 4, 10), "connectivity").when(reason.isin(0, 6, 7, 8, 9), "value").otherwise("other")


def non_finite(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf"))


def like_pattern(text: str, escape: bool) -> str:
    """A case-insensitive substring pattern; with `escape` the wildcards of the text are ordinary characters."""
    text = text.strip() if escape else text
    for c in "\\%_" if escape else "":
        text = text.replace(c, "\\" + c)
    return f"%{text}%"
