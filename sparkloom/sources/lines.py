"""Parsers of log lines: each gives a struct column, null where the line isn't of its format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.scoring import level_of_status

# The formats' patterns.
COMMON = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "(\S+) (\S+) ([^"]*)" (\d{3}) (\d+|-)'
AGENT = r'^ "([^"]*)" "([^"]*)"$'
COMBINED = COMMON + AGENT[1:]
RFC3164 = r"^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: (.*)$"
RFC5424 = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|\[.*\]) ?(.*)$"
JOURNAL = r"^([A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2}) (\S+) ([^:\[\s]+)\[(\d+)\]: (.*)$"
FACILITIES = 8
FIELDS = "struct<format string, ts string, host string, app string, level string, status int, bytes long, message string>"


#: Stands between the groups of a line while they are taken apart; in a line it counts as a space.
_BETWEEN = "\x1f"


def _parsed(line: Column, pattern: str, groups: int, build: Callable[[Callable[[int], Column]], Column]) -> Column:
    """build(group) for a line that fits a pattern: all groups by one replacement and one split, not an extraction each; a group
    that is empty is null."""
    joined = F.regexp_replace(F.translate(line, _BETWEEN, " "), pattern, _BETWEEN.join(f"${i}" for i in range(1, groups + 1)))
    each = F.transform(F.array(F.split(joined, _BETWEEN)), lambda g: build(lambda i: F.nullif(F.element_at(g, i), F.lit(""))))
    return F.when(line.rlike(pattern), F.element_at(each, 1))


def _dash(c: Column) -> Column:
    return F.nullif(c, F.lit("-"))


def _row(format_: str, **fields: Column) -> Column:
    kinds = {"ts": "string", "host": "string", "app": "string", "level": "string", "status": "int", "bytes": "long", "message": "string"}
    return F.struct(F.lit(format_).alias("format"), *(fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def access(line: Column) -> Column:
    """Common and combined access logs; the level follows from the class of the status."""

    def row(group: Callable[[int], Column]) -> Column:
        status = group(8).try_cast("int")
        ts = F.date_format(F.try_to_timestamp(group(4), F.lit("dd/MMM/yyyy:HH:mm:ss Z")), "yyyy-MM-dd'T'HH:mm:ss")
        kind = F.when(group(10).rlike(AGENT), "combined").otherwise("common")
        return _row("", ts=F.coalesce(ts, group(4)), host=group(1), app=_dash(group(3)), level=level_of_status(status), status=status, bytes=_dash(group(9)), message=F.concat_ws(" ", group(5), group(6))).withField("format", kind)

    return _parsed(line, COMMON + r"([\s\S]*)$", 10, row)


def syslog(line: Column) -> Column:
    """RFC 3164 and 5424; the priority is split into facility (div 8) and severity (mod 8)."""
    names = F.array(*[F.lit(x) for x in ("EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG")])

    def row(name: str, ts: int, host: int, app: int, message: int) -> Callable:
        level = lambda group: F.element_at(names, F.coalesce(group(1).try_cast("int") % FACILITIES, F.lit(7)) + 1)
        return lambda group: _row(name, ts=group(ts), host=_dash(group(host)), app=_dash(group(app)), level=level(group), message=F.coalesce(group(message), F.lit("")))

    both = F.coalesce(_parsed(line, RFC3164, 6, row("rfc3164", 2, 3, 4, 6)), _parsed(line, RFC5424, 8, row("rfc5424", 2, 3, 4, 8)))
    return F.when(line.startswith("<"), both)


def journal(line: Column) -> Column:
    """Short form of the journal; the level is told from the words of the message."""

    def row(group: Callable[[int], Column]) -> Column:
        message = F.coalesce(group(5), F.lit(""))
        level = F.when(message.rlike("(?i)error|fail"), "ERROR").when(message.rlike("(?i)warn"), "WARNING").otherwise("INFO")
        return _row("journal", ts=group(1), host=group(2), app=group(3), level=level, message=message)

    return _parsed(line, JOURNAL, 5, row)


def json_line(line: Column) -> Column:
    """An object with any of the usual names for time, level and message."""
    get = lambda *names: F.coalesce(*(F.get_json_object(line, f"$.{n}") for n in names))
    row = _row("json", ts=get("timestamp", "ts", "time", "@timestamp"), host=get("host", "hostname"), app=get("service", "app", "source"), level=F.upper(get("level", "severity", "lvl")), status=get("status", "status_code").try_cast("int"), message=get("message", "msg", "text"))
    return F.when(line.rlike(r"^\s*\{") & F.get_json_object(line, "$").isNotNull(), row)


def detect(line: Column) -> Column:
    """The first format that fits: JSON, syslog, access logs, journal; else format unknown with the line as message."""
    return F.coalesce(json_line(line), syslog(line), access(line), journal(line), _row("unknown", message=line))


def structured_data(line: Column) -> Column:
    """The key="value" pairs of an RFC 5424 line as a map."""
    data = F.regexp_extract(line, RFC5424, 7)
    keys, values = (F.regexp_extract_all(data, F.lit(r'(\w+)="([^"]*)"'), F.lit(i)) for i in (1, 2))
    return F.map_from_arrays(keys, values)


def parse_time(value: Column) -> Column:
    """Epoch seconds, epoch milliseconds (above 9,999,999,999), access-log and ISO forms; naive times are UTC."""
    n = value.try_cast("double")
    return F.coalesce(
        F.when(n > 9_999_999_999, F.timestamp_millis(n.cast("long"))).when(n.isNotNull(), F.timestamp_seconds(n)),
        F.try_to_timestamp(value, F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
        value.try_cast("timestamp"),
    )
