"""EVE JSON flow events.

Lines are parsed with ``from_json`` against a schema whose leaves are all
STRING: the same key may hold a number in one event and text in another, and
a STRING leaf keeps the raw token either way; values are ``try_cast`` later. What was a
JSON number is told by a second, narrow parse whose leaves are DOUBLE (text gives
null there). Bytes that are no UTF-8 are left out. Blank, truncated or non-JSON lines
parse to null and fall out with the ``event_type = 'flow'`` filter (D01). ``.gz`` files
are read natively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOW_FIELDS = ["start", "end", "age", "state", "reason", "pkts_toserver", "pkts_toclient",
               "bytes_toserver", "bytes_toclient"]
TOP_FIELDS = ["timestamp", "event_type", "flow_id", "community_id", "src_ip", "src_port", "dest_ip",
              "dest_port", "proto", "app_proto"]

EVE_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in TOP_FIELDS]
    + [T.StructField("flow", T.StructType([T.StructField(f, T.StringType()) for f in FLOW_FIELDS]))]
)

NUMBER_FIELDS = ["flow_id", "src_port", "dest_port", "proto"]
FLOW_NUMBER_FIELDS = ["age", "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient"]
NUMBER_SCHEMA = T.StructType(
    [T.StructField(f, T.DoubleType()) for f in NUMBER_FIELDS]
    + [T.StructField("flow", T.StructType([T.StructField(f, T.DoubleType()) for f in FLOW_NUMBER_FIELDS]))])


def readable(value: Column) -> Column:
    """The text without bytes that are no UTF-8."""
    return F.when(F.is_valid_utf8(value), value).otherwise(
        F.translate(F.make_valid_utf8(value), "\ufffd", ""))


def parse_eve_lines(lines: DataFrame, value_col: str = "value", keep_all: bool = False) -> DataFrame:
    """Lines -> one row per flow event: the top-level fields, ``flow`` struct, ``numbers`` (the
    values of fields whose token was a JSON number) and ``proto_is_number`` / ``age_is_number``.

    The parse is a generator (``inline`` of the one-element array), so the
    ``event_type`` filter stays above it and every line is parsed exactly once
    (a filter pushed through a projection would re-run ``from_json``)."""
    v = readable(F.col(value_col))
    both = F.struct(F.from_json(v, EVE_SCHEMA, {"mode": "PERMISSIVE"}).alias("_e"),
                    F.from_json(v, NUMBER_SCHEMA, {"mode": "PERMISSIVE"}).alias("numbers"))
    kept = [c for c in lines.columns if c != value_col]
    parsed = lines.select(*kept, F.inline(F.array(both))).select(
        *kept, F.col("numbers.proto").isNotNull().alias("proto_is_number"),
        F.col("numbers.flow.age").isNotNull().alias("age_is_number"), "_e.*", "numbers")
    if not keep_all:
        parsed = parsed.filter(F.col("event_type") == "flow")  # D01
    return parsed


def read_eve_flows(spark: SparkSession, paths) -> DataFrame:
    """One file, a glob or a list; gz transparent; only flow events."""
    lines = spark.read.text(paths)
    return parse_eve_lines(lines)


def stream_eve_flows(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same parse on a streaming text source (new files in a directory)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_eve_lines(reader.load(directory))


def stream_eve_flows_from(spark: SparkSession, fmt: str, options: dict[str, str], path: str | None = None) -> DataFrame:
    """A05 by configuration: any streaming source whose ``value`` column holds
    one EVE JSON object per record (e.g. ``fmt="kafka"`` with
    ``kafka.bootstrap.servers`` / ``subscribe`` when that connector is on the
    classpath; it is not bundled here)."""
    reader = spark.readStream.format(fmt)
    for k, v in options.items():
        reader = reader.option(k, v)
    raw = reader.load(path) if path else reader.load()
    return parse_eve_lines(raw.select(F.col("value").cast("string").alias("value")))


def iso_to_epoch(text: Column) -> Column:
    """ISO-8601 text with ``Z``, ``+0000`` or ``+00:00`` -> epoch seconds
    (DOUBLE); naive text is UTC (session time zone); invalid -> null."""
    s = F.trim(text)
    s = F.regexp_replace(s, "Z$", "+00:00")
    s = F.regexp_replace(s, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    ts = s.try_cast("timestamp")
    return F.unix_micros(ts) / F.lit(1e6)
