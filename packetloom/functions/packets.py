"""Fields of packets that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ports of the two protocols that have directions.
MODBUS_PORT, MQTT_PORT = "502", "1883"
TOPIC_BUCKETS = 1024


def direction(src_port: Column, dst_port: Column, port: str) -> tuple[Column, Column]:
    """(is_request, is_response): towards the port, or from it, but not both."""
    request = (dst_port == port) & (src_port != port)
    response = (src_port == port) & (dst_port != port)
    return F.when(request, 1).otherwise(0), F.when(response, 1).otherwise(0)


def delta_source(frame_delta: Column, tcp_delta: Column) -> Column:
    """Which layer has a delta at all; an empty list counts, JSON null doesn't. Arguments are variants."""

    def there(value: Column) -> Column:
        return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))

    return F.when(there(frame_delta), "frame").when(there(tcp_delta), "tcp").otherwise("none")


def known_source(source: Column) -> Column:
    return F.when(source.isin("frame", "tcp"), source).otherwise("none")


def topic_bucket(topic: Column, buckets: int = TOPIC_BUCKETS) -> Column:
    """SHA-1 of the topic modulo 1024, which its last three hex digits decide; -1 without a topic."""
    if buckets not in (16, 256, 1024, 4096):
        raise ValueError("buckets must be a power of two up to 4096")
    return F.coalesce(F.conv(F.right(F.sha1(topic), F.lit(3)), 16, 10).cast("bigint") % buckets, F.lit(-1).cast("bigint"))


def topic_length(topic: Column) -> Column:
    return F.coalesce(F.length(topic), F.lit(-1)).cast("bigint")


def payload_bytes(hex_text: Column) -> Column:
    """Bytes of a dump like ``aa:bb``; none for empty or missing."""
    return F.when(F.coalesce(hex_text, F.lit("")) == "", 0).otherwise(F.size(F.split(hex_text, ":")))


def window_start(ts: Column, seconds: Column | float) -> Column:
    """Start of the tumbling window, as floating seconds (no timestamp cast, so no rounding to microseconds)."""
    width = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return F.floor(ts / width) * width
