"""Operators on packet tables: header fields, reuse of identifiers and payloads, timing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MICROS, modbus_header
from ..functions.ordered import previous_row


def decode(packets: DataFrame, payload_hex: str = "payload_hex") -> DataFrame:
    fields = modbus_header(F.col(payload_hex))
    return packets.select("*", *[c.alias(n) for n, c in fields.items()])


def protocol_counts(packets: DataFrame, proto: str = "proto") -> DataFrame:
    """TCP, UDP and the rest."""
    name = F.lower(F.col(proto))
    kind = F.when(name == "tcp", "TCP").when(name == "udp", "UDP").otherwise("other")
    return packets.groupBy(kind.alias("protocol")).agg(F.count(F.lit(1)).alias("n"))


def first_with_payload(
    packets: DataFrame, t: str, tie: str, payload: str, n: int = 5, of_first: int = 1000
) -> DataFrame:
    """The first n packets with a payload among the first ``of_first`` packets."""
    head = packets.orderBy(t, tie).limit(of_first)
    return head.filter(F.length(payload) > 0).orderBy(t, tie).limit(n)


def id_reuse(
    packets: DataFrame, conn: str, txid: str, t: str, tie: str, session_s: float, slice_s: float
) -> DataFrame:
    """Packets whose transaction id was used before on the connection within the session window."""
    before = previous_row(packets, [conn, txid], t, tie, [t], slice_s)
    gap = (F.col(t) - F.col(f"prev_{t}")) / F.lit(float(MICROS))
    return before.withColumn("gap_s", gap).filter(F.col("gap_s") <= session_s).drop(f"prev_{t}")


def payload_reuse(
    packets: DataFrame, conn: str, payload: str, order: Sequence[str]
) -> DataFrame:
    """Mark packets whose payload bytes were seen before on the connection.

    Only the first packet of each payload is looked up, by a minimum that is combined before the
    shuffle; a payload that makes up much of the traffic is never gathered.
    """
    digest = packets.withColumn("digest", F.md5(F.col(payload).cast("binary")))
    first = digest.groupBy(conn, "digest").agg(
        F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("n_copies")
    )
    return digest.join(first, [conn, "digest"]).select(
        *digest.columns, "n_copies", (F.struct(*order) > F.col("_first")).alias("seen_before")
    )


def timing_regularity(
    packets: DataFrame, conn: str, t: str, tie: str, slice_s: float
) -> DataFrame:
    """Deviation of the gaps between packets over their mean, per connection; small is regular."""
    before = previous_row(packets, [conn], t, tie, [t], slice_s)
    gap = (F.col(t) - F.col(f"prev_{t}")) / F.lit(float(MICROS))
    return before.groupBy(conn).agg(
        F.count(gap).alias("n_gaps"), F.avg(gap).alias("mean_gap_s"),
        (F.stddev_samp(gap) / F.nullif(F.avg(gap), F.lit(0.0))).alias("irregularity"),
    )
