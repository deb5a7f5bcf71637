"""Packets of bytes to messages, and messages to their kind and data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType

from .running import running_sum

#: Packet numbers of a bucket in which messages are counted.
BUCKET = 1 << 16

#: Lengths of system messages of more than a byte; those of one byte; the others have 3 bytes, or 2 for program change and channel pressure.
SYSTEM = {0xF1: 2, 0xF2: 3, 0xF3: 2}
ALONE = (0xF6, 0xF8, 0xF9, 0xFA, 0xFB, 0xFC, 0xFD, 0xFE, 0xFF)
#: Kinds by the high half of the status byte, and of system messages.
KINDS = {0x8: "note_off", 0x9: "note_on", 0xA: "poly_pressure", 0xB: "control", 0xC: "program", 0xD: "pressure", 0xE: "bend"}
SYSTEM_KINDS = (0xF0, *SYSTEM, 0xF6, 0xF8, 0xFA, 0xFB, 0xFC, 0xFE, 0xFF)


def split_packet(data: bytes) -> list[bytes]:
    """Complete messages of a packet; a tail that can't be framed stays one chunk."""
    out, i = [], 0
    while i < len(data):
        status = data[i]
        if status == 0xF0:
            end = data.find(b"\xf7", i)
            n = end + 1 - i if end >= 0 else 0
        elif status < 0x80:
            n = 0
        elif status >= 0xF0:
            n = 1 if status in ALONE else SYSTEM.get(status, 0)
        else:
            n = 2 if status >> 4 in (0xC, 0xD) else 3
        if not n or i + n > len(data):
            return [*out, data[i:]]
        out.append(data[i : i + n])
        i += n
    return out


@F.pandas_udf(ArrayType(BinaryType()))
def split_messages(packets: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in packets:
        yield batch.map(lambda data: split_packet(bytes(data)) if data is not None else [])


def byte(raw: Column, i: int) -> Column:
    """The i-th byte of a binary column as a number, null beyond its end; -2 for the last."""
    return F.conv(F.hex(F.substring(raw, i + 1, 1)), 16, 10).try_cast("int")


def classify(raw: Column) -> tuple[Column, Column, Column, Column]:
    """Kind, channel and data bytes of a message. undecodable: not whole, an open system-exclusive one, or a status without meaning; these have no channel or data."""
    status = byte(raw, 0)
    need = F.when(F.shiftright(status, 4).isin(0xC, 0xD), 2).otherwise(3)
    table = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v)])
    voice = (status >= 0x80) & (status < 0xF0) & (F.octet_length(raw) >= need)
    closed = (status != 0xF0) | (byte(raw, -2) == 0xF7)
    kind = F.when(voice, F.try_element_at(table, F.shiftright(status, 4))).when(status.isin(*SYSTEM_KINDS) & closed, "system")
    return F.coalesce(kind, F.lit("undecodable")), F.when(voice, status.bitwiseAND(0x0F)), F.when(voice, byte(raw, 1)), F.when(voice & (need == 3), byte(raw, 2))


def framed(packets: DataFrame) -> DataFrame:
    """Messages of packets (take, packet_seq, ns, data): take, seq, packet_seq, ns, kind, channel, note, velocity, raw. seq counts a take's messages; packets of one number are in any order."""
    parts = packets.withColumn("parts", split_messages("data"))
    parts = running_sum(parts.withColumn("_size", F.size("parts")), ["take"], ["packet_seq"], "_size", "_upto", F.floor(F.col("packet_seq") / BUCKET))
    parts = parts.withColumn("first", F.col("_upto") - F.col("_size"))
    rows = parts.select("take", "packet_seq", "ns", "first", F.posexplode("parts").alias("i", "raw"))
    kind, channel, d1, d2 = classify(F.col("raw"))
    kind = F.when((kind == "note_on") & (d2 == 0), "note_off").otherwise(kind)
    return rows.select("take", (F.col("first") + F.col("i")).alias("seq"), "packet_seq", "ns", kind.alias("kind"), channel.alias("channel"), d1.alias("note"), d2.alias("velocity"), "raw")
