"""Expressions over note numbers, times and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Names of the twelve pitch classes from C.
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def note_name(n: Column) -> Column:
    """Name and octave; 60 is C4."""
    return F.concat(F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(n, F.lit(12)) + 1).cast("int")), (F.floor(n / 12) - 1).cast("string"))


def note_number(name: Column) -> Column:
    """Number of a name such as Gb4 or C#3; null if it is none."""
    letter = F.upper(F.regexp_extract(name, "^([A-Ga-g])([#b]*)(-?[0-9]+)$", 1))
    base = F.element_at(F.create_map(*[F.lit(x) for n, v in zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11)) for x in (n, v)]), letter)
    marks = F.regexp_extract(name, "^([A-Ga-g])([#b]*)(-?[0-9]+)$", 2)
    shift = F.length(F.regexp_replace(marks, "b", "")) - F.length(F.regexp_replace(marks, "#", ""))
    octave = F.regexp_extract(name, "^([A-Ga-g])([#b]*)(-?[0-9]+)$", 3).try_cast("int")
    return F.when(letter != "", base + shift + 12 * (octave + 1)).cast("int")


def message_length(status: Column) -> Column:
    """Bytes of a message from its status byte; null for data bytes, for statuses without meaning, and for system-exclusive ones, whose end is marked."""
    high = status.bitwiseAND(0xF0)
    return F.when(status < 0x80, None).when(high.isin(0xC0, 0xD0), 2).when(high < 0xF0, 3).when(status == 0xF0, None).when(status.isin(0xF1, 0xF3), 2).when(status == 0xF2, 3).when(status.isin(0xF4, 0xF5, 0xF7), None).otherwise(1).cast("int")


def pedal_contact(value: Column, *, engage: float = 0.55, knee: float = 0.25, leak: float = 0.02, scale: float = 1.0) -> Column:
    """Contact in [0, 1] of a damper at a control value of 0 to 127: a ramp of width `knee` centred on `engage`, both parts of the scaled travel; 1 below and `leak` above."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    travel = unit(value / 127.0) * scale
    ramp = unit((engage - travel) / knee + 0.5) if knee > 1e-6 else F.when(travel >= engage, 0.0).otherwise(1.0)
    return unit(leak + (1.0 - leak) * ramp)


def hex_bytes(raw: Column) -> Column:
    """Bytes as two-digit numbers with spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.hex(raw)), "(..)", "$1 "))


def key_index(note: Column) -> Column:
    """Place of a note on a keyboard of 88 keys, from 0; null beyond it."""
    return F.when(note.between(21, 108), note - 21)


def note_of_key(key: Column) -> Column:
    return F.when(key.between(0, 87), key + 21)


def duration_text(ns: Column) -> Column:
    """A time in the largest of s, ms, us that it reaches one of, else in ns."""
    scaled = lambda unit, name: F.concat(F.format_number(ns / unit, 3), F.lit(name))
    return F.when(ns >= 1_000_000_000, scaled(1e9, " s")).when(ns >= 1_000_000, scaled(1e6, " ms")).when(ns >= 1000, scaled(1e3, " us")).otherwise(F.concat(ns.cast("string"), F.lit(" ns")))


def spelled(melody: Column, *, octave: int = 4) -> Column:
    """Numbers of note names with spaces between; a name without an octave lies as near as can be to the note before, the lower of two equally near ones."""
    pc = F.create_map(*[F.lit(x) for n, v in zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11)) for x in (n, v)])

    def add(found: Column, name: Column) -> Column:
        marks = F.regexp_extract(name, "^[A-Ga-g]([#b]*)", 1)
        cls = F.try_element_at(pc, F.upper(F.substring(name, 1, 1))) + F.length(F.regexp_replace(marks, "b", "")) - F.length(F.regexp_replace(marks, "#", ""))
        given = F.regexp_extract(name, "(-?[0-9]+)$", 1).try_cast("int")
        before = F.try_element_at(found, F.lit(-1))
        up = F.pmod(cls - before, F.lit(12))
        near = before + F.when(up < 6, up).otherwise(up - 12)
        return F.concat(found, F.array(F.coalesce(12 * (given + 1) + cls, near, 12 * (octave + 1) + cls).cast("int")))

    return F.aggregate(F.filter(F.split(melody, " +"), lambda x: x != ""), F.array().cast("array<int>"), add)


def clock(seconds: Column) -> Column:
    """MM:SS."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), F.floor(F.pmod(seconds, F.lit(60))).cast("long"))


def seconds_of(text: Column) -> Column:
    """Seconds of MM:SS or of a number; null if it is neither."""
    parts = F.split(text, ":")
    return F.when(F.size(parts) == 2, F.get(parts, 0).try_cast("double") * 60 + F.get(parts, 1).try_cast("double")).otherwise(text.try_cast("double"))
