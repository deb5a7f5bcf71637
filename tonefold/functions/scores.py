"""Score and capture formats that only a scan can read: Plaine & Easie incipits, Standard MIDI Files. Arrow-batched."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T

# --- Plaine & Easie -------------------------------------------------------------------------

#: Quarter notes of a duration digit, semitones of a letter.
QUARTERS = {"0": 8.0, "1": 4.0, "2": 2.0, "4": 1.0, "8": 0.5, "6": 0.25, "3": 0.125, "5": 0.0625, "7": 0.03125, "9": 0.015625}
SEMITONES = dict(zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11)))
SHIFTS = {"xx": 2, "x": 1, "bb": -2, "b": -1, "n": 0}
#: What a decoder has to see; everything else is passed over. A measure rest takes its count along.
_INCIPIT = re.compile(r"(?P<rests>=[0-9]*)|(?P<tuplet>\((?:[0-9]+(?=[^0-9.]))?|\))|(?P<grace>qq|r|[gq])|(?P<octave>'+|,+)|(?P<shift>xx|x|bb|b|n)|(?P<length>[0-9]\.*)|(?P<note>[A-G])(?P<chord>\^?)|(?P<rest>-)|(?P<bar>/)|(?P<tie>\+)")


def key_shifts(signature: str) -> dict[str, int]:
    """bBEA to B, E and A one lower, xFCG to F, C and G one higher."""
    out: dict[str, int] = {}
    for sign, letters in re.findall("([xbn])([A-G]*)", signature or ""):
        if sign != "n":
            out |= dict.fromkeys(letters, SHIFTS[sign])
    return out


def incipit(code: str, signature: str = "", most: int = 96) -> tuple[list[int], list[float]]:
    """Pitches and onsets in quarter notes. Of a chord's notes the highest counts; accidentals hold for their letter, in any octave, to the bar line; grace notes
    take no time; notes of a group in brackets are three, or as many as the bracket says, in the time of two; a tied note of the same pitch goes on."""
    pitches: list[int] = []
    onsets: list[float] = []
    always, here = key_shifts(signature), {}
    octave, length, at, shift = 4, 1.0, 0.0, None
    grace, chord, tied, group = "", False, False, 1.0
    for m in _INCIPIT.finditer(code or ""):
        kind, text = ("note", m["note"]) if m["note"] else (m.lastgroup, m[0])
        if kind == "grace":
            grace = {"g": "one", "q": "one", "qq": "many", "r": ""}[text]
        elif kind == "octave":
            octave = 3 + len(text) if text[0] == "'" else 4 - len(text)
        elif kind == "shift":
            shift = SHIFTS[text]
        elif kind == "length":
            length = QUARTERS[text[0]] * (2 - 0.5 ** text.count("."))
        elif kind == "rest":
            at += length * group
        elif kind == "tuplet":
            group = 1.0 if text == ")" else 2 / int(text[1:] or 3) if text != "(0" else 1.0
        elif kind == "bar":
            here = {}
        elif kind == "tie":
            tied = True
        elif kind == "note":
            if shift is not None:
                here[text] = shift
            pitch = 12 * (octave + 1) + SEMITONES[text] + here.get(text, always.get(text, 0))
            shift, takes = None, 0.0 if grace else length * group
            grace = "" if grace == "one" else grace
            if not 0 <= pitch < 128:
                pass
            elif chord and pitches:
                pitches[-1] = max(pitches[-1], pitch)
            elif tied and pitches and pitches[-1] == pitch:
                at += takes
            else:
                if len(pitches) == most:
                    break
                pitches.append(pitch)
                onsets.append(round(at, 5))
                at += takes
            tied, chord = False, m["chord"] == "^"
    return pitches, onsets


@F.pandas_udf(T.StructType().add("pitches", T.ArrayType(T.IntegerType())).add("onsets", T.ArrayType(T.DoubleType())))
def decode_incipit(codes: pd.Series, signatures: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([incipit(c, s) for c, s in zip(codes, signatures)], columns=["pitches", "onsets"])


# --- Standard MIDI Files --------------------------------------------------------------------

TICKS = 480
#: Microseconds of a quarter note where a file gives no tempo.
TEMPO = 500_000


def _number(data: bytes, i: int) -> tuple[int, int]:
    """Variable-length number at i, and the place after it."""
    value = 0
    while True:
        value = value << 7 | data[i] & 0x7F
        i += 1
        if not data[i - 1] & 0x80:
            return value, i


def _spelled(value: int) -> bytes:
    out = bytes([value & 0x7F])
    while value := value >> 7:
        out = bytes([value & 0x7F | 0x80]) + out
    return out


def _track(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(tick, message) of a track; meta messages begin with FF, running status is written out."""
    i = tick = 0
    status = 0
    while i < len(data):
        step, i = _number(data, i)
        tick += step
        if data[i] >= 0x80:
            status = data[i]
            i += 1
        if status == 0xFF:
            kind = data[i]
            n, j = _number(data, i + 1)
            yield tick, bytes([0xFF, kind]) + data[j : j + n]
            i = j + n
        elif status in (0xF0, 0xF7):
            n, j = _number(data, i)
            yield tick, bytes([status]) + data[j : j + n]
            i = j + n
        else:
            n = 1 if status >> 4 in (0xC, 0xD) else 2
            yield tick, bytes([status]) + data[i : i + n]
            i += n


def read_midi(data: bytes) -> list[dict]:
    """Messages of all tracks as {seconds, data} in order of time, by the file's tempo map. Not a MIDI file: none."""
    if data[:4] != b"MThd":
        return []
    division = int.from_bytes(data[12:14], "big")
    i, rows = 8 + int.from_bytes(data[4:8], "big"), []
    while i + 8 <= len(data):
        n = int.from_bytes(data[i + 4 : i + 8], "big")
        if data[i : i + 4] == b"MTrk":
            rows += [(tick, len(rows) + k, message) for k, (tick, message) in enumerate(_track(data[i + 8 : i + 8 + n]))]
        i += 8 + n
    out, seconds, last, tempo = [], 0.0, 0, TEMPO
    for tick, _, message in sorted(rows):
        seconds += (tick - last) * tempo / 1e6 / division
        last = tick
        if message[:2] == b"\xff\x51":
            tempo = int.from_bytes(message[2:5], "big")
        elif message[0] < 0xF0:
            out.append({"seconds": seconds, "data": message})
    return out


def write_midi(ticks: list[int], messages: list[bytes]) -> bytes:
    """A file of one track with messages at non-decreasing ticks, at the usual tempo."""
    body, last = b"\x00\xff\x51\x03" + TEMPO.to_bytes(3, "big"), 0
    for tick, message in zip(ticks, messages):
        body += _spelled(tick - last) + message
        last = tick
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + (6).to_bytes(4, "big") + b"\x00\x00\x00\x01" + TICKS.to_bytes(2, "big") + b"MTrk" + len(body).to_bytes(4, "big") + body


@F.pandas_udf(T.ArrayType(T.StructType().add("seconds", T.DoubleType()).add("data", T.BinaryType())))
def parse_midi(files: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in files:
        yield batch.map(lambda data: read_midi(bytes(data)) if data is not None else [])
