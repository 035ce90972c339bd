"""WAV files by their chunks: where the samples lie and in which form, and what is wrong with a file."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format tags: whole numbers, floating point, and the extensible form, which names one of the two.
WHOLE, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Chunks that a header may have before its samples.
MOST_CHUNKS = 64


class Fault(ValueError):
    """What keeps a file from being read."""


@dataclass(frozen=True)
class Form:
    tag: int
    bits: int
    channels: int
    rate: int
    at: int  #: where the samples begin
    frames: int  #: samples of each channel

    @property
    def width(self) -> int:
        """Bytes of a frame: a sample of each channel."""
        return self.bits // 8 * self.channels


def form(data: bytes | None) -> Form:
    """The form of a file; a Fault for null, other files, forms that are not read, and files that are cut short."""
    if data is None:
        raise Fault("no content")
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise Fault("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        at += 8
        if name == b"fmt ":
            if size < 16 or at + size > len(data):
                raise Fault("the format is cut short")
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at)
            if tag == EXTENSIBLE and size >= 26:
                (tag,) = struct.unpack_from("<H", data, at + 24)
            if (tag, bits) not in {(WHOLE, 8), (WHOLE, 16), (WHOLE, 24), (WHOLE, 32), (FLOAT, 32), (FLOAT, 64)} or not channels or not rate:
                raise Fault(f"form {tag} of {bits} bits, {channels} channels at {rate} Hz is not read")
            head = tag, bits, channels, rate
        elif name == b"data":
            if head is None:
                raise Fault("samples before their format")
            if size == 0xFFFFFFFF:  # written before its length was known
                size = len(data) - at
            if at + size > len(data):
                raise Fault("the samples are cut short")
            tag, bits, channels, rate = head
            return Form(*head, at, size // (bits // 8 * channels))
        at += size + size % 2
    raise Fault("no samples")


def samples(data: bytes, f: Form, first: int, count: int) -> np.ndarray:
    """Samples first to first + count between -1 and 1, the mean of the channels; only their bytes are read."""
    count = max(0, min(count, f.frames - first))
    raw = memoryview(data)[f.at + first * f.width : f.at + (first + count) * f.width]
    if f.tag == FLOAT:
        x = np.nan_to_num(np.frombuffer(raw, f"<f{f.bits // 8}").astype(np.float64), posinf=1.0, neginf=-1.0)
    elif f.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif f.bits == 24:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{f.bits // 8}") / float(1 << (f.bits - 1))
    return x.reshape(-1, f.channels).mean(1)


def written(x: np.ndarray, rate: int) -> bytes:
    """A WAV file of 16-bit samples, one channel; what is beyond full scale is clipped."""
    raw = np.rint(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, WHOLE, 1, rate, 2 * rate, 2, 16, b"data", len(raw))
    return head + raw


def seconds(content: Column) -> Column:
    """The duration that a header states, walking its chunks up to the samples; null where there are none. No sample is read."""

    def number(at: Column, n: int) -> Column:
        digits = F.concat(*(F.hex(F.substring(content, at + k + 1, F.lit(1))) for k in reversed(range(n))))
        return F.conv(digits, 16, 10).cast("long")

    def step(s: Column, _: Column) -> Column:
        name, size = F.substring(content, s["at"] + 1, F.lit(4)).cast("string"), number(s["at"] + 4, 4)
        found = s["bytes"].isNotNull() | size.isNull()
        here = F.least(size, F.octet_length(content) - s["at"] - 8)
        return F.struct(
            F.when(found, s["at"]).otherwise(s["at"] + 8 + size + size % 2).alias("at"),
            F.when(~found & (name == "fmt "), number(s["at"] + 16, 4)).otherwise(s["rate"]).alias("rate"),
            F.when(~found & (name == "data"), here).otherwise(s["bytes"]).alias("bytes"),
        )

    none = F.lit(None).cast("long")
    start = F.struct(F.lit(12).cast("long").alias("at"), none.alias("rate"), none.alias("bytes"))
    riff = (F.substring(content, F.lit(1), F.lit(4)).cast("string") == "RIFF") & (F.substring(content, F.lit(9), F.lit(4)).cast("string") == "WAVE")
    last = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_CHUNKS)), start, step)
    return F.when(riff, F.try_divide(last["bytes"], last["rate"]))
