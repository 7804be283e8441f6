"""Functions of image bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PNG = b"\x89PNG\r\n\x1a\n"
#: Chunks that hold text, profiles and camera data; fixed values.
TEXT_CHUNKS = frozenset({b"iCCP", b"iTXt", b"zTXt", b"tEXt", b"eXIf"})


def without_text(data: bytes | None) -> bytes | None:
    """A PNG file without its text chunks. Other files, and what follows a broken chunk, stay as they are."""
    if data is None or not data.startswith(PNG):
        return data
    kept, at = [PNG], len(PNG)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        end = at + 12 + size
        if end > len(data):
            break
        if kind not in TEXT_CHUNKS:
            kept.append(data[at:end])
        at = end
    return b"".join([*kept, data[at:]])


@F.pandas_udf(T.BinaryType())
def strip_png(images: pd.Series) -> pd.Series:
    return images.map(without_text)
