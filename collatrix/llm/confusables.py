"""The public table of visually confusable characters (Unicode Technical Standard 39), as the ICU library that Spark ships holds it.

Nothing is copied here: the table (confusables.cfu, some 6,300 characters) is read from ``jars/icu4j-*.jar`` of the Spark
at hand, on the driver and in each worker, so its version is that of Spark (ICU 77.1 with Spark 4.1). Its layout, in
big-endian numbers: a header whose first two bytes give its size; then offsets and counts of keys (a character in the low
24 bits, the length of its prototype less one in the high 8), values (the prototype if it is one unit, else its place
in the strings) and strings (UTF-16 units).
"""

from __future__ import annotations

import glob
import os
import struct
import zipfile
from functools import lru_cache

ENTRY = "com/ibm/icu/impl/data/icudata/confusables.cfu"


def _archive() -> str:
    import pyspark

    for home in (os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)):
        found = sorted(glob.glob(os.path.join(home, "jars", "icu4j-*.jar"))) if home else []
        if found:
            return found[-1]
    raise RuntimeError("no icu4j-*.jar among Spark's jars: the public table of confusable characters is read from there")


@lru_cache(maxsize=1)
def prototypes() -> dict[str, str]:
    """Each confusable character with the prototype of its class (one or more characters)."""
    with zipfile.ZipFile(_archive()) as z:
        raw = z.read(ENTRY)
    body = raw[struct.unpack(">H", raw[:2])[0] :]
    _, _, _, at_keys, n, at_values, _, at_strings, units = struct.unpack(">9i", body[:36])
    keys = struct.unpack(f">{n}i", body[at_keys : at_keys + 4 * n])
    values = struct.unpack(f">{n}H", body[at_values : at_values + 2 * n])
    strings = body[at_strings : at_strings + 2 * units]
    out = {}
    for k, v in zip(keys, values, strict=True):
        length = (k >> 24 & 0xFF) + 1
        out[chr(k & 0xFFFFFF)] = chr(v) if length == 1 else strings[2 * v : 2 * (v + length)].decode("utf-16-be")
    return out
