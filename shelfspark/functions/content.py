"""Rules over file contents: archives, headers, digests, inner titles.

Header rules and digests are Column expressions.  Only byte swaps, archives and the cleaning of inner titles have no
built-in form and run as Arrow-batched functions.
"""

from __future__ import annotations

import io
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, StringType

# Fixed values of the formats.
HEADER_BYTES = {"smc_512": 512, "ines_16": 16, "lynx_64": 64}
INES_MAGIC = "4E45531A"
LYNX_MAGIC = "4C594E5800"
Z64, V64, N64 = b"\x80\x37\x12\x40", b"\x37\x80\x40\x12", b"\x40\x12\x37\x80"
PAYLOAD_LIMIT = 2 * 2**30
N64_TITLE = (0x20, 20)
SNES_OFFSETS = [0x7FC0, 0xFFC0]
MEGADRIVE_OFFSETS = [0x150, 0x120]
MEGADRIVE_MAGIC = ["SEGA MEGA DRIVE", "SEGA GENESIS", "SEGA 32X", "SEGA PICO"]
TITLE_SLOTS = {"gb": (0x134, 16), "gbc": (0x134, 16), "gba": (0xA0, 12), "nds": (0, 12)}

_CHUNK = 1 << 20


def _magic(content: Column, hex_bytes: str) -> Column:
    return F.hex(F.substring(content, 1, len(hex_bytes) // 2)) == hex_bytes


def _after(content: Column, n: int) -> Column:
    return F.substr(content, F.lit(n + 1))


def byte_order(data: bytes) -> bytes:
    """Big-endian form of a cartridge in any of three byte orders (padded with zeros to whole units); other data as it is."""
    unit = {V64: 2, N64: 4}.get(bytes(data[:4]))
    if unit is None:
        return data
    padded = bytes(data) + b"\0" * (-len(data) % unit)
    return np.frombuffer(padded, dtype=f"u{unit}").byteswap().tobytes()


@pandas_udf(BinaryType())
def big_endian(content: pd.Series) -> pd.Series:
    return content.map(byte_order, na_action="ignore")


def normalized(content: Column, rule: Column) -> Column:
    """The content without the header that its rule names; without a rule, as it is. Only what has to be swapped goes to Python, which Spark would else ask about every row."""
    swapped = (rule == "n64_byteswap") & F.hex(F.substring(content, 1, 4)).isin(V64.hex().upper(), N64.hex().upper())
    return (
        F.when((rule == "smc_512") & (F.octet_length(content) % 1024 == 512), _after(content, HEADER_BYTES["smc_512"]))
        .when((rule == "ines_16") & _magic(content, INES_MAGIC), _after(content, HEADER_BYTES["ines_16"]))
        .when((rule == "lynx_64") & _magic(content, LYNX_MAGIC), _after(content, HEADER_BYTES["lynx_64"]))
        .when(swapped, big_endian(F.when(swapped, content)))
        .otherwise(content)
    )


def digests(content: Column) -> dict[str, Column]:
    return {"crc32": F.lower(F.lpad(F.hex(F.crc32(content)), 8, "0")), "sha1": F.sha1(content), "md5": F.md5(content), "size": F.octet_length(content).cast("long")}


def unzip(data: bytes, limit: int = PAYLOAD_LIMIT) -> bytes | None:
    """The largest file of an archive (the first of equals); null if there is none, it can't be read or has more than limit bytes."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            files = [i for i in archive.infolist() if not i.is_dir()]
            if not files:
                return None
            out = bytearray()
            with archive.open(max(files, key=lambda i: i.file_size)) as inner:
                # the size in the directory may be a lie, so bytes are counted as they come
                while chunk := inner.read(_CHUNK):
                    out += chunk
                    if len(out) > limit:
                        return None
            return bytes(out)
    except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, RuntimeError, ValueError, zlib.error):
        return None


@pandas_udf(BinaryType())
def zip_payload(content: pd.Series) -> pd.Series:
    return content.map(unzip, na_action="ignore")


@pandas_udf(ArrayType(StringType()))
def zip_names(content: pd.Series) -> pd.Series:
    """Names of an archive's files, from its directory alone; none if it can't be read."""

    def names(data: bytes) -> list[str]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                return [i.filename for i in archive.infolist() if not i.is_dir()]
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError):
            return []

    return content.map(names, na_action="ignore")


def is_multi_archive(content: Column, extensions: list[str]) -> Column:
    """More than one file with a known extension."""
    ext = lambda n: F.lower(F.regexp_extract(n, r"^.*[^/](\.[^./]+)$", 1))
    return F.size(F.filter(zip_names(content), lambda n: ext(n).isin(extensions))) > 1


def payload(content: Column, extension: Column) -> Column:
    """What is hashed: an archive's payload, else the content."""
    return F.when(F.lower(extension) == ".zip", zip_payload(content)).otherwise(content)


def clean_title(raw: Column) -> Column:
    """Printable ASCII up to the first NUL, blanks collapsed; bytes beyond ASCII become the replacement character. Null if nothing is left."""
    # Latin-1 gives each byte one character, so that the rules below see bytes
    text = F.regexp_replace(F.decode(raw, "ISO-8859-1"), "(?s)\\x00.*$", "")
    text = F.regexp_replace(F.regexp_replace(text, "[\\x01-\\x1F\\x7F]", ""), "[\\x80-\\xFF]", "�")
    return F.nullif(F.trim(F.regexp_replace(text, " +", " ")), F.lit(""))


def printable(raw: Column) -> Column:
    """How many bytes are from blank to '~'."""
    return F.length(F.regexp_replace(F.decode(raw, "ISO-8859-1"), "[^\\x20-\\x7E]", ""))


def _slot(content: Column, offset: int, length: int) -> Column:
    return F.when(F.octet_length(content) >= offset + length, F.substring(content, offset + 1, length))


def _best(content: Column, offsets: list[int], length: int) -> Column:
    """The title of the slot with more printable bytes; of equal ones the first."""
    slots = [_slot(content, o, length) for o in offsets]
    found = F.array(*(F.struct(printable(s).alias("p"), F.lit(-i).alias("i"), clean_title(s).alias("t")) for i, s in enumerate(slots)))
    return F.array_max(F.filter(found, lambda x: x["t"].isNotNull()))["t"]


def inner_title(content: Column, system: Column) -> Column:
    """The title inside a cartridge's header, null where the system has no slot or the content is too short."""
    bare = normalized(content, F.lit("smc_512"))
    head = F.substring(content, 1, N64_TITLE[0] + N64_TITLE[1])  # whole units, so its swapped form is the beginning of the content's
    swapped = F.when(F.hex(F.substring(content, 1, 4)).isin(*(m.hex().upper() for m in (Z64, V64, N64))), normalized(F.when(system == "n64", head), F.lit("n64_byteswap")))
    mega = F.decode(F.substring(content, 0x101, 16), "ISO-8859-1")
    out = (
        F.when(system == "snes", _best(bare, SNES_OFFSETS, 21))
        .when(system == "n64", clean_title(_slot(swapped, *N64_TITLE)))
        .when((system == "megadrive") & F.greatest(*(mega.startswith(m) for m in MEGADRIVE_MAGIC)), _best(content, MEGADRIVE_OFFSETS, 48))
    )
    for name, (offset, length) in TITLE_SLOTS.items():
        out = out.when(system == name, clean_title(_slot(content, offset, length)))
    return out
