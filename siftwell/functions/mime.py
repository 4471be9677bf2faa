"""File types by leading bytes or by file extension.

Null bytes or extensions give null, as do unknown ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import as_column, ascii_lower, null_of

#: Fixed values: (type, MIME string, canonical extension, all accepted extensions).
TYPES = [
    ("Jpeg", "image/jpeg", "jpg", "jpg jpeg"),
    ("Png", "image/png", "png", "png"),
    ("Gif", "image/gif", "gif", "gif"),
    ("WebP", "image/webp", "webp", "webp"),
    ("Bmp", "image/bmp", "bmp", "bmp"),
    ("Ico", "image/x-icon", "ico", "ico"),
    ("Tiff", "image/tiff", "tiff", "tiff tif"),
    ("Mp4", "video/mp4", "mp4", "mp4 m4v"),
    ("QuickTime", "video/quicktime", "mov", "mov qt"),
    ("ThreeGp", "video/3gpp", "3gp", "3gp 3gpp"),
    ("Mkv", "video/x-matroska", "mkv", "mkv mk3d"),
    ("Heic", "image/heic", "heic", "heic"),
    ("Heif", "image/heif", "heif", "heif"),
    ("Avif", "image/avif", "avif", "avif"),
    ("WebM", "video/webm", "webm", "webm"),
    ("Avi", "video/x-msvideo", "avi", "avi"),
    ("Mp3", "audio/mpeg", "mp3", "mp3"),
    ("Wav", "audio/wav", "wav", "wav"),
    ("Flac", "audio/flac", "flac", "flac"),
    ("Ogg", "audio/ogg", "ogg", "ogg oga"),
    ("Pdf", "application/pdf", "pdf", "pdf"),
    ("Zip", "application/zip", "zip", "zip docx xlsx pptx jar"),
    ("Gzip", "application/gzip", "gz", "gz gzip"),
    ("Tar", "application/x-tar", "tar", "tar"),
    ("Sqlite", "application/x-sqlite3", "db", "db sqlite sqlite3"),
    ("Wasm", "application/wasm", "wasm", "wasm"),
    ("Elf", "application/x-elf", "elf", "elf"),
    ("PeExe", "application/x-msdownload", "exe", "exe dll"),
]

#: ISO media brands that do not mean plain MP4.
BRANDS = [
    ("Heic", ["heic", "heix", "hevc", "hevx"]),
    ("Heif", ["mif1"]),
    ("Avif", ["avif", "avis"]),
    ("QuickTime", ["qt  "]),
    ("ThreeGp", ["3gp4", "3gp5", "3gp6", "3gr6", "3gs6", "3gpp"]),
]

#: Fixed values, the first fit deciding: (type, [(offset, hex bytes), ...]); None as type stands for a family told apart further below.
SIGNATURES = [
    ("Jpeg", [(0, "FFD8FF")]),
    ("Png", [(0, "89504E470D0A1A0A")]),
    ("Gif", [(0, "47494638")]),
    ("WebP", [(0, "52494646"), (8, "57454250")]),
    ("Pdf", [(0, "25504446")]),
    ("Wasm", [(0, "0061736D")]),
    ("Elf", [(0, "7F454C46")]),
    ("PeExe", [(0, "4D5A")]),
    ("Gzip", [(0, "1F8B")]),
    ("Zip", [(0, "504B0304")]),
    ("Sqlite", [(0, "53514C69746520666F726D6174203300")]),
    ("Flac", [(0, "664C6143")]),
    ("Ogg", [(0, "4F676753")]),
    ("Mp3", [(0, "494433")]),
    ("Mp3", [(0, "FFFB")]),
    ("Mp3", [(0, "FFFA")]),
    ("Mp3", [(0, "FFF3")]),
    ("Mp3", [(0, "FFF2")]),
    ("Matroska", [(0, "1A45DFA3")]),
    ("IsoMedia", [(4, "66747970")]),
    ("Wav", [(0, "52494646"), (8, "57415645")]),
    ("Avi", [(0, "52494646"), (8, "41564920")]),
    ("Tar", [(257, "7573746172")]),
    ("Bmp", [(0, "424D")]),
    ("Ico", [(0, "00000100")]),
    ("Tiff", [(0, "49492A00")]),
    ("Tiff", [(0, "4D4D002A")]),
]
HEAD_BYTES = 512
#: Document type element of EBML: id 4282, length (high bit ignored), value.
_DOC_TYPE = r"(?s)\x42\x82(?:[\x04\x84](webm)|[\x08\x88](matroska))"


def mime_detect(content: Column | str) -> Column:
    """The type's name by the first 512 bytes, or null."""
    head = F.substring(as_column(content), 1, HEAD_BYTES)
    at = lambda off, n: F.substring(head, off + 1, n)
    brand = F.decode(at(8, 4), "ISO-8859-1")
    iso = reduce(lambda c, b: c.when((F.octet_length(head) >= 12) & brand.isin(b[1]), b[0]), BRANDS[1:], F.when((F.octet_length(head) >= 12) & brand.isin(BRANDS[0][1]), BRANDS[0][0])).otherwise("Mp4")
    ebml = F.when(F.regexp_extract(F.decode(head, "ISO-8859-1"), _DOC_TYPE, 1) == "webm", "WebM").otherwise("Mkv")
    found = null_of("string")
    for kind, parts in reversed(SIGNATURES):
        fits = reduce(lambda a, b: a & b, [at(off, len(h) // 2) == F.unhex(F.lit(h)) for off, h in parts])
        value = iso if kind == "IsoMedia" else ebml if kind == "Matroska" else F.lit(kind)
        found = F.when(fits, value).otherwise(found)
    return found


def mime_by_extension(extension: Column | str) -> Column:
    """The type's name by an extension without its dot; only A-Z are folded."""
    known = F.create_map(*[F.lit(x) for kind, _, _, accepted in TYPES for ext in accepted.split() for x in (ext, kind)])
    return F.try_element_at(known, ascii_lower(as_column(extension)))


def mime_string(kind: Column | str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for t in TYPES for x in (t[0], t[1])]), as_column(kind))


def mime_extension(kind: Column | str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for t in TYPES for x in (t[0], t[2])]), as_column(kind))


def mime_types(spark: SparkSession) -> DataFrame:
    """The closed dimension of 28 types: kind, mime, extension, accepted."""
    return spark.createDataFrame([(a, b, c, d.split()) for a, b, c, d in TYPES], "kind string, mime string, extension string, accepted array<string>")
