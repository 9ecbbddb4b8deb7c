"""Capture table schema and the fixed values of the CDX format.

A capture is one archived copy of a URL: the canonical URL, the capture instant (UTC, whole seconds),
the original URL, mime type, HTTP response, content digest, redirect, the record offset and the archive
(W)ARC file that holds it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------------
# These must equal the reference format exactly for results to match.
#
# The one CDX layout line accepted as a file header (note the leading space):
CDX_HEADER = " CDX N b a m s k r M S V g"
# Columns of the capture table / escaped-CSV export, in this order:
CAPTURE_COLUMNS = ("id", "url", "date", "ourl", "mime", "response", "newdigest", "redirect", "offset", "arc",
                   "sdomain", "path")
# Cell values that mean "no value":
NULL_TOKENS = ("", "-")
# Response codes that are not numbers but still accepted, stored as -1:
RESPONSE_PLACEHOLDERS = ("-", "TBD")
RESPONSE_PLACEHOLDER_VALUE = -1
# CDX field letters and the capture column each one fills (None: read but not stored):
CDX_LETTERS = {
    "N": "url",        # URL in canonical form
    "A": "url",        # the same, where a layout has no N
    "b": "date",       # capture time
    "a": "ourl",       # URL as requested
    "m": "mime",       # content type
    "s": "response",   # HTTP status
    "k": "newdigest",  # content hash
    "r": "redirect",   # target of a redirect
    "M": "meta",       # robot flags, one letter each
    "S": None,         # record length, compressed
    "V": "offset",     # place in the compressed archive file
    "g": "arc",        # archive file
    "e": "ip",         # server address
    "c": "digest",     # content hash of the old kind
    "v": "uoffset",    # place in the uncompressed archive file
    "D": "doffset",    # place in the compressed data file
    "d": "udoffset",   # place in the uncompressed data file
    "n": "arclength",  # length of the archived document
}
# What ends the domain part of a canonical URL:
DOMAIN_END = r"\)?/"
# Timestamp text format in the export (UTC, mandatory Z):
EXPORT_DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# Default search column list and row limit:
DEFAULT_FIELDS = ("ourl", "date", "mime", "arc", "offset")
DEFAULT_LIMIT = 10000
# ---------------------------------------------------------------------------------------------------

CDX_TIMESTAMP_FORMAT = "yyyyMMddHHmmss"
DEFAULT_ORDER = ("url", "date", "id")

CAPTURE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("date", T.TimestampType(), True),
    T.StructField("ourl", T.StringType(), True),
    T.StructField("mime", T.StringType(), True),
    T.StructField("response", T.IntegerType(), True),
    T.StructField("newdigest", T.StringType(), True),
    T.StructField("redirect", T.StringType(), True),
    T.StructField("offset", T.LongType(), True),
    T.StructField("arc", T.StringType(), True),
    T.StructField("sdomain", T.StringType(), True),
    T.StructField("path", T.StringType(), True),
])

# Declared by the format but filled by no converter; typed here so a wider layout can carry them.
OPTIONAL_FIELDS = {
    "ip": T.StringType(),          # a dotted address does not fit an int
    "digest": T.StringType(),
    "uoffset": T.LongType(),
    "doffset": T.LongType(),
    "udoffset": T.LongType(),
    "arclength": T.LongType(),
    "meta": T.ArrayType(T.StringType()),
}

REQUIRED = ("id", "url", "date", "ourl")


def layout_letters(layout: str = CDX_HEADER) -> list[str]:
    """`` CDX N b a ...`` -> ``['N', 'b', 'a', ...]`` (the leading ``CDX`` marker dropped)."""
    parts = layout.split()
    if not parts or parts[0] != "CDX":
        raise ValueError(f"not a CDX layout line: {layout!r}")
    return parts[1:]
