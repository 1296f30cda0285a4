"""URL columns: normalising and validating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import strip

_LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?"
HOST = rf"^(?:{_LABEL}\.)+[a-zA-Z]{{2,}}$"
SCHEME = "^https?://"


def normalize_url(c: Column | str) -> Column:
    """Trim and prefix ``https://`` unless a (lower-case) http scheme is there."""
    url = strip(c)
    return F.when(url.rlike(SCHEME), url).otherwise(F.concat(F.lit("https://"), url))


def is_valid_url(c: Column | str) -> Column:
    """True if the host is dotted labels ending in letters.

    The host is what stands before the first colon of the authority, so
    ``user@host`` and IP addresses are invalid, as is a blank cell or a null.
    ``parse_url`` would drop the user part and call the former valid.
    """
    # URL splitting ignores these three control characters wherever they stand.
    url = F.translate(normalize_url(c), "\t\r\n", "")
    authority = F.regexp_extract(url, SCHEME + "([^/?#]*)", 1)
    host = F.substring_index(authority, ":", 1)
    return F.coalesce((strip(c) != "") & host.rlike(HOST), F.lit(False))

