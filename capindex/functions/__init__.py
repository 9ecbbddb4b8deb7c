"""Column expressions: CDX cells, URL canonical form, time."""

from .cdx import (capture_id, escape_cell, nullify, parse_offset, parse_response, parse_timestamp,  # noqa: F401
                  path_of, sdomain_of, split_escaped_line, split_url, tokenise)
from .surt import reverse_host, scheme, surt  # noqa: F401
from .time import date_math, partial_range, time_distance, ts14  # noqa: F401
