"""capindex: a web-archive capture index on Spark.

CDX lines become a typed capture table (rejects kept aside), stored as Parquet laid out by canonical URL
and time, and queried with plain DataFrame operations.
"""

from .functions import date_math, scheme, surt, time_distance  # noqa: F401
from .operators import *  # noqa: F401,F403
from .schema import CAPTURE_COLUMNS, CAPTURE_SCHEMA, CDX_HEADER  # noqa: F401
from .sources import *  # noqa: F401,F403
from .streaming import ingest_stream  # noqa: F401
