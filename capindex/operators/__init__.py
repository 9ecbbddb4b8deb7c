"""Query operators over a captures DataFrame: filters, lookups, paging, closest capture, aggregations."""

from .facets import capture_calendar, distinct_urls, facet, first_per_digest, group_summary, hit_count  # noqa: F401
from .lookup import (chunk_plan, closest, closest_capture, export, lookup_many, page_after,  # noqa: F401
                     random_capture, random_order, search)
from .predicates import match, match_condition  # noqa: F401
from .api import cdx_search, convert_cdx  # noqa: F401
