"""Sources and sinks: CDX text, escaped CSV, the Parquet capture store and its ingest job, the test-table
adapter."""

from .cdx import (AUTO, accepted, header_report, ingest_report, new_files, parse_cdx, read_cdx,  # noqa: F401
                  reject_summary, rejected)
from .csvio import from_escaped_lines, read_escaped_csv, to_escaped_lines, write_escaped_csv  # noqa: F401
from .ingest import ingest_files, read_rejects  # noqa: F401
from .store import (commit_upsert, compact, latest_per_key, manifest, read_store, upsert,  # noqa: F401
                    write_layout)
