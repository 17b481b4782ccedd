from almanac.sources.daily import read_archive, read_daily, write_csv, write_daily
from almanac.sources.gridded import read_pairs
from almanac.sources.landing import (
    decode_records,
    json_value,
    read_service_records,
    rejected_bodies,
)
from almanac.sources.versions import ConflictError, VersionedTable

__all__ = [
    "ConflictError",
    "VersionedTable",
    "decode_records",
    "json_value",
    "read_archive",
    "read_daily",
    "read_pairs",
    "read_service_records",
    "rejected_bodies",
    "write_csv",
    "write_daily",
]
