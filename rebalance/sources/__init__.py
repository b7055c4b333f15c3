from rebalance.sources.keel import (
    KeelSchema,
    format_rows,
    parse_header,
    read_keel,
    read_keel_header,
    read_keel_rejects,
    rejects,
    well_formed,
    write_balanced,
)

__all__ = [
    "KeelSchema",
    "format_rows",
    "parse_header",
    "read_keel",
    "read_keel_header",
    "read_keel_rejects",
    "rejects",
    "well_formed",
    "write_balanced",
]
