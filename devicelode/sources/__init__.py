"""Readers and writers of the catalogue's files."""

from devicelode.sources.keyed import (  # noqa: F401
    ConcurrentWrite, compact, create_keyed, read_keyed, upsert_keyed,
)
from devicelode.sources.readers import (  # noqa: F401
    read_access_keys, read_brand_snapshot, read_catalogue, read_ledger, read_pages, read_specs,
)
from devicelode.sources.sinks import (  # noqa: F401
    append_rows, overwrite_swap, preview, read_current, serialise_specs, write_brand_snapshot,
)
