from .delimited import (
    drop_embedded_headers,
    load_observations,
    read_delimited,
    read_stage,
    read_yearly,
    rename_positional,
    write_stage,
)
from .schemas import SOURCES, Source

__all__ = [
    "SOURCES", "Source", "drop_embedded_headers", "load_observations", "read_delimited",
    "read_stage", "read_yearly", "rename_positional", "write_stage",
]
