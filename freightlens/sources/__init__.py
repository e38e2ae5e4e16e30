"""Scans and loaders (S1-S5) plus the test-table derivations."""

from .shipments import (  # noqa: F401
    canonical_names,
    coerce_types,
    load_shipments,
    read_dictionary,
    read_shipments,
)
