"""Readers (tables, pair lists, field descriptions) and writers (edges, labels,
embeddings, indexed tables)."""

from cobi.sources.describe import (field_pairs, read_description, string_fields,
                                   string_fields_of)
from cobi.sources.pairs import parse_pairs, read_pairs, select_pair
from cobi.sources.publish import current, publish, published
from cobi.sources.tables import TableResolver, read_table, read_tsv, read_tsv_checked

__all__ = [
    "field_pairs", "read_description", "string_fields", "string_fields_of",
    "parse_pairs", "read_pairs", "select_pair", "TableResolver", "read_table",
    "read_tsv", "read_tsv_checked", "current", "publish", "published",
]
