"""Column expressions: key/value cleaning predicates and small vector helpers.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it runs JVM-side inside whole-stage codegen.
"""

from cobi.functions.clean import (MISSING_TOKENS, is_long_key, is_missing_token,
                                  keep_node, remove_whitespace, resolve_column,
                                  strip_margin, type_is_string)
from cobi.functions.vectors import (const_vector, embedding_width, hadamard,
                                    log2, prefix, scale, vector_sum)

__all__ = [
    "MISSING_TOKENS", "is_long_key", "is_missing_token", "keep_node",
    "remove_whitespace", "resolve_column", "strip_margin", "type_is_string",
    "const_vector", "embedding_width", "hadamard", "log2", "prefix", "scale",
    "vector_sum",
]
