"""SQL fragments shared by the DuckDB oracles (same semantics as the Spark code)."""

# The missing-value tokens of ``cobi.functions.clean`` written as
# DuckDB literals (backslash is literal in standard SQL strings; chr(10) is a
# newline).
MISSING_SQL = "('\\N', '\\n', chr(10), ' ', 'n/a', 'na', 'none')"
MARGIN_SQL = r"'(?m)^[\x00-\x09\x0b-\x20]*\|'"


def keep(col: str) -> str:
    """FLT4 in SQL: present and not a missing token."""
    return (f"({col} IS NOT NULL AND regexp_replace(lower(CAST({col} AS VARCHAR)), "
            f"{MARGIN_SQL}, '', 'g') NOT IN {MISSING_SQL})")


def long_key(col: str, min_key: int) -> str:
    """FLT1-3 in SQL for a string key."""
    return (f"(regexp_full_match(CAST({col} AS VARCHAR), '^[+-]?[0-9]+$') "
            f"AND try_cast(CAST({col} AS VARCHAR) AS BIGINT) >= {min_key})")


def edges_sql(a_sql: str, b_sql: str) -> str:
    """Edge list from two (key, node) relations: count of matching record pairs."""
    return (f"SELECT a.node AS first_field, b.node AS second_field, "
            f"CAST(count(*) AS DOUBLE) AS weight FROM ({a_sql}) a JOIN ({b_sql}) b "
            f"ON a.key = b.key GROUP BY a.node, b.node")


def side_sql(table: str, key: str, node: str, min_key: int, string_key: bool = False,
             where: str = "TRUE") -> str:
    if string_key:
        kexpr = f"CAST({key} AS VARCHAR)"
        kcond = long_key(key, min_key)
    else:
        kexpr = f"CAST({key} AS BIGINT)"
        kcond = f"{key} IS NOT NULL AND {key} >= {min_key}"
    return (f"SELECT {kexpr} AS key, CAST({node} AS VARCHAR) AS node FROM {table} "
            f"WHERE {kcond} AND {keep(node)} AND ({where})")
