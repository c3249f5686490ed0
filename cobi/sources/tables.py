"""Table sources (SRC3) and the table-name resolver (SRC4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

#: column of a whole line that does not fit the table
CORRUPT = "_corrupt_record"


def read_tsv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True, quote: str | None = None,
             null_value: str | None = None) -> DataFrame:
    """SRC3: tab-separated table with a header line, read permissively.

    Without ``schema`` the types are inferred (one extra pass over the file,
    as in the reference); pass a schema on large inputs to skip it.  Quoting is
    off by default (``quote=None``) so double quotes and leading blanks stay
    part of the value; ``quote=' '`` reproduces the reference's setting.
    ``null_value`` names a token the reader turns into null; by default only
    empty fields become null, and tokens such as ``\\N`` stay strings so the
    node filter (FLT4) sees them.
    """
    reader = (spark.read.option("header", header).option("sep", "\t")
              .option("mode", "PERMISSIVE")
              .option("quote", "\u0000" if quote is None else quote))
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


# Type names with what a value has to look like, and the cast that must hold.
# Tried in this order; a column takes the first type that all its values fit.
_TYPES = {
    "bigint": r"^[+-]?[0-9]{1,19}$",
    "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$",
    "boolean": r"^(?i)(true|false)$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
}


@dataclass(frozen=True)
class CheckedTable:
    """A text table read in two passes: what fits, with types, and what does not."""

    good: DataFrame        # typed rows
    bad: DataFrame         # (line): lines with too few or too many fields
    n_good: int
    n_bad: int
    types: dict[str, str]


def _fits(c: Column, kind: str) -> Column:
    # nulls, and the values of damaged lines, do not decide a type
    fits = F.when(c.isNotNull(), c.rlike(_TYPES[kind]) & c.try_cast(kind).isNotNull())
    return F.coalesce(F.bool_and(fits), F.lit(False))


def read_tsv_checked(spark: SparkSession, path: str, columns: list[str] | None = None, *, header: bool = True,
                     quote: str | None = None) -> CheckedTable:
    """SRC3 for files that may be damaged: lines whose number of fields is not
    the table's are set aside and counted instead of being padded or cut, and
    the types are inferred over the kept rows alone, in the same single pass
    that counts.  ``columns`` names the fields of a table without a header line
    (from its description file, say)."""
    reader = (spark.read.option("sep", "\t").option("mode", "PERMISSIVE").option("header", header)
              .option("quote", "\u0000" if quote is None else quote)
              .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False))
    names = columns or reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    # Spark reads the line column only beside others: nothing of the first field is added
    nothing = F.coalesce(F.substring(F.col(f"`{names[0]}`"), 1, 0), F.lit(""))
    lines = reader.schema(schema).csv(path).withColumn(CORRUPT, F.concat(F.col(CORRUPT), nothing))
    kept = F.col(CORRUPT).isNull()
    value = lambda n: F.when(kept, F.col(f"`{n}`"))
    tests = [_fits(value(n), kind).alias(f"{i} {kind}") for i, n in enumerate(names) for kind in _TYPES]
    found = lines.agg(F.count_if(kept).alias("good"), F.count_if(~kept).alias("bad"), *tests).first()
    types = {n: next((kind for kind in _TYPES if found[f"{i} {kind}"]), "string") for i, n in enumerate(names)}
    good = lines.where(kept).select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in types.items()])
    bad = lines.where(~kept).select(F.col(CORRUPT).alias("line"))
    return CheckedTable(good, bad, found["good"], found["bad"], types)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **tsv_options) -> DataFrame:
    """Read a table by format: parquet (default for ``.parquet`` paths and
    directories of parquet files) or TSV."""
    if fmt is None:
        fmt = "tsv" if path.endswith((".tsv", ".txt", ".csv")) else "parquet"
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "tsv":
        return read_tsv(spark, path, **tsv_options)
    return spark.read.format(fmt).load(path)


@dataclass(frozen=True)
class TableResolver:
    """SRC4: map a table name (as written in a pair list) to its data and its
    field description.

    ``data_pattern`` and ``desc_pattern`` are format strings over ``root`` and
    ``table`` (the upper-cased name) / ``lower`` (the lower-cased name).  The
    defaults fit the test data (``{root}/{lower}.parquet``); the reference's
    layout is ``{root}/{table}/000000_combine.tsv`` with ``{root}/{table}/desc.txt``.
    Without a description file the field list comes from the table schema.
    """

    root: str
    data_pattern: str = "{root}/{lower}.parquet"
    desc_pattern: str | None = None
    fmt: str | None = None

    def data_path(self, table: str) -> str:
        return self.data_pattern.format(root=self.root, table=table.upper(), lower=table.lower())

    def desc_path(self, table: str) -> str | None:
        if self.desc_pattern is None:
            return None
        return self.desc_pattern.format(root=self.root, table=table.upper(), lower=table.lower())

    def table(self, spark: SparkSession, table: str) -> DataFrame:
        return read_table(spark, self.data_path(table), self.fmt)
