"""Command line: ``python -m cobi PAIRS ROOT OUT [clusters [row_cap [pair_no]]]``.

PAIRS is a pair list, ROOT the folder of the tables, OUT where the field pairs'
directories go.  The options are the reference's, with its defaults for the
number of clusters and the pair number; the row cap is off unless given.
"""

from __future__ import annotations

import argparse

from cobi.plans.runs import DEFAULT_CLUSTERS, DEFAULT_PAIR_NO, run_pair_to_files
from cobi.session import get_session
from cobi.sources.pairs import read_pairs
from cobi.sources.tables import TableResolver


def main(argv: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(prog="cobi", description="Cluster the field pairs of one pair of tables.")
    p.add_argument("pairs")
    p.add_argument("root")
    p.add_argument("out")
    p.add_argument("clusters", nargs="?", type=int, default=DEFAULT_CLUSTERS)
    p.add_argument("row_cap", nargs="?", type=int, default=None, help="first rows of table B that are read")
    p.add_argument("pair_no", nargs="?", type=int, default=DEFAULT_PAIR_NO)
    p.add_argument("--data", default=TableResolver.data_pattern, help="pattern of a table's path")
    p.add_argument("--desc", default=None, help="pattern of a description file's path")
    p.add_argument("--edges-only", action="store_true")
    a = p.parse_args(argv)
    spark = get_session()
    return run_pair_to_files(spark, read_pairs(spark, a.pairs), TableResolver(a.root, a.data, a.desc), a.out,
                             a.pair_no, k=None if a.edges_only else a.clusters, limit_b=a.row_cap)


if __name__ == "__main__":
    print("\n".join(main()))
