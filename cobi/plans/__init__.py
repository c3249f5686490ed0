"""End-to-end runs (pair selection, sweeps, clustering, output layout) and the
registered query catalogue used by ``__spark_entry__``."""
