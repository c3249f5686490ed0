"""SNK8: results of several tables are replaced as a whole."""

import pytest

from cobi.plans.runs import write_pair
from cobi.sources.publish import current, publish, published


class Lost(Exception):
    pass


def test_a_reader_sees_the_old_or_the_new_result(spark, tmp_out):
    root = tmp_out + "/pair"
    assert published(spark, root) is None
    with pytest.raises(FileNotFoundError):
        current(spark, root)

    def write(n, fail_after=None):
        def run(folder):
            for k, name in enumerate(("edges", "labels")):
                spark.createDataFrame([(n,)], "n int").write.parquet(f"{folder}/{name}")
                if fail_after == k:
                    raise Lost
        return run

    def seen():
        return {spark.read.parquet(f"{current(spark, root)}/{name}").first().n for name in ("edges", "labels")}

    publish(spark, root, write(1))
    assert seen() == {1}
    for stop in (0, 1):       # between the tables, and between the last one and the manifest
        with pytest.raises(Lost):
            publish(spark, root, write(2, stop))
        assert seen() == {1}
    publish(spark, root, write(3))
    assert seen() == {3} and published(spark, root)[0] == 1


def test_pair_directories_are_replaced_as_a_whole(spark, tmp_out, monkeypatch):
    edges = lambda w: spark.createDataFrame([("a", "b", w)], "first_field string, second_field string, weight double")
    labels = spark.createDataFrame([("row", "a", 0), ("column", "b", 1)], "side string, node string, cluster_no int")
    where = (tmp_out, 1, "A", "x", "B", "y")
    read = lambda out: spark.read.option("sep", "\t").option("header", True).csv(
        f"{current(spark, out)}/edgelist").first().Weight
    out = write_pair(*where, edgelist=edges(1.0), labels=labels)
    assert read(out) == "1.0"

    def lost(*args):
        raise Lost
    with monkeypatch.context() as m:
        m.setattr("cobi.sources.sinks.write_labels", lost)
        with pytest.raises(Lost):
            write_pair(*where, edgelist=edges(2.0), labels=labels)
    assert read(out) == "1.0"
    assert spark.read.option("header", True).csv(f"{current(spark, out)}/labels_row").count() == 1
    assert write_pair(*where, edgelist=edges(3.0)) == out and read(out) == "3.0"
