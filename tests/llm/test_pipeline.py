import re

import corpus_pipeline
from corpus_pipeline import STAGES, run
from cobi.llm.pii import Pseudonyms, KEY
from tests.conftest import SF_SMALL, table
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_minmax_dedup import brute as groups
from tests.llm.test_packing import check


def chained(spark, docs, sf_dir, root):
    """Each stage's table, written and read again."""
    out = [docs]
    for name, stage in STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(f"{root}/{name}")
        out.append(spark.read.parquet(f"{root}/{name}"))
    return out


def test_stages_equal_brute_force(spark, tmp_out):
    docs = table(spark, "documents")
    raw, good, single, clean, private, packed = chained(spark, docs, SF_SMALL, tmp_out)
    assert [n for n, _ in STAGES] == ["quality", "near_dedup", "benchmark", "pii", "packing"]
    for t in (good, single, clean, private):
        assert t.dtypes == docs.dtypes
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = text(good)
    assert text(raw).items() >= before.items()
    want = groups(before.items(), percent=80)
    assert text(single) == {i: t for i, t in before.items() if want[i][1] == i}
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    after = text(clean)
    assert not any(r[-1] for r in hits(after.items(), items))
    for i, _, n_hit, *_, contaminated in hits(text(single).items(), items):
        assert contaminated or after[i] == text(single)[i] if i in after else contaminated
    names = Pseudonyms(KEY)
    assert text(private) == {i: names.replace(t)[0] for i, t in after.items()}
    assert all(r.n_chars == len(r.text) for r in private.collect())
    check(packed.collect(), list(text(private).items()), 4096)


def test_run_equals_the_chain(spark, tmp_out):
    chain = chained(spark, table(spark, "documents"), SF_SMALL, tmp_out)[-1]
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(run(spark, SF_SMALL)) == key(chain)


def test_edge_rows(spark, tmp_out):
    rows = [(1, None, None, "s", 0, 1), (2, "", "en", None, 0, 2), (None, "no id 988-555-2485", "en", "s", None, 3),
            (4, "one two three four five six", "en", "s", 0, 4), (5, "one two three four five six", "en", "s", 0, 5),
            (5, "one two three four five six", "en", "s", 0, 5), (6, "long " * 9000, "en", "s", 0, 6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, {} long"
    for k, extra in enumerate(("component_id", "_u", "kept")):
        docs = spark.createDataFrame(rows, schema.format(extra))
        tables = chained(spark, docs, SF_SMALL, f"{tmp_out}/{k}")
        assert all(t.columns == docs.columns for t in tables[:-1])
        assert sorted((r.doc_id or 0) for r in tables[2].collect()) == [0, 1, 2, 4, 6]
        assert not re.search("988-555-2485", str(tables[4].collect()))
    empty = chained(spark, docs.limit(0), SF_SMALL, f"{tmp_out}/empty")
    assert [t.count() for t in empty] == [0] * 6
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_dedup_goes_by_a_similarity_of_80(spark):
    rows = []
    for k, (n, changed) in enumerate([(49, [20]), (100, [30, 60]), (100, [30, 50, 70]), (100, [50]), (48, [20])]):
        w = [f"w{k}x{i}" for i in range(n)]     # 0.80, 0.81, 0.73, 0.90, 0.796
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join("new" if i in changed else x for i, x in enumerate(w)))]
    rows += [(100 + r.doc_id, r.text) for r in table(spark, "documents").collect()]
    want = groups(rows, percent=80)
    assert [i for i in range(10) if want[i][1] != i] == [1, 3, 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF_SMALL).collect()} == {
        i for i, _ in rows if want[i][1] == i}
