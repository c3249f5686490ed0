import zlib

import numpy as np
import pytest

from cobi.llm.shards import query, read_from, shards, write_shards
from cobi.llm.tokens import Encoder
from tests.conftest import SF_SMALL, table


def expected(rows, length):
    enc, out = Encoder().tokenizer, []
    for i, t in rows:
        ids = enc.encode(t or "", add_special_tokens=False).ids + [1]
        out += [(i, k // length, tuple(ids[k:k + length])) for k in range(0, len(ids), length)]
    return sorted(out, key=str)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    got = query(spark, SF_SMALL).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    want = sorted((i, k, len(x), zlib.crc32(np.array(x, "<u2").tobytes())) for i, k, x in expected(rows, 1024))
    assert sorted((r.doc_id, r.piece, r.n_ids, r.ids_crc32) for r in got) == want
    assert all(r.shard == r.slot // 2048 and r.byte_offset == r.slot % 2048 * 2048 for r in got)
    # the order is not that of the ids
    order = [r.doc_id for r in sorted(got, key=lambda r: r.slot)]
    assert np.corrcoef(order, np.arange(len(order)))[0, 1] < 0.5


def test_files_and_resumed_reading(spark, tmp_out):
    rows = [(1, None), (2, ""), (3, "one two " * 40), (3, "one two " * 40), (None, "no id"), (5, "x" * 500)]
    docs = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, shard int").repartition(2)
    write_shards(docs, tmp_out, length=16, per_shard=4)
    want = expected(rows, 16)
    got = list(read_from(spark, tmp_out))
    assert [s for s, _ in got] == list(range(len(want)))
    assert sorted(tuple(np.frombuffer(b, "<u2").tolist()) for _, b in got) == sorted(x for _, _, x in want)
    assert list(read_from(spark, tmp_out, 6)) == got[6:]
    for r in spark.read.parquet(tmp_out).collect():
        assert len(r.payload) == r.n_slots * 32 and r.n_slots <= 4


def test_key_and_empty_table(spark):
    docs = spark.createDataFrame([(k, f"t {k}") for k in range(50)], "doc_id long, text string")
    one, two = ([r.doc_id for r in shards(docs, key=k).orderBy("shard").collect()] for k in (1, 2))
    assert one != two
    assert shards(docs.limit(0)).count() == 0


@pytest.mark.parametrize("remembered", [3, 10**6])
def test_encoder_forgets(monkeypatch, remembered):
    monkeypatch.setattr("cobi.llm.tokens.REMEMBERED", remembered)
    e = Encoder()
    for t in ("a b c d", "d e f", "a é"):
        data = np.frombuffer(t.encode(), np.uint8)
        ids, limits = e.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [1] and limits.tolist() == [0, len(ids)]
