import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tapelake.llm import byte_bpe, common, set_join
import cases


@pytest.fixture(scope="module")
def pieces():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(pieces):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)},
                             special_tokens={})


def test_round_trip_as_the_rank_library(spark, pieces, reference):
    rows = cases.odd_rows() + [(20 + i, t, "", "", 0) for i, t in enumerate((
        "it's 'S I'LL 'll", " " * 3000 + "x", "\x1c\x1d \x85\xa0 a", "<|endoftext|>", "é ‍", "\x00\n\r\n", "x" * 9999 + " 0123"))]
    df = cases.clashing(cases.frame(spark, rows))
    got = sorted(map(tuple, byte_bpe.digests(df, pieces, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_columns_pass_and_large_results_are_cut(spark, pieces, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 10)
    df = cases.clashing(cases.frame(spark, cases.odd_rows())).drop("ids")
    out = byte_bpe.encode(df, pieces, public_tokenizers.PATTERN)
    assert out.columns == [*df.columns, "ids"] and out.count() == df.count()


def test_round_trip_is_encode_and_decode_in_one_worker(spark, pieces):
    df = cases.frame(spark, cases.odd_rows())
    both = byte_bpe.decode(byte_bpe.encode(df, pieces, public_tokenizers.PATTERN), pieces)
    once = byte_bpe.round_trip(df, pieces, public_tokenizers.PATTERN)
    assert once.columns == both.columns
    assert sorted(map(repr, once.collect())) == sorted(map(repr, both.collect()))
    plan = byte_bpe.digests(df, pieces, public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_idle_workers_remember_nothing(spark, pieces):
    docs = cases.frame(spark, cases.odd_rows())
    set_join.clusters(docs).collect()
    byte_bpe.digests(docs, pieces, public_tokenizers.PATTERN).collect()
    model = byte_bpe.model_bytes(pieces)

    def remembered(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common.HASHES) + len(byte_bpe._encoder(model, public_tokenizers.PATTERN))])], ["n"])
    assert {r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(remembered, "n long").collect()} == {0}


def test_empty_table(spark, pieces):
    assert byte_bpe.digests(cases.frame(spark, []), pieces, public_tokenizers.PATTERN).collect() == []


def test_ranks_must_be_whole(tmp_path):
    (tmp_path / "r").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(tmp_path / "r"))
