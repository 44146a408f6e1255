import random

import public_tokenizers
import pytest
import tiktoken

import cases
import corpus_pipeline
from tapelake.llm import byte_bpe
from tapelake.session import written


def tables(spark, folder, seed=11):
    rng = random.Random(seed)
    bench = [(i, " ".join(cases.words(rng, 15, 10**6))) for i in range(6)]
    rows, labels = [], []
    for i in range(700):
        w = cases.words(rng, rng.randrange(30, 90), 3000)
        kind = i % 10
        if kind < 3:
            w[rng.randrange(len(w))] = rng.choice(["blorkish", "blorkishly", f"blorkish{i}"])
        if kind == 4:
            w += bench[i % 6][1].upper().split()
        lines = [" ".join(w[:20]), "the same footer", " ".join(w[20:])] if kind != 5 else [" ".join(w)]
        rows.append((i, "\n".join(lines), "en", "hot" if i % 3 else "b", 0))
        labels.append((i, 1, int(kind < 3)))
    rows += [(1000 + i, rows[i][1] + " tail", "en", "b", 0) for i in range(6, 700, 10)]
    rows += [(2000 + i, t, *rest) for i, (_, t, *rest) in enumerate(cases.odd_rows())]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    cases.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return rows, bench


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    return path, *tables(spark, path)


def test_stages_take_effect(spark, folder):
    path, rows, bench = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, path), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r["doc_id"]: r for r in docs.collect()})
    first, second, third, fourth = seen
    toxic = {r[0] for r in rows if "blork" in (r[1] or "")}
    assert len(toxic & set(first)) <= 0.05 * len(toxic) and len({r[0] for r in rows} - toxic - set(first)) <= 0.02 * len(rows)
    assert set(second) == set(first) and not any("same footer" in (r["text"] or "") for r in second.values() if r["source"] in ("hot", "b"))
    assert all(r["n_chars"] in (None, 0, len(r["text"] or "")) or r["text"] == first[i]["text"] for i, r in second.items())
    copies = {1000 + i: i for i in range(6, 700, 10)}
    assert not [c for c, i in copies.items() if c in third and i in third]
    assert {i for i in second if 2003 <= i <= 2005} <= set(third)  # empty sets stay
    planted = {r[0] for r in rows if r[0] < 700 and r[0] % 10 == 4}
    assert not planted & set(fourth) and set(third) - set(fourth) <= planted
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    pieces = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    assert {r["doc_id"]: r["n_tokens"] for r in last} == {i: len(reference.encode_ordinary(r["text"] or "")) for i, r in fourth.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, last))


def test_stages_on_clashing_columns_and_no_rows(spark, folder):
    path, rows, _ = folder
    for docs in (cases.clashing(cases.frame(spark, rows[:40] + rows[-16:])), cases.frame(spark, [])):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, path), f"test-{name}")
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
