import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tapelake.llm import byte_bpe, piece_bpe
import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return piece_bpe.read_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_digests_as_the_library(spark, model, library):
    rows = cases.odd_rows() + [(20 + i, t, "", "", 0) for i, t in enumerate((
        "<s> </s> <0x41> <unk>", " " * 3000 + "x", "▁a▁ ▁b", "é ‍ ﻿", "\x00\n\r\n", "x" * 9999 + " 0123", "=" * 501, "\n\n\n"))]
    df = cases.clashing(cases.frame(spark, rows))
    got = sorted(map(tuple, piece_bpe.digests(df, model).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_random_texts_as_the_library(model, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEEP", 50)  # memories overflow
    rng, encoder = random.Random(1), piece_bpe.Encoder(model)
    pieces = list(encoder.ids)
    for _ in range(1500):
        kind = rng.randrange(3)
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 8))) if kind == 0 else \
            "".join(rng.choice("ab ▁ntheris,.éß漢\n\t😀") for _ in range(rng.randrange(40))) if kind == 1 else \
            rng.choice(" aeh=-.#") * rng.randrange(100) + rng.choice(pieces)
        assert encoder.encode(text) == np.array(library.encode(text), "<u4").tobytes(), text


def test_each_prefix_has_one_last_piece(model, library):
    """Of the pieces that end a prefix exactly one is compatible with the piece before it."""
    encoder, text = piece_bpe.Encoder(model), "▁unbelievableness"
    last = {0: None}
    for end in range(1, len(text) + 1):
        fits = [(i, n) for at, (i, n) in encoder.automaton.iter(text[:end]) if at + 1 == end
                and (n == end or encoder.compatible(last[end - n], i))]
        assert len(fits) == 1
        last[end] = fits[0][0]
        assert library.encode(text[1:end])[-1:] == ([last[end]] if end > 1 else [])


def test_columns_pass_and_large_results_are_cut(spark, model, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CHUNK", 10)
    df = cases.clashing(cases.frame(spark, cases.odd_rows())).drop("ids")
    out = piece_bpe.encode(df, model)
    assert out.columns == [*df.columns, "ids"] and out.count() == df.count()


def test_a_model_without_byte_pieces(spark):
    """The unknown id, once for a run of unknown characters."""
    pieces = [b"a", b"b", b"ab"]
    own = byte_bpe.model_bytes(pieces)
    encoder, other = piece_bpe.Encoder(own), sentencepiece.SentencePieceProcessor(model_proto=own)
    for text in ("", byte_bpe.mapped(b"abba"), "??" + byte_bpe.mapped(b"ab") + "?", "xyz"):
        assert encoder.encode(text) == np.array(other.encode(text), "<u4").tobytes()


def test_empty_table(spark, model):
    assert piece_bpe.digests(cases.frame(spark, []), model).collect() == []


def test_compatible_pairs_merge_to_themselves(model):
    rng, encoder = random.Random(4), piece_bpe.Encoder(model)
    names = {i: p for p, i in encoder.ids.items()}
    known = sorted(encoder.steps)
    short = [i for i in known if len(names[i]) < 4]
    found = set()
    for _ in range(6000):
        a, b = rng.choice(rng.choice([known, short])), rng.choice(rng.choice([known, short]))
        found.add(encoder.compatible(a, b))
        parts, _ = encoder.merges(names[a] + names[b])
        assert encoder.compatible(a, b) == (parts == [names[a], names[b]]), (names[a], names[b])
    assert found == {True, False}
