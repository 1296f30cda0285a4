"""Ids and texts against the library that the models belong to."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pagesift.llm import pieces as P
from pagesift.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return P.load(PATH)


def ids_of(model, text):
    return np.frombuffer(model.encode(text), "<i4").tolist()


def texts():
    rng = random.Random(12)
    yield from ["", " ", "a", " a", "a  b", "\n", "▁", "▁▁a", "x▁y", "<s>", "<0x0A>", "<unk> ⁇ ", "a\tb\r\nc",
                "日本語 テスト", "🙂🙂 é", "é", "\u0000a\u0000", "�", "　x"]
    yield from (f"{a}{' ' * k}{b}" for k in range(70) for a in ("", "b", "🙂") for b in ("", "c", "\n", "漢", "🙂"))
    yield from ("=" * k + "a" * k for k in range(80))
    for letters, n in (("aeinst ", 200), ("the. ,(){}[]=_- \n", 60), ("абв ab12 ", 60), ("漢字かな🙂 é\n", 30)):
        yield from ("".join(rng.choice(letters) for _ in range(rng.randint(1, n))) for _ in range(300))


def test_ids_and_texts_of_the_library(library, model):
    for text in texts():
        want = library.encode(text)
        assert ids_of(model, text) == want, text
        assert model.decode(np.array(want, np.int32), np.array([0, len(want)]))[0].decode() == library.decode(want)


def test_random_pieces(library, model):
    rng = random.Random(5)
    spelled = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.vocab_size())]
    for n in (300, len(spelled)):
        for _ in range(1000):
            text = "".join(rng.choice(spelled[:n]) for _ in range(rng.randint(1, 30)))
            assert ids_of(model, text) == library.encode(text), text


def test_long_words(library, model):
    rng = random.Random(6)
    for text in ("aeinst" * 5000, "".join(rng.choice("aeinrst") for _ in range(30000)), " " * 30000 + "x",
                 "a" * 30000, "=" * 30001):
        assert ids_of(model, text) == library.encode(text)


def test_any_ids_decode_as_in_the_library(library, model):
    rng = random.Random(7)
    lists = [[rng.choice([rng.randrange(3), rng.randrange(3, 259), rng.randrange(259, 32000), 259])
              for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    offsets = np.cumsum([0, *map(len, lists)])
    got = model.decode(np.array([i for x in lists for i in x], np.int32), offsets)
    assert [g.decode() for g in got] == [library.decode(x) for x in lists]


def test_words_are_forgotten_but_not_their_ids(library, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 8)
    monkeypatch.setattr(P, "PAIRS", 8)
    model = P.Pieces(PATH)
    text = "Words are encoded one by one and remembered, up to a number of them. " * 3
    assert ids_of(model, text) == library.encode(text)
    assert len(model.known) <= 8 and len(model.pairs) <= 8


def test_merge_in_both_ways(model):
    rng = random.Random(8)
    for _ in range(300):
        symbols = [rng.choice("▁aenrst") for _ in range(rng.randint(1, 40))]
        assert P.merge(symbols, model.rank) == P.merge([*symbols, *["\n"] * 80], model.rank)[:-80]


def test_query(spark, documents, library):
    got = {tuple(r) for r in QUERIES["op12_backtracking_pieces"](spark, "/root/testdata/sf0.001").collect()}
    want = set()
    for r in documents.collect():
        ids = library.encode(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == want


def test_odd_rows(spark, edges, empty, library):
    rows = P.decode(P.encode(edges).withColumn("a.b", P.F.lit(1))).collect()
    want = sorted((str(r.doc_id), library.encode(r.text or "")) for r in edges.collect())
    assert sorted((str(r.id), r.ids) for r in rows) == want
    assert all(r.decoded == library.decode(r.ids) and r["a.b"] == 1 for r in rows)
    assert P.decode(P.encode(empty)).count() == 0
    lists = spark.createDataFrame([(1, [259, 260]), (2, None), (3, [])], "k int, tokens array<int>")
    assert {r.k: r.decoded for r in P.decode(lists, "tokens").collect()} == {1: library.decode([259, 260]), 2: "", 3: ""}


def test_refused_models(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    for change in ("model.trainer_spec.model_type = 1", "model.normalizer_spec.remove_extra_whitespaces = True",
                   "model.pieces[300].type = 4", "model.pieces[300].piece = 'a▁b'"):
        other = sentencepiece_model_pb2.ModelProto()
        other.CopyFrom(model)
        exec(change, {"model": other})
        path = tmp_path / "m.model"
        path.write_bytes(other.SerializeToString())
        with pytest.raises(ValueError):
            P.Pieces(str(path))
