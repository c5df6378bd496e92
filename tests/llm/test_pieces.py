"""Pieces: ids, byte spans and decoded texts are the sentencepiece library's, for its model and for models with compiled character maps."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import pieces, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def strings(alphabet, n, longest, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def assert_same(path, texts):
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    for text in texts:
        want = library.encode(text, return_type="proto").pieces
        ids, begins, ends = own.encode(text.encode())
        assert (ids.tolist(), begins.tolist(), ends.tolist()) == ([p.id for p in want], [p.begin for p in want], [p.end for p in want]), repr(text)
        assert own.decode(ids) == library.decode([p.id for p in want]), repr(text)


def test_the_model_s_own_texts(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 50)
    monkeypatch.setattr(pieces, "LONGEST", 12)
    odd = ["", " ", "  a ", "▁a", "x" * 3000, " " * 100, "é😀" * 50, "<s></s><unk><0x41>", "\x00"]
    assert_same(PATH, odd + strings(" \n\t\r aaBs'é1!<s>▁ 日本.,;ñ😀\x00e​", 1500, 60))


def test_decoding_any_ids():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.PieceModel(PATH), random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(300), 28705, 259]) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("dummy, squeeze, escape, fallback", [(1, 1, 1, 1), (0, 0, 1, 1), (1, 0, 1, 0), (0, 1, 1, 0), (0, 0, 0, 1)])
def test_compiled_character_maps(rule, dummy, squeeze, escape, fallback, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(open(PATH, "rb").read())
    model.normalizer_spec.CopyFrom(pb.NormalizerSpec.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()))
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = bool(dummy), bool(squeeze), bool(escape)
    model.trainer_spec.byte_fallback = bool(fallback)
    if not fallback:
        for p in model.pieces:
            if p.type == 6:
                p.type = 5
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    assert_same(str(path), strings(" \n\t　  aÀàＡｶﾞ㍿①ﬁéÅ각ÄßÇ­​xY▁日\x01", 500, 25))


def test_user_defined_and_unused_pieces(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(open(PATH, "rb").read())
    rng = random.Random(3)
    for i in rng.sample(range(300, 2000), 400):
        model.pieces[i].type = 5
    model.pieces.append(pb.ModelProto.SentencePiece(piece="the a", score=0.0, type=4))
    model.pieces.append(pb.ModelProto.SentencePiece(piece="<x>", score=0.0, type=4))
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    assert_same(str(path), ["the a<x>thethe a then <x <x>"] + strings(["the", " a", "<x>", " ", "in", "er", "ou", "ed ", "<", "s"], 500, 20))


def test_spans_cover_the_text():
    own = pieces.PieceModel(PATH)
    for text in strings("ab é😀\n日", 300, 40, 4):
        raw = text.encode()
        ids, begins, ends = own.encode(raw)
        assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw


def test_invalid_bytes_become_replacements():
    own = pieces.PieceModel(PATH)
    ids, begins, ends = own.encode(b"a\xff\xe2\x96 b")
    assert own.decode(ids) == "a��� b" and ends[-1] == 6


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceModel(str(tmp_path / "m.model"))


def test_the_query(spark, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [None, "", "same text", "same text", "long word " * 30_000, "é日 😀\x00", *strings("abc é", 200, 50, 5)]
    rows = [(None if i == 3 else i, t, 5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op11_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t, _ in rows:
        ids = library.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hexed(",".join(map(str, ids))), hexed(library.decode(ids)))
    some = pieces.encode(spark.read.parquet(str(tmp_path / "documents.parquet")), PATH)
    assert {r["doc_id"]: r["t"] for r in some.select("doc_id", pieces.decoded(some["ids"], PATH).alias("t")).collect()} == {i: t or "" for i, t, _ in rows}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert queries.op11_sentencepiece(spark, str(tmp_path / "e")).collect() == []
