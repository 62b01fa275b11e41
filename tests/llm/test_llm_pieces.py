"""SentencePiece encoding against the library: ids, spans, decoded texts, character maps."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from llm_cases import documents
from shelfgap.llm import piece_codec as pc
from shelfgap.llm.queries import op13_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "▁x ▁▁ y", "\0a\0 b", "\n\t x\r\n", "文字 \U0001F600 ok é", "a" * 500, " " * 77 + "x", " x ",
         "<s> </s> <0x0A>", "ﬁ ㍿ À ｶﾞ 　¨"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return pc.Codec(open(PATH, "rb").read())


def noise(n, seed=3):
    pick = random.Random(seed)
    return ["".join(pick.choice("ab ▁é文\U0001F600\n\0xyz  the ﬁÀ") for _ in range(pick.randint(1, 60)))
            for _ in range(n)]


def test_ids_spans_and_texts_equal_the_library(library, codec):
    for text in TEXTS + noise(500):
        ids, starts, ends = codec.encode(text)
        assert ids.tolist() == library.encode(text), text
        proto = library.encode(text, return_type="proto")
        assert [(p.begin, p.end) for p in proto.pieces] == list(zip(starts.tolist(), ends.tolist())), text
        assert codec.decode(ids) == library.decode(ids.tolist()), text


def test_any_ids_decode_as_in_the_library(library, codec):
    pick = random.Random(5)
    for _ in range(3000):
        ids = [pick.choice([0, 1, 2, pick.randint(3, 258), pick.randint(3, 258), pick.randint(259, 31999)])
               for _ in range(pick.randint(0, 8))]
        assert codec.decode(ids) == library.decode(ids), ids
    with pytest.raises(ValueError):
        codec.decode([32000])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("remove", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
def test_character_maps_and_their_alignment_equal_the_library(rule, remove, dummy):
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy,
                                                remove_extra_whitespaces=remove, escape_whitespaces=True)
    model = pb.ModelProto()
    model.ParseFromString(own.serialized_model_proto())
    ours = pc.Normaliser(model.normalizer_spec.precompiled_charsmap, dummy, remove, True)
    for text in [t for t in TEXTS if t] + noise(300, 4):
        seen, source = ours(text)
        expected, chars = own.normalize(text, with_offsets=True)
        place = [len(text[:i].encode()) for i in range(len(text) + 1)]
        assert seen == expected
        assert source.tolist() == [place[i] for i in chars], text


def test_a_full_memo_forgets_and_goes_on(monkeypatch, library):
    monkeypatch.setattr(pc, "MEMO_WORDS", 30)
    own = pc.Codec(open(PATH, "rb").read())
    for k in range(8):
        text = " ".join(f"word{i} wörd" for i in range(20 * k, 20 * k + 20))
        assert own.encode(text)[0].tolist() == library.encode(text)
        assert len(own.words.place) <= 30 + 22


def test_long_words_are_merged_by_themselves(library, codec):
    pick = random.Random(8)
    for n in (pc.LONG_CHARS - 1, pc.LONG_CHARS, pc.LONG_CHARS + 1, 5000):
        text = "x " + "".join(pick.choice("abcé文\U0001F600the") for _ in range(n)) + " end"
        ids, starts, ends = codec.encode(text)
        assert ids.tolist() == library.encode(text)
        assert ends[-1] == len(text.encode()) and (starts[1:] == ends[:-1]).all()


def test_awkward_rows_and_clashing_names(spark, library):
    docs = documents(spark)
    encoded = pc.encode(docs, PATH)
    assert encoded.columns == [*docs.columns, "ids", "starts", "ends"]
    again = encoded.withColumn("n", encoded["ids"])
    got = pc.decode(again, PATH, ids="n").collect()
    assert len(got) == docs.count()
    for r in got:
        text = r["text"] or ""
        assert list(r["ids"]) == library.encode(text)
        assert r["decoded"] == library.decode(list(r["ids"]))
        assert (r["ends"][-1] if r["ends"] else 0) == len(text.encode())
    assert "text" not in pc.encode(docs, PATH, keep_text=False).columns
    with pytest.raises(ValueError):
        pc.encode(docs.withColumnRenamed("key", "ids"), PATH)
    with pytest.raises(ValueError):
        pc.decode(encoded.withColumnRenamed("n", "decoded"), PATH)


def test_empty_table_and_null_ids(spark, library):
    docs = documents(spark).limit(0)
    assert pc.decode(pc.encode(docs, PATH), PATH).count() == 0
    ids = library.encode("The quick")
    rows = spark.createDataFrame([(1, None), (2, []), (3, [ids[0], None, *ids[1:]])], "n int, ids array<int>")
    assert [r["decoded"] for r in pc.decode(rows, PATH).orderBy("n").collect()] == ["", "", "The quick"]


def test_query_equals_the_library(spark, library):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in
             spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op13_pieces(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(library.decode(ids))
