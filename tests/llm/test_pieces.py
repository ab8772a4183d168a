import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401

from graphloom.llm import pieces
from graphloom.llm.queries import QUERIES

ODD = ["a", "e", " ", "  ", "\n", "\t", "\x00", "▁", "<s>", "</s>", "<0x0A>", "é", "ﬁ", "中", "日本", "🙂", "́", "the"]
ODD += ["ing", "12", "3", ".", ",", "'", "-", "--", "://", " ", "​", "А", "при", "Ω", "�"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("most, longest", [(300_000, 64), (40, 3)])
def test_ids_are_those_of_the_library(library, odd_rows, most, longest):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [r[1] or "" for r in odd_rows] + ["x" * 5000 + " " * 3000, "́" * 70]
    encoder = pieces.PieceEncoder(most=most, longest=longest)
    for start in range(0, len(texts), 250):
        some = texts[start : start + 250]
        assert [ids.tolist() for ids in encoder.encode(some, whole_check=True)] == library.encode(some)


def test_one_agenda_and_many_agree(library):
    rng = random.Random(4)
    encoder = pieces.PieceEncoder()
    chunks = ["▁" + "".join(rng.choice("abcdeinorstéüß中") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    together = encoder._merge_together(chunks)
    assert [list(memoryview(ids).cast("i")) for ids in together] == [encoder.merge(c) for c in chunks]


def test_a_wrong_merge_is_noticed():
    encoder = pieces.PieceEncoder()
    encoder.agenda.rank[:-1] = encoder.agenda.rank[:-1][::-1].copy()
    with pytest.raises(ValueError, match="differ"):
        encoder.encode(["hello there, general statement"])


def test_model_of_another_kind_is_refused(monkeypatch):
    plain = pieces._fields

    def other(data):
        return [(k, 1 if k == 3 and v == pieces.MERGES else v) for k, v in plain(data)]

    monkeypatch.setattr(pieces, "_fields", other)
    with pytest.raises(ValueError, match="merge type"):
        pieces.PieceEncoder()


def test_documents_with_odd_rows(spark, odd_docs, no_docs, odd_rows, library):
    coded = pieces.encode(odd_docs, name="n_lines", decoded="start")  # names that the table has already
    assert sorted(coded.columns) == sorted(odd_docs.columns)
    got = sorted(((r.doc_id, r.text, list(r.n_lines), r.start) for r in coded.collect()), key=repr)
    expected = []
    for row in odd_rows:
        ids = library.encode(row[1] or "") + [library.eos_id()]
        expected.append((row[0], row[1], ids, library.decode(ids)))
    assert got == sorted(expected, key=repr)
    assert pieces.encode(no_docs).count() == 0


def test_start_id_and_bytes_that_are_not_text(spark, library):
    docs = spark.sql("SELECT 1 AS doc_id, cast(unhex('61FF62') AS string) AS text, map('a', 1) AS extra")
    row = pieces.encode(docs, start_id=True, end_id=False).first()
    assert list(row.ids) == [library.bos_id()] + library.encode("a�b")
    assert row.extra == {"a": 1}


def test_decoding(spark, library):
    ids = library.encode("Some words,\n中文 and\x00 more")
    df = spark.createDataFrame([(1, ids), (2, []), (3, None), (4, [5, None]), (5, [32000]), (6, [-1])], "i int, ids array<int>")
    got = {r.i: r.text for r in pieces.decode(df).collect()}
    assert got == {1: library.decode(ids), 2: "", 3: None, 4: None, 5: None, 6: None}


def test_bound_query(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op11_piece_agenda"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids, row = library.encode(doc.t, add_eos=True), got[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
