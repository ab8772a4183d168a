import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401

from graphloom.llm import packing, token_files
from graphloom.llm.tokens import WordEncoder


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_give_the_ids_of_whole_texts(ids_of, odd_rows):
    texts = [r[1] for r in odd_rows]
    texts += ["ÁB H̱ K İ ς Σ", "don't WE'LL'x ‍   b", "a\x1cb\x85c", "İ" * 300, "it's<|startoftext|>ok <|", "ÀÉ!! x***,."]
    texts += ["!!'s 's!! a'!b 'T'' it's. (it's) '.'re ..'ll x'd!", "É×! ÷÷. a÷b,", "3.5% a1! 12,000 a\u00a0b!", "A\u0301. e\u0301!", "ß. ÿ? µm! ﬁ. ＡＢ"]
    texts += [texts[0].upper() + "?!.", "<|ENDOFTEXT|> <|endoftext|>", "\x00a! \x1fb. \x7f!c", "İ. I! ı?", "a\u2028b. c\u3000d!"]
    for most in (400_000, 50):  # also when the cache never lasts
        encoder = WordEncoder(most=most)
        for _ in range(2):
            packed = encoder.encode([None if t is None else t.encode() for t in texts])
            assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [ids_of(t) for t in texts]


def test_letters_are_merged_as_the_library_does(ids_of):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdluéüßñÿcmz") for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    encoder = WordEncoder()
    assert [np.frombuffer(p, "<u4").tolist() for p in encoder._merge_words([w.encode() for w in words])] == [ids_of(w) for w in words]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["The Quick  brown\nfox, isn't it?", "", "é 中文  x"]
    found = WordEncoder(path).encode([*(t.encode() for t in texts), None])
    plain = Tokenizer.from_file(path)
    assert [np.frombuffer(p, "<u4").tolist() for p in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_fill_is_nearest():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        target = rng.randrange(0, 60)
        items = [k for k, v in counts.items() for _ in range(v)]
        sums = {sum(items[i] for i in range(len(items)) if m >> i & 1) for m in range(1 << len(items))}
        used = packing.fill(target, counts, sorted(counts, reverse=True))
        assert all(n <= counts[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= target)


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    counts = Counter(rng.randrange(1, 65) for _ in range(3000))
    counts[8] += 100_000
    steps = packing.plan(counts, 64)
    given = Counter()
    for used, times in steps:
        assert sum(k * n for k, n in used.items()) <= 64
        given.update({k: n * times for k, n in used.items()})
    assert given == counts
    sequences = sum(t for _, t in steps)
    assert sequences <= -(-sum(k * v for k, v in counts.items()) // 64) * 1.01 + 1


def test_pack(spark, odd_docs, odd_rows, ids_of):
    found = packing.pack(odd_docs).collect()
    expected = Counter()
    for row in odd_rows:
        ids = ids_of(row[1]) + [1]
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            expected[(row[0], start, len(part), crc(part), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == expected
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_pack_nothing(no_docs):
    assert packing.pack(no_docs).collect() == []


@pytest.mark.parametrize("layout", ["dictionary", "delta"])
def test_files_round_trip(spark, odd_docs, odd_rows, ids_of, tmp_path, layout):
    path = str(tmp_path / layout)
    token_files.write_tokens(odd_docs, path, layout=layout, row_group=64 << 10, page=4 << 10)
    stored = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert Counter((r.doc_id, tuple(r.tokens)) for r in stored) == Counter(
        (r[0], tuple(ids_of(r[1]) + [2])) for r in odd_rows
    )
    at = 0
    for r in stored:
        assert r.start == at and r.n_tokens == len(r.tokens)
        at += r.n_tokens
    ids = [r.doc_id for r in stored if r.doc_id is not None]
    assert ids == sorted(ids) and stored[0].doc_id is None
    digest = {(r.start, r.ids_crc32) for r in token_files.token_digest(spark, path).collect()}
    assert digest == {(r.start, crc(r.tokens)) for r in stored}
    encodings, indexed = set(), set()
    for part in (tmp_path / layout).glob("part-*.parquet"):
        meta = pq.ParquetFile(part).metadata
        for group in range(meta.num_row_groups):
            for i in range(meta.num_columns):
                column = meta.row_group(group).column(i)
                if column.path_in_schema.startswith("tokens"):
                    encodings.update(column.encodings)
                    indexed.add(column.has_offset_index)
    assert indexed == {True}
    assert any(("DICTIONARY" in e) == (layout == "dictionary") for e in encodings)
    assert ("DELTA_BINARY_PACKED" in encodings) == (layout == "delta")


def test_files_of_nothing(spark, no_docs, tmp_path):
    token_files.write_tokens(no_docs, str(tmp_path / "none"))
    assert token_files.token_digest(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(ValueError):
        token_files.write_tokens(no_docs, str(tmp_path / "bad"), layout="plain")
