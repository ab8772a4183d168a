"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pytest

DOC_FIELDS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that the operators use for their own results.
    "start long, score double, shard int, slot int, fp long, n_lines int, size long, rank int, text_crc32 string"
)


def words(rng, count, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(count))


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    passage = "\n".join(words(rng, 12) for _ in range(5))
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(30)]
    texts += ["", "   \n\t ", None, "é ü ß É word's 'tis <|endoftext|> x\u0001y  z 12 34", "a", "a b c d", "\n\n\n"]
    texts += [texts[0]] * 3
    texts += [f"{words(rng, 9)}\n{passage}\n{words(rng, 9)}" for _ in range(4)] + [passage, passage + "\n" + passage]
    texts += ["\n".join(words(rng, 8) for _ in range(700))]  # very long
    texts += [words(rng, 3000) + " " + "x" * 20000]
    rows = [(i, t, "en", f"src{i % 4}", len(t or ""), i, 0.5, 9, 9, 9, 9, 9, 9, "old") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[32]]  # whole rows again
    rows += [(None, words(rng, 40), None, None, None, None, None, None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    rows += [(7, "another text of a used id", "en", None, 0, 1, 1.0, 1, 1, 1, 1, 1, 1, "")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC_FIELDS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
