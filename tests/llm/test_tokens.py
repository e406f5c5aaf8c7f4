import os
import random

import pytest

from runweave.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json"), reason="no tokenizer files")


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.Vocabulary(tokens.read_vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def texts(n, seed):
    rnd = random.Random(seed)
    alphabet = "aabcdeeinorstthABC  \n\t \x1c\x1f\x85é漢字あ🙂'.,;-0123456789‍ß"
    parts = ["the", "<|endoftext|>", "aaaa", "====", "    ", "\r\n", "running", "'s"]
    return ["".join(rnd.choice(alphabet) if rnd.random() < 0.7 else rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_ids_equal_the_library_and_decode_back(vocabulary, library):
    for t in [*texts(3000, 1), "a" * 20_000, "ab" * 3000, " " * 500]:
        ids = vocabulary.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert vocabulary.decode(ids) == t


def test_corpus(spark, vocabulary):
    rows = [(1, "some text"), (2, ""), (3, None), (4, "  "), (5, "x" * 100_000), (5, "twice")]
    df = spark.createDataFrame([(k, t, [9], "e") for k, t in rows], "doc_id long, text string, ids array<int>, key string")
    out = tokens.encode_corpus(df, "doc_id", "text")
    got = sorted((r["doc_id"], list(r["ids"])) for r in out.collect())
    assert got == sorted((k, vocabulary.encode(t) if t else []) for k, t in rows)
    back = sorted(tuple(r) for r in tokens.decode_corpus(out, "doc_id", "ids").collect())
    assert back == sorted((k, t or "") for k, t in rows)
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
