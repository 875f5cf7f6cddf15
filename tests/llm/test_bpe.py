import base64
import random
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

from sparrowql.llm.bpe import MATRIX_LIMIT, bpe, bpe_digests, codec

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    alphabet = "abcdefghij ththe e\n\t  éèßñ'sll0123 中文🙂​\x1c"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(300)]
    return ["", " ", "it's", "a" * (MATRIX_LIMIT + 700), "ab" * 3000, "=" * 5000, "the" * 300, *made]


def test_ids_equal_the_library(library):
    coder = codec(Path(PATH).read_bytes(), public_tokenizers.PATTERN)
    import numpy as np

    for text, got in zip(texts(), coder.encode_texts(texts()), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert coder.decode(np.array(ids, int)) == text.encode()


def test_matrix_equals_heap():
    coder = codec(Path(PATH).read_bytes(), public_tokenizers.PATTERN)
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"theinanre \xc3\xa9") for _ in range(rng.randint(2, 90))) for _ in range(400)]
    for a, b in zip(coder._by_matrix(pieces), map(coder._by_heap, pieces), strict=True):
        assert a.tolist() == b.tolist()


def test_frames_nulls_repeats_and_clashes(spark, library):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "the there", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = bpe(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == 4 and set(out[0].asDict()) == {"doc_id", "text", "token_ids", "_token_ids", "decoded"}
    assert [r["_token_ids"] for r in out if r["text"]] == [library.encode_ordinary("the there")]
    got = bpe_digests(docs, PATH, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r["n_tokens"] for r in got.collect()) == [0, 0, 0, len(library.encode_ordinary("the there"))]
    assert bpe_digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
