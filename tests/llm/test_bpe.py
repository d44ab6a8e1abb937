import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from priorframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "'", "\n", "  ", "'s", "'re", "<|endoftext|>", "1", "é", "the", "ing", "\x1c", "\xa0", "🙂", "ABC", " the", "<|endof", "ß", "漢字", "\t", "$$$"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_matches_library_on_random_texts(library):
    random.seed(3)
    texts = ["".join(random.choice(PIECES) for _ in range(random.randint(0, 50))) for _ in range(3000)]
    ours = bpe.codec(PATH).encode_batch(texts)
    assert ours == [ids(library, t) for t in texts]
    assert [bpe.codec(PATH).decode(x) for x in ours] == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in ours]


def test_very_long_word_is_whole(library):
    text = "".join(random.Random(5).choice("abcdefgh") for _ in range(60_000))
    assert bpe.codec(PATH).encode_batch([text])[0] == ids(library, text)


def test_only_failing_words_are_merged():
    codec = bpe.BytePairCodec(PATH)
    words = [w.encode() for w in ("hello", " world", "onanthe", "thenening", "zzzzzzz", " unbelievable")]
    assert codec.encode_words(words) == [codec.merge(w) for w in words]
    assert len(codec.pairs) < 40


def test_tested_pairs_take_few_bytes():
    """Both caches of a worker stay small beside an executor: tested pairs take nine bytes each, and are found again."""
    codec = bpe.BytePairCodec(PATH)
    rng = np.random.default_rng(3)
    left, right = rng.choice(codec.single, 60_000), rng.integers(300, 50_000, 60_000)
    keys = np.unique(np.concatenate((left << 32 | right, -1 - right)))
    tracemalloc.start()
    codec.fitting(keys[::2])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 20 * len(keys[::2])
    fits = codec.fitting(keys)
    assert len(codec.pairs) == len(keys) and (codec.fitting(keys) == fits).all() and 0 < fits.sum() < len(fits)
    for k in rng.choice(len(keys), 500).tolist():
        pair = [-1 - keys[k]] if keys[k] < 0 else [keys[k] >> 32, keys[k] & 0xFFFFFFFF]
        assert fits[k] == (codec.merge(b"".join(codec.token_bytes[t] for t in pair)) == pair)


def test_round_trip_rows(spark, library):
    rows = [(1, "The cat\n sat", "x"), (2, None, "y"), (3, "", None), (1, "The cat\n sat", "x"), (None, "ab<|endoftext|>c", "z")]
    out = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out}
    assert by[2].n_tokens == by[3].n_tokens == 0
    assert by[None].ids_sha256 == hashlib.sha256(ids(library, "ab<|endoftext|>c")).hexdigest()
    assert by[1].decoded_sha256 == hashlib.sha256(b"The cat\n sat").hexdigest()


def test_ids_and_decoded_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 8)], "doc_id long, text string, ids int")
    out = bpe.decode_ids(bpe.with_tokens(df, PATH), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["a b", ""] and [r.n_tokens for r in out] == [2, 0]
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_whole_table_equals_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: hashlib.sha256(ids(library, r.text)).hexdigest() for r in docs.collect()}
    got = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(docs, PATH).collect()}
    assert got == want
