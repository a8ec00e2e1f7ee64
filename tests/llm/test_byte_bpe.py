"""The backtracking encoder against the tokenizers library, on random and awkward texts and in Spark."""

import hashlib
import random

import numpy as np
import pytest

from ketspark.llm import byte_bpe, queries

AWKWARD = ["", " ", "a" * 3000, " " * 2000, "ab" * 1500 + "<|endoftext|> x", "<|endoftext|><|endoftext|>", "  <|endoftext|>  a", "\n\n x\x85 y\x1c z", "don't we'll 'S", "\U0001f600é日本\x00�"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe.default_tokenizer())


def random_texts(library, n):
    rng = random.Random(3)
    letters = "ab  \n\t'stremvdl.,!? é日本  \x1c\x85\r0129\U0001f600-_<|endoftext|>aaaa"
    pieces = [t.replace("Ġ", " ") for t in library.get_vocab()]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("special", [True, False])
def test_ids_and_texts_are_the_library_s(library, special):
    codec = byte_bpe.ByteBPE(byte_bpe.default_tokenizer(), special)
    codec.MEMO = 500  # generations of the memo change
    library.encode_special_tokens = not special
    for text in [*AWKWARD, *random_texts(library, 4000)]:
        ids = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(codec.encode(text), "<u4")
        assert got.tolist() == ids, text
        assert codec.decode(got).tobytes().decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)
    library.encode_special_tokens = False


def test_pairs_go_together_as_merges_say(library):
    """Neighbours in the table against the encoding of their joined bytes, without the word pattern."""
    codec, rng = byte_bpe.ByteBPE(byte_bpe.default_tokenizer()), random.Random(7)
    for _ in range(3000):
        x, y = rng.randrange(50_000), rng.randrange(50_000)
        joined = (codec.tokens[x] + codec.tokens[y]).decode("latin-1").encode("latin-1")
        merged = [t.id for t in library.model.tokenize("".join(byte_bpe.LETTERS[b] for b in joined))]
        assert codec.go_together(x, y) == (merged == [x, y])


def test_part_of_a_character_decodes_to_the_replacement():
    codec = byte_bpe.ByteBPE(byte_bpe.default_tokenizer())
    ids = np.frombuffer(codec.encode("日"), "<u4")[:1]
    assert codec.decode(ids).tobytes().decode("utf-8", "replace") == "�"


def test_rows_keep_their_columns(spark, library):
    rows = [(i, t, "x", 5) for i, t in enumerate([*AWKWARD, None, "same", "same"])] + [(None, "null id", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids int")
    found = byte_bpe.with_text(byte_bpe.with_ids(docs, byte_bpe.default_tokenizer()), byte_bpe.default_tokenizer(), out_col="again")
    assert found.columns == ["doc_id", "text", "decoded", "ids", "again"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.again == (r.text or "")
    assert byte_bpe.with_ids(docs.limit(0), byte_bpe.default_tokenizer()).count() == 0
    lists = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.text for r in byte_bpe.with_text(lists, byte_bpe.default_tokenizer()).collect()] == ["", ""]


def test_query(spark, library):
    data = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    got = queries.QUERIES["op12_byte_bpe"](spark, data).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
