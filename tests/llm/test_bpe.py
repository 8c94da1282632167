import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomrank.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def compare(got, rows, library):
    assert len(got) == len(rows)
    want = sorted((i, len(e.ids), sha(",".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))) for i, t in rows for e in [library.encode(t or "", add_special_tokens=False)])
    assert sorted(map(tuple, got)) == want


def test_documents_against_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    compare(bpe.digests(bpe.encode_documents(docs, chunk_bytes=30_000)).collect(), rows, library)


def test_odd_rows(spark, library):
    rows = [
        (1, None), (2, ""), (3, " "), (4, "  \n\n x  \t"), (5, "it's we'll 12 a1 ½ ②"), (6, "<|endoftext|>a <|endoftext|> <|endoftext"), (7, "né日本語 ́ é 🤔🤔 ​"),
        (8, "x" * 200_000), (9, " ".join(f"w{i}" for i in range(50_000))), (10, "same"), (10, "same"), (11, "a՘b \U0001c9c1 �\x00\x1c\x85  z"), (12, "\x1c \x1d\x1e"),
    ]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, slot int, word string").repartition(3)
    compare(bpe.digests(bpe.encode_documents(docs)).collect(), rows, library)


def test_helper_columns_chunks_in_bytes_and_catalog(spark, library):
    """Columns named as the operator's own are ignored; a chunk counts UTF-8 bytes; no catalog entry stays behind."""
    rows = [(f"d{i}", "日本語テキスト " * 50 + str(i)) for i in range(12)]
    docs = spark.createDataFrame([(i, t, 7, 8, "x", 9) for i, t in rows], "doc_id string, text string, chunk long, bucket int, payload string, id int").coalesce(1)
    encoded = bpe.encode_documents(docs, chunk_bytes=3_000)
    compare(bpe.digests(encoded).collect(), rows, library)
    assert {r["doc_id"]: r["decoded"] for r in encoded.collect()} == dict(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("loomrank_")]


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "one two")], "doc_id long, text string")
    assert [tuple(r) for r in bpe.encode_documents(docs).collect()] == [(None, [505, 734], "one two")]
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_decode_join_is_the_library_decoding(spark, library):
    rows = [(1, [15496, 995, 50256]), (2, [447, 239]), (3, [220])]
    table = bpe.pieces(spark, bpe.default_tokenizer())
    got = bpe.decode_ids(spark.createDataFrame(rows, "word_id int, ids array<int>"), table).collect()
    assert {r["word_id"]: bytes(r["decoded"]).decode("utf-8", "replace") for r in got} == {k: library.decode(ids, skip_special_tokens=False) for k, ids in rows}
    assert table.count() == 50257


@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sS1<|>")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_split_words_encode_as_the_whole(text):
    library = Tokenizer.from_file(bpe.default_tokenizer()) if not hasattr(test_split_words_encode_as_the_whole, "t") else test_split_words_encode_as_the_whole.t
    test_split_words_encode_as_the_whole.t = library
    words = bpe.Splitter(bpe.default_tokenizer()).words(text)
    assert "".join(words) == text
    assert [i for w in words for i in library.encode(w, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids
