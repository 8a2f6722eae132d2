import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sylvan.llm.token_counts import count_tokens, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "The quick brown fox. " * 900, "x" * 5000, "a <|endoftext|>b", "don't  stop\n\n now", "日本語。" * 700 + "テスト",
    "it's 12\n34 é ü " * 800, "tab\tand\r\nbreaks \x00", "word\nword " * 2000,
]


def expected(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False))


@pytest.mark.parametrize("split", [50, 1 << 16])
def test_whole_texts(spark, split):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)] + [(None, "a", "n")], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in count_tokens(docs, PATH, split_chars=split, batch_bytes=3000).collect()}
    for i, text in enumerate(TEXTS):
        assert rows[i].n_tokens == expected(text)
        assert rows[i].n_bytes == len((text or "").encode())
        assert rows[i].over_limit == (rows[i].n_tokens > 512)
    assert rows[None].n_tokens == 1


def test_pieces_join_to_the_text():
    for text in filter(None, TEXTS):
        assert "".join(pieces(text, 40)) == text
    assert len(pieces(TEXTS[4], 40)) > 50


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(docs, PATH).count() == 0
    docs = spark.createDataFrame([(1, "one two"), (1, "one two")], "doc_id long, text string")
    assert [r.n_tokens for r in count_tokens(docs, PATH).collect()] == [2, 2]


def test_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(1, "Hello there, world"), (2, "")], "doc_id long, text string")
    rows = {r.doc_id: r.n_tokens for r in count_tokens(docs, path).collect()}
    assert rows == {1: len(own.encode("Hello there, world")), 2: 0}
