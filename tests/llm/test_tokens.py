"""Token counts against the libraries' own counts of whole texts."""

import random

import public_tokenizers
import pytest

from helpers import docs
from timesift.llm import tokens

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
TEXTS = [None, "", " ", "a  b", "Plain words, and: more words.", "<|endoftext|> x<|startoftext|>y <s> </s>", "don't  can't 's 'S x", "é é ́x",
         "日本語 テキスト " * 50, "x\n\ny z w  ", " lead and trail ", "İstanbul ﬁ ½ ² ­ ​", "a" * 5000, "\U0001f600 \U0001f600 smile"]


def whole(name, texts):
    """Counts of whole texts by the library itself."""
    if name.endswith(".json"):
        from tokenizers import Tokenizer
        loaded = Tokenizer.from_file(public_tokenizers.path(name))
        return [len(loaded.encode(t or "", add_special_tokens=False).ids) for t in texts]
    from sentencepiece import SentencePieceProcessor
    loaded = SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return [len(loaded.encode(t or "")) for t in texts]


def random_texts(n):
    rng = random.Random(3)
    letters = "ab Z'9é́日 \n.,<|>sdt  İ_ \x1f"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(n)]


@pytest.mark.parametrize("name", NAMES)
def test_counts_equal_the_library_on_whole_texts(name):
    texts = [t or "" for t in TEXTS] + random_texts(1500)
    counter = tokens.PieceCounter(*tokens.load_encoder(*tokens.read_model(public_tokenizers.path(name))), batch_bytes=512, known_pieces=50)
    assert counter.counts(texts) == whole(name, texts)
    assert counter.counts(texts[::-1]) == whole(name, texts[::-1])  # from memory


def test_every_row_returns_a_row(spark):
    long_text = "many words in a very long text. " * 20_000
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a  b"), (None, "no id"), (99, long_text)]
    got = tokens.flag_over_limit(tokens.count_tokens(docs(spark, rows, extra=True), public_tokenizers.path(NAMES[0])), 2048).collect()
    texts = [t for _, t in rows]
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, whole(NAMES[0], texts), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert [tuple(r)[3] for r in got if r.doc_id == 99] == [True]


def test_empty_table_and_unknown_kind(spark, tmp_path):
    assert tokens.count_tokens(docs(spark, [(1, "x")]).limit(0), public_tokenizers.path(NAMES[0])).count() == 0
    with pytest.raises(ValueError):
        tokens.load_encoder("txt", b"")
