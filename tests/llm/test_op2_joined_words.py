import random

import numpy as np
import pyarrow as pa
import pytest

from guestsignal.llm import coder, op2_token_output

PARTS = [
    " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "\x1c", "\x00", ".", ",", "...", "'s", "n't", "-", "a", "é",
    "×", "ß", "the", "word", "123", "٣.", "½,", "слово.", "漢字", "́", "😀", "<|endoftext|>", "ÿ;", "ɀ!", "ä.", "％",
]


def tokenizer():
    return op2_token_output.WordTokenizer(op2_token_output.default_tokenizer())


class Counted:
    """A tokenizer that counts the strings it is asked to encode."""

    def __init__(self, own):
        self.own, self.strings = own, 0

    def encode_batch_fast(self, texts, **options):
        self.strings += len(texts)
        return self.own.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.own, name)


def test_new_words_go_to_the_library_many_at_once():
    rng = random.Random(2)
    names = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(4000)]
    text = "".join(n + rng.choice([" ", "\n", ". ", ",\n"]) for n in names) + "end"
    own = tokenizer()
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    own.model, own.tokenizer = Counted(own.model), Counted(own.tokenizer)
    assert next(own.ids(pa.array([text]))).tolist() == want
    assert own.model.strings + own.tokenizer.strings < 100
    # known words are not encoded again
    before = own.model.strings + own.tokenizer.strings
    assert [found.tolist() for found in own.ids(pa.array([text, text]))] == [want, want]
    assert own.model.strings + own.tokenizer.strings == before


@pytest.mark.parametrize("words, size", [(250_000, 1 << 23), (50, 3000)])
def test_ids_of_odd_texts(monkeypatch, words, size):
    monkeypatch.setattr(op2_token_output, "CACHE_WORDS", words)
    monkeypatch.setattr(op2_token_output, "CHUNK_BYTES", size)
    rng, own = random.Random(words), tokenizer()
    texts = [None, "", " ", "\n", ".", "a", *(
        "".join(rng.choice(PARTS if rng.random() < 0.5 else [" a", " the,", "\nB", " é."]) for _ in range(rng.randrange(12)))
        for _ in range(4000)
    )]
    want = [e.ids for e in own.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert [found.tolist() for found in own.ids(pa.array(texts))] == want
    own.between = None
    assert [found.tolist() for found in own.ids(pa.array(texts).slice(2000))] == want[2000:]


@pytest.mark.parametrize("n", [255, 256, 70_000, 300_000])
def test_coder_carries(n):
    rng = np.random.default_rng(n)
    kinds = (
        np.zeros(n, int), rng.integers(0, 2, n), rng.integers(0, 60_000, n),
        np.where(rng.random(n) < 0.001, rng.integers(0, 50_000, n), 7),
    )
    for ids in kinds:
        found, lengths = coder.decode_block(coder.encode_block(ids, np.array([n])))
        assert (found == ids).all() and lengths.tolist() == [n]
