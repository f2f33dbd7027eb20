"""What a tokenizer holds."""

from public_tokenizers import path

from linescope.llm import bpe

RANKS = path("byte_bpe_50k.tiktoken")


def test_merged_slices_are_held_in_two_bounded_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    with open(RANKS, "rb") as file:
        source = file.read()
    words, fresh = bpe.Vocabulary(source), bpe.Vocabulary(source)
    pieces = [f" zqx{k}vjw".encode() for k in range(400)]
    for piece in pieces:
        words.ids_of(b" oftenaskedfor")
        assert words.ids_of(piece) == fresh.merged(piece)
        assert len(words.cache) + len(words.older) <= 100
    assert b" oftenaskedfor" in words.cache | words.older  # never merged again
