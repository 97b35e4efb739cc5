"""Ids of texts that hold the string of an added token, against a freshly loaded tokenizer."""

from array import array

from tokenizers import Tokenizer

from lodestrata.llm import packing


def test_added_tokens_are_single_ids():
    path = packing.default_tokenizer()
    fresh, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", "no token  here", "é <|endoftext|>é"]
    for text in texts:
        want = fresh.encode(text, add_special_tokens=False).ids
        assert array("I", want).tobytes() == encoder.encode(text), text
    assert fresh.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
