"""Every code point between letters, against the tokenizers library."""

import public_tokenizers
from tokenizers import Tokenizer

from marquee.llm import bpe


def test_every_code_point():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(path), bpe.word_bpe(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}1" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    wrong = []
    for at in range(0, len(texts), 1000):
        for text, want in zip(texts[at : at + 1000], library.encode_batch(texts[at : at + 1000], add_special_tokens=False)):
            if coder.encode(text) != want.ids:
                wrong.append(text)
    assert not wrong, (len(wrong), [hex(ord(c)) for c in wrong[0][1::7]][:5])
