"""Packed ids against the tokenizer's own on random texts."""

import random

import pyarrow as pa

from pressline.llm import packing, queries

PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|", "|>", "İ.", "İ,", "İ", "Iİı", "ǅ", "ß", "É.", "e\u0301.", "ﬁ", "ſ", "Σ.", "ΑΣ", "日本。", "ñ,",
         "it's", "WE'RE", "'LL", "don't", "12.5", "a.b,c", "x", "Hello", "WORLD.", "-", "...", "$€", "\u200d", "\U0001f600", "½", "²", "\u0345", "Ⅷ."]


def test_ids_equal_the_tokenizers():
    coder = packing.Encoder(queries.WORDS)
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) + rng.choice(["", "", " ", "\n", "\t "]) for _ in range(rng.randrange(7))) for _ in range(20_000)]
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for a in range(0, len(texts), 5000):
        got = list(coder.encode(pa.array(texts[a : a + 5000])))
        for text, ids, ref in zip(texts[a : a + 5000], got, want[a : a + 5000], strict=True):
            assert ids.tolist() == ref, repr(text)
