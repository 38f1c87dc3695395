"""Units that a task of packing has met are looked up all at once."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from oddlot.llm import packing
from oddlot.llm.packing import Encoder


def test_units_are_kept_in_order_and_found_at_once():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two three", "three  four\nfive two", "", "zz six one", "\u00a0odd <|endoftext|> x"]
    for part in (texts[:1], texts[1:3], texts[3:], texts, texts[::-1]):
        raw = [t.encode() for t in part]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        got = encoder.encode(data, np.cumsum([0, *map(len, raw)]))
        assert [x.tolist() for x in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert isinstance(encoder.known, np.ndarray) and (np.diff(encoder.known.astype(object)) > 0).all()
        assert len(encoder.known) == len(encoder.place) == len(encoder.size)


def _encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    return encoder.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))


def test_words_are_learnt_without_the_signs_after_them():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    _encoded(encoder, ["a word word. word, word's word7 word*** new new. new, new's new7 new***"])
    assert len(encoder.known) == 8
    draw = random.Random(5)
    parts = ["don", "'t", "'s", "'", "re", "word", "X", "7", "42", ".", ",", "***", "(", "|>", "<|endoftext|>", "\u00f6st", "\u00f1", "e\u0301",
             "\u4e2d", "\u2014", "\U0001f600", " ", "  ", "\n", "\t\r\n", "\u00a0", "\u2003", "\x1c", "\x00"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(3000)]
    for got, text in zip(_encoded(encoder, texts), texts, strict=True):
        assert got.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_worker_keeps_its_units(monkeypatch):
    learnt, learn = [], Encoder._learn

    def counted(self, codes, *rest):
        learnt.append(len(codes))
        learn(self, codes, *rest)

    monkeypatch.setattr(Encoder, "_learn", counted)
    monkeypatch.setattr(packing, "_encoders", {}, raising=False)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["quite new words", "words quite new"]})
    run = packing._pieces(public_tokenizers.path("byte_bpe_50k.json"), 1024, 128)
    first, second = (pa.Table.from_batches(run(iter([batch]))) for _ in range(2))
    assert first.equals(second) and len(learnt) == 1
