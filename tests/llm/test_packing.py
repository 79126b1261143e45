import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


_RNG = random.Random(1)
MIXED = [_RNG.randint(1, 4096) for _ in range(3000)]


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_tokens_equal_the_library(reference, monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 200)
    rng = random.Random(3)
    alphabet = "ab.,'s tl é…́İΣς1 2\t\n <|>#A\x01\x1c\x85漢😀"
    texts = ["", "a\x01b \x01 \x01\x01c", "<|startoftext|>", "x.<|ENDOFTEXT|> <|endoftext", "it's don't. <|endoftext|> ὈΔΥΣΣΕΎΣ ΣΑΣ é", *["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(1500)]]
    tokens = packing.WordTokens(PATH)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], tokens.ids(texts[at : at + 100]), strict=True):
            assert ids.tolist() == reference(text), text


@pytest.mark.parametrize(("lengths", "most"), [([], 0), ([4096], 1), ([1] * 5000, 2), ([1366] * 7, 4), ([2049, 2047, 2048, 2048, 1365, 1365, 1366], 3), (MIXED, 1.02 * sum(MIXED) / 4096 + 1), ([1366, 2731, 1365] * 100, 150)])
def test_plan_holds_every_piece_once(lengths, most):
    patterns = packing.plan(dict(Counter(lengths)), 4096)
    held = Counter()
    for times, filled in patterns:
        assert times > 0 and sum(filled) <= 4096 and sum(3 * x > 4096 for x in filled) <= 2
        for x in filled:
            held[x] += times
    assert held == Counter(lengths)
    assert sum(t for t, _ in patterns) <= most


def test_packed_sequences(spark, reference):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("alpha", "beta.", "Gamma", "x1")) for _ in range(rng.choice((0, 3, 40, 900, 1500, 6000)))) for _ in range(120)] + [None, "", "same", "same"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, length string").repartition(5)
    out = packing.pack(docs, PATH).collect()
    expected = {}
    for k, t in enumerate(texts):
        ids = [*reference(t or ""), 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            expected[k, piece] = (at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == expected and len(out) == len(expected)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= 1.05 * sum(r.length for r in out) / 4096 + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_words_of_a_batch_are_those_of_each_text():
    texts = ["", "Ab. c,d\x0be", "x", " \t", "a.b.c é. É", "end", ""]
    words, bounds = packing._words([t.encode() for t in texts])
    own = [words.to_pylist()[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
    assert own == [[], [b"ab", b". c,d".split()[0], b"c", b",d", b"e"], [b"x"], [], [b"a", b".b", b".c", "é.".encode(), "É.".encode()[:-1]], [b"end"], []]
    assert packing._words([])[1].tolist() == [0]
