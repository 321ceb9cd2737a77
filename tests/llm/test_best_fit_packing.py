import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from spanwright.llm import best_fit_packing as b


def test_pieces_are_the_tokenizers_ids(odd):
    tokenizer = Tokenizer.from_file(b.default_tokenizer())
    rows = defaultdict(list)
    for r in b.pieces(odd).collect():
        rows[r.doc_id].append(r)
    for doc_id, text in [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 2]:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(rows[doc_id], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), 2048)) and sum(r.length for r in parts) == len(ids)
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]


def test_words_alone_give_the_texts_ids():
    tokenizer, own = Tokenizer.from_file(b.default_tokenizer()), b.WordIds(b.default_tokenizer())
    alphabet = "aZ é É ß ÿ Ā ñ n\u0303 1 ½ ' 's 'LL <|endoftext|> <|EndOfText|> < | > * _ - , . \u00a0 \u2028 \x1c \x0b \n \t 漢 🙂 ² × ÷ Σ ς İ fi\u0301".split(" ") + [" ", " "]
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        assert own(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def best_fit(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_packing_is_gapless_and_as_good_as_sequential_best_fit(spark):
    rng = random.Random(5)
    lengths = [rng.choice([1, 7, 30, 100, 33, 64, rng.randint(1, 128)]) for _ in range(2000)] + [50] * 900
    frame = spark.createDataFrame([(k // 2, k % 2, 0, x, 1) for k, x in enumerate(lengths)], b.PIECES)
    rows = b.pack(frame, 128).collect()
    assert len(rows) == len(lengths)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) == best_fit(lengths, 128)


def test_empty_and_odd(odd):
    assert b.pack(b.pieces(odd.limit(0))).count() == 0
    assert b.pack(b.pieces(odd)).count() == b.pieces(odd).count()
