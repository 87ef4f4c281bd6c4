from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from quirelake.llm import _text

WORD = re.compile(_text.WORD_PATTERN)


def test_words_match_the_pattern():
    r = random.Random(1)
    texts = [None, "", "É_x a", "a" * 70_000, " \n"] + ["".join(r.choice("aZé0_ .-!\n😀") for _ in range(r.randint(0, 60))) for _ in range(500)]
    seen: dict = {}
    for size in (1, 200, 1 << 19):
        for t in _text.tokenised(pa.chunked_array([texts[:3], texts[3:]], pa.string()), size):
            for i in range(len(t)):
                own = WORD.findall((texts[t.first + i] or "").lower())
                hashes = t.hashes[t.bounds[i] : t.bounds[i + 1]].tolist()
                assert len(own) == len(hashes)
                for w, h in zip(own, hashes, strict=True):
                    assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_rolling_hash_is_of_the_run_alone():
    x = np.random.default_rng(0).integers(0, 5, 400).astype(np.uint64)
    by_run: dict = {}
    for i, h in enumerate(_text.rolling(x, 4).tolist()):
        assert by_run.setdefault(tuple(x[i : i + 4]), h) == h
    assert len(set(by_run.values())) == len(by_run)
    assert len(_text.rolling(x[:3], 4)) == 0
