"""Items of a few shingles are found wherever a document holds them."""

import numpy as np

from visitlake.llm.decontaminate import WORDS, Items
from visitlake.llm.wordhash import shingles, words_by_text


def test_no_short_item_is_missed():
    rng = np.random.default_rng(9)
    texts = [" ".join(f"i{j}x{n}" for n in range(WORDS + j % 8)) for j in range(6000)]
    filler = [" ".join(f"f{x}" for x in rng.integers(0, 10**9, 20)) for _ in texts]
    doc = " ".join(f"{f} {t}" for f, t in zip(filler, texts, strict=True))
    items = Items([*enumerate(texts), (-1, " ".join(f"absent{n}" for n in range(WORDS)))])
    found = items.search(shingles(words_by_text([doc])[0], WORDS))
    assert [(items.ids[j], hits) for j, hits in found] == [(j, 1 + j % 8) for j in range(6000)]
