"""op9's ids are those of the tokenizers library with add_special_tokens=False, also where a text holds a special token's string."""

import random
import zlib

import numpy as np

from visitlake.llm import token_frames
from visitlake.llm.queries import BYTE_MODEL, tokenizer_path

SPECIAL = "<|endoftext|>"
TEXTS = [
    SPECIAL, f"x {SPECIAL} y", f"in{SPECIAL}side", f"  {SPECIAL}\n\n{SPECIAL}  ", f"a\n{SPECIAL}\nb", f"{SPECIAL}{SPECIAL}", f"it{SPECIAL}'s",
    f"a\t \n {SPECIAL}, b.", f"end {SPECIAL}", "<|endoftext", f"a \x1c{SPECIAL}\x1f b", f"{SPECIAL} plain words only", "plain words only", "", None,
]


def test_ids_with_special_tokens(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(BYTE_MODEL))
    rng = random.Random(4)
    parts = [SPECIAL, " ", "  ", "\n", "\t", "a", "word", "'s", ".", "é", "中", "12", "<|", "|>"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 15))) for _ in range(1500)]
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, token_frames.END_ID] for t in texts]
    assert want[1][:-1] == [87, 220, 50256, 331]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(token_frames.token_files(df, tokenizer_path(BYTE_MODEL)).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, ids in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[r.doc_id]
        at += len(ids)
