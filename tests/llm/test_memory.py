"""What Python workers keep: freed memory goes back after each task, batches are worked on in slices."""

import platform
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from visitlake.llm import wordhash
from visitlake.llm.common import lean, slices


def _anonymous_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="other C libraries keep memory in other ways")
def test_a_task_gives_its_memory_back():
    pinned = []

    def run(batches):
        for batch in batches:
            held = [np.ones(8000) for _ in range(3000)]  # 190 MB in pieces that the C library keeps for itself
            pinned.append(np.ones(8000))  # lies behind them
            del held
            yield batch

    before = _anonymous_mb()
    batches = [pa.RecordBatch.from_pydict({"a": [1, 2]})]
    assert list(run(iter(batches))) == batches
    assert _anonymous_mb() > before + 100, "kept without lean"
    assert list(lean(run)(iter(batches))) == batches
    assert _anonymous_mb() < before + 40


def test_slices_hold_all_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"a": list(range(a, b))}) for a, b in ((0, 1300), (1300, 1300), (1300, 1301))]
    cut = list(slices(iter(batches), 512))
    assert [b.num_rows for b in cut] == [512, 512, 276, 1]
    assert [x for b in cut for x in b.column("a").to_pylist()] == list(range(1301))


def test_words_of_a_megabyte_need_small_tables():
    wordhash._powers.cache_clear()
    texts = ["some words of a text " * 100] * 500
    assert len({w.tobytes() for w in wordhash.words_by_text(texts)}) == 1
    power, inverse = wordhash._powers(1 << wordhash.BUFFER.bit_length())
    assert wordhash._powers.cache_info().misses == 1, "one table serves all buffers"
    assert power.nbytes + inverse.nbytes <= 8 << 20
