"""Fill-in-the-middle by repeated captures.

One fullmatch of ``(unit)*`` by the regex library keeps every repetition of the group: ``match.ends(1)`` has
the number of units and the offset behind each, so both cuts are looked up in it and nothing steps through the text.
A unit is one code point by default; another pattern (a grapheme, a word with its blanks) cuts at that unit's ends.

The library keeps every capture in memory and gives up on some millions, so a text of over ``WINDOW`` code points is matched window
by window: all but the last unit of a window count, and the next window begins where that last one does. A task holds one
window's match and 8 bytes a unit of its longest text. Rows are independent: no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.llm.common import ship, text_of

UNIT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: documents left plain, and of the others those with the suffix first.
PLAIN, SPM = 10, 20
SEED = 1
#: Code points that one match covers.
WINDOW = 1 << 18


def unit_ends(units: regex.Pattern, text: str, window: int = WINDOW) -> Sequence[int]:
    """Offsets behind each unit of ``text``; ``units`` is ``(unit)*``. ``ValueError`` if the units do not tile the text."""
    if len(text) <= window:
        match = units.fullmatch(text)
        if match is None:
            raise ValueError("the unit's pattern does not tile a text")
        return match.ends(1)
    ends, at, size = array("q"), 0, window
    while at < len(text):
        last = at + size >= len(text)
        match = units.fullmatch(text, at) if last else units.match(text, at, at + size)
        found = match.ends(1) if match else []
        if not last:
            del found[-1:]  # what follows it may belong to it
        if not found and last:
            raise ValueError("the unit's pattern does not tile a text")
        ends.extend(found)
        # a unit as long as the window: look further
        at, size = (ends[-1], window) if found else (at, 2 * size)
    return ends


def numbers(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first digits of the sha256 of ``seed:doc_id`` (a null doc_id: of ``seed:``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, unit: str = UNIT) -> DataFrame:
    """One row (doc_id, n, form, prefix_chars, middle_chars, output) per row of ``docs`` (doc_id, text).

    The text is cut after two numbers of its ``n`` units drawn from the doc_id; ``output`` has the parts behind their marks,
    prefix first (``psm``) or suffix first (``spm``). A text that is empty or holds a mark, and ``PLAIN`` of 100 others, is ``plain``:
    left as it is, with null ``prefix_chars`` and ``middle_chars`` (code points else). Null counts as empty.
    Rows with the same doc_id and text are treated alike, a null doc_id has numbers of its own, other columns are
    ignored, and an empty table gives no rows. A text that ``unit`` does not tile is an error.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({unit})*")
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output")}
            columns = [batch.column(c) for c in ("text", "h1", "h2", "h3", "h4")]
            for cell in zip(*columns, strict=True):
                text, h1, h2, h3, h4 = (x.as_py() for x in cell)
                ends = unit_ends(units, text)
                n = len(ends)
                if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= 100 - PLAIN:
                    row = (n, "plain", None, None, text)
                else:
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    first, second = (ends[k - 1] if k else 0 for k in (a, b))
                    prefix, middle, suffix = text[:first], text[first:second], text[second:]
                    if h4 % 100 < SPM:
                        row = (n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
                    else:
                        row = (n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
                for k, value in zip(out, row, strict=True):
                    out[k].append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *out])

    drawn = [h.alias(f"h{i}") for i, h in enumerate(numbers(F.col("doc_id"), seed), 1)]
    rows = docs.select("doc_id", text_of().alias("text"), *drawn)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form alone; null for null.

    A text holds no mark and no two marks overlap, so the first place of each mark is the one that was put in.
    """
    def part(start: Column, end: Column | None = None) -> Column:
        return F.substring(output, start, F.length(output) if end is None else end - start)

    at = {m: F.locate(m, output) for m in (PREFIX, SUFFIX, MIDDLE)}
    p, s, m = (at[k] for k in (PREFIX, SUFFIX, MIDDLE))
    width = len(PREFIX)
    psm = F.concat(part(p + width, s), part(m + width), part(s + width, m))
    spm = F.concat(part(p + width, m), part(m + width), part(s + width, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
