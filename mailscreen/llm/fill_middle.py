"""Fill-in-the-middle texts by a pyarrow.compute pipeline.

A text is cut into units (white space and the word after it; white space at the end of the
text is a unit of its own).  Two cuts, drawn from the document's id, part the units into
prefix, middle and suffix, which are laid out around three markers:

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text as it is: texts that are empty or hold a marker, and the share of all
           documents that the rate leaves as they are

Per slice of an Arrow batch: put a separator byte behind every word (0xFF, which UTF-8 never
has), split at it into a list array, flatten that with parent indices, number the units of
each text, filter them by role, rebuild one list array per role, and join lists and pieces
with `binary_join`.  No Python code runs per row.  Slices hold about `slice_bytes` of text,
so memory is bounded by that or by one long text.  Draws and digests are Column functions.

Edge cases: a null text is empty (plain, n = 0); a null id draws as the empty string; a text
of white space is one unit; the cuts may fall together or at the ends, which gives empty
pieces; rows with the same id draw alike and each gives a row; other columns are ignored; an
empty table gives an empty result.  Texts are taken to be valid UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN, PSM, SPM = "plain", "psm", "spm"
_WORD, _MARK = rb"[^\x20\x09-\x0D]+", b"\xff"
_BYTES = pa.large_binary()
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class FimSettings:
    seed: int = 42
    rate: int = 50  # percent of the documents that are rearranged
    spm_share: int = 80  # percent of those that put the suffix first
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    slice_bytes: int = 1 << 20  # the arrays made of a slice take nearly 20 times that

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(doc_id: Column, seed: int, count: int = 4) -> list[Column]:
    """`count` unsigned 32-bit numbers: the groups of 8 digits of sha256("seed:id")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(count)]


def units(texts: pa.Array) -> pa.Array:
    """list<large_binary> of the units of each text."""
    marked = pc.replace_substring_regex(texts.cast(_BYTES), pattern=_WORD, replacement=b"\\0" + _MARK)
    return pc.split_pattern(marked, _MARK)


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of about `size` bytes."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, length in enumerate(lengths):
        if row > start and held + length > size:
            yield start, row - start
            start, held = row, 0
        held += int(length)
    if len(lengths) > start:
        yield start, len(lengths) - start


def _joined(values: pa.Array, keep: pa.Array, sizes: pa.Array) -> pa.Array:
    """The kept values, `sizes` of them a row, joined: one large_binary per row."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values.filter(keep)), pa.scalar(b"", _BYTES))


def _remainder(x: pa.Array, by: pa.Array | int) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def _ends_empty(lists: pa.Array) -> pa.Array:
    """Whether the last part of each (never empty) list has no bytes."""
    return pc.equal(pc.binary_length(lists.values.take(pc.subtract(lists.offsets[1:], 1))), 0)


def rearrange(texts: pa.Array, h: list[pa.Array], settings: FimSettings) -> list[pa.Array]:
    """[n, form, prefix_chars, middle_chars, output] of a slice; `h` are its four draws."""
    lists = units(texts)
    values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    # The last part of a split is the white space at the end, mostly none.
    real = pc.greater(pc.binary_length(values), 0)
    values, parents = values.filter(real), parents.filter(real)
    n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), _ends_empty(lists).cast(pa.int64()))
    first = pc.subtract(pc.cumulative_sum(n), n)
    ordinal = pc.subtract(pa.array(np.arange(len(values), dtype=np.int64)), first.take(parents))

    cut1, cut2 = (_remainder(x, pc.add(n, 1)) for x in h[:2])
    low, high = pc.min_element_wise(cut1, cut2), pc.max_element_wise(cut1, cut2)
    before, behind = pc.less(ordinal, low.take(parents)), pc.greater_equal(ordinal, high.take(parents))
    roles = ((before, low), (pc.invert(pc.or_(before, behind)), pc.subtract(high, low)), (behind, pc.subtract(n, high)))
    prefix, middle, suffix = (_joined(values, keep, sizes) for keep, sizes in roles)

    marked = pc.match_substring(texts, settings.prefix)
    for marker in settings.markers[1:]:
        marked = pc.or_(marked, pc.match_substring(texts, marker))
    percent = [_remainder(x, 100) for x in h[2:]]
    plain = pc.or_(pc.or_(marked, pc.equal(n, 0)), pc.greater_equal(percent[0], settings.rate))
    suffix_first = pc.less(percent[1], settings.spm_share)
    form = pc.if_else(plain, PLAIN, pc.if_else(suffix_first, SPM, PSM))

    p, s, m = (pa.scalar(marker.encode(), _BYTES) for marker in settings.markers)
    nothing = pa.scalar(b"", _BYTES)
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
    output = pc.if_else(plain, texts.cast(_BYTES), pc.if_else(suffix_first, spm, psm)).cast(pa.large_string())
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(piece.cast(pa.large_string())).cast(pa.int64())) for piece in (prefix, middle)]
    return [n, form.cast(pa.string()), *chars, output]


def arranged(batches: Iterator[pa.RecordBatch], settings: FimSettings) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text, the four draws) as batches of the result, one per slice."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        for at, rows in _slices(texts, settings.slice_bytes):
            numbers = [batch.column(i).slice(at, rows) for i in range(2, 6)]
            parts = rearrange(pa.concat_arrays([texts.slice(at, rows)]), numbers, settings)
            # Spark's string columns have 32-bit offsets; a slice or one text fits them.
            parts[-1] = parts[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), *parts], names=names)


def fill_in_middle(docs: DataFrame, settings: FimSettings = FimSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of `docs`.

    `n` counts units; the counts of characters are null where the form is plain.
    """
    h = draws(F.col(doc_id), settings.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arranged(batches, settings)

    wanted = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[x.alias(f"h{i}") for i, x in enumerate(h)])
    return wanted.mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column, settings: FimSettings = FimSettings()) -> Column:
    """The text again, from output and form alone.

    A rearranged text holds no marker of its own, and no marker can arise where a piece
    meets one, so splitting at the markers gives the pieces.
    """
    parts = F.split(output, "|".join(re.escape(marker) for marker in settings.markers), -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
