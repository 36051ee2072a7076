"""Overlapping windows over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions.text import DEFAULT_CHUNK, DEFAULT_OVERLAP, strip_ctrl

#: Windows in a stretch.
STRETCH = 8


def sliding_chunks(df: DataFrame, doc_id: str, text: str, size: int = DEFAULT_CHUNK, overlap: int = DEFAULT_OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """(<doc_id>, chunk_id, chunk_index, char_start, char_end, content, <keep>): windows of `size` code points every size - overlap.

    Contents are trimmed of characters up to U+0020 and blank windows dropped; chunk_index counts the kept windows, offsets
    are those before trimming. Null and empty texts give no rows. Windows are numbered inside each row: no shuffle.
    A text is first cut into stretches of some windows, in one pass: to find a place in a text takes time in proportion to how
    far in it is, and so would the square of a long text's length for all windows.
    """
    step = size - overlap
    n = F.length(text)
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")), lambda k: k * step)
    wide = STRETCH * step
    cut = F.regexp_extract_all(F.col(text), F.lit("(?s).{1,%d}" % wide), F.lit(0))
    part = lambda p, s: F.substring(F.concat(F.element_at(p, (F.floor(s / wide) + 1).cast("int")), F.substring(F.coalesce(F.try_element_at(p, (F.floor(s / wide) + 2).cast("int")), F.lit("")), F.lit(1), F.lit(size))), (s % wide + 1).cast("int"), F.lit(size))
    window = lambda p, s: F.struct(s.alias("char_start"), F.least(s + size, n).alias("char_end"), strip_ctrl(part(p, s)).alias("content"))
    # As a lambda's argument the stretches are cut once for all windows.
    kept = F.flatten(F.transform(F.array(cut), lambda p: F.filter(F.transform(starts, lambda s: window(p, s)), lambda w: w["content"] != "")))
    x = df.where(n > 0).select(F.col(doc_id), *(keep or []), F.posexplode(kept).alias("chunk_index", "w"))
    return x.select(doc_id, F.concat(F.col(doc_id).cast("string"), F.lit("#chunk-"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "w.char_start", "w.char_end", "w.content", *(keep or []))
