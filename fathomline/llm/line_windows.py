"""Line dedup by overlapping windows of consecutive lines, in DataFrame functions only.

Every window of three consecutive lines is hashed (two 64-bit hashes), the first
occurrence of each window in (doc_id, position) order is found over the whole
corpus, and the lines that later occurrences cover are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm._shared import stage

#: Lines in a window.
WINDOW = 3


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per window: _id, _row (hash of the row's text), pos (0-based), key (128 bits).

    A text of fewer lines than a window is one window of all its lines. A window
    whose lines are all blank has a null key: it never counts as repeated.
    """
    lines = F.split("_text", "\n", -1)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_lines") - (window - 1), F.lit(1)))

    def key(start):
        part = F.slice("_lines", start, F.lit(window))
        blank = F.forall(part, lambda line: F.trim(line) == "")
        return F.when(~blank, F.struct(F.xxhash64(part).alias("a"), F.xxhash64(F.lit(1), part).alias("b")))

    return (
        docs.where(F.col("_text").isNotNull())
        .select("_id", "_row", lines.alias("_lines"))
        .select("_id", "_row", F.posexplode(F.transform(starts, key)).alias("pos", "key"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with its text column rewritten, and the columns n_lines and n_removed added.

    Lines are split at newlines. Of each window of lines that occurs more than
    once in the corpus, the occurrence with the smallest (id, position) stays and
    all others lose the lines they cover; overlapping covers are merged.

    Nulls and edges: a null text stays null with 0 lines; an empty text is one
    blank line and stays; a null id sorts first; rows that repeat both id and text
    are one document and get the same result in every copy; rows that share an id
    but not a text are ordered by a hash of the text. All other columns pass
    through; columns of the input named n_lines or n_removed are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = docs[text_col]
    docs = docs.select(F.struct(*[docs[c] for c in rest]).alias("_doc"), docs[id_col].alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_row"))
    found = line_windows(docs.select("_id", "_row", "_text"), window).where("key is not null")
    place = F.struct("_id", "_row", "pos")
    firsts = found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("key", "first")
    # the first occurrences are written: joined by them, a window that very many share can be split among tasks
    later = found.join(stage(firsts, "first-windows"), "key").where(place != F.col("first")).groupBy("_id", "_row").agg(F.collect_set("pos").alias("later"))
    over = F.flatten(F.transform("later", lambda p: F.sequence(p, p + (window - 1))))
    later = later.select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2"), F.array_sort(F.array_distinct(over)).alias("_covered"))
    joined = docs.join(later, (F.col("_row") == F.col("_row2")) & F.col("_id").eqNullSafe(F.col("_id2")), "left")

    # what stays are the stretches between covered lines; the lines are a column, so that they are split once
    joined = joined.withColumn("_lines", F.split("_text", "\n", -1))
    lines = F.col("_lines")
    covered = F.filter("_covered", lambda c: c < F.size(lines))
    starts = F.concat(F.array(F.lit(0)), F.transform(covered, lambda c: c + 1))
    ends = F.concat(covered, F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.withColumn("_kept", F.when(F.col("_covered").isNotNull(), kept)).select(
        *[
            F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col("_text")).alias(c) if c == text_col else F.col("_doc").getField(c).alias(c)
            for c in rest
        ],
        n_lines.alias("n_lines"),
        F.when(F.col("_kept").isNotNull(), F.size(lines) - F.size("_kept")).otherwise(0).cast("long").alias("n_removed"),
    )
