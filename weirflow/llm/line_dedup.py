"""Line dedup over overlapping windows of three lines.

Each document's consecutive lines are hashed in overlapping windows. A window that
occurs again, anywhere, is removed where it isn't the first: the covered positions
of its later occurrences are merged into ranges, and the lines outside all ranges
stay. The first occurrence is that with the smallest (doc_id, position), then the
smallest hash of its text; null ids come last.

Windows are compared by md5 of their three lines, joined by line feeds, which no
line holds. Counts are pre-aggregated; the join of repeated windows with their
first occurrence is a plain equi-join, which AQE splits where a window is in a
third of all documents. Covered positions are merged by a window over one document
at a time, sorted and spilled by Spark; nothing of a group is collected but a
document's own ranges. Texts are cut in Arrow batches: compiled into the join's
code, that has at times taken the JVM's compiler over a GB.

Documents of fewer lines than a window stay as they are; null text stays null. A
document of which nothing stays has the empty text. Rows with equal id and text
are one document, so both stay, with the same result; rows with equal id and
unlike texts are judged apart. An empty table gives an empty result. Columns other
than text pass unchanged, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weirflow.llm.scratch import Scratch, column, fresh

LINES = 3


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """All columns of ``docs`` (which has doc_id and text), with text cleaned, then n_lines and n_removed.

    If ``docs`` has one of these two names already, the new column is that of fresh().
    """
    id_, own, cut, done, n_lines, n_removed = fresh(docs.columns, "_id", "_own", "_cut", "_done", "n_lines", "n_removed")
    keyed = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.col("text"))
    split = F.split("text", "\n", -1)
    windows = F.expr(f"transform(sequence(1, size(_lines) - {lines - 1}), i -> unhex(md5(array_join(slice(_lines, i, {lines}), '\\n'))))")
    found = docs.filter("text is not null").select(keyed[0].alias("_id"), keyed[1].alias("_own"), split.alias("_lines")).filter(F.size("_lines") >= lines)
    found = found.select("_id", "_own", F.posexplode(windows).alias("_at", "_window"))
    # Both the first occurrences and the later ones come from the windows: texts are cut into lines once.
    found = Scratch(docs.sparkSession).keep(found, "windows")

    firsts = found.groupBy("_window").agg(F.min(F.struct("_id", "_at", "_own")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    later = found.join(firsts, "_window").filter("struct(_id, _at, _own) > _first").select("_id", "_own", "_at").distinct()

    in_order = Window.partitionBy("_id", "_own").orderBy("_at")
    islands = later.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(in_order) > lines).cast("int"), F.lit(1)))
    islands = islands.withColumn("_island", F.sum("_new").over(in_order))
    ranges = islands.groupBy("_id", "_own", "_island").agg(F.min("_at").alias("a"), (F.max("_at") + lines).alias("b"))
    ranges = ranges.groupBy(F.col("_id").alias(id_), F.col("_own").alias(own)).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias(cut))

    joined = docs.withColumn(id_, keyed[0]).withColumn(own, keyed[1]).join(ranges, [id_, own], "left")
    joined = joined.withColumn(done, cut_lines(F.col("text"), column(cut)))
    out = [column(done)["text"].alias("text") if c == "text" else column(c) for c in docs.columns]
    return joined.select(*out, column(done)["n_lines"].alias(n_lines), column(done)["n_removed"].alias(n_removed))


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
def cut_lines(text: pa.Array, cut: pa.Array) -> pa.Array:
    """Each text without its lines in [a, b) of the sorted, disjoint ranges; texts without ranges pass untouched."""
    n_lines = pc.if_else(text.is_valid(), pc.add(pc.fill_null(pc.count_substring(text, "\n"), 0), 1), 0)
    removed, cleaned = np.zeros(len(text), np.int64), []
    marked = np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False))
    for i in marked.tolist():
        lines, kept, at = text[i].as_py().split("\n"), [], 0
        for r in cut[i].as_py():
            kept += lines[at : r["a"]]
            at = r["b"]
            removed[i] += r["b"] - r["a"]
        cleaned.append("\n".join(kept + lines[at:]))
    mask = np.zeros(len(text), bool)
    mask[marked] = True
    done = pc.replace_with_mask(text, pa.array(mask), pa.array(cleaned, text.type))
    return pa.StructArray.from_arrays([done, n_lines.cast(pa.int64()), pa.array(removed)], ["text", "n_lines", "n_removed"])
