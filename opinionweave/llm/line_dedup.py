"""Line dedup by deletion neighbourhoods over words, in DataFrame operations only.

Symbols are words, the edit bound is one word inserted, removed or replaced. Removing word i from a line gives the
variant (i, rest). Two lines of equal length differ in one place exactly when they share a variant with the same i;
a line one word shorter than another is one edit away exactly when it equals a variant of the longer. So the earliest
neighbour of every line follows from a minimum per variant, without pairs, and is verified word by word. Variants are
emitted only for lines that can have a neighbour, those that share their first or last part with another line, and
only for words outside the shared part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bind
from ..plans.lineage import written

BLANKS = "[ \\t\\r\\f\\x0B]+"
STEP = 8


def _words(line: Column) -> Column:
    return F.filter(F.split(line, BLANKS), lambda w: w != "")


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row``: hash of id and text. Rows that repeat both are one document to this operator."""
    return docs.withColumn("_row", F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _row, _line, line) of every line."""
    return docs.select(
        F.col(id_col).alias("_id"), "_row", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("_line", "line")
    )


def _part(n: Column) -> Column:
    """Words of the first or last part that one of two neighbours' ends share: about half, equal for n of one step."""
    return (F.floor(n / STEP) * (STEP // 2)).cast("int")


def _has_step_below(n: Column, min_words: int) -> Column:
    return (n % STEP == 0) & (n > min_words)


def _ends(n: Column, words: Column, min_words: int) -> Column:
    """Keys of the first and the last part, in the lowest bit which; a line at a step also has those of the step below.

    Neighbours have equal or successive lengths, so they have a step in common; a word edited outside the first part
    leaves it equal, and one inside it leaves the last part equal.
    """

    def of(c):
        key = lambda part, side: F.shiftleft(F.shiftright(F.xxhash64(F.lit(side), c, part), 1), 1) + side
        return [key(F.slice(words, F.lit(1), c), 0), key(F.slice(words, n - c + 1, c), 1)]

    at, below = of(_part(n)), of(_part(n) - STEP // 2)
    return F.when(_has_step_below(n, min_words), F.array(*at, *below)).otherwise(F.array(*at))


def distinct_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(h, at, n, ends): each distinct line, under a hash of its words, with its earliest place.

    A line without words is a line of its own wherever it stands. Lines under ``min_words`` have no ends.
    """
    place = F.struct("_id", "_row", "_line").alias("at")
    lines = lines_of(docs, id_col, text_col).select(place, _words(F.col("line")).alias("words"))
    words, n = F.col("words"), F.size("words")
    keyed = lines.select(
        "at", n.alias("n"), F.when(n > 0, F.xxhash64(words)).otherwise(F.xxhash64(F.lit(2), F.col("at"))).alias("h"),
        F.when(n >= min_words, _ends(n, words, min_words)).alias("ends"),
    )
    return keyed.groupBy("h", "n").agg(F.min("at").alias("at"), F.min("ends").alias("ends"))


def candidates(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(o, h, n, sides, line): lines that share an end with another, numbered in their order; sides: bits of the ends."""
    ends = lines.filter("ends is not null").select("h", F.explode("ends").alias("key"))
    shared = ends.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high").select("key")
    sides = ends.join(shared, "key").groupBy("h").agg(F.bit_or(F.when(F.col("key").bitwiseAND(1) == 1, 2).otherwise(1)).alias("sides"))
    able = lines.select("h", "n", "at").join(sides, "h").select("h", "n", "sides", F.col("at._id").alias("_id"), F.col("at._row").alias("_row"), F.col("at._line").alias("_line"))
    spelt = lines_of(docs, id_col, text_col).drop("_id")
    # rows that repeat id and text give the same line again
    found = able.join(spelt, ["_row", "_line"]).dropDuplicates(["h", "n"])
    numbered = found.orderBy(F.asc_nulls_first("_id"), "_row", "_line").withColumn("o", F.monotonically_increasing_id())
    return written(numbered.select("o", "h", "n", "sides", "line"), "lines")


def variants(able: DataFrame, min_words: int) -> DataFrame:
    """(v, i, o): hash of a line without word i, for the words outside its shared ends; i = -1 for the line itself."""
    n, words = F.col("n"), F.col("words")
    least = F.when(_has_step_below(n, min_words), _part(n) - STEP // 2).otherwise(_part(n))
    places = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: ((F.col("sides").bitwiseAND(1) > 0) & (i >= least)) | ((F.col("sides").bitwiseAND(2) > 0) & (i < n - least)),
    )
    cut = able.select("o", "n", _words(F.col("line")).alias("words"), places.alias("places")).select("o", "n", "words", F.explode("places").alias("i"))
    rest = F.concat(F.slice(words, F.lit(1), F.col("i")), F.slice(words, F.col("i") + 2, n))
    return cut.select(F.xxhash64(rest).alias("v"), "i", "o").unionByName(able.select(F.col("h").alias("v"), F.lit(-1).alias("i"), "o"))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are one edit apart: what is left between their common ends is at most one word each.

    ``a`` and ``b`` are used many times, also per word: bind them.
    """
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")

    def rest_equal(first: Column) -> Column:
        tail = lambda x, skip: F.slice(x, first + skip + 1, F.size(x))
        return F.when(F.size(a) == F.size(b), tail(a, 1) == tail(b, 1)).when(F.size(a) > F.size(b), tail(a, 1) == tail(b, 0)).otherwise(tail(a, 0) == tail(b, 1))

    return (long - short <= 1) & bind(F.when(differs > 0, differs - 1).otherwise(short), rest_equal)


def _lines_one_edit(line: Column, other: Column) -> Column:
    """The same for two lines, each split once."""
    return bind(_words(line), lambda a: bind(_words(other), lambda b: _one_edit(a, b)))


def neighbours(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(h, n): distinct lines of which an earlier line is one edit away."""
    able = candidates(docs, lines, id_col, text_col)
    every = variants(able, min_words)
    busy = every.groupBy("v").agg(F.min("o").alias("low"), F.max("o").alias("high")).filter("low < high").select("v")
    rows = written(every.join(busy, "v"), "variants")
    cut, whole = rows.filter("i >= 0"), rows.filter("i < 0").select("v", F.col("o").alias("short"))
    # a replaced word: the earliest line with the same rest and place
    same = cut.groupBy("v", "i").agg(F.min("o").alias("first"), F.max("o").alias("last")).filter("first < last").drop("last")
    replaced = cut.join(same, ["v", "i"]).select("o", "first")
    # a removed word: the shorter line is the rest itself
    to_short = cut.join(whole, "v").select("o", F.col("short").alias("first"))
    earliest = cut.groupBy("v").agg(F.min("o").alias("first"))
    to_long = whole.join(earliest, "v").select(F.col("short").alias("o"), "first")
    found = replaced.unionByName(to_short).unionByName(to_long).groupBy("o").agg(F.min("first").alias("first")).filter("first < o")
    pairs = found.join(able.select("o", "h", "n", "line"), "o").join(able.select(F.col("o").alias("first"), F.col("line").alias("other")), "first")
    return pairs.filter(_lines_one_edit(F.col("line"), F.col("other"))).select("h", "n")


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = STEP) -> DataFrame:
    """(_row, kept): numbers of the lines that stay of each document, ascending; ``docs`` needs ``_row``."""
    lines = written(distinct_lines(docs, id_col, text_col, min_words), "distinct")
    near = neighbours(docs, lines, id_col, text_col, min_words)
    stay = lines.select("h", "n", "at").join(near, ["h", "n"], "left_anti")
    return stay.groupBy(F.col("at._row").alias("_row")).agg(F.array_sort(F.collect_list("at._line")).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = STEP) -> DataFrame:
    """Every document with ``n_lines``, ``kept`` (line numbers from 0) and the text of the lines that stay.

    A line goes when an earlier line, in the order of ids, then of line numbers, has the same words, or has
    ``min_words`` words or more, as it has itself, and is one word edit away. Words are what stands between blanks;
    lines without words always stay. Columns of the input are kept, but for names that begin with an underscore or
    clash with the new ones. A null text has one empty line and comes back empty; a null id comes first. Rows that
    repeat id and text share one decision; with another text under the same id they are ordered by a hash of it.
    An empty table gives no rows, and a very long line is a row like any other.
    """
    new = {"n_lines", "kept"}
    rows = with_row_key(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new and not c.startswith("_")]), id_col, text_col)
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    kept = kept_lines(rows, id_col, text_col, min_words)
    out = rows.join(kept, "_row", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    return out.withColumns({
        "n_lines": F.size(split), text_col: F.array_join(F.transform("kept", lambda i: F.get(split, i)), "\n"),
    }).drop("_row")


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = STEP) -> DataFrame:
    """(id, n_lines, n_kept, kept_lines): the decisions of ``dedup_lines`` without the texts."""
    rows = with_row_key(docs.select(id_col, text_col), id_col, text_col)
    kept = kept_lines(rows, id_col, text_col, min_words)
    sized = rows.select(id_col, "_row", F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"))
    kept = F.coalesce("kept", F.array().cast("array<int>")), kept
    return sized.join(kept[1], "_row", "left").select(
        id_col, "n_lines", F.size(kept[0]).cast("bigint").alias("n_kept"), F.array_join(kept[0].cast("array<string>"), ",").alias("kept_lines")
    )
