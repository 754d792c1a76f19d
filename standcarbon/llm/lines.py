"""Line dedup: lines within one edit of an earlier line go, and short lines that are equal to an
earlier one. DataFrame functions only.

Segment-partition edit join. With a threshold of one edit a line has two segments, its halves. Two
lines within one edit agree in one of them: the first half at the start of both, or the second
half at their ends, where the halves are those of the shorter line. So each line is posted
under its own halves and, as a possible longer partner, under the halves that a line one shorter
would have; substrings are looked up together with the lengths. Posting and counting need hashes
only; texts are fetched for lines that meet, and verified by Spark's banded `levenshtein`.

Under a crowded posting no pairs are formed: the unequal half is posted with each of its characters
left out. Lines that then meet are within one edit by construction, and a star links them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standcarbon.llm.graphs import stars
from standcarbon.session import discard, staged

# Shorter lines (in characters, without blanks at both ends) are compared exactly.
MIN_CHARS = 20
# Lines under one posting that are compared pair by pair.
PAIRWISE = 64
BITMAP_BITS = 25
BLANKS = " \t\r\x0b\x0c"
_FIRST, _SECOND = 1, 2
_OWN, _LONGER = 0, 1


def split_lines(docs: DataFrame, doc_id: str, text: str, row: Column | None = None) -> DataFrame:
    """(row, doc_id, pos, line, chars); `row` numbers the rows of `docs` and needs fixing."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    numbered = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.split(whole, "\n").alias("lines"),
    )
    exploded = numbered.select("row", "doc_id", F.posexplode("lines").alias("pos", "raw"))
    line = F.btrim("raw", F.lit(BLANKS))
    return exploded.select("row", "doc_id", "pos", line.alias("line"), F.length(line).alias("chars"))


def line_hash(line: Column, chars: Column) -> Column:
    return F.xxhash64(line, chars)


def _half(chars: Column) -> Column:
    return F.floor(chars / 2).cast("int")


def _segments(line: Column, chars: Column, of: Column) -> tuple[Column, Column]:
    """Hashes of the two segments that a line of length `of` would have, read in `line`."""
    first = F.substr(line, F.lit(1), _half(of))
    size = of - _half(of)
    return F.xxhash64(first), F.xxhash64(F.substr(line, chars - size + 1, size))


def facts(lines: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Lines of `least` characters as numbers: where they are, their hash, length and segment
    hashes."""
    line, chars = F.col("line"), F.col("chars")
    own, longer = _segments(line, chars, chars), _segments(line, chars, chars - 1)
    return lines.filter(chars >= least).select(
        "row", "doc_id", "pos", "chars", line_hash(line, chars).alias("h"),
        own[0].alias("own1"), own[1].alias("own2"),
        longer[0].alias("longer1"), longer[1].alias("longer2"),
    )


def _posted(distinct: DataFrame) -> DataFrame:
    """(h, key, role, segment): four postings a line."""

    def posting(role: int, segment: int, of: Column, value: str) -> Column:
        key = F.xxhash64(of, F.lit(segment), F.col(value))
        return F.struct(key.alias("key"), F.lit(role).alias("role"), F.lit(segment).alias("segment"))

    chars = F.col("chars")
    postings = F.array(
        posting(_OWN, _FIRST, chars, "own1"),
        posting(_OWN, _SECOND, chars, "own2"),
        posting(_LONGER, _FIRST, chars - 1, "longer1"),
        posting(_LONGER, _SECOND, chars - 1, "longer2"),
    )
    return distinct.select("h", F.explode(postings).alias("p")).select("h", "p.*")


def _candidates(cold: DataFrame) -> DataFrame:
    """Pairs (a, b) under postings with few lines; one of them is of the posting's length."""
    grouped = cold.groupBy("key").agg(F.collect_list(F.struct("role", "h")).alias("g"))
    own = F.filter("g", lambda x: x["role"] == _OWN)
    each = grouped.select("g", F.explode(own).alias("x"))

    def partner(y: Column) -> Column:
        return (y["role"] == _LONGER) | (y["h"] > F.col("x.h"))

    pairs = each.select(F.col("x.h").alias("a"), F.explode(F.filter("g", partner)).alias("y"))
    return pairs.select("a", F.col("y.h").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    named = [texts.select(F.col("h").alias(n), F.col("line").alias(f"line_{n}")) for n in "ab"]
    both = pairs.join(named[0], "a").join(named[1], "b")
    return both.filter(F.levenshtein("line_a", "line_b", 1) >= 0).select("a", "b")


def _left_out(hot: DataFrame) -> DataFrame:
    """Links under crowded postings: hot(h, line, chars, role, segment).

    A changed character leaves equal texts before and after it; an added one leaves, without it,
    the shorter line. Each position of the half that need not agree is posted with the hashes of
    what is before and after; an end is allowed on both sides of the border between the halves.
    """
    chars, line = F.col("chars"), F.col("line")
    length = F.when(F.col("role") == _OWN, chars).otherwise(chars - 1)
    low = F.when(F.col("segment") == _FIRST, _half(length)).otherwise(F.lit(0))
    high = F.when(F.col("segment") == _FIRST, length).otherwise(_half(length))
    placed = hot.select("h", "role", line.alias("line"), chars.alias("chars"),
                        length.alias("length"), F.explode(F.sequence(low, high)).alias("j"))
    j = F.col("j")
    before = F.xxhash64(F.substr("line", F.lit(1), j))
    rest = lambda skip: F.xxhash64(F.substr("line", j + skip + 1, F.col("chars")))
    own = F.col("role") == _OWN
    changed = placed.filter(own & (j < F.col("chars"))).select(
        "h", F.xxhash64(F.lit("c"), "length", "j", before, rest(1)).alias("key")
    )
    gap = F.xxhash64(F.lit("g"), "length", "j", before, F.when(own, rest(0)).otherwise(rest(1)))
    gaps = placed.select("h", "role", gap.alias("key")).distinct()
    met = changed.distinct().groupBy("key").agg(F.min("h").alias("b"), F.count(F.lit(1)).alias("n"))
    same = changed.distinct().join(met.filter("n > 1"), "key").select(F.col("h").alias("a"), "b")
    shorter = gaps.filter(own).groupBy("key").agg(F.min("h").alias("b"))
    added = gaps.filter(~own).join(shorter, "key").select(F.col("h").alias("a"), "b")
    return same.unionByName(added).filter("a <> b").distinct()


def _maybe(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `lines` whose hash may be among `wanted`, by a bitmap of 2 ** BITMAP_BITS places.

    The bitmap has 4 MB whatever the data, so it can be broadcast. It drops most lines before
    their texts are shuffled; which of the rest are wanted is for a join to say.
    """
    place = lambda h: F.pmod(h, F.lit(1 << BITMAP_BITS)) + 1
    bucket = F.bitmap_bucket_number(place(F.col("h")))
    bit = F.bitmap_bit_position(place(F.col("h")))
    bits = wanted.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    near = lines.withColumns({"bucket": bucket, "bit": bit}).join(F.broadcast(bits), "bucket")
    byte = F.conv(F.hex(F.substr("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    held = F.getbit(byte.cast("int"), F.pmod("bit", F.lit(8)).cast("int")) == 1
    return near.filter(held).drop("bucket", "bit", "bits")


def links(distinct: DataFrame, lines: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Pairs (a, b) of line hashes that link all lines within one edit of each other."""
    posted = staged(_posted(distinct))
    crowd = posted.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == _OWN).alias("n_own")
    )
    crowd = crowd.filter("n > 1 and n_own > 0").select("key", "n")
    crowded = staged(posted.join(crowd, "key"))
    discard(posted)
    pairs = staged(_candidates(crowded.filter(F.col("n") <= pairwise)))
    hot = crowded.filter(F.col("n") > pairwise).select("h", "role", "segment")
    wanted = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h")))
    wanted = staged(wanted.unionByName(hot.select("h")).distinct())
    hashed = lines.filter(F.col("chars") >= MIN_CHARS).select(
        line_hash(F.col("line"), F.col("chars")).alias("h"), "line", "chars"
    )
    # Copies of a line are one text here; they are dropped before the texts are shuffled.
    first = _maybe(hashed, wanted).join(wanted, "h", "left_semi").dropDuplicates(["h"])
    texts = staged(first)
    return _verified(pairs, texts).unionByName(_left_out(hot.distinct().join(texts, "h")))


def repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    pairwise: int = PAIRWISE,
    short: bool = False,
    row: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, repeated): rows(row, doc_id, n_lines) of `docs`; repeated(row, pos) of the lines
    to drop, that is all of a group of linked lines but the first by id, row and position.

    With `short`, equal lines under MIN_CHARS are a group too; blank lines never are. `row` is a
    number of each row, where `docs` has one.
    """
    lines = split_lines(docs, doc_id, text, row)
    known = staged(facts(lines, 1 if short else MIN_CHARS))
    at = F.struct("doc_id", "row", "pos")
    numbers = ["chars", "own1", "own2", "longer1", "longer2"]
    distinct = known.groupBy("h").agg(
        *[F.min(c).alias(c) for c in numbers],
        F.min(at).alias("first"),
        F.count(F.lit(1)).alias("n"),
    )
    distinct = staged(distinct)
    star = stars(links(distinct.filter(F.col("chars") >= MIN_CHARS), lines, pairwise))
    star = star.select(F.col("a").alias("h"), F.col("b").alias("root"))
    roots = star.unionByName(star.select(F.col("root").alias("h"), "root")).distinct()
    grouped = distinct.select("h", "first", "n").join(roots, "h", "left")
    grouped = grouped.filter("n > 1 or root is not null")
    grouped = staged(grouped.select("h", "first", F.coalesce("root", "h").alias("root")))
    firsts = grouped.groupBy("root").agg(F.min("first").alias("first"))
    several = grouped.select("h", "root").join(firsts, "root").select("h", "first")
    again = known.join(several, "h").filter(
        (F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos"))
    )
    counted = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.size(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")).alias("n_lines"),
    )
    return counted, again.select("row", "pos")


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of removed lines, from 0, for every row.

    A null text counts as empty: one empty line, which stays, as every blank line does. Repeated
    rows: the lines of all but the first go; an empty table gives an empty result; other columns
    are not looked at.
    """
    rows, repeated = repeated_lines(docs, doc_id, text, short=True)
    removed = repeated.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("removed"))
    joined = rows.join(removed, "row", "left")
    none = F.array().cast("array<int>")
    return joined.select(
        F.col("doc_id").alias(doc_id),
        "n_lines",
        F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
        F.coalesce("removed", none).alias("removed"),
    )


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with the lines of `line_report` taken out of the text.

    A text without such lines is unchanged; a text of nothing else becomes empty.
    """
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, inner, strict=True)]
    rows = staged(docs.select(*kept, F.monotonically_increasing_id().alias("_row")), "zstd")
    id_, whole = (inner[docs.columns.index(c)] for c in (doc_id, text))
    _, repeated = repeated_lines(rows, id_, whole, short=True, row=F.col("_row"))
    removed = repeated.groupBy(F.col("row").alias("_row")).agg(F.collect_list("pos").alias("_removed"))
    stays = F.filter(
        F.split(F.col(whole).cast("string"), "\n"),
        lambda _, i: ~F.array_contains(F.col("_removed"), i),
    )
    cut = F.when(F.col("_removed").isNull(), F.col(whole)).otherwise(F.array_join(stays, "\n"))
    joined = rows.join(removed, "_row", "left").withColumn(whole, cut)
    return joined.select(*inner).toDF(*docs.columns)
