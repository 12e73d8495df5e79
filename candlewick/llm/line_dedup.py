"""Line dedup (operator 1), in DataFrame functions only: a deletion-neighbourhood join.

A line goes if an equal line, or one within one character edit (insertion, deletion or substitution), comes earlier in the
corpus, in the order of doc_id and line number.

1. Distinct lines keep their earliest place; equal later ones go.  A line is known by a 128-bit hash from here on.
2. Two lines within one edit of each other agree once the edited character is left out: a line of n characters emits its n
   variants with one character deleted (with the place: two lines of one length that agree there differ by one
   substitution), and a line of n - 1 characters emits itself (it agrees with a variant of a line with one more).
3. Emitting all variants of all lines would multiply the corpus by its line length.  So each line is first cut to blocks, and
   emits its deletion neighbourhood over blocks: hashes of all blocks but one.  An edit is in one block and leaves the
   others equal, so only where two distinct lines agree on all blocks but one are the characters of that block deleted
   one by one.  Nothing is lost: the blocks hold every edit.
4. Lines with an equal variant are compared with the earliest of them, and the edit distance is verified.  All lines that agree
   but for one place are within one substitution of each other, so the earliest is enough.

Short lines (below ``least`` characters) are removed only if equal: one edit makes another word or number of them.  least=0
compares all lines in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import hot_join, row_key, scratch, stored, unstore

BLOCK, BLOCKS = 256, 256  # characters of a block; beyond so many blocks they grow, so a line costs its length times BLOCKS
FEW = 2_000_000  # hashes that are broadcast at most (16 MB)
COUNTS = ("n_lines", "n_equal", "n_near")


def has_word(text: Column | str) -> Column:
    """Whether a text has a character other than blanks: it stops at the first one, where a regular expression decodes all."""
    return F.ltrim(text, F.lit(" \t\n\v\f\r")) != ""


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_key, at (doc_id, line number), line, h1, h2: the lines with a word."""
    # keys first: beside the generator they would be computed, and the text copied, for each line
    keyed = docs.select("doc_id", row_key().alias("doc_key"), F.split("text", "\n").alias("lines"))
    cut = keyed.select("doc_id", "doc_key", F.posexplode("lines").alias("line_no", "line"))
    cut = cut.where(has_word("line"))
    at = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "doc_key", "line_no")
    return cut.select("doc_key", at.alias("at"), "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def blocks_of(lines: DataFrame, *carried: str) -> DataFrame:
    """One row for each line, role and block: whether the line is the longer of a pair or not (role 1: by one; role 0: equal
    length or the shorter one), the block's number, the hash of all that is outside, and the text inside."""
    n = F.length("line")
    roles = lines.withColumn("n", n).withColumn("role", F.explode(F.array(F.lit(0), F.lit(1))))
    # lengths and blocks are those of the shorter line of a pair
    roles = roles.withColumn("short", F.col("n") - F.col("role"))
    count = F.least(F.lit(BLOCKS), F.greatest(F.lit(2), F.ceil(F.col("short") / BLOCK))).cast("int")
    rows = roles.withColumn("count", count).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    rows = rows.withColumn("low", F.floor(F.col("short") * F.col("block") / F.col("count")).cast("int"))
    rows = rows.withColumn("high", F.floor(F.col("short") * (F.col("block") + 1) / F.col("count")).cast("int") + F.col("role"))
    outside = F.xxhash64("short", "block", F.substring("line", F.lit(1), F.col("low")), F.substring("line", F.col("high") + 1, F.col("n")))
    inside = F.substring("line", F.col("low") + 1, F.col("high") - F.col("low"))
    return rows.select("h1", "h2", *carried, "role", "n", "low", outside.alias("outside"), inside.alias("inside"))


def variants_of(blocks: DataFrame) -> DataFrame:
    """The variants: kind "same" (one place differs) and "more" (one line has one character more), with a key."""
    size = F.length("inside")
    places = F.when((F.col("role") == 0) & (size > 0), F.sequence(F.lit(0), size - 1)).when(F.col("role") == 1, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    # role 0 emits itself too, under place -1
    places = F.when(F.col("role") == 0, F.concat(F.array(F.lit(-1)), places)).otherwise(places)
    rows = blocks.withColumn("place", F.explode(places))
    left = F.when(F.col("place") < 0, F.col("inside")).otherwise(F.concat(F.substring("inside", F.lit(1), F.col("place")), F.substring("inside", F.col("place") + 2, size)))
    more = (F.col("role") == 1) | (F.col("place") < 0)
    # a substitution pairs lines that are changed at the same place
    where = F.when(more, F.lit(-1)).otherwise(F.col("place"))
    return rows.select("h1", "h2", "role", more.alias("more"), (F.col("low") + F.col("place")).alias("spot"), F.xxhash64("outside", where, left).alias("variant"))


def near_lines(docs: DataFrame, least: int) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier line within one edit."""
    long_ = lines_of(docs).where(F.length("line") >= least)
    keys = stored(blocks_of(long_).select("outside", "h1"), "block-keys")
    met = keys.groupBy("outside").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.count("*").alias("n")).where("low < high")
    met = stored(met.select("outside", "n"), "met-keys")
    asked = stored(hot_join(keys, met, ["outside"], "n", keys.count()).groupBy("h1").agg(F.collect_set("outside").alias("open")), "open-lines")
    unstore(keys)
    # only lines that agree with another but for one block go on, with their text
    hashes = asked.agg(F.coalesce(F.sum(F.size("open") + 1), F.lit(0))).first()[0]
    some = long_.join(F.broadcast(asked) if hashes <= FEW else asked, "h1").groupBy("h1", "h2").agg(F.first("line").alias("line"), F.first("open").alias("open"), F.min("at").alias("first"))
    some = stored(some, "near-lines")
    rows = blocks_of(some, "open").where(F.array_contains("open", F.col("outside")))
    variants = variants_of(rows)
    # of plain numbers, which are aggregated by hash; places come to the few variants that two lines share
    shared = variants.groupBy("more", "variant").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("more", "variant")
    shared = stored(variants.join(shared, ["more", "variant"]).join(some.select("h1", "h2", "first"), ["h1", "h2"]), "shared-variants")
    earliest = lambda role: F.min(F.when(F.col("role") == role, F.struct("first", "h1", "h2", "spot")))
    pairs = shared.join(shared.groupBy("more", "variant").agg(earliest(0).alias("short"), earliest(1).alias("long")), ["more", "variant"])
    # of a group with one character more and less, each line meets the earliest of the other length
    other = F.when(~F.col("more"), F.col("short")).when(F.col("role") == 0, F.col("long")).otherwise(F.col("short"))
    pairs = pairs.withColumn("other", other).where("other.first < first")
    # the place of the character that differs, or that the longer line has more
    spot = F.when(F.col("more") & (F.col("role") == 0), F.col("other.spot")).otherwise(F.col("spot"))
    pairs = pairs.select("h1", "h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"), spot.alias("spot")).distinct()
    texts = some.select("h1", "h2", "line")
    others = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("earlier"))
    both = pairs.join(texts, ["h1", "h2"]).join(others, ["o1", "o2"])
    return both.where(one_edit("line", "earlier", F.col("spot"))).select("h1", "h2").distinct()


def one_edit(a: str, b: str, spot: Column) -> Column:
    """Whether two lines are the same but for the character at `spot`: another one, or one more in the longer line.  Found in one
    pass, where a general edit distance is slow on very long lines."""
    n, m = F.length(a), F.length(b)
    without = lambda c, size: F.concat(F.substring(c, F.lit(1), spot), F.substring(c, spot + 2, size))
    return F.when(n == m, without(a, n) == without(b, m)).when(n == m + 1, without(a, n) == F.col(b)).when(n + 1 == m, F.col(a) == without(b, m)).otherwise(False)


def deduplicated(docs: DataFrame, least: int = 20, counts: bool = True) -> DataFrame:
    """All columns of docs with `text` cleaned, and n_lines (with a word), n_equal and n_near (removed); a row for each row.

    A null text stays null, an empty one empty; lines without a word stay where they are.  A null doc_id comes last in the
    order.  Rows with equal doc_id and text are one document here: it keeps the lines of its first copy, in each of
    its rows.  A line that occurs twice in a text stays once.  Very long lines are compared like others.  Columns of docs
    with a name of COUNTS give way to the counts; with counts=False the result has the columns of docs, all of them.
    """
    with scratch(docs.sparkSession) as keep:
        gone = keep(_gone(docs, least), "gone")
    whole = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("doc_key")).join(gone, "doc_key", "left")
    lines = F.split("row.text", "\n")
    # a lambda's own variable holds the lines, so that the text is cut once and not for each line
    left = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "gone")
    joined = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(left(ls), lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.get(joined, F.lit(0)))
    n_lines = F.size(F.filter(F.coalesce(lines, F.array().cast("array<string>")), has_word))
    n_gone, n_near = F.coalesce(F.size("gone"), F.lit(0)), F.coalesce("n_near", F.lit(0))
    columns = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if not counts or c not in COUNTS]
    return whole.select(*columns, *([n_lines.alias("n_lines"), (n_gone - n_near).alias("n_equal"), n_near.alias("n_near")] if counts else []))


def _gone(docs: DataFrame, least: int) -> DataFrame:
    """doc_key, gone (numbers of the lines that go), n_near (how many of them are near an earlier line)."""
    # of plain numbers, aggregated by hash; only the places of repeated and near lines are compared
    counts = lines_of(docs).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    repeated = stored(counts.where("n > 1"), "repeated-lines")
    near = stored(near_lines(docs, least), "near")
    judged = repeated.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "full")
    judged = stored(judged.select("h1", "h2", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("near", F.lit(False)).alias("near")), "judged")
    total = judged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = stored(hot_join(lines_of(docs).select("h1", "h2", "at"), judged, ["h1", "h2"], "n", total), "met-lines")
    # every line but the earliest of its kind goes, and the earliest too if it is near an earlier one
    first = met.where("not near").groupBy("h1", "h2").agg(F.min("at").alias("at")).select("at", F.lit(False).alias("near"), F.lit(True).alias("stays"))
    places = met.select("at", "near", F.lit(False).alias("stays")).union(first)
    # copies of a row give each line again
    numbers = lambda which: F.collect_set(F.when(which, F.col("at.line_no")))
    found = places.groupBy(F.col("at.doc_key").alias("doc_key")).agg(numbers(~F.col("stays")).alias("all"), numbers(F.col("stays")).alias("kept"), F.size(numbers(F.col("near"))).alias("n_near"))
    return found.select("doc_key", F.array_except("all", "kept").alias("gone"), "n_near").where(F.size("gone") > 0)


def text_left() -> Column:
    """Whether a text still has a word."""
    return F.coalesce(has_word("text"), F.lit(False))


def oracle(least: int = 20) -> str:
    """The same in DuckDB's SQL: near lines by their edit distance among lines that share a half."""
    word = r"[^\x20\x09-\x0D]"
    return rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT * FROM l WHERE regexp_matches(line, '{word}')),
f AS (SELECT line, min(doc_id * 1000000 + i) AS first, length(line) AS n FROM w GROUP BY line),
k AS (SELECT *, unnest([0, 1]) AS role, unnest([n, n - 1]) AS short FROM f WHERE n >= {least}),
h AS (SELECT *, unnest(['a' || left(line, (short // 2)::INT), 'b' || right(line, (short - short // 2)::INT)]) AS half FROM k),
near AS (SELECT DISTINCT x.line FROM h x JOIN h y ON x.short = y.short AND x.half = y.half AND x.role + y.role < 2
  WHERE y.first < x.first AND levenshtein(x.line, y.line) = 1),
j AS (SELECT w.doc_id, w.i, w.line, near.line IS NOT NULL AS near, w.doc_id * 1000000 + w.i <> f.first AS again
  FROM w JOIN f USING (line) LEFT JOIN near USING (line)),
s AS (SELECT doc_id, count(*) AS n_lines, sum((again AND NOT near)::INT) AS n_equal, sum(near::INT) AS n_near FROM j GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l LEFT JOIN j ON l.doc_id = j.doc_id AND l.i = j.i
  WHERE NOT coalesce(j.near OR j.again, false) GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(n_lines, 0)::INT AS n_lines,
  coalesce(n_equal, 0)::INT AS n_equal, coalesce(n_near, 0)::INT AS n_near FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)"""
