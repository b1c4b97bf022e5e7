"""Line dedup: an exact set-similarity join of lines by prefix, position and length, in DataFrame functions only."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .util import cut, release, remove, tidied

THRESHOLD = 0.8
#: Words are counted in so many buckets: a table of this size, whatever the corpus.
BUCKETS = 1 << 18
#: Lines of at most this many words are indexed by pairs of prefix words.
SHORT = 15
#: Lines of fewer distinct words are left alone: by default those without any.
MIN_WORDS = 1
#: Index entries that may share a key before the key is salted.
GROUP = 50_000
#: Of lines with more neighbouring words in their prefix than this, those are keys by which they meet leaders that a hash
#: chooses, so many to twice as many: near copies choose the same.
LEADS = 3
#: Bytes of the bit set that keeps lines without a candidate out of a shuffle. A corpus with more candidates than it
#: tells apart shuffles more lines; the exact join that follows decides.
FILTER = 1 << 18
#: True for every row. A filter with it doesn't move below a shuffle, so that one shuffle serves two readers.
STAYS = "spark_partition_id() >= 0"
#: Blanks that end a word beside U+0020.
BLANKS = "\t\x0b\x0c\r"


def words(line: Column) -> Column:
    """What blanks separate (other blanks are U+0020 by now, see `all_lines`)."""
    return F.array_remove(F.split(line, " "), "")


def hashes(line: Column) -> Column:
    """A line's distinct words, as 64-bit hashes."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def constant(rows: DataFrame, size: int) -> tuple[Column, str]:
    """Rows (b, v), one for each b at most, as a constant array of `size` bytes: v, of 0 to 127, or 0 for every b below size;
    and the place of the table that holds it. It is a subquery, as every text of a plan would spell out a literal."""
    every = rows.select(F.col("b").cast("long").alias("b"), F.col("v").cast("int").alias("v")).union(rows.sparkSession.range(size).select(F.col("id").alias("b"), F.lit(0).alias("v")))
    one = every.groupBy("b").agg(F.sum("v").alias("v")).agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("all"))
    bytes_, place = cut(one.select(F.transform("all", lambda x: x["v"].cast("tinyint")).alias("bytes")), "line-constant")
    return bytes_.scalar(), place


def at(constant: Column, place: Column) -> Column:
    """The byte of a constant at a place from 0."""
    return F.coalesce(F.get(constant, place).cast("int"), F.lit(0))  # never null: what holds it is sorted as longs


def commonness(lines: DataFrame) -> tuple[Column, str]:
    """A constant of bytes and its place: for each bucket of words four times the binary logarithm of how often they occur in all
    lines."""
    bucket = F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    counted = lines.select(F.explode(F.split(F.col("line"), " ")).alias("w")).where("w <> ''").groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    return constant(counted.select("b", F.least(F.lit(127), F.floor(F.log2("n") * 4)).alias("v")), BUCKETS)


def ranked(words: Column, common: Column) -> Column:
    """A line's distinct words (hashes) as sorted longs, rarest first: how common the word's bucket is, over 52 bits of the
    word's hash. Any one order of all words gives exact results; this one puts rare words into the prefixes."""
    level = lambda h: F.call_function("shiftleft", at(common, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long"), F.lit(52))
    return F.sort_array(F.transform(words, lambda h: level(h).bitwiseOR(F.shiftrightunsigned(h, 12))))


def texts(docs: DataFrame) -> tuple[Column, Column]:
    """doc_id (null ids before all others) and text, in which every blank is U+0020 or a newline."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    other = F.contains(text, F.lit(BLANKS[0]))
    for c in BLANKS[1:]:
        other |= F.contains(text, F.lit(c))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.when(other, F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)


def identity(line: Column) -> list[Column]:
    """128 bits that tell lines apart."""
    return [F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line).alias("y")]


def all_lines(docs: DataFrame) -> DataFrame:
    """doc_id, no (from 0), line, x and y (its identity) of every line that isn't empty."""
    doc_id, text = texts(docs)
    return docs.select(doc_id.alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line")).where("line <> ''").select("doc_id", "no", "line", *identity(F.col("line")))


def least_overlap(n: Column, threshold: float) -> Column:
    """Words that a line of n words has in common with any similar line at least."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")


def ranked_lines(lines: DataFrame, common: Column, threshold: float, min_words: int) -> DataFrame:
    """The distinct lines: identity x, first place (doc_id, no), size n, parity bits, p, the prefix of
    n - overlap + 2 words, and into how many parts its commonest word, the last, salts a key."""
    n = F.col("n")
    return (
        lines.where(F.length("line") >= 2 * min_words - 1)
        .select("x", "y", "doc_id", "no", hashes(F.col("line")).alias("h"), F.spark_partition_id().alias("part"))
        .where("part >= 0")  # always; it keeps the two apart, or each row would take a copy of the constant along
        .select("x", "y", "doc_id", "no", "h", common.alias("common"))  # lambdas take no subquery itself
        .select("x", "y", "doc_id", "no", F.size("h").alias("n"), *parity(F.col("h")), ranked(F.col("h"), F.col("common")).alias("s"))
        .select("x", "y", "doc_id", "no", "n", "bits", "more_bits", F.slice("s", 1, n - least_overlap(n, threshold) + 2).alias("p"))
        .groupBy("x", "y")
        .agg(F.min(F.struct("doc_id", "no")).alias("f"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("more_bits").alias("more_bits"), F.first("p").alias("p"), F.count("*").alias("copies"))
        .where(n >= min_words)  # here, as a filter before the grouping would rank every line's words twice
        .select("x", F.col("f.doc_id").alias("doc_id"), F.col("f.no").alias("no"), "n", "bits", "more_bits", "p", "copies", salts(F.get("p", F.size("p") - 1)).alias("most_salts"))
    )


def salts(word: Column) -> Column:
    """Parts of a key whose rarer word is this one: by its bucket's count, rounded up."""
    level = F.shiftrightunsigned(word, 52)
    return F.when(level < int(4 * math.log2(GROUP)) - 1, 1).otherwise(F.ceil(F.pow(F.lit(2.0), level / F.lit(4.0) + F.lit(1 / 4)) / F.lit(GROUP)).cast("int"))


def salt(salts: Column) -> Column:
    return F.when(salts > 1, F.pmod(F.xxhash64("x", F.lit(3)), salts).cast("int")).otherwise(-1)


def salted_lines(once: DataFrame) -> DataFrame:
    """Lines that have entries under salted keys. The filter is on a number as it is stored, so that a scan passes over
    the row groups without such lines."""
    return once.where(F.col("most_salts") > 1)


def key(t: Column, salt: Column) -> Column:
    """Both as one long, which sorts by its bits alone. Keys that fall together only add pairs to compare."""
    return F.when(salt < 0, t).otherwise(F.xxhash64(t, salt))


def entries(once: DataFrame, threshold: float, keep: list[str]) -> DataFrame:
    """Prefix entries of lines: key t and salt (of so many salts), place i of the entry's word in the line's order and
    the columns in `keep`. Similar lines share a word of their prefixes of n - overlap + 1 words, and two words of
    prefixes longer by one; short lines, whose prefixes hold common words too, use the second rule, so that their
    keys are rare. The two kinds are made apart: in one, the code is too long for the JVM to compile."""
    n, u, v, size = F.col("n"), F.col("u"), F.col("v"), F.size("p")
    # a line of at most SHORT * threshold words has no similar line above SHORT: only lines between need both kinds
    # of entry; one of at most 1 / threshold words may share a single word with a similar line
    alone = once.where((n > int(SHORT * threshold)) | (n <= int(1 / threshold + 1e-9)))
    single = alone.select(*keep, F.posexplode(F.slice("p", 1, n - least_overlap(n, threshold) + 1)).alias("i", "u")).select(*keep, (F.col("i") + 1).alias("i"), "u", u.alias("t"))
    # the pairs (1, 2), (1, 3), (2, 3), (1, 4), ...: the greater place, then the lesser
    double = (
        once.where((n <= SHORT) & (size > 1))
        .select(*keep, "p", F.explode(F.sequence(F.lit(1), F.expr("size(p) * (size(p) - 1) div 2").cast("int"))).alias("q"))
        .withColumn("i", F.ceil((F.sqrt(F.col("q") * 8 + 1) - 1) / 2).cast("int") + 1)
        .withColumn("lo", F.col("q") - F.expr("(i - 1) * (i - 2) div 2").cast("int"))
        .select(*keep, "i", F.element_at("p", F.col("lo")).alias("u"), F.element_at("p", F.col("i")).alias("v"))
        .select(*keep, "i", "u", F.xxhash64(u, v).alias("t"))  # the rarer word comes first
    )
    return single.union(double).select(*keep, "i", "t", salts(u).alias("salts")).select(*keep, "i", "t", "salts", salt(F.col("salts")).alias("salt"))


def indexed(threshold: float) -> Column:
    """Of entries those by which a line meets lines that are no shorter: what it shares with them is at least
    2 t / (1 + t) of its own words, so the first shared word (or the second) is that much nearer to the front."""
    n = F.col("n")
    most = n - F.ceil(n * F.lit(2 * threshold / (1 + threshold)) - F.lit(1e-9)).cast("int") + F.when(n <= SHORT, 2).otherwise(1)
    return F.col("i") <= most


def parity(h: Column) -> list[Column]:
    """64 bits for the words with the highest bit of their hash, 64 for all words, each telling whether an odd number of
    these words of a line falls on it. Both together give the bits of the words without the highest bit, for less than
    these cost: see `differing`."""
    place = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    high = F.aggregate(h, zero, lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", F.shiftrightunsigned(h, 63), place(h))))
    return [high.alias("bits"), F.aggregate(h, zero, lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", one, place(h)))).alias("more_bits")]


def differing(a: str, b: str) -> Column:
    """In how many parity bits, of 64 for either half of the words, two lines differ: in at least so many words they do."""
    high, every = (F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")) for c in ("bits", "more_bits"))
    return F.bit_count(high) + F.bit_count(high.bitwiseXOR(every))


def promising(a: str, b: str, threshold: float, first: bool) -> Column:
    """Length, position and parity filters for lines under two prefixes of column names, that share the words at
    places i. `first` assumes that they share none before, as holds for one of the words of every similar pair
    that are keys by themselves."""
    n, i, m, j = (F.col(f"{p}{c}") for p in (a, b) for c in ("n", "i"))
    need = F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    alone = (n > SHORT) | (m > SHORT)
    before = F.when(alone, 1).otherwise(F.least(i, j)) if first else F.least(i, j)
    return (F.least(n, m) >= F.greatest(n, m) * F.lit(threshold) - F.lit(1e-9)) & (before + F.least(n - i, m - j) >= need) & (differing(a, b) <= n + m - 2 * need)


def maybe_in(x: Column, wanted: DataFrame) -> tuple[Column, str]:
    """And the place of its table. False only for hashes that aren't among those wanted: a bit set of 7 bits in each of FILTER bytes, built from
    all of them."""
    place, bit = lambda x: F.pmod(x, F.lit(FILTER)).cast("int"), lambda x: F.pmod(F.shiftrightunsigned(x, 32), F.lit(7)).cast("int")
    bits = wanted.groupBy(place(F.col("x")).alias("b")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), bit(F.col("x")))).alias("v"))
    held, kept = constant(bits, FILTER)
    return F.getbit(at(held, place(x)), bit(x)) == 1, kept


def verified(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (x, o) of lines the identity, x and y, of those x whose word sets are similar to the other's. The words
    are kept in buckets by x: of both joins only the pairs, and what the first adds to them, are shuffled."""
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted, place = cut(pairs.select("x").union(pairs.select(F.col("o").alias("x"))).distinct(), "lines-wanted")
    maybe, kept = maybe_in(F.col("x"), wanted)
    own = lines.where(maybe).select("x", "y", "line").dropDuplicates(["x", "y"]).join(wanted, "x", "left_semi").select("x", "y", hashes(F.col("line")).alias("w"))
    name = f"line_words_{uuid.uuid4().hex}"
    with tidied(spark):
        own.write.bucketBy(parts, "x").format("parquet").saveAsTable(name)
    try:
        own = spark.table(name)
        joined = pairs.join(own, "x").join(own.select(F.col("x").alias("o"), F.col("w").alias("v")), "o")
        common = F.size(F.array_intersect("w", "v"))
        similar, _ = cut(joined.where(common >= (F.size("w") + F.size("v") - common) * F.lit(threshold) - F.lit(1e-9)).select("x", "y").distinct(), "lines-dead")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for done in (place, kept):
        remove(spark, done)
    release(spark)
    return similar


def leaders(once: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, o): of the lines that share two neighbouring words of their prefixes each against the earliest, the
    one before, and of the earlier ones that with the most copies, where the filters let it. So copies that differ a
    little cost a few comparisons each, however many there are. It need not find all: what it misses, the prefix join
    finds."""
    parts = int(once.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    u, pairs = lambda k: F.get("p", k), F.greatest(F.lit(1), F.size("p") - 1)
    t = lambda k: F.xxhash64(u(k), F.coalesce(u(k + 1), u(k)))
    own = ["x", "doc_id", "no", "n", "bits", "more_bits", "copies"]
    # one in 2^j, so that what a line of fewer words chooses holds what one of more words does
    rest = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.floor(F.log2(pairs / F.lit(LEADS))).cast("int"))) - 1
    few = once.select(*own, "p", rest.alias("rest"), F.sequence(F.lit(0), pairs - 1).alias("places"))
    few = few.select(*own, "p", F.explode(F.filter("places", lambda k: F.shiftrightunsigned(t(k), 20).bitwiseAND(F.col("rest")) == 0)).alias("k"))
    found = few.select(*own, key(t(F.col("k")), salt(salts(u(F.col("k"))))).alias("t")).repartition(parts, "t")
    # keys that come up once are counted away, as the window takes long over each; the condition names all columns, so
    # that both read one shuffle
    found = found.where(F.expr(STAYS) | F.coalesce(*own).isNull())
    found = found.join(found.groupBy(F.col("t").alias("shared")).agg(F.count("*").alias("lines")).where("lines > 1"), F.col("t") == F.col("shared"), "left_semi").withColumn("i", F.lit(1))
    line, w = F.struct("x", "n", "i", "bits", "more_bits"), Window.partitionBy("t").orderBy("doc_id", "no", "x")
    chosen = {"first": F.first(line).over(w), "before": F.lag(line).over(w), "most": F.max(F.struct("copies", line.alias("line"))).over(w)["line"]}
    found = found.withColumns(chosen)
    held = {c: F.when((F.col(f"{c}.x") != F.col("x")) & promising("", f"{c}.", threshold, True), F.col(f"{c}.x")).alias(c) for c in chosen}
    found = found.select("x", *held.values()).where(F.coalesce(*held).isNotNull())
    return found.select("x", F.explode(F.array_compact(F.array_distinct(F.array(*held)))).alias("o")).distinct()


def dead_lines(lines: DataFrame, threshold: float, min_words: int) -> DataFrame:
    """Identity, x and y, of every distinct line that is similar to one whose first place is earlier.

    First each line meets a few leaders. Lines that this leaves meet all earlier lines that share a key. Of both the
    candidates are verified on their words, and what is similar is dead."""
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, places = f"line_index_{uuid.uuid4().hex}", []
    # buckets by x: what is dead joins without another shuffle of the lines
    common, place = commonness(lines)
    release(spark)
    with tidied(spark):
        ranked_lines(lines, common, threshold, min_words).repartition(parts, "x").write.bucketBy(parts, "x").format("parquet").saveAsTable(name)
    remove(spark, place)
    try:
        once = spark.table(name)
        release(spark)
        pairs, place = cut(leaders(once, threshold), "line-pairs")
        places.append(place)
        release(spark)
        dead = verified(pairs, lines, threshold)
        keep = ["x", "doc_id", "no", "n", "bits", "more_bits", "dead"]
        left = once.join(dead.select("x").distinct().withColumn("dead", F.lit(True)), "x", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
        all_ = entries(left, threshold, keep).select(*keep, "i", key(F.col("t"), F.col("salt")).alias("t")).repartition(parts, "t")
        a, b = all_.where(indexed(threshold) & F.expr(STAYS) | ~F.expr(STAYS)).alias("a"), all_.where(STAYS).alias("b")  # one shuffle for both sides
        later = (F.col("a.doc_id") > F.col("b.doc_id")) | (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.no") > F.col("b.no"))
        shorter = (F.col("a.n") < F.col("b.n")) & (F.col("a.x") != F.col("b.x")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.x") < F.col("b.x"))
        open_ = promising("a.", "b.", threshold, True) & shorter & F.when(later, ~F.col("a.dead")).otherwise(~F.col("b.dead"))
        pair = F.when(later, F.struct(F.col("a.x").alias("x"), F.col("b.x").alias("o"))).otherwise(F.struct(F.col("b.x").alias("x"), F.col("a.x").alias("o")))
        rest = a.join(b, (F.col("a.t") == F.col("b.t")) & open_).select(pair.alias("pair")).select("pair.*")
        # a line under a salted key also meets the other salts, one by one
        salted = entries(salted_lines(left), threshold, keep).where("salt >= 0")
        spread = salted.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).where("to < salt").drop("salt").withColumnRenamed("to", "salt")
        c, d = spread.alias("a"), salted.alias("b")
        apart = F.col("a.x") != F.col("b.x")
        far = c.join(d, (F.col("a.t") == F.col("b.t")) & (F.col("a.salt") == F.col("b.salt")) & apart & F.when(later, ~F.col("a.dead")).otherwise(~F.col("b.dead")) & promising("a.", "b.", threshold, True))
        rest, place = cut(rest.union(far.select(pair.alias("pair")).select("pair.*")).distinct(), "line-pairs")
        places.append(place)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    release(spark)
    dead = dead.union(verified(rest, lines, threshold))
    for place in places:
        remove(spark, place)
    return dead


def removals(docs: DataFrame, threshold: float, min_words: int) -> DataFrame:
    """doc_id (null as the smallest long), h (hash of the text), gone: the sorted numbers of the lines to remove, for
    documents that have any."""
    doc_id, text = texts(docs)
    dead = dead_lines(all_lines(docs), threshold, min_words)
    line = F.col("line")
    some = F.trim(line) != "" if min_words <= 1 else (F.length(line) >= 2 * min_words - 1) & (F.size(hashes(line)) >= min_words)
    places = docs.select(doc_id.alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line")).where(some)
    places, _ = cut(places.select("doc_id", "h", "no", *identity(line)), "line-places")
    anew = places.groupBy("x", "y").agg(F.min(F.struct("doc_id", "no")).alias("f"), F.count("*").alias("n")).where("n > 1")
    fate = anew.select("x", "y", F.col("f.doc_id").alias("fd"), F.col("f.no").alias("fno")).join(dead.withColumn("dead", F.lit(True)), ["x", "y"], "full_outer").withColumn("dead", F.coalesce("dead", F.lit(False)))
    later = (F.col("doc_id") > F.col("fd")) | ((F.col("doc_id") == F.col("fd")) & (F.col("no") > F.col("fno")))
    return places.join(fate, ["x", "y"]).where(F.col("dead") | later).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("no")).alias("gone"))


def joined(docs: DataFrame, threshold: float, min_words: int, keep: dict[str, Column]) -> DataFrame:
    """The columns in `keep`, and `gone`; no name of docs' columns is used beside them."""
    gone = removals(docs, threshold, min_words).toDF("d", "h", "gone")
    key = docs.select(*[c.alias(n) for n, c in keep.items()], texts(docs)[0].alias("d"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    return key.join(gone, ["d", "h"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the lines to remove from 0, comma-joined) of every document.

    A line is removed if an earlier line anywhere (by doc_id, then number) has a set of words with Jaccard
    similarity of at least the threshold; equal lines are similar. Lines end at newlines, words at blanks (U+0020,
    tab, vertical tab, form feed, carriage return). Lines of fewer than `min_words` distinct words always stay, so by
    default blank ones. Null and empty texts are one empty line. Repeated rows, and rows that share a doc_id, don't
    remove each other's line of the same number. Null ids come before all others. No rows give no rows; other
    columns are ignored, whatever their names. Lines are told apart by 128-bit hashes, a line's words by 64-bit
    ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = joined(docs, threshold, min_words, {"doc_id": F.col("doc_id").cast("long"), "n_lines": F.size(F.split(text, "\n", -1))})
    return out.select("doc_id", "n_lines", F.size("gone").alias("n_removed"), F.array_join(F.transform("gone", lambda x: x.cast("string")), ",").alias("removed"))


def without_repeats(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with those lines taken out of text, and n_chars set anew if there; no document goes, other columns stay as
    they are."""
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    out = joined(docs, threshold, min_words, {n: F.col(f"`{c}`") for c, n in name.items()})
    old, some = F.col(name["text"]), F.size("gone") > 0
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    out = out.withColumn("lines", F.when(some, F.split(old, "\n", -1)))
    out = out.withColumn("new", F.when(some, F.array_join(F.transform(left, lambda i: F.element_at(F.col("lines"), i + 1)), "\n")).otherwise(old))
    chars = lambda c: F.when(some, F.char_length("new").cast("long")).otherwise(F.col(c))
    made = {"text": F.col("new")} | ({"n_chars": chars(name["n_chars"])} if "n_chars" in name else {})
    return out.select(*[made.get(c, F.col(n)).alias(c) for c, n in name.items()])
