"""Screening of counterparties against lists: candidate joins on keys, scores, ship numbers, top candidates, changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.entity import conflict, prepared_entity
from ..functions.keys import imo_valid, is_vessel, trigrams
from ..llm.util import cut
from .matchers import osa

STRONG, POSSIBLE, SHOWN = 0.81, 0.80, 5
# Fixed values of the score: what a name contained in another is worth at most, the share of the greatest weight from
# which a word is rare, the least similarity of two glued names, and the letters up to which one must be exact.
CONTAINED, RARE, BLOCK, SHORT_BLOCK = 0.8, 0.45, 0.8, 8
#: A word is found by its letters less one from so many letters on, and by its trigrams from so many.
DELETIONS, GRAMS = (6, 13), 11
#: A pair of words that shares no key gains this at most (`keys`); what is left has to come from words that do.
UNFOUND = 2 / 3
ENTRY = "source string, id string, name string, alias array<string>, weak array<string>, type string, programme string, imo string, other_imo array<string>"
MORE = "designated_on string, designation_field string, parties array<struct<role:string,name:string>>"


def word_similarity(a: str, b: str) -> float:
    return 1.0 if a == b else max(0.0, 1 - (osa(a, b) + (a[:1] != b[:1])) / max(len(a), len(b)))


def typing_error(a: str, b: str) -> bool:
    """Two neighbouring letters exchanged, or one letter left out."""
    if len(a) == len(b):
        at = [k for k in range(len(a)) if a[k] != b[k]]
        return len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def entity_score(a: list[str], b: list[str], u: list[float], v: list[float], doubt: bool = False) -> float:
    """Weighted best counterparts of both names' words; u and v weigh them.

    Different numbers never match. Names with a word left over on both sides lose a tenth; a rare word left over, a
    short word that is neither equal nor mistyped, a number on one side only, or another reason to doubt, cap the
    score at what a contained name is worth. A block of words glued together counts if the numbers of words differ
    and no word is left over by itself; so does a whole name of two words that the other holds."""
    if not a or not b:
        return 0.0
    digits = [{w for w in x if w.isdigit()} for x in (a, b)]
    if digits[0] and digits[1] and digits[0] != digits[1]:
        return 0.0
    gain = lambda s: max(0.0, (s - 0.5) * 2)
    part, total, left, capped, contained = [], [], [], doubt or bool(digits[0]) != bool(digits[1]), [0.0]
    doubtful = False
    for x, y, weight in ((a, b, u), (b, a, v)):
        best = [max((word_similarity(w, o), o) for o in y) for w in x]
        top = max(weight)
        part.append(sum(k * gain(s) for k, (s, _) in zip(weight, best, strict=True)))
        total.append(sum(weight))
        left.append([w for w, (s, _) in zip(x, best, strict=True) if s < 0.8])
        for w, k, (s, o) in zip(x, weight, best, strict=True):
            doubtful |= s < 0.8 and k >= RARE * top or 0.5 < s < 0.9 and max(len(w), len(o)) <= 8 and not typing_error(w, o)
        if len(x) >= 2 and any(s >= 0.9 and k >= 0.5 * top for k, (s, _) in zip(weight, best, strict=True)):
            contained.append(part[-1] / total[-1])
    score = sum(part) / sum(total) * (0.9 if left[0] and left[1] else 1.0)
    score = min(score, CONTAINED) if doubtful else score
    if len(a) != len(b):
        glued, rest = ("".join(a), "".join(b)), ("".join(left[0]), "".join(left[1]))
        gap = abs(len(glued[0]) - len(glued[1]))
        more = gap > 0 and any(len(w) == gap for w in left[len(glued[0]) < len(glued[1])])
        if gap <= 2 and not more and (not rest[0] or not rest[1] or word_similarity(*rest) >= BLOCK):
            block = word_similarity(*glued)
            if block >= BLOCK:
                score = max(score, min(block, CONTAINED) if block < 1 and max(map(len, glued)) <= SHORT_BLOCK else block)
    score = max(score, CONTAINED * max(contained))
    return min(score, CONTAINED) if capped else score


def names(entries: DataFrame) -> DataFrame:
    """One row per listed string: eid, listed, is_alias, is_weak."""
    base = entries.withColumn("eid", F.concat_ws(":", "source", "id"))
    none = F.array().cast("array<string>")
    weak = F.coalesce("weak", none)
    one = lambda a, alias, weak: F.transform(a, lambda x: F.struct(x.alias("listed"), F.lit(alias).alias("is_alias"), F.lit(weak).alias("is_weak")))
    all_ = F.concat(one(F.array("name"), False, False), one(F.array_except(F.coalesce("alias", none), weak), True, False), one(weak, True, True))
    return base.select("eid", F.explode(all_).alias("s")).select("eid", "s.*").where("trim(coalesce(listed, '')) <> ''").distinct()


def texts(rows: DataFrame, name: str) -> DataFrame:
    """Each distinct spelling once: `name`, text (its prepared words) and marks."""
    text, marks = prepared_entity(name)
    return rows.select(name).distinct().select(name, text.alias("text"), marks.alias("marks"))


def weighed(spelled: DataFrame, frequency: DataFrame, total: int) -> DataFrame:
    """text, words, weights (in the order of words) and prefix: the heaviest words, as many as hold more of the weight
    than words that share no key can gain a possible match without. Each distinct text once."""
    word = spelled.select("text").distinct().select("text", F.posexplode(F.split("text", " ")).alias("at", "w")).join(frequency, "w", "left")
    weight = (1 + F.log((F.lit(total) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0))).alias("k")
    by = word.select("text", "at", "w", weight).groupBy("text").agg(F.array_sort(F.collect_list(F.struct("at", "w", "k"))).alias("x"), F.sum("k").alias("sum"))
    # with a loss of at most a fifth of one side's weight, words without a key hold at most 0.2 / (1 - UNFOUND) of it
    least = F.col("sum") * F.lit(0.2 / (1 - UNFOUND) + 1e-9)
    heavy = F.reverse(F.array_sort(F.transform("x", lambda x: F.struct(x["k"], x["w"]))))
    taken = F.aggregate(heavy, F.struct(F.lit(0.0).alias("k"), F.array().cast("array<string>").alias("w")), lambda a, x: F.when(a["k"] > least, a).otherwise(F.struct((a["k"] + x["k"]).alias("k"), F.array_append(a["w"], x["w"]).alias("w"))))
    return by.select("text", F.col("x.w").alias("words"), F.col("x.k").alias("weights"), taken["w"].alias("prefix"))


def like_words(x: DataFrame, y: DataFrame) -> DataFrame:
    """(wa, wb): words of x and y, one a row in w, that are equal or found by a key: from six letters on each of their
    letters left out, from eleven as many trigrams as so few edits leave (one takes four at most). Words that this
    doesn't pair are so unlike that their similarity gains UNFOUND at most: shorter ones differ in a fifth of their
    letters, longer ones in two of twelve or more."""
    n, w = F.char_length("w"), F.col("w")
    least, most = DELETIONS
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))
    shorter = lambda df, as_: df.where(n.between(least - 1, most)).select(w.alias(as_), F.explode(F.concat(F.array(w), F.when(n >= least, less).otherwise(F.array().cast("array<string>")))).alias("key"))
    grams = lambda df, as_: df.where(n >= GRAMS).select(w.alias(as_), n.alias(f"n{as_}"), F.array_distinct(trigrams(w)).alias("g")).select("*", F.size("g").alias(f"g{as_}"), F.explode("g").alias("key")).drop("g")
    length = F.greatest("nwa", "nwb")
    edits = F.floor(length * F.lit((1 - UNFOUND) / 2) + F.lit(1e-9))
    long = grams(x, "wa").join(grams(y, "wb"), "key").where(F.abs(F.col("nwa") - F.col("nwb")) <= edits).groupBy("wa", "wb")
    long = long.agg(F.count("*").alias("n"), F.first(F.greatest("gwa", "gwb") - 4 * edits).alias("least")).where("n >= least")
    equal = x.join(y, "w").select(w.alias("wa"), w.alias("wb"))
    return equal.union(shorter(x, "wa").join(shorter(y, "wb"), "key").select("wa", "wb")).union(long.select("wa", "wb")).distinct()


def gain_at_most(w: Column, o: Column) -> Column:
    """What two words gain at most: an edit of `osa` takes two of Levenshtein's at most."""
    apart = F.ceil(F.levenshtein(w, o) / 2) + F.when(F.substring(w, 1, 1) == F.substring(o, 1, 1), 0).otherwise(1)
    return F.greatest(F.lit(0.0), F.lit(1.0) - apart * 2 / F.greatest(F.char_length(w), F.char_length(o)))


def loss_at_least(words: Column, weights: Column, others: Column, most: Column) -> Column:
    """What the words of a name lose of their weight at least beside the other's; counted no further once above `most`."""
    gain = lambda w: F.when(F.array_contains(others, w), 1.0).otherwise(F.array_max(F.transform(others, lambda o: gain_at_most(w, o))))
    more = lambda lost, x: F.when(lost > most, lost).otherwise(lost + x["k"] * (1 - gain(x["w"])))
    return F.aggregate(F.arrays_zip(words.alias("w"), weights.alias("k")), F.lit(0.0), more)


def may_match(possible: float = POSSIBLE) -> Column:
    """False only for pairs (words and weights xa, ka and xb, kb) that stay below the possible level but as glued names:
    the words lose too much, and neither name holds the other."""
    xa, ka, xb, kb = (F.col(c) for c in ("xa", "ka", "xb", "kb"))
    most = (F.col("suma") + F.col("sumb")) * F.lit(1 - possible + 1e-6)
    within = lambda x, y: (F.size(x) >= 2) & (F.size(F.array_except(x, y)) == 0)
    first = loss_at_least(xa, ka, xb, most)
    return within(xa, xb) | within(xb, xa) | ((first <= most) & (first + loss_at_least(xb, kb, xa, most) <= most))


def glued(mine: DataFrame, listed: DataFrame) -> DataFrame:
    """(a, b): texts of different numbers of words whose letters are alike as one block. Their lengths differ by two at
    most, and of a block's trigrams, as many as its letters, an edit takes four and moves the others by one: a fifth of
    the letters in edits leaves one. The pair is decided where they meet, on its letters."""
    glue = lambda x: F.replace(F.col(x), F.lit(" "), F.lit(""))
    block = lambda df, x: df.select(F.col("text").alias(x), F.size("words").alias(f"n{x}"), F.char_length(glue("text")).alias(f"l{x}"), F.posexplode(trigrams(glue("text"))).alias(f"p{x}", "key"))
    near = block(mine, "a").withColumn("lb", F.explode(F.sequence(F.col("la") - 2, F.col("la") + 2)))
    edits = F.floor(F.greatest("la", "lb") * F.lit(1 - BLOCK) + F.lit(1e-9)).cast("int")
    alike = (F.col("na") != F.col("nb")) & (F.abs(F.col("pa") - F.col("pb")) <= edits) & (F.levenshtein(glue("a"), glue("b")) <= 2 * edits)
    return near.join(block(listed, "b"), ["key", "lb"]).where(alike).select("a", "b")


def candidates(mine: DataFrame, listed: DataFrame) -> DataFrame:
    """(a, b): pairs of texts that may reach the possible level, by equi-joins.

    A score of 0.8 needs a heavy word of one name that is like any word of the other: common words count in names
    that hold hardly anything else. Glued names are found by their trigrams. Most pairs that meet share a common word
    or trigram and nothing else: what can't reach the level goes where they meet, before anything is shuffled."""
    own = lambda df, text: df.select(F.col("text").alias(text), F.col("words").alias(f"x{text}"), F.col("weights").alias(f"k{text}"), F.aggregate("weights", F.lit(0.0), lambda s, k: s + k).alias(f"sum{text}"), "prefix")
    side = lambda df, which, text, word: own(df, text).withColumn(word, F.explode(F.array_distinct(which or f"x{text}"))).drop("prefix")
    vocabulary = lambda df: df.select(F.explode("words").alias("w")).distinct()
    like, _ = cut(like_words(vocabulary(mine), vocabulary(listed)), "screen-like")
    heavy = side(mine, "prefix", "a", "wa").join(like, "wa").join(side(listed, None, "b", "wb"), "wb").where(may_match()).select("a", "b")
    light = side(mine, None, "a", "wa").join(like, "wa").join(side(listed, "prefix", "b", "wb"), "wb").where(may_match()).select("a", "b")
    return heavy.union(light).union(glued(mine, listed)).distinct()


def screen(parties: DataFrame, entries: DataFrame, strong: float = STRONG, possible: float = POSSIBLE, exhaustive: bool = False) -> DataFrame:
    """One row per counterparty: line, name, ref, imo, status, candidates (at most five, best first), others, set_aside.

    parties: line, name, ref, imo, type. A ship number equal to an entry's makes it a candidate with score 1, and
    `renamed` lists the entry's names if none is like the one sent; an entry found by name whose number differs is set
    aside. A weak alias reaches `possible` at most."""
    for field in MORE.split(", "):
        column, kind = field.split(" ", 1)
        entries = entries if column in entries.columns else entries.withColumn(column, F.lit(None).cast(kind))
    listed, _ = cut(names(entries), "screen-listed")
    mine = parties.where("trim(coalesce(name, '')) <> ''")
    total = entries.count()
    # what several joins read is written once: the plan of all of them at once takes the driver hundreds of MB
    (spelled, _), (sent, _) = cut(texts(listed, "listed"), "screen-spelled"), cut(texts(mine, "name"), "screen-sent")
    by_entry = listed.join(spelled, "listed").select("eid", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    frequency, _ = cut(by_entry.groupBy("w").agg(F.countDistinct("eid").alias("df")), "screen-frequency")
    (a, _), (b, _) = cut(weighed(sent, frequency, total), "screen-weighed"), cut(weighed(spelled, frequency, total), "screen-weighed")
    found = a.select(F.col("text").alias("a")).crossJoin(b.select(F.col("text").alias("b"))) if exhaustive else cut(candidates(a, b), "screen-pairs")[0]
    mark = lambda df, x: df.select(F.col("text").alias(x), F.col("marks").alias(f"m{x}")).distinct()
    pairs = found.join(mark(sent, "a"), "a").join(mark(spelled, "b"), "b").select("a", "b", "ma", "mb", conflict(F.col("ma"), F.col("mb")).alias("doubt"))
    full = lambda df, x: df.select(F.col("text").alias(x), F.col("words").alias(f"w{x}"), F.col("weights").alias(f"k{x}"))
    both = pairs.select("a", "b", "doubt").distinct().join(full(a, "a"), "a").join(full(b, "b"), "b")

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series, u: pd.Series, v: pd.Series, doubt: pd.Series) -> pd.Series:
        return pd.Series([entity_score(list(x), list(y), list(u), list(v), d) for x, y, u, v, d in zip(x, y, u, v, doubt, strict=True)])

    alike = both.select("a", "b", "doubt", score("wa", "wb", "ka", "kb", "doubt").alias("raw")).where(F.col("raw") >= possible - 1e-9)
    alike, _ = cut(alike, "screen-alike")
    alike = pairs.join(alike, ["a", "b", "doubt"]).join(sent.toDF("name", "a", "ma"), ["a", "ma"]).join(spelled.toDF("listed", "b", "mb"), ["b", "mb"]).select("name", "listed", "raw")
    by_name = mine.select("line", "name").join(alike, "name").join(listed, "listed")
    rounded = F.floor(F.col("raw") * 1000 + 0.5) / 1000
    by_name = by_name.select("line", "eid", F.when(F.col("is_weak"), F.least(rounded, F.lit(possible))).otherwise(rounded).alias("score"), F.lit("name").alias("by"), F.when(F.col("is_alias"), F.col("listed")).alias("alias"), "is_weak")
    none = F.array().cast("array<string>")
    stated = ["designated_on", "designation_field", "parties"]
    info = entries.select(F.concat_ws(":", "source", "id").alias("eid"), "source", "id", F.col("name").alias("listed_name"), "programme", F.col("imo").alias("listed_imo"), "other_imo", *stated, F.concat(F.array("name"), F.coalesce("alias", none)).alias("all_names"))
    number = info.select("eid", F.explode(F.array_compact(F.concat(F.array("listed_imo"), F.coalesce("other_imo", none)))).alias("imo"))
    by_imo = mine.where("imo is not null").select("line", "imo").join(number, "imo").select("line", "eid", F.lit(1.0).alias("score"), F.lit("imo").alias("by"), F.lit(None).cast("string").alias("alias"), F.lit(False).alias("is_weak"))
    order = [F.desc("score"), F.when(F.col("by") == "imo", 0).otherwise(1), F.col("alias").isNotNull(), F.col("is_weak"), F.col("alias")]
    each = Window.partitionBy("line", "eid")
    best = by_name.unionByName(by_imo).select("*", F.row_number().over(each.orderBy(*order)).alias("r"), F.bool_or(F.col("by") == "name").over(each).alias("alike")).where("r = 1").drop("r")
    rows = best.join(info, "eid").join(mine.select("line", "imo"), "line")
    rows = rows.withColumn("renamed", F.when((F.col("by") == "imo") & ~F.col("alike"), F.col("all_names")))
    differs = (F.col("by") == "name") & F.coalesce((F.col("listed_imo") != F.col("imo")) & ~F.coalesce(F.array_contains("other_imo", F.col("imo")), F.lit(False)), F.lit(False))
    aside = rows.where(differs).groupBy("line").agg(F.array_sort(F.collect_set(F.struct("listed_name", "listed_imo"))).alias("set_aside"))
    group = ["line", "source", F.coalesce("programme", F.lit("")).alias("list"), F.lower("listed_name").alias("low"), F.coalesce("listed_imo", F.lit("")).alias("number")]
    w = Window.partitionBy("line").orderBy(F.desc("score"), "listed_name", "source", F.col("ids")[0])
    shown = ["listed_name", "listed_imo", "score", "by", "alias", "is_weak", *stated, "renamed"]
    first = F.struct(-F.col("score"), F.col("by") != "imo", F.col("alias").isNotNull(), "is_weak", F.coalesce("alias", F.lit("")), "id")
    top = (
        rows.where(~differs)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min_by(F.struct(*shown), first).alias("b"))
        .select("line", "source", "list", "ids", "b.*")
        .withColumn("place", F.row_number().over(w))
        .groupBy("line")
        .agg(F.count("*").alias("n"), F.max("score").alias("top"), F.array_sort(F.collect_list(F.when(F.col("place") <= SHOWN, F.struct("place", "source", "list", "ids", *shown)))).alias("candidates"))
    )
    status = F.when(F.col("n").isNull(), "no-match").when(F.col("top") >= strong, "strong").otherwise("possible")
    return mine.join(top, "line", "left").join(aside, "line", "left").select(
        "line", "name", "ref", "imo", status.alias("status"), "candidates", F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - SHOWN).alias("others"), "set_aside",
        (~imo_valid(F.col("imo"))).alias("imo_invalid"), (F.col("imo").isNull() & is_vessel(F.col("name"), F.col("type"))).alias("vessel_without_imo"),
    )


def party_key(df: DataFrame) -> DataFrame:
    """A counterparty's name between runs: its reference, else its name."""
    return df.withColumn("key", F.when(F.length("ref") > 0, F.concat(F.lit("ref:"), "ref")).otherwise(F.concat(F.lit("name:"), F.lower(F.trim("name")))))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """change, key, candidate between two screenings: candidates new and gone of parties in both, parties added and
    removed. Anti-joins both ways."""
    b, a = party_key(before), party_key(after)
    rows = lambda df: df.select("key", F.explode_outer("candidates").alias("c")).where("c is not null").select("key", F.concat_ws("|", "c.source", F.concat_ws(",", F.array_sort("c.ids"))).alias("candidate")).distinct()
    none = F.lit(None).cast("string").alias("candidate")
    say = lambda df, what, *cols: df.select(F.lit(what).alias("change"), "key", *cols)
    only = lambda x, y: x.select("key").distinct().join(y.select("key").distinct(), "key", "left_anti")
    common = a.select("key").distinct().join(b.select("key").distinct(), "key", "left_semi")
    new = rows(a).join(rows(b), ["key", "candidate"], "left_anti").join(common, "key", "left_semi")
    gone = rows(b).join(rows(a), ["key", "candidate"], "left_anti").join(common, "key", "left_semi")
    return say(new, "new candidate", "candidate").union(say(gone, "candidate gone", "candidate")).union(say(only(a, b), "party added", none)).union(say(only(b, a), "party removed", none))
