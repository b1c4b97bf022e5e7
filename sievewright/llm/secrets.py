"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds, in the order in which kinds are listed: kind, pattern, the group whose length
# decides, and that length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
# Parts that are weak by themselves: a token of letters and digits in both cases, in either alphabet of base64 ('=' may
# stand before it and pads it; '/' may stand beside the URL-safe one), and an address of a service.
MIXED = r"(?=[%(a)s]{20})(?=[%(u)s]*[0-9])(?=[%(l)s]*[A-Z])(?=[%(c)s]*[a-z])[%(a)s]{20,}={0,2}"
PLAIN, SAFE = (MIXED % {"a": "A-Za-z0-9" + x, "u": "A-Za-z" + x, "l": "a-z0-9" + x, "c": "A-Z0-9" + x} for x in ("+/", "_-"))
WEAK = (
    ("key", rf"(?<![A-Za-z0-9+/_-]){PLAIN}(?![A-Za-z0-9+/=_-])|(?<![A-Za-z0-9+_-]){SAFE}(?![A-Za-z0-9+=_-])", 0, 20),
    # a scheme of at most 32 characters, begun where a run of letters begins: no place is looked at more often than that
    ("endpoint", r"""(?<![a-z])[a-z][a-z0-9+.-]{0,31}://[^\x20\x09-\x0D"'<>]+""", 0, 8),
)
KINDS = [k for k, *_ in (*BASE, *WEAK)]
#: Code points between the parts of one credential at most.
SCOPE = 200
#: Elements of an array that one pass walks; longer arrays are walked block by block.
BLOCK = 256
SPAN = "array<struct<s:int,k:int,e:int>>"


def scan(rows: Column, row: str, zero: Column, value, combine) -> Column:
    """array<struct<before:int,row>>: each element with what `combine` makes of the values before it. An array that
    grows by one costs its length each time, so blocks are walked apart and joined by what they add up to."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / F.lit(BLOCK)).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))
    local = F.transform(
        blocks,
        lambda block: F.aggregate(
            block,
            F.struct(zero.alias("t"), F.array().cast(f"array<struct<before:int,row:{row}>>").alias("o")),
            lambda a, x: F.struct(combine(a["t"], value(x)).alias("t"), F.concat(a["o"], F.array(F.struct(a["t"].alias("before"), x.alias("row")))).alias("o")),
        ),
    )
    carried = F.aggregate(
        local,
        F.struct(zero.alias("t"), F.array().cast(f"array<struct<t:int,o:array<struct<before:int,row:{row}>>>>").alias("o")),
        lambda a, x: F.struct(combine(a["t"], x["t"]).alias("t"), F.concat(a["o"], F.array(F.struct(a["t"].alias("t"), x["o"].alias("o")))).alias("o")),
    )["o"]
    return F.flatten(F.transform(carried, lambda c: F.transform(c["o"], lambda x: F.struct(combine(c["t"], x["before"]).alias("before"), x["row"].alias("row")))))


def found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans (start, kind, end) of a pattern's matches from left to right: what split() leaves between matches and
    what regexp_extract_all() gives add up to the places, in code points."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    decisive = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(
        F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("b"), matches.alias("m"), decisive.alias("d")),
        lambda x: F.struct(F.char_length(x["b"]).alias("b"), F.char_length(x["m"]).alias("m"), F.char_length(x["d"]).alias("d")),
    )
    placed = scan(rows, "struct<b:int,m:int,d:int>", F.lit(0), lambda x: x["b"] + x["m"], lambda a, b: a + b)
    good = F.filter(placed, lambda x: x["row"]["d"] >= least)
    out = F.transform(good, lambda x: F.struct((x["before"] + x["row"]["b"]).alias("s"), F.lit(kind).alias("k"), (x["before"] + x["row"]["b"] + x["row"]["m"]).alias("e")))
    return F.when(F.rlike(text, F.lit(pattern)), out).otherwise(F.array().cast(SPAN))


def near(weak: Column, strong: Column, scope: int) -> Column:
    """The weak spans that a strong one stands beside: an interval join of the two sorted lists. From the left the
    farthest end so far, from the right the nearest start tell each weak span how far its complement is."""
    row = "struct<s:int,w:boolean,e:int,k:int>"
    side = lambda a, w: F.transform(a, lambda x: F.struct(x["s"].alias("s"), F.lit(w).alias("w"), x["e"].alias("e"), x["k"].alias("k")))
    both = F.array_sort(F.concat(side(weak, True), side(strong, False)))
    far = 1 << 30
    left = scan(both, row, F.lit(-far), lambda x: F.when(x["w"], F.lit(-far)).otherwise(x["e"]), lambda a, b: F.greatest(a, b))
    right = scan(F.reverse(both), row, F.lit(far), lambda x: F.when(x["w"], F.lit(far)).otherwise(x["s"]), lambda a, b: F.least(a, b))
    hit = F.concat(
        F.filter(left, lambda x: x["row"]["w"] & (x["row"]["s"] - x["before"] <= scope)),
        F.filter(right, lambda x: x["row"]["w"] & (x["before"] - x["row"]["e"] <= scope)),
    )
    out = F.array_distinct(F.transform(hit, lambda x: F.struct(x["row"]["s"].alias("s"), x["row"]["k"].alias("k"), x["row"]["e"].alias("e"))))
    return F.when((F.size(weak) > 0) & (F.size(strong) > 0), out).otherwise(F.array().cast(SPAN))


def spans(docs: DataFrame, text: Column, scope: int = SCOPE) -> DataFrame:
    """docs with __base and __linked: arrays of spans (s, k, e; k numbers KINDS), each by start, then kind.

    A key is reported if an access identifier or an endpoint stands within its scope, an endpoint if an access
    identifier, an assignment or a key does: a part alone is no finding."""
    # runs below the least length fail anyway, so these patterns needn't match them
    narrow = {"hex": r"[0-9a-f]{32,}", "access": r"AKIA[A-Z0-9]{12,}"}
    parts = {k: found(text, n, narrow.get(k, p), g, least) for n, (k, p, g, least) in enumerate((*BASE, *WEAK))}
    s, a, h, k, e = (F.col(f"__{x}") for x in KINDS)
    return docs.withColumns({f"__{name}": v for name, v in parts.items()}).withColumns(
        {"__base": F.array_sort(F.concat(s, a, h)), "__linked": F.array_distinct(F.concat(near(k, F.concat(a, e), scope), near(e, F.concat(s, a, k), scope)))}
    )


def named(array: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda x: F.concat(F.element_at(kinds, x["k"] + 1), F.lit(":"), x["s"], F.lit(":"), x["e"])), ",")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; native functions only.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. A null text counts as empty; both
    have no spans and the digest of an empty list. Texts of any length are scanned whole, in their own row: no
    shuffle, no key. Repeated rows give repeated rows; no rows give no rows; a null doc_id stays null; other
    columns are ignored, whatever their names."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    of = lambda k: F.size(F.col(f"__{k}")).cast("long").alias(f"n_{k}")
    return spans(base, F.col("__text"), scope).select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(named(F.col("__base")), 256).alias("base_sha256"), named(F.array_sort(F.concat("__base", "__linked"))).alias("spans")
    )


def redact(docs: DataFrame, scope: int = SCOPE, sign: str = "[SECRET]") -> DataFrame:
    """docs with every span of `text` replaced by a sign, overlapping spans by one, and n_chars set anew if there.
    Texts without spans stay as they are, null ones too; so do all other columns, whatever their names, and rows
    without a doc_id or that repeat another."""
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    old = F.col(name["text"])
    text = F.coalesce(old.cast("string"), F.lit(""))
    sorted_ = F.array_sort(F.concat("__base", "__linked"))
    marked = scan(F.col("all"), "struct<s:int,k:int,e:int>", F.lit(0), lambda x: x["e"], lambda a, b: F.greatest(a, b))
    # what stands between the farthest end so far and the next start stays; a span that starts before that end adds no sign
    kept = F.transform(
        marked,
        lambda x: F.when(x["row"]["s"] >= x["before"], F.concat(F.substring(text, x["before"] + 1, x["row"]["s"] - x["before"]), F.lit(sign))).otherwise(F.lit("")),
    )
    some = F.size("all") > 0
    rest = F.substring(text, F.array_max(F.transform("all", lambda x: x["e"])) + 1, F.char_length(text))
    out = spans(docs.toDF(*name.values()), text, scope).withColumn("all", sorted_).withColumn("new", F.when(some, F.concat(F.array_join(kept, ""), rest)).otherwise(old))
    made = {"text": F.col("new")}
    if "n_chars" in name:
        made["n_chars"] = F.when(some, F.char_length("new").cast("long")).otherwise(F.col(name["n_chars"]))
    return out.select(*[made.get(c, F.col(n)).alias(c) for c, n in name.items()])
