"""Whether the European Union's list is current: its own dates, what its feed announces, and the clock."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Days after which nothing has confirmed that the file is the latest, and by which clocks may differ.
STALE_AFTER, TOLERANCE = 7, 1
#: A day, or a time of which the day counts.
DAY = r"^(\d{4}-\d{2}-\d{2})(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
#: Odd dates that a reason quotes.
QUOTED = 3


@dataclass(frozen=True)
class Recorded:
    """What is known of a file when it is downloaded: the day it was made, the newest day that an entry of it was
    published, why these can't be trusted; the newest day its feed announced it, or why the feed can't be read; and the
    last day on which a download found no newer file announced."""

    generated: str | None
    published: str | None = None
    fault: str | None = None
    announced: str | None = None
    unreadable: str | None = None
    confirmed: str | None = None


def day(text: str | None) -> date | None:
    """A day of the calendar written YYYY-MM-DD, or null."""
    try:
        return date.fromisoformat(text) if text and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else None
    except ValueError:
        return None


def file_dates(spark: SparkSession, path: str) -> Recorded:
    """The dates that a file of the list holds, read as text: the root's and every entry's."""
    lines = spark.read.text(path)
    said = lambda name: F.regexp_extract_all("value", F.lit(rf'\b{name}="([^"]*)"'), F.lit(1))
    root = lines.where(F.contains("value", F.lit("generationDate="))).select(F.get(said("generationDate"), F.lit(0)).alias("d")).first()
    found = re.match(DAY, root.d or "") if root else None
    generated = found[1] if found and day(found[1]) else None
    each = lines.select(F.explode(said("publicationDate")).alias("d")).groupBy("d").agg(F.count("*").alias("n")).select("d", F.regexp_extract("d", DAY, 1).alias("s"))
    valid = F.expr("try_to_date(s, 'yyyy-MM-dd')").isNotNull() & (F.col("s") != "")
    published = each.where(valid).agg(F.max("s").alias("s")).first().s
    odd = [r.d for r in each.where(~F.coalesce(valid, F.lit(False))).orderBy("d").limit(QUOTED).collect()]
    fault = None
    if generated is None:
        fault = "the file has no day on which it was made" if not root else f"the file was made on {root.d!r}, which is no day"
    elif odd:
        fault = f"entries were published on {', '.join(repr(d[:40]) for d in odd)}, which are no days"
    elif published and day(published) > day(generated) + timedelta(days=TOLERANCE):
        fault = f"an entry was published on {published}, after the file was made on {generated}"
    return Recorded(generated, published, fault)


def announced(feed: str, file: str) -> tuple[str | None, str | None]:
    """The newest day on which the feed announces the file whose link holds `file`, or why that can't be read."""
    try:
        items = ElementTree.fromstring(feed).iter("item")
        times = [datetime.strptime(re.sub(r"\s(?:GMT|UTC?|\+0000)$", "", (i.findtext("pubDate") or "").strip()), "%a, %d %b %Y %H:%M:%S") for i in items if file in (i.findtext("link") or "")]
    except (ElementTree.ParseError, ValueError) as e:
        return None, f"the feed can't be read: {e}"
    return (max(times).date().isoformat(), None) if times else (None, "the feed doesn't announce the file")


def recorded(file: Recorded, feed: str, name: str, today: date, before: Recorded | None = None) -> Recorded:
    """A download's record: it confirms the file if the feed can be read and announces no newer one, else the day of
    the record before it stays."""
    on, why = announced(feed, name)
    made = day(file.generated)
    newer = on is not None and made is not None and day(on) > made + timedelta(days=TOLERANCE)
    confirmed = today.isoformat() if on is not None and made is not None and not newer else (before.confirmed if before else None)
    return Recorded(file.generated, file.published, file.fault, on, why, confirmed)


def stale(of: Recorded, today: date) -> str | None:
    """Why the list can't be screened against, or null if it can."""
    slack = timedelta(days=TOLERANCE)
    made = day(of.generated)
    if of.fault:
        return of.fault
    if made is None:
        return "the day on which the file was made is not known"
    late = {"the file was made": of.generated, "the feed announced it": of.announced, "a download confirmed it": of.confirmed}
    for what, said in late.items():
        if said is not None and (day(said) is None or day(said) > today + slack):
            return f"{what} on {said}, which is no day up to now"
    if of.announced and day(of.announced) > made + slack:
        return f"the feed announced a file on {of.announced}, and the one here was made on {of.generated}"
    last = max(made, day(of.confirmed) or made)
    if today - last > timedelta(days=STALE_AFTER):
        return f"nothing has shown since {last} that the file is the latest"
    return None
