"""Article sources: JSON news APIs, RSS and Atom feeds, pushed batches; schedules of polling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as tx

MOST_ENTRIES = 200  # of one response: the contract of the sources

_ITEM = "struct<url:string,link:string,title:string,headline:string,publishedAt:string,published_at:string,date:string,content:string,body:string,description:string,author:string,id:string,urlToImage:string,image:string>"
_RESPONSE = f"articles array<{_ITEM}>, results array<{_ITEM}>, items array<{_ITEM}>"


def _first(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def parse_json_api(responses: DataFrame, body: str = "body", s: Settings = DEFAULT) -> DataFrame:
    """RAW_ARTICLE columns from rows (source_id, <body>) of JSON responses; what isn't JSON has no articles."""
    parsed = responses.select("source_id", F.from_json(body, _RESPONSE, {"mode": "PERMISSIVE"}).alias("r"))
    items = F.coalesce(*[F.when(F.size(f"r.{k}") > 0, F.col(f"r.{k}")) for k in ("articles", "results", "items")])
    each = parsed.select("source_id", F.explode(F.slice(items, 1, MOST_ENTRIES)).alias("i"))
    i = lambda n: F.col(f"i.{n}")
    out = each.select(
        "source_id", _first(i("url"), i("link")).alias("url"), _first(i("title"), i("headline")).alias("title"),
        F.substring(tx.strip_html(_first(i("content"), i("body"))), 1, s.max_body).alias("body"),
        F.substring(tx.strip_html(i("description")), 1, s.max_summary).alias("summary"), i("author").alias("author"),
        tx.parse_time(_first(i("publishedAt"), i("published_at"), i("date"))).alias("published_at"),
        F.coalesce(i("id"), F.lit("")).alias("external_id"), _first(i("urlToImage"), i("image")).alias("image_url"),
    )
    return out.filter("url is not null and title is not null").withColumn("title", tx.strip_html("title"))


def _entries(source_id: int, xml: str | None):
    """Raw articles of one feed document, RSS or Atom; what isn't XML has none."""
    import xml.etree.ElementTree as ET
    from email.utils import parsedate_to_datetime

    def local(e):
        return e.tag.rsplit("}", 1)[-1]

    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return
    for entry in [e for e in root.iter() if local(e) in ("item", "entry")][:MOST_ENTRIES]:
        found: dict[str, list] = {}
        for e in entry.iter():
            found.setdefault(local(e) if e.tag.rsplit("}", 1)[0] != "{http://search.yahoo.com/mrss/" else f"media:{local(e)}", []).append(e)
        text = lambda *names: next(("".join(e.itertext()) for n in names for e in found.get(n, ()) if "".join(e.itertext()).strip()), None)  # noqa: B023, E731
        link = text("link") or next((e.get("href") for e in found.get("link", ()) if e.get("rel", "alternate") == "alternate" and e.get("href")), None)
        when = None
        for name in ("pubDate", "published", "issued", "date", "updated", "modified"):
            if when is None and (raw := text(name)):
                when = _time(raw.strip(), parsedate_to_datetime)
        whole = " ".join("".join(e.itertext()) for n in ("encoded", "content") for e in found.get(n, ()) if "".join(e.itertext()).strip())
        image = next((e.get("url") for e in found.get("media:content", ()) if e.get("url")), None)
        yield source_id, link, text("title"), whole, text("description", "summary"), text("creator", "author", "name"), when, text("guid", "id"), image


def _time(raw: str, parse_mail):
    from datetime import datetime, timezone

    for read in (lambda x: datetime.fromisoformat(x.replace("Z", "+00:00")), parse_mail):
        try:
            t = read(raw)
            return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t
        except (TypeError, ValueError):
            continue
    return None


def parse_feeds(documents: DataFrame, body: str = "body", s: Settings = DEFAULT) -> DataFrame:
    """RAW_ARTICLE columns from rows (source_id, <body>) of RSS or Atom documents."""
    from ..schema import RAW_ARTICLE

    def run(it):
        import pandas as pd

        for pdf in it:
            rows = [e for sid, xml in zip(pdf["source_id"], pdf["__body"], strict=True) for e in _entries(sid, xml)]
            yield pd.DataFrame(rows, columns=["source_id", "url", "title", "body", "summary", "author", "published_at", "external_id", "image_url"]).astype({"published_at": "datetime64[us]"})

    raw = documents.select("source_id", F.col(body).alias("__body")).mapInPandas(run, RAW_ARTICLE)
    summary = tx.strip_html("summary", exact=True)
    out = raw.withColumn("title", tx.strip_html("title", exact=True)).filter("coalesce(url, '') <> '' and title <> ''")
    own = tx.strip_html("body", exact=True)
    return out.withColumn("body", F.substring(F.when(own != "", own).otherwise(summary), 1, s.max_body)).withColumn("summary", F.substring(summary, 1, s.max_summary))


def pushed(spark: SparkSession, articles: list[dict]) -> DataFrame:
    """A pushed batch of 1 to 500 articles as PUSH_INPUT rows."""
    from ..schema import PUSH_INPUT

    if not 1 <= len(articles) <= 500:
        raise ValueError("a batch has 1 to 500 articles")
    names = [c.split()[0] for c in PUSH_INPUT.split(", ")]
    for a in articles:
        if not all(a.get(k) for k in ("source", "url", "title")):
            raise ValueError("an article needs source, url and title")
        if a.get("reliability") is not None and not 0 <= a["reliability"] <= 1:
            raise ValueError("reliability lies within 0 and 1")
    return spark.createDataFrame([tuple(a.get(n) for n in names) for a in articles], PUSH_INPUT)


def from_push(batch: DataFrame, sources: DataFrame) -> DataFrame:
    """PUSH_INPUT rows to RAW_ARTICLE, the sources (id, name) being known."""
    joined = batch.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source")
    return joined.select("source_id", "url", "title", "body", "summary", "author", tx.parse_time(F.col("published_at")).alias("published_at"), "external_id", "image_url")


def due(sources: DataFrame, as_of: Column, most: int = 200) -> DataFrame:
    """Enabled sources whose time has come and whose breaker is closed, the longest due first."""
    open_ = F.col("breaker_open_until").isNull() | (F.col("breaker_open_until") <= as_of)
    ready = F.col("next_poll_at").isNull() | (F.col("next_poll_at") <= as_of)
    return sources.filter(F.col("enabled") & ready & open_).orderBy(F.col("next_poll_at").asc_nulls_first(), "id").limit(most)


def after_success(interval: Column, items: Column, s: Settings = DEFAULT) -> Column:
    """The next polling interval: longer after nothing new, shorter after something."""
    slower = F.least(F.lit(s.poll_max_s), F.floor(interval * 1.5)).cast("int")
    faster = F.greatest(F.lit(s.poll_s // 3), F.floor(interval * 0.8)).cast("int")
    return F.when(items == 0, slower).otherwise(faster)


def cooldown(failures: Column, s: Settings = DEFAULT) -> Column:
    """Seconds that the breaker stays open after so many failures in a row; null while it stays closed."""
    over = F.least(failures - s.breaker_failures, F.lit(3))
    return F.when(failures >= s.breaker_failures, (s.breaker_cooldown_s * F.pow(F.lit(2), over)).cast("int"))


def record_polls(sources: DataFrame, results: DataFrame, as_of: Column, s: Settings = DEFAULT) -> DataFrame:
    """sources after polls (id, ok, items, etag, last_modified)."""
    r = results.select(F.col("id").alias("__id"), "ok", "items", F.col("etag").alias("__etag"), F.col("last_modified").alias("__modified"))
    j = sources.join(r, sources.id == r["__id"], "left")
    polled, fine = F.col("__id").isNotNull(), F.coalesce("ok", F.lit(False))
    interval = F.when(fine, after_success(F.col("poll_interval_s"), F.col("items"), s)).otherwise(F.col("poll_interval_s"))
    failures = F.when(~polled, F.col("consecutive_failures")).when(fine, 0).otherwise(F.col("consecutive_failures") + 1)
    later = lambda seconds: as_of + F.make_dt_interval(secs=seconds)
    new = {
        "poll_interval_s": F.when(polled, interval).otherwise(F.col("poll_interval_s")),
        "next_poll_at": F.when(polled, later(interval)).otherwise(F.col("next_poll_at")),
        "last_polled_at": F.when(polled, as_of).otherwise(F.col("last_polled_at")),
        "etag": F.when(polled & fine, F.col("__etag")).otherwise(F.col("etag")),
        "last_modified": F.when(polled & fine, F.col("__modified")).otherwise(F.col("last_modified")),
        "breaker_open_until": F.when(polled & fine, F.lit(None)).when(polled & cooldown(failures, s).isNotNull(), later(cooldown(failures, s))).otherwise(F.col("breaker_open_until")),
        "consecutive_failures": failures.cast("int"),
    }
    return j.withColumns(new).select(*sources.columns)
