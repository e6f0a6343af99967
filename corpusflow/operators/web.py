"""Web results: canonical URLs, deduplication, page text, cached rows."""

from __future__ import annotations

import ipaddress
import re
import socket
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import quote_plus, unquote_plus, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as X

# Parameters that only track clicks, and default ports.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")
PORTS = {"http": 80, "https": 443}


# The parts of an http(s) URL: scheme, host, port, path and query; credentials and
# fragment are passed over. Both engines read it alike.
_PARTS = r"(?is)^(https?)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#\[\]@]*)(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
_TRACKED = r"(?is)^(?:utm_.*|" + "|".join(TRACKING) + ")$"


def canonical(url: str | None) -> str | None:
    """The URL without credentials, default port, fragment and tracking, with
    sorted parameters; null for what isn't an http(s) URL with a host."""
    found = re.match(_PARTS, re.sub("[\t\r\n]", "", (url or "").strip()))
    scheme, host, port, path, query = (x or "" for x in found.groups()) if found else ("",) * 5
    scheme, host, number = scheme.lower(), host.lower().strip("[]"), int(port or 0)
    if not host or number > 65_535:
        return None
    named = (p.partition("=") for p in query.split("&") if p)
    pairs = sorted((k, v) for k, v in ((unquote_plus(a), unquote_plus(b)) for a, _, b in named) if not re.match(_TRACKED, k))
    own = "" if number in (0, PORTS[scheme]) else f":{number}"
    asked = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in pairs)
    return f"{scheme}://{host}{own}{re.sub('/+', '/', path or '/')}" + (f"?{asked}" if asked else "")


def canonical_url(url: Column) -> Column:
    """canonical() of a column, by the JVM."""
    clean = F.regexp_replace(X.stripped(F.coalesce(url, F.lit(""))), "[\\t\\r\\n]", "")
    part = lambda i: F.regexp_extract(clean, _PARTS, i)
    scheme, host, port = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), r"^\[|\]$", ""), F.regexp_replace(part(3), "^0+", "")
    usual = F.when(scheme == "https", str(PORTS["https"])).otherwise(str(PORTS["http"]))
    # What isn't an escape is a percent sign.
    plain = lambda c: F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))
    quoted = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    given = F.filter(F.split(part(5), "&"), lambda p: p != "")
    pairs = F.transform(given, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), F.when(F.instr(p, F.lit("=")) > 0, plain(F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p)))).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p.k.rlike(_TRACKED)))
    asked = F.array_join(F.transform(kept, lambda p: F.concat(quoted(p.k), F.lit("="), quoted(p.v))), "&")
    path = F.when(part(4) == "", "/").otherwise(F.regexp_replace(part(4), "/+", "/"))
    whole = F.concat(scheme, F.lit("://"), host, F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port)), path, F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)))
    return F.when((host != "") & (F.coalesce(F.nullif(port, F.lit("")).try_cast("int"), F.when(port == "", 0).otherwise(99_999)) <= 65_535), whole)


def dedup_top(results: DataFrame, k: int, query: str = "query_id", position: str = "position") -> DataFrame:
    """The first of each canonical URL per query, the k best by position. The
    score is the number of all rows of the query, repeats and unusable ones
    too, less the row's place among them (from 0)."""
    placed = results.withColumns({"_place": F.row_number().over(Window.partitionBy(query).orderBy(position)) - 1, "_rows": F.count("*").over(Window.partitionBy(query))})
    named = placed.withColumn("canonical", canonical_url(F.col("url"))).where("canonical IS NOT NULL")
    first = named.groupBy(query, "canonical").agg(F.min(F.struct(position, "_place", "_rows")).alias("f"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(f"f.{position}"))
    ranked = first.select(query, "canonical", F.col(f"f.{position}").alias(position), rank.alias("rank"), (F.col("f._rows") - F.col("f._place")).cast("double").alias("score"), (F.col("f._place") + 1).cast("double").alias("provider_rank"))
    return ranked.where(F.col("rank") <= k)


def public_urls(resolve: Callable[[str], list[str]]):
    """A pandas UDF: the canonical URL if it may be fetched, else null. It needs
    http(s), a host, no user info, and only global addresses from `resolve`,
    which is given host names; a name it can't resolve isn't public."""

    def one(url: str | None) -> str | None:
        try:
            raw = urlsplit((url or "").strip())
            if raw.username or raw.password:
                return None
        except ValueError:
            return None
        found = canonical(url)
        if found is None:
            return None
        try:
            addresses = resolve(urlsplit(found).hostname or "")
            return found if addresses and all(ipaddress.ip_address(a).is_global for a in addresses) else None
        except (OSError, ValueError):
            return None

    @F.pandas_udf(StringType())
    def checked(urls: pd.Series) -> pd.Series:
        return urls.map(one)

    return checked


def system_addresses(host: str) -> list[str]:
    """What this machine's resolver says."""
    return sorted({str(row[4][0]) for row in socket.getaddrinfo(host, None, type=socket.SOCK_STREAM)})


def shown_pages(results: DataFrame) -> DataFrame:
    """results with text cleaned for display: titles to 500, descriptions to 1,000 characters."""
    return results.withColumns({"title": X.sanitized(F.coalesce("title", F.lit("")), limit=500), "description": X.sanitized(F.coalesce("description", F.lit("")), limit=1000)})


class _Text(HTMLParser):
    HIDDEN = ("script", "style", "noscript", "nav", "header", "footer", "aside")
    BLOCKS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "tr", "section", "article")

    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in self.HIDDEN and self.depth > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def page_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def main_text(html: pd.Series) -> pd.Series:
    return html.map(page_text)


def unexpired(cache: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """keys with the payload of a cached row that expires after now, else null."""
    live = cache.where(F.col("expires") > now).select("key", "payload")
    return keys.join(live, "key", "left")
