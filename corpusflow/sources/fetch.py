"""Web searches and page fetches through an injected transport, per Arrow batch."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.web import canonical, page_text


@dataclass
class Reply:
    """body is bytes, or parts of them that are read as they come."""

    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes | Iterable[bytes] = b""

    def content(self, most: int | None = None) -> bytes | None:
        """The whole body; null if it has more than `most` bytes, of which no more
        parts are read then."""
        out = bytearray()
        for part in [self.body] if isinstance(self.body, bytes) else self.body:
            out += part
            if most is not None and len(out) > most:
                return None
        return bytes(out)


Get = Callable[[str], Reply]
"""A transport: a URL to a reply, without following redirects; OSError if it can't."""
Allowed = Callable[[str], bool]

HOPS, MOST_BYTES, AGENT = 6, 2_000_000, "CorpusflowBot/0.2"
RESULTS = "query_id long, position long, url string, title string, description string, age string, error string"


def with_retries(call: Callable[[], Reply], retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> Reply:
    """The first reply that is neither 429 nor 5xx. Between attempts it waits for
    what retry-after says, else 2**n seconds, 4 at most."""
    why = "no attempt"
    for n in range(retries):
        try:
            reply = call()
        except OSError as e:
            why, delay = str(e), 2.0**n
        else:
            if reply.status != 429 and reply.status < 500:
                return reply
            said = reply.headers.get("retry-after", "")
            why, delay = f"status {reply.status}", float(said if said.strip().isdigit() else 2**n)
        if n + 1 < retries:
            sleep(min(4.0, delay))
    raise RuntimeError(f"web search failed after retries: {why}")


def search(queries: DataFrame, find: Callable[[str, int], list[dict] | Reply], k: int = 5, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """RESULTS of each query (query_id, text): up to min(20, 2k) rows by position,
    or one row with an error. `find` gives rows, or the API's reply with a JSON
    list of them; a reply of 429 or 5xx, or OSError, is tried again by with_retries."""
    count = min(20, 2 * k)

    def one(text: str) -> Reply:
        found = find(text, count)
        return found if isinstance(found, Reply) else Reply(200, body=json.dumps(found).encode())

    def rows_of(text: str) -> tuple[list[dict], str | None]:
        try:
            reply = with_retries(lambda: one(text), retries, sleep)
        except RuntimeError as e:
            return [], str(e)
        if reply.status != 200:
            return [], f"web search failed: status {reply.status}"
        return json.loads(reply.content())[:count], None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RESULTS.split(", ")]
        for f in frames:
            out = []
            for i, text in zip(f["query_id"], f["text"], strict=True):
                asked = " ".join((text or "").split())
                found, error = rows_of(asked) if asked else ([], None)
                out += [(i, p, r.get("url"), r.get("title"), r.get("description"), r.get("age"), None) for p, r in enumerate(found)]
                if error:
                    out.append((i, None, None, None, None, None, error))
            yield pd.DataFrame(out, columns=names).astype({"position": "Int64"})

    return queries.select("query_id", "text").mapInPandas(run, RESULTS)


def followed(url: str, get: Get, admit: Callable[[str], str | None]) -> tuple[str, Reply] | None:
    """The address and reply at the end of the redirects from url, HOPS requests at
    most. Each address is admitted first; null if one isn't, if a redirect names
    no place, if there are too many, or if the transport fails."""
    at: str | None = url
    for _ in range(HOPS):
        safe = admit(at) if at else None
        if safe is None:
            return None
        try:
            reply = get(safe)
        except OSError:
            return None
        if not 300 <= reply.status < 400:
            return safe, reply
        place = reply.headers.get("location")
        at = urljoin(safe, place) if place else None
    return None


@dataclass
class Robots:
    """What sites let an agent fetch; each site's rules are read once."""

    get: Get
    public: Callable[[str], str | None]
    agent: str = AGENT
    known: dict[str, RobotFileParser] = field(default_factory=dict)

    def allow(self, url: str) -> bool:
        site = "{0.scheme}://{0.netloc}".format(urlsplit(url))
        if site not in self.known:
            self.known[site] = RobotFileParser()
            end = followed(f"{site}/robots.txt", self.get, self.public)
            lines = (end[1].content(MOST_BYTES) or b"").decode("utf-8", "replace").splitlines() if end and end[1].status == 200 else []
            self.known[site].parse(lines)
        return self.known[site].can_fetch(self.agent, url)


def page_of(reply: Reply, most: int = MOST_BYTES) -> str | None:
    """The text of a reply that is HTML or plain text of at most `most` bytes in a
    known encoding; else null."""
    kind, _, rest = reply.headers.get("content-type", "").lower().partition(";")
    html = "text/html" in kind
    if reply.status >= 400 or not (html or "text/plain" in kind):
        return None
    raw = reply.content(most)
    encoding = rest.partition("charset=")[2].split(";")[0].strip() or "utf-8"
    try:
        text = None if raw is None else raw.decode(encoding, "replace")
    except LookupError:
        return None
    return page_text(text) if html and text is not None else text


def fetched(url: str, get: Get, public: Callable[[str], str | None], robots: Robots | None = None, most: int = MOST_BYTES) -> str | None:
    """The text of one page, or null: not public, disallowed, too many redirects,
    neither HTML nor plain text, too large, or not readable. Each hop is checked anew."""

    def admit(at: str) -> str | None:
        safe = public(at)
        return safe if safe and (robots is None or robots.allow(safe)) else None

    end = followed(url, get, admit)
    return page_of(end[1], most) if end else None


def enriched(results: DataFrame, get: Get, public: Callable[[str], str | None] = canonical, concurrency: int = 5, url: str = "url", content: str = "content", respect_robots: bool = True) -> DataFrame:
    """results with the cleaned text of their pages where it could be had. At
    most `concurrency` fetches run at once in a task."""
    schema = results.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        robots = Robots(get, public) if respect_robots else None
        with ThreadPoolExecutor(concurrency) as pool:
            for f in frames:
                pages = list(pool.map(lambda u: fetched(u or "", get, public, robots), f[url]))
                yield f.assign(**{content: [p if p and p.strip() else c for p, c in zip(pages, f[content], strict=True)]})

    return results.mapInPandas(run, schema).withColumn(content, X.sanitized(F.col(content)))
