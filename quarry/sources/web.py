"""Web pages: main text of HTML, titles, and the rules for what may be fetched."""

from __future__ import annotations

import ipaddress
import re
import socket
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import FETCH_SECONDS, MAX_PAGE_BYTES, MAX_REDIRECTS
from quarry.functions.text import host, normalised
from quarry.sources.work import python_ready

_SILENT = {"script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "svg", "head", "iframe"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "main", "blockquote", "pre", "dd", "dt", "header"}
_CELLS = {"td", "th"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "source", "embed", "col", "area", "base", "wbr"}
_ADS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|sponsor|cookie|banner|share|sidebar|breadcrumb)s?(?:$|[\s_-])")


class _Main(HTMLParser):
    """Text inside <article> or <main> if there is one, else of the whole body, without furniture."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.parts: dict[bool, list[str]] = {True: [], False: []}
        self.open: list[tuple[str, bool]] = []
        self.silent = self.inside = self.row = 0
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = " ".join(str(v) for k, v in attrs if k in ("class", "id") and v).lower()
        if tag == "title":
            self.in_title = True
        if tag in _VOID:
            self._say("\n" if tag in _BREAKS else " ")
            return
        hidden = tag in _SILENT or bool(named and _ADS.search(named))
        self.open.append((tag, hidden))
        self.silent += hidden
        self.inside += tag in ("article", "main")
        if tag in _BREAKS:
            self._say("\n\n" if tag == "p" else "\n")
            self.row = 0
        elif tag in _CELLS:
            self._say(" | " if self.row else "")
            self.row += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in _VOID or tag not in [t for t, _ in self.open]:
            return
        while self.open:  # what was left open inside ends here too
            closed, hidden = self.open.pop()
            self.silent -= hidden
            self.inside -= closed in ("article", "main")
            if closed == tag:
                break
        if tag in _BREAKS:
            self._say("\n\n" if tag == "p" else "\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        else:
            self._say(data)

    def _say(self, data: str) -> None:
        if not self.silent and data:
            self.parts[self.inside > 0].append(data)


def main_text(page: str | None) -> tuple[str, str]:
    """(title, text) of a page; comments and furniture are left out, table cells joined by " | "."""
    parser = _Main()
    parser.feed(page or "")
    parser.close()
    text = "".join(parser.parts[True]).strip() or "".join(parser.parts[False]).strip()
    lines = [" ".join(x.split()) for x in text.replace("\0", "").split("\n")]
    return " ".join("".join(parser.title).split()), re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, title, text, sha256, download_bytes, error for rows of page_id, url, html.

    The title is the page's, else the host, else a fixed one. A page without text has an
    error and no text; the digest is of the text, as pages differ in markup only too often.
    """
    python_ready(pages.sparkSession)

    @F.pandas_udf("title string, text string")
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([main_text(x) for x in html], columns=["title", "text"])

    got = pages.select("page_id", "url", "html").withColumn("got", run("html"))
    text = normalised(F.col("got.text"))
    title = F.coalesce(F.nullif(F.col("got.title"), F.lit("")), F.nullif(host(F.col("url")), F.lit("")), F.lit("Untitled page"))
    empty = F.length(text) == 0
    return got.select("page_id", "url", host(F.col("url")).alias("host"), title.alias("title"), F.when(~empty, text).alias("text"), F.when(~empty, F.sha2(text.cast("binary"), 256)).alias("sha256"), F.octet_length("html").alias("download_bytes"), F.when(empty, "no readable text").alias("error"))


class FetchError(ValueError):
    """A URL that may not, or could not, be fetched."""


def is_public(address: str) -> bool:
    """Whether an IP address is neither private nor reserved in any way."""
    ip = ipaddress.ip_address(address.split("%")[0])
    if getattr(ip, "ipv4_mapped", None):
        ip = ip.ipv4_mapped
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)


def resolve(name: str) -> list[str]:
    return [x[4][0] for x in socket.getaddrinfo(name, None, proto=socket.IPPROTO_TCP)]


def check_url(url: str, resolver: Callable[[str], list[str]] = resolve) -> str:
    """The URL, if it is http(s), names a host, and that host has public addresses only."""
    try:
        parts = urlsplit(url.strip())
        name = parts.hostname
    except ValueError as bad:
        raise FetchError("the URL is malformed") from bad
    if parts.scheme not in ("http", "https"):
        raise FetchError("only http and https are allowed")
    if not name:
        raise FetchError("the URL names no host")
    try:
        found = [name] if re.fullmatch(r"[\d.]+|[0-9a-fA-F:]+", name) and (":" in name or name.count(".") == 3) else resolver(name)
    except OSError as bad:
        raise FetchError("the host is unknown") from bad
    if not found or not all(is_public(x) for x in found):
        raise FetchError("the host is not public")
    return url.strip()


@dataclass(frozen=True)
class Response:
    status: int
    headers: dict[str, str]
    body: bytes


class _Still(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def send(url: str) -> Response:
    """One request without redirects; reads one byte past the limit at most."""
    opener = urllib.request.build_opener(_Still)
    try:
        with opener.open(urllib.request.Request(url, headers={"User-Agent": "quarry"}), timeout=FETCH_SECONDS) as got:
            return Response(got.status, {k.lower(): v for k, v in got.headers.items()}, got.read(MAX_PAGE_BYTES + 1))
    except urllib.error.HTTPError as got:
        return Response(got.code, {k.lower(): v for k, v in got.headers.items()}, b"")
    except OSError as bad:
        raise FetchError(f"the download failed: {bad}") from bad


def fetch(url: str, sender: Callable[[str], Response] = send, resolver: Callable[[str], list[str]] = resolve) -> tuple[str, bytes]:
    """(final URL, body): every hop is checked, redirects and size are limited."""
    for _ in range(MAX_REDIRECTS + 1):
        got = sender(check_url(url, resolver))
        if 300 <= got.status < 400 and got.headers.get("location"):
            url = urljoin(url, got.headers["location"])
            continue
        if got.status >= 400:
            raise FetchError(f"the server answered {got.status}")
        if len(got.body) > MAX_PAGE_BYTES:
            raise FetchError("the page is too large")
        return url, got.body
    raise FetchError("too many redirects")


def public_urls(urls: DataFrame, column: str = "url", resolver: Callable[[str], list[str]] | None = None) -> DataFrame:
    """urls with `problem`: why a URL may not be fetched, null if it may. Without a resolver, names count as public."""
    python_ready(urls.sparkSession)
    look = resolver or (lambda _: ["93.184.216.34"])

    @F.pandas_udf("string")
    def run(series: pd.Series) -> pd.Series:
        def one(url: str | None) -> str | None:
            try:
                check_url(url or "", look)
            except FetchError as bad:
                return str(bad)
            return None

        return series.map(one)

    return urls.withColumn("problem", run(column))


def fetched(urls: DataFrame, sender: Callable[[str], Response] = send, resolver: Callable[[str], list[str]] = resolve) -> DataFrame:
    """page_id, url, html, error: pages downloaded by the executors."""
    python_ready(urls.sparkSession)

    @F.pandas_udf("final string, html string, error string")
    def run(series: pd.Series) -> pd.DataFrame:
        rows = []
        for url in series:
            try:
                final, body = fetch(url or "", sender, resolver)
                rows.append((final, body.decode("utf-8", "replace"), None))
            except FetchError as bad:
                rows.append((None, None, str(bad)))
        return pd.DataFrame(rows, columns=["final", "html", "error"])

    return urls.withColumn("got", run("url")).select("page_id", F.coalesce("got.final", "url").alias("url"), "got.html", "got.error")
