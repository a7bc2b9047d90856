"""HTML pages to located text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import resolve_url
from docketry.session import ship

# Elements whose content is not shown, and elements that break paragraphs.
HIDDEN = ("script", "style", "noscript", "template", "svg")
BLOCKS = (
    "address", "article", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
)
#: An ampersand that begins no reference with a semicolon.
_OPEN = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


class _Reader(HTMLParser):
    """Text by tokens alone: no tree is built, so an element that never closes hides or holds what follows, and no element's content is read differently."""

    CDATA_CONTENT_ELEMENTS = RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.body, self.title = base, [], []
        self.hidden: list[str] = []
        self.in_title, self.link, self.link_text = False, None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif self.hidden:
            return
        elif tag == "title":
            self.in_title = True
        elif tag == "a":
            if self.link is None:
                self.link, self.link_text = dict(attrs).get("href") or "", []
        elif tag in BLOCKS:
            self.body.append("\n\n")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        elif self.hidden:
            return
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.link is not None:
            text = " ".join("".join(self.link_text).split())
            url = resolve_url(self.base, " ".join(self.link.split()))
            self.body.append(f"{text} ({url})" if url else text)
            self.link = None
        elif tag in BLOCKS:
            self.body.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            (self.body if self.link is None else self.link_text).append(data)


def project(html: str | None, url: str | None, closed: bool = False) -> tuple[str, str]:
    """(title, text): paragraphs of collapsed white space, links as "text (url)".

    As HTML has it, some character references count without their semicolon; if `closed`, such text stays as it is written.
    """
    reader = _Reader(url or "")
    reader.feed(_OPEN.sub("&amp;", html or "") if closed else html or "")
    reader.close()
    paragraphs = (" ".join(p.split()) for p in "".join(reader.body).split("\n\n"))
    return " ".join("".join(reader.title).split()), "\n\n".join(p for p in paragraphs if p)


def projected(pages: DataFrame, url: str = "url", html: str = "html", closed: bool = False) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, title, text, line_count); see project()."""

    def each(htmls: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([project(h, u, closed) for h, u in zip(htmls, urls, strict=True)], columns=["title", "text"])

    each.__annotations__ = {"htmls": pd.Series, "urls": pd.Series, "return": pd.DataFrame}
    ship(pages.sparkSession)
    found = pages.select("page_id", F.col(url).alias("url"), F.pandas_udf(each, "title string, text string")(F.col(html), F.col(url)).alias("p"))
    return found.select("page_id", "url", "p.title", "p.text", F.size(F.split("p.text", "\n")).alias("line_count"))


def title(html: Column) -> Column:
    """The first title element's collapsed text, without a parser: for listings."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def readable(data: bytes) -> str:
    """Bytes as UTF-8; anything else is an error, never a replacement."""
    return data.decode("utf-8")




#: Requests that one import makes at most, redirects included. Fixed value.
MAX_ATTEMPTS = 8


def imported(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(url, final_url, attempts, context, problem, html) of explicitly asked URLs (url).

    answers: url, status, location, html, what a request to each URL gives. Redirects are followed,
    MAX_ATTEMPTS requests in all; nothing else is fetched. `context` has the URLs on the way.
    """
    known = answers.select(F.col("url").alias("final_url"), "status", "location", "html")
    moved = F.col("status").between(300, 399) & F.col("location").isNotNull()
    rows = asked.select("url", F.col("url").alias("final_url"), F.array().cast("array<string>").alias("context"))
    out = None
    for attempt in range(1, MAX_ATTEMPTS + 1):
        rows = rows.join(known, "final_url", "left")
        last = attempt == MAX_ATTEMPTS
        over = rows if last else rows.where(~F.coalesce(moved, F.lit(False)))
        problem = F.when(F.col("status").isNull(), "no answer").when(moved, "too many redirects").when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string")))
        part = over.select("url", "final_url", F.lit(attempt).alias("attempts"), "context", problem.alias("problem"), F.when(problem.isNull(), F.col("html")).alias("html"))
        out = part if out is None else out.unionByName(part)
        rows = rows.where(moved).select("url", F.col("location").alias("final_url"), F.concat("context", F.array("final_url")).alias("context"))
    return out
