"""Thread pages (S2 to S5, K9): list, post and comment parsing over HTML that was captured before.

Links and ids come from regular expressions in the JVM; only HTML to text needs a parser, which is
the standard library's, over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.numbers import first_int, timestamp_of
from tallyglass.functions.text import text_of

SKIPPED = {"script", "style", "noscript", "template"}
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "section", "article", "ul", "ol", "table", "title"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.title: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in SKIPPED
        self.in_title |= tag == "title"
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in SKIPPED and self.hidden > 0
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.out.append(data.replace("\n", " "))


def html_text(html: str | None) -> tuple[str, str]:
    """(title, text) with a line per block and single spaces; broken markup gives what can be read."""
    p = _Text()
    p.feed(html or "")
    p.close()
    lines = (" ".join(line.split()) for line in "".join(p.out).split("\n"))
    return " ".join("".join(p.title).split()), "\n".join(line for line in lines if line)


def extract_text(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """S3: id, title, text. NULL markup gives empty texts."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [html_text(h) for h in f["html"]]
            yield pd.DataFrame({"id": f["id"], "title": [m[0] for m in made], "text": [m[1] for m in made]})

    src = pages.select(F.col(id).alias("id"), F.col(html).alias("html"))
    return src.mapInPandas(parse, f"id {dict(src.dtypes)['id']}, title string, text string")


def list_url(gallery: str, keyword: str, page: int, base: str) -> str:
    """S3: address of a result page."""
    from urllib.parse import urlencode

    return f"{base}?{urlencode({'id': gallery, 's_type': 'search_subject_memo', 's_keyword': keyword, 'page': page})}"


def listed_threads(html: Column) -> Column:
    """S3: distinct thread numbers of a result page, in order."""
    return F.array_distinct(F.regexp_extract_all(text_of(html), F.lit(r"[?&;]no=(\d+)"), 1))


def comments_from_payloads(payloads: Column) -> Column:
    """K9: comments of all pages in page order; payloads are (comment_page, comments)."""
    return F.flatten(F.transform(F.sort_array(payloads), lambda p: p["comments"]))


def post_columns(meta: Column) -> list[Column]:
    """the nine columns of a post; a blank or zero comment count falls through to the next key."""
    count = lambda c: F.nullif(first_int(c), F.lit(0))
    return [
        meta["body"].alias("body"), meta["title"].alias("title"),
        F.coalesce(meta["nick"], meta["owner_username"]).alias("author"), timestamp_of(meta["posted_at"]).alias("posted_at"),
        first_int(meta["likes"]).alias("likes"), first_int(meta["views"]).alias("views"),
        F.coalesce(count(meta["comment_count"]), first_int(meta["comments"])).alias("comment_count"),
        first_int(meta["recommend_up"]).alias("votes_up"), first_int(meta["recommend_down"]).alias("votes_down"),
    ]


def reprocess(latest_rows: DataFrame, keywords: list[str]) -> DataFrame:
    """Threads of the raw log that were collected for one of the keywords: thread_no, html, payloads in page order."""
    obj = lambda p: F.get_json_object("item", p)
    rows = latest_rows.select(obj("$.thread_no").alias("thread_no"), obj("$.type").alias("type"), obj("$.html").alias("html"),
                              obj("$.comment_page").cast("int").alias("comment_page"), obj("$.payload").alias("payload"),
                              F.from_json(obj("$.keywords"), "array<string>").alias("keywords"))
    posts = rows.where(F.col("type") == "post")
    if keywords:
        posts = posts.where(F.arrays_overlap("keywords", F.array(*map(F.lit, keywords))))
    comments = rows.where(F.col("type") == "comments").groupBy("thread_no").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("comment_page", "payload"))), lambda p: p["payload"]).alias("payloads")
    )
    return posts.select("thread_no", "html").join(comments, "thread_no", "left")
