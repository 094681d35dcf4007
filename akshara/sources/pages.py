"""Fetched pages: body, date and title of an article, by the rules of its publisher or a sweep over paragraphs.

Pages are parsed in Arrow batches by the standard library's parser, since class
rules need a tree; everything around it stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akshara.sources.search import domain_key

# They must be these for equal results.
BODY_SELECTORS = {
    "aajtak.in": ["story-with-main-sec", "content-area"],
    "jansatta.com": ["wp-block-post-content"],
    "navbharattimes.indiatimes.com": ["story-card-container", "articleshow"],
    "amarujala.com": ["article-desc", "hide_micropay_story"],
    "livehindustan.com": ["storyArticle", "stryCnt"],
    "pib.gov.in": ["innner-page-main-about-us-content-right-part", "content-area", "pressrelease"],
}
JUNK = re.compile(r"author-card|ad_|social")
BOILERPLATE = ((r"^\s*विस्तार\s*", ""), (r"Add as a preferred\s*\n*\s*source on google\s*", ""))
DATE_META = ("article:published_time", "og:updated_time", "datePublished", "publishdate", "publish-date", "DC.date.issued", "sailthru.date")
URL_REWRITES = (("pib.gov.in", "PressReleaseDetail.aspx", "PressReleasePage.aspx"),)
PARAGRAPH, PIB_PARAGRAPH, LEAST = 30, 40, 200
REMOVED = ("script", "style", "nav", "footer", "aside")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def article_address(url: Column) -> Column:
    """The address of the page that carries the body."""
    out = url
    for host, old, new in URL_REWRITES:
        out = F.when(F.contains(url, F.lit(host)) & F.contains(url, F.lit(old)), F.replace(url, F.lit(old), F.lit(new))).otherwise(out)
    return out


class Node:
    """An element: its name, attributes and children (elements and strings)."""

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack += reversed(x.children)
            elif x.strip():
                out.append(x.strip())
        return out

    def find(self, test) -> Node | None:
        return next((n for n in self.walk() if n is not self and test(n)), None)

    def drop(self, test) -> None:
        for n in list(self.walk()):
            n.children = [c for c in n.children if not (isinstance(c, Node) and test(c))]


class Tree(HTMLParser):
    """Builds the elements of a page; an end tag closes up to its start, and one without a start is nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parsed(page: str) -> Node:
    tree = Tree()
    tree.feed(page)
    tree.close()
    return tree.root


def classed(pattern: str, name: str | None = None, whole: bool = False):
    """Tests an element's classes: one equal to the pattern, or one that holds it."""
    hit = re.compile(pattern).search
    return lambda n: (name is None or n.name == name) and any(c == pattern if whole else hit(c) for c in n.attrs.get("class", "").split())


def text(node: Node | None) -> str:
    return "\n\n".join(node.strings()) if node else ""


def paragraphs(node: Node, least: int) -> str:
    found = ("".join(n.strings()) for n in node.walk() if n.name == "p")
    return "\n\n".join(p for p in found if len(p) >= least)


def by_publisher(key: str, root: Node) -> str:
    """The body by the rules of a listed publisher, empty where its elements are missing."""
    names = BODY_SELECTORS.get(key)
    article = lambda n: n.attrs.get("itemprop") == "articleBody"
    if key in ("aajtak.in", "jansatta.com"):
        return text(next((n for c in names for n in [root.find(classed(c, whole=True))] if n), None))
    if key == "navbharattimes.indiatimes.com":
        node = next((n for c in names for n in [root.find(classed(c, "div"))] if n), None)
        if node:
            node.drop(lambda n: any(JUNK.search(c) for c in n.attrs.get("class", "").split()))
        return text(node)
    if key == "amarujala.com":
        out = text(next((n for test in (*(classed(c, "div") for c in names), article) for n in [root.find(test)] if n), None))
        for old, new in BOILERPLATE:
            out = re.sub(old, new, out)
        return out.strip()
    if key == "livehindustan.com":
        node = root.find(classed("|".join(names), "div")) or root.find(article)
        return text(node) if node else paragraphs(root, PARAGRAPH)
    if key == "pib.gov.in":
        node = root.find(classed(names[0], "div")) or root.find(classed("|".join(names[1:]), "div"))
        return paragraphs(node, PIB_PARAGRAPH) if node else ""
    return ""


def page_date(root: Node) -> str:
    """Ten characters of the first listed meta date, else of the first time element."""
    metas = [n.attrs for n in root.walk() if n.name == "meta"]
    for name in DATE_META:
        found = next((m for attr in ("property", "name", "itemprop") for m in metas if m.get(attr) == name), None)
        if found and found.get("content"):
            return found["content"][:10]
    tag = root.find(lambda n: n.name == "time")
    return tag.attrs.get("datetime", "")[:10] if tag else ""


def page_title(root: Node, body: str) -> str:
    """og:title, else the h1, else the first line of the body."""
    meta = root.find(lambda n: n.name == "meta" and n.attrs.get("property") == "og:title")
    head = root.find(lambda n: n.name == "h1")
    return (meta.attrs.get("content", "").strip() if meta else "") or ("".join(head.strings()) if head else "") or body.split("\n")[0][:120]


def extracted(key: str, page: str) -> tuple[str, str, str, str]:
    """body, extractor, page_date and page_title of a page of a publisher; no body of 200 characters or fewer."""
    root = parsed(page)
    day = page_date(root)
    own = by_publisher(key, (lambda r: (r.drop(lambda n: n.name in REMOVED), r)[1])(parsed(page)))
    if len(own) > LEAST:
        return own, key, day, page_title(root, own)
    swept = parsed(page)
    swept.drop(lambda n: n.name in REMOVED)
    body = paragraphs(swept, PARAGRAPH)
    body, extractor = (body, "generic") if len(body) > LEAST else ("", "")
    return body, extractor, day, page_title(root, body)


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("body", "extractor", "page_date", "page_title")]))
def extraction(key: pd.Series, page: pd.Series) -> pd.DataFrame:
    rows = [extracted(k or "", p) if p else ("", "", "", "") for k, p in zip(key, page, strict=True)]
    return pd.DataFrame(rows, columns=["body", "extractor", "page_date", "page_title"])


def article_pages(df: DataFrame, url: str, page: str, kind: str | None = None) -> DataFrame:
    """df with real_url, body, extractor, page_date and page_title; kind: a column with the content type, pages of others than HTML have no body."""
    html = F.col(page)
    if kind is not None:
        html = F.when(F.contains(F.coalesce(F.col(kind), F.lit("")), F.lit("html")), html)
    rows = df.withColumn("real_url", article_address(F.col(url)))
    rows = rows.withColumn("__x", extraction(domain_key(F.col("real_url")), html))
    return rows.select(*df.columns, "real_url", "__x.body", "__x.extractor", "__x.page_date", "__x.page_title")
