"""Links, articles and comments out of stored pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that never have content.
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
ARTICLE = "struct<title: string, subtitle: string, date: string, text: string, genres: array<string>>"
COMMENT = "array<struct<comment_id: string, user_names: string, user_follower: int, id: string, timestamp: string, heading: string, text: string, level_in_tree: int, pinned: boolean, votes_pos: int, votes_neg: int>>"


def links(html: str | Column) -> Column:
    """Targets of all anchors, as an array; empty without any."""
    c = F.col(html) if isinstance(html, str) else html
    found = F.regexp_extract_all(c, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


class _Article(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []
        self.title, self.subtitle, self.date = [], [], None
        self.paragraphs: list[list[str]] = []
        self.genres: list[str] = []
        self.crumbs = 0
        self.part: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "time" and self.date is None:
            self.date = a.get("datetime")
        if tag == "nav":
            self.crumbs += 1
        if tag == "a" and self.crumbs and a.get("href"):
            self.genres.append(a["href"])
        if tag == "h1" and not self.title:
            self.part = self.title
        elif tag in ("h2", "h3") and not self.subtitle:
            self.part = self.subtitle
        elif tag == "p":
            self.paragraphs.append([])
            self.part = self.paragraphs[-1]

    def handle_endtag(self, tag: str) -> None:
        if tag == "nav":
            self.crumbs = max(0, self.crumbs - 1)
        if tag in ("h1", "h2", "h3", "p", "article"):
            self.part = None

    def handle_data(self, data: str) -> None:
        if self.part is not None:
            self.part.append(data)


def _words(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def article(pages: pd.Series) -> pd.DataFrame:
    """Title, subtitle, date attribute, paragraphs joined by one space, and the targets in the navigation."""
    rows = []
    for page in pages:
        p = _Article()
        p.feed(page or "")
        p.close()
        rows.append((_words(p.title), _words(p.subtitle), p.date, " ".join(filter(None, map(_words, p.paragraphs))), p.genres))
    return pd.DataFrame(rows, columns=["title", "subtitle", "date", "text", "genres"])


def articles(df: DataFrame, html: str = "html") -> DataFrame:
    """The columns of an article; genre2 and genre3 are null where the navigation ends before."""
    out = df.withColumn("_a", F.pandas_udf(article, ARTICLE)(html))
    genres = {f"genre{k}": F.expr(f"try_element_at(_a.genres, {k})") for k in (1, 2, 3)}
    return out.withColumns({c: F.col(f"_a.{c}") for c in ("title", "subtitle", "date", "text")} | genres).drop("_a", html)


class _Comments(HTMLParser):
    """Postings as elements of class "posting", their fields as elements or attributes in them."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.field: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if "posting" in classes:
            self.rows.append({"comment_id": a.get("id", "")[7:], "user_names": a.get("aria-label", "")[12:], "user_follower": 0, "id": a.get("data-postingid", ""), "timestamp": "", "heading": "", "text": "", "level_in_tree": int(a.get("data-level", "0") or 0), "pinned": "pinned" in classes, "votes_pos": 0, "votes_neg": 0})
        self.field = None
        if self.rows:
            for name in ("user_follower", "timestamp", "heading", "text", "votes_pos", "votes_neg"):
                if name in classes:
                    self.field = name

    def handle_endtag(self, tag: str) -> None:
        self.field = None

    def handle_data(self, data: str) -> None:
        if self.field is None:
            return
        row, value = self.rows[-1], data.strip()
        if isinstance(row[self.field], int):
            row[self.field] = int(value) if value.isdecimal() else 0
        else:
            row[self.field] = (row[self.field] + " " + value).strip()


def comments_of(pages: pd.Series) -> pd.Series:
    out = []
    for page in pages:
        p = _Comments()
        p.feed(page or "")
        p.close()
        out.append(p.rows)
    return pd.Series(out)


def comments(df: DataFrame, article: str, html: str = "html") -> DataFrame:
    """One row a comment, in the page's order; followers and votes default to 0, texts to ""."""
    return df.select(F.col(article).alias("article"), F.posexplode(F.pandas_udf(comments_of, COMMENT)(html))).select("article", (F.col("pos") + 1).alias("order"), "col.*")


#: The forum's elements, the class of a content element with the length of what stands before
#: the comment's id in it, and that of what stands before a user's name and before the number in an id.
POSTING, HEAD, USER, RATING = "dst-posting", "dst-posting-head", "dst-posting--user", "dst-posting--ratinglog"
CONTENT, BEFORE_ID, BEFORE_NAME, BEFORE_NUMBER = "posting--content", 26, 12, 7
FORUM = "array<struct<comment_id: string, id: string, user_names: string, user_follower: int, timestamp: string, heading: string, text: string, pinned: string, is_root_comment: int, is_leaf_comment: int, level_in_tree: int, root_of_tree: string, votes_pos: int, votes_neg: int>>"


class _Forum(HTMLParser):
    """Postings as elements of their own; fields are the first elements that match inside them."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.open: list[tuple[str, list[str]]] = []
        self.root = ""
        self.field: str | None = None
        self.depth = 0
        self.seen: set[str] = set()

    def within(self, *tags: str) -> bool:
        """Whether the tags are open in this order, the first of them outermost."""
        rest = iter(t for t, _ in self.open)
        return all(t in rest for t in tags)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in EMPTY:
            return
        if tag == POSTING:
            level = int(a["data-level"]) if a.get("data-level", "").isdecimal() else 0
            self.rows.append({"comment_id": "", "id": "", "user_names": a.get("aria-label", "")[BEFORE_NAME:], "user_follower": 0, "timestamp": "", "heading": "", "text": "", "pinned": "", "is_root_comment": int(level == 0), "is_leaf_comment": int(a.get("class") == "posting"), "level_in_tree": level, "root_of_tree": "", "votes_pos": 0, "votes_neg": 0})
            self.open, self.field, self.seen, self.deleted = [], None, set(), "posting-deleted" in a.get("class", "").split()
        if not self.rows:
            return
        row = self.rows[-1]
        if tag == "div" and a.get("class", "").startswith(CONTENT) and not row["comment_id"]:
            row["comment_id"] = a["class"][BEFORE_ID:]
            row["id"] = row["comment_id"][BEFORE_NUMBER:]
            self.root = row["comment_id"] if row["is_root_comment"] else self.root
            row["root_of_tree"] = self.root
        in_content = any(t == "div" and any(c.startswith(CONTENT) for c in classes) for t, classes in self.open)
        if tag == "time" and self.within(HEAD) and not self.deleted and not row["timestamp"]:
            row["timestamp"] = a.get("data-date", "")
        classes = a.get("class", "").split()
        wanted = None
        if tag in ("h1", "p") and in_content:
            wanted = "heading" if tag == "h1" else "text"
        elif tag == "title" and self.within(HEAD, "time", "strong", "svg"):
            wanted = "pinned"
        elif tag == "div" and self.within(HEAD, USER, "button", "span"):
            wanted = "user_follower"
        elif tag == "span" and self.within(RATING, "button"):
            wanted = "votes_pos" if "pos" in classes else "votes_neg" if "neg" in classes else None
        self.open.append((tag, classes))
        if wanted and wanted not in self.seen and self.field is None:
            self.field, self.depth = wanted, len(self.open)
            self.seen.add(wanted)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        if self.field and len(self.open) < self.depth:
            self.field = None

    def handle_data(self, data: str) -> None:
        if self.field is None:
            return
        row = self.rows[-1]
        if isinstance(row[self.field], int):
            row[self.field] = int(data) if data.strip().isdecimal() else row[self.field]
        else:
            row[self.field] += data


def forum_of(pages: pd.Series) -> pd.Series:
    out = []
    for page in pages:
        p = _Forum()
        p.feed(page or "")
        p.close()
        out.append(p.rows)
    return pd.Series(out)


def forum_comments(df: DataFrame, article: str, html: str = "html") -> DataFrame:
    """One row a posting of a stored forum page, in the page's order, with its place in the tree.

    Numbers default to 0, texts to ""; a deleted posting has a blank time; a
    posting without postings of its own is a leaf; the root is the last of level 0
    at or above.
    """
    return df.select(F.col(article).alias("article"), F.posexplode(F.pandas_udf(forum_of, FORUM)(html))).select("article", (F.col("pos") + 1).alias("order"), "col.*")
