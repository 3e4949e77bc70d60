"""Main text of web pages by differencing pages whose URLs are nearest."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import chain
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.session import table

CHROME, OPEN, ARTICLE, MAIN = 0, 1, 2, 3  # zones of a line: of a part that is never main text, of none, of an article's body, of <main> without an article
# HTML's element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("aside button dialog footer form head iframe menu nav noscript option script select style svg template textarea title".split())
NEVER_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NEVER_NAME = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent footer masthead menu nav navbar "
    "navigation newsletter notice notices popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar".split()
)
#: Names that are clear even as a part of a longer one, such as ``comment-list``.
NEVER_PART = frozenset("advert advertisement breadcrumb breadcrumbs comment comments cookie cookies navbar newsletter sidebar sponsored".split())
CLOSES_P = BLOCK - {"body", "html", "head"}
INLINE = frozenset("p b i em strong span a u font".split())
BODY = frozenset("html body article main".split())  # never chrome, whatever their classes
STEP = 64  # range starts looked through at a time


class Lines(HTMLParser):
    """The text lines of a page, one for each block, each with its zone. Malformed markup raises nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.stack: list[tuple[str, bool, int]] = [("", False, OPEN)]  # tag, whether chrome, zone of what isn't
        self.opened: Counter[str] = Counter()
        self.blocks: list[int] = []  # places of block elements on the stack
        self.text: list[str] = []

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text = []
        if line:
            _, chrome, zone = self.stack[-1]
            self.lines.append((line, CHROME if chrome else zone))

    def leave(self, at: int) -> None:
        """Close the element at place ``at`` of the stack and all within it."""
        self.opened.subtract(tag for tag, _, _ in self.stack[at:])
        del self.stack[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section is a bogus comment in HTML, whatever it is called."""
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in BLOCK or tag in NEVER:
            self.flush()
        if tag in CLOSES_P and self.stack[-1][0] in INLINE and self.blocks and self.stack[self.blocks[-1]][0] == "p":
            self.leave(self.blocks[-1])
        if tag == "li" and self.stack[-1][0] == "li":
            self.leave(len(self.stack) - 1)
        _, chrome, zone = self.stack[-1]
        if not chrome and tag not in BODY:
            of = dict(attrs)
            names = f"{of.get('class') or ''} {of.get('id') or ''}".lower().split()
            chrome = (
                tag in NEVER
                or (tag == "header" and zone == OPEN)
                or (of.get("role") or "").lower() in NEVER_ROLE
                or "hidden" in of
                or not NEVER_NAME.isdisjoint(names)
                or not NEVER_PART.isdisjoint(part for name in names for part in name.replace("_", "-").split("-"))
            )
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.opened[tag] += 1
        self.stack.append((tag, chrome, ARTICLE if tag == "article" else MAIN if tag == "main" and zone == OPEN else zone))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK or tag in NEVER:
            self.flush()
        if self.opened[tag] > 0:
            self.leave(next(k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k][0] == tag))

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def page_lines(html: str | None) -> list[tuple[str, int]]:
    if not html:
        return []
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.lines


def lcs_row(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` and every prefix of ``b``, by bit vectors as long as ``b``."""
    spots: dict[int, int] = {}
    for j, x in enumerate(b):
        spots[x] = spots.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        match = row & spots.get(x, 0)
        row = ((row + match) | (row - match)) & full
    bits = np.unpackbits(np.frombuffer((full & ~row).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])


def shared(a: list, b: list) -> list[int]:
    """Positions of ``a`` on a longest common subsequence with ``b``. Halves ``a`` again and again, so memory stays linear."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = list(range(head))
    todo = [(head, len(a) - tail, head, len(b) - tail)]
    while todo:
        i, j, k, l = todo.pop()
        if i == j or k == l:
            continue
        if j - i == 1:
            if a[i] in b[k:l]:
                out.append(i)
            continue
        mid = (i + j) // 2
        best = int((lcs_row(a[i:mid], b[k:l]) + lcs_row(a[mid:j][::-1], b[k:l][::-1])[::-1]).argmax())
        todo += [(i, mid, k, k + best), (mid, j, k + best, l)]
    return sorted(out + list(range(len(a) - tail, len(a))))


def main_text(lines: list[tuple[str, int]], other: list[tuple[str, int]] | None) -> str:
    """The lines that are left when those shared with the nearest page are deleted.

    A template's line counts as shared wherever it stands outside an article's body. Lines of the body stay even if the other page has them too (passages are
    quoted and copied); of ``<main>`` without an article the shared lines before its first own line and behind its last one
    go, those between stay. Chrome goes even if it is this page's own, and so do open lines beside an article. If all of the
    open lines, or of those in ``<main>``, are shared, the other page is a copy and says nothing of them.
    """
    gone: set[int] = set()
    if other:
        both = set(shared([t for t, _ in lines], [t for t, _ in other]))
        own = [i for i, (_, zone) in enumerate(lines) if zone == MAIN and i not in both]
        inside = range(own[0], own[-1] + 1) if own else range(len(lines))
        gone = {i for i in both if lines[i][1] in (OPEN, CHROME) or (lines[i][1] == MAIN and i not in inside)}
        free = [i for i, (_, zone) in enumerate(lines) if zone == OPEN]
        if free and gone.issuperset(free):
            gone.difference_update(free)
    rest = [(t, zone) for i, (t, zone) in enumerate(lines) if i not in gone and zone != CHROME]
    body = any(zone != OPEN for _, zone in rest)
    return "\n".join(t for t, zone in rest if zone != OPEN or not body)


def with_ranges(keyed: DataFrame, parts: int) -> DataFrame:
    """``keyed(host, path, page_id, ...)`` with ``bucket`` and ``halo``: ranges of the order of (host, path, page_id).

    The first page of every range is also put, as ``halo``, into the range before it, and the last one into the range after
    it, so that each page finds both of its neighbours. Only the ends of the ranges, two keys for each, reach the driver.
    """
    key = F.struct("host", "path", "page_id")
    narrow = keyed.select("host", "path", "page_id").repartitionByRange(parts, "host", "path", "page_id")
    ends = narrow.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = ends.groupBy("low").agg(F.max("high").alias("high")).orderBy("low").collect()
    kind = "array<struct<host: string, path: string, page_id: bigint>>"
    listed = lambda keys: F.from_json(F.lit(json.dumps([k.asDict() for k in keys])), kind)
    lows, highs = [r["low"] for r in ends], [r["high"] for r in ends]
    rows = keyed.withColumn("key", key).withColumn("lows", listed(lows)).withColumn("highs", listed(highs)).withColumn("tops", listed(lows[::STEP]))
    rows = rows.withColumn("top", F.expr("greatest(size(filter(tops, b -> b <= key)) - 1, 0)"))
    rows = rows.withColumn("bucket", F.expr(f"greatest(top * {STEP} + size(filter(slice(lows, top * {STEP} + 1, {STEP}), b -> b <= key)) - 1, 0)"))
    also = F.expr("array_compact(array(bucket, IF(bucket > 0 AND key = get(lows, bucket), bucket - 1, null), IF(bucket < size(lows) - 1 AND key = get(highs, bucket), bucket + 1, null)))")
    rows = rows.withColumn("also", also).withColumn("of", F.explode("also"))
    return rows.withColumn("halo", F.col("of") != F.col("bucket")).withColumn("bucket", F.col("of")).drop("key", "lows", "highs", "tops", "top", "also", "of")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``(page_id, url, text, n_chars)``, a row for each row.

    Pages are dealt into ranges of the order of host, path, page_id, so a host of any size is dealt over many tasks; the
    nearest page of a page is the one before or after it in its host with the longer common path (the one before, if both
    are as near; rows alike in these three may stand in any order). A host's only page is cut by its elements alone.
    Null html gives an empty text; a null url is a host of its own, null page_ids come first. Malformed markup is read as
    far as it goes. Repeated rows are repeated, an empty table gives no rows, other columns of ``pages`` are not read.
    """

    def differenced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = here = None  # rows (page_id, url, host, path, bucket, halo, lines)
        done: list[tuple] = []

        def near(page: tuple, other: tuple | None) -> int:
            return -1 if other is None or other[2] != page[2] or other[4] != page[4] else len(commonprefix([other[3], page[3]]))

        def finish(after: tuple | None) -> None:
            if here is not None and not here[5]:
                other = max((before, after), key=lambda o: near(here, o))
                text = main_text(here[6], other[6] if near(here, other) >= 0 else None)
                done.append((here[0], here[1], text, len(text)))

        columns = ["page_id", "url", "text", "n_chars"]
        for f in chain(frames, [None]):
            rows = [None] if f is None else zip(f.page_id, f.url, f.host, f.path, f.bucket, f.halo, f.html, strict=True)
            for row in rows:
                page = None if row is None else (*row[:6], page_lines(row[6]))
                finish(page)
                before, here = here, page
            if done:
                yield pd.DataFrame(done, columns=columns).astype({"page_id": "Int64"})
                done = []

    rest = F.regexp_replace(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    keyed = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), path.alias("path"), "html")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_ranges(keyed, 4 * parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "host", "path", "page_id")
    return dealt.select("page_id", "url", "host", "path", "bucket", "halo", "html").mapInPandas(differenced, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``: ``extract_pages``."""
    return extract_pages(table(spark, sf_dir, "pages"))
