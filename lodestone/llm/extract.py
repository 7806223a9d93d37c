"""Main text of web pages: each is aligned with the page nearest by URL on its host, and lines that both share go."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, saved

#: What a line may be: dropped by its element, outside an article, inside one, outside and mostly a link, dropped by a name alone.
CHROME, LOOSE, BODY, LINKED, NAMED = range(5)
RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "template")}
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("aside button canvas datalist dialog embed footer form head iframe input label math menu nav noscript object option script select style svg template textarea title audio video".split())
INLINE = frozenset("p b i em strong span a font u".split())
HEADING = re.compile(r"h[1-6]$")
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
QUOTE = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Whole names in class or id that stand for an element HTML has, or for an advert, a notice or reader comments.
NAMES = frozenset("ad ads advert advertisement aside banner breadcrumbs comments cookie-banner cookie-notice footer header menu nav navbar navigation newsletter notice sidebar site-footer site-header sponsored".split())
#: What a name of several parts may be of (``top-menu``, ``comment-list``): its last part, or the one before a word for a container.
#: Names of what has or has not such a thing (``has-sidebar``) are others.
PARTS = frozenset("ad ads advert advertisement breadcrumb breadcrumbs comment comments cookie cookies menu nav navbar navigation newsletter notice sidebar sponsored".split())
CONTAINERS = frozenset("area banner bar block body box container form item items links list panel section slot thread unit widget wrap wrapper".split())
WRAPPER = re.compile(r"(?:has|no|with|without|is)[-_]")
COMMENT = frozenset("comment comments reply replies".split())
#: Words of a line in a ``menu`` inside an article that is not of links: it is prose, say about food.
PROSE = 8


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(text)}


def marked(name: str, text: str) -> bool | str:
    """Whether an element's attributes say that it is no part of the article; by a name alone: the name's part."""
    if not text or name in ("html", "body", "main"):
        return False
    at = attributes(text)
    names = f"{at.get('class', '')} {at.get('id', '')}".lower().split()
    if name == "article":  # a page's article has all sorts of names, a reader's comment has its own
        return not COMMENT.isdisjoint(names)
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or at.get("role", "").lower() in ROLES or HIDDEN.search(at.get("style", "")):
        return True
    if not NAMES.isdisjoint(names):
        return "menu" if "menu" in names else "name"
    heads = {head(n) for n in names if not WRAPPER.match(n)} & PARTS
    return "menu" if "menu" in heads else "name" if heads else False


def head(name: str) -> str:
    """What a name of parts is of."""
    parts = re.split("[-_]+", name)
    return parts[-2] if len(parts) > 1 and parts[-1] in CONTAINERS else parts[-1]


class Scanner:
    """Finds a page's tags. A character is looked at a fixed number of times, however malformed the page is.

    A quote that never ends, or one that swallows the page's last tag end, makes the rest be read without quotes. What
    follows the last tag end is text.
    """

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, True, page.rfind(">")

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it closes, attributes) of the next tag; comments and declarations have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", False, ""
            if start > self.last:
                return None
            if page[start + 1] in "!?":
                return start, page.find(">", start) + 1, "", False, ""
            if (m := NAME.match(page, start + 1)) is None:
                at = start + 1
                continue
            end = m.end()
            while self.quotes:
                q = QUOTE.search(page, end)
                if q is not None and q[0] == ">":
                    end = q.end()
                    break
                close = -1 if q is None else page.find(q[0], q.end())
                self.quotes = close >= 0
                end = close + 1
            if not self.quotes:
                end = page.find(">", m.end()) + 1
            return start, end, m[1].lower(), page[start + 1] == "/", page[m.end() : end - 1]
        return None


def lines(page: str | None) -> tuple[list[str], list[int]]:
    """The page's lines of text, one a block, with character references decoded and white space made single, and their kinds."""
    texts: list[str] = []
    kinds: list[int] = []
    # open elements: name, whether dropped, whether inside an article, whether the block that its text is in is dropped, and
    # where the paragraph is that only inline elements part it from (-1: none)
    stack: list[tuple[str, bool | str, bool, bool, int]] = []
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    linked = [0]
    heading = False

    def flush() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            dropped, inside = (stack[-1][1] if stack and stack[-1][3] else False, stack[-1][2]) if stack else (False, False)
            links = linked[0] * 2 > len(text)
            if inside and (not dropped or (heading and dropped == "header") or (dropped == "menu" and not links and text.count(" ") >= PROSE - 1)):
                kind = BODY
            elif dropped:
                kind = NAMED if dropped in ("name", "menu") else CHROME
            else:
                kind = LINKED if links else LOOSE
            texts.append(text)
            kinds.append(kind)
        buffer.clear()
        linked[0] = 0

    def put(text: str) -> None:
        """Text of a dropped element inside a line that stays is no part of the line."""
        if not stack or not stack[-1][1] or stack[-1][3]:
            buffer.append(text)
            linked[0] += len(text) * (link > 0)

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    page, at, link = page or "", 0, 0
    scanner = Scanner(page)
    while (tag := scanner.after(at)) is not None:
        start, end, name, close, given = tag
        if start > at:
            put(page[at:start])
        at = end
        if not name:
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in ("td", "th"):
            buffer.append(" ")
        if not close and name in RAW:
            ended = RAW[name].search(page, at)
            at = ended.end() if ended else len(page)
            continue
        block = name in BLOCK
        if block:
            flush()
        if name == "a":
            link = 0 if close else 1
        if close:
            if opened[name]:
                while pop() != name:
                    pass
            heading = heading and not HEADING.match(name)
            continue
        if name in VOID or not (block or name in DROP or given.strip("/ ")):
            continue  # void, or an inline element that changes nothing
        if name == "p" or HEADING.match(name):  # these end an open paragraph
            first = stack[-1][4] if stack else -1
            while 0 <= first < len(stack):
                pop()
            heading = bool(HEADING.match(name))
        elif name == "li":
            while stack and stack[-1][0] == "li":
                pop()
        dropped, inside, hidden, paragraph = stack[-1][1:] if stack else (False, False, False, -1)
        if not dropped:
            dropped = name in DROP or marked(name, given) or ("header" if name == "header" else False)
            if not dropped and (name in ("article", "main") or "articleBody" in given):
                inside = True
        if given.endswith("/") and not block:
            continue
        stack.append((name, dropped, inside, bool(dropped) if block else hidden, len(stack) if name == "p" else paragraph if name in INLINE else -1))
        opened[name] += 1
    put(page[at:])
    flush()
    return texts, kinds


def lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each prefix of ``b``, by a bit vector."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer((~v & full).to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits)])


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``: halves of ``a`` split ``b`` where both fit best."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k]:
            out.append(i)
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            out.append(j)
        if i >= j or k >= n:
            continue
        if j - i == 1:
            if a[i] in b[k:n]:
                out.append(i)
            continue
        half = (i + j) // 2
        front, back = lengths(a[i:half], b[k:n]), lengths(a[half:j][::-1], b[k:n][::-1])[::-1]
        if not (front + back).any():
            continue
        cut = k + int((front + back).argmax())
        todo += [(i, half, k, cut), (half, j, cut, n)]
    return sorted(out)


Page = tuple[str | None, str | None, list[int], list[int], list[int]]  # host, path; of each line digest, length, kind


def near(a: Page, b: Page | None) -> int:
    """Characters that two paths on one host have in common at the start; -1 for another host."""
    if b is None or a[0] is None or a[0] != b[0]:
        return -1
    x, y = a[1] or "", b[1] or ""
    return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def alike(bodies: list[list[int]]) -> tuple[int, int]:
    """How many lines all the bodies begin with alike, and how many they end with alike."""
    count = lambda rows: next((i for i, x in enumerate(zip(*rows, strict=False)) if len(set(x)) > 1), min(map(len, rows)))
    return count(bodies), count([b[::-1] for b in bodies])


def repeated(page: Page, before: Page | None, after: Page | None) -> list[int]:
    """Numbers of the lines that a page loses, between its neighbours in the order of paths, whose texts differ from its.

    The neighbour with the longer common path is the pair, the one before on a tie. All lines are aligned, those that
    markup will drop too. A line outside an article goes if a longest common subsequence with the pair has it. Articles quote each other and come in edited copies, so inside one
    a line goes only if it's part of a template: it stands in a run of lines with which all three articles begin, or
    end, while neither neighbour shares half of the page's article.
    """
    _, _, own, sizes, kinds = page
    by = sorted((x for x in (before, after) if near(page, x) >= 0), key=lambda x: -near(page, x))
    if not by:
        return []
    same = [shared(own, x[2]) for x in by]
    out = [i for i in same[0] if kinds[i] != BODY]
    body = [i for i, k in enumerate(kinds) if k == BODY]
    half = sum(sizes[i] for i in body) / 2
    if len(by) == 2 and all(sum(sizes[i] for i in x if kinds[i] == BODY) < half for x in same):
        first, last = alike([[m for m, k in zip(x[2], x[4], strict=True) if k == BODY] for x in (page, *by)])
        out += body[:first] + body[max(first, len(body) - last) :]
    return sorted(out)


def staying(texts: list[str], kinds: list[int]) -> list[int]:
    """Numbers of the lines that markup leaves: those inside articles, if these have as much text as what is outside and is
    neither dropped nor links; else those outside too. Where that is nothing, what names alone have dropped stays."""
    size = lambda kind: sum(len(t) for t, k in zip(texts, kinds, strict=True) if k == kind)
    kept = (BODY,) if size(BODY) >= max(1, size(LOOSE)) else (BODY, LOOSE, LINKED)
    found = [i for i, k in enumerate(kinds) if k in kept]
    return found or [i for i, k in enumerate(kinds) if k == NAMED]


def article(page: str | None) -> tuple[list[str], list[int]]:
    """Lines that markup alone leaves, and their kinds."""
    texts, kinds = lines(page)
    on = staying(texts, kinds)
    return [texts[i] for i in on], [kinds[i] for i in on]


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each row of ``pages`` (key, url, html): key, url, text, n_chars, n_shared (lines deleted as shared, be they
    such that markup drops or not).

    Digests of the pages' lines are sorted by host and path over all partitions, so that the nearest page by path is a
    neighbour; the first and last page of each partition are handed to the partitions around it, so a host may span any
    number of them. Pages of one host with the same lines are one there, at the first of their paths, so that a page is
    paired with one whose text differs. Only numbers of deleted lines come back to the texts. Null or empty html gives
    an empty text. Null url: the page has no pair, and markup alone decides. Equal URLs are each other's pair. Repeated
    rows give a row each, of one text. Other columns are ignored.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    row = F.xxhash64(F.col(key).isNull(), key, F.col("url").isNull(), "url", "html")
    keyed = pages.select(F.col(key).alias("key"), "url", "html", row.alias("row"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                each = [lines(x) for x in part["html"].to_pylist()]
                marks = [[xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in texts] for texts, _ in each]
                lists = [
                    pa.array(marks, pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts] for texts, _ in each], pa.list_(pa.int32())),
                    pa.array([k for _, k in each], pa.list_(pa.int8())),
                ]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in ("row", "host", "path")], *lists], names=["row", "host", "path", "marks", "sizes", "kinds"])

    hosted = keyed.select("row", F.nullif(host, F.lit("")).alias("host"), path.alias("path"), "html").where("host is not null and html is not null")
    read = hosted.mapInArrow(digest, "row long, host string, path string, marks array<long>, sizes array<int>, kinds array<tinyint>")
    digests = saved(read.withColumn("page", F.xxhash64("host", "marks", "kinds")), "digests")
    columns = ["page", "host", "path", "marks", "sizes", "kinds"]
    one = F.struct(*columns)
    single = digests.groupBy("page").agg(F.min_by(one, "path").alias("p")).select("p.*")
    order = ["host", "path", "page"]
    placed = saved(single.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "pages")
    # one row a partition: its first and last page go to the nearest partitions that have any
    edge = saved(placed.groupBy("part").agg(F.min_by(one, F.struct(*order)).alias("first"), F.max_by(one, F.struct(*order)).alias("last")), "edges")
    parts = [r["part"] for r in edge.select("part").orderBy("part").collect()]  # as many as partitions
    step = spark.createDataFrame([(p, b, a) for p, b, a in zip(parts, [None, *parts], [*parts[1:], None], strict=False)], "part int, before int, after int")
    outer = edge.join(F.broadcast(step), "part")
    extra = outer.select(F.col("after").alias("part"), F.lit(0).alias("side"), F.col("last").alias("p"))
    extra = extra.unionByName(outer.select(F.col("before").alias("part"), F.lit(2).alias("side"), F.col("first").alias("p"))).where("part is not null")
    every = placed.select("part", F.lit(1).alias("side"), *columns).unionByName(extra.select("part", "side", *[F.col(f"p.{c}").alias(c) for c in columns]))
    every = every.repartition(n, "part").sortWithinPartitions("part", "side", *order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(0, len(batch), 1024):
                    yield from zip(*[batch[c].slice(i, 1024).to_pylist() for c in ("part", "side", *columns)], strict=True)

        out: list[tuple] = []
        before = now = None
        for after in chain(rows(), [None]):
            if now is not None and now[1] == 1:
                gone = repeated(now[3:], before[3:] if before and before[0] == now[0] else None, after[3:] if after and after[0] == now[0] else None)
                if gone:
                    out.append((now[2], gone))
            before, now = now, after
            if len(out) >= 4096 or out and after is None:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([g for _, g in out], pa.list_(pa.int32()))], names=["page", "gone"])
                out = []

    gone = saved(every.mapInArrow(walk, "page long, gone array<int>"), "gone")
    # rows that are equal have one digest each, all the same
    gone = saved(digests.select("row", "page").join(gone, "page").groupBy("row").agg(F.max("gone").alias("gone")), "gone")

    @F.pandas_udf("text string, n_chars long, n_shared int")
    def text_of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for h, g in parts:
            out = []
            for page, numbers in zip(h, g, strict=True):
                less = set() if numbers is None else set(numbers.tolist() if hasattr(numbers, "tolist") else numbers)
                texts, kinds = lines(page)
                text = "\n\n".join(texts[i] for i in staying(texts, kinds) if i not in less)
                out.append((text, len(text), len(less)))
            yield pd.DataFrame(out, columns=["text", "n_chars", "n_shared"])

    met = keyed.join(gone, "row", "left").select("key", "url", text_of("html", "gone").alias("t"))
    return met.select(F.col("key").alias(key), "url", "t.text", "t.n_chars", "t.n_shared")
