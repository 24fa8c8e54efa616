"""Main text of pages by nearest-URL differencing, with the page's own landmarks.

A page is read into text blocks. Pages of a host are put in the order of their paths, each is paired with the one of its
neighbours whose path is nearest, and the lines that both have, by longest common subsequence, are deleted as template. A
neighbour with the very same texts shows no template: the nearest is the nearest whose texts differ. What differencing cannot
tell, the page's landmarks do: furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) goes though its
words be the page's own, an article's line stays though a copy stands elsewhere, and a page without a neighbour gives its article.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .shared import ARROW_ROWS, settle, small_batches
from .urlfilter import url_host, url_path

#: Pages of a range, about, where the session's number of shuffle partitions gives larger ones.
RANGE_PAGES = 1 << 15

#: Regions of a page. In FURNITURE an article begins all the same; what is ASIDE (menus, sidebars, comments) has no article in it.
#: From FORM on, a number for each form: furniture, unless the form turns out to hold the page.
OWN, FURNITURE, OTHER, ASIDE, FORM = 0, 1, 2, 3, 4

# a quote opens a value only after an equals sign; elsewhere it is a character like others, and the tag ends at the next >
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)|[^>])*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose content is not text, and those whose content is furniture.
_RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "noembed", "noframes"}
_FURNITURE = {"header", "button", "select", "head", "fieldset", "datalist"}
_ASIDE = {"nav", "footer", "aside", "menu", "dialog"}
_OWN = {"article", "main"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "link", "map", "mark", "meta",
    "canvas", "object", "svg", "g", "text", "tspan", "desc", "math", "mfrac", "mi", "mn", "mo", "mroot", "mrow", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "semantics",
    "output", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: What begins on the left ends an open element on the right.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role values that mark furniture, and those that mark the article.
_FURNITURE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "disqus",
    "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related", "reply", "replies",
    "respond", "search", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
_OWN_WORDS = {"article", "articlebody", "entry-content", "main", "main-content", "post-content", "post-body", "article-body", "article-content"}


#: First parts of names that tell of a layout, not of furniture (with-sidebar), and last parts of names of furniture (ad-slot).
_STATES = {"has", "hide", "is", "no", "non", "not", "one", "show", "three", "two", "with", "without"}
_HOLDERS = {
    "area", "bar", "block", "body", "box", "button", "buttons", "container", "form", "group", "holder", "icons", "inner", "item", "items", "label", "link", "links", "list", "panel", "posts", "row",
    "section", "signup", "slot", "slots", "text", "thread", "title", "toggle", "top", "unit", "wrap", "wrapper",
}
#: Words that mark comments; in an article an id marks nothing else, as it is an anchor.
_COMMENTS = {"comment", "comments", "disqus", "replies", "respond"}


def _names(attributes: str) -> Iterator[tuple[str, str]]:
    """(attribute, name) of each name in class, id and role."""
    for found in _NAMES.finditer(attributes):
        for name in (found[2] or found[3] or found[4] or "").lower().split():
            yield found[1].lower(), name


def _marks_furniture(name: str, words: set[str]) -> bool:
    """Whether a name is one of the words, ends in one (user-comments), or begins with one and ends in a holder's name (ad-slot)."""
    if name in words:
        return True
    parts = re.split("[-_]+", name)
    first, last = parts[0], parts[-1]
    if len(parts) < 2 or first in _STATES:
        return False
    return last in words or first in words and (last in _HOLDERS or last.isdigit())


def _region(tag: str, attributes: str, inside: int) -> int:
    """The region of an element within a region.

    An article or main part begins whatever holds it, unless that is aside or the article is a comment by its name. Of names,
    whole ones count, and hyphenated ones that end in a word or a holder's name; with-sidebar and share-price tell nothing.
    """
    if inside == ASIDE and tag != "main" or tag in _ASIDE:
        return ASIDE
    found = [(kind, n) for kind, n in _names(attributes)] if "=" in attributes and tag not in ("body", "html") else []
    words = _FURNITURE_WORDS if tag != "article" else _COMMENTS
    for kind, name in found:
        if _marks_furniture(name, _COMMENTS if kind == "id" and inside == OWN else words) and tag != "main":
            return ASIDE if name in words or tag == "article" else FURNITURE
    if tag in _OWN or any(name in _OWN_WORDS for _, name in found):
        return OWN
    if inside == FURNITURE or tag in _FURNITURE and not (tag == "header" and inside == OWN):
        return FURNITURE
    return inside


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, region) of the text blocks of a page in order; each is trimmed and has single spaces.

    Character references are decoded, markup is left out; unclosed and crossing elements end with what holds them.
    """
    page = page or ""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = [("", OTHER)]
    parts: list[str] = []
    forms, pages = 0, set()  # forms so far, and those that hold a page: an article, a main part or a heading of the first order
    at, n = 0, len(page)

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((text, stack[-1][1]))
            parts.clear()

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            parts.append(page[at:])
            break
        if begin > at:
            parts.append(page[at:begin])
        m = _TOKEN.match(page, begin)
        if not m:
            parts.append("<")
            at = begin + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        if closing:
            deep = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if deep:
                del stack[deep:]
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            continue
        if tag in _VOID or m[3].endswith("/") and tag not in ("div", "p", "section"):
            continue
        if stack[-1][0] == "p":
            stack.pop()
        while stack[-1][0] in _CLOSES.get(tag, ()):
            stack.pop()
        if tag == "body" and stack[-1][0] == "head":
            stack.pop()
        inside = stack[-1][1]
        if tag in _OWN or tag == "h1":
            pages.update(region for _, region in stack if region >= FORM)
        region = _region(tag if tag != "form" else "div", m[3], inside)
        if tag == "form" and region != ASIDE:
            region, forms = (FORM + forms, forms + 1) if region == inside == OTHER else (FURNITURE, forms)
        stack.append((tag, region))
    flush()
    return [(text, region if region < FORM else OTHER if region in pages else FURNITURE) for text, region in out]


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of two lists of lines."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = {*range(low), *range(len(a) - high, len(a))}
    inner, other = range(low, len(a) - high), set(b[low : len(b) - high])
    mine = [i for i in inner if a[i] in other]
    kept = {a[i] for i in mine}
    theirs = [x for x in b[low : len(b) - high] if x in kept]
    # longest increasing run of matches (Hunt and Szymanski): fast where few lines are shared
    places: dict[str, list[int]] = {}
    for j, x in enumerate(theirs):
        places.setdefault(x, []).append(j)
    from bisect import bisect_left

    tails: list[int] = []
    chain: list[tuple[int, tuple | None]] = []
    for i in mine:
        for j in reversed(places[a[i]]):
            k = bisect_left(tails, j)
            node = (i, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(node)
            else:
                tails[k], chain[k] = j, node
    node = chain[-1] if chain else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def main_text(own: list[tuple[str, int]], near: list[tuple[str, int]] | None) -> str:
    """The article of a page, given its blocks and those of its nearest page, blocks joined by two line ends.

    Furniture goes, an article's lines stay, and of the other lines those shared with the nearest page go. A page that
    the nearest repeats in full shows no template; there, and without a nearest page, the others stay only if there is no article.
    """
    shared = common_lines([t for t, _ in own], [t for t, _ in near]) if near else set()
    told = near is not None and len(shared) < len(own)
    others = told or all(region != OWN for _, region in own)
    return "\n\n".join(t for i, (t, region) in enumerate(own) if region == OWN or region == OTHER and others and not (told and i in shared))


def _nearest(path: str, before: str | None, after: str | None) -> int:
    """-1 or 1: the neighbour with the longer common start of the path; the one before if equal; 0 without any."""
    if before is None or after is None:
        return -1 if before is not None else 1 if after is not None else 0
    return 1 if len(commonprefix([path, after])) > len(commonprefix([path, before])) else -1


def _seal(text: Column) -> Column:
    """64-bit hash of the texts of a page's blocks, as a column; equal for pages that differ in markup only."""

    @F.pandas_udf("long")
    def of(sources: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh64_intdigest("\n".join(t for t, _ in blocks(x)).encode("utf-8", "surrogatepass")) - (1 << 63) for x in sources], dtype="int64")

    return of(text)


_KEY = ("host", "path", "page_id", "seal")


def _edges(keys: DataFrame, ranges: int) -> tuple[list[Row], list[tuple[Row, int]]]:
    """(the first key of each range of pages, (key, range) of pages that a range needs to see besides its own).

    ``keys``: _KEY and ``said``, the hash of the texts. A range needs, of its first host, the last page before it whose
    texts are not its first page's, and of its last host, the first page after it whose texts are not its last page's.
    At most four rows of a range come to the driver, whatever the number of pages.
    """
    key = F.struct(*_KEY)
    dealt = keys.repartitionByRange(ranges, *_KEY).withColumn("range", F.spark_partition_id())
    texts = settle(dealt.groupBy("range", "host", "said").agg(F.min(key).alias("low"), F.max(key).alias("high")))
    first, last = Window.partitionBy("range").orderBy("low", "said"), Window.partitionBy("range").orderBy(F.desc("high"), "said")
    low = texts.withColumn("n", F.row_number().over(first)).where("n <= 2").select("range", "n", "said", F.col("low").alias("key"), F.lit(True).alias("begins"))
    high = texts.withColumn("n", F.row_number().over(last)).where("n <= 2").select("range", "n", "said", F.col("high").alias("key"), F.lit(False).alias("begins"))
    begin: dict[int, list[Row]] = {}
    end: dict[int, list[Row]] = {}
    for row in low.unionByName(high).orderBy("range", "n").collect():
        (begin if row["begins"] else end).setdefault(row["range"], []).append(row)
    order = sorted(begin)
    needs: list[tuple[Row, int]] = []
    for edges, line in ((end, order), (begin, order[::-1])):
        facing = begin if edges is end else end
        for i, own in enumerate(line):
            host, said = facing[own][0]["key"]["host"], facing[own][0]["said"]
            for j in range(i - 1, -1, -1):
                other = line[j]
                one = next((x for x in edges[other] if (x["key"]["host"], x["said"]) != (host, said)), None)
                if one and one["key"]["host"] == host:
                    needs.append((one["key"], i if edges is end else len(line) - 1 - i))
                if one:
                    break
    return [begin[r][0]["key"] for r in order], needs


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """pages -> (page_id, url, text, n_chars), a row for each row; text is empty where there is none.

    Null html is an empty page. Pages without a host are paired among themselves. Ties in path go by id and then by a
    hash of the html. Pages are dealt by ranges of that order, and each range is given the pages beyond its ends that it
    needs, so the nearest page is the same at any number of ranges; a host of any size is spread over its tasks.
    """
    spark = pages.sparkSession
    small_batches(spark)
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    own = own.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url")), "seal": F.xxhash64("html")})
    keys = settle(own.select(*_KEY, _seal(F.col("html")).alias("said")))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // RANGE_PAGES))
    begins, needs = _edges(keys, ranges)
    form = own.select(*_KEY).schema
    asked: dict[Row, list[int]] = {}
    for one, to in needs:
        asked.setdefault(one, []).append(to)
    bounds = spark.createDataFrame([(begins,)], StructType([StructField("begins", ArrayType(form))]))
    beyond = spark.createDataFrame([(*one, to) for one, to in asked.items()], StructType([*(StructField(f"_{f.name}", f.dataType) for f in form), StructField("also", ArrayType(IntegerType()))]))
    met = F.lit(True)
    for name in _KEY:
        met &= F.col(name).eqNullSafe(F.col(f"_{name}"))
    # the last range that begins at or before the page: found by halves, so a page meets few of the begins
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(len(begins).bit_length()))))
    last = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.coalesce(F.get("begins", at + step - 1) <= F.struct(*_KEY), F.lit(False)), at + step).otherwise(at))
    placed = own.crossJoin(F.broadcast(bounds)).withColumn("range", last - 1)
    placed = placed.join(F.broadcast(beyond), met, "left")
    to = F.concat(F.array("range"), F.coalesce("also", F.array().cast("array<int>")))
    dealt = placed.select(*_KEY, "url", "html", F.posexplode(to).alias("guest", "range"))
    dealt = dealt.repartition(ranges, "range").sortWithinPartitions("range", *_KEY)

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a run is of neighbours with the same texts: (path, id, url, blocks, whether a guest) of each page
        key, run, said, before, rows = None, [], None, None, []

        def done(after: tuple | None) -> None:
            known: dict[tuple[int, int], str] = {}
            for path, own_id, address, own, guest in run:
                if guest:
                    continue
                side = _nearest(path, before and before[0], after and after[0])
                if (id(own), side) not in known:
                    near = before if side < 0 else after if side > 0 else None
                    known[id(own), side] = main_text(own, near[3] if near else None)
                text = known[id(own), side]
                rows.append((own_id, address, text, len(text)))

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})

        for batch in batches:
            ids = (None if x != x else int(x) for x in batch["page_id"])
            for host, part, path, own_id, address, source, guest in zip(batch["host"], batch["range"], batch["path"], ids, batch["url"], batch["html"], batch["guest"]):
                own = blocks(source)
                texts = [t for t, _ in own]
                page = (path, own_id, address, own, guest > 0)
                if run and (key != (part, host) or texts != said):
                    done(page if key == (part, host) else None)
                    before, run = run[-1] if key == (part, host) else None, []
                elif run and own == run[0][3]:
                    page = (*page[:3], run[0][3], page[4])  # copies hold one list
                key, said = (part, host), texts
                run.append(page)
                if len(rows) >= ARROW_ROWS:
                    yield frame(rows)
                    rows.clear()
        done(None)
        if rows:
            yield frame(rows)

    return dealt.mapInPandas(differ, "page_id long, url string, text string, n_chars long")
