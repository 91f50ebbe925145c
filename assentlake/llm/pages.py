"""Main text of web pages: what a page shares with its neighbour is not its own.

Pages of a host are ordered by URL path; each is compared with the neighbour whose path agrees
with its own for longer. The text lines of both are aligned by a longest common subsequence,
and lines in common are taken for boilerplate, but for those inside an article or main element,
which are the page's own by their place. Differencing cannot see boilerplate that varies from
page to page, so what the markup names is left out first: navigation, headers, footers, sidebars,
forms, adverts, notices and comments. Elements that hold the article itself are never left out,
whatever their name or class says; without an article, those that hold most of the text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from assentlake.llm.common import slices
from assentlake.session import staged

# A quoted value may hold any character; a quote that never ends takes the rest, as in browsers.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z](?:[^>=]|=(?:\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)))?+)*+(?:>|\Z)", re.S
)
NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"(?:\b|_)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Elements of HTML by what they do to text.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "math", "object"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "address"}
CONTENT = {"article", "main"}
# Elements whose end tag may be missing: what they close when they begin.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "pre", "section", "table", "ul"}
#: Words in a class, id or role that tell boilerplate.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notices|popup|modal|"
    r"newsletter|subscribe|signup|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side|widget|toolbar|"
    r"header|masthead|footer|foot|copyright|social|share|sharing|related|recommend\w*|comments?|comment-\w+|respond|replies|"
    r"disqus|login|search|complementary|contentinfo|skip|hidden)(?=$|[\s_-])",
    re.I,
)
#: Words in a class, id or role that tell other content than the article, even on an article element.
OTHERS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|related|recommend\w*|comments?|comment-\w+|respond|replies|disqus)(?=$|[\s_-])",
    re.I,
)
# What an element says about the text below it.
PLAIN, WRAPPED, NAMED, OTHER, ARTICLE = 0, 1, 2, 3, 4
OUT, OPEN, IN = 0, 1, 2


def _says(name: str, tag: str) -> int:
    """What a start tag says about the text of its element."""
    marks = " ".join(a or b or c for key, a, b, c in MARK.findall(tag) if key.lower() != "aria-label") if "=" in tag else ""
    if marks and OTHERS.search(marks):
        return OTHER
    if name in CONTENT:
        return ARTICLE
    if name in CHROME:
        # A form or header may hold the article; the others never do.
        return WRAPPED if name in ("form", "header") else OTHER
    return NAMED if marks and name not in ("html", "body") and NOISE.search(marks) else PLAIN


def _parse(html: str) -> tuple[list[tuple[int, str]], list[tuple[int, str, int]]]:
    """Blocks as (element, text) and elements as (parent, name, what it says), in page order."""
    found: list[tuple[int, str]] = []
    elements: list[tuple[int, str, int]] = [(-1, "", PLAIN)]
    stack, parts = [0], []
    depth: dict[str, int] = {}
    never: set[str] = set()
    at = 0

    def end_block() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                found.append((stack[-1], text))
            parts.clear()

    def pop() -> str:
        name = elements[stack.pop()][1]
        depth[name] -= 1
        return name

    while (m := TOKEN.search(html, at)) is not None:
        parts.append(html[at : m.start()])
        tag, at = m[0], m.end()
        n = NAME.match(tag)
        if n is None:
            continue
        name = n[1].lower()
        if name == "br":
            parts.append(" ")
        elif name in INLINE:
            continue
        elif tag[1] == "/":
            end_block()
            if depth.get(name):
                while pop() != name:
                    pass
        elif name in RAW:
            # Nothing inside counts but its own end tag, whatever it looks like.
            end_block()
            if tag.endswith("/>") or name in never:
                continue
            if (close := re.compile(rf"</\s*{name}\b[^>]*+(?:>|\Z)", re.I).search(html, at)) is not None:
                at = close.end()
            elif name in ("script", "style"):
                at = len(html)
            else:
                never.add(name)
        else:
            end_block()
            closing = CLOSES.get(name) or ({"p"} if name in ENDS_P else ())
            while len(stack) > 1 and elements[stack[-1]][1] in closing:
                pop()
            if name not in VOID and not tag.endswith("/>"):
                elements.append((stack[-1], name, _says(name, tag)))
                stack.append(len(elements) - 1)
                depth[name] = depth.get(name, 0) + 1
    parts.append(html[at:])
    end_block()
    return found, elements


def _spine(found, elements) -> set[int]:
    """The element that holds the main text, and all around it."""
    other = [False] * len(elements)
    for i, (parent, _, says) in enumerate(elements):
        other[i] = says == OTHER or (parent >= 0 and other[parent])
    sizes = [0] * len(elements)
    for i, text in found:
        if not other[i]:
            sizes[i] += len(text)
    for i in range(len(elements) - 1, 0, -1):
        sizes[elements[i][0]] += sizes[i]
    articles = [i for i, e in enumerate(elements) if e[2] == ARTICLE and sizes[i]]
    if articles:
        at = max(articles, key=lambda i: (sizes[i], -i))
    else:
        # The innermost element with more than half of the text; those that have it lie in each other.
        at = max(i for i in range(len(elements)) if i == 0 or 2 * sizes[i] > sizes[0])
    out = set()
    while at >= 0:
        out.add(at)
        at = elements[at][0]
    return out


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the text blocks of a page, in order; kind is OUT, OPEN or IN."""
    found, elements = _parse(html or "")
    spine = _spine(found, elements)
    kinds = [OPEN]
    for i, (parent, name, says) in enumerate(elements[1:], 1):
        kind = kinds[parent]
        if kind != OUT:
            if says == ARTICLE:
                kind = IN
            elif i not in spine and says != PLAIN and not (name == "header" and kind == IN):
                kind = OUT
        kinds.append(kind)
    return [(kinds[i], text) for i, text in found]


def own_lines(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The lines that the markup does not rule out."""
    return [(k, t) for k, t in found if k != OUT]


def _steps(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of ``b``: a zero bit where the common length with ``a`` grows by one.

    Rows of the usual table are single large integers, a bit for each place of ``a``.
    """
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        own = row & masks.get(y, 0)
        row = ((row + own) | (row - own)) & full
        yield row


#: Numbers, of lines left out and of keys, that are sent to all pages; more meet them in a shuffled join.
SENT_PLACES = 1 << 20
#: Bits of a table that is kept as a whole; larger ones are cut in halves.
TABLE_BITS = 1 << 26


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in bounded memory."""
    common = set(a).intersection(b)
    places = [i for i, x in enumerate(a) if x in common]
    out: list[int] = []
    _align([a[i] for i in places], [y for y in b if y in common], 0, out)
    return [places[i] for i in out]


def _align(a: list[int], b: list[int], base: int, out: list[int]) -> None:
    """Append the places of ``a``, counted from ``base``, that are aligned with ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out.extend(range(base, base + head))
    inner_a, inner_b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(inner_a) and len(inner_b):
        if len(inner_b) > 1 and len(inner_a) * len(inner_b) > TABLE_BITS:
            _halves(inner_a, inner_b, base + head, out)
        else:
            _traced(inner_a, inner_b, base + head, out)
    out.extend(range(base + len(a) - tail, base + len(a)))


def _halves(a, b, base: int, out: list[int]) -> None:
    """Cut ``b`` in the middle and ``a`` where both parts together align most (Hirschberg, 1975)."""
    middle = len(b) // 2
    last = [0, 0]
    for side, rows in enumerate((_steps(a, b[:middle]), _steps(a[::-1], b[middle:][::-1]))):
        for row in rows:
            last[side] = row
    before, after = ([c == "0" for c in format(row, f"0{len(a)}b")[::-1]] for row in last)
    value = best = sum(after)
    cut = 0
    for i in range(len(a)):
        value += before[i] - after[len(a) - 1 - i]
        if value > best:
            best, cut = value, i + 1
    _align(a[:cut], b[:middle], base, out)
    _align(a[cut:], b[middle:], base + cut, out)


def _traced(a, b, base: int, out: list[int]) -> None:
    """Steps are followed back from the last row."""
    rows = list(_steps(a, b))
    found, j = [], len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        while j > 0 and not rows[j] >> i & 1 and not rows[j - 1] >> i & 1:
            j -= 1
        if j >= 0 and not rows[j] >> i & 1:
            found.append(base + i)
            j -= 1
    out.extend(reversed(found))


def _lines(pages: DataFrame) -> DataFrame:
    """(key, lines, open) of each page: hashes of its lines, and the places outside an article."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        for part in slices(batches):
            lines, free = [], []
            for page in part.column(1).to_pylist():
                found = own_lines(blocks(page))
                free.append([i for i, (k, _) in enumerate(found) if k == OPEN])
                lines.append([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for _, t in found])
            yield pa.record_batch(
                [part.column(0), pa.array(lines, pa.list_(pa.int64())), pa.array(free, pa.list_(pa.int32()))], names=["key", "lines", "open"]
            )

    return pages.select("key", "html").mapInArrow(run, "key binary, lines array<long>, open array<int>")


def _address(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; query and fragment are no part of the place of a page."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][\w+.-]*://)?[^/?#]*([^?#]*)", 1)
    return host, path


def _neighbours(pages: DataFrame) -> DataFrame:
    """(key, other) of pages with a neighbour on their host.

    The whole table is sorted by ranges of host and path; a page finds the pages before and
    after it by number, so that a large host is no task of its own.
    """
    host, path = _address(F.col("url"))
    order = [F.col("host"), F.col("path"), F.col("key")]
    placed = staged(
        pages.select("key", host.alias("host"), path.alias("path"))
        .where("host != ''")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "*",
            F.spark_partition_id().alias("range"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        ),
        "paths",
    )
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range of the sort.
    starts = sizes.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = staged(
        placed.join(F.broadcast(starts), "range").select((F.col("before") + F.col("place")).alias("rank"), "host", "path", "key"),
        "ranked",
    )
    sides = None
    for step in (-1, 1):
        other = ranked.select((F.col("rank") + step).alias("rank"), F.col("host").alias("h"), F.col("path").alias("p"), F.col("key").alias("other"))
        side = ranked.join(other, "rank").where("host = h and key != other").select("key", "path", "p", "other")
        sides = side if sides is None else sides.unionByName(side)
    # The number of leading characters in which both paths agree.
    agree = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1))),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.substr(F.col("path"), i, F.lit(1)) == F.substr(F.col("p"), i, F.lit(1))) & (i <= F.length("p")), i).otherwise(n),
    )
    best = F.max_by("other", F.struct(agree, "other"))
    return sides.groupBy("key").agg(best.alias("other"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of ``pages``; no text gives an empty string.

    A null or empty html gives an empty text. Character references are decoded, white space
    inside a block becomes one space, and blocks stand on lines of their own. A page without
    a host, or alone on it, is not compared with another. Text beside an article stays if the
    markup does not name it and the neighbour does not share it. Rows that repeat have equal results.
    Other columns are not looked at.
    """
    digest = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256)
    # 128 bits tell pages apart at any size, and keys travel often.
    key = F.unhex(F.substring(digest, 1, 32))
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("key", key)
    lines = staged(_lines(keyed).dropDuplicates(["key"]), "lines")
    pairs = _neighbours(keyed.select("key", "url").dropDuplicates(["key"]))
    aligned = (
        pairs.join(lines, "key")
        .join(lines.select(F.col("key").alias("other"), F.col("lines").alias("other_lines")), "other")
        .select("key", "lines", "other_lines", "open")
    )

    def align(batches) -> Iterator:
        import pyarrow as pa

        for part in slices(batches):
            places = [sorted(set(shared(a, b)).intersection(free)) for a, b, free in zip(*(part.column(c).to_pylist() for c in (1, 2, 3)))]
            yield pa.record_batch([part.column(0), pa.array(places, pa.list_(pa.int32()))], names=["key", "drop"])

    dropped = staged(aligned.mapInArrow(align, "key binary, drop array<int>").where(F.size("drop") > 0), "dropped")
    # Where neighbours share little, its real size lets the pages stay where they were read.
    n, places = dropped.agg(F.count("*"), F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()
    few = 4 * n + places <= SENT_PLACES

    def run(batches) -> Iterator:
        import pyarrow as pa

        for part in slices(batches):
            texts = []
            for page, drop in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                gone = set(drop or ())
                texts.append("\n".join(t for i, (_, t) in enumerate(own_lines(blocks(page))) if i not in gone))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return (
        keyed.join(F.broadcast(dropped) if few else dropped, "key", "left")
        .select("page_id", "url", "html", "drop")
        .mapInArrow(run, "page_id long, url string, text string")
    )
