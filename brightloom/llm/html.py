"""Main text of web pages by nearest-URL page differencing.

A page becomes a list of block lines. Pages are ordered by host and URL path, and
each is paired with its nearest neighbour of the same host. Their lines are aligned
by longest common subsequence, and lines that both have are the site's, not the
page's: they are deleted. Two kinds of line don't wait for a neighbour: what stands
in a container that is boilerplate by its element, role or class always goes (a host
may have one page only), and what stands in an explicit article or main element
otherwise stays (two pages may quote the same passage). A form, class, id or role never
marks an article or main element, what holds one, or what holds most of the text.

Only 64-bit hashes of lines are compared, and equal pages of a host count once, so a
copy under another address is no neighbour.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, named, parts, read_table, row_of, ship, with_fields

#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template head title svg canvas iframe object select option textarea button datalist".split())
#: Elements that are boilerplate as a whole.
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
ARTICLE = frozenset({"article", "main"})
#: Elements that don't end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br "
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr mstyle mpadded mphantom merror mfenced menclose maction".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark a container as boilerplate.
MARKED = re.compile(
    r"nav(?:bar|igation)?|menus?|breadcrumbs?|footer|masthead|banner|side-?bar|aside|complementary|contentinfo|ads?|adsbygoogle|advert(?:s|isements?|ising)?|sponsor(?:ed|s)?|promo(?:s|tion)?|cookies?|consent|gdpr|notices?|notifications?|alert|toast|pop-?up|modal|subscribe|newsletter|sign-?up|login|share|sharing|social|related|recommend(?:ed|ations)?|pagination|pager|comments?|commentlist|respond|replies|disqus|search(?:box|form)?|toolbar|skip-?link|legal|copyright|disclaimer"
)
#: Words after a marking word that leave it the head of its name, as in ad-top.
NEUTRAL = frozenset("area bar block bottom box button buttons center column container content form group header holder icons inner items left links list main outer panel post posts primary reading right secondary section stories top widget widgets wrap wrapper".split())
#: Words of names that tell a state: with-sidebar is no sidebar.
STATES = frozenset("with without has have no not is are open opened closed enabled disabled allowed hide hidden layout".split())
#: Marking words that a paragraph of the text may well have by themselves.
WEAK = frozenset("legal social notice notices alert related".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figure figcaption".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "title", "textarea", "iframe", "annotation", "annotation-xml")}
_HEADER_OF_PAGE = frozenset({"header"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph as they start.
ENDS_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p pre search section summary table ul".split())
#: Elements that what is implied never reaches through.
BARRIERS = frozenset("table td th caption template object button".split())
#: What a part of a table ends: all that is open within these.
TABLE_PARTS = {name: frozenset(around.split()) for names, around in (("td th", "tr tbody thead tfoot table"), ("tr", "tbody thead tfoot table"), ("tbody thead tfoot caption colgroup", "table")) for name in names.split()}
#: Elements that don't end an open head.
OF_HEAD = frozenset("base basefont bgsound link meta noframes script style template title noscript head".split())


def _names_boilerplate(name: str, token: str) -> bool:
    """Whether one class or id says that its element is boilerplate: its head is a marking word."""
    words = [w for w in re.split("[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower().replace("side-bar", "sidebar").replace("pop-up", "popup").replace("sign-up", "signup").replace("skip-link", "skiplink")) if w]
    if not STATES.isdisjoint(words):
        return False
    while len(words) > 1 and words[-1] in NEUTRAL:
        words.pop()
    return bool(words) and MARKED.fullmatch(words[-1]) is not None and not (words[-1] in WEAK and len(words) == 1 and name in RUNNING)


def _marked(name: str, attributes: str) -> str:
    """``hard`` where an element is hidden, ``mark`` where it is a form or a class, id or role says that it is boilerplate, else empty."""
    mark = "mark" if name == "form" else ""
    for attribute, value in _ATTRIBUTE.findall(attributes):
        attribute, value = attribute.lower(), value.strip("\"'")
        if attribute == "hidden" or (attribute == "aria-hidden" and value.lower() == "true"):
            return "hard"
        if attribute == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "hard"
        elif any(_names_boilerplate(name, t) for t in value.split()):
            mark = "mark"
    return "" if name in ARTICLE else mark


def _places(scopes: list[tuple[int, str]], sizes: list[int]) -> list[str]:
    """Where the lines of each scope stand. ``scopes``: the scope around it and its kind; ``sizes``: its own characters.

    A form, class, id or role doesn't mark what holds an article or main element, other
    than one within another article (a comment), nor what holds more than half of the
    text: of the article that it stands in, or of a page that has none.
    """
    hard, within, outermost = [False], [False], [0]
    for i, (parent, kind) in enumerate(scopes[1:], 1):
        hard.append(hard[parent] or kind == "hard")
        within.append(within[parent] or kind == "article")
        outermost.append(outermost[parent] or (i if kind in ("article", "main") and not hard[i] else 0))
    sizes = [0 if h else n for n, h in zip(sizes, hard, strict=True)]
    for i in range(len(scopes) - 1, 0, -1):
        sizes[scopes[i][0]] += sizes[i]
    bare = not any(outermost)
    void = [(outermost[i] > 0 or bare) and 2 * sizes[i] > sizes[outermost[i]] for i in range(len(scopes))]
    for parent, kind in (x for x, h in zip(scopes, hard, strict=True) if x[1] in ("article", "main") and not h):
        while parent and not within[parent]:
            void[parent] = True
            parent = scopes[parent][0]
    places = [""]
    for i, (parent, kind) in enumerate(scopes[1:], 1):
        outer = places[parent]
        if outer == "boilerplate" or kind == "hard" or (kind == "mark" and not void[i]) or (kind == "header" and outer != "article"):
            places.append("boilerplate")
        else:
            places.append("article" if kind in ("article", "main") else outer)
    return places


def lines(page: str) -> list[tuple[str, str]]:
    """The page's blocks in order, each with where it stands: ``article``, ``boilerplate`` or empty.

    White space within a block is one space; empty blocks are left out.
    """
    # Pieces of blocks: text, scope, and whether it goes on with the block of the piece before.
    pieces: list[tuple[str, int, bool]] = []
    parts_: list[str] = []
    # Open blocks, and inline elements that matter: name and the scope that holds outside them.
    stack: list[tuple[str, int]] = []
    scopes: list[tuple[int, str]] = [(0, "")]
    scope, goes_on = 0, False
    depth: dict[str, int] = {}

    def flush(ends: bool = True) -> None:
        nonlocal goes_on
        if parts_:
            pieces.append(("".join(parts_), scope, goes_on))
            parts_.clear()
            goes_on = True
        if ends:
            goes_on = False

    def pop(n: int) -> None:
        """Only the outermost n open elements stay open."""
        nonlocal scope
        while len(stack) > n:
            name, scope = stack.pop()
            depth[name] -= 1

    def last(names: frozenset[str], barriers: frozenset[str]) -> int:
        """The place of the innermost open element of these names, -1 if a barrier stands before it."""
        if any(depth.get(name) for name in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names:
                    return i
                if stack[i][0] in barriers:
                    break
        return -1

    def imply_ends(name: str) -> None:
        """Close what HTML closes where this element starts."""
        if name in TABLE_PARTS and (i := last(TABLE_PARTS[name], frozenset())) >= 0:
            pop(i + 1)
        if name == "li" and (i := last(frozenset({"li"}), BARRIERS | {"ul", "ol", "menu"})) >= 0:
            pop(i)
        elif name in ("dt", "dd") and (i := last(frozenset({"dt", "dd"}), BARRIERS | {"dl"})) >= 0:
            pop(i)
        elif name in ("option", "optgroup") and stack and stack[-1][0] == "option":
            pop(len(stack) - 1)
        if name in ENDS_P and (i := last(frozenset({"p"}), BARRIERS)) >= 0:
            pop(i)
        if name in HEADINGS and stack and stack[-1][0] in HEADINGS:
            pop(len(stack) - 1)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if depth.get("head") and (text.strip() or m and m[1] and m[0][1] != "/" and m[1].lower() not in OF_HEAD):
            flush()
            pop(last(frozenset({"head"}), frozenset()))
        if text:
            parts_.append(text)
        if m is None:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            parts_.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1] is None:
            continue
        name, opening = m[1].lower(), m[0][1] != "/"
        block = name not in INLINE
        if name.startswith("annotation"):  # a formula's source, which is not shown
            close = _RAW_END[name].search(page, at) if opening and name in _RAW_END else None
            at = close.end() if close else at
            continue
        if block:
            flush()
        if opening:
            imply_ends(name)
            if name in _RAW_END:
                close = _RAW_END[name].search(page, at)
                at = close.end() if close else end
                continue
            if name == "br":
                parts_.append(" ")
            if name in VOID or m[0].endswith("/>"):
                continue
            kind = _marked(name, m[2]) if (m[2] or name == "form") and name not in ("html", "body") else ""
            if name in SKIPPED or name in BOILERPLATE:
                kind = "hard"
            elif not kind:
                kind = name if name in ARTICLE or name in _HEADER_OF_PAGE else ""
            if kind and not block:
                flush(False)
            if name not in ("html", "body") and (block or kind or depth.get(name)):
                stack.append((name, scope))
                depth[name] = depth.get(name, 0) + 1
            if kind:
                scopes.append((scope, kind))
                scope = len(scopes) - 1
        elif name == "br":
            parts_.append(" ")
        elif block:
            i = last(HEADINGS if name in HEADINGS else frozenset({name}), BARRIERS - {name} if name not in TABLE_PARTS and name not in BARRIERS else frozenset({"table"}) - {name})
            if i >= 0:
                pop(i)
        elif depth.get(name):
            i = len(stack) - 1
            while stack[i][0] != name and stack[i][0] in INLINE:
                i -= 1
            if i >= 0 and stack[i][0] == name:
                if stack[i][1] != scope:
                    flush(False)
                pop(i)
    flush()
    sizes = [0] * len(scopes)
    for raw, s, _ in pieces:
        sizes[s] += len("".join(html.unescape(raw).split()))
    places = _places(scopes, sizes)
    blocks: list[tuple[list[str], str]] = []
    for raw, s, on in pieces:
        if on and blocks and blocks[-1][1] == places[s]:
            blocks[-1][0].append(raw)
        else:
            blocks.append(([raw], places[s]))
    texts = ((" ".join(html.unescape("".join(raw)).split()), place) for raw, place in blocks)
    return [(text, place) for text, place in texts if text]


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Bit-parallel: a row of the table is one integer, whose bits are ``b``'s places.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    found = {*range(start), *range(len(a) - stop, len(a))}
    x, y = a[start : len(a) - stop], b[start : len(b) - stop]
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    keep = [i for i, v in enumerate(x) if v in where]
    full = (1 << len(y)) - 1
    rows, row = [], full
    for i in keep:
        hit = row & where[x[i]]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    j = len(y)
    for k in range(len(keep) - 1, -1, -1):
        above = rows[k - 1] if k else full
        count = lambda r: j - (r & ((1 << j) - 1)).bit_count()  # noqa: B023, E731
        if count(rows[k]) > count(above):
            found.add(start + keep[k])
            # the place in y that this step matched: the last one below j with a clear bit
            clear = ~rows[k] & ((1 << j) - 1)
            top = clear.bit_length() - 1
            while not where[x[keep[k]]] >> top & 1:
                clear &= (1 << top) - 1
                top = clear.bit_length() - 1
            j = top
    return found


def address(url: str | None) -> tuple[str, str]:
    """Host and path: no scheme, user, port, query, fragment, index page or last slash."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].rpartition("@")[2].partition(":")[0].lower(), m[2]) if m else ("", re.split("[?#]", url or "")[0])
    path = re.sub(r"(?:/index)?(?:\.(?:html?|php|aspx?|jsp))?/*$", "", path, flags=re.I)
    return host, path


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, path and line hashes of each page, and a digest of the hashes."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for url, page in zip(batch.column("url"), batch.column("html"), strict=True):
            host, path = address(url.as_py())
            hashes = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in lines(page.as_py() or "")]
            if hashes:
                for column, v in zip(out, (host, path, hashes, _digest(hashes)), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.int64())], ["host", "path", "hashes", "digest"])


def _digest(hashes: list[int]) -> int:
    return xxhash.xxh3_64_intdigest(b"".join(h.to_bytes(8, "little", signed=True) for h in hashes)) - (1 << 63)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of a partition, with its number; one row may be both."""
    from pyspark import TaskContext

    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
    for row, is_last in ((first, False), (last, True)):
        if row is not None:
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([is_last])], [*row.schema.names, "part", "last"])


def nearness(a: str, b: str) -> int:
    """Characters that two paths share from the start."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _judged(row: tuple, other: tuple, before: bool) -> tuple:
    """host, digest, how near the other page is, whether it comes before, places of shared lines."""
    host, path, digest, hashes = row
    return host, digest, nearness(other[1], path), before, sorted(common_lines(hashes, other[3]))


_JUDGED = {"host": pa.string(), "digest": pa.int64(), "near": pa.int32(), "before": pa.bool_(), "shared": pa.list_(pa.int32())}
_JUDGED_DDL = "host string, digest bigint, near int, before boolean, shared array<int>"


def _judgements(found: list[tuple]) -> list[pa.Array]:
    return [pa.array([x[i] for x in found], k) for i, k in enumerate(_JUDGED.values())]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hold each page against the nearer of its two neighbours; at either end of a partition against the one there is."""
    rows: list[tuple | None] = [None]

    def decided(prev: tuple | None, row: tuple, following: tuple | None) -> list[tuple]:
        near = [x for x in (prev, following) if x and x[0] == row[0]]
        other = max(near, key=lambda x: nearness(x[1], row[1]), default=None)
        return [_judged(row, other, other is prev)] if other else []

    for batch in batches:
        rows += list(zip(*(batch.column(c).to_pylist() for c in ("host", "path", "digest", "hashes")), strict=True))
        yield pa.RecordBatch.from_arrays(_judgements([x for i in range(1, len(rows) - 1) for x in decided(*rows[i - 1 : i + 2])]), list(_JUDGED))
        rows = rows[-2:]
    if len(rows) == 2:
        yield pa.RecordBatch.from_arrays(_judgements(decided(rows[0], rows[1], None)), list(_JUDGED))


def _meet(table: pa.Table) -> pa.Table:
    """What the last page of a partition and the first of the next one say of each other."""
    rows = {last: row for last, *row in zip(*(table[c].to_pylist() for c in ("last", "host", "path", "digest", "hashes")), strict=True)}
    found = [_judged(rows[True], rows[False], False), _judged(rows[False], rows[True], True)] if len(rows) == 2 and rows[True][0] == rows[False][0] else []
    return pa.table(_judgements(found), names=list(_JUDGED))


def shared_lines(pages: DataFrame) -> DataFrame:
    """host, digest, shared: places of the lines that a page and its nearest neighbour have.

    Pages are sorted over all partitions, so one host may fill many of them. Where two
    partitions meet, the two pages there meet in a task of their own; of the partitions
    only numbers reach the driver.
    """
    spark = pages.sparkSession
    hashed = pages.select("url", "html").mapInArrow(_hashed, "host string, path string, hashes array<bigint>, digest bigint")
    one = hashed.groupBy("host", "digest").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"))
    one = cut(one.select("host", "path", "digest", "hashes"))
    ordered = cut(one.repartitionByRange(parts(spark, one.count(), 50_000), "host", "path", "digest").sortWithinPartitions("host", "path", "digest"))
    ends = cut(ordered.mapInArrow(_edges, "host string, path string, digest bigint, hashes array<bigint>, part int, last boolean"))
    filled = sorted(r["part"] for r in ends.filter("last").select("part").collect())
    order = spark.createDataFrame(list(enumerate(filled)), "place int, part int")
    borders = ends.join(order, "part").withColumn("border", F.col("place") - F.when(F.col("last"), 0).otherwise(1))
    met = borders.select("border", "last", "host", "path", "digest", "hashes").groupBy("border").applyInArrow(_meet, _JUDGED_DDL)
    judged = ordered.mapInArrow(_compare, _JUDGED_DDL).unionAll(met)
    nearest = judged.groupBy("host", "digest").agg(F.max_by("shared", F.struct("near", "before")).alias("shared"))
    return nearest.filter(F.size("shared") > 0)


def main_text(pages: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the ``carry`` columns of ``pages``, all by default), text, how many lines
    the nearest page took that would stay without it (n_shared), and how many the markup
    took, whether the nearest page has them or not (n_marked).

    Null html is an empty page, with an empty text. A null url has no host, like any
    other relative address. Repeated rows and pages of equal lines on one host get
    equal texts. Other columns may have any names: they travel inside ``row``.
    """
    ship(pages.sparkSession)
    source = pages.select(row_of(pages.columns if carry is None else carry), "url", "html")
    shared = shared_lines(source)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for url, page in zip(batch.column("url"), batch.column("html"), strict=True):
                found = lines(page.as_py() or "")
                hashes = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in found]
                for column, v in zip(out, (address(url.as_py())[0], _digest(hashes), ["" if p == "boilerplate" else t for t, p in found], ["?ab"[("", "article", "boilerplate").index(p)] for _, p in found]), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string())), pa.array(["".join(x) for x in out[3]], pa.string())], ["row", "host", "digest", "lines", "places"])

    parsed = source.mapInArrow(keys, with_fields(source, ["row"], "host string, digest bigint, lines array<string>, places string"))
    joined = parsed.join(shared, ["host", "digest"], "left")
    place = lambda i: F.substring(F.col("places"), i + 1, F.lit(1))
    kept = F.filter("lines", lambda _, i: (place(i) == "a") | ((place(i) == "?") & ~F.coalesce(F.array_contains("shared", i), F.lit(False))))
    taken = F.filter(F.coalesce("shared", F.array().cast("array<int>")), lambda i: place(i) == "?")
    marked = F.length("places") - F.length(F.replace("places", F.lit("b"), F.lit("")))
    return joined.select("row", F.array_join(kept, "\n").alias("text"), F.size(taken).alias("n_shared"), marked.alias("n_marked"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(read_table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
