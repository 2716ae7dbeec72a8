"""HTML main-text extraction by union-free wrapper inference.

A page is a stream of start tags, end tags and text runs. Its own repetitions fold first: neighbouring equal items, or
equal groups of up to four, become one repeated item. Two streams are then aligned level by level: items that match
are merged, items without a partner become optional, text runs that differ become slots. The result is a union-free
regular expression (sequence, optional and repeated groups, text slots) that fits both, and folding page after page
of a host into it gives the host's wrapper with the text and link characters that each slot has held. Slots of the
main region (the article, or else the region that holds most of the text that is not in links) that are not template
text are content; a page's text is what it has in those slots.

Wrappers merge in any grouping, so tasks fold their own pages first, then some hundreds of partial wrappers of a host
meet in salted groups, then the few of those in one; what moves is as large as the page structure, not as the pages.
Every wrapper stream is folded as it is read. Wrappers join back by host; the optimizer broadcasts them if small,
and otherwise splits the pages of a hot host.

Defined results: null or empty html gives an empty text; pages without a URL or host share the wrapper of the empty
host; repeated pages give equal texts; a page that has nothing in its host's content slots is labelled by its own wrapper, and so is
what the host's wrapper has no place for; elements nested over ``DEPTH`` deep are read as part of their ancestor; html of
any length is read whole; of main regions with equal weight the first counts; an empty table gives none; only the named
columns are read, whatever others are called.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm.common import arrow_schema, saved, table
from gavel.llm.urls import site_parts

DEPTH = 100
GROUP = 4
#: Items of one level that are aligned by dynamic programming; longer levels are aligned by unique signatures in order.
ALIGNED = 200
#: Items a wrapper level keeps in order; a longer level has one item for each signature, in any order.
LEVEL_ITEMS = 256
#: Hosts a task folds at once, and salted groups of partial wrappers of a host.
HOSTS_AT_ONCE, SALTS = 2000, 32
#: Pages of different main text from which a text that never changes counts as the template's, where a host has no article.
TEMPLATE_PAGES = 10

# A tag whose quotes don't close ends at the next ">".
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
                    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title template noscript iframe svg object annotation annotation-xml".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span "
              "strike strong sub sup time tt u var img wbr br ruby rt rp math semantics mrow mi mn mo mtext mspace mfrac msup msub msubsup "
              "msqrt mroot mstyle munder mover munderover mmultiscripts mtable mtr mtd mfenced mpadded".split())
_SKIPPED = set("nav header footer aside form button select option menu dialog head audio video canvas map fieldset".split()) | _RAW
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_HINTS = set("ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
             "gdpr notice popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb "
             "breadcrumbs footer header masthead comment comments disqus respond replies share sharing social related "
             "recommended widget widgets pagination pager login search toolbar skip".split())
#: Words that a class or id may hold beside such a hint and still name what the hint says; "has-sidebar",
#: "comments-open" or "related-work" say something else.
_NEUTRAL = set("site page global main top bottom left right upper lower box bar block wrapper wrap container section area list item items "
               "link links button buttons form inner outer slot unit zone panel column col row group posts articles stories news body "
               "primary secondary wp js the our your my form field icon icons text title message banner policy container".split())
_COMMENT = {"comment", "comments", "disqus", "respond", "replies"}
#: Elements that no class or id makes less than text (an article may still be a reader's comment).
_TEXT_TAGS = set("h1 h2 h3 h4 h5 h6 main article body html".split())
#: What an open element of the first name is closed by.
_CLOSED_BY = {
    "p": set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"},
}
_HEADINGS = {"h1", "h2", "h3"}
#: Elements that hold a piece of a text, not a region of a page.
_BLOCKS = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address details summary".split())
_MAIN = (("article",), ("main",))

# An item of a wrapper: [signature, optional, repeated, children or None for text, statistics]. Statistics of text:
# [times, characters, characters in links, hash of the only text so far or 0, numbers of the page's runs, hash of all
# texts]; in a wrapper the last is the least TEMPLATE_PAGES different hashes of the main text of the slot's pages;
# of elements: times. A signature that starts with "!" is no main text and keeps no children.
TEXT = "#"


def _named(tag: str, names: str) -> bool:
    """Whether a class or id says that an element is no main text: a name of hints and neutral words alone."""
    hints = _COMMENT if tag == "article" else set() if tag in _TEXT_TAGS else _HINTS
    for name in names.lower().split():
        parts = set(re.findall("[a-z]+", name))
        if parts & hints and parts <= _HINTS | _NEUTRAL:
            return True
    return False


def signature(tag: str, attributes: str, trusted: frozenset = frozenset()) -> str:
    """The name of an element in wrappers. One that starts with "!" is no main text, with "!~" by its class or id alone, unless
    it is among the ``trusted`` names."""
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    hidden = "hidden" in attributes.lower().split() or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    skip = tag in _SKIPPED or hidden or found.get("role", "").lower() in _ROLES
    names = ".".join(sorted(re.sub("[0-9]+", "#", x) for x in set(found.get("class", "").lower().split())))
    main = "@main" if found.get("role") == "main" or found.get("itemprop") == "articleBody" else ""
    name = f"{tag}{main}.{names}"
    if tag in ("body", "html"):
        return name
    if skip:
        return "!" + name
    by_name = not main and _named(tag, f"{found.get('class', '')} {found.get('id', '')}") and name not in trusted
    return "!~" + name if by_name else name


def parse(html: str) -> tuple[list, list[str]]:
    """A page's items, unfolded, and its text runs with white space as it came. An element that holds more text than all
    that is left without it is no menu or notice, whatever its class or id says."""
    trusted: frozenset = frozenset()
    while True:
        items, texts, lost = _parsed(html, trusted)
        name, most = max(lost.items(), key=lambda x: (x[1], x[0]), default=("", 0))
        if most <= sum(len(t.strip()) for t in texts):
            return items, texts
        trusted |= {name}


def _parsed(html: str, trusted: frozenset) -> tuple[list, list[str], Counter]:
    """Items, text runs, and the characters that elements lost by their class or id."""
    root: list = []
    stack = [("", root, False)]  # tag, children (over DEPTH those of the ancestor), inside something that is no main text
    lost: Counter = Counter()
    opened: Counter = Counter()  # tags on the stack
    texts: list[str] = []
    run: list[tuple[str, bool]] = []
    links = 0

    def flush():
        if run:
            if not stack[-1][2]:
                whole = "".join(x for x, _ in run)
                size = len(whole.split()) and len(whole.strip())
                if size:
                    texts.append(whole)
                    linked = sum(len(x) for x, inside in run if inside)
                    only = zlib.crc32(" ".join(whole.split()).encode("utf-8", "replace")) | 1 << 32
                    stack[-1][1].append([TEXT, False, False, None, [1, size, min(linked, size), only, [len(texts) - 1], only]])
            run.clear()

    def text(s):
        if not s:
            return
        if not stack[-1][2]:
            run.append((entities.unescape(s), links > 0))
        elif stack[-1][2][:1] == "~":
            lost[stack[-1][2][1:]] += len(s.strip())
    at = 0
    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at: m.start()])
        at = m.end()
        ends, tag, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "br":
                text(" ")
            elif tag == "a":
                links = max(0, links - 1) if ends else links + 1
            continue
        flush()
        if ends:
            if opened[tag]:
                links = 0
                while (name := stack.pop()[0]) != tag:
                    opened[name] -= 1
                opened[tag] -= 1
            continue
        if tag in _RAW:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = close.end() if close else len(html)
            continue
        while tag in _CLOSED_BY.get(stack[-1][0], ()):
            opened[stack.pop()[0]] -= 1
            links = 0
        if tag in _VOID:
            continue
        sign = signature(tag, attributes, trusted)
        # Why the element is no main text: "~" and the name that says so, or another reason.
        within = stack[-1][2]
        skip = "!" if sign[0] == "!" and sign[1] != "~" or within == "!" else within or (sign[1:] if sign[0] == "!" else False)
        children: list = stack[-1][1] if len(stack) > DEPTH else []
        if not stack[-1][2] and len(stack) <= DEPTH:
            stack[-1][1].append([sign, False, False, children, 1])
        stack.append((tag, children, skip))
        opened[tag] += 1
    flush()
    return root, texts, lost


def merged(a: list, b: list) -> list:
    """The item that fits what either of two items with one signature fits (the first is changed)."""
    a[1], a[2] = a[1] or b[1], a[2] or b[2]
    if a[3] is None:
        s, t = a[4], b[4]
        s[0] += t[0]
        s[1] += t[1]
        s[2] += t[2]
        s[3] = s[3] if s[3] == t[3] else 0
        s[4] += t[4]
        s[5] = sorted({*s[5], *t[5]})[:TEMPLATE_PAGES] if isinstance(s[5], list) else (31 * s[5] + t[5]) % (1 << 61)
    else:
        a[3] = merge(a[3], b[3])
        a[4] += b[4]
    return a


def fold(items: list, widest: int = GROUP) -> list:
    """Neighbouring repetitions become repeated items or groups, inside out."""
    for x in items:
        if x[3]:
            x[3] = fold(x[3], widest)
    for k in range(1, widest + 1):
        if len(items) < 2 * k:
            break
        out, i = [], 0
        while i < len(items):
            group, signs, j = items[i: i + k], [x[0] for x in items[i: i + k]], i + k
            while len(signs) == k and [x[0] for x in items[j: j + k]] == signs:
                group = [merged(x, y) for x, y in zip(group, items[j: j + k])]
                j += k
            if j == i + k:
                out.append(items[i])
                i += 1
                continue
            if k == 1:
                group[0][2] = True
                out.append(group[0])
            else:
                out.append(["(" + " ".join(signs) + ")", False, True, group, 1])
            i = j
        items = out
    return items


def align(a: list, b: list) -> Iterator[tuple[int | None, int | None]]:
    """Pairs of places of items with equal signatures in order, and the places between that have no partner."""
    x, y = [i[0] for i in a], [i[0] for i in b]
    if x == y:
        yield from ((i, i) for i in range(len(x)))
        return
    pairs = []
    if len(x) <= ALIGNED and len(y) <= ALIGNED:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(len(y) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        places: dict[str, list[int]] = {}
        for j, s in enumerate(y):
            places.setdefault(s, []).append(j)
        last = -1
        for i, s in enumerate(x):
            own = places.get(s)
            while own and own[0] <= last:
                own.pop(0)
            if own:
                last = own.pop(0)
                pairs.append((i, last))
    i = j = 0
    for p, q in [*pairs, (len(x), len(y))]:
        yield from ((k, None) for k in range(i, p))
        yield from ((None, k) for k in range(j, q))
        if p < len(x):
            yield p, q
        i, j = p + 1, q + 1


def merge(a: list, b: list) -> list:
    """The union-free sequence that fits two sequences (their items are reused)."""
    out = []
    for i, j in align(a, b):
        if i is None or j is None:
            item = b[j] if i is None else a[i]
            item[1] = True
            out.append(item)
        else:
            out.append(merged(a[i], b[j]))
    if any(p[0] == q[0] for p, q in zip(out, out[1:])):
        out = fold(out, 1)
    if len(out) > LEVEL_ITEMS:
        by: dict[str, list] = {}
        for item in out:
            item[1] = item[2] = True
            by[item[0]] = merged(by[item[0]], item) if item[0] in by else item
        out = list(by.values())
    return out


def bare(items: list, own: list[int] | None = None) -> list:
    """A page's wrapper, without the numbers of its text runs."""
    if own is None:
        main = next((r for names in _MAIN if any(map(weight, r := _regions(items, names)))), items)
        own = [zlib.crc32(repr(_hashes(main)).encode())]
    return [[x[0], x[1], x[2], None, [*x[4][:4], [], own]] if x[3] is None else [x[0], x[1], x[2], bare(x[3], own), x[4]] for x in items]


def _hashes(items: list) -> list[int]:
    return [k for x in items for k in ([x[4][5]] if x[3] is None else _hashes(x[3]))]


def weight(item: list) -> int:
    """Characters outside links less those in links."""
    if item[3] is None:
        return item[4][1] - 2 * item[4][2]
    return 0 if item[0][:1] == "!" else sum(max(0, weight(x)) for x in item[3])


def _regions(items: list, names: tuple[str, ...]) -> list:
    """Outermost elements of these names."""
    out = []
    for x in items:
        if x[3] is not None and x[0][0] != "!":
            out += [x] if x[0].split(".")[0] in names or names[0] == "main" and "@main" in x[0] else _regions(x[3], names)
    return out


def label(items: list) -> list:
    """The wrapper with 1 or 0 as the only number of each text slot: content or not. In an article or main element every
    slot is; elsewhere text that never changes over some pages is the template's, and so are slots that are mostly links."""
    chosen = next((r for names in _MAIN if any(map(weight, r := _regions(items, names)))), None)
    found = chosen is not None
    if not found:
        region = ["", False, False, items, 1]
        while True:
            total = weight(region)
            inner = max((x for x in region[3] if x[3] is not None and x[0][0] not in "!(" and x[0].split(".")[0] not in _BLOCKS), key=weight, default=None)
            if inner is None or weight(inner) < 0.7 * total or not total:
                break
            region = inner
        chosen = [region]
    inside = {id(x) for x in chosen}
    whole = bool(chosen and chosen[0][0] == "")

    def varies(items):
        return any(x[4][3] == 0 if x[3] is None else varies(x[3]) for x in items)
    changing = any(varies(x[3]) for x in chosen)

    def mark(items, within, parent):
        for x in items:
            if x[3] is None:
                _, chars, links, only, _, pages = x[4]
                shared = not found and isinstance(pages, list) and len(pages) >= TEMPLATE_PAGES
                template = only and changing and shared and parent not in _HEADINGS
                x[4] = [*x[4][:4], [int(bool(within and not template and (found or 2 * links <= chars)))]]
            elif x[0][0] != "!":
                mark(x[3], within or id(x) in inside, x[0].split(".")[0])
    mark(items, whole, "")
    return items


def _numbers(items: list) -> list[int]:
    return [k for x in items for k in (x[4][4] if x[3] is None else _numbers(x[3]))]


def content(page: list, wrapper: list) -> tuple[list[int], list[int]]:
    """Numbers of the page's text runs in content slots, and of those that the wrapper has no place for."""
    out, strange = [], []
    places = None
    for i, j in align(page, wrapper):
        if i is None:
            continue
        x = page[i]
        if j is None:  # a level in any order has its place elsewhere
            if places is None:
                places = {y[0]: k for k, y in reversed(list(enumerate(wrapper)))}
            j = places.get(x[0])
        if j is None:
            strange += _numbers([x])
        elif x[3] is None:
            out += x[4][4] if wrapper[j][4][4] == [1] else []
        else:
            inner = content(x[3], wrapper[j][3])
            out += inner[0]
            strange += inner[1]
    return out, strange


def _own(page: list) -> list[int]:
    numbers = {}

    def keep(items, path):
        for k, x in enumerate(items):
            if x[3] is None:
                numbers[*path, k] = x[4][4]
            else:
                keep(x[3], (*path, k))
    keep(page, ())
    out = []

    def read(items, path):
        for k, x in enumerate(items):
            if x[3] is None:
                out.extend(numbers[*path, k] if x[4][4] == [1] else [])
            else:
                read(x[3], (*path, k))
    read(label(page), ())
    return out


def extract(html: str, wrapper: list | None) -> str:
    """Main text of one page."""
    items, texts = parse(html)
    page = fold(items)
    numbers, strange = content(page, wrapper) if wrapper is not None else ([], [])
    if not numbers:
        numbers = _own(page)
    elif strange:
        numbers += set(strange).intersection(_own(page))
    return "\n\n".join(" ".join(texts[k].split()) for k in sorted(numbers))


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One wrapper for each key, folded as the sorted stream passes."""
    schema = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys] + [T.StructField("wrapper", T.StringType())])
    out = arrow_schema(schema)
    width = len(keys)

    def run(batches):
        key, wrapper = None, []
        for batch in batches:
            done: list = []
            for *own, text in zip(*(batch.column(i).to_pylist() for i in range(width + 1))):
                if own != key:
                    if key is not None:
                        done.append([*key, json.dumps(wrapper)])
                    key, wrapper = own, json.loads(text)
                else:
                    wrapper = merge(wrapper, json.loads(text))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), out)], schema=out)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([*key, json.dumps(wrapper)], out)], schema=out)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "wrapper").select(*keys, "wrapper").mapInArrow(run, schema)


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper) for every host, from all of its pages; the wrapper as JSON."""
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("wrapper", T.StringType())])
    out = arrow_schema(schema)

    def run(batches):
        by: dict[str, list] = {}

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([json.dumps(x) for x in by.values()], pa.string())], schema=out)
        for batch in batches:
            for host, text in zip(batch.column(0), batch.column(1)):
                host, own = host.as_py(), bare(fold(parse(text.as_py() or "")[0]))
                by[host] = merge(by[host], own) if host in by else own
                if len(by) >= HOSTS_AT_ONCE:
                    yield emit()
                    by.clear()
        yield emit()
    parts = pages.select(site_parts(F.col(url))[0].alias("host"), F.col(html).alias("html")).mapInArrow(run, schema)
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    return _folded(_folded(parts, ["host", "salt"]).drop("salt"), ["host"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    known = saved(wrappers(pages, url, html)).select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    rows = pages.select(key, url, html, site_parts(F.col(url))[0].alias("__own_host"))
    rows = rows.join(known, F.col("__own_host") == F.col("__host"), "left").select(key, url, html, "__wrapper")
    schema = T.StructType([pages.schema[key], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    out = arrow_schema(schema)

    def run(batches):
        labelled: dict[str, list] = {}
        for batch in batches:
            texts = []
            for text, wrapper in zip(batch.column(2), batch.column(3)):
                name = wrapper.as_py()
                if name is not None and name not in labelled:
                    if len(labelled) >= HOSTS_AT_ONCE:
                        labelled.clear()
                    labelled[name] = label(json.loads(name))
                texts.append(extract(text.as_py() or "", labelled.get(name)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out[0].type), batch.column(1).cast(out[1].type), pa.array(texts, pa.string()),
                                              pa.array([len(x) for x in texts], pa.int64())], schema=out)
    return rows.mapInArrow(run, schema)


def op1_html(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
