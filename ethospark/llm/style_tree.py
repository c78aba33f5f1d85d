"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree, whose nodes are paths of labels (tag, class and id; equal siblings are one node). All
nodes are in it, navigation and adverts too; equal pages of a host count once. Two measures say how important a node
is, after the number m of pages that have it:

* presentation: the entropy, to base m, of the sequences of children it has on the pages. A node that always looks
  the same has 0;
* content: 1 minus the mean entropy, to base m, of its texts over the pages. A text that is on every page has entropy
  1, one that is on a single page 0.

A node's own importance is the weighted mean of its measures and those of the nodes below it. The weight fades with the depth by
GAMMA, and presentation weighs 1 - GAMMA^l for l sequences. A branch is as important as its most important node, so what
stands around an article never takes it along. What few pages show is uncertain, so the measure is drawn towards 1 as
if ``PRIOR`` further pages had it. The composite importance is the measure times the weight of the node's role, 0 or 1. Branches of low
composite importance are removed from every page of the host. A role is known from the page alone, so only
branches of low measure are looked up.

What gives a role of weight 0: tags (``nav``, ``footer``, ``form``, hidden ones), and classes, ids and roles that *name* a part (``class="sidebar"``, ``id="site-footer"``: nothing but
such a word and words of layout). A name that only holds such a word (``notice-period``, ``search-engine-history``) is none, nor are words of several meanings (``menu``, ``notice``)
on tables and paragraphs, or on a branch of an article with much prose in it: there the measure decides alone. Reader comments are known by all names that begin with ``comment``.
Of several articles those much shorter than the longest are teasers; of an article's own header headings and lead paragraphs stay, bylines go.

Spark jobs: pages to nodes and text digests (no text is shuffled); three grouped sums; two over all ancestors of a
node; then pages join the low branches of their host, which are few. A host with a third of all pages is merged
before each shuffle. The low branches are written and measured: they are broadcast up to ``BROADCAST_BYTES``, so that no page
moves; beyond, pages are shuffled by host, those of a hot host to several tasks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import join_split, map_batches, strings, written

GAMMA = 0.9
#: A branch below this composite importance is noise.
LOW = 0.5
#: Pages of full importance that are added to those of a node: a branch that never changes is noise from the third page on.
PRIOR = 1
#: Words of prose with which a branch of an article survives a name of several meanings; words of a lead paragraph; share of the longest article's text below which another one is a teaser.
PROSE_WORDS, LEAD_WORDS, TEASER = 40, 8, 0.3
BROADCAST_BYTES = 32 << 20
#: Levels of the tree: what is nested deeper counts as part of the node there, and its text is kept.
DEPTH = 64
#: Longer names of classes and ids are cut in labels and marked by their hash.
NAME_CHARS = 40

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*(?:>|\Z)", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)

RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Blocks that end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
NOISE_TAGS = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "option", "svg", "canvas", "object", "embed", "audio", "video", "input"} | RAW
ROOTS = {"html", "body", "main", "article"}
#: Words of classes, ids and roles that name a part which isn't the article.
NOISE_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices"
    " alert newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond replies popup modal form search widget widgets copyright legal toolbar pagination pager overlay"
    " complementary contentinfo dialog discussion".split()
)
#: Of these, words that can speak of a text's matter.
AMBIGUOUS = set("menu notice notices alert legal search related form copyright banner promotion widget login share social dialog overlay modal recommended complementary discussion".split())
#: Tags of a text's own parts, on which ambiguous words name nothing.
MATTER = {"p", "table", "thead", "tbody", "tr", "td", "th", "caption", "dl", "dt", "dd", "blockquote", "pre", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "section"}
#: Words that turn a token into a remark on the layout: with-sidebar.
LAYOUT_WORDS = {"with", "has", "no", "without", "is"}
#: Words that may stand beside the word that names a part.
BESIDE = set(
    "box bar area wrapper wrap container block section list links link unit slot inner outer item items panel module content site page main global top bottom left right header primary secondary row col group zone region"
    " text title body post posts article articles stories news entry user reader readers button buttons icon icons tools view holder frame cell new all the by thread form author meta".split()
)
COMMENT = re.compile(r"comment(?!ar|at)[a-z]*|disqus|respond|repl(?:y|ies)|guestbook")


class _Node:
    __slots__ = ("article", "branch", "brief", "depth", "dropped", "inline", "label", "link", "main", "path", "tag", "words")

    def __init__(self, tag: str, label: str, words: set[str], parent: _Node | None):
        self.tag, self.label, self.words = tag, label, words
        if tag in MATTER:
            words -= AMBIGUOUS
        self.inline = tag in INLINE and not words & NOISE_WORDS
        up = parent.path if parent else ""
        self.depth = (parent.depth if parent else 0) + (not self.inline)
        self.path = up if self.inline or self.depth > DEPTH else f"{up}/{label}"
        main = parent.main if parent else False
        named = words & NOISE_WORDS if tag not in ROOTS else words & {"comment"}
        header = tag == "header" or "header" in words and tag not in ROOTS
        role = bool(tag in NOISE_TAGS or named - AMBIGUOUS or named and not main or header and not main)
        self.dropped = bool(parent and parent.dropped) or role or "?hidden" in words
        #: A branch whose name has several meanings: its text decides, once it is known.
        self.branch = bool(named) and not self.dropped
        inside = bool(parent and "?header" in parent.words) and not self.inline
        self.brief = inside and tag == "p" or bool(parent and parent.brief)
        if not self.dropped and inside and not re.fullmatch(r"h[1-6]|hgroup|div|p", tag):
            self.dropped = True
        if header and main and not role or inside and tag == "div":
            words.add("?header")  # of an article's own header headings and leads stay
        self.main = main or (tag in ("article", "main") and not self.dropped)
        self.article = tag == "article" and not self.dropped
        self.link = tag == "a" or bool(parent and parent.link)


def _words(attributes: str) -> tuple[set[str], str]:
    """The words by which a node's class, id and role name a part that isn't the article, and the node's label."""
    words: set[str] = set()
    name = ""
    for key, a, b, c in NAMED.findall(attributes):
        value = html.unescape(a or b or c)
        for token in value.split():
            parts = [x.lower() for x in CAMEL.split(token) if x]
            if not parts or parts[0] in LAYOUT_WORDS:
                continue
            said = ["comment" if COMMENT.fullmatch(x) else x for x in parts]
            naming = {x for x in said if x in NOISE_WORDS or x == "header"}
            if naming and all(x in naming or x in BESIDE or len(x) < 3 for x in said):
                words |= naming
        if key.lower() != "role":
            label = re.sub(r"\d+", "0", "-".join(value.split())).replace("/", "|")
            name += ("." if key.lower() == "class" else "#") + (label if len(label) <= NAME_CHARS else f"{label[:NAME_CHARS]}~{xxhash.xxh64_hexdigest(label)}")
    if HIDDEN.search(attributes):
        words.add("?hidden")
    return words, name


def blocks(page: str) -> tuple[list[tuple[str, bool, bool, str]], dict[str, list[str]]]:
    """The text blocks of a page, in order, as (path, dropped by role, inside article or main, text), and each node's children.

    The reader is lenient: unknown, unclosed and cut tags are taken as browsers take them, roughly.
    """
    out: list[tuple[str, bool, bool, str]] = []
    of: list[tuple[int, int]] = []  # of each block: the named branch and the article that it is in, by number
    branches, articles = [[0, 0]], [0]  # words and words in links of branches; characters of articles; 0 is none
    inside = [(0, 0)]  # as many as the stack
    children: dict[str, list[str]] = {}
    stack = [_Node("", "", set(), None)]
    held: list[str] = []
    links = [0]  # words in links of the block under way
    memory: dict[str, tuple[set[str], str]] = {}

    def end_block() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                node, (branch, article) = stack[-1], inside[-1]
                n_words = len(text.split())
                dropped = node.dropped or node.brief and n_words < LEAD_WORDS
                branches[branch][0] += n_words
                branches[branch][1] += links[0]
                if not dropped:
                    articles[article] += len(text)
                out.append((node.path, dropped, node.main, text))
                of.append((branch, article))
            links[0] = 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            held.append(page[at:])
            break
        if lt > at:
            held.append(page[at:lt])
            if stack[-1].link:
                links[0] += page.count(" ", at, lt) + 1
        m = TOKEN.match(page, lt) or LOOSE.match(page, lt)
        if not m:
            held.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m.lastindex is None or not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE and not any(x.tag == tag and not x.inline for x in stack):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k], inside[k]
                        if tag == "a":
                            for x in stack[k:]:
                                x.link = False
                        break
                    if not stack[k].inline:
                        break
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    end_block()
                    del stack[k:], inside[k:]
                    break
            else:
                if tag in ENDS_P:
                    end_block()
            continue
        if tag == "br":
            held.append(" ")
            continue
        close = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in close:
                    end_block()
                    del stack[k:], inside[k:]
                    break
                if not stack[k].inline and stack[k].tag not in ("td", "th"):
                    break
        words, name = memory.get(m[3]) or memory.setdefault(m[3], _words(m[3]) if "=" in m[3] or "hidden" in m[3] else (set(), ""))
        node = _Node(tag, tag + name, set(words), stack[-1])
        if not node.inline:
            end_block()
            seen = children.setdefault(stack[-1].path, [])
            if not seen or seen[-1] != node.label:
                seen.append(node.label)
            children.setdefault(node.path, [])
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = stop.start() if stop else n
            if stop:
                at = (page.find(">", at) + 1) or n
        elif tag not in VOID and not m[3].endswith("/"):
            branch, article = inside[-1]
            if node.branch and not branch:
                branches.append([0, 0])
                branch = len(branches) - 1
            if node.article and not any(x.article for x in stack):
                articles.append(0)
                article = len(articles) - 1
            stack.append(node)
            inside.append((branch, article))
    end_block()
    bare = {k for k, (n_words, linked) in enumerate(branches) if k and (n_words < PROSE_WORDS or 3 * linked > n_words)}
    teasers = {k for k, n_chars in enumerate(articles) if k and n_chars < TEASER * max(articles[1:])}
    return [(path, dropped or b in bare or k in teasers, main, text) for (path, dropped, main, text), (b, k) in zip(out, of, strict=True)], children


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("path", pa.string()), ("kind", pa.int32()), ("feature", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        hosts, pages = strings(batch, "host"), strings(batch, "html")
        out: list[tuple] = []
        for host, page in zip(hosts, pages, strict=True):
            found, children = blocks(page)
            rows: Counter = Counter((path, 1, _digest(text)) for path, _, _, text in found)
            for path in {p[:i] for p in {x[0] for x in found} for i, c in enumerate(p + "/") if c == "/" and i}:
                rows[path, 0, _digest("\n".join(children.get(path, ())))] = 1
            key = _digest(page)
            out += [(host, key, *k, v) for k, v in rows.items()]
            if len(out) >= 65536:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def importance(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The merged trees: rows (host, path, pages, measure) for each node of each host.

    ``measure`` is the importance of the branch before its role is considered. Pages without a url are one host's.
    """
    source = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("html is not null")
    found = map_batches(source, _nodes, "host string, page long, path string, kind int, feature long, n long")
    found = found.groupBy("host", "page", "path", "kind", "feature").agg(F.max("n").alias("n"))  # equal pages are one
    # Of a feature: its pages, and the sum for its entropy over them, ln C - sum(c ln c) / C.
    by_feature = found.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.log("n")).alias("s"))
    style, text = F.col("kind") == 0, F.col("kind") == 1
    nodes = by_feature.groupBy("host", "path").agg(
        F.sum(F.when(style, F.col("c"))).alias("m"),
        F.count_if(style).alias("styles"),
        F.sum(F.when(style, F.col("c") * F.log("c"))).alias("style_sum"),
        F.count_if(text).alias("texts"),
        F.sum(F.when(text, F.log("c") - F.col("s") / F.col("c"))).alias("text_sum"),
    )
    ln_m = F.log("m")
    sure = (F.col("m") - 1) / (F.col("m") - 1 + PRIOR)
    look = F.when(F.col("m") > 1, 1 - sure + sure * (ln_m - F.col("style_sum") / F.col("m")) / ln_m).otherwise(1.0)
    content = F.when(F.col("m") > 1, 1 - sure + sure * F.greatest(F.lit(0.0), 1 - F.col("text_sum") / F.col("texts") / ln_m)).otherwise(1.0)
    weight = 1 - F.pow(F.lit(GAMMA), F.col("styles"))
    both = nodes.select(
        "host", "path", "m", (F.col("m") * (weight * look + F.when(F.col("texts") > 0, content).otherwise(0.0))).alias("value"), (F.col("m") * (weight + F.when(F.col("texts") > 0, 1.0).otherwise(0.0))).alias("weight")
    )
    # A node counts for itself and for all nodes above it.
    labels, up = F.split("path", "/"), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/")
    above = F.posexplode(F.transform(F.sequence(F.lit(2), F.size(labels)), up)).alias("up", "above")
    ups = both.select("host", "path", "m", "value", "weight", above, F.size(labels).alias("size"))
    fade = F.pow(F.lit(GAMMA), F.col("size") - F.col("up") - 2)
    mean = ups.groupBy("host", F.col("above").alias("path")).agg(F.max(F.when(F.col("above") == F.col("path"), F.col("m"))).alias("pages"), (F.sum(F.col("value") * fade) / F.sum(F.col("weight") * fade)).alias("mean")).where("pages is not null")
    best = mean.select("host", "path", "pages", "mean", above).groupBy("host", F.col("above").alias("path"))
    return best.agg(F.max(F.when(F.col("above") == F.col("path"), F.col("pages"))).alias("pages"), F.max("mean").alias("measure")).where("pages is not null")


def _extract(low_col: str, low_limit: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            lows = batch.column(batch.schema.get_field_index(low_col)).to_pylist()
            for page, low in zip(strings(batch, "html"), lows, strict=True):
                found, noise = blocks(page)[0], set(low or ())
                if low_limit > 0:  # of a role that isn't the article's the composite importance is 0
                    found = [x for x in found if not x[1]]
                    if any(x[2] for x in found):
                        found = [x for x in found if x[2]]
                if noise:
                    found = [x for x in found if not any(x[0][:i] in noise for i, c in enumerate(x[0] + "/") if c == "/" and i)]
                texts.append(" ".join(x[3] for x in found))
            columns = [batch.column(k).cast(schema.field(k).type) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", low: float = LOW) -> DataFrame:
    """Rows (page_id, url, text, n_chars): the main text of each page.

    A null or empty page has an empty text; a null url belongs to the host without a name. Pages with an ``article`` or ``main``
    give that part, others the whole body, either without branches of an importance below ``low``. Repeated rows and
    equal or null ids give a row each.
    """
    noise = importance(pages, url_col, html_col).where(F.col("measure") < low)
    noise = noise.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low"))
    noise = written(noise, "noise")
    size = noise.agg(F.coalesce(F.sum(F.octet_length(F.array_join("low", ";")) + F.octet_length("host") + 32), F.lit(0)).alias("n")).first()["n"]
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if size <= BROADCAST_BYTES:
        joined = source.join(F.broadcast(noise), "host", "left")
    else:
        counts = source.groupBy("host").agg(F.count("*").alias("rows"))
        joined = join_split(source, written(counts.join(noise, "host", "left"), "noise"), "host", "rows", "left")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return map_batches(joined.select("page_id", "url", "html", "low"), _extract("low", low, schema), "page_id long, url string, text string, n_chars long")
