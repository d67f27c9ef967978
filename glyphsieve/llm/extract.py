"""Main text of web pages by templates deduced from equivalence classes of same-host tokens."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.common import BROADCAST_BYTES, materialize, sized, texts_of

#: Fixed values of HTML: elements whose content is no markup or no text, that never have content, and that don't break a block.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp", "title")
SILENT = {"script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "head", "title", "svg", "math", "canvas", "object", "audio", "video", "select", "option", "button", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that end an open element of the listed kinds when they start.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"table", "ul", "ol", "dl", "article", "main", "section", "div", "body", "html", "blockquote", "figure", "aside", "nav", "header", "footer", "form", "td", "th", "li", "select"}
#: Elements that can be a slot of their own, and of these the ones that are told apart by their place among their like if they have no name.
CONTAINERS = {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td"}
PLACED = {"div", "section", "center", "table", "td"}
HEADINGS = {"h1", "h2", "h3"}
#: Elements, roles and name parts that mark what surrounds an article.
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog"} | SILENT
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?<!without[_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|banner|cookies?|consent|gdpr|notice|notices|notification|newsletter|subscribe|subscription|signup|popup|modal|overlay|nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|side-?bar|widget|widgets|masthead|footer|comments?|comment-?list|disqus|respond|responses|replies|reactions|discussion|reader-?comments|share|sharing|social|related|recommended|pagination|pager|toolbar|login)(?=$|[\s_-])",
    re.I,
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])header(?=$|[\s_-])", re.I)

_NAME = r"[a-zA-Z][^\s/>]*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)({_NAME})((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)({_NAME})([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")

Marks = tuple[tuple[str, bool], ...]


@dataclass
class Node:
    tag: str
    path: str
    chrome: bool
    article: str  # path of the article, else of the main element that it is in, or nothing
    sure: bool  # whether that is an article
    silent: bool
    marks: Marks = ()  # elements named like chrome that hold it, as far out as its article: path, and whether that is all the name says
    doubt: Marks = ()  # such elements around its article
    unnamed: dict[str, int] = field(default_factory=dict)  # elements without a name in it, by tag


@dataclass
class Block:
    """A run of text between tags that break it."""

    node: Node
    words: str
    links: bool  # whether all of it is links


@dataclass
class Page:
    """A page as tokens: how often each path (root to tag, with class and id) occurs, and its blocks of text in page order."""

    paths: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    blocks: list[Block] = field(default_factory=list)


Names = frozenset[str] | None


def _parts(tag: str, name: str) -> list[str]:
    """The parts of a class and id as they may stand in a path: all numbers are alike, and the document's own elements have none."""
    return [] if tag in ("html", "body") else _DIGITS.sub("0", name).replace("/", "_").split()


@lru_cache(maxsize=20_000)
def _attributes(attributes: str) -> tuple[str, str, bool, bool, bool, bool]:
    """Of a tag's attributes: class and id, role, whether it is hidden; whether its name is chrome's, a header's, and nothing but such."""
    names, role, hidden = [], "", False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names.append(value)
        elif key == "role":
            role = value.lower().strip()
        elif key == "itemprop" and value.lower() == "articlebody":
            role = "article"
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            hidden = True
    name = " ".join(names)
    return name, role, hidden, bool(CHROME_NAMES.search(name)), bool(HEADER_NAMES.search(name)), _only_chrome(name)


def _node(parent: Node, tag: str, attributes: str, stable: Names) -> Node:
    name, role, hidden, chrome_name, header_name, only = _attributes(attributes) if attributes.strip(" /") else ("", "", False, False, False, False)
    sure = tag == "article" or role == "article"
    opens = sure or tag == "main" or role == "main"
    # an article inside an article, such as a reader's comment, is no article of the page
    named = bool(name and tag not in ("html", "body") and (chrome_name or (not parent.article and header_name)) and not (opens and not parent.article))
    heading = tag == "header" and parent.article
    chrome = parent.chrome or (tag in CHROME and not heading) or role in CHROME_ROLES or hidden
    parts = [x for x in _parts(tag, name) if stable is None or f"{tag}.{x}" in stable] if name else ()
    step = tag + (f".{' '.join(parts)}" if parts else "")
    if not parts and tag in PLACED:
        k = parent.unnamed[tag] = parent.unnamed.get(tag, 0) + 1
        step += f"~{k}" * (k > 1)
    path = f"{parent.path}/{step}"
    enters = not chrome and (sure and not parent.sure or opens and not parent.article)
    marks = (*parent.marks, (path, only)) if named else parent.marks
    doubt = parent.doubt
    if enters:
        marks, doubt = (), (*doubt, *marks)
    return Node(tag, path, chrome, path if enters else parent.article, parent.sure or (enters and sure), parent.silent or tag in SILENT, marks, doubt)


def _only_chrome(name: str) -> bool:
    """Whether a class or id consists of listed parts alone (cookie-notice), not one among others (sidebar-right, widget-area)."""
    return any(not HEADER_NAMES.sub("", CHROME_NAMES.sub("", x)).strip("-_") for x in name.split())


def parse(text: str, stable: Names = None) -> Page:
    """Tokens and blocks of a page. Markup may be cut off, unclosed or crossed. Of classes and ids, paths hold the parts that are
    stable on the host ("tag.part"), all if that is None."""
    page, stack = Page(), [Node("", "", False, "", False, False)]
    parts: list[str] = []
    linked = plain = 0
    owner = stack[0]
    at = anchors = 0

    def flush() -> None:
        nonlocal parts, linked, plain
        if parts:
            words = " ".join(html.unescape("".join(parts)).split())
            if words:
                page.blocks.append(Block(owner, words, not plain and linked > 0))
        parts, linked, plain = [], 0, 0

    def block_node() -> Node:
        return next(n for n in reversed(stack) if n.tag not in INLINE)

    def say(piece: str) -> None:
        nonlocal owner, linked, plain
        if not piece or stack[-1].silent:
            return
        top = stack[-1]
        if (top.chrome, top.marks) != (owner.chrome, owner.marks) and parts and piece.strip():
            flush()  # an inline element may be chrome of its own
        if not parts:
            block = block_node()
            owner = top if top.chrome or top.marks != block.marks else block
        parts.append(piece)
        if piece.strip():
            if anchors:
                linked += len(piece)
            else:
                plain += len(piece)

    while m := _TOKEN.search(text, at):
        say(text[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        end, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if end:
            if tag == "br" or tag not in INLINE:
                flush()
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                page.paths[f"{stack[depth].path}/"] += 1
                anchors -= sum(n.tag == "a" for n in stack[depth:])
                del stack[depth:]
            continue
        if tag not in INLINE:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, a list item its neighbour
                if stack[k].tag == "p" or stack[k].tag in CLOSES.get(tag, ()):
                    if tag != "br" and tag != "hr" or stack[k].tag != "p":
                        anchors -= sum(n.tag == "a" for n in stack[k:])
                        del stack[k:]
                    if tag not in CLOSES:
                        break
                elif stack[k].tag in SCOPES and stack[k].tag not in CLOSES.get(tag, ()):
                    break
        node = _node(stack[-1], tag, attributes, stable)
        page.paths[node.path] += 1
        if tag in VOID:
            continue
        if tag in RAW and not attributes.rstrip().endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(text, at)
            page.paths[f"{node.path}/"] += 1
            at = close.end() if close else len(text)
            continue
        if attributes.rstrip().endswith("/") and tag in SILENT:
            continue
        stack.append(node)
        anchors += tag == "a"
    say(text[at:])
    flush()
    return page


def host(url: Column) -> Column:
    """The host that a url names, in lower case; empty if none."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9_+.\-]*:", ""), "^/+", "")
    return F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))


TEXT = "#"  # starts a text token: the path of a block and a digest of its words


def text_token(b: Block) -> str:
    return f"{TEXT}{b.node.path}{TEXT}{_hash(b.words):016x}"


def page_tokens(page: Page) -> dict[str, int]:
    """Occurrences of each token: every path, and every block with its path, however long and in an article element or not."""
    out = dict(page.paths)
    for b in page.blocks:
        key = text_token(b)
        out[key] = out.get(key, 0) + 1
    return out


def weight(b: Block) -> int:
    """How much a character of a block counts where a host's main slot is looked for: tags and names tip the scales between
    slots, but a slot wins by the text that varies in it."""
    if b.node.chrome:
        return 0
    return 1 if b.node.marks or b.node.doubt else 8 if b.node.article else 4


_NAMED = re.compile(rf"<({_NAME})((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
NAMES = "host string, name string, pages long"


def stable_names(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """host, names: of the tags' parts of classes and ids ("tag.part") those that at least share of the host's pages have. What a page has of
    its own (categories, numbers of posts, states) is no part of a path, so that pages agree in their paths.

    Tasks add up their pages before anything is shuffled; of a host no more names remain than 1 / share times those of a page.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], int] = defaultdict(int)
        known: dict[tuple[str, str], list[str]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["host", "name", "pages"])

        for b in batches:
            for site, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                seen: set[str] = set()
                for tag, attributes in set(_NAMED.findall(text or "")):
                    if not attributes.strip(" /"):
                        continue
                    if (own := known.get((tag, attributes))) is None:
                        low = tag.lower()
                        name = " ".join(m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id"))
                        if len(known) > 20_000:
                            known.clear()
                        own = known[tag, attributes] = [f"{low}.{x}" for x in _parts(low, name)]
                    seen.update(own)
                for name in seen:
                    sums[site, name] += 1
                sums[site, ""] += 1
            if len(sums) > 200_000:
                yield out()
                sums.clear()
        if sums:
            yield out()

    rows = pages.select("html", host(F.col("url")).alias("host")).mapInArrow(count, NAMES).groupBy("host", "name").agg(F.sum("pages").alias("pages"))
    rows = materialize(rows, "names")
    hosts = rows.where("name = ''").select(F.col("host").alias("h"), F.col("pages").alias("host_pages"))
    kept = rows.where("name <> ''").join(sized(hosts, 100), F.col("host") == F.col("h")).where(F.col("pages") >= share * F.col("host_pages"))
    return materialize(kept.groupBy("host").agg(F.array_sort(F.collect_list("name")).alias("names")), "stable")


def by_host(asked: DataFrame, sides: DataFrame, size: int, salts: int) -> DataFrame:
    """asked with the row of sides of its host, if any: broadcast if size bytes allow, else joined by host and a salt."""
    if size <= BROADCAST_BYTES:
        return asked.join(F.broadcast(sides), "host", "left")
    salted = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return asked.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")


TOKENS = "host string, token string, vector long, pages long, total long, least long, most long, chars long"


def _bytes(sides: DataFrame, *lists: str) -> int:
    return sides.agg(F.sum(F.length("host") + 100 + sum((F.length(F.array_join(F.col(c).cast("array<string>"), "")) + 8 * F.size(c) for c in lists), F.lit(0)))).first()[0] or 0


def token_vectors(pages: DataFrame, names: DataFrame | None = None, salts: int = 32) -> DataFrame:
    """host, token, and its occurrence vector over the host's pages as a 64-bit sum of one random term for each page,
    times the count; support and extremes of the counts; of text tokens the weighted characters. Also a row (token starts with "@")
    for each path of blocks: total and chars are its weighted characters and those that are links.

    Tasks add up their pages before anything is shuffled, so a host with a third of all pages is a few rows a task. names are stable_names,
    if known.
    """
    names = stable_names(pages) if names is None else names

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], list[int]] = {}
        stable: dict[str, frozenset[str]] = {}

        def out() -> pa.RecordBatch:
            keys = list(sums)
            cols = list(zip(*sums.values(), strict=True))
            vector = np.array([v & (1 << 64) - 1 for v in cols[0]], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(vector), *[pa.array(c, pa.int64()) for c in cols[1:]]], [c.split()[0] for c in TOKENS.split(", ")])

        for b in batches:
            if len(stable) > 1000:
                stable.clear()
            for k, (key, url, site, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "host", "html")), strict=True)):
                if site not in stable:
                    stable[site] = frozenset(b.column("names")[k].as_py() or ())
                page, term = parse(text or "", stable[site]), _hash(f"{key} {url}")
                seen = page_tokens(page)
                seen[""] = 1  # the host itself: its number of pages
                for token, n in seen.items():
                    s = sums.setdefault((site, token), [0, 0, 0, n, n, 0])
                    s[0] += term * n
                    s[1] += 1
                    s[2] += n
                    s[3], s[4] = min(s[3], n), max(s[4], n)
                for x in page.blocks:
                    if n := len(x.words) * weight(x):
                        sums[site, text_token(x)][5] += n
                        s = sums.setdefault((site, f"@{x.node.path}"), [0] * 6)
                        s[1] += 1
                        s[2] += n
                        s[5] += n * x.links
            if len(sums) > 200_000:
                yield out()
                sums.clear()
        if sums:
            yield out()

    asked = by_host(pages.select("page_id", "url", "html", host(F.col("url")).alias("host")), names, _bytes(names, "names"), salts)
    rows = asked.select("page_id", "url", "html", "host", "names").mapInArrow(count, TOKENS)
    added = [F.sum(c).alias(c) for c in ("pages", "total", "chars")]
    return rows.groupBy("host", "token").agg(F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), *added, F.min("least").alias("least"), F.max("most").alias("most"))


def equivalence_classes(vectors: DataFrame, share: float = 0.5) -> DataFrame:
    """host, class_vector, pages, once, tokens, chars: tokens of a host with one occurrence vector, found on at least share of its
    pages. once says that each occurs exactly once on each of its pages. A class is valid if it has two tokens or more
    and, as paths tell, its tags nest: the parent of each is in a class that is found wherever it is."""
    hosts = vectors.where("token = ''").select(F.col("host").alias("h"), F.col("pages").alias("host_pages"))
    tokens = vectors.where("token <> '' and not startswith(token, '@')").join(sized(hosts, 100), F.col("host") == F.col("h"))
    large = tokens.where(F.col("pages") >= share * F.col("host_pages"))
    classes = large.groupBy("host", "host_pages", F.pmod("vector", F.lit(1 << 62)).alias("class_vector"), "pages", "total").agg(F.array_sort(F.collect_list(F.struct("token", "chars"))).alias("held"), F.min("least").alias("least"), F.max("most").alias("most"))
    return classes.select("host", "host_pages", F.col("class_vector").cast("long").alias("class_vector"), "pages", ((F.col("least") == 1) & (F.col("most") == 1)).alias("once"), F.col("held.token").alias("tokens"), F.col("held.chars").alias("chars"), (F.size("held") > 1).alias("valid"))


def nest(classes: list[dict]) -> list[dict]:
    """Template of a host: its valid classes, each with the class of its outermost token's parent. Roots have parent -1.

    Text tokens hang below their path. Classes are ordered from the outside in; a class whose parent token is in no
    valid class, or in one with less support, is dropped with all below it.
    """
    valid = sorted((c for c in classes if c["valid"]), key=lambda c: (min(t.count("/") for t in c["tokens"]), -c["pages"], c["tokens"]))
    at: dict[str, int] = {}
    out: list[dict] = []
    for c in valid:
        tags = [t for t in c["tokens"] if not t.startswith(TEXT)] or [t[1:].rpartition(TEXT)[0] for t in c["tokens"]]
        first = min((t.rstrip("/") for t in tags), key=lambda t: (t.count("/"), t))
        up = first.rpartition("/")[0]
        parent = at.get(up, -1)
        if (up and parent < 0) or (parent >= 0 and out[parent]["pages"] < c["pages"]):
            continue
        for t in c["tokens"]:
            if not t.startswith(TEXT):
                at.setdefault(t.rstrip("/"), len(out))
        out.append(c | {"class_id": len(out), "parent": parent})
    return out


def _tag(path: str) -> str:
    return re.split(r"[.~]", path.rpartition("/")[2], maxsplit=1)[0]


def main_slot(nested: list[dict], slots: list[dict], repeated: bool = True, enough: float = 0.8) -> str:
    """The path of a host's main slot, or nothing if no slot stands out.

    Slots lie between tags of nested classes that occur once a page. From the whole page inwards, the slot that has enough of the
    varying text of the one around it is taken: weighted characters less those of links and of template texts (on a host of few
    pages nothing is repeated enough to be one). An article is not parted.
    """
    constant: dict[str, int] = defaultdict(int)
    for c in nested if repeated else []:
        for t, n in zip(c["tokens"], c["chars"], strict=True):
            if t.startswith(TEXT):
                constant[t[1:].rpartition(TEXT)[0]] += n
    varies = {s["path"]: max(0, s["total"] - 2 * s["chars"] - constant[s["path"]]) for s in slots}
    tags = sorted({t.rstrip("/") for c in nested if c["once"] for t in c["tokens"] if not t.startswith(TEXT) and _tag(t.rstrip("/")) in CONTAINERS}, key=lambda t: (t.count("/"), t))
    held = {t: sum(n for p, n in varies.items() if p == t or p.startswith(f"{t}/")) for t in tags}
    root, rest = "", sum(varies.values())
    while _tag(root) != "article":
        inner = next((t for t in tags if t.startswith(f"{root}/") and held[t] and held[t] >= enough * rest), None)
        if inner is None:
            break
        root, rest = inner, held[inner]
    return "" if _tag(root) in ("", "html", "body") else root


TEMPLATES = "host string, host_pages long, classes array<struct<class_id:int,parent:int,pages:long,once:boolean,tokens:array<string>>>, fixed array<long>, skeleton array<long>, root string"


def slots_of(vectors: DataFrame, share: float) -> DataFrame:
    """host, path, total, chars of the paths of blocks that at least share of the host's pages have; what stands below rarer ones is added up
    as one path "*" below the nearest that is that frequent. So a host has no more than 1 / share times the paths of a page."""
    hosts = sized(vectors.where("token = ''").select(F.col("host").alias("h"), (F.col("pages") * share).alias("least_pages")), 100)
    frequent = vectors.join(hosts, F.col("host") == F.col("h"))
    tags = frequent.where("startswith(token, '/') and not endswith(token, '/') and pages >= least_pages").select(F.col("host").alias("h"), F.col("token").alias("tag"))
    told = frequent.where("startswith(token, '@')").select("host", F.expr("substring(token, 2)").alias("path"), "total", "chars")
    above = F.expr("transform(filter(sequence(1, length(path)), i -> substring(path, i, 1) = '/' AND i > 1), i -> substring(path, 1, i - 1))")
    each = told.select("*", F.explode(F.concat(F.array(F.lit("")), above, F.array("path"))).alias("prefix"))
    held = each.join(tags, (F.col("host") == F.col("h")) & (F.col("prefix") == F.col("tag")), "left").where("tag is not null or prefix = ''")
    nearest = held.groupBy("host", "path", "total", "chars").agg(F.max(F.struct(F.length("prefix"), "prefix")).alias("at"))
    place = F.when(F.col("at.prefix") == F.col("path"), F.col("path")).otherwise(F.concat("at.prefix", F.lit("/*")))
    return nearest.groupBy("host", place.alias("path")).agg(F.sum("total").alias("total"), F.sum("chars").alias("chars"))


def templates(pages: DataFrame, share: float = 0.5, least_pages: int = 3, names: DataFrame | None = None, salts: int = 32) -> DataFrame:
    """For each host: its nested classes; hashes of the texts in them; hashes of their tag paths; and the path of the main slot.
    On a host with fewer than least_pages pages no text counts as template. Of a host only what at least share of its pages have is gathered."""
    vectors = materialize(token_vectors(pages, stable_names(pages, share) if names is None else names, salts), "tokens")
    classes = equivalence_classes(vectors, share).groupBy("host", "host_pages").agg(F.collect_list(F.struct("class_vector", "pages", "once", "tokens", "chars", "valid")).alias("classes"))
    slots = slots_of(vectors, share).groupBy(F.col("host").alias("r")).agg(F.collect_list(F.struct("path", "total", "chars")).alias("slots"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                nested = nest(r["classes"])
                known = nested if r["host_pages"] >= least_pages else []
                sides = [t for c in known for t in c["tokens"] if t.startswith(TEXT) and c["pages"] >= least_pages], [t for c in known for t in c["tokens"] if not t.startswith(TEXT)]
                fixed, skeleton = (np.array(sorted({_hash(t) for t in side}), np.uint64).view(np.int64).tolist() for side in sides)
                own = [{k: c[k] for k in ("class_id", "parent", "pages", "once", "tokens")} for c in nested]
                rows.append((r["host"], r["host_pages"], own, fixed, skeleton, main_slot(nested, r["slots"] or [], bool(known))))
            if rows:
                shape = pa.struct([("class_id", pa.int32()), ("parent", pa.int32()), ("pages", pa.int64()), ("once", pa.bool_()), ("tokens", pa.list_(pa.string()))])
                types = [pa.string(), pa.int64(), pa.list_(shape), *[pa.list_(pa.int64())] * 2, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["host", "host_pages", "classes", "fixed", "skeleton", "root"])

    joined = classes.join(slots, F.col("host") == F.col("r"), "left").select("host", "host_pages", "classes", "slots")
    return joined.mapInArrow(fold, TEMPLATES)


def _in(token: str, hashes: frozenset[int]) -> bool:
    return (_hash(token) + (1 << 63)) % (1 << 64) - (1 << 63) in hashes


def main_text(page: Page, once: frozenset[str], fixed: frozenset[int], skeleton: frozenset[int], root: str) -> str:
    """The slots of a page that hold its article, by its host's template.

    These are the blocks in the main slot whose words are in no nested class, and headings that vary, occur once and stand before it in
    the slot around it. All stay if the template has each (copies of one page). Within the main slot, tags and names settle what the
    template leaves open: elements such as aside, form and footer hold no article, nor do readers' articles, which repeat, beside one that
    occurs once a page. An element only named like chrome is dropped where the template confirms it: it holds links
    or template words, or its name says nothing else and its path is in a nested class.

    A page without the main slot, or of a host without a template or one slot that stands out, is read by its tags alone: the
    blocks of its articles, else of its main element, else all that are no mere links, without template words.
    """

    def under(path: str) -> bool:
        return bool(root) and (root == path or root.startswith(f"{path}/"))

    def within(b: Block) -> bool:
        return b.node.path == root or b.node.path.startswith(f"{root}/")

    def taken(b: Block, marks: Marks) -> bool:
        return any(not under(path) and (b.links or only and (not skeleton or _in(path, skeleton)) or _in(text_token(b), fixed)) for path, only in marks)

    free = [b for b in page.blocks if not b.node.chrome and not taken(b, b.node.marks)]
    own = [b for b in free if within(b)] if root else []
    if own:
        first, around = page.blocks.index(own[0]), root.rpartition("/")[0]
        heads = [b for b in free if _tag(b.node.path) in HEADINGS and b.node.path in once and not b.links and not within(b) and page.blocks.index(b) < first]
        own = [b for b in heads if _tag(around) not in ("html", "body") and b.node.path.startswith(f"{around}/") or under(b.node.path.rpartition("/")[0])] + own
    else:
        sure, some = [b for b in free if b.node.sure], [b for b in free if b.node.article]
        doubtless = lambda of: [b for b in of if not b.node.doubt]
        likely = lambda of: [b for b in of if under(b.node.article) or not any(only for _, only in b.node.doubt)]
        own = doubtless(sure) or likely(sure) or doubtless(some) or likely(some)
    paths = {b.node.article for b in own if b.node.sure}
    if len(paths) > 1 and paths & once:
        own = [b for b in own if not b.node.sure or b.node.article in once]
    if not own:
        own = [b for b in free if not taken(b, b.node.doubt) and (not b.links or b.node.path in once)]
        return " ".join(b.words for b in own if not _in(text_token(b), fixed))
    return " ".join(b.words for b in ([b for b in own if not _in(text_token(b), fixed)] if fixed else []) or own)


def extract(pages: DataFrame, share: float = 0.5, least_pages: int = 3, salts: int = 32) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Names that a host's pages share are found first (see stable_names), then templates are deduced from all pages of each host (see
    templates); then each page's slots are read through its host's. Both are broadcast only if their counted bytes allow; otherwise pages are joined with them by host and a
    salt, so a host with a third of all pages is spread.
    Nulls: a null html is empty and gives an empty text; a null or odd url belongs to the host that its text names,
    at worst the empty one; a null page_id stays. Repeated rows are extracted each. An empty table gives no rows.
    A page of any length is parsed whole, in one worker. Other columns are not read.
    """
    names = stable_names(pages, share)
    made = materialize(templates(pages, share, least_pages, names, salts), "templates")
    brief = made.join(names, "host", "left").select("host", "names", F.flatten(F.transform(F.filter("classes", lambda c: c["once"]), lambda c: F.filter(c["tokens"], lambda t: ~t.startswith(TEXT)))).alias("once"), "fixed", "skeleton", "root")
    size = _bytes(brief, "once", "fixed", "skeleton") + _bytes(names, "names")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, tuple[frozenset, ...]] = {}
        for b in batches:
            texts = []
            for k, (site, root, text) in enumerate(zip(b.column("host").to_pylist(), b.column("root").to_pylist(), texts_of(b.column("html")), strict=True)):
                if site not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[site] = tuple(frozenset(b.column(c)[k].as_py() or ()) for c in ("names", "once", "fixed", "skeleton"))
                stable, *of_host = sets[site]
                texts.append(main_text(parse(text, stable), *of_host, root or ""))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    asked = pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("host"))
    joined = by_host(asked, brief, size, salts)
    out = joined.select("page_id", "url", "html", "host", "names", "once", "fixed", "skeleton", "root").mapInArrow(read, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

