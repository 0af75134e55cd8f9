"""HTML extraction by consensus host paths.

Every page is parsed once to score its containers: a container's score is the text of its own paragraphs, less what its
links hold. Containers are named by their generalised path of tags and classes (numbers in names become one sign), and each
page votes for them with their shares of the page's text. Spark sums the votes by host and path and takes each
host's winning path; then every page is extracted from the winning path's containers, or the articles these lie in. A page that has none of them is
extracted from its articles, else its main elements, else its own best container.

Blocks of the article are its block elements' texts: character references decoded, white space inside a block one space,
trimmed, joined by a newline in page order. Navigation, headers and footers of the page, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out, by their tag or role, or by a class or id of which every word is one of such
parts or says nothing (`cookie-bar` goes, `menu-review` stays).

Defined results: null, empty and text-free pages give an empty text; pages without containers give the text of their body;
unclosed tags end with their parent; tags that never end are text; broken, deep and very long markup costs no more than its
length; pages of one host may be any share of all rows, as votes are summed before they are
shuffled; a page without a host forms the host "". Extra columns are ignored, repeated rows repeat their result.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsplit.llm.common import slices
from tabsplit.shared import written

# Fixed names of HTML: elements without content, with raw text, that begin a block, and that close an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe button select option input textarea svg object embed canvas dialog menu head title label fieldset legend".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup modal overlay"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar side aside rail widget related recommended recommendations share sharing social"
    " comment comments commentlist reply replies respond discussion disqus footer foot masthead toolbar subscribe newsletter signup login search copyright legal skip tags toc".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div main".split())

# Words that say nothing by themselves: a class that joins them to noise words is noise, any other word makes it content.
HELPERS = frozenset(
    "site main page global top bottom left right box boxes block blocks bar bars list lists item items link links button buttons btn wrap wrapper container area section slot unit inner outer content"
    " col column row primary secondary small large mobile desktop sticky fixed js the in and icon icons widget widgets js posts post stories articles news form field fields text body head".split()
)

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.DOTALL)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN_END = re.compile(r"[^>\"']*>")
SPECIAL = re.compile(r"[>\"']")
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACES = re.compile(r"\s+")


class Node:
    """An element with its path, what it holds in order (text or nodes), whether it is noise, and whether it is an article's."""

    __slots__ = ("tag", "path", "parts", "noise", "block", "inside")

    def __init__(self, tag: str, path: str, noise: bool, inside: bool):
        self.tag, self.path, self.noise, self.block, self.inside, self.parts = tag, path, noise, tag in BLOCK, inside, []


class Ends:
    """Where the tags of a page end: at the first `>` outside quotes.

    Most tags have no quoted `>`, which one look tells. Else the page's quotes and `>` are gone through once from the end, and
    each is told where a tag ends that reaches it outside quotes, so that a page of tags that never end costs no more.
    """

    def __init__(self, page: str) -> None:
        self.page, self.at, self.ends = page, None, []

    def of(self, start: int) -> int:
        """The place of the `>` that ends a tag whose name ends at start; -1 if none does."""
        if m := PLAIN_END.match(self.page, start) if self.at is None else None:
            return m.end() - 1
        if self.at is None:
            self.at = [m.start() for m in SPECIAL.finditer(self.page)]
            self.ends = [-1] * (len(self.at) + 1)
            inside = {'"': -1, "'": -1}
            for k in range(len(self.at) - 1, -1, -1):
                c, after = self.page[self.at[k]], self.ends[k + 1]
                if c == ">":
                    self.ends[k] = self.at[k]
                else:
                    # a quote opens here for tags that come outside quotes, and closes for those inside
                    self.ends[k], inside[c] = inside[c], after
        return self.ends[bisect_left(self.at, start)]


def digested(path: str) -> str:
    """A path, with what is far above told by a digest: nesting costs no more the deeper it is."""
    return path if len(path) <= 1000 else "/" + hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest()


def is_noise(name: str) -> bool:
    """Whether all words of a class or id are noise words or say nothing, and one is a noise word."""
    words = set(WORDS.findall(CAMEL.sub(" ", name).lower()))
    return bool(words & NOISE_WORDS) and words <= NOISE_WORDS | HELPERS


def described(tag: str, told: str) -> tuple[str, bool]:
    """The element's general name, and whether its tag, class, id or role says that it isn't the article's text."""
    if not told or told.isspace():
        return tag, tag in NOISE_TAGS
    names = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(told)}
    noise = tag in NOISE_TAGS or "hidden" in names or names.get("aria-hidden", "").lower() == "true" or names.get("role", "").lower() in NOISE_ROLES
    if tag not in ("html", "body", "article", "main"):
        noise = noise or any(map(is_noise, [*names.get("class", "").split(), names.get("id", "")]))
    general = ".".join(sorted(re.sub(r"\d+", "#", x) for x in names.get("class", "").split()))
    return f"{tag}.{general}" if general else tag, noise


def parse(page: str) -> Node:
    """The page's tree; end tags without a start are passed over, open ones end with their parent; a tag that never ends is text."""
    root = Node("", "", False, False)
    stack, at, ends = [root], 0, Ends(page)
    open_: Counter[str] = Counter()

    def cut(k: int) -> None:
        for node in stack[k:]:
            open_[node.tag] -= 1
        del stack[k:]

    seen = 0
    while (start := page.find("<", seen)) >= 0:
        m = MARKUP.match(page, start)
        name = None if m else NAME.match(page, start)
        end = m.end() if m else ends.of(name.end()) + 1 if name else 0
        if not end:
            seen = start + 1
            continue
        if start > at:
            stack[-1].parts.append(page[at:start])
        at = seen = end
        if m:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, told = name[2].lower(), page[name.end() : end - 1]
        if name[1]:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    cut(k)
                    break
                if stack[k].tag in SCOPES and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK and open_["p"]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p" or stack[k].tag in SCOPES), 0)
            if k and stack[k].tag == "p":
                cut(k)
        if any(open_[x] for x in CLOSED_BY.get(tag, ())):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY[tag]:
                    cut(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        general, noise = described(tag, told)
        inside = open_["article"] + open_["main"] > 0
        node = Node(tag, digested(f"{stack[-1].path}/{general}"), noise or (tag == "header" and not inside), inside or tag in ("article", "main"))
        stack[-1].parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = seen = close.end() if close else len(page)
        elif tag not in VOID and not told.endswith("/"):
            stack.append(node)
            open_[tag] += 1
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


def blocks(top: Node) -> list[str]:
    """The texts of the blocks under a node, without noise."""
    found, held = [], []

    def close() -> None:
        text = SPACES.sub(" ", html.unescape("".join(held))).strip()
        if text:
            found.append(text)
        held.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append(" ")
        elif not x.noise or x is top:
            if x.block:
                close()
                todo.append(None)
            todo.extend(reversed(x.parts))
    close()
    return found


def containers(root: Node) -> list[Node]:
    """Containers outside noise, in page order."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not x.noise:
            if x.tag in CONTAINERS:
                found.append(x)
            todo.extend(reversed(x.parts))
    return found


def own_text(node: Node) -> tuple[int, int]:
    """Letters in the node's paragraphs that no container inside it holds, and letters of links among them."""
    text, links, todo = 0, 0, [(x, False) for x in node.parts]
    while todo:
        x, link = todo.pop()
        if isinstance(x, str):
            n = len(x.strip())
            text, links = text + n, links + n * link
        elif not x.noise and x.tag not in CONTAINERS:
            todo.extend((y, link or x.tag == "a") for y in x.parts)
    return text, links


def scored(page: str) -> list[tuple[str, float]]:
    """The page's container paths from the best on, each with its share of the page's text; article and main elements count double."""
    scores: dict[str, float] = {}
    for node in containers(parse(page)):
        text, links = own_text(node)
        weight = (text - 2 * links) * (2.0 if node.inside else 1.0)
        if weight > 0:
            scores[node.path] = scores.get(node.path, 0.0) + weight
    total = sum(scores.values())
    return [(path, value / total) for path, value in sorted(scores.items(), key=lambda x: (-x[1], x[0]))]


def widened(root: Node, chosen: list[Node]) -> list[Node]:
    """The chosen containers in page order, each as the article that it lies in, so that an article's other parts are not lost;
    where there is none and it has no heading of its own, as the least element around it that has the first one."""
    wanted, found, todo, above = {id(x) for x in chosen}, [], [(root, None)], {}
    headed: set[int] = set()
    while todo:
        x, article = todo.pop()
        if isinstance(x, Node):
            article = x if x.tag == "article" else article
            if x.tag == "h1" and not x.noise:
                up = x
                while up is not None and id(up) not in headed:
                    headed.add(id(up))
                    up = above.get(id(up))
            if id(x) in wanted:
                found.append((x, article))
            todo.extend((y, article) for y in reversed(x.parts))
            above.update((id(y), x) for y in x.parts if isinstance(y, Node) and not x.noise)
    out = []
    for x, article in found:
        up = x
        while article is None and up is not None and id(up) not in headed:
            up = above.get(id(up))
        out.append(article or (up if up is not None and up.tag not in ("", "html", "body") else x))
    return out


def extract(page: str, path: str | None) -> str:
    """The text of the winning path's containers, with what lies in them; articles and main elements stand in where there are none."""
    root = parse(page)
    found = containers(root)
    chosen = widened(root, [x for x in found if path and x.path == path])
    chosen = chosen or [x for x in found if x.tag == "article"] or [x for x in found if x.tag == "main"]
    if not chosen:
        own = scored(page)
        chosen = [x for x in found if own and x.path == own[0][0]] or [root]
    seen: set[int] = set()
    parts = []
    for node in chosen:
        if id(node) not in seen:
            parts += blocks(node)
            todo = [node]
            while todo:
                x = todo.pop()
                if isinstance(x, Node):
                    seen.add(id(x))
                    todo.extend(x.parts)
    return "\n".join(parts)


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and its winning path: most summed votes, then the first path in order."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = [(host, path, share) for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True) for path, share in scored(page or "")]
            if rows:
                hosts, paths, shares = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())], ["host", "path", "share"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path string, share double")
    # shares in whole millionths, so that sums don't depend on their order
    summed = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    return summed.withColumn("place", first).where("place = 1").select("host", "path")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of pages (page_id, url, html)."""
    named = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    # a written table's size is known, so that Spark broadcasts it if it is small and shuffles no page then
    joined = named.join(written(winning_paths(named), "paths"), "host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [extract(page or "", path) for page, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
