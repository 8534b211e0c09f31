"""Main text of web pages: flat text blocks, classified by a decision tree on word counts and link densities.

A page becomes a flat list of blocks, cut at block-level tags. Each block has its words, its link density, those of the
blocks before and after it, and whether it stands in page furniture or in an article, by the names of the elements around it.
A small decision tree, trained on the blocks of the labelled pages below, tells main text from the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose boundaries end a block, whose content is never text, and that have no content.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul br".split()
)
HIDDEN_TAGS = frozenset("head iframe noscript object script select style svg template textarea title".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button".split())
#: Parts of classes and ids that name page furniture, those that name comments, and first parts that only say what an element has.
COMMENT_WORDS = frozenset("comment comments replies reply".split())
FURNITURE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert advertisement advertising advertorial adverts banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer header login "
    "masthead menu modal nav navbar navi navigation newsletter notice notices pagination popup promo promos promotion promotional related search share "
    "sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget".split()
)
STATE_WORDS = frozenset("has hide is no not show with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PARTS = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int = 0
    link_words: int = 0
    furniture: bool = False
    article: bool = False
    heading: bool = False
    named: tuple[int, ...] = ()


@dataclass
class Named:
    """An element whose class or id names furniture: what it holds tells whether it is furniture or a wrapper of the page."""

    comments: bool
    headed: bool = False
    paragraphs: int = 0
    words: int = 0


def _furniture_words(attributes: dict[str, str]) -> set[str]:
    """The furniture words among the parts of an element's class tokens and id."""
    found: set[str] = set()
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = _PARTS.split(token)
        if parts[0] not in STATE_WORDS:
            found |= FURNITURE_WORDS.intersection(parts)
    return found


def _settle(page: list[Block], elements: list[Named]) -> list[Block]:
    """Marks the blocks of furniture by name. An element with most of the page's words and its text is a wrapper instead."""
    total = sum(b.words for b in page)
    for b in page:
        for k in b.named:
            elements[k].words += b.words
    plain = any(not b.furniture and not b.named for b in page)

    def wrapper(e: Named) -> bool:
        return 2 * e.words > total and (e.headed or (not e.comments and e.paragraphs > 0 and (e.paragraphs > 1 or not plain)))

    for b in page:
        b.furniture |= any(not wrapper(elements[k]) for k in b.named)
    return page


def blocks(html: str) -> list[Block]:
    """The non-empty text blocks of a page in page order. Unclosed elements end with the elements around them."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, bool, tuple[int, ...]]] = []  # tag, hidden, furniture, article, named: each with what is around it
    elements: list[Named] = []
    around = lambda: stack[-1] if stack else ("", False, False, False, ())
    at = 0

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(p for p, _ in parts)).strip()
        if text:
            _, _, furniture, article, named = around()
            linked = sum(len(p.split()) for p, link in parts if link)
            out.append(Block(text, len(text.split()), linked, furniture, article, any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack), named))
        parts.clear()

    def add(raw: str) -> None:
        if raw and not (stack and stack[-1][1]):
            parts.append((unescape(raw), any(s[0] == "a" for s in stack)))

    def enter(tag: str, tail: str) -> None:
        attributes = {name.lower(): value.strip("\"'") for name, value in reversed(_ATTRIBUTE.findall(tail))} if "=" in tail else {}
        _, hidden, furniture, article, named = around()
        furniture |= tag in FURNITURE_TAGS or (tag == "header" and not article) or attributes.get("role", "").lower() in ROLES
        names = set() if tag in ("html", "body", "main") else _furniture_words(attributes)
        if names and tag != "article":
            named += (len(elements),)
            elements.append(Named(not COMMENT_WORDS.isdisjoint(names)))
        for k in named:
            elements[k].headed |= tag in ("main", "h1") or (tag == "article" and not names)
            elements[k].paragraphs += tag == "p"
        stack.append((tag, hidden or tag in HIDDEN_TAGS, furniture, article or tag in ("article", "main"), named))

    while at < len(html):
        found = _TOKEN.search(html, at)
        if not found:
            add(html[at:])
            break
        add(html[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            flush()
        if found[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                if any(s[0] in BLOCK_TAGS for s in stack[depth:]):
                    flush()
                del stack[depth:]
            continue
        if tag in VOID_TAGS:
            continue
        if tag == "p" or tag == "li":  # an open one ends where the next begins
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK_TAGS), None)
            if depth is not None and stack[depth][0] == tag:
                del stack[depth:]
        enter(tag, found[3] or "")
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            if tag in HIDDEN_TAGS:
                at = end.start() if end else len(html)
    flush()
    return _settle(out, elements)


FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "page_article", "heading")


def features(page: list[Block]) -> np.ndarray:
    """One row per block, columns as in ``FEATURES``; neighbours beyond the page's ends have no words."""
    words = np.array([b.words for b in page], dtype=float)
    density = np.array([b.link_words / max(1, b.words) for b in page])
    flag = lambda name: np.array([getattr(b, name) for b in page], dtype=float)
    before, after = (lambda x: np.r_[0.0, x[:-1]]), (lambda x: np.r_[x[1:], 0.0])
    any_article = np.full(len(page), float(any(b.article for b in page)))
    columns = [words, density, before(words), before(density), after(words), after(density), flag("furniture"), flag("article"), any_article, flag("heading")]
    return np.stack(columns, axis=1) if page else np.zeros((0, len(FEATURES)))


#: The labelled table: pages whose main blocks are those that begin with the word "main". Half of the pages name nothing, so that
#: words and links of a block and its neighbours have to tell.
LABELLED = (
    "<nav><a>home</a> <a>news</a></nav><article><h1>main title</h1><p>main text of several words that goes on for a while</p><p>main.</p></article><footer>&copy; all the usual words of a footer line here</footer>",
    "<div class=ad>buy these things now they are very cheap today</div><article><h1>main</h1><p>main <a>with a link</a></p><p><a>main all link</a></p></article>",
    "<ul><li><a>one</a></li><li><a>two</a></li></ul><div><p>main one two three four five six seven eight nine ten eleven twelve</p><p>main again with quite a few more words than a menu entry has</p></div><div class=footer>terms and privacy</div>",
    "<header>site name and slogan</header><main><p>main words</p><aside>read also these other stories</aside><p>main more words</p><form>sign up for our letter</form></main>",
    "<div id=cookie-notice>we use cookies to make this site work for you and others</div><div><h2>main heading</h2><p>main paragraph with enough words to count as text of the page</p><p>main last one with as many words as the one before it had</p></div><div class=comments><p>a reader wrote this long comment about the text above and liked it</p></div>",
    "<article><header><h1>main title</h1></header><p>main body that is a bit longer than the title is</p><div class=share>share this</div><section class=comments><p>first comment by a reader with a lot of words</p></section></article><div><a>next</a></div>",
    "<div><a>home</a></div><p>main text without an article element but with more than ten words in it</p><p>main text goes on here with yet another ten or more words</p><div><a>more</a> <a>links</a> <a>here</a></div>",
    "<body>main text right in the body of the page with more than ten words in all</body>",
    "<article><p>main</p></article><div>text outside of the article that is as long as a paragraph of it would be</div>",
    "<div>welcome to our site which has been here for many years and will stay</div><article><p>main words of it</p><p>main</p></article><div>some last words about us and our friends</div><div>and more</div>",
    "<div>a line above</div><main><h1>main</h1><p>main text that follows</p></main><div>other things that stand below the text of this page</div><p>and on</p>",
    "<ul><li><a>first story of the day and what it means</a></li><li><a>second story about something else</a></li></ul><p>main text of this page with a good number of words in it</p><p>main and <a>one link</a> among many other words of the page</p><ul><li><a>third story of another day</a></li></ul>",
    "<p>main first paragraph of a plain page that has many words</p><p>main second one of the same kind with many words too</p><p>main last one that ends the page with no footer at all</p>",
    "<div>contact</div><div>imprint</div><p>main text of a page that has short lines around it but is long itself</p><div>terms</div>",
    "<div><a>home</a></div><div><a>world</a></div><h1>main title of it</h1><p>main opening paragraph that has well over a dozen words to read in it</p><p>main yes</p><p>main closing paragraph that has well over a dozen words to read in it</p><div><a>older</a></div><div><a>newer</a></div>",
    "<div>Monday edition</div><div><a>sports</a></div><div>main long paragraph of the page that stands in a plain division with many words</div><div>main short one</div><div>main second long paragraph of the page that stands in a plain division with many words</div><div><a>all sports news of this long week in one place for you</a></div>",
    "<div><a>ten ways to cook rice that you have never tried at home</a></div><div><a>why cats sleep all day and what you can do about it</a></div><p>main report about the river that flooded the old town last night again</p><p>main witnesses said that <a>the bridge</a> had been closed hours before the water came</p><div><a>what to pack when you travel north in winter with children</a></div>",
    "<div>search</div><div><a>log in</a></div><p>main the council met on Tuesday and agreed on the plan for the school</p><p><a>main the full plan is here</a></p><p>main parents may send their remarks until the end of the month by post</p><div><a>jobs</a></div><div>phone</div>",
    "<table><tr><td><a>start</a></td><td><a>archive</a></td></tr></table><div>main a letter from the editor to everybody who has written to us this year</div><div>main thank you all.</div><div>main we read every line of them and will print the best ones in spring</div><table><tr><td><a>imprint</a></td><td>2019</td></tr></table>",
    "<ul><li><a>part one</a></li><li><a>part two</a></li></ul><p>main how to mend a puncture without taking the wheel off the bicycle at all</p><ol><li>main find the hole</li><li>main dry it well</li></ol><p>main then put the patch on and press it down for at least two minutes</p><ul><li><a>shops</a></li><li><a>forum</a></li></ul>",
    "<div>you are here: <a>home</a> <a>garden</a> <a>trees</a> <a>apple trees</a> <a>old apple trees of the north</a></div><p>main apple trees want light and a soil that does not stay wet in the winter</p><p>main cut them late in winter when the hard frost is over and buds are shut</p><div>see <a>pear trees and how to cut them</a> or <a>plum trees and their pests in summer</a></div>",
    "<div><a>a</a> | <a>b</a> | <a>c</a></div><div>last change 4 May</div><div><a>print</a></div><h2>main heading here</h2><p>main the museum opens its new wing in autumn with works from four countries in it</p><div><a>tickets</a></div><div>open daily</div><div><a>map</a></div>",
    "<p>main notes of a walk along the coast with a friend in the last week of May</p><p>main day one.</p><p>main we left the car at the church and followed the path to the lighthouse first</p><p>main day two.</p><p>main rain kept us in the hut until noon and then we went on to the harbour</p>",
    "<div><a>first page</a></div><p>main the recipe needs three eggs and a little flour and a pan that is hot</p><div><a>watch twenty short films in which our cook shows you every step of this</a></div><div><a>order the book with all the recipes of our cook at a low price today</a></div>",
    "<div>weather 12 degrees</div><div><a>radar</a></div><div>traffic is light</div><div><a>roads</a></div><p>main the minister said on Friday that the new line will not be built before spring</p><p>main critics call it late.</p><p>main work on the second station had been stopped twice for want of money and steel</p>",
    "<div>tags: <a>rivers</a> <a>floods</a> <a>towns</a> <a>bridges</a> <a>rain</a> <a>weather of the year</a></div><div>by our staff</div><div><a>follow</a></div><p>main this study followed nine hundred families for ten years and asked them the same questions</p><p>main its <a>tables</a> and <a>methods</a> are open to everyone who wants to read or check them</p>",
)


def patterned_pages() -> list[str]:
    """Labelled pages by rule. Those that mark their article have every pair of block kinds (words, linked or not) in it and around it.

    Others mark nothing: short blocks, linked or not, belong to the text between long ones and not to it among links.
    """

    def block(words: int, linked: bool, first: str) -> str:
        text = " ".join([first, *["word"] * (words - 1)])
        return f"<a>{text}</a>" if linked else text

    kinds = [(words, linked) for words in (1, 3, 8, 20, 60) for linked in (False, True)]
    page = "<nav>{}</nav><article><p>{}</p><p>{}</p></article><footer>{}</footer>".format
    marked = [page(block(*a, "other"), block(*a, "main"), block(*b, "main"), block(*b, "other")) for a in kinds for b in kinds]
    bare = "<div>{0}</div><div>{0}</div><p>{2}</p><p>{3}</p><p>{4}</p><div>{0}</div><div>{1}</div><div>{0}</div>".format
    for menu in (1, 3, 7, 12):
        for short, linked in ((w, x) for w in (1, 2, 4, 7, 12) for x in (False, True)):
            marked.append(bare(block(menu, True, "other"), block(2, False, "other"), block(20, False, "main"), block(short, linked, "main"), block(30, False, "main")))
    return marked


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10) -> tuple:
    """A decision tree by Gini impurity: a leaf is (share of main,), a split is (feature, threshold, low, high)."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return (share,)
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def train(pages: Iterable[str] = LABELLED) -> tuple:
    """The tree for labelled pages and ``patterned_pages``."""
    parsed = [blocks(p) for p in [*pages, *patterned_pages()]]
    x = np.concatenate([features(p) for p in parsed])
    y = np.array([float(b.text.startswith("main")) for p in parsed for b in p])
    return grow(x, y)


def classify(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree[0] >= 0.5


def main_text(html: str | None, tree: tuple) -> str:
    """The main blocks of a page, one per line. Null, empty and text-free pages give an empty text."""
    page = blocks(html or "")
    return "\n".join(b.text for b, row in zip(page, features(page)) if classify(tree, row))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Only page_id, url and html are read, so other columns may have any name. Rows without page_id or url and repeated rows are
    extracted each; whole pages are parsed however long. A block in a leaf of the tree with as many blocks of either kind is main text.
    An empty table gives no rows.
    """
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, EXTRACTED)
