"""Main text of web pages by block rules in two passes.

A page is cut into blocks at its block-level tags.  The first pass decides the clear ones:
blocks of a menu, header, footer, sidebar, notice, advert, form or comment section and blocks
made mostly of links are boilerplate; long blocks with the stop-word share of running prose
are text.  Everything else (short or without stop words) is ambiguous and, in the second
pass, inherits the label of the nearest decided neighbours: first of those in its own
section, then of those on the page.
"""

import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LONG_CHARS = 70  # a block from here on can be decided as text
STOP_SHARE = 0.3  # share of stop words in running prose, at least
SOME_STOP_SHARE = 0.15  # enough from LONGER_CHARS on
LONGER_CHARS = 200
LINK_SHARE = 0.5  # share of a block's characters in links, above: boilerplate

# fixed values: words of the languages, names of HTML, common names of page parts
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i in is it its not of on or that the their they this to was we were which with you
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne on ou par pas pour que qui sa se ses son sur un une
    aber als am auch auf aus bei das dem den der des die ein eine einer es für hat ich im ist mit nach nicht noch sich sie sind so und von war wie wird zu zum zur
    al como con del el era es esta está fue ha la las lo los más muy no o para pero por se si sin su sus también un una y ya
    """.split()
)
RAW = frozenset("script style noscript template textarea title svg math iframe object select datalist option button canvas audio video head".split())
RAW_TEXT = frozenset("script style textarea title iframe noscript".split())  # no tags inside
BLOCK = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTION = frozenset("article main".split())
PARTS = frozenset("nav footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = frozenset(
    """
    ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs byline-ad comment comments commentlist consent cookie cookies disclaimer
    disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup
    promo promoted promotion promotions recommended related remark replies reply respond responses share sharing sidebar sidenav signup skyscraper social
    sponsor sponsored subscribe subscription tagcloud teaser toc toolbar topbar widget widgets
    """.split()
)
CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option"})}

_TAG = re.compile(r"""<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))""")
_REST = re.compile(r"""(?:[^>"'=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>?""")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z]+")
_LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_]\w+")  # of the element's neighbours, not of itself


@dataclass(frozen=True)
class Block:
    text: str  # white space collapsed, trimmed, not empty
    section: int  # number of the article or main part that holds it, 0: none
    boilerplate: bool  # inside a part of the page that is none of its text
    link_chars: int


def _is_part(name: str, attributes: str, in_section: bool) -> bool:
    """Whether an element holds no main text, by its tag, role or names."""
    if name in PARTS or (name == "header" and not in_section):
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for m in _NAMED.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "main") and not NAMES.isdisjoint(_NAME.findall(_LAYOUT.sub("", value))):
            return True
    return False


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order, in one pass over its characters."""
    page = page or ""
    found: list[Block] = []
    open_tags: list[tuple[str, bool, bool, bool]] = []  # name, part, raw, section
    names: Counter[str] = Counter()  # of the open tags
    parts = raws = links = 0
    sections: list[int] = []
    made = 0
    pieces: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                link_text = "".join(html.unescape("".join(linked)).split()) if linked else ""
                found.append(Block(text, sections[-1] if sections else 0, parts > 0, len(link_text)))
            pieces.clear()
            linked.clear()

    def close(to: int) -> None:
        nonlocal parts, raws, links
        while len(open_tags) > to:
            name, part, raw, section = open_tags.pop()
            names[name] -= 1
            parts -= part
            raws -= raw
            links -= name == "a"
            if section:
                sections.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        upto = m.start() if m else end
        if upto > at and not raws:
            pieces.append(page[at:upto])
            if links:
                linked.append(page[at:upto])
        if not m:
            break
        if not m[2]:  # a comment or a declaration
            mark = "-->" if m[0] == "<!--" else ">"
            over = page.find(mark, m.end())
            at = end if over < 0 else over + len(mark)
            continue
        name = m[2].lower()
        rest = _REST.match(page, m.end())
        at = rest.end()
        block = name in BLOCK
        if m[1]:  # a closing tag
            if block:
                flush()
            elif name == "br":
                pieces.append(" ")
            if names[name]:  # an end tag of an element that is not open closes nothing
                for i in range(len(open_tags) - 1, -1, -1):
                    if open_tags[i][0] == name:
                        close(i)
                        break
                    if not block and (open_tags[i][0] in BLOCK and name != "a" or len(open_tags) - i > 512):
                        break
            continue
        if block:
            flush()
            while open_tags and open_tags[-1][0] in CLOSED_BY and name in CLOSED_BY[open_tags[-1][0]]:
                close(len(open_tags) - 1)
        elif name in ("br", "img", "wbr", "input"):
            if name != "wbr":
                pieces.append(" ")
        attributes = rest[0]
        if name in VOID or attributes.endswith("/>"):
            continue
        if name in RAW_TEXT:
            over = re.compile(f"</{name}[\\s/>]", re.IGNORECASE).search(page, at)
            at = over.start() if over else end
        if name == "a" and links:  # links do not nest
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == "a":
                    _, part, raw, _ = open_tags.pop(i)
                    names["a"] -= 1
                    parts, raws, links = parts - part, raws - raw, links - 1
                    break
        part, raw, section = _is_part(name, attributes, bool(sections)), name in RAW, name in SECTION
        if part and not block and pieces:
            flush()
        open_tags.append((name, part, raw, section))
        names[name] += 1
        parts += part
        raws += raw
        links += name == "a"
        if section:
            made += 1
            sections.append(made)
    flush()
    return found


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(block: Block) -> bool | None:
    """True: text, False: boilerplate, None: ambiguous."""
    if block.boilerplate or block.link_chars > LINK_SHARE * len(block.text.replace(" ", "")):
        return False
    n = len(block.text)
    if n >= LONG_CHARS and stop_share(block.text) >= (STOP_SHARE if n < LONGER_CHARS else SOME_STOP_SHARE):
        return True
    return None


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Ambiguous blocks inherit from the nearest decided neighbours.

    In an article or main part those are its own blocks: it keeps what is not boilerplate.
    Elsewhere the nearest decided block on the page counts, of two equally near ones the one
    that is text; a page without any decided block is text.
    """
    decided = [i for i, label in enumerate(labels) if label is not None]
    out = []
    for i, (block, label) in enumerate(zip(blocks, labels, strict=True)):
        if label is None:
            k = bisect_left(decided, i)
            near = decided[max(0, k - 1) : k + 1]
            least = min((abs(i - j) for j in near), default=0)
            label = bool(block.section) or not near or any(labels[j] for j in near if abs(i - j) == least)
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by a line feed; empty if there are none."""
    blocks = blocks_of(page)
    if any(b.section for b in blocks):
        # a page that marks its article has no text outside of it
        blocks = [b for b in blocks if b.section]
    labels = second_pass(blocks, [first_pass(b) for b in blocks])
    return "\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label)


def extracted(page: Column) -> Column:
    """struct(text, n_chars) of each whole page; null and empty pages, and those without main text, have an empty text."""

    @F.arrow_udf("text string, n_chars long")
    def extract(pages: pa.Array) -> pa.Array:
        texts = [main_text(p) for p in pages.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["text", "n_chars"])

    return extract(page.cast("string"))


def extract_pages(pages: DataFrame, page: str = "html") -> DataFrame:
    """All columns of ``pages`` but ``page``, with ``text`` and ``n_chars``; our columns win over clashing names.

    One row per row of the table, repeated rows and rows without an id included; an empty
    table gives no rows.
    """
    taken = {"text", "n_chars", page.lower()}
    with_text = pages.select(*(pages[f"`{c}`"] for c in pages.columns if c.lower() not in taken), extracted(pages[f"`{page}`"]).alias("text"))
    return with_text.select(*(f"`{c}`" for c in with_text.columns if c != "text"), "text.text", "text.n_chars")
