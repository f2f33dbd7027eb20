"""Main text of web pages by block rules in two passes.

A tolerant scanner cuts a page into text blocks at block-level tags.  The first
pass decides each block from its container, link density, length and density of
stop words; short or middling blocks stay undecided.  In the second pass these
take the label of the nearest decided neighbour.

A page that marks its article (article, main) is only read there, and a block
inside counts as text unless its links or its container speak against it: then
only blocks with many links are decided as clutter by their figures.  A page
without such marks is judged by the figures alone.

A row stays in its task: no shuffle.  Nulls: null html counts as empty, null
url stays null.  Pages without text give an empty string.  An empty table gives
no rows.  Extra columns are ignored; repeated rows stay.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from linescope.llm.storage import python_tasks

# HTML's own element kinds.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style noscript template textarea select option iframe object svg math canvas audio video title".split())
CLUTTER_TAGS = frozenset("nav footer aside form menu dialog button fieldset search".split())
MARKED_TAGS = frozenset(("article", "main"))
CLUTTER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Parts of class and id names that say clutter.
CLUTTER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager sidebar sidebars widget widgets related recommended recommendations trending "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "paywall share sharing social comment comments commentlist disqus respond reply replies footer masthead toolbar skip "
    "hidden toc search".split()
)
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one "
    "you were her all she there would their we him been has when who will no if out so what up "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch "
    "le la les de des du et un une que qui dans pour pas sur au par avec ce il est plus se en sont ou son sa ses mais aux "
    "comme cette été leur nous vous elle ne "
    "el los las del y que una por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre "
    "ser también me hasta hay donde quien desde todo".split()
)

SHORT, LONG = 70, 200  # characters
LOW, HIGH = 0.30, 0.32  # density of stop words
MAX_LINKS = 0.33  # share of a block's characters inside links

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[A-Za-z!?][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_NAME = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in ("script", "style", "textarea", "title", "iframe", "noscript")}


class Block:
    __slots__ = ("text", "links", "clutter", "marked")

    def __init__(self, text: str, links: int, clutter: bool, marked: int):
        self.text, self.links, self.clutter, self.marked = text, links, clutter, marked


def is_clutter(tag: str, rest: str, marked: bool) -> bool:
    """Whether an element's name, role, class or id says that it is no text."""
    if tag in CLUTTER_TAGS or tag == "header" and not marked:
        return True
    if not rest:
        return False
    for found in _NAME.finditer(rest):
        name, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in CLUTTER_ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and not CLUTTER_NAMES.isdisjoint(_PART.findall(value)):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order, with white space settled."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, skipped, clutter, number of the marked element
    open_at: dict[str, list[int]] = {}  # places in the stack, by tag
    pieces: list[str] = []
    skipped = clutter = False
    marked = count = links = depth = breaks = 0

    def close() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, min(links, len(text)), clutter, marked))
            pieces.clear()
        links = 0

    def leave(place: int) -> None:
        """Close the element at a place of the stack and all inside of it."""
        nonlocal skipped, clutter, marked
        _, skipped, clutter, marked = stack[place]
        for name, *_ in stack[place:]:
            open_at[name].pop()
        del stack[place:]

    def add(raw: str) -> None:
        nonlocal links, breaks
        if skipped or not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if not text.isspace():
            breaks = 0
        if depth:
            links += len("".join(text.split()))

    place = 0
    while True:
        token = _TOKEN.search(page, place)
        if not token:
            break
        add(page[place : token.start()])
        place = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                close()
            elif not skipped:
                pieces.append(" ")
            continue
        if tag == "a":
            depth = 0 if token["end"] else 1
        elif tag == "hr":
            close()
        held = tag in BLOCK_TAGS or tag in SKIPPED_TAGS or tag in ("div", "section", "span")
        if tag in VOID_TAGS or not held:
            continue
        if tag in BLOCK_TAGS:
            close()
            breaks = 0
        if token["end"]:
            depth = 0 if tag in BLOCK_TAGS else depth
            if not open_at.get(tag):
                continue
            k = open_at[tag][-1]
            if tag in ("p", "li", "span") and any(open_at.get(name) and open_at[name][-1] > k for name in MARKED_TAGS):
                continue
            if tag not in BLOCK_TAGS and clutter != stack[k][2]:
                close()
            leave(k)
            continue
        if token["rest"].endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            leave(len(stack) - 1)
        ended = _RAW_END.get(tag)
        if ended:
            tail = ended.search(page, place)
            place = tail.end() if tail else len(page)
            continue
        bad = is_clutter(tag, token["rest"], bool(marked))
        if bad and not clutter and tag not in BLOCK_TAGS:
            close()
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, skipped, clutter, marked))
        skipped = skipped or tag in SKIPPED_TAGS or tag == "head"
        clutter = clutter or bad
        if tag == "body":
            skipped = False
        if tag in MARKED_TAGS and not marked and not clutter:
            count += 1
            marked = count
    add(page[place:])
    close()
    return found


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(word.strip(".,;:!?\"'()[]{}«»„“”…*#$%&|<>-") in STOP_WORDS for word in words) / len(words)


def first_pass(block: Block) -> bool | None:
    """True for text, False for clutter, None where the figures do not decide."""
    if block.clutter:
        return False
    size = len(block.text)
    if block.links > MAX_LINKS * size:
        return False
    if block.marked:
        return True if size >= SHORT and stop_density(block.text) >= LOW else None
    if "©" in block.text:
        return False
    if size < SHORT:
        return False if block.links else None
    density = stop_density(block.text)
    if density >= HIGH and size > LONG:
        return True
    return None if density >= LOW else False


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided neighbour, at
    equal distance text where the article is marked, else clutter.  Inside a
    marked article containers known as clutter are no neighbours, and with none
    decided a block is text."""
    count = len(blocks)
    left: list[int | None] = [None] * count
    right: list[int | None] = [None] * count
    for order, side in ((range(count), left), (range(count - 1, -1, -1), right)):
        near = None
        for k in order:
            if labels[k] is not None and not (blocks[k].marked and blocks[k].clutter):
                near = k
            elif labels[k] is None:
                side[k] = near
    out = []
    for k, label in enumerate(labels):
        if label is None:
            near = [j for j in (left[k], right[k]) if j is not None and blocks[j].marked == blocks[k].marked]
            marked = blocks[k].marked > 0
            if not near:
                label = marked
            else:
                least = min(abs(j - k) for j in near)
                votes = [labels[j] for j in near if abs(j - k) == least]
                label = any(votes) if marked else all(votes)
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if any(block.marked for block in blocks):
        blocks = [block for block in blocks if block.marked]
    labels = second_pass(blocks, [first_pass(block) for block in blocks])
    return "\n\n".join(block.text for block, label in zip(blocks, labels) if label)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    python_tasks(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
