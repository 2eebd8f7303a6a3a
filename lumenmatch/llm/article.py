"""Main text of web pages: the best-scoring stretch of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmatch.llm.arrow import fields, map_batches

#: Element names by their role in HTML; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg title textarea canvas select button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
LISTS = frozenset("dl ol ul".split())
CONTAINERS = frozenset("article aside body details dialog div fieldset footer form header main menu nav section table td".split())
#: Elements that an opening tag of the same group ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements and roles that are not the article, words of class or id that speak against it, and words that speak for it.
DROPPED_TAGS = frozenset("nav aside footer form menu dialog head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent footer gdpr notice alert popup modal overlay comment comments commentlist disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe signup login search pagination pager widget toolbar skip".split()
)
ARTICLE_WORDS = frozenset("article content entry post".split())
#: Words counted in favour of and against a container before any page is seen; AGAINST in one whose names speak against it.
PRIOR = {"article": (30.0, 1.0), "main": (30.0, 1.0)}
AGAINST = (1.0, 30.0)
NEUTRAL = (3.0, 2.0)
#: What a tag costs, the bounds of a word's score, and how many kinds of containers a model holds.
TAG_COST, BOUND, KINDS = 0.02, 3.0, 2000
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


class Block:
    """Text of one block: its kind of container (with ``~`` and words, if names speak against it), whether it stands in the
    article by mark-up, and tags before it."""

    __slots__ = ("text", "kind", "inside", "tags")

    def __init__(self, text: str, kind: str, inside: bool, tags: int):
        self.text, self.kind, self.inside, self.tags = text, kind, inside, tags


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def _dropped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED_TAGS or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if attributes.get("role", "").lower() in DROPPED_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    tokens = attributes.get("class", "").split()
    words = {w.lower() for t in (*tokens, attributes.get("id", "")) for w in _NAME.findall(t)}
    if "header" in words and not in_article and not words & ARTICLE_WORDS:
        return True
    return in_article and tag in CONTAINERS | LISTS and any(t.lower() in DROPPED_WORDS for t in tokens)


def _against(attributes: dict[str, str], in_main: bool) -> str:
    """Words of class or id that speak against an element outside an article; nothing if another of its names speaks for it.

    Within main a name must be such a word as a whole.
    """
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    split = [{n.lower()} if in_main else {w.lower() for w in _NAME.findall(n)} for n in names]
    if any(w & ARTICLE_WORDS and not w & DROPPED_WORDS for w in split):
        return ""
    return ".".join(sorted(set().union(*split) & DROPPED_WORDS)) if split else ""


def blocks(page: str) -> tuple[list[Block], bool]:
    """Blocks of a page outside dropped elements, in order, and whether the page marks its article itself.

    Missing end tags are supplied; an article that opens inside a dropped element ends that element, so that a menu without an
    end doesn't hide the page.
    """
    out: list[Block] = []
    # tag, kind of container, dropped, 1 in main and 2 in an article, words against it
    outside = ("", "body", False, 0, "")
    stack: list[tuple[str, str, bool, int, str]] = []
    in_main: list[Block] = []
    held: list[str] = []
    tags, marked, at = 0, 0, 0

    def flush() -> None:
        nonlocal tags
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            top = stack[-1] if stack else outside
            out.append(Block(text, f"{top[1]}~{top[4]}" if top[4] else top[1], top[3] > 0, tags))
            if top[3] == 1 and top[4]:
                in_main.append(out[-1])
            tags = 0

    def pop(keep: int) -> None:
        while len(stack) > keep:
            if stack[-1][0] in BLOCKS:
                flush()
            stack.pop()

    while True:
        m = _TOKEN.search(page, at)
        if not (stack and stack[-1][2]):
            held.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        if m[1] is None:
            continue
        tag, closing = m[1].lower(), m[0][1] == "/"
        tags += 1
        if closing:
            if tag in BLOCKS:
                flush()
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if place is not None and not (tag in ("p", "li") and any(s[0] in CONTAINERS for s in stack[place + 1 :])):
                pop(place)
            continue
        if tag == "br" or tag in ("td", "th"):
            held.append(" ")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at) if not m[0].endswith("/>") else None
            at = end.end() if end else (len(page) if tag in ("script", "style", "title", "textarea") and not m[0].endswith("/>") else at)
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in CONTAINERS), None)
            if place is not None and stack[place][0] == "p":
                pop(place)
        if tag in VOID or m[0].endswith("/>"):
            continue
        if tag in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    pop(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table") or stack[i][0] in CONTAINERS - {"td"}:
                    break
        parent = stack[-1] if stack else outside
        if tag in ("article", "main", "body") and parent[2]:
            first = next(i for i, s in enumerate(stack) if s[2])
            if tag == "body" or stack[first][0] not in ("form",) and "comment" not in stack[first][1]:
                pop(first)
                parent = stack[-1] if stack else outside
        attributes = _attributes(m[2])
        dropped = parent[2] or _dropped(tag, attributes, parent[3] > 0)
        level, against = parent[3], parent[4]
        if tag in ("article", "main", "body"):
            if not dropped and "comment" not in against:
                level, against = max(level, ("body", "main", "article").index(tag)), ""
        elif tag in CONTAINERS | LISTS and level < 2 and not against:
            against = _against(attributes, level == 1)
        marked = max(marked, level)
        kind = parent[1]
        if tag in CONTAINERS:
            words = sorted({w.lower() for w in _NAME.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")})
            kind = ".".join([tag, *words[:4]])
        stack.append((tag, kind, dropped, level, against))
    flush()
    if marked == 2:  # comments and the like in main, outside the article proper
        for b in in_main:
            b.inside = False
    return out, marked > 0


def weight(content: float, other: float, kind: str) -> float:
    """Score of a word in a kind of container, from the words seen inside and outside of articles."""
    before = AGAINST if "~" in kind else PRIOR.get(kind.split(".")[0], NEUTRAL)
    return max(-BOUND, min(BOUND, math.log((content + before[0]) / (other + before[1]))))


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the stretch with the largest sum, in one scan; of equal ones the first and shortest. (0, 0) if no sum
    is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best region, joined by line breaks."""
    found, _ = blocks(page)
    scores = [len(b.text.split()) * weights.get(b.kind, weight(0, 0, b.kind)) - TAG_COST * min(b.tags, 20) for b in found]
    # what its names speak against, and no page seen for, parts no region
    scores = [max(s, 0.0) if "~" in b.kind else s for b, s in zip(found, scores)]
    start, end = best_region(scores)
    return "\n".join(b.text for b, s in zip(found[start:end], scores[start:end]) if s > 0)


def learn_weights(pages: DataFrame, kinds: int = KINDS) -> dict[str, float]:
    """Word scores by kind of container, from all pages that mark their article (article or main element).

    Words are counted per batch and summed with partial results; the model holds the ``kinds`` most frequent kinds (a bound
    of its size; others keep the prior score), so it may be sent to the tasks.
    """

    def work(batch) -> Iterator[dict]:
        content, other = Counter(), Counter()
        for page in batch.column("html").to_pylist():
            found, marked = blocks(page or "")
            if marked:
                for b in found:
                    (content if b.inside else other)[b.kind] += len(b.text.split())
        names = sorted(content.keys() | other.keys())
        if names:
            yield {"kind": names, "content": [content[k] for k in names], "other": [other[k] for k in names]}

    counted = map_batches(pages.select("html"), T.StructType.fromDDL("kind string, content long, other long"), work)
    summed = counted.groupBy("kind").agg(F.sum("content").alias("content"), F.sum("other").alias("other"))
    rows = summed.orderBy((F.col("content") + F.col("other")).desc(), "kind").limit(kinds).collect()
    return {r["kind"]: weight(r["content"], r["other"], r["kind"]) for r in rows}


def extract_articles(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), weights: dict[str, float] | None = None) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of every page (html).

    A page is a row of blocks. Scripts, styles, forms, menus, headers (outside an article), footers and sidebars are dropped by
    element or role; within an article or main also containers and lists (not headings, paragraphs or spans) with a class that
    is as a whole a word for adverts, notices, comments and the like. Elsewhere such words in class or id of a container are
    part of its kind, which scores little unless pages tell otherwise. A word of a block scores what ``weights``
    (default: learnt from all pages) give its kind of container, a tag costs a little, and the contiguous blocks with the
    largest sum are the text, less blocks among them that score nothing.

    Defined cases: null, empty and textless pages give an empty text; repeated rows give equal texts; an empty table gives no
    rows. Other columns are ignored.
    """
    known = pages.sparkSession.sparkContext.broadcast(learn_weights(pages) if weights is None else weights)

    def work(batch) -> Iterator[dict]:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(x or "", known.value) for x in part.column("__html").to_pylist()]
            yield {**{k: part.column(k) for k in keep}, "text": texts, "n_chars": list(map(len, texts))}

    return map_batches(pages.select(*keep, F.col("html").alias("__html")), fields(pages, keep, "text string, n_chars long"), work)
