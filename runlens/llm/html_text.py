"""Main text of web pages: the maximum-scoring contiguous region of words and tags, with weights from labelled pages.

A page becomes a sequence of items: runs of words and tags. A word scores positive, a tag negative; a linear scan finds the
contiguous region with the largest sum. How much each kind counts is learned: pages that mark their own article (exactly one
<article>, or one <main> and no <article>) are labels, and the weight of an item kind is the log-odds of standing inside
rather than outside the marked element (counts over all items of such pages, those of menus, adverts and footers stand outside;
one row per kind, and kinds are a fixed list of tag names), drawn towards a prior weight where a kind is rare. Words are
clipped to +0.2 .. +2 and tags to -3 .. -0.01, as the method wants.

The scan goes over the whole page, whether it marks an article or not: of several articles, and of articles beside other text, those
parts are joined whose words outweigh the tags between them. The region then grows to the whole of the innermost <article>,
<main>, <section>, <div> or <td> that holds it (an article is not divided), so that lists of few words at its ends or in its midst
cost no text. Parts that are never main text (menus, adverts, forms, reader comments ..., known by tag, by role or by an unambiguous class or id)
give no words, neither to the score nor to the text; their tags cost a little, so that the region may span an advert in
mid-article. Elements whose class or id only hints at a side matter (related, search, notice ...) score a little below zero outside a marked
article and are left to the scan; inside one those that name a box (newsletter, related, sidebar, sponsored ...; no headings, no
sections) are left out, the others are text like any other. A name counts if all its parts are
such words or words of layout ("related-posts", not "related-work"); ids of headings, paragraphs and sections are titles and
do not count, but for lists of comments. Inside the region, blocks are the runs of text between block-level tags (a script or label in mid-sentence ends none); white space inside a block becomes one space, character references are decoded, blocks are joined
by one line feed. Should class and id names rule out every word of a page, they are not believed.

Defined cases: null or blank html gives an empty text; a page without any words outside excluded parts too; unclosed and
misnested tags follow the open-element stack (a closing tag without an open one is ignored); of equal regions the first wins;
repeated rows are extracted alike; an empty table gives an empty result; without labelled pages the prior weights
hold; other columns pass through `extract`, whatever their names (its own are `main_text` and `main_chars`).
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import extended, mapped, slices, table

#: Elements by role in HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg annotation annotation-xml iframe object canvas select head".split())
BLOCK = frozenset(("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search "
                   "section summary table tbody td tfoot th thead tr ul").split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr button input").split())
DROPPED = frozenset("nav footer aside form menu dialog button input select label fieldset search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                          "toolbar tablist".split())
#: Words in class or id that name parts which are not main text: without doubt, or perhaps.
COMMENTS = frozenset("comment comments commentlist disqus".split())
SURE = COMMENTS | frozenset(("ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsbygoogle cookie cookies consent "
                             "gdpr share sharing").split())
HINTS = frozenset(("banner sponsor sponsored promo promotion nav navbar navigation navi menu menubar topbar breadcrumb breadcrumbs "
                   "pagination pager toc sidebar side aside widget widgets rail footer foot masthead header topnav reply "
                   "replies respond discussion notice notices notification alert popup modal overlay "
                   "newsletter newsletters subscribe signup login social responses related recommended recommendations "
                   "teaser teasers tags tagcloud toolbar search skip copyright legal disclaimer paywall dialog form").split())
#: Those of them that name a box beside the text even inside a marked article.
BOXES = frozenset("sponsor sponsored promo promotion sidebar newsletter newsletters subscribe signup related recommended recommendations".split())
#: Words that say where or in what shape such a part stands; a name with any other word speaks of something else.
LAYOUT = frozenset(("bar bars box boxes block blocks button buttons slot slots unit list lists item items link links area container wrapper wrap "
                    "inner outer content section panel group row column col left right top bottom middle center main page site post posts "
                    "article articles story stories news entry user reader google js the and this primary secondary global mobile desktop "
                    "sticky fixed large small wide body icons icon thread div wp gpt dfp leaderboard skyscraper mpu zone space placeholder").split())
#: Names of an <article> that is not the one of the page.
OTHER = COMMENTS | {"teaser", "teasers", "related"}
#: Elements whose id is a title of text.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TITLED = HEADINGS | {"p", "section"}
SUSPECT = 2
ARTICLE = frozenset(("article", "main"))
#: Elements that hold text as a whole.
HOLDERS = frozenset(("section", "div", "td"))
#: Start tags that end an open paragraph; item tags end their like.
ENDS_P = BLOCK - {"body", "html", "br", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "legend", "summary"}
ENDS_LIKE = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)),
             "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "option": ("option", ("select",))}
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: What ends a tag, or begins a quoted value in it; other quotes inside tags mean nothing.
STOP = re.compile(r">|=\s*([\"'])")
#: One attribute: a name and perhaps a value, quoted or not; a quote that never closes reaches the end of the tag.
ATTRIBUTE = re.compile(r"([^\s/=][^\s/=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|(\S*)))?")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
KINDS = tuple(sorted(BLOCK | INLINE)) + ("other",)
KNOWN = frozenset(KINDS)
#: Weights before any label, and how many counted items they are worth.
PRIOR = {"word": 1.0, "tag": -0.1, "dropped": -0.05, "suspect": -0.2, **dict.fromkeys(("<article", "</article", "<main", "</main"), -3.0)}
BELIEF = 50
#: Names like "has-sidebar" or "no-comments" speak of the page, not of the element.
ABOUT = re.compile(r"\b(?:has|with|without|no|hide|show|is)[-_]+[a-z]+")


def named(attributes: str) -> dict[str, str]:
    """Values of the attributes of a tag by lower-case name; the first of a name counts, as in browsers."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        out.setdefault(name.lower(), "".join(values))
    return out


def hinted(name: str, given: dict[str, str], in_article: bool) -> int:
    """What class and id say of an element: True (no main text), SUSPECT or False."""
    found = 0
    for key in ("class", "id"):
        for value in ABOUT.sub(" ", given.get(key, "").lower()).split():
            parts = frozenset(p for p in re.split(r"[^a-z]+", value) if p)
            if not parts <= SURE | HINTS | LAYOUT or key == "id" and name in TITLED and not (name == "section" and parts & COMMENTS):
                continue
            if parts & (OTHER if name in ARTICLE else SURE):
                return True
            if name in ARTICLE | HEADINGS:
                continue
            if in_article and parts & BOXES and name != "section":
                return True
            if parts & HINTS and not in_article:
                found = SUSPECT
    return found


def excluded(name: str, attributes: str, in_article: bool, hints: bool = True) -> int:
    """Whether an element and all it holds is no main text: True, SUSPECT or False."""
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attributes or name in ("body", "html"):
        return False
    given = named(attributes)
    if ("hidden" in given or given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in DROPPED_ROLES
            or UNSEEN.search(given.get("style", ""))):
        return True
    return hints and hinted(name, given, in_article)


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place of the > that ends a tag, or -1: the first outside quoted values, however long they are. A quote that hides a > and
    never closes, or closes right before more text (so it belongs to a later tag), is taken for a stray one; `last` holds the last
    place of either quote, so that unclosed ones are not sought to the end of the page again and again."""
    while found := STOP.search(page, at):
        if not found[1]:
            return found.start()
        begin = found.end()
        stop = page.find(found[1], begin) if begin <= last[found[1]] else -1
        over = page.find(">", begin, stop if stop >= 0 else len(page))
        if stop < 0 or over >= 0 and page[stop + 1:stop + 2].strip() not in ("", "/", ">"):
            return over
        at = stop + 1
    return -1


def declaration(page: str, at: int) -> tuple[str, int]:
    """(text, end) of a comment, CDATA section, or other declaration; only CDATA has text. Unclosed ones reach the end."""
    for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
        if page.startswith(start, at):
            end = page.find(stop, at + len(start))
            text = page[at + 9:end if end >= 0 else len(page)] if stop == "]]>" else ""
            return text, end + len(stop) if end >= 0 else len(page)
    return "", at + 1


def items(page: str, hints: bool = True, parents: list[int] | None = None) -> list[tuple[str, str, int, int, int]]:
    """(kind, text, excluded, mark, holder): kind is 'word' for text, else '<name' or '</name'; excluded may be SUSPECT; mark is the number of the
    outermost <article> around it, minus that of <main> outside any article, or 0; holder is the number of the innermost element
    that holds text as a whole, 0 for the page. Holders are numbered as they begin; `parents` receives the holder around each."""
    out: list[tuple[str, str, int, int, int]] = []
    stack: list[tuple[str, int, int, int]] = []  # name, excluded, mark, holder
    parents = [] if parents is None else parents
    parents.append(0)
    opened: Counter = Counter()  # names on the stack: a closing tag without its like costs nothing
    endless: set[str] = set()  # raw elements that are never closed again
    lower = page.lower()
    lone = {name for name in ARTICLE if lower.count("<" + name) == 1}
    last = {quote: page.rfind(quote) for quote in "\"'"}
    at = marks = 0

    def top():
        return stack[-1] if stack else ("", False, 0, 0)

    def close(name: str, upto: tuple = ()) -> None:
        if not opened[name]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                opened.subtract(s[0] for s in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in upto:
                return

    while at < len(page):
        _, out_of, inside, holder = top()
        tag = TAG.match(page, at)
        if tag is None:
            if page.startswith(("<!", "<?"), at):
                text, at = declaration(page, at)
            else:
                end = page.find("<", at + 1)
                text, at = page[at:end if end >= 0 else len(page)], end if end >= 0 else len(page)
            if text:
                out.append(("word", text, out_of, inside, holder))
            continue
        end = tag_end(page, tag.end(), last)
        if end < 0:
            out.append(("word", page[at:], out_of, inside, holder))
            break
        name, attributes, at = tag[2].lower(), page[tag.end():end], end + 1
        kind = name if name in KNOWN else "other"
        if tag[1]:
            out.append(("</" + kind, "", out_of, inside, holder))
            close(name)
            continue
        if name in RAW:  # nothing inside is markup or text
            end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end is None:
                endless.add(name)
            at = end.end() if end else (len(page) if name in ("script", "style") else at)
            out.append(("<other", "", True, inside, holder))
            continue
        if name in ENDS_P and not (name == "p" and top()[0] != "p") and any(s[0] == "p" for s in stack[-4:]):
            close("p", tuple(BLOCK - {"p"}))
        if name in ENDS_LIKE:
            close(name, ENDS_LIKE[name][1])
        if name in ARTICLE and out_of is True and not any(s[2] or s[0] in ("section", "div") and s[1] is True for s in stack):
            while stack and top()[1] is True:  # an article inside a menu or header: that one was never closed
                opened[stack.pop()[0]] -= 1
            _, out_of, inside, holder = top()
        if name in lone and out_of == SUSPECT:  # a hint around the only article speaks of the page
            out_of = False
        drop = True if out_of is True else excluded(name, attributes, inside > 0, hints) or out_of
        now = inside
        if name in ARTICLE and not drop and inside <= 0 and (name == "article" or not inside):
            marks += 1
            now = marks if name == "article" else -marks
        if now != inside or not now and name in HOLDERS:
            parents.append(holder)
            holder = len(parents) - 1
        out.append(("<" + kind, "", drop, now, holder))
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, drop, now, holder))
            opened[name] += 1
    return out


def scores(sequence, weights: dict[str, float]) -> list[float]:
    word = {False: weights["word"], True: 0.0, SUSPECT: PRIOR["suspect"]}
    return [word[drop] * len(text.split()) if kind == "word"
            else PRIOR["dropped"] if drop else weights.get(kind, PRIOR.get(kind, PRIOR["tag"])) for kind, text, drop, *_ in sequence]


def best_region(values: list[float]) -> tuple[int, int]:
    """[start, stop) of the first contiguous region with the largest positive sum; empty if there is none."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, region = total, (start, i + 1)
    return region


def widened(sequence, start: int, stop: int, parents: list[int]) -> tuple[int, int]:
    """[start, stop) of the innermost holder of a region; a region that only the page holds stays as it is."""
    a, b = sequence[start][4], sequence[stop - 1][4]
    while a != b:  # a holder begins behind the one around it
        a, b = (parents[a], b) if a > b else (a, parents[b])
    if not a:
        return start, stop
    within = [False] * len(parents)
    within[a] = True
    for i in range(a + 1, len(parents)):
        within[i] = within[parents[i]]
    while start and within[sequence[start - 1][4]]:
        start -= 1
    while stop < len(sequence) and within[sequence[stop][4]]:
        stop += 1
    return start, stop


def main_text(page: str, weights: dict[str, float]) -> str:
    for hints in (True, False):
        parents: list[int] = []
        sequence = items(page, hints, parents)
        scanned = start, stop = best_region(scores(sequence, weights))
        if stop:
            start, stop = widened(sequence, start, stop, parents)
            break
    blocks, held = [], []

    def flush():
        block = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if block:
            blocks.append(block)

    for i in range(start, stop):
        kind, text, drop, *_ = sequence[i]
        if drop == SUSPECT and scanned[0] <= i < scanned[1]:
            drop = False
        if kind == "word":
            if not drop:
                held.append(text)
        elif kind.lstrip("</") in BLOCK:
            flush()
    flush()
    return "\n".join(blocks)


def counts(page: str) -> Counter:
    """(kind, inside) counts of a page that marks exactly one article; nothing for others. Excluded parts and the tags of the
    marked element itself stand outside."""
    lower = page.lower()
    one = "article" if "<article" in lower else "main"
    if lower.count("<" + one) != 1:
        return Counter()
    out: Counter = Counter()
    for kind, text, drop, mark, _ in items(page):
        inside = not drop and (mark > 0 if one == "article" else mark != 0) and kind.lstrip("</") != one
        out[kind, inside] += len(text.split()) if kind == "word" else 1
    return out


def learn(pages: DataFrame, html_col: str = "html", smoothing: float = 1.0) -> dict[str, float]:
    """Weight per item kind from all labelled pages; the driver receives one row per kind (a fixed list)."""
    import pyarrow as pa

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "html"):
                for page in part.column(0).to_pylist():
                    total.update(counts(page or ""))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()),
             pa.array([total[k] for k in keys], pa.int64())], names=["kind", "inside", "n"])

    rows = (mapped(pages.select(F.col(html_col).alias("html")), run, "kind string, inside boolean, n long")
            .groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect())
    seen = {(r["kind"], r["inside"]): r["n"] for r in rows}
    all_in, all_out = (sum(n for (_, i), n in seen.items() if i == side) for side in (True, False))
    weights = {}
    for kind in {k for k, _ in seen}:
        inside, outside = seen.get((kind, True), 0) + smoothing, seen.get((kind, False), 0) + smoothing
        odds = math.log(inside / (all_in + smoothing)) - math.log(outside / (all_out + smoothing))
        n = inside + outside
        odds = (n * odds + BELIEF * PRIOR.get(kind, PRIOR["tag"])) / (n + BELIEF)
        weights[kind] = min(2.0, max(0.2, odds)) if kind == "word" else max(-3.0, min(-0.01, odds))
    return {"word": PRIOR["word"], **weights}


COLUMNS = (("main_text", "string"), ("main_chars", "bigint"))


def extract(pages: DataFrame, html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """`pages` with main_text and main_chars (code points)."""
    import pyarrow as pa

    weights = weights or learn(pages, html_col)
    at = pages.columns.index(html_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                texts = [main_text(p or "", weights) for p in part.column(at).to_pylist()]
                new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *(c for c, _ in COLUMNS)])

    return mapped(pages, run, extended(pages.schema, COLUMNS))


def op4_html_text(spark, sf_dir):
    rows = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


QUERIES = {"op4_html_text": (op4_html_text, None)}
