"""Main text of HTML pages: flat text blocks, their neighbours' word counts and link densities, a decision tree."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Markup of a page: comments, parts whose content is no markup, tags. Quantifiers are possessive: no backtracking.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>""", re.I | re.S)
BREAKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("address article aside blockquote body center details dialog div dl fieldset figure footer form head header li main menu nav ol section table td tr ul".split())
#: Elements whose text is not shown as text; one that is not closed ends with its container.
UNSEEN = frozenset("title noscript template svg iframe select button object video audio canvas datalist math".split())
#: What an element's name says of the text inside: -2 outside the article, -1 perhaps outside, 2 inside.
NAMES = {"nav": -2, "menu": -2, "footer": -2, "aside": -2, "dialog": -2, "head": -2, "form": -1, "fieldset": -1, "header": -1, "article": 2, "main": 2}
#: The same of the last word of a class, id or role, without the ROOM words that only name a part of the page, and
#: without a word of TRAIT before it, which makes it a property of what the element holds (no-sidebar, tag-legal).
TRAIT = frozenset("no not non has have with without is hide show tag category cat topic subject status format type layout".split())
OUTSIDE_WORD = re.compile(r"nav\w*|menu\w*|footers?|foot|cc|overlay|toast|snackbar|masthead|sidebar\w*|side|aside|ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscri\w*|signup|login|search\w*|sharing|shares?|social\w*|related|recommend\w*|breadcrumbs?|pagination|pager|widgets?|toolbar|comments?|commentlist|respond|replies|reply|disqus|copyright|legal|disclaimer|complementary|contentinfo|navigation")
PERHAPS_WORD = re.compile(r"head(?:er|bar)?|form\w*|tags?|meta|byline|info")
MAIN_WORD = re.compile(r"article|main|content|post|entry|story|body|text|footnotes?|endnotes?|references|bibliography")
#: Elements whose classes say how the whole page or article is shown, and what they may say still.
WHOLE = frozenset("html body main article".split())
READER_WORD = re.compile(r"comments?|commentlist|respond|replies|reply")
ROOM = frozenset("area box wrapper wrap container list section bar block inner outer item items links row column col group panel content body text main left right top bottom primary secondary window".split())
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Headings of what follows an article, and lines that stand around readers' comments, in four languages.
AFTERWARDS = re.compile(r"(?:\d+\s+)?(?:comments?|repl(?:y|ies)|responses?|discussion|leave a|join the (?:discussion|conversation)|what do you think|commentaires?|r[eé]ponses?|laisser un|comentarios?|respuestas?|deja un|kommentare?|antworten|related|similar|read (?:more|next)|more (?:from|stories|in|on)|you (?:may|might|could)|share|follow us|newsletter|subscribe|popular|trending|recommended|sponsored|advertisement)\b", re.I)
READERS = re.compile(r"(?:reply|report|permalink|like|upvote|downvote|flag|r[eé]pondre|responder|antworten|\d+\s+(?:likes?|points?|votes?)|.{1,40}\s(?:says|said|wrote|commented):?|.{0,40}\b\d+\s+(?:minutes?|hours?|days?|weeks?|months?|years?) ago)\W*", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "hint", "heading", "readers")
#: The share of a page's words outside links that must lie where a hint is or better, for others to be judged by it;
#: an article may be much shorter than what its readers say.
SHARE = 0.05
#: Words from which on a block is just long.
ENOUGH = 60

#: The labelled table: one page a line, one block a mark. A mark is the hint of the elements around (o: -2,
#: w: -1, none: 0, m: 1, a: 2), ! for a heading, ~ for one of AFTERWARDS, the words, those inside links, and + for
#: main text.
LABELLED = """
o1/1- o1/1- o2/2- o1/1- o8- a!9+ a45+ a70/6+ a3+ a28+ a12+ o14-
o1/1- o1/1- o1/1- o1/1- o9- a!10+ a80+ a25+ a2+ a1+ a40+ o12-
o1/1- o2/2- o18- a!3+ a5+ a120+ a1+ o5-
1/1- 2/2- 1/1- 3/3- !7+ 60+ 45/3+ 38+ 5/5- 4/4- 6-
5- 1/1- 1/1- 1/1- !8+ 30+ 90/4+ 18+ 55+ 12+ 3/3- 3/3- 3/3- 7-
3- 2/2- 2/2- 2/2- !4+ 25+ 33/2+ 41+ 2/2- 1/1- 8/2-
w1/1- w2/2- w1/1- w!6+ w55+ w40/2+ w8+ w62+ w2/2- w3/3- w5-
w2/2- w1/1- w!5+ w70+ w31+ w4+ w28/3+ w3/3- w1/1- w4-
o3- o2/2- o2/2- o25- o2/2- a!7+ a50+ a9+ a33+ a20/18+ a3/3+ a2/2+ o40- o30-
a!6+ a90+ a60+ a22+ o2- o1/1- o30- o1/1- o55- o18- o70- o6-
o25/1- o2- !5+ 40+ 52+ 31+ 4/4- o20-
o60- o12- m!7+ m34+ m58+ m16+ o150- o80- o3/3-
2/2- 2/2- 2/2- 9- 150/4+ 80+ 3/3- 3/3- 12/2-
w3/1- w6- o1/1- o1/1- m!8+ m14+ m66+ m5+ m38+ m2+ o10- o4/4-
o1/1- o2/2- a!4+ a6+ a2+ o7-
o1/1- o1/1- a!2+ a3+ a1+ o3-
90+
400+
30+
7+
o2/2- a!7+ a30/12+ a44/9+ a8/2+ a60+ o3/3-
o1/1- a!9+ a4/1+ a50+ a65+ a2+ o2- o35-
o1/1- m!6+ m48+ m7+ m3+ m75/3+ m11+ w9- o2/2-
a70+ a6+ a66+ a1+ a42+
1/1- !6+ 52+ 4+ 61+ 7+ 3+ 48+ 2/2- 2/2- 9-
a40+ w6- w4- a52+ w3- w2- w1- a33+
a44+ a!~2- a7/7- a8/8- a6/6- o5-
51+ !~2- 7/7- 9/9- 5/5- 4-
o9- a!10+ a280+ a8+ a8+ a160+ a12+ a150+ a9+ a230+ a2+ a2+ a170+ a16+ a7+ o11-
o1/1- o7- a!5+ a1+ a1+ a2+ o13-
m!6+ m10+ m150+ m9+ m190+ m3+ m7+ m95+ o6-
o1/1- o8- !7+ 3+ 90+ 10+ 120+ 2+ o9- o2/2-
2/2- 2/2- !5+ 9+ 140+ 8+ 7+ 150+ 11+ 60+ 3/3- 2/2- 9-
o8- a!3/3+ a50+ o7-
2/2- 1/1- 100+ 70+ 3/3-
1/1- 4/4- 45+ 30+ 80+ 2/2- 2/2-
2/2- 3/3- 26+ 4+ 33+ 4/4- 3/3- 12/3-
o!2/2- o2/2- o!3/3- o5/5- a!6+ a60+ a40+ o!2/2- o!4/4- o6-
a!5+ a!3+ a20+ a!2+ a31+ a!4+ a15+
!5+ 33+ !3+ 20+ !2+ 31+ 6+ 44+ !4+ 15+ 2/2- 3/3-
a35+ a3+ a4+ a2+ a5+ a40+ a38+ a4/4+ a3/3+ a5/5+
a50+ a4/4+ a3/3+ a5/5+ a2/2+ a40+ a12+ a8/2+
a!6+ a60+ a!2+ a5/5+ a9/4+ a7/7+ o9-
o2/2- a!3+ a80+ a2/2+ a3/3+ a50+ a2/2+ a1/1+ a30+ o8-
a!4+ a55+ a1/1+ a1/1+ a1/1+ a44+ o2/2-
a!6+ a60+ a45+ a!~2- a2- a40- a25- a3- a60- a1/1-
!6+ 60+ 45+ !~2- 2- 40- 25- 3- 60- 1/1- 4-
!5+ 80+ 30+ 44+ !~3- 2- 18- 1/1- 2- 70- 1/1- 9-
m!5+ m80+ m30+ m!~2- m12- m35- m2/2- o8-
a50+ a6/3+ a7/2+ a45+ m29+ m2/2- m3/3-
o1/1- o!7+ o60+ o45/3+ o12+ o38+ o5+
o!4+ o33+ o80+ o2+ o51+
w45+ w60+ w38/2+ w4- w2- w5/5- w3/3-
o!3- o12- o!2- o4/4- o5/5- m60+ m20+ o!2- o45- o33-
"""


def labelled_rows(table: str = LABELLED):
    """FEATURES and class of each block of a labelled table."""
    out = []
    for line in table.split("\n"):
        found = re.findall(r"([owma]?)(!?~?)(\d+)(?:/(\d+))?([+-])", line)
        blocks_ = [("comments" if "~" in mark else "", int(n), int(inside or 0), {"o": -2, "w": -1, "": 0, "m": 1, "a": 2}[hint], int(bool(mark))) for hint, mark, n, inside, _ in found]
        out += [(*x, float(m[4] == "+")) for x, m in zip(block_features(blocks_), found)]
    return out


def fit_tree(rows, depth: int = 8):
    """A decision tree over rows whose last column is the class: (feature, split, left, right, share of 1)."""
    data = np.array(rows, float)
    nodes = []

    def gini(y):
        return len(y) * 2 * y.mean() * (1 - y.mean()) if len(y) else 0.0

    def grow(part, left):
        me, y = len(nodes), part[:, -1]
        nodes.append([0, 0.0, -1, -1, y.mean()])
        best = (gini(y) - 1e-9, None, None)
        if left and 0 < y.mean() < 1:
            for f in range(part.shape[1] - 1):
                values = np.unique(part[:, f])
                for s in (values[1:] + values[:-1]) / 2:
                    under = part[:, f] <= s
                    cost = gini(y[under]) + gini(y[~under])
                    if cost < best[0] - 1e-12:
                        best = (cost, f, s)
        if best[1] is not None:
            under = part[:, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = grow(part[under], left - 1)
            nodes[me][3] = grow(part[~under], left - 1)
        return me

    grow(data, depth)
    return np.array(nodes)


def classify(tree, x):
    at = np.zeros(len(x), np.int64)
    while True:
        down = tree[at, 2] >= 0
        if not down.any():
            return tree[at, 4] >= 0.5
        under = x[np.arange(len(x)), tree[at, 0].astype(np.int64)] <= tree[at, 1]
        at = np.where(down, np.where(under, tree[at, 2], tree[at, 3]), at).astype(np.int64)


def hint(name: str, attributes: str, around: int) -> int:
    """-2 to 2: what the element says of the text inside; around: what those around it say. What is outside stays so
    but for an article or main element in it; a header or the like inside the article is part of it. It is
    a hint only: block_features sets it against the rest of the page's."""
    own = NAMES.get(name, 0)
    for said in NAMED.findall(attributes) if attributes else ():
        for token in said.strip("\"'").lower().split():
            parts = re.split(r"[-_]+", token)
            while len(parts) > 1 and parts[-1] in ROOM:
                parts.pop()
            if len(parts) > 1 and parts[-2] in TRAIT:
                continue
            if name in WHOLE:
                own = -2 if READER_WORD.fullmatch(parts[-1]) or READER_WORD.fullmatch(parts[0]) else own
            elif OUTSIDE_WORD.fullmatch(parts[-1]):
                own = min(own, 0) - 2
            elif PERHAPS_WORD.fullmatch(parts[-1]):
                own = own or -1
            elif MAIN_WORD.fullmatch(parts[-1]):
                own = own or (1 if "-" in token or "_" in token else 2)
    own = max(-2, min(2, own))
    if name in WHOLE and own > 0:
        return own if around > -2 else 1
    return around if not own or around == -2 or own == -1 and around > 0 else own


def blocks(page: str):
    """The flat text blocks of a page in order: (text, words, words inside links, hint, heading)."""
    out, text, links = [], [], []
    stack: list[tuple[str, int]] = []  # open elements, with the hint for the text inside
    open_: dict[str, int] = {}
    anchors, heading, unseen = 0, False, 0

    def flush():
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                inside = len(html.unescape("".join(links)).split()) if links else 0
                out.append((" ".join(words), len(words), min(inside, len(words)), stack[-1][1] if stack else 0, int(heading)))
        text.clear(), links.clear()

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at and not unseen:
            text.append(page[at : m.start()])
            if anchors:
                links.append(text[-1] + " ")
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = m[2] or m[5], m[4] or m[7] or ""
        if name == "br":
            if not unseen:
                text.append(" ")
        elif name == "a":
            anchors = 0 if closing else 1
        elif name in BREAKS or name in UNSEEN:
            if name in BREAKS:
                flush()
                heading = not closing and len(name) == 2 and name[0] == "h" and name[1] in "123456"
            if name in HOLDERS or name in UNSEEN:
                if not closing and not attributes.endswith("/"):
                    around = stack[-1][1] if stack else 0
                    stack.append((name, hint(name, attributes, around) if name in HOLDERS else around))
                    open_[name] = open_.get(name, 0) + 1
                    unseen += name in UNSEEN
                    anchors = anchors if name in UNSEEN else 0
                elif closing and open_.get(name):
                    last = ""
                    while last != name:
                        last = stack.pop()[0]
                        open_[last] -= 1
                        unseen -= last in UNSEEN
    if not unseen:
        text.append(page[at:])
    flush()
    return out


def block_features(found):
    """FEATURES of a page's blocks."""
    x = np.zeros((len(found), len(FEATURES)))
    if found:
        n, inside = np.array([b[1] for b in found], float), np.array([b[2] for b in found], float)
        x[:, 0], x[:, 1] = np.minimum(n, ENOUGH), np.round(4 * inside / n) / 4
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
        # A hint counts against the best one under which a good part of the page's words stands: where all is
        # said to be outside, nothing is. An article that is called so stands out, with its lists of links.
        hints, free = np.array([b[3] for b in found]), n - inside
        best = next((h for h in (2, 1, 0, -1) if free[hints >= h].sum() >= SHARE * free.sum() > 0), -2)
        x[:, 6], x[:, 7] = np.minimum(hints - best, 0) + ((hints == 2) & (best == 2)), [b[4] for b in found]
        after, around = False, [bool(b[1] <= 8 and READERS.fullmatch(b[0])) for b in found] + [False]
        for i, b in enumerate(found):
            if b[4]:
                after = bool(AFTERWARDS.match(b[0]))
            x[i, 8] = after or around[i] or around[i + 1]
    return x


def main_text(pages: DataFrame, labelled: str = LABELLED) -> DataFrame:
    """One row per input row of pages(page_id, url, html): page_id, url, text, n_chars, n_blocks, n_main.

    The page is cut at block tags into flat blocks; scripts, styles, titles, comments and form controls
    go with their content; character references are decoded; white space in a block becomes one space.
    A decision tree, trained here on the small labelled table, tells main blocks from the rest by their
    word count and link density, those of both neighbours, headings, a hint from the elements around that
    is set against the page's other ones, and whether it stands under a heading such as Comments. Main blocks are joined by newlines; nothing else is dropped. Null or empty html, and pages without
    main blocks, give ''. An unclosed tag ends with its container; a tag that ends in /> has no content.
    A very long page is read whole, in one task, in time that grows with its length. Repeated rows are separate, a null
    page_id or url is kept, other columns are ignored, and an empty table gives none."""
    tree = fit_tree(labelled_rows(labelled))

    def run(batches):
        for batch in batches:
            text, n, main = [], [], []
            for page in batch.column(2):
                found = blocks(page.as_py() or "")
                kept = classify(tree, block_features(found)) if found else []
                text.append("\n".join(b[0] for b, k in zip(found, kept) if k))
                n.append(len(found)), main.append(int(sum(kept)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(n, pa.int64()), pa.array(main, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
