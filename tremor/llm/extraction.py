"""Main text of HTML pages.

A page becomes flat blocks of text: any block-level tag, opening or closing, ends a block.
A decision tree says which blocks are the article's.  It looks at a block's words and link
density and at those of the blocks before and after it; besides, at the HTML element the block
stands in (article, or one meant for what is beside it) and at what the names of its containers
(class, id, role) are worth.  Tree and worth of names are both learned from a small labelled
table, ``PAGES``, whose rows also count with other lengths and without elements or names, as
most pages have neither.  A page of which no block is taken gives the likeliest ones, if any is
likely at all.

Markup need not be well formed: end tags may be missing, attributes unquoted, tags cut off
at the end.  Null or empty html gives the empty text; repeated rows are treated each;
a very long page is scanned once from left to right; an empty table gives no rows.  Other
columns, of any name, are ignored.
"""

import functools
import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by kind (fixed values, from the HTML standard's categories).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th "
    "thead title tr ul button label".split()
)
UNREAD = frozenset("script style noscript template textarea title svg iframe object canvas math head-only".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_NEXT = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ASIDES = frozenset("nav footer aside form menu dialog button select label fieldset".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
PARTS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
#: A page without any block of this likelihood has no article.
LEAST = 0.1

FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "element", "names", "marked_page"]

#: The labelled table.  A line is a page, an entry one of its blocks: + (article) or - (not), words/words in links,
#: ^ inside article or main, _ inside an element for what is beside the article, and the names of its containers.
PAGES = """
-1/1_menu -1/1_menu -2/2_menu -1/1_menu +9/0^post +64/2^post +88/0^post +41/0^post +73/3^post -9/0_footer -3/3_footer
-1/1_ -1/1_ -1/1_ -1/1_ -9/0=ad +11/0^ +30/0^ +95/0^ +52/0^ +18/0^ -11/0_
-2/2_ -1/1_ -3/3_ -14/0=ad +8/0^ +6/0^ +70/0^ -12/0_
-1/1_ -2/2_ -7/0=ad +12/0^ +140/0^ +6/0^ +3/0^ -14/0_
-3/3=nav -2/2=nav -1/1=nav +7/0=content +45/1=content +60/0=content +2/0=content +37/0=content +90/4=content -2/0=sidebar -5/5=sidebar -4/4=sidebar -6/6=sidebar -16/1=footer
-2/2=navbar -2/2=navbar -3/3=breadcrumb +10/0=article,body +33/0=article,body +51/2=article,body -13/0=article,body,ad +49/0=article,body +77/1=article,body -4/0=related -8/8=related -9/9=related -7/7=related -6/0=newsletter,signup -15/0=newsletter,signup
-4/4_ -3/3_ +13/0^ +24/0^ -18/0^promo +66/1^ +58/0^ -10/0_newsletter +81/0^ -3/3=tags -2/2=tags -21/0_ -5/5_
-1/0=logo -2/2=menu -2/2=menu -1/1=menu +6/0=entry +120/6=entry +80/2=entry +64/0=entry -2/0=comments -2/1=comment,meta -34/0=comment -2/1=comment,meta -51/1=comment -2/1=comment,meta -12/0=comment -3/0=respond -5/0=respond
-1/1_ -1/1_ +8/0^ +58/1^ +71/0^ +44/0^ -3/0^comments -29/0^comment -46/0^comment -80/0^comment -8/0^reply,comment -17/0_
-24/1=cookie,notice -1/0=cookie,notice -2/2=header -3/3=header +11/0=story +9/0=story +47/1=story +39/0=story +55/0=story +28/0=story -1/1=share -1/1=share -1/1=share -30/4=footer
-19/0=alert -1/1=nav -1/1=nav -1/1=nav +7/0^ +83/2^ +97/0^ -5/5_ -6/6_ -5/5_ -22/2_
+34/0
+11/0
+62/0 +48/0 +71/2
+9/0 +55/1 +80/0 +63/0 +42/0 +38/0
+5/0 +29/0 +41/0 -8/0
+8/0 +50/0 +66/0 +47/0 -9/0=box
+90/0 +120/1 +64/0 -11/0 -3/3
-1/1 -1/1 -2/2 -1/1 +7/0 +56/0 +81/1 +40/0 -12/0
-2/2 -2/2 -2/2 +10/0 +35/0 +6/0 +48/2 +91/0 -4/4 -3/3 -7/0
-3/3 -4/4 -2/2 +44/0 +52/0 +70/3 -2/0 -5/5 -6/6 -4/4 -10/1
-1/1=top -1/1=top +6/0 +22/0 +31/0 +17/0 +44/0 -6/6=bottom -9/1=bottom
-2/2_ -1/1_ +9/0=main,text +27/0=main,text +4/0=main,text +5/0=main,text +3/0=main,text +60/0=main,text -6/0=widget -14/0=widget -4/4=widget -13/0_
-1/1_ +5/0^ +3/0^ +4/0^ +21/1^ +8/0^ +7/0^ +6/0^ +55/0^ +12/0^ -9/2_
-2/1=header +8/0=post,title +68/0=post,content +72/2=post,content -11/0=sponsored +59/0=post,content -3/2=post,meta -8/0=pagination -2/2=pagination -18/0=footer,copyright
-7/0=banner -1/1=menu -1/1=menu -1/1=menu +6/0=doc,content +18/0=doc,content +36/5=doc,content +4/0=doc,content +25/2=doc,content +30/1=doc,content -2/2=pager -3/3=pager -9/1=footer
-5/5=list -6/6=list -4/4=list -7/7=list -5/5=list -6/6=list -10/0=footer
-1/1_ -1/1_ -1/1_ -3/3_ -2/2_ -9/0_
-2/0_login -1/0_login -2/0_login -1/0_login -6/0_
-3/3 -2/2 -4/4 -6/6 -3/3 -2/2
-2/2=nav +9/0=col,main +74/2=col,main +53/0=col,main -2/0=col,side -26/0=col,side -3/3=col,side -4/4=col,side -19/1=footer
-1/1_ -2/2_ +12/0^ +160/3^ -20/0^_ad +140/1^ -16/0_
-3/3_ -2/2_ +7/0^ +49/0^ +86/2^ -28/0_about,author -4/4_related -5/5_related -33/1=comment -12/0=comment -64/0=comment -11/0_
-1/1=menu -1/1=menu -31/0=popup,modal -2/0=popup,modal +10/0=post,body +57/1=post,body +83/0=post,body -27/0=disclaimer,notice -8/2=footer
-2/2 -1/1 -12/0=ads +9/0 +47/0 +68/0 +55/1 +23/0 -13/0=ads -15/1
-1/1 -1/1 -1/1 -10/0 +8/0 +61/0 +73/0 +39/0 -11/0
-8/8=teaser -12/2=teaser -7/7=teaser -15/2=teaser -9/9=teaser -11/0=footer
-1/1_ -1/1_ +6/0^ +2/0^ -9/0_
-1/1_ -2/2_ -10/0=ad +10/0^ +1/0^ +3/0^ -12/0_
-1/1_ -1/1_ -12/0=ad +9/0^ +2/0^ -22/0_
-1/1_ -3/3_ +2/0^ +1/0^ +1/0^ +40/0^ +1/0^ +2/0^ +90/0^ +3/0^ +1/0^ -6/0_
-1/1_ -2/2_ -25/0=ad +4/0^ +30/0^ +12/0^ +1/0^ +150/0^ +2/0^ -40/0_
-2/2_ -12/0_ +7/0^ +65/3^ +4/0^ +2/2^ +50/0^ +8/8^ -35/0_ -2/2_ -60/1_
-1/1_ -1/1_ -2/0=ad +3/0^ +3/0^ +3/0^ -3/0_
-1/1_ -1/1_ -30/0=ad +60/0^ +200/0^ +400/0^ +25/0^ -28/0_
-1/1_ -45/0_ -3/3_ +15/0^ +9/0^ -70/0_ -5/5_ +33/0^ +2/0^ -18/0_
-1/1_ -2/2_ +9/0^ +26/0^ +22/0^
-1/1_ +3/0^ +70/0^ +8/0^
+2/0^ +26/0^ -9/0_ +22/0^ -2/0_ -1/0_ +2/0^
+7/0^ +29/0^
+6/0^ +40/0^ +3/0^ +33/0^ +1/0^
-1/1 -3/3 -1/1 +4/0 +26/0 +22/0 +23/0 -4/4
-1/1 -2/2 +5/0 +40/0 +35/1 +30/0 -6/6 -4/4 -5/5
-2/2 -2/2 -1/1 +8/0 +25/0 +28/0 +60/0 +33/2 -5/5 -7/7
"""


class Block:
    __slots__ = ("text", "words", "linked", "element", "names")

    def __init__(self, text, linked, element, names):
        self.text, self.linked, self.element, self.names = text, linked, element, names
        self.words = text.count(" ") + 1


def inside(tag, attributes, above):
    """(element, names) of the content of an element, from those of what it stands in."""
    element, names = above
    if tag in ("article", "main"):
        element = 1
    elif tag in ASIDES or tag == "header" and element == 0:
        element = -1
    if attributes:
        if tag not in ("body", "html"):
            found = {p for m in NAMES.finditer(attributes) for p in PARTS.findall(m[1].lower())}
            names = names | found if found else names
        if HIDDEN.search(attributes):
            element = -1
    return element, names


def blocks_of(page):
    """The flat text blocks of a page, in order."""
    out, pieces, linked = [], [], 0
    stack = [("", (0, frozenset()))]
    in_link, at, lower = False, 0, None

    def text_until(end):
        nonlocal linked
        if end > at:
            t = page[at:end]
            if t and not t.isspace():
                if "&" in t:
                    t = entities.unescape(t)
                if in_link:
                    linked += len(t.split())
                pieces.append(t)
            elif t:
                pieces.append(" ")

    def close_block():
        nonlocal pieces, linked
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                out.append(Block(text, linked, *stack[-1][1]))
            pieces, linked = [], 0

    while True:
        i = page.find("<", at)
        if i < 0:
            text_until(len(page))
            break
        if page.startswith("<!--", i):
            text_until(i)
            j = page.find("-->", i + 4)
            at = len(page) if j < 0 else j + 3
            continue
        if page.startswith(("<!", "<?"), i):
            text_until(i)
            j = page.find(">", i)
            at = len(page) if j < 0 else j + 1
            continue
        m = TAG.match(page, i)
        if not m:
            if page[i + 1 : i + 2].isalpha() or page[i + 1 : i + 2] == "/":  # cut off, or an end tag without a name
                text_until(i)
                j = page.find(">", i)
                at = len(page) if j < 0 else j + 1
            else:  # a plain "<"
                text_until(i + 1)
                at = i + 1
            continue
        text_until(i)
        at = m.end()
        ends, tag, attributes = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        if tag in UNREAD:
            if not ends and not attributes.endswith("/"):
                if lower is None:
                    lower = page.lower()
                j = lower.find(f"</{tag}", at)
                j = lower.find(">", j) if j >= 0 else -1
                at = len(page) if j < 0 else j + 1
            continue
        if tag == "a":
            in_link = not ends
        elif tag in VOID:
            if tag == "hr":
                close_block()
            elif tag == "br":
                pieces.append(" ")
        elif tag in BLOCKS:
            close_block()
            if ends:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                in_link = False
            else:
                if stack[-1][0] in CLOSED_BY_NEXT.get(tag, ()) or stack[-1][0] == "p" and tag not in ("button", "label", "select"):
                    stack.pop()
                stack.append((tag, inside(tag, attributes, stack[-1][1])))
    close_block()
    return out


def table_of(blocks, worth):
    """One row of features for each block; worth: what names speak for the article, by name."""
    own = [(b.words, min(1.0, b.linked / b.words)) for b in blocks]
    around = [(0, 0.0), *own, (0, 0.0)]
    names = [max(-3.0, min(3.0, sum(worth.get(n, 0.0) for n in b.names))) for b in blocks]
    marked = any(b.element > 0 for b in blocks)
    return [(*own[i], *around[i], *around[i + 2], b.element, names[i], marked) for i, b in enumerate(blocks)]


ENTRY = re.compile(r"([+-])(\d+)/(\d+)(\^?_?)=?([a-z,]*)")


def labelled(copies=40, seed=5):
    """Pages of the labelled table as lists of (block, label): as they are, then with other lengths, and with elements or names left out."""
    r = random.Random(seed)
    for k in range(copies):
        for line in PAGES.strip().split("\n"):
            scale, with_elements, with_names = (1.0, True, True) if not k else (r.choice([0.5, 0.8, 1.0, 1.6, 2.5]), r.random() < 0.75, r.random() < 0.6)
            rows = []
            for sign, words, linked, element, names in ENTRY.findall(line):
                block = Block("", 0, 0, frozenset())
                length, links = int(words), int(linked)
                if length > 4 and links < length:  # lengths of prose differ, those of menus hardly
                    length = max(3, int(length * scale * r.uniform(0.7, 1.4)))
                block.words, block.linked = length, links if links < int(words) else length
                if with_elements:
                    block.element = -1 if "_" in element else 1 if element else 0
                if with_names:
                    block.names = frozenset(names.split(",")) - {""}
                rows.append((block, sign == "+"))
            yield rows


def worth_of(pages, least=1):
    """Log odds of names among article blocks against others, over those of all blocks; each page counts a name once a label."""
    kept: dict[str, int] = {}
    lost: dict[str, int] = {}
    for rows in pages:
        for label, held in ((True, kept), (False, lost)):
            for name in {n for b, y in rows if y == label for n in b.names}:
                held[name] = held.get(name, 0) + 1
    return {n: float(np.log((kept.get(n, 0) + 0.5) / (lost.get(n, 0) + 0.5))) for n in kept.keys() | lost.keys() if kept.get(n, 0) + lost.get(n, 0) >= least}


def grow(x, y, depth=8, least=20):
    """A tree as nested tuples: (feature, bound, low, high) or the share of article blocks."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(t))
        ones = np.cumsum(t)[:-1]
        rest = t.sum() - ones
        impurity = ones * (1 - ones / n) + rest * (1 - rest / (len(t) - n))
        impurity[(v[1:] == v[:-1]) | (n < least) | (len(t) - n < least)] = np.inf
        k = int(impurity.argmin())
        if np.isfinite(impurity[k]) and (best is None or impurity[k] < best[0] - 1e-9):
            best = impurity[k], f, (v[k] + v[k + 1]) / 2
    if best is None:
        return float(y.mean())
    _, f, bound = best
    low = x[:, f] <= bound
    return f, float(bound), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@functools.cache
def model():
    """(tree, worth of names)."""
    pages = list(labelled())
    worth = worth_of(pages)
    x = np.array([row for rows in pages for row in table_of([b for b, _ in rows], worth)], dtype=float)
    y = np.array([label for rows in pages for _, label in rows], dtype=float)
    return grow(x, y), worth


def likelihood(row, node):
    while isinstance(node, tuple):
        f, bound, low, high = node
        node = low if row[f] <= bound else high
    return node


def main_text(page, node, worth):
    blocks = blocks_of(page) if page else []
    chance = [likelihood(row, node) for row in table_of(blocks, worth)]
    bound = min(0.5, max(chance, default=0.0)) or 1.0
    return "\n".join(b.text for b, c in zip(blocks, chance, strict=True) if c >= bound and c > LEAST)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row; no shuffle."""
    node, worth = model()

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), node, worth) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")
