"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by the
elements they stand in, their share of linked text, their length and their share of stop
words. Short blocks and blocks in between stay open; the second pass gives them the label
of the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent function words of some languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be been but by can for from had has have he her his how i if in into is it
    its just like may more most no not of on one only or other our out over she so some such than that the their them then
    there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in
    ist mit nach nicht noch nur oder sein sich sie sind so um und von vor war werden wie wird wir zu zum zur über
    au aux avec ce cette ces comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas
    plus pour qu que qui sa se ses si son sont sur un une vous y été être
    al como con de del el ella en entre era es esta este fue ha hay la las lo los más me muy no nos o para pero por que se
    sin sobre son su sus también un una y ya
    che da dal della di e gli il le non per più si sono una
    à ao com da das do dos e em mais na no não o os ou para por que se uma
    aan bij dat de die een en het ik in is met niet op te van voor was zijn
    """.split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br"
    " math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg iframe object video audio canvas textarea select".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu fieldset label option head title datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Words of class and id that name a part beside the article.
PARTS = frozenset(
    """
    ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner
    sidebar aside comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice
    notices notification alert newsletter subscribe subscription signup login social share sharing related recommended
    recommendations menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar popup modal overlay widget
    pagination pager search toolbar copyright disclaimer teaser teasers trending paywall
    """.split()
)
#: Of these names, the ones that also count at the end of a longer name inside the article.
COMMENT_PARTS = frozenset("comment comments commentlist replies discussion".split())
#: Names that begin so state something about their element instead of naming a part.
STATES = frozenset("has with without no not is show hide".split())
#: Elements whose class and id say nothing about a part.
WHOLE = frozenset("html body article main".split())
#: These name a title block when they stand inside the article.
TOP_PARTS = frozenset(("header", "top"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SHORT, LONG = 70, 200
LOW_STOPS, HIGH_STOPS = 0.2, 0.3
LINKS_OUTSIDE, LINKS_INSIDE = 0.33, 0.6

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>"""
    r"""|<[a-zA-Z/!?][^>]*(?:>|\Z)"""
    r"""|(?P<text>[^<]+|<)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
WORD = re.compile(r"[^\W\d_]+")
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in DROPPED}

GOOD, BAD, SHORT_OPEN, LONG_OPEN = "good", "bad", "short", "near"


def _names_part(name: str, inside: bool) -> bool:
    """Whether one class or id names a part beside the article.

    A longer name counts by its first word (``comment-list``), and by its last one outside
    the article (``site-footer``); words in between, as in ``x-widget-text``, do not count.
    """
    words = [w.lower() for w in NAME_PART.findall(name)]
    if not words or words[0] in STATES:
        return False
    if words[0] in PARTS or words[-1] in (COMMENT_PARTS if inside else PARTS):
        return True
    return not inside and (words[0] in TOP_PARTS or words[-1] in TOP_PARTS)


def _is_part(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is a part beside the article."""
    if tag in BOILERPLATE or (tag == "header" and not inside):
        return True
    if not attrs.strip():
        return False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            if tag not in WHOLE and any(_names_part(v, inside) for v in value.split()):
                return True
        elif name == "role" and value.lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """The blocks of a page: text, linked characters, beside the article, inside it, a heading."""
    out: list = []
    stack: list[tuple[str, bool, bool]] = []  # tag, beside, inside
    parts: list[str] = []
    linked = anchors = 0
    heading = False
    at = 0

    def flush():
        nonlocal linked, heading
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, beside, inside = stack[-1] if stack else ("", False, False)
                out.append((text, linked, beside, inside, heading))
            parts.clear()
        linked = 0
        heading = False

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        if m["text"]:
            parts.append(m["text"])
            if anchors:
                linked += len(" ".join(m["text"].split()))
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in DROPPED:
            if not m["close"] and not m["attrs"].rstrip().endswith("/"):
                end = ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            anchors = 0 if m["close"] else 1
        block = tag not in INLINE
        if block:
            flush()
            anchors = 0 if tag != "a" else anchors
        if m["close"]:
            if block and any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in HEADINGS:
            heading = True
        if not block or tag in VOID:
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            stack.pop()
        _, beside, inside = stack[-1] if stack else ("", False, False)
        main = tag in ("article", "main")
        own = _is_part(tag, m["attrs"], inside or main)
        if main and not own and not inside:
            beside = any(s[1] and s[0] in ("section", "ul", "ol", "li", "aside") for s in stack)
        stack.append((tag, beside or own, inside or main))
    flush()
    return out


def first_pass(found: list[tuple[str, int, bool, bool, bool]]) -> list[str]:
    """The label of each block by itself."""
    has_main = any(inside and not beside for _, _, beside, inside, _ in found)
    labels = []
    for text, linked, beside, inside, _ in found:
        density = linked / len(text)
        if beside or (has_main and not inside) or ("©" in text and not inside and len(text) < LONG):
            labels.append(BAD)
        elif density > (LINKS_INSIDE if inside else LINKS_OUTSIDE):
            labels.append(BAD)
        elif inside and len(text) >= SHORT:
            labels.append(GOOD)
        elif len(text) < SHORT:
            labels.append(BAD if linked and not inside else SHORT_OPEN)
        else:
            words = WORD.findall(text.lower())
            stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            if stops >= HIGH_STOPS:
                labels.append(GOOD if len(text) > LONG else LONG_OPEN)
            else:
                labels.append(LONG_OPEN if stops >= LOW_STOPS else BAD)
    return labels


def second_pass(found: list[tuple[str, int, bool, bool, bool]], labels: list[str]) -> list[bool]:
    """Whether each block belongs to the main text; open blocks follow their decided neighbours."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            near[i] = last
            if labels[i] in (GOOD, BAD):
                last = i
    out = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            out.append(label == GOOD)
            continue
        text, _, _, inside, heading = found[i]
        sides = [(abs(i - j), labels[j]) for j in (before[i], after[i]) if j is not None and (not inside or found[j][3])]
        kinds = {k for _, k in sides}
        if not sides:
            out.append(inside or label == LONG_OPEN)
        elif len(kinds) == 1:
            out.append(kinds == {GOOD})
        elif heading or label == LONG_OPEN:
            # a heading belongs to what follows it
            follow = labels[after[i]] if heading and after[i] is not None else GOOD
            out.append(follow == GOOD)
        else:
            gap = {k: min(d for d, kind in sides if kind == k) for k in kinds}
            out.append(gap[GOOD] < gap[BAD] or (inside and gap[GOOD] == gap[BAD]))
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by a space."""
    if not page:
        return ""
    found = blocks(page)
    kept = second_pass(found, first_pass(found))
    return " ".join(b[0] for b, keep in zip(found, kept) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null, empty or article-less page gives an empty text. Broken markup is read as far
    as it goes: unclosed elements end with their parent, an unclosed script or comment
    with the page. Other columns of ``pages`` are ignored; equal rows give equal rows.
    """
    kept = pages.select("page_id", "url", "html")
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(_extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
