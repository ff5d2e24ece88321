"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is read as a sequence of tags and stretches of words. Words score above zero, by kind (within an
article or main element, elsewhere on a page that has one, on a page that has none, within a link), and
tags below zero, by name. One scan finds the contiguous region with the greatest sum, and its
bounds are those of the result; no element sets them. The weights are those that agree best with labelled
pages: ``fit`` moves one weight at a time over a scale of values and keeps what raises the mean
word F1 of the extracted regions and the share of pages that come out exactly.

Elements that never hold main text (scripts, styles, navigation, headers, footers, asides,
forms, and elements whose class, id or role names an advert, notice, menu, sidebar or reader
comments) are cut out before, so a region that spans one doesn't return it.

Text: character references decoded, white space inside a block turned into one space and trimmed,
blocks joined in page order by one space. Null, empty and textless pages give the empty string;
unclosed and misnested tags close at their ancestor's end or the page's end. Nothing is capped. Of regions
with equal sums the first counts, and the longest of those. Repeated rows and empty tables give as many
rows. Kept columns named text or n_chars are replaced by the result's.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML.
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object noembed noframes xmp".split())
CUT = frozenset("nav header footer aside form button select menu dialog head label fieldset figcaption option datalist".split()) - {"figcaption"}
BLOCK = frozenset("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
CLOSES = {name: [x for x, by in CLOSED_BY.items() if name in by] for name in set().union(*CLOSED_BY.values())}
SCOPE = frozenset("article section div body main html table td th li ul ol blockquote".split())
# Words in class, id and role attributes that mark other content.
OTHER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adslot|banner|sponsor\w*|promo\w*|comments?|respond|reply|replies|discussion|disqus|sidebar|side-?bar|widget\w*|aside|nav|navbar|navigation|menu\w*|breadcrumbs?|footer|header|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-?up|login|share|sharing|social|related|recommend\w*|pagination|pager|legal|copyright|disclaimer|hidden|search(?:box|form)?|complementary|contentinfo|dialog|search)(?:$|[\s_-])",
    re.I,
)
WHOLE = re.compile(r"^(?:ads?|advert\w*|comments?|comment[-_]?(?:body|item|list)|sponsored|promo|related|teaser|widget|notice)$", re.I)
_WITH = re.compile(r"(?:has|with|no|without|is)[-_]", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Weights:
    """Score of one word by kind, and of one tag by name (``other`` for the rest)."""

    word: dict[str, float] = field(default_factory=lambda: {"home": 1.0, "plain": 1.0, "away": 1.0, "link": 1.0})
    tag: dict[str, float] = field(default_factory=dict)
    other: float = -3.0


@dataclass
class _Token:
    kind: str  # "text", "open" or "close"
    name: str
    text: str = ""
    cut: bool = False
    home: int = 0  # number of the enclosing article or main element, 0 for none
    link: bool = False


def _is_other(name: str, attrs: str) -> bool:
    if name in CUT:
        return True
    if not attrs or name in ("html", "body"):
        return False
    pattern = WHOLE if name in ("article", "main") else OTHER
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role") and any(pattern.search(x) for x in value.split() if not _WITH.match(x)):
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDES.search(value):
            return True
    return False


def tokens(page: str) -> list[_Token]:
    """Tags and text of a page in order, each marked with whether it lies in a cut container."""
    out: list[_Token] = []
    stack: list[tuple[str, bool, int, bool]] = []  # name, cut, home, link
    is_open: dict[str, int] = {}
    homes = 0
    at, n = 0, len(page)

    def state() -> tuple[bool, int, bool]:
        return stack[-1][1:] if stack else (False, 0, False)

    def pop(k: int) -> None:
        while len(stack) > k:
            name, cut, home, _ = stack.pop()
            is_open[name] -= 1
            out.append(_Token("close", name, cut=cut, home=home))

    def text(s: str) -> None:
        if s:
            out.append(_Token("text", "", s, *state()))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name, attrs = m[2].lower(), m[3] or ""
        if m[1]:
            if name == "br":
                out.append(_Token("open", "br", cut=state()[0], home=state()[1]))
                continue
            for k in range(len(stack) - 1, -1, -1) if is_open.get(name) else ():
                if stack[k][0] == name:
                    pop(k)
                    break
                if name not in SCOPE and stack[k][0] in ("article", "main", "td", "th", "table") and name not in BLOCK:
                    break
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            continue
        for k in range(len(stack) - 1, -1, -1) if any(is_open.get(x) for x in CLOSES.get(name, ())) else ():
            if name in CLOSED_BY.get(stack[k][0], ()):
                pop(k)
                break
            if stack[k][0] in SCOPE and stack[k][0] not in CLOSED_BY:
                break
        cut, home, link = state()
        cut = cut or _is_other(name, attrs)
        if name in ("article", "main") and not home and not cut:
            homes += 1
            home = homes
        out.append(_Token("open", name, cut=cut, home=home))
        if name not in VOID and not attrs.rstrip().endswith("/"):
            stack.append((name, cut, home, link or name == "a"))
            is_open[name] = is_open.get(name, 0) + 1
    pop(0)
    return out


def _kinds(toks: list[_Token]) -> list[tuple[str, int]]:
    """Of each token, the name of its weight and how often it counts: words by their kind, tags with a sign before the name, "" for what is cut."""
    homes = any(t.home and t.kind == "text" and not t.cut and t.text.strip() for t in toks)
    out = []
    for t in toks:
        if t.cut:
            out.append(("", 0))
        elif t.kind == "text":
            out.append(("home" if t.home else "link" if t.link else "away" if homes else "plain", len(t.text.split())))
        else:
            out.append(("<" + t.name, 1))
    return out


def _scores(kinds: list[tuple[str, int]], w: Weights) -> list[float]:
    return [0.0 if not k else n * w.word[k] if k[0] != "<" else w.tag.get(k[1:], w.other) for k, n in kinds]


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous [start, end) with the greatest sum, the earliest and longest of equals; empty if no sum is above zero."""
    best, start, end = 0.0, 0, 0
    run, begin = 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, begin = 0.0, i
        run += s
        if run > best or run == best and run > 0 and begin == start:
            best, start, end = run, begin, i + 1
    return start, end


def _render(toks: Iterable[_Token]) -> str:
    blocks: list[list[str]] = [[]]
    for t in toks:
        if t.kind == "text":
            if not t.cut:
                blocks[-1].append(t.text)
        elif t.name in BLOCK and blocks[-1]:
            blocks.append([])
    parts = (" ".join(_html.unescape("".join(b)).split()) for b in blocks)
    return " ".join(p for p in parts if p)


def extract(page: str | None, w: Weights) -> str:
    """The main text of one page."""
    if not page:
        return ""
    toks = tokens(page)
    start, end = best_region(_scores(_kinds(toks), w))
    return _render(toks[start:end])


# The scale on which fit moves a weight; only its sign is given.
TAG_SCALE = tuple(-0.02 * 3.0**k for k in range(8))
WORD_SCALE = (0.02, 0.1, 0.25, 0.5, 1.0, 2.0)


def _inside(toks: list[_Token], kinds: list[tuple[str, int]], label: str) -> list[int]:
    """Of each token, its words if it belongs to the labelled text: the first run of stretches that spells it, else those found in order."""
    spelt = ["".join(_html.unescape(t.text).split()) if k and k[0] != "<" else "" for t, (k, _) in zip(toks, kinds, strict=True)]
    want, whole = "".join(label.split()), "".join(spelt)
    ends = [0]
    for s in spelt:
        ends.append(ends[-1] + len(s))
    bounds, at = set(ends), whole.find(want) if want else -1
    while at >= 0 and not (at in bounds and at + len(want) in bounds):
        at = whole.find(want, at + 1)
    if at >= 0:
        return [n if s and at <= e and e + len(s) <= at + len(want) else 0 for s, e, (_, n) in zip(spelt, ends, kinds, strict=False)]
    out, at = [], 0
    for s, (_, n) in zip(spelt, kinds, strict=True):
        place = want.find(s, at) if s else -1
        at = place + len(s) if place >= 0 else at
        out.append(n if place >= 0 else 0)
    return out


def fit(pages: list[tuple[str, str]], *, rounds: int = 3) -> Weights:
    """Weights from (page, main text) pairs, by coordinate ascent on the word F1 of the extracted regions plus 1 for exact ones.

    All weights start alike (1 a word, the middle of the scale a tag); a tag of which no value is better than another
    keeps its value.
    """
    cases = []
    for page, label in pages:
        toks = tokens(page)
        kinds = _kinds(toks)
        inside = _inside(toks, kinds, label)
        words = [n if k and k[0] != "<" else 0 for k, n in kinds]
        cases.append((kinds, inside, words, sum(inside)))

    def quality(w: Weights, which) -> float:
        total = 0.0
        for c in which:
            kinds, inside, words, all_ = cases[c]
            a, z = best_region(_scores(kinds, w))
            got = sum(words[a:z])
            both = sum(inside[a:z])
            total += (2 * both / (got + all_) if got + all_ else 1.0) + (both == got == all_)
        return total

    middle = TAG_SCALE[len(TAG_SCALE) // 2]
    uses: dict[str, list[int]] = {}
    for c, (kinds, *_) in enumerate(cases):
        for k in {k for k, _ in kinds if k}:
            uses.setdefault(k, []).append(c)
    w = Weights(tag={k[1:]: middle for k in uses if k[0] == "<"}, other=middle)
    for _ in range(rounds):
        for k in sorted(uses):
            table, name, scale = (w.tag, k[1:], TAG_SCALE) if k[0] == "<" else (w.word, k, WORD_SCALE)
            best, now = quality(w, uses[k]), table[name]
            for v in scale:
                table[name] = v
                q = quality(w, uses[k])
                if q > best + 1e-9:
                    best, now = q, v
            table[name] = now
    return w


def labelled_pages(n: int = 60) -> list[tuple[str, str]]:
    """Labelled example pages from templates: each page and its main text. Pass your own to ``fit`` for other sites.

    Titles and closing paragraphs may be of one word; what stands around the text is in plain elements without
    telling names: lists of links, notices of up to 30 words, closing lines.
    """
    out = []
    for i in range(n):
        words = [f"w{(i * 31 + k * 17) % 997}" for k in range(400)]
        paras = [" ".join(words[k : k + 12 + (i * k) % 40]) + "." for k in range(0, 40 * (3 + i % 6), 40)]
        if i % 3 == 0:
            paras.append(words[7])
        title = " ".join(words[: 1 + i % 7])
        nav = "<ul>" + "".join(f'<li><a href="/{k}">{words[k]}</a></li>' for k in range(4 + i % 9)) + "</ul>"
        side = f"<div><ul>{''.join(f'<li><a href=x>{x}</a></li>' for x in words[50 : 58 + i % 5])}</ul></div>"
        notice = f"<div>{' '.join(words[60 : 64 + (i * 7) % 27])}</div>"
        marks = ("<p>{}</p>", "<p><b>{}</b><br>", "<p><i>{}</i> <em>x</em></p>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<p><span>{}</span> <strong>y</strong></p>", "<pre><code>{}</code></pre>", "<table><tr><td>{}</td></tr></table>")
        body = "".join(marks[k % 2 if i % 2 else (i + k) % len(marks)].format(p) for k, p in enumerate(paras))
        box = ("article", "div", "section", "main")[i % 4]
        end = f"<div>Copyright 2020 &middot; <a href=/t>Terms</a> <a href=/p>Privacy</a> {' '.join(words[90 : 92 + i % 9])}</div>"
        page = f"<html><head><title>{title}</title></head><body><div>{nav}</div>{side}{notice}<{box}><h1>{title}</h1>{body}</{box}>{end}</body></html>"
        out.append((page, " ".join([title, re.sub(r"<[^>]*>", " ", body)])))
    return out


def extract_pages(pages: DataFrame, weights: Weights | None = None, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of every page."""
    w = weights or fit(labelled_pages())
    spark: SparkSession = pages.sparkSession
    shared = spark.sparkContext.broadcast(w)
    names = [n for n in keep if n not in ("text", "n_chars")]
    page = "html"
    while page in names:
        page += "_"
    rows = pages.select(*names, F.col(html_col).cast("string").alias(page))
    schema = T.StructType([*rows.drop(page).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        w = shared.value
        for b in batches:
            texts = [extract(p.as_py(), w) for p in b.column(page)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"]
            )

    return rows.mapInArrow(run, schema)
