"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. A word's score is the log-odds of being article text of the word
itself (hashed into a table of fixed size) and of its context, and a tag's is negative, the more so the less it occurs within
articles; both come from labelled pages, those that mark their article, of which a bounded sample is counted. One scan
finds the contiguous region with the greatest sum. Of that region, what stands in menus, forms, notices, adverts, comments and the
like is left out, and the rest is joined by blocks.

Noise is told by tags, roles, and the last part of classes and ids; an article is none by its class, and where the word is
one that may name a subject (legal, discussion), the scores of what the element holds decide.

Defined results: null or empty html, or a page without words, gives an empty text; of equal regions the first
is taken; repeated rows give equal results; an empty table gives no rows; other columns pass through, and those of
the new names are replaced. Tags
that are not closed end with what holds them; a ``<`` that begins no tag is text. Reading takes time in proportion to the
page, however its tags are nested, unmatched or unclosed.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from itertools import accumulate
from math import log
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import chosen, least_keys

_SKIPPED = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
_NAME = r"<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)"
#: A quotation mark counts after an equals sign only, and where it has a partner.
TOKEN = re.compile(_SKIPPED + "|" + _NAME + r"(?P<attrs>(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.DOTALL)
#: From the first tag on that no unquoted > ends, tags end with any >.
LOOSE_TOKEN = re.compile(_SKIPPED + "|" + _NAME + r"(?P<attrs>[^>]*+)(?:>|\Z)", re.DOTALL)
START = re.compile(r"<(?:[!?]|/?[A-Za-z])")
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
CLOSING = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody tfoot thead tr ul".split()
)
HELD = BLOCK | frozenset("a button td th svg math object audio video canvas label".split())  # kept on the stack of open elements
LOOSE = frozenset("td th br wbr img input".split())  # part words but not blocks
ENDS = {  # elements that a tag of the same kind ends, if no element of the second set is between
    **dict.fromkeys(["li"], frozenset("ul ol menu".split())),
    **dict.fromkeys(["dt", "dd"], frozenset(["dl"])),
    **dict.fromkeys(["tr", "td", "th"], frozenset(["table"])),
    **dict.fromkeys(["option"], frozenset(["select"])),
    "a": frozenset(),
}
CLOSES_P = BLOCK - frozenset("option optgroup legend caption tbody thead tfoot tr body html head".split())
NOISE_TAGS = frozenset("nav footer aside form button select menu dialog svg object audio video canvas head search label fieldset".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe subscription signup login sidebar side menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments commentlist disqus respond reply replies discussion related recommended recommendations share sharing social "
    "widget toolbar pagination pager search alert disclaimer copyright legal toc skip masthead topbar".split()
)
DOUBTFUL = frozenset(  # words that may as well name what a text is about
    "alert disclaimer copyright legal discussion related recommended recommendations share sharing social search side menu "
    "reply replies respond promotion subscription toc skip overlay".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
TOPICS = frozenset("category tag topic".split())  # category-legal names a subject
HOLDERS = frozenset(  # a share-box is for sharing, a share-price is not
    "area bar block body bottom box btn button buttons container content form group holder icons inner item items large leaderboard left "
    "link links list outer panel popup posts rail right section slot small sticky stories top unit widget widgets wrap wrapper".split()
)
ABOUT_LAYOUT = frozenset("has with without no is layout page".split())  # has-sidebar says what else the page holds
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
ARTICLE = frozenset(["article", "main"])


PLAIN, NOISE, NAMED, REMARKS, DOUBT = range(5)  # no noise, noise for sure, by a class or id, by one of comments, by a doubtful one


def named(word: str, in_article: bool) -> int:
    """What a class or id says of an element: by its last part, those aside that only say that it holds something."""
    own = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower()) if x]
    if not own or own[0] in ABOUT_LAYOUT:
        return PLAIN
    while len(own) > 1 and (own[-1] in HOLDERS or own[-1][0].isdigit()):
        own.pop()
    if own[-1] in NOISE_WORDS:
        return DOUBT if own[-1] in DOUBTFUL or len(own) > 1 and own[0] in TOPICS else REMARKS if own[-1] in COMMENTS else NAMED
    return NAMED if own[-1] == "header" and not in_article else PLAIN


def noise(name: str, attrs: str, in_article: bool, in_text: bool = False) -> int:
    """Whether an element holds something other than the article, and what tells so."""
    if name in NOISE_TAGS or name == "header" and not in_article:
        if not (in_article and name in ("label", "fieldset") or in_text and name == "label"):
            return NOISE
    if not attrs or attrs.isspace() or name in ("html", "body", "main"):
        return PLAIN
    out = PLAIN
    for m in ATTR.finditer(attrs):
        if m[5]:
            return NOISE
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            for word in (m[2] or m[3] or m[4] or "").split():
                say = named(word, in_article)
                if name == "article" and not (in_article and say == REMARKS):
                    continue  # its text is the article, unless it is a comment within one
                if say and out in (PLAIN, DOUBT):
                    out = say
        elif key == "role" and value in NOISE_ROLES or key == "aria-hidden" and value == "true" or key == "hidden":
            return NOISE
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return NOISE
    return out


def read(page: str, keep: frozenset[int] = frozenset(), found: list[list[int]] | None = None) -> list[tuple]:
    """The page as ("w", context, text, number of words, is noise) and ("t", tag, ends a block, in article, is noise).
    Elements at the places ``keep`` are no noise whatever their class; ``found`` takes [place, kind, first token, past
    last token] of those that are noise by a class."""
    out: list[tuple] = []
    open_: list[list[int]] = []  # entries of found on the stack, each with its depth behind
    stack: list[tuple[str, bool, bool, str, bool]] = []  # name; noise, in article, nearest block and in a paragraph, with what holds it
    where: dict[str, list[int]] = {}  # depths of open elements by name
    solid: list[int] = []  # depths of those that aren't links or labels
    at, end = 0, len(page)

    def last(*names: str) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    def close_from(k: int) -> None:
        while len(stack) > k:
            where[stack.pop()[0]].pop()
        while solid and solid[-1] >= k:
            solid.pop()
        while open_ and open_[-1][4] >= k:
            open_.pop()[3:] = [len(out)]

    def text(piece: str) -> None:
        _, bad, inside, holder, _ = stack[-1] if stack else ("", False, False, "", False)
        if not piece.isspace():
            out.append(("w", (inside, bad, holder, any(x[0] == "a" for x in stack[-3:])), piece, len(piece.split()), bad))
        elif piece:
            out.append(("w", (inside, bad, "", False), piece, 0, bad))

    token = TOKEN
    while at < end:
        m = START.search(page, at)
        if not m:
            text(page[at:])
            break
        m = token.match(page, m.start())
        if not m:
            token = LOOSE_TOKEN
            continue
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name, closing, attrs = name.lower(), bool(m["end"]), m["attrs"] or ""
        if name in RAW and not closing:
            if not attrs.endswith("/") or name in ("script", "style", "textarea", "title"):
                stop = CLOSING[name].search(page, at)
                close = page.find(">", stop.end()) if stop else -1
                at = end if close < 0 else close + 1
            continue
        if closing:
            if where.get(name):
                k = where[name][-1]
                walls = [n for n in ("td", "th", "table") if n != name] if name not in ("table", "tr", "tbody", "body", "html") else []
                if last(*walls) < k:
                    close_from(k)
        else:
            if name in ENDS:
                k, bound, para = last(name), last(*ENDS[name]), last("p") if name in CLOSES_P else -1
                k = k if k > bound else para
                if k > bound:
                    close_from(k)
            elif name in CLOSES_P and solid and stack[solid[-1]][0] == "p":
                close_from(solid[-1])
            if name in HELD and name not in VOID:
                _, bad, inside, holder, in_p = stack[-1] if stack else ("", False, False, "", False)
                say = noise(name, attrs, inside, name == "label" and in_p)
                if say > NOISE:
                    if found is not None:
                        found.append([m.start(), say, len(out), end, len(stack)])
                        open_.append(found[-1])
                    say = PLAIN if m.start() in keep else say
                bad = bad or say != PLAIN
                where.setdefault(name, []).append(len(stack))
                if name not in ("a", "label"):
                    solid.append(len(stack))
                stack.append((name, bad, inside or name in ARTICLE and not bad, name if name in BLOCK else holder, in_p or name == "p"))
        _, bad, inside, *_ = stack[-1] if stack else ("", False, False)
        out.append(("t", name, name in BLOCK, inside, bad, name in LOOSE))
    close_from(0)
    return out


def reading(page: str, weights: Weights, least: float = 8.0) -> list[tuple]:
    """The page, where an element stays whose class is doubtful but whose words score as text, and, where no article is
    marked, one that holds most of the page's words (but comments)."""
    found: list[list[int]] = []
    tokens = read(page, found=found)
    if not found:
        return tokens
    is_marked = marked(tokens)
    size = [0, *accumulate(t[3] if t[0] == "w" else 0 for t in tokens)]
    score = [0.0, *accumulate(weights.plain(t) if t[0] == "w" else 0.0 for t in tokens)]
    keep = set()
    for at, kind, a, b in found:
        most = not is_marked and kind != REMARKS and 2 * (size[b] - size[a]) > size[-1]
        if most or kind == DOUBT and score[b] - score[a] >= least:
            keep.add(at)
    return read(page, frozenset(keep)) if keep else tokens


def marked(tokens: list[tuple]) -> bool:
    return any(t[0] == "w" and t[1][0] and not t[4] and t[3] for t in tokens)


def features(token: tuple) -> tuple[str, str]:
    """Names under which a token is counted: with its place against the marked article, and without."""
    if token[0] == "w":
        inside, bad, holder, link = token[1]
        kind = f"w {int(bad)} {holder if holder in BLOCK else '-'} {int(link)}"
        return f"{kind} {int(inside)}", kind
    return f"t {token[1] if token[1] in HELD else '-'}", ""


WORDS = 1 << 14


def word_feature(word: str) -> str:
    """The name under which a word is counted: one of WORDS, so that the table has a fixed size."""
    return f"v {crc32(word.lower().encode('utf-8', 'replace')) % WORDS}"


def count(pages: list[str]) -> Counter:
    """(feature, is article) counts over the pages that mark their article; a word counts once a page and side."""
    out: Counter = Counter()
    for page in pages:
        tokens = read(page)
        if marked(tokens):
            seen = set()
            for t in tokens:
                is_article = bool(t[1][0] and not t[4] if t[0] == "w" else t[3] and not t[4])
                for f in features(t):
                    if f:
                        out[f, is_article] += t[3] if t[0] == "w" else 1
                if t[0] == "w":
                    seen |= {(word_feature(x), is_article) for x in t[2].split()}
            out.update(seen)
            out["v", True] += 1  # pages, for words
    return out


def prior(feature: str) -> tuple[float, float]:
    """Pseudo-counts (article, other) that speak where labelled pages say nothing."""
    part = feature.split(" ")
    if part[0] == "t":
        return 1.0, 1.0
    if part[1] == "1":
        return 0.1, 10.0
    if len(part) > 4:
        return (10.0, 0.5) if part[4] == "1" else (0.3, 5.0)
    if part[2] == "li" and part[3] == "0":
        return 2.0, 1.5
    if part[3] == "1" or part[2] in ("li", "a", "option"):
        return 1.0, 2.0
    return (6.0, 1.0) if part[2] in ("p", "h1", "h2", "h3", "blockquote", "pre", "article") else (3.0, 2.0)


class Weights:
    """Scores learnt from counts of features within and without articles."""

    def __init__(self, counts: dict[tuple[str, bool], int]) -> None:
        self.score: dict[str, float] = {}
        self.word: dict[str, float] = {}
        self.near: dict[str, float] = {}  # scores of words met of late
        for f in {f for f, _ in counts}:
            inside, outside = counts.get((f, True), 0), counts.get((f, False), 0)
            if f[0] == "v":  # of the pages that have the word at all: on which side it stands, in half a point a word at most
                self.word[f] = max(-0.5, min(0.5, log((inside + 2) / (outside + 2)) / 4))
            else:
                self.score[f] = self.odds(f, inside, outside)

    def words(self, text: str) -> float:
        """The sum of the words' own scores."""
        if not self.word:
            return 0.0
        total, near = 0.0, self.near
        for x in text.split():
            v = near.get(x)
            if v is None:
                if len(near) > 100_000:
                    near.clear()
                v = near[x] = self.word.get(word_feature(x), 0.0)
            total += v
        return total

    @staticmethod
    def odds(f: str, inside: float, outside: float) -> float:
        a, b = prior(f)
        v = max(-4.0, min(4.0, log((inside + a) / (outside + b))))
        return v if f[0] == "w" else -0.1 - max(0.0, -v) / 4

    def plain(self, token: tuple) -> float:
        """The score of words as if they were neither noise nor in an article."""
        _, _, holder, link = token[1]
        f = f"w 0 {holder or '-'} {int(link)}"
        if f not in self.score:
            self.score[f] = self.odds(f, 0, 0)
        return self.score[f] * token[3] + self.words(token[2])

    def of(self, token: tuple, has_article: bool) -> float:
        if token[0] == "w" and token[1][0] and token[1][1]:
            return 0.0  # noise within the article is left out later and need not end the region
        full, kind = features(token)
        f = full if has_article or not kind else kind
        v = self.score.get(f)
        if v is None:
            v = self.score[f] = self.odds(f, 0, 0)
        if token[0] == "t":
            return v
        if token[4]:
            return max(v * token[3], -2.0)  # so that one long advert doesn't split a text
        return v * token[3] + self.words(token[2])


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, past last) of the contiguous run with the greatest positive sum; (0, 0) if there is none."""
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, at = run, (start, i + 1)
    return at


def extract(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    tokens = reading(page, weights)
    has = marked(tokens)
    a, b = best_region([weights.of(t, has) for t in tokens])
    blocks, now = [], []
    for t in tokens[a:b]:
        if t[0] == "w":
            if not t[4]:
                now.append(unescape(t[2]))
        elif t[2]:
            blocks.append("".join(now))
            now = []
        elif t[5]:
            now.append(" ")
    blocks.append("".join(now))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def learn(pages: DataFrame, html_col: str = "html", key: str = "page_id", sample: int = 2000) -> Weights:
    """Weights from at most ``sample`` pages that mark an article, those with the least hashes of key and html. What reaches
    the driver is one row for each feature; features are made of known tag names, and of words by a hash into WORDS."""
    rows = pages.select(F.col(html_col).alias("t"), F.lit(1).alias("y"), F.xxhash64(F.lit("page"), key, html_col).alias("h")).where(F.col("t").rlike("(?i)<(article|main)[\\s>]"))
    keys = least_keys(rows.select("y", "h"), sample)
    if not keys:
        return Weights({})

    def run(batches):
        total: Counter = Counter()
        seen: set[int] = set()
        for batch in batches:
            own = dict(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True))
            total.update(count([t for h, t in own.items() if h not in seen]))
            seen |= set(own)
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in names], pa.string()), pa.array([i for _, i in names], pa.bool_()), pa.array([total[k] for k in names], pa.int64())], ["f", "i", "n"])

    counted = rows.where(chosen(keys)).select("t", "h").mapInArrow(run, "f string, i boolean, n long")
    return Weights({(r["f"], r["i"]): r["n"] for r in counted.groupBy("f", "i").agg(F.sum("n").alias("n")).collect()})


def extract_pages(pages: DataFrame, weights: Weights, html_col: str = "html") -> DataFrame:
    """pages without their html, with ``text`` and ``n_chars``."""
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches):
        for batch in batches:
            texts = [extract(h.as_py(), weights) for h in batch.column(batch.schema.get_field_index(html_col))]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*keep).schema)
    return pages.select(*keep, html_col).mapInArrow(run, f"{fields}text string, n_chars long")
