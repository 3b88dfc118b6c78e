"""Main text of web pages by equivalence-class template deduction.

A site's pages are made from one template. Its tokens here are containers, told apart by their path.
Over the pages of a host each token has an occurrence vector: how often each page has it. Tokens that
share a vector form an equivalence class, which is accepted or rejected as a whole: it is valid if most
of its tokens stand in one order on every page and all nest in tokens of valid classes. The valid classes that most pages have are the host's template. A block
of text that stands in a token on all pages that have the token is template too; other text is in slots.
Only slots are kept, and of these not what names tell to be menus, notices, adverts, forms and
the like. Text within an article or main element, and text that outweighs all slots of the host (its
pages may copy one another), is never taken for template.

Vectors are never gathered: a token carries two sums of hashes of (page, count), which are equal for
equal vectors and, but for chance of two to the minus 64, for no others. Sums add up before the
shuffle, so a host with a third of all pages is no more work than another. A class is no larger than
any page that has it, nor a template than twice the largest page, whatever a host's size.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator, Sequence
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.markup import blocks
from vertexloom.llm.op4_url_filter import url_parts
from vertexloom.session import cut, spread, table

#: Share of a host's pages that a template token is on.
SUPPORT = 0.5
#: Pages that must agree on a block of text for it to be the template's.
AGREEING_PAGES = 2
#: Templates are broadcast up to so many bytes, and beyond that joined by a shuffle.
BROADCAST_BYTES = 8 << 20

# What tells parts of a page that are not its article, by element and by words of class, id or role.
OTHER_ELEMENTS = frozenset(
    "head nav footer aside form noscript template svg canvas select datalist button dialog menu audio video".split()
)
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle promo promotion promoted sponsor sponsored sponsors "
    "banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription social share sharing related recommended recommendations "
    "comment comments respond reply replies disqus footer header masthead topbar widget widgets login signup search form "
    "pagination pager toolbar contentinfo complementary dialog hidden".split()
)
MAIN_WORDS = frozenset("article main content post entry story".split())
#: First words of names that tell what a container has, not what it is.
HAVING_WORDS = frozenset("with has have no without hide show".split())
# Elements that hold the whole page, so their names tell what the page has.
WHOLE_ELEMENTS = frozenset("html body".split())
# Classes of inline elements that are no part of the text around them.
INLINE_SKIPPED = frozenset("ad ads advert advertisement sponsored hidden".split())
# Elements that are text themselves, and words that only say how a part is laid out.
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr tbody caption figcaption".split())
LAYOUT_WORDS = frozenset("list area section wrapper container thread bar button buttons link links icon icons".split())
_WORD = re.compile(r"[a-z]+")


def _words(names: list[str]) -> list[str]:
    parts = [_WORD.findall(name) for name in names]
    return [w for own in parts if own and own[0] not in HAVING_WORDS for w in own]


def _other(label: str, within: str) -> bool:
    """Whether a container is no part of the article; ``within``: the path above it."""
    name, *words = label.split(".")
    if name in WHOLE_ELEMENTS:
        return "hidden" in words
    if name == "header":
        return "/article" not in within
    return name in OTHER_ELEMENTS or any(w in OTHER_WORDS for w in _words(words))


def _other_inside(label: str, within: str) -> bool:
    """Whether a container in the article's slot is none of its parts.

    There names are often the article's own, so one counts only if it says nothing else: all its words
    are those of other parts or of layout. Elements that are text themselves go only as adverts or hidden.
    """
    name, *words = label.split(".")
    if name in OTHER_ELEMENTS or name == "header" and "/article" not in within:
        return True
    if name in TEXT_ELEMENTS:
        return not INLINE_SKIPPED.isdisjoint(words)
    parts = [_WORD.findall(w) for w in words]
    return any(own and own[0] in OTHER_WORDS and all(w in OTHER_WORDS or w in LAYOUT_WORDS for w in own) for own in parts)


def _outside(path: str, main: str = "") -> bool:
    """Whether a container from ``main`` down to ``path`` is no part of the article."""
    above, other = main, _other_inside if main else _other
    for label in path[len(main) + 1 :].split("/") if len(path) > len(main) else ():
        if other(label, above):
            return True
        above = f"{above}/{label}"
    return False


def _under(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/")


def _rank(path: str) -> int:
    """How clearly a container says that it is the article's."""
    name, *words = path.rpartition("/")[2].split(".")
    if name == "article":
        return 3
    if name == "main" or "role-main" in words:
        return 2
    return int(name in ("div", "section", "td") and any(w in MAIN_WORDS for w in _words(words)))


def main_slot(chars: dict[str, int]) -> str:
    """The container of the article, among paths with the characters that stand directly in them.

    The clearest kind of container that has text wins, of several the one with most text, then the
    outer one. Without any, it is the container below which all slots lie that are no other part's. Names
    above an article or main element do not count against it if it has more text than all slots that are
    no other part's: they tell of the page's layout.
    """
    total: Counter = Counter()
    for path, n in chars.items():
        if n and not _outside(path):
            total[""] += n
            while path:
                total[path] += n
                path = path.rpartition("/")[0]
    named = [p for p in total if p and _rank(p)]
    inner: Counter = Counter()
    for path, n in chars.items():
        labels, at = path.split("/"), 0
        for label in labels[1:]:
            at += 1 + len(label)
            top = path[:at]
            if _rank(top) > 1 and not _outside(top, top.rpartition("/")[0]) and not _outside(path, top):
                inner[top] += n
            if label.partition(".")[0] in OTHER_ELEMENTS:
                break
    best = max(inner, key=lambda p: (inner[p], _rank(p), p), default="")
    if best and inner[best] > total[""]:
        return best
    if named:
        return min(named, key=lambda p: (-_rank(p), -total[p], len(p), p))
    tops = [p for p in total if p and total[p] == total[""]]
    return max(tops, key=len, default="")


def page_tokens(html: str | None) -> list[tuple[str, int, int, int]]:
    """``(path, count, rank, chars)`` of a page's containers; rank: their place among their kind of siblings."""
    found, opened = blocks(html, INLINE_SKIPPED)
    counts, chars, ranks = Counter(opened), Counter(), {}
    siblings: defaultdict = defaultdict(dict)
    for path in opened:
        own = siblings[path.rpartition("/")[0]]
        ranks[path] = own.setdefault(path, len(own))
    for path, text in found:
        chars[path] += len(text)
    return [(p, n, ranks[p], chars[p]) for p, n in counts.items()]


def _tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(host, page, *t) for host, page, html in zip(frame["host"], frame["page"], frame["html"]) for t in page_tokens(html)]
        yield pd.DataFrame(rows, columns=["host", "page", "path", "n", "rank", "chars"])


def _block_key(path: str, text: str) -> int:
    return int.from_bytes(blake2b(f"{path}\n{text}".encode(errors="surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each page's different blocks that are in no article or main element."""
    for frame in frames:
        rows: list[tuple] = []
        for host, html in zip(frame["host"], frame["html"]):
            chars: Counter = Counter()
            own: dict[str, bool] = {"": True}  # of a page without containers nothing is template
            for path, text in blocks(html, INLINE_SKIPPED)[0]:
                if path not in own:
                    labels = path.split("/")
                    own[path] = any(_rank(label) > 1 for label in labels)
                if not own[path]:
                    chars[path, _block_key(path, text)] += len(text)
            rows += [(host, path, key, n) for (path, key), n in chars.items()]
        yield pd.DataFrame(rows, columns=["host", "path", "key", "chars"])


def classes(pages: DataFrame) -> DataFrame:
    """Tokens of each host by class: ``(host, path, class, n_pages, total, chars, place, pages)``.

    ``pages`` has host, page (a number that tells pages apart) and html. Tokens of one ``class``
    have equal occurrence vectors. ``place``: least, greatest and sum of the pages' ranks of the token.
    """
    tokens = pages.mapInPandas(_tokens, "host string, page long, path string, n long, rank int, chars long")

    def sketch(seed: int) -> Column:
        return F.sum(F.xxhash64("page", "n", F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF)))

    by_token = tokens.groupBy("host", "path").agg(
        F.count("*").alias("n_pages"),
        F.sum("n").alias("total"),
        F.sum("chars").alias("chars"),
        F.array(F.min("rank"), F.max("rank"), F.sum("rank")).alias("place"),
        sketch(1).alias("s1"),
        sketch(2).alias("s2"),
    )
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"))
    named = by_token.join(hosts, "host")
    return named.select(
        "host", "path", F.struct("n_pages", "total", "s1", "s2").alias("class"), "n_pages", "total", "chars", "place", "pages"
    )


def valid_classes(of: dict[str, object], place: dict[str, Sequence[int]]) -> set:
    """The valid ones of the classes ``of`` tokens by path.

    A neighbour that is not on all pages moves the tokens after it alike, so order is that of siblings in
    the class: least, greatest and sum of their ranks must rise together.
    """
    own, siblings, wrong = Counter(of.values()), defaultdict(list), set()
    for path, name in of.items():
        siblings[name, path.rpartition("/")[0]].append(path)
    for paths in siblings.values():
        paths.sort(key=lambda p: tuple(place[p]))
        for one, other in zip(paths, paths[1:]):
            if not all(a < b for a, b in zip(place[one], place[other])):
                wrong |= {one, other}
    out = Counter(of[p] for p in wrong)
    kept = {name for name, n in own.items() if 2 * out[name] <= n}
    below: defaultdict = defaultdict(set)
    for path, name in of.items():
        above = path.rpartition("/")[0]
        if above:
            below[of.get(above)].add(name)
    gone = [*(set(own) - kept), None]
    while gone:
        for name in below[gone.pop()] & kept:
            kept.remove(name)
            gone.append(name)
    return kept


def agreed_texts(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(host, path, texts)``: of ``tokens`` the blocks that are on all pages that have the token; no more than a page has."""
    texts = pages.select("host", "html").mapInPandas(_texts, "host string, path string, key long, chars long")
    repeated = texts.groupBy("host", "path", "key").agg(F.count("*").alias("n_pages"), F.sum("chars").alias("chars"))
    found = repeated.where(F.col("n_pages") >= AGREEING_PAGES).join(tokens.select("host", "path", "n_pages"), ["host", "path", "n_pages"])
    return found.groupBy("host", "path").agg(F.collect_list(F.struct("key", "chars")).alias("texts"))


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``(host, main, tokens, fixed)``: of each host the article's slot, its template's tokens, outer ones first, and keys of its blocks."""
    often = cut(classes(pages).where(F.col("n_pages") >= support * F.col("pages")))
    token = F.struct("path", "chars", "place", F.coalesce("texts", F.array()).alias("texts"))
    named = often.join(agreed_texts(pages, often), ["host", "path"], "left").groupBy("host", "class").agg(F.collect_list(token).alias("tokens"))

    def nest(frame: pd.DataFrame) -> pd.DataFrame:
        of = {t["path"]: k for k, tokens in enumerate(frame["tokens"]) for t in tokens}
        token = {t["path"]: t for tokens in frame["tokens"] for t in tokens}
        valid = valid_classes(of, {p: t["place"] for p, t in token.items()})
        kept = sorted((p for p in of if of[p] in valid), key=lambda p: (p.count("/"), p))
        slots = sum(token[p]["chars"] - sum(t["chars"] for t in token[p]["texts"]) for p in kept)
        chars, fixed = {}, []
        for p in kept:
            own = [t for t in token[p]["texts"] if t["chars"] <= slots]
            chars[p] = token[p]["chars"] - sum(t["chars"] for t in own)
            fixed += [t["key"] for t in own]
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "main": [main_slot(chars)], "tokens": [kept], "fixed": [fixed]})

    return named.select("host", "tokens").groupBy("host").applyInPandas(nest, "host string, main string, tokens array<string>, fixed array<long>")


def main_text(html: str | None, main: str | None, fixed: Collection[int] = ()) -> str:
    """A page's blocks in the template's article slot, without the template's blocks; a page without that slot is its own template."""
    found, opened = blocks(html, INLINE_SKIPPED)
    if fixed:
        found = [(path, text) for path, text in found if _block_key(path, text) not in fixed]
    if not main or not any(_under(path, main) for path in opened):
        chars: Counter = Counter()
        for path, text in found:
            chars[path] += len(text)
        main = main_slot(chars)
    return "\n".join(text for path, text in found if _under(path, main) and not _outside(path, main) and not (path == "" and main))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(page_id, url, host, text, n_chars, main)`` for every row of ``pages``.

    Pages without a url, or with one without a host, are taken as one host. A null or empty page has
    the empty text. Repeated rows and ids all come back; an empty table gives no rows; other columns
    are not read. ``main`` is the path of the host's article slot, null if the host has no template.
    """
    host = url_parts(F.col(url_col))[0]
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html")
    )
    found = cut(templates(rows.select("host", F.xxhash64("page_id", "url").alias("page"), "html")).select("host", "main", "fixed"))
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("main") + 8 * F.size("fixed") + 32)).first()[0] or 0
    small = F.broadcast(found) if size <= broadcast_bytes else found.hint("shuffle_hash")

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(frame["html"], frame["main"], frame["fixed"])
            frame["text"] = [main_text(h, m, () if f is None else frozenset(f)) for h, m, f in rows]
            yield frame.drop(columns=["html", "fixed"])

    kind = dict(pages.dtypes)[id_col]
    joined = rows.join(small, "host", "left").select("page_id", "url", "host", "main", "fixed", "html")
    out = joined.mapInPandas(texts, f"page_id {kind}, url string, host string, main string, text string")
    return out.select("page_id", "url", "host", "text", F.length("text").cast("long").alias("n_chars"), "main")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(table(spark, sf_dir, "pages"))).select("page_id", "url", "text", "n_chars")


#: For pages whose article is an element of that name with headings and paragraphs only.
SQL = r"""
with cut as (
  select page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') as parts
  from pages),
clean as (
  select page_id, url, list_transform(parts, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) as parts
  from cut)
select page_id, url, text, length(text) as n_chars
from (select page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) as text from clean)
"""
