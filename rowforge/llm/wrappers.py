"""Main text of web pages by wrappers: union-free regular expressions of a host's pages.

A page is a stream of blocks, each known by the elements around it. Streams of one host are
aligned one after another; where they differ, the mismatch becomes a repeated group (equal
neighbours), an optional part (blocks of one side only) or a text slot (equal places with
different texts). The pages of a host are read through its wrapper, which says of every block
what the pages of the host have in its slot. Slots of other templates of the host have no say.

Where elements or their words name an article among the slots that a page fills, it is the
main text. On all other pages the slots decide: text that is in links, or the same on all pages
of the host, counts for nothing, and the container whose slots hold most of the rest on all
pages is the article (``by_text``). Neighbours with equal names are different containers.

Inference covers all pages without gathering a host in one task: pages are first reduced
to shapes, the folded streams; statistics of equal shapes are summed by a grouped
aggregation; and shapes are aligned in groups of a bounded number, level by level, until a
host has one wrapper.

Defined cases: a null or empty page has an empty text; a page without an address, or with
one that has no host, belongs to the host named by an empty text; equal rows are read
separately; a null id is carried; other columns are not read; of a page that its wrapper
does not accept, blocks count as the slots with the same elements around them; an empty table gives an empty
table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import compress, pairwise

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .html_tokens import Block, blocks

#: Shapes or wrappers that one task aligns at a time, about.
GROUP = 200
#: Longest repeated group that folding looks for.
LONGEST_GROUP = 6
#: How many times the text of a container its parent must hold to be the article instead.
SPREAD = 1.5

# Elements and words of class, id or role around what is not the article.
NOT_ARTICLE = frozenset("nav footer aside form menu dialog button select legend".split())
NOT_ARTICLE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs "
    "comment comments commentlist complementary consent contentinfo cookie cookies dialog disqus "
    "footer form header hidden login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices notification notifications pager pagination popup promo promotion recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar topbar widget widgets".split()
)
#: First parts of class words that only say what a page has or has not, and last parts of
#: those that name a place or a state of the layout.
MODIFIERS = frozenset("has no with without is not".split())
LAYOUT = frozenset(
    "area free layout left right closed open fixed sticky visible active inactive enabled disabled on off page site wide".split()
)
ARTICLE_ELEMENTS = ("article", "main")
ARTICLE_WORDS = frozenset("article articlebody article-body content entry entry-content main post post-content story".split())


def _says_outside(word: str) -> bool:
    if word in NOT_ARTICLE_WORDS:
        return True
    parts = word.replace("_", "-").split("-")
    return parts[0] not in MODIFIERS and parts[-1] not in LAYOUT and any(p in NOT_ARTICLE_WORDS for p in parts)


def outside(path: tuple[str, ...]) -> bool:
    """Whether an element around a block says that it is not the article."""
    inside = False
    for label in path:
        name, *words = label.split()
        if name in NOT_ARTICLE or name == "header" and not inside:
            return True
        if name not in ("html", "body", *ARTICLE_ELEMENTS) and any(map(_says_outside, words)):
            return True
        inside = inside or name in ARTICLE_ELEMENTS
    return False


def inner_path(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path from the first article or main element on, empty if there is none."""
    for i, label in enumerate(path):
        if label.split()[0] in ARTICLE_ELEMENTS:
            return path[i:]
    return ()


def article_rank(path: tuple[str, ...]) -> int:
    """How surely a path is inside the article: 3 by element, 1 by a word, 0 not at all."""
    names = {label.split()[0] for label in path}
    for rank, name in zip((3, 2), ARTICLE_ELEMENTS):
        if name in names:
            return rank
    words = {w for label in path for w in label.split()[1:]}
    return 1 if words & ARTICLE_WORDS else 0


# ------------------------------------------------------------------- wrappers


@dataclass(slots=True)
class Slot:
    """A place for text: how many texts, their characters, those in links, and whether
    they are all the same (``low == high``). ``begins`` says that a container begins with it."""

    path: tuple[str, ...]
    texts: int = 0
    chars: int = 0
    linked: int = 0
    low: int = 0
    high: int = 0
    begins: bool = False

    def take(self, other: Slot) -> Slot:
        return Slot(
            self.path, self.texts + other.texts, self.chars + other.chars, self.linked + other.linked,
            min(self.low, other.low), max(self.high, other.high), self.begins,
        )


@dataclass(slots=True)
class Part:
    """One place of a wrapper: a slot or a group, optional or not, repeated or not."""

    inner: list[Part] = field(default_factory=list)
    slot: Slot | None = None
    optional: bool = False
    repeated: bool = False

    def key(self) -> str:
        """What it matches, whether repeated, optional or neither."""
        if self.slot:
            return " > ".join(self.slot.path) + " ^" * self.slot.begins
        return "(" + " | ".join(p.key() for p in self.inner) + ")"

    def slots(self) -> Iterator[Slot]:
        if self.slot:
            yield self.slot
        for part in self.inner:
            yield from part.slots()


def _joined(a: Part, b: Part, repeated: bool = False) -> Part:
    """Two parts of the same key as one."""
    return Part(
        [_joined(x, y) for x, y in zip(a.inner, b.inner)],
        a.slot.take(b.slot) if a.slot else None,
        a.optional and b.optional if repeated else a.optional or b.optional,
        a.repeated or b.repeated or repeated,
    )


def fold(parts: list[Part]) -> list[Part]:
    """Equal neighbours, and equal neighbouring groups, become repeated ones."""
    for size in range(1, LONGEST_GROUP + 1):
        out: list[Part] = []
        keys: list[str] = []
        for part in parts:
            out.append(part)
            keys.append(part.key())
            while len(out) >= 2 * size and keys[-size:] == keys[-2 * size : -size]:
                pairs = [_joined(a, b) for a, b in zip(out[-2 * size : -size], out[-size:])]
                del out[-2 * size :], keys[-2 * size :]
                if size == 1:
                    pairs[0].repeated = True
                    out.append(pairs[0])
                else:
                    out.append(Part(pairs, repeated=True))
                keys.append(out[-1].key())
            if size > 1 and len(out) > size and out[-size - 1].repeated and not out[-size - 1].slot:
                group = out[-size - 1]  # one more turn of the group before
                if len(group.inner) == size and [p.key() for p in group.inner] == keys[-size:]:
                    group.inner = [_joined(a, b) for a, b in zip(group.inner, out[-size:])]
                    del out[-size:], keys[-size:]
        parts = out
    return parts


def align(a: list[Part], b: list[Part]) -> list[Part]:
    """A wrapper that accepts what either side accepts: a longest common subsequence of
    keys is joined, everything else is optional."""
    x, y = [p.key() for p in a], [p.key() for p in b]
    if x == y:
        return [_joined(p, q) for p, q in zip(a, b)]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    m, n = len(x) - head - tail, len(y) - head - tail
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[head + i] == y[head + j] else max(best[i + 1][j], best[i][j + 1])
    out = [_joined(p, q) for p, q in zip(a[:head], b[:head])]
    i = j = 0
    while i < m or j < n:
        p, q = a[head + i] if i < m else None, b[head + j] if j < n else None
        if p and q and x[head + i] == y[head + j]:
            out.append(_joined(p, q))
            i, j = i + 1, j + 1
        elif q is None or p and best[i + 1][j] >= best[i][j + 1]:
            p.optional = True
            out.append(p)
            i += 1
        else:
            q.optional = True
            out.append(q)
            j += 1
    out += [_joined(p, q) for p, q in zip(a[len(a) - tail :], b[len(b) - tail :])]
    return fold(out)


def begins(stream: list[Block]) -> list[bool]:
    """For every block whether it opens more than its own element: neighbours of equal names
    in different containers are told apart by the first of them."""
    out, before = [], ()
    for block in stream:
        common = 0
        for a, b in zip(before, block.elements):
            if a != b:
                break
            common += 1
        out.append(len(block.elements) - common > 1)
        before = block.elements
    return out


def shape_of(stream: list[Block]) -> list[Part]:
    out = []
    for block, first in zip(stream, begins(stream)):
        h = xxhash.xxh3_64_intdigest(block.text.encode("utf-8", "surrogatepass")) >> 1
        out.append(Part(slot=Slot(block.path, 1, len(block.text), block.linked, h, h, first)))
    return fold(out)


def dump(parts: list[Part], figures: bool = True) -> str:
    """Canonical text of a wrapper; without figures, of its shape."""

    def plain(part: Part):
        mark = "?" * part.optional + "+" * part.repeated
        if part.slot:
            s = part.slot
            return [mark + "^" * s.begins, list(s.path), *([s.texts, s.chars, s.linked, s.low, s.high] if figures else [])]
        return [mark, [plain(p) for p in part.inner], "group"]

    return json.dumps([plain(p) for p in parts], ensure_ascii=False, separators=(",", ":"))


def load(text: str, figures: list[list[int]] | None = None) -> list[Part]:
    """A wrapper from its text; figures of its slots in order, if they come apart from it."""
    rest = iter(figures or [])

    def part(x) -> Part:
        if x[-1] == "group":
            inner, slot = [part(p) for p in x[1]], None
        else:
            inner, slot = [], Slot(tuple(x[1]), *(next(rest) if figures is not None else x[2:]), begins="^" in x[0])
        return Part(inner, slot, "?" in x[0], "+" in x[0])

    return [part(x) for x in json.loads(text)]


def _own_text(slot: Slot) -> int:
    """Characters neither in links nor the same on all pages."""
    return 0 if slot.texts > 1 and slot.low == slot.high else slot.chars - slot.linked


def choose(parts: list[Part]) -> list[bool]:
    """For every slot in order, whether names leave it to the article of a page that fills all."""
    return by_names([s for p in parts for s in p.slots()])[0]


def by_names(slots: list[Slot]) -> tuple[list[bool], bool]:
    """For each of the slots that a page fills, whether names leave it to the article, and
    whether some name an article: the surest sign among the slots then decides."""
    open_slots = [not outside(s.path) for s in slots]
    inner = [inner_path(s.path) for s in slots]
    if not any(o and p for o, p in zip(open_slots, inner)):
        # all articles are in containers that speak against them: these decide nothing if most text is there
        freed = [bool(p) and not outside(p) for p in inner]
        if sum(map(_own_text, compress(slots, freed))) > sum(map(_own_text, compress(slots, open_slots))):
            open_slots = freed
    rank = max((article_rank(s.path) for s, o in zip(slots, open_slots) if o), default=0)
    return [o and article_rank(s.path) >= rank for s, o in zip(slots, open_slots)], rank > 0


def by_text(stream: list[Block], slots: list[Slot], allowed: list[bool]) -> list[bool]:
    """For each block of a page whether it belongs to the article, from the slots of the blocks.

    A block weighs its part of the text that its slot holds on all pages of the host, links
    and constant texts not counted. The article is the container whose own blocks weigh most,
    or one around it as long as that holds ``SPREAD`` times as much: the text is spread over
    several containers then. Blocks of others in it need text of their own.
    """
    around = {e for b in stream for e in b.elements[:-1]}
    outer: dict[int, int] = {}
    homes = []
    for b in stream:
        chain = (0, *b.elements)
        outer.update((inner, e) for e, inner in pairwise(chain))
        # text beside other blocks of an element is in that element, other text is the element's content
        homes.append(chain[-1] if len(chain) == 1 or chain[-1] in around else chain[-2])
    times: dict[int, int] = {}
    for s in slots:
        times[id(s)] = times.get(id(s), 0) + 1
    own: dict[int, float] = {}
    whole: dict[int, float] = {}
    for b, s, home, ok in zip(stream, slots, homes, allowed):
        weight = _own_text(s) / times[id(s)] if ok else 0.0
        own[home] = own.get(home, 0.0) + weight
        for e in (0, *b.elements):
            whole[e] = whole.get(e, 0.0) + weight
    if not any(own.values()):
        return allowed
    first = root = min(own, key=lambda e: (-own[e], e))
    while root in outer and whole[outer[root]] >= SPREAD * whole[root]:
        root = outer[root]
    return [
        ok and root in (0, *b.elements) and (home == first or _own_text(s) > 0)
        for b, s, home, ok in zip(stream, slots, homes, allowed)
    ]


def read(stream: list[Block], parts: list[Part], values: list) -> list | None:
    """For each block of a page the value of its slot, or None if the wrapper does not accept it."""
    found: list = []
    first: dict[int, set] = {}
    tokens = list(zip((b.path for b in stream), begins(stream)))

    def heads(part: Part) -> set:
        if id(part) not in first:
            if part.slot:
                first[id(part)] = {(part.slot.path, part.slot.begins)}
            else:
                first[id(part)] = set()
                for inner in part.inner:
                    first[id(part)] |= heads(inner)
                    if not inner.optional:
                        break
        return first[id(part)]

    def here(part: Part) -> bool:
        return len(found) < len(tokens) and tokens[len(found)] in heads(part)

    def run(some: list[Part], number: int) -> bool:
        for part in some:
            size = sum(1 for _ in part.slots())
            if not here(part) and not part.optional:
                return False
            while here(part):
                if part.slot:
                    found.append(values[number])
                elif not run(part.inner, number):
                    return False
                if not part.repeated:
                    break
            number += size
        return True

    return found if run(parts, 0) and len(found) == len(stream) else None


# ---------------------------------------------------------------------- Spark


_SHAPES = "host string, shape string, figures array<struct<texts:long,chars:long,linked:long,low:long,high:long>>"
_FIGURES = ("texts", "chars", "linked", "low", "high")


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in _FIGURES]))
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            shapes = [shape_of(blocks(page)) for page in part.column(1).to_pylist()]
            figures = [[{n: getattr(s, n) for n in _FIGURES} for p in shape for s in p.slots()] for shape in shapes]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([dump(s, figures=False) for s in shapes]), pa.array(figures, kind)],
                ["host", "shape", "figures"],
            )


def _align_all(rows: pd.DataFrame) -> pd.DataFrame:
    wrapper: list[Part] | None = None
    for text in sorted(rows["wrapper"]):
        parts = load(text)
        wrapper = parts if wrapper is None else align(wrapper, parts)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [dump(wrapper or [])]})


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """``host, wrapper`` from ``host, html``, all pages of a host taken together."""
    shapes = pages.select("host", F.coalesce("html", F.lit(""))).mapInArrow(_shapes, _SHAPES)
    slots = shapes.select("host", "shape", F.posexplode_outer("figures").alias("i", "f"))
    summed = slots.groupBy("host", "shape", "i").agg(
        F.struct(F.sum("f.texts"), F.sum("f.chars"), F.sum("f.linked"), F.min("f.low"), F.max("f.high")).alias("f")
    )
    # one row per slot of a shape: bounded by the page that has it
    gathered = summed.groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("i", "f"))).alias("figures"))

    @F.pandas_udf("string")
    def filled(shape: pd.Series, figures: pd.Series) -> pd.Series:
        return pd.Series([dump(load(s, [list(f["f"].values()) for f in fs if f["i"] is not None])) for s, fs in zip(shape, figures)])

    wrappers = durable(gathered.select("host", filled("shape", "figures").alias("wrapper")))
    while True:
        many = wrappers.groupBy("host").agg(F.ceil(F.count("*") / group).alias("groups"))
        most = many.agg(F.max("groups")).first()[0] or 0
        dealt = wrappers.join(many, "host").withColumn("g", F.pmod(F.xxhash64("wrapper"), "groups"))
        wrappers = durable(
            dealt.select("host", "g", "wrapper").groupBy("host", "g").applyInPandas(_align_all, "host string, wrapper string")
        )
        if most <= 1:
            return wrappers


@lru_cache(maxsize=256)
def _loaded(text: str) -> tuple[list[Part], list[Slot], dict[tuple[str, ...], Slot]]:
    parts = load(text)
    slots = [s for p in parts for s in p.slots()]
    by_path: dict[tuple[str, ...], Slot] = {}
    for slot in slots:
        by_path[slot.path] = by_path[slot.path].take(slot) if slot.path in by_path else slot
    return parts, slots, by_path


@lru_cache(maxsize=4096)
def _by_names(text: str, filled: tuple[int, ...]) -> tuple[dict[int, bool], bool]:
    slots = _loaded(text)[1]
    allowed, named = by_names([slots[i] for i in filled])
    return dict(zip(filled, allowed)), named


def article(page: str | None, wrapper: str | None) -> tuple[str, bool]:
    """Main text of a page, and whether its wrapper accepts it."""
    stream = blocks(page)
    wrapper = wrapper or "[]"
    parts, slots, by_path = _loaded(wrapper)
    places = read(stream, parts, list(range(len(slots))))
    accepted = places is not None
    if accepted:
        allowed_slots, named = _by_names(wrapper, tuple(sorted(set(places))))
        filled = [slots[i] for i in places]
        kept = [allowed_slots[i] for i in places]
    else:
        own: dict[tuple[str, ...], Slot] = {}
        for b in stream:  # no other page tells whether these are the same on all
            slot = Slot(b.path, 1, len(b.text), b.linked, 0, 1)
            own[b.path] = own[b.path].take(slot) if b.path in own else slot
        of_path = {path: by_path.get(path, slot) for path, slot in own.items()}
        allowed, named = by_names(list(of_path.values()))
        by = dict(zip(of_path, allowed))
        filled = [of_path[b.path] for b in stream]
        kept = [by[b.path] for b in stream]
    if not named:
        kept = by_text(stream, filled, kept)
    return "\n".join(b.text for b, keep in zip(stream, kept) if keep), accepted


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars, accepted`` of every page."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    wrappers = infer_wrappers(rows.select("host", "html"))

    @F.pandas_udf("struct<text:string,accepted:boolean>")
    def extract(page: pd.Series, wrapper: pd.Series) -> pd.DataFrame:
        found = [article(p, w) for p, w in zip(page, wrapper)]
        return pd.DataFrame(found, columns=["text", "accepted"])

    read_through = rows.join(wrappers, "host", "left").select("key", "url", extract("html", "wrapper").alias("e"))
    return read_through.select(
        F.col("key").alias(key), F.col("url").alias(url), "e.text", F.length("e.text").cast("long").alias("n_chars"), "e.accepted"
    )
