"""HTML extraction by deducing each host's template from equivalence classes of tokens.

A token is a tag or a word together with its place in the tag tree. Its
occurrence vector says how often it occurs on each page of a host (a token that
occurs once on nearly every page it is on counts once on the others, too, where
the data happens to repeat it); tokens with equal vectors form a class. A class
is valid if it has ``min_size`` tokens on ``min_share`` of the pages, if its tokens
come in one order on every page (tokens that don't are dropped), and if it
nests: of any two classes either none has tokens within the other, or all of
one lies in one and the same gap between two neighbouring tokens of the other.
A class is placed inside the innermost one around it, to any depth. The tree of
valid classes, read from left to right, is the template.

A page is matched to the template by position: of tokens that belong once, the
longest run of occurrences in the template's order is template; a class that
repeats is followed token by token. What stands between, also a word that the
template has elsewhere, is the page's data: its slots, tags and scripts aside.

A host's skeleton are the pages on which at least half of its common tokens
occur once; common are those that occur once on ``min_share`` of its pages. Empty
and odd pages (errors, say) thus have no say in the template; it is applied to
them all the same.

Vectors are never built over a whole host: a token's vector is summed up as
``sum(count * r(page))`` modulo 2**64 with a random value per page, which is
equal for equal vectors and adds up over groups of pages. Hosts of up to
``GROUP_PAGES`` pages are one group; larger ones are split by hash of the page,
their tokens are counted over the whole host first, the groups' sums are added,
and what must hold on every page must hold in every group, in the same order.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.arrow_text import mix64
from recollect.llm.common import checkpointed, need, shuffle_partitions, table

MIN_PAGES = 3
MIN_SIZE = 3
MIN_SHARE = 0.5
GROUP_PAGES = 2048
#: Share of its pages on which a token occurs once for it to count once on all of them.
USUAL = 0.9
#: The table of split hosts is broadcast up to so many rows, joined by sort-merge beyond.
BROADCAST_HOSTS = 100_000

#: Markup: comments, scripts and styles with what they hold, tags. What lies between is text.
_MARKUP = re.compile(r"(<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)|<[a-z/!?][^>]*(?:>|\Z))", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-z][a-z0-9:-]*)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDED = frozenset("p li td tr option".split())
_K = np.uint64(0x9E3779B97F4A7C15)


class Page:
    """Tokens of one page: text, whether it is a tag, and the index of its place in the tag tree."""

    __slots__ = ("places", "tag", "tokens", "where")

    def __init__(self, text: str):
        self.tokens: list[str] = []
        self.places = [""]
        known = {"": 0}
        stack: list[str] = []
        at = 0
        tokens, runs, kinds, places = self.tokens, [], [], []  # runs of tokens of one kind and place
        for k, part in enumerate(_MARKUP.split(text)):
            if not k % 2:
                if part and (words := part.split()):
                    tokens += words
                    runs.append(len(words))
                    kinds.append(False)
                    places.append(at)
                continue
            m = _NAME.match(part)
            if m is None:
                continue
            name = m[1].lower()
            if name == "script" or name == "style":
                continue
            runs.append(1)
            kinds.append(True)
            if part[1] == "/":
                tokens.append(f"</{name}>")
                places.append(at)
                if name not in stack:
                    continue
                while stack.pop() != name:
                    pass
            else:
                tokens.append(f"<{name}>")
                if name in _ENDED and stack and stack[-1] == name:
                    stack.pop()  # these end where the next begins
                if name in _VOID:
                    places.append(at)
                    continue
                stack.append(name)
            path = "/".join(stack)
            at = known.setdefault(path, len(known))
            if at == len(self.places):
                self.places.append(path)
            if part[1] != "/":
                places.append(at)
        self.tag, self.where = np.repeat(np.array(kinds, dtype=bool), runs), np.repeat(np.array(places, dtype=np.int64), runs)


class _Hashes(dict):
    """Hashes of strings, remembered up to a bound."""

    def __missing__(self, s: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[s] = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def _hash(strings: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, strings), dtype=np.uint64, count=len(strings))


def keys(page: Page) -> np.ndarray:
    """A hash of each token with its place."""
    if not page.tokens:
        return np.zeros(0, np.uint64)
    return mix64(_hash(page.tokens) ^ (_hash(page.places) * _K)[page.where])


def ordered(rows: np.ndarray) -> np.ndarray:
    """Which columns of a class keep one order. ``rows``: positions, one row an occurrence of the class, one column a token.

    The token whose rank varies most is dropped until all rows agree.
    """
    keep = np.arange(rows.shape[1])
    while len(keep) > 1:
        rank = np.argsort(np.argsort(rows[:, keep], axis=1), axis=1)
        spread = rank.max(axis=0) - rank.min(axis=0)
        if not spread.any():
            break
        # all of the worst go at once unless that is everything
        worst = np.flatnonzero(spread == spread.max())
        gone = worst if len(worst) <= len(keep) // 4 else worst[np.argsort(-rank[:, worst].var(axis=0), kind="stable")][: max(1, len(worst) // 8)]
        keep = np.delete(keep, gone)
    return keep


def once_on(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that occur once on a page, page by page, and whose page each is."""
    own = [u[c == 1] for u, c in (np.unique(t, return_counts=True) for t in tokens)]
    return np.concatenate(own) if own else np.zeros(0, np.uint64), np.repeat(np.arange(len(own)), [len(t) for t in own])


def skeleton(tokens: list[np.ndarray], min_share: float, common: np.ndarray | None = None) -> np.ndarray:
    """The pages on which at least half of the common tokens occur once; by default those are counted on the pages themselves."""
    flat, page = once_on(tokens)
    if common is None:
        name, pages = np.unique(flat, return_counts=True)
        common = name[pages >= max(min_share * sum(len(t) > 0 for t in tokens), 1)]
    if len(common) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(2 * np.bincount(page[np.isin(flat, common)], minlength=len(tokens)) >= len(common))


def counted(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, pages it is on, pages it is on once)."""
    name, on = np.unique(np.concatenate([np.unique(t) for t in tokens]) if tokens else np.zeros(0, np.uint64), return_counts=True)
    one, times = np.unique(once_on(tokens)[0], return_counts=True)
    once = np.zeros(len(name), np.int64)
    once[np.searchsorted(name, one)] = times
    return name, on, once


class _Class:
    """A class that is valid so far: where its occurrences lie."""

    def __init__(self, members: np.ndarray, rows: np.ndarray, page: np.ndarray, clean: np.ndarray):
        self.members, self.rows, self.page, self.clean = members, rows, page, clean
        self.size = rows.shape[1]
        self.spots = np.sort(rows.ravel())
        self.low, self.high = rows.min(axis=1), rows.max(axis=1)
        self.parent: _Class | None = None
        self.gap = 0

    def gap_of(self, other: "_Class", begin: np.ndarray) -> int | None:
        """The gap of this class that all of the other's occurrences lie in (0: outside); None: not one."""
        see = self.clean[other.page]
        low, high, page = other.low[see], other.high[see], other.page[see]
        if len(low) == 0:
            return 0
        at = np.searchsorted(self.spots, low)
        if (at != np.searchsorted(self.spots, high)).any():
            return None
        gap = (at - np.searchsorted(self.spots, begin[page])) % self.size
        return int(gap[0]) if (gap == gap[0]).all() else None


def deduce(tokens: list[np.ndarray], weights: np.ndarray, min_share: float, min_size: int = MIN_SIZE, wanted: np.ndarray | None = None, usual: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(token, signature, pages, total, place) of the tokens on ``min_share`` of a group's pages, or of those ``wanted``.

    ``place`` is the token's index in the template, read from left to right; -1: it has none.
    """
    n = len(tokens)
    sizes = [len(t) for t in tokens]
    page, begin = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes if n else np.zeros(0, np.int64)
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")  # page and position stay in order within a token
    token, owner = flat[order], page[order]
    if len(token) == 0:
        z = np.zeros(0, np.uint64)
        return z, z, z.astype(np.int64), z.astype(np.int64), z.astype(np.int64)
    head = np.append(True, token[1:] != token[:-1])
    start = np.flatnonzero(head)
    total = np.diff(np.append(start, len(token)))
    # runs: a token's occurrences on one page
    run = np.flatnonzero(head | np.append(True, owner[1:] != owner[:-1]))
    first_run = np.searchsorted(run, start)
    single = np.diff(np.append(run, len(token))) == 1
    pages = np.diff(np.append(first_run, len(run)))
    once = np.add.reduceat(single.astype(np.int64), first_run)
    name = token[start]
    counts_once = once >= USUAL * pages if usual is None else np.isin(name, usual)
    sig = np.where(counts_once, np.add.reduceat(weights[owner[run]], first_run), np.add.reduceat(weights[owner], start))
    total = np.where(counts_once, pages, total)
    often = np.flatnonzero(pages >= max(min_share * n, 1) if wanted is None else np.isin(name, wanted))
    name, sig, pages, total, start, first_run = (x[often] for x in (name, sig, pages, total, start, first_run))
    place = np.full(len(often), -1, dtype=np.int64)
    klass = np.unique(np.stack([sig, pages.astype(np.uint64), total.astype(np.uint64)], axis=1), axis=0, return_inverse=True)[1].ravel()
    members = np.argsort(klass, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(klass[members]) != 0))
    found = []
    for x, y in zip(bounds, np.append(bounds[1:], len(members))):
        g = members[x:y]
        if len(g) < min_size:
            continue
        m, clean = pages[g[0]], np.ones(n, dtype=bool)
        if total[g[0]] == m:
            # once a page: pages where the data repeats one of the tokens say nothing on order and nesting
            rows = np.stack([order[run[first_run[i] : first_run[i] + m]] for i in g], axis=1)
            good = np.stack([single[first_run[i] : first_run[i] + m] for i in g], axis=1).all(axis=1)
            clean[page[rows[~good, 0]]] = False
            rows = rows[good]
        else:
            rows = np.stack([order[start[i] : start[i] + total[i]] for i in g], axis=1)
        if len(rows) == 0:
            continue
        stay = ordered(rows)
        stay = stay[np.argsort(rows[0, stay])]
        rows = rows[:, stay]
        # one occurrence of the class must be over before the next begins
        if len(stay) >= min_size and not (rows.max(axis=1)[:-1] >= rows.min(axis=1)[1:]).any():
            found.append(_Class(g[stay], rows, page[rows[:, 0]], clean))
    # what lies around others comes first: on most pages, least often, widest
    span = lambda c: float((c.high - c.low).mean())
    found.sort(key=lambda c: (-pages[c.members[0]], total[c.members[0]], -span(c), int(name[c.members].min())))
    kept: list[_Class] = []
    for c in found:
        root = total[c.members[0]] == pages[c.members[0]]
        if not kept and not root:
            continue
        gaps = [p.gap_of(c, begin) for p in kept]
        if any(g is None for g in gaps):
            continue
        around = [(span(p), k) for k, (p, g) in enumerate(zip(kept, gaps)) if g]
        if around:
            k = min(around)[1]
            c.parent, c.gap = kept[k], gaps[k]
        kept.append(c)
    where = {id(c): float(np.median(c.low - begin[c.page])) for c in kept}
    inside: dict[tuple[int, int], list[_Class]] = {}
    for c in kept:
        inside.setdefault((id(c.parent), c.gap) if c.parent else (0, 0), []).append(c)
    count = 0

    def lay(c: _Class) -> None:
        nonlocal count
        for col, i in enumerate(c.members.tolist()):
            place[i] = count
            count += 1
            for child in sorted(inside.get((id(c), col + 1), []), key=lambda x: where[id(x)]):
                lay(child)

    for c in sorted(inside.get((0, 0), []), key=lambda x: where[id(x)]):
        lay(c)
    return name, sig, pages, total, place


def _increasing(x: np.ndarray) -> np.ndarray:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    tops: list[int] = []
    before = []
    for i, v in enumerate(x.tolist()):
        k = bisect_left(tails, v)
        before.append(tops[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            tops.append(i)
        else:
            tails[k], tops[k] = v, i
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1], dtype=np.int64)


class Template:
    """A host's template: its tokens, their places, and for those that repeat their class, index in it and its size."""

    def __init__(self, token: np.ndarray, place: np.ndarray, repeats: np.ndarray, klass: np.ndarray, col: np.ndarray, size: np.ndarray):
        order = np.argsort(token)
        self.token, self.place, self.repeats, self.klass, self.col, self.size = (x[order] for x in (token, place, repeats, klass, col, size))

    def match(self, key: np.ndarray) -> np.ndarray:
        """Which of a page's tokens are template."""
        fixed = np.zeros(len(key), dtype=bool)
        if len(self.token) == 0 or len(key) == 0:
            return fixed
        at = np.minimum(np.searchsorted(self.token, key), len(self.token) - 1)
        spot = np.flatnonzero(self.token[at] == key)
        at = at[spot]
        single = ~self.repeats[at]
        own, place = spot[single], self.place[at[single]]
        fixed[own if (place[1:] > place[:-1]).all() else own[_increasing(place)]] = True
        spot, at = spot[~single], at[~single]
        for c in np.unique(self.klass[at]):
            mine = np.flatnonzero(self.klass[at] == c)
            col, size = self.col[at[mine]], int(self.size[at[mine[0]]])
            if ((col[1:] > col[:-1]) | ((col[:-1] == size - 1) & (col[1:] == 0))).all():
                fixed[spot[mine]] = True
                continue
            last, cols = size - 1, col.tolist()
            for i, v in enumerate(cols):
                # a row goes on; or begins, unless what comes next carries on the row before
                if v > last or v == 0 and (last == size - 1 or i + 1 == len(cols) or cols[i + 1] <= last):
                    last = v
                    fixed[spot[mine[i]]] = True
        return fixed


_NO_TEMPLATE = Template(np.zeros(0, np.uint64), *(np.zeros(0, np.int64),), np.zeros(0, bool), *(np.zeros(0, np.int64),) * 3)


def slots_of(page: Page, template: Template, key: np.ndarray | None = None) -> tuple[list[dict[str, str]], int]:
    """The page's slots (path, text) and the number of its tokens that are template."""
    fixed = template.match(keys(page) if key is None else key)
    out: list[dict[str, str]] = []
    # a run of words ends at a template token or at a change of place
    data = np.flatnonzero(~fixed & ~page.tag)
    if len(data):
        walls, tokens = np.cumsum(fixed), page.tokens
        cut = np.flatnonzero((walls[data[1:]] != walls[data[:-1]]) | (page.where[data[1:]] != page.where[data[:-1]])) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(data)]):
            first, last = int(data[a]), int(data[b - 1])
            text = " ".join(tokens[first : last + 1] if last - first == b - a - 1 else [tokens[i] for i in data[a:b].tolist()])
            out.append({"path": page.places[page.where[first]], "text": _html.unescape(text) if "&" in text else text})
    return out, int(fixed.sum())


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_size: int = MIN_SIZE, min_share: float = MIN_SHARE, group_pages: int = GROUP_PAGES) -> DataFrame:
    """(page_id, host, template_tokens, slots, text) of every page with HTML.

    ``slots`` are (path, text) in page order, ``text`` their texts, one a line;
    ``template_tokens`` counts the page's tokens that are template. Hosts of under
    ``min_pages`` pages have no template: all their text is data.

    A null or hostless URL belongs to the host ''. A null ``html`` gives no row, an
    empty one no slots. A null ``page_id`` is carried along; repeated rows count as
    pages each. Long pages are read whole, broken markup is read as far as it goes.
    Other columns are ignored.

    Of tokens whose places tie, as of repeated rows, all are kept. No rows in, no rows out.

    In a host of several groups the first count leaves out tokens on under a quarter
    of ``min_share`` of a group's pages; what is on three quarters of ``min_share``
    of the host's by that count is then counted in full, so that none on
    ``min_share`` is missed, however the pages are spread over the groups.
    """
    base = need(pages, "page_id", "url", "html").filter("html is not null").select("page_id", host_of(F.col("url")).alias("host"), "html")
    hosts = checkpointed(base.groupBy("host").agg(F.count("*").alias("host_pages")))
    large = hosts.filter(F.col("host_pages") > group_pages).select("host", F.ceil(F.col("host_pages") / F.lit(float(group_pages))).cast("int").alias("groups"))
    split = large.count()
    if split <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    placed = base.join(large, "host", "left").select("page_id", "host", "html", F.coalesce("groups", F.lit(1)).alias("groups"), F.pmod(F.xxhash64("page_id", "html"), F.coalesce("groups", F.lit(1))).cast("int").alias("part"))
    # an exchange of its own, which the deduction and the extraction both read: the pages are shuffled once
    placed = placed.repartition(shuffle_partitions(pages.sparkSession), "host", "part")

    def counts(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        if group["groups"][0].as_py() == 1:  # left out here, not before, so that the exchange is the same
            return pa.table({"host": pa.array([], pa.string()), "token": pa.array([], pa.int64()), "on": pa.array([], pa.int64()), "once": pa.array([], pa.int64())})
        tokens = [t for t in (keys(Page(x)) for x in group["html"].to_pylist()) if len(t)]
        name, on, once = counted(tokens)
        often = on >= min_share / 4 * len(tokens)
        name, on, once = name[often], on[often], once[often]
        # the row without a token says how many pages there are
        return pa.table({"host": pa.array([key[0].as_py()] * (len(name) + 1), pa.string()), "token": pa.array([*name.view(np.int64).tolist(), None], pa.int64()), "on": pa.array([*on.tolist(), len(tokens)], pa.int64()), "once": pa.array([*once.tolist(), 0], pa.int64())})

    given = placed.withColumns({c: F.lit(None).cast("array<long>") for c in ("common", "wanted", "usual")})
    if split:
        seen = placed.groupBy("host", "part").applyInArrow(counts, "host string, token long, on long, once long")
        seen = seen.groupBy("host", "token").agg(F.sum("on").alias("on"), F.sum("once").alias("once")).withColumn("full", F.max(F.when(F.col("token").isNull(), F.col("on"))).over(Window.partitionBy("host")))
        lists = seen.filter((F.col("token").isNotNull()) & (F.col("on") >= F.lit(0.75 * min_share) * F.col("full")))
        lists = lists.groupBy("host").agg(F.collect_list("token").alias("wanted"), F.collect_list(F.when(F.col("once") >= F.lit(min_share) * F.col("full"), F.col("token"))).alias("common"), F.collect_list(F.when(F.col("once") >= F.lit(USUAL) * F.col("on"), F.col("token"))).alias("usual"))
        lists = lists.join(large, "host").select("host", "wanted", "common", "usual", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
        given = placed.join(lists, ["host", "part"], "left")

    def sums(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        n, parts = group.num_rows, group["groups"][0].as_py()
        base_pages = 0
        if n < min_pages and parts == 1:
            cols = [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
        else:
            order = np.argsort(_hash([str(x) for x in group["page_id"].to_pylist()]), kind="stable")
            texts = group["html"].to_pylist()
            weights = mix64(_hash([str(x) for x in group["page_id"].to_pylist()]) ^ _hash(texts))
            twin = np.zeros(n, dtype=np.uint64)  # repeated rows are pages of their own
            seen: dict[int, int] = {}
            for i, w in enumerate(weights.tolist()):
                twin[i] = seen[w] = seen.get(w, -1) + 1
            weights = mix64(weights + twin * _K)
            tokens = [keys(Page(texts[i])) for i in order]
            common, wanted, usual = (np.array(group[c][0].as_py() or [], dtype=np.int64).view(np.uint64) if parts > 1 else None for c in ("common", "wanted", "usual"))
            stay = skeleton(tokens, min_share, common)
            if parts == 1 and len(stay) < min_pages:
                stay = stay[:0]
            base_pages = len(stay)
            cols = deduce([tokens[i] for i in stay], weights[order][stay], min_share, min_size, wanted, usual)
        name, sig, on, total, spot = cols
        part = key[1].as_py()
        # the row without a token says how many pages the skeleton has
        m = len(name) + 1
        return pa.table({"host": pa.array([key[0].as_py()] * m, pa.string()), "part": pa.array([part] * m, pa.int32()), "groups": pa.array([parts] * m, pa.int32()), "token": pa.array([*name.view(np.int64).tolist(), None], pa.int64()), "sig": np.append(sig.view(np.int64), 0), "on": np.append(on, base_pages), "total": np.append(total, 0), "place": np.append(spot, -1)})

    found = given.groupBy("host", "part").applyInArrow(sums, "host string, part int, groups int, token long, sig long, on long, total long, place long")
    # windows within a host, one exchange for all: read once, in one job with the extraction, so that both share the pages' exchange
    host, token = Window.partitionBy("host"), Window.partitionBy("host", "token")
    # vectors add up over the groups (modulo 2**64, hence by halves), and a token must have a place in each where it is
    low, high = F.col("sig").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("sig", 32)
    merged = found.withColumn("host_pages", F.sum(F.when(F.col("token").isNull(), F.col("on"))).over(host)).filter("token is not null")
    merged = merged.select("host", "part", "groups", "token", "host_pages", F.col("place").alias("p"), *[x.over(token).alias(c) for c, x in {"on": F.sum("on"), "total": F.sum("total"), "lo": F.sum(low), "hi": F.sum(high), "least": F.min("place"), "place": F.min_by("place", "part"), "first": F.min("part")}.items()])
    merged = merged.filter("least >= 0").filter((F.col("host_pages") >= min_pages) & (F.col("on") >= F.col("host_pages") * F.lit(min_share)))
    carry = F.shiftrightunsigned("lo", 32)
    merged = merged.withColumn("klass", F.xxhash64(F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF)), (F.col("hi") + carry).bitwiseAND(F.lit(0xFFFFFFFF)), "on", "total"))
    # the groups must give a class one order: its tokens' ranks are compared
    ranked = merged.withColumn("r", F.row_number().over(Window.partitionBy("host", "part", "klass").orderBy("p")))
    agreed = ranked.withColumns({"r1": F.min("r").over(token), "r2": F.max("r").over(token)}).filter("r1 = r2 and part = first")
    own = Window.partitionBy("host", "klass")
    agreed = agreed.withColumns({"col": F.row_number().over(own.orderBy("place")) - 1, "size": F.count("*").over(own)}).filter(F.col("size") >= min_size)
    template = agreed.groupBy("host", "groups").agg(F.collect_list(F.struct("token", "place", (F.col("total") != F.col("on")).alias("repeats"), "klass", F.col("col").cast("long").alias("col"), "size")).alias("template"))
    template = template.select("host", "template", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    # `groups` is carried along so that both uses of the pages have the same columns
    matched = placed.join(template, ["host", "part"], "left").select("page_id", "host", "html", "groups", "template")

    def fill(batches):
        for b in batches:
            rows = []
            lists, hosts_ = b.column("template"), b.column("host").to_pylist()
            known: dict[str, Template] = {}
            for i, text in enumerate(b.column("html").to_pylist()):
                if hosts_[i] not in known:
                    fixed = lists[i].values
                    if fixed is None:
                        known[hosts_[i]] = _NO_TEMPLATE
                    else:
                        col = {k: fixed.field(k).to_numpy(zero_copy_only=False) for k in ("token", "place", "repeats", "klass", "col", "size")}
                        known[hosts_[i]] = Template(col["token"].view(np.uint64), *(col[k] for k in ("place", "repeats", "klass", "col", "size")))
                rows.append(slots_of(Page(text), known[hosts_[i]]))
            kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id").cast(pa.int64()), b.column("host"), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[0] for r in rows], kind), pa.array(["\n".join(s["text"] for s in r[0]) for r in rows], pa.string())],
                ["page_id", "host", "template_tokens", "slots", "text"],
            )

    return matched.mapInArrow(fill, "page_id long, host string, template_tokens int, slots array<struct<path:string,text:string>>, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
