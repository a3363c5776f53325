"""HTML extraction by wrapper induction: pages of a host are aligned, what is constant is template, what varies content.

Every host gets up to three patterns: the pages with the smallest hashes of their source by three seeds. Each page of the
host is aligned with each pattern by simple tree matching: roots match if their labels (tag and class) are equal,
children are matched in order so that the most nodes match, and equal texts decide ties. A node of a pattern is constant
if nine in ten of the aligned pages (``LEAST`` at least) have the same text there; a constant node is template and
leaves every page that has it at the same path. Nodes whose texts vary are slots, and what fills them is content,
as are nodes that a pattern doesn't have. A page that shares more than half of its text with the pattern (a copy of it)
says nothing of what varies and isn't counted, and those that are must have different contents (``LEAST`` of 63
classes by the longest text), so copies of a page don't turn it into a template.

What stands beside the article by HTML's own marks (menus, forms and so on, see ``dom``) is left out before that.

All pages of a host count. Patterns and templates go to the pages by broadcast if they are small; otherwise
pages meet them sorted by host, where hosts with very many pages are dealt to several tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_BYTES, SALTS, arrow_rows, hot_keys, maybe_broadcast, plan_bytes, written
from ._text import slices, tidied
from .dom import Block, cleaned, read

PATTERNS = 3
#: A template node is the same in this share of the aligned pages, and in so many of them.
CONSTANT, LEAST = 0.9, 5
#: Pages that share more of their text with a pattern are copies of it.
COPY = 0.5
#: Cells of a table of two lists of children; longer lists are halved first.
CELLS = 1 << 22
#: Counts that a task keeps before it passes them on.
KEPT_COUNTS = 200_000
#: Hosts whose patterns a worker keeps read.
READ_HOSTS = 64
#: A matched pair counts so much more than an equal text that texts only decide ties.
_PAIR = 1 << 20


class Node:
    """A block for matching: its label, text, and number of its shape (label and shapes of children)."""

    __slots__ = ("label", "text", "kids", "shape", "runs", "path", "chars")

    def __init__(self, block: Block, path: int):
        self.label, self.runs = block.label, block.runs
        self.text = "\n".join(r[1] for r in block.runs)
        self.chars = len(self.text)
        self.path = xxhash.xxh64_intdigest(self.label, path)
        self.kids: list[Node] = []
        self.shape = -1


class Matcher:
    """Simple tree matching; sizes of matchings are kept by shape, as they don't depend on texts."""

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.sizes: dict[tuple[int, int], int] = {}
        self.of: list[tuple] = []

    def full(self) -> bool:
        return len(self.sizes) > 1 << 20 or len(self.of) > 1 << 20

    def tree(self, block: Block, path: int = 0) -> Node:
        node = Node(block, path)
        node.kids = [self.tree(kid, node.path) for kid in block.kids]
        self._number(node)
        return node

    def _number(self, node: Node) -> None:
        key = (node.label, *(k.shape for k in node.kids))
        if key not in self.shapes:
            self.shapes[key] = len(self.of)
            self.of.append(key)
        node.shape = self.shapes[key]

    def size(self, a: int, b: int) -> int:
        """The most nodes of two shapes that match."""
        x, y = self.of[a], self.of[b]
        if x[0] != y[0]:
            return 0
        if len(x) == 1 or len(y) == 1:
            return 1
        if (a, b) not in self.sizes:
            self.sizes[a, b] = 1 + int(_last_row(*self._weights(x[1:], y[1:]))[-1])
        return self.sizes[a, b]

    def _weights(self, xs: tuple, ys: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shapes' matching sizes, and which row and column each child has."""
        ux, uy = ({s: k for k, s in enumerate(dict.fromkeys(shapes))} for shapes in (xs, ys))
        return np.array([[self.size(p, q) for q in uy] for p in ux], np.int64), np.array([ux[s] for s in xs]), np.array([uy[s] for s in ys])

    def matched(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """The pairs of nodes of a matching of the most nodes (of these, one with the most equal texts among siblings)."""
        todo = [(a, b)] if a.label == b.label else []
        while todo:
            x, y = todo.pop()
            yield x, y
            if len(x.kids) == len(y.kids) == 1:
                todo += [(x.kids[0], y.kids[0])] if self.size(x.kids[0].shape, y.kids[0].shape) else []
            elif x.kids and y.kids:
                weights, ix, iy = self._weights(tuple(k.shape for k in x.kids), tuple(k.shape for k in y.kids))
                texts: dict[str, int] = {}
                tx = np.array([texts.setdefault(k.text, len(texts)) for k in x.kids])
                ty = np.array([texts.setdefault(k.text, len(texts)) for k in y.kids])
                todo += [(x.kids[i], y.kids[j]) for i, j in _pairs(weights * _PAIR, ix, iy, tx, ty)]


def _rows(weights, ix, iy, tx=None, ty=None) -> Iterator[np.ndarray]:
    """The rows of the table of best sums for beginnings of the two lists, from the first on."""
    row = np.zeros(len(iy) + 1, np.int64)
    for i in range(len(ix)):
        w = weights[ix[i]][iy]
        if tx is not None:
            w = w + ((ty == tx[i]) & (w > 0))
        new = row.copy()
        np.maximum(row[1:], row[:-1] + w, out=new[1:])
        row = np.maximum.accumulate(new)
        yield row


def _last_row(weights, ix, iy, tx=None, ty=None) -> np.ndarray:
    row = np.zeros(len(iy) + 1, np.int64)
    for row in _rows(weights, ix, iy, tx, ty):  # noqa: B007
        pass
    return row


def _pairs(weights, ix, iy, tx, ty) -> list[tuple[int, int]]:
    """Places of matched children, for the largest sum of weights in order."""
    todo, out = [(0, len(ix), 0, len(iy))], []
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        part = weights, ix[a:b], iy[c:d], tx[a:b], ty[c:d]
        if (b - a) * (d - c) <= CELLS or b - a == 1:
            table = [np.zeros(d - c + 1, np.int64), *_rows(*part)]
            i, j = b - a, d - c
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j))
            continue
        half = (a + b) // 2
        down = _last_row(weights, ix[a:half], iy[c:d], tx[a:half], ty[c:d])
        up = _last_row(weights, ix[half:b][::-1], iy[c:d][::-1], tx[half:b][::-1], ty[c:d][::-1])[::-1]
        cut = c + int(np.argmax(down + up))
        todo += [(a, half, c, cut), (half, b, cut, d)]
    return out


def node_key(node: Node) -> int:
    """A node's path and text as a 64-bit number."""
    return xxhash.xxh64_intdigest(node.text.encode("utf-8", "surrogatepass"), node.path) - (1 << 63)


def nodes(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += x.kids


def same_nodes(matcher: Matcher, pattern: Node, page: Node, chars: int) -> set[int] | None:
    """Keys of the pattern's nodes that have the same text in the page (of ``chars`` characters); None if the page is a copy of the pattern, or has no text."""
    same = [x for x, y in matcher.matched(pattern, page) if x.text and x.text == y.text]
    if not chars or sum(x.chars for x in same) > COPY * chars:
        return None
    return {node_key(x) for x in same}


def content_bit(page: Node) -> int:
    """One of 64 bits, by the page's longest text: pages of different contents mostly have different ones."""
    longest = max((x.text for x in nodes(page)), key=lambda t: (len(t), t))
    return 1 << xxhash.xxh64_intdigest(longest) % 63


def texts_of(page: Block, template: set[int]) -> list[str]:
    """The texts of a page's article in order, without the nodes in the template."""
    runs, todo = [], [(page, 0)]
    while todo:
        block, path = todo.pop()
        if template:
            node = Node(block, path)
            path = node.path
        if block.runs and not (template and node_key(node) in template):
            runs += block.runs
        todo += [(kid, path) for kid in block.kids]
    return [r[1] for r in sorted(runs)]


def host_of(url: Column) -> Column:
    """After the first :// up to the next of / ? #, A-Z lower-cased; null without one."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"://([^/?#]*)", 1))
    host = F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(host != "", host)


Rows = Iterator[tuple[list[bytes], pa.RecordBatch]]


def _met(pages: DataFrame, side: DataFrame, hosts: DataFrame, run: Callable[[Rows], Iterator[pa.RecordBatch]], schema: str, limit: int) -> DataFrame:
    """``run`` over (what ``side`` has for a host, rows of that host) for all pages (page_id, url, html, host).

    ``side`` is a written table (host, payload binary), ``hosts`` one of (host, n). Rows come in slices of about 1 MB of html.
    """
    columns = ["page_id", "url", "html"]
    if plan_bytes(side) <= limit:
        found: dict[str, list[bytes]] = {}
        for host, payload in side.toLocalIterator():  # ``limit`` bytes at most
            found.setdefault(host, []).append(bytes(payload))
        ship = pages.sparkSession.sparkContext.broadcast({h: sorted(p) for h, p in found.items()})

        @tidied
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Rows:
                for batch in batches:
                    for part in slices(batch, "html"):
                        names = part.column(3).to_pylist()
                        for host in dict.fromkeys(names):
                            at = pa.array([k for k, h in enumerate(names) if h == host], pa.int64())
                            yield ship.value.get(host, []), pa.RecordBatch.from_arrays([part.column(k).take(at) for k in range(3)], columns)

            yield from run(rows())

        return pages.select(*columns, "host").mapInArrow(spread, schema)

    hot = F.broadcast(hot_keys(hosts, "host"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    own = pages.join(hot, "host", "left").select(*columns, "host", salt.alias("salt"), F.lit(None).cast("binary").alias("payload"))
    theirs = side.join(hot, "host", "left").select(*(F.lit(None).cast(t).alias(c) for c, t in zip(columns, ("long", "string", "string"))), "host", F.explode(copies).alias("salt"), "payload")

    @tidied
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Rows:
            now, payloads = None, []
            for batch in batches:
                names, sides = list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())), batch.column(5).to_pylist()
                at = 0
                while at < batch.num_rows:
                    if names[at] != now:
                        now, payloads = names[at], []
                    if sides[at] is not None:  # before the pages of the host
                        payloads.append(sides[at])
                        at += 1
                        continue
                    end = at + 1
                    while end < batch.num_rows and names[end] == now and sides[end] is None:
                        end += 1
                    for part in slices(batch.slice(at, end - at), "html"):
                        yield payloads, part.select(columns)
                    at = end

        yield from run(rows())

    dealt = theirs.union(own).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("payload").isNull(), "payload")
    return dealt.mapInArrow(stream, schema)


def _reader(payloads_to: Callable[[list[bytes]], object]) -> Callable[[list[bytes]], object]:
    """Keeps what was made of the last hosts' payloads."""
    kept: dict[int, tuple[list[bytes], object]] = {}

    def get(payloads: list[bytes]) -> object:
        key = id(payloads)
        if key not in kept or kept[key][0] is not payloads:
            if len(kept) >= READ_HOSTS:
                kept.pop(next(iter(kept)))
            kept[key] = payloads, payloads_to(payloads)
        return kept[key][1]

    return get


def _align(rows: Rows) -> Iterator[pa.RecordBatch]:
    """(pattern, key, n, contents): in how many pages a pattern's node has its text, and bits of their contents; key null: of all pages aligned with it."""
    matcher = Matcher()
    patterns = _reader(lambda payloads: [(pattern_name(p), p[8:].decode()) for p in payloads])
    trees: dict[int, Node] = {}
    counts: Counter = Counter()
    contents: dict[tuple, int] = {}

    def passed_on() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([counts[k] for k in keys], pa.int64()), pa.array([contents[k] for k in keys], pa.int64())], ["pattern", "key", "n", "contents"])
        counts.clear()
        contents.clear()
        return out

    for payloads, part in rows:
        for html in part.column(2).to_pylist():
            if not html or not payloads:
                continue
            if matcher.full() or len(trees) > 4 * READ_HOSTS:
                matcher, trees = Matcher(), {}
            page = matcher.tree(cleaned(read(html)))
            chars, bit = sum(x.chars for x in nodes(page)), content_bit(page)
            for name, source in patterns(payloads):
                if name not in trees:
                    trees[name] = matcher.tree(cleaned(read(source)))
                same = same_nodes(matcher, trees[name], page, chars)
                if same is not None:
                    for key in ((name, None), *((name, key) for key in same)):
                        counts[key] += 1
                        contents[key] = contents.get(key, 0) | bit
        if len(counts) > KEPT_COUNTS:
            yield passed_on()
    yield passed_on()


def _extract(rows: Rows) -> Iterator[pa.RecordBatch]:
    template_of = _reader(lambda payloads: {int.from_bytes(p, "big", signed=True) for p in payloads})
    for payloads, part in rows:
        template = template_of(payloads) if payloads else set()
        texts = ["\n".join(texts_of(cleaned(read(html)), template)) if html else "" for html in part.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _hosted(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))


def induce(pages: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Tables of the templates' nodes (host, payload: a node's key) and of the hosts (host, n)."""
    pages = _hosted(pages).withColumn("h", F.when(F.col("html") != "", F.xxhash64("html")))
    smallest = [F.min(F.when(F.col("h").isNotNull(), F.struct(F.xxhash64("h", F.lit(k)).alias("o"), "h"))).alias(f"p{k}") for k in range(PATTERNS)]
    hosts = written(pages.groupBy("host").agg(F.count("*").alias("n"), *smallest))
    picks = written(hosts.where("host <> '' and n > 1").select("host", F.explode(F.array(*(f"p{k}.h" for k in range(PATTERNS)))).alias("h")).where("h is not null").distinct())
    # a key of the join is one source, so none is hot but by equal copies
    sources = pages.select("host", "h", "html").join(maybe_broadcast(picks, limit), ["host", "h"], "left_semi")
    payload = F.concat(F.unhex(F.lpad(F.hex(F.xxhash64("host")), 16, "0")), F.col("html").cast("binary"))
    patterns = written(sources.select("host", payload.alias("payload")).distinct())
    counts = _met(pages, patterns, hosts, _align, "pattern long, key long, n long, contents long", limit)
    counts = written(counts.groupBy("pattern", "key").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("contents")).alias("contents")))
    aligned = counts.where("key is null").select("pattern", F.col("n").alias("of"))
    constant = counts.where("key is not null").join(aligned, "pattern").where((F.col("contents") >= LEAST) & (F.col("n") >= CONSTANT * F.col("of")))
    names = patterns.select("host", F.xxhash64("payload").alias("pattern"))
    return written(constant.join(names, "pattern").select("host", _payload(F.col("key")).alias("payload")).distinct()), hosts


def pattern_name(payload: bytes) -> int:
    """As Spark's xxhash64 of it."""
    h = xxhash.xxh64_intdigest(payload, seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def _payload(key: Column) -> Column:
    return F.unhex(F.lpad(F.hex(key), 16, "0"))


def extract(pages: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html); blocks are joined by line ends.

    Null and empty pages have an empty text. Pages without a host (no ://) aren't aligned with others. Repeated rows stay,
    null ids and urls stay null, a table without rows gives none, ties between patterns can't be (all of them are used).
    Other columns aren't read. Text without any markup is one block. ``limit``: bytes up to which tables are broadcast.
    """
    arrow_rows(pages.sparkSession)
    template, hosts = induce(pages, limit)
    return _met(_hosted(pages), template, hosts, _extract, "page_id long, url string, text string, n_chars long", limit)


#: For the pages of the tables, whose articles are marked as such and hold headings and paragraphs only. These four references count without a
#: semicolon too, as in HTML: a heading can end within one.
ORACLE_SQL = r"""
with a as (
  select page_id, url, regexp_split_to_array(coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), ''), '</?(p|h1)>') as parts
  from pages),
b as (
  select page_id, url, list_filter(list_transform(parts, lambda p: trim(regexp_replace(
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(p, '<br>', ' '), '<[^>]*>', '', 'g'),
           '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda p: p <> '') as blocks
  from a)
select page_id, url, coalesce(array_to_string(blocks, chr(10)), '') as text,
       cast(length(coalesce(array_to_string(blocks, chr(10)), '')) as bigint) as n_chars
from b
"""
