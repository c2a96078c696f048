"""N-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct k-word shingles. Two documents link when 100 * intersection >= percent * union. Rows with
equal sets are one node, known by a 64-bit key of the set.

1. Groups. Shingles are hashed into groups; how many groups depends on the band of the set's size. Linked sets differ in
   at most d = (100 - percent) * n / percent shingles, hence in at most d groups. So if all group contents have one order,
   here by how many nodes hold them and then by value, the first d + 1 of a set's contents hold one that also is among the
   first of the other set. Contents that one node alone holds come first and need no listing: most documents have more
   than d of them and are done. What common passages fill comes last and is not listed.
2. Blocks. Nodes listed under one content form a block. Each node is first held against the hub (smallest node) with
   which it shares most contents, then against its other hubs as far as no link has joined them yet.
3. Points. In blocks that are not one component by then, the counts of hash groups are a node's point, of about as many
   coordinates as the set has shingles. A packed R-tree over a page of points answers, for every node outside the
   block's largest component, which others may overlap enough: the overlap is at most the sum of the coordinate minima,
   for a tree node taken over its corner of maxima. What leaves a page are the clusters that such pairs hang together in.
4. Verification. Clusters go through pages once more, now with the sets: those of pairs within the bound are intersected,
   and a link makes one component of two. Nodes of one component are not paired again. All pairs of a block that are in
   different components are covered, so no link between components is lost, and what leaves a page are fewer links than
   it has components, not its pairs.
5. Components over the links. Pairs with hubs are verified by the sizes of the exact intersections as well.

Nulls and edges: a null text or one without words has an empty set and links with nothing; a null doc_id keeps its row
and links with nothing; of rows that repeat a doc_id each has the component of its own text; equal texts link; empty
tables give empty results; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_row, cut, discard, partitions, slices, store, table, tidy, trimmed
from .components import components
from .hashing import mix, shingles

FANOUT, BITMAP = 16, 1 << 24
#: Bytes of points in a page (of sets four times as many), shingles compared at once, and contents under at least so many nodes count as equally common.
PAGE_BYTES, CHUNK, COMMON = 1 << 22, 1 << 18, 4096


def differ(n: int, percent: int) -> int:
    """Most shingles in which a set of n can differ from one it links with."""
    return (100 - percent) * n // percent


def _bands(n: int, percent: int) -> Iterator[tuple[int, int]]:
    """(band, groups) under which a set of n is listed: its own half octave and, near its upper end, the next."""
    edge = lambda b: int(np.ceil(2 ** (b / 2)))  # noqa: E731  first size of a band
    b = int(2 * np.log2(n))
    while edge(b + 1) <= n:
        b += 1
    while edge(b) > n:
        b -= 1
    top = 100 * n // percent
    while True:
        yield b, int(np.ceil(1.25 * (differ(edge(b + 1) - 1, percent) + 1)))
        b += 1
        if edge(b) > top:
            return


def group_contents(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """(band, contents of the groups that are not empty): 64-bit numbers whose low 6 bits are the band."""
    if not differ(len(s), percent):
        return []  # links only with equal sets
    mixed, out = mix(s + np.uint64(0xA5A5A5A5A5A5A5A5)), []
    low, high = (mixed & np.uint64(0xFFFFFFFF)).astype(np.float64), (mixed >> np.uint64(32)).astype(np.float64)
    for band, groups in _bands(len(s), percent):
        g = ((s >> np.uint64(16)) % np.uint64(groups)).astype(np.int64)
        filled = np.bincount(g, minlength=groups) > 0
        # sums of 32-bit halves are exact in doubles
        content = np.bincount(g, low, groups).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.bincount(g, high, groups).astype(np.uint64) + np.uint64(band << 40) + np.arange(groups, dtype=np.uint64) * np.uint64(1 << 45))
        out.append((band, mix(content[filled]) & ~np.uint64(63) | np.uint64(band)))
    return out


def coordinates(band: int) -> int:
    return 1 << min(14, max(4, band // 2))


def count_vector(s: np.ndarray, band: int) -> np.ndarray:
    """Counts by hash group; one byte each as long as a group holds 16 shingles or so, four in larger bands."""
    count = np.bincount((s & np.uint64(coordinates(band) - 1)).astype(np.int64), minlength=coordinates(band))
    return count.astype(_kind(band))


def _kind(band: int) -> type:
    return np.uint8 if band < 36 else np.uint32


def need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """A packed R-tree over count vectors: pages of FANOUT points, sorted by size and first coordinates, under nodes of FANOUT pages, and so on."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes)) if len(points) else np.zeros(0, np.int64)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        top, least = self.points, self.sizes
        while len(top) > FANOUT:
            at = np.arange(0, len(top), FANOUT)
            top, least = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(least, at)
            self.levels.append((top, least))

    def reach(self, q: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Indexes of points whose overlap with q may be large enough for a link."""
        nodes = np.arange(len(self.levels[-1][1]) if self.levels else len(self.sizes))
        for level in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[level]
            # a node passes if its corner could hold enough for its smallest set
            nodes = nodes[np.minimum(top[nodes], q).sum(axis=1, dtype=np.int64) >= need(size, least[nodes], percent)]
            below = self.levels[level - 1][1] if level else self.sizes
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes = nodes[nodes < len(below)]
        hit = nodes[np.minimum(self.points[nodes], q).sum(axis=1, dtype=np.int64) >= need(size, self.sizes[nodes], percent)]
        return self.order[hit]


def _utf8(column: pa.Array) -> list[bytes]:
    return [(x or b"").lower() for x in column.cast(pa.binary()).to_pylist()]


def _texts(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _lists(x: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(y) for y in x])]).astype(np.int32)), pa.array(flat))


def _node(s: np.ndarray) -> int:
    return int((np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(s))).view(np.int64))


def sizes(df: DataFrame, text: str, doc_id: str, k: int) -> DataFrame:
    """(doc_id, n, node) per row; node is null for an empty set or a null doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(_utf8(batch.column(1)), k)
            nodes = [_node(s) if len(s) and d is not None else None for d, s in zip(batch.column(0).to_pylist(), sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())], ["doc_id", "n", "node"])

    return _texts(df, text, doc_id).mapInArrow(trimmed(run), "doc_id long, n long, node long")


def contents(df: DataFrame, text: str, doc_id: str, k: int, percent: int) -> DataFrame:
    """(content, node, spare): group contents, for the first of equal sets in a task. spare: how many contents a node need not list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            found: list[np.ndarray] = []
            nodes, spare = [], []
            for s in shingles(_utf8(batch.column(1)), k):
                node = _node(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    for _, c in group_contents(s, percent):
                        found.append(c)
                        nodes.append(node)
                        spare.append(len(c) - differ(len(s), percent) - 1)
            if found:
                times = [len(c) for c in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), times)), pa.array(np.repeat(np.array(spare, np.int32), times))], ["content", "node", "spare"])

    rows = _texts(df, text, doc_id).filter("doc_id is not null")
    return rows.mapInArrow(trimmed(run), "content long, node long, spare int")


def shared(listed: DataFrame) -> DataFrame:
    """(content, node, spare, holders) of contents that two nodes hold or more, streamed over sorted rows; holders counts up to COMMON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = d = np.zeros(0, np.int64)
        e = np.zeros(0, np.int32)  # rows of the last content that still wait
        common = None  # a content of which COMMON rows have gone out
        last_node = None
        for batch in _with_end(batches):
            if batch is not None:
                c, d, e = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((c, d, e)))
                once = np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
                if common is not None and len(c) and c[0] == common and d[0] == last_node:
                    once[0] = False  # the row before has gone out already
                    once[1:] &= ~((c[1:] == common) & (d[1:] == last_node))
                c, d, e = c[once], d[once], e[once]
            if not len(c):
                continue
            start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            length = np.diff(np.append(start, len(c)))
            holders = np.minimum(length, COMMON)
            if c[0] == common:
                holders[0] = COMMON
            wait = batch is not None and holders[-1] < COMMON
            upto = start[-1] if wait else len(c)
            each = np.repeat(holders, length)[:upto]
            out = np.flatnonzero(each > 1)
            yield pa.RecordBatch.from_arrays([pa.array(c[out]), pa.array(d[out]), pa.array(e[out]), pa.array(each[out].astype(np.int32))], ["content", "node", "spare", "holders"])
            if not wait:
                common, last_node = int(c[-1]), int(d[-1])
            c, d, e = c[upto:], d[upto:], e[upto:]

    n = partitions(listed.sparkSession)
    return listed.repartition(n, "content").sortWithinPartitions("content", "node").mapInArrow(trimmed(run), "content long, node long, spare int, holders int")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (x for x in batches if x.num_rows)
    yield None


def blocks(hits: DataFrame) -> DataFrame:
    """(content, node, band, hub): what nodes are listed under, where two or more are."""
    band = F.col("content").bitwiseAND(F.lit(63)).cast("int")
    per = hits.groupBy("node", band.alias("band")).agg(F.sort_array(F.collect_set(F.struct("holders", "content"))).alias("x"), F.min("spare").alias("spare"))
    listed = per.select("node", "band", F.explode(F.slice("x", F.lit(1), F.greatest(F.size("x") - F.col("spare"), F.lit(0)))).alias("y")).select(F.col("y.content").alias("content"), "node", "band")
    listed = cut(listed)
    hubs = listed.groupBy("content").agg(F.min("node").alias("hub"), F.count("*").alias("c")).filter("c > 1").select("content", "hub")
    return listed.join(hubs, "content").select("content", "node", "band", "hub")


class Page:
    """A part of a block's members, given with their points or their sets, and which of them queries have joined."""

    def __init__(self, band: int, percent: int):
        self.band, self.percent = band, percent
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.tree: CountTree | None = None
        self.ids: dict[int, int] = {}  # of what is joined
        self.root, self.joined = np.zeros(0, np.int64), {}  # by id: one id for all that are joined; the ids of each

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """Ids of keys; new ones are alone."""
        at = np.array([self.ids.setdefault(x, len(self.ids)) for x in keys.tolist()], np.int64)
        more = np.arange(len(self.root), len(self.ids))
        self.root = np.concatenate([self.root, more])
        self.joined.update((x, [x]) for x in more.tolist())
        return at

    def _join(self, x: int, y: int) -> bool:
        """False if they were joined already."""
        x, y = int(self.root[x]), int(self.root[y])
        if x == y:
            return False
        if len(self.joined[x]) < len(self.joined[y]):
            x, y = y, x
        less = self.joined.pop(y)
        self.root[less] = x
        self.joined[x] += less
        return True

    def add(self, asks: np.ndarray, node: np.ndarray, label: np.ndarray, n: np.ndarray, points: np.ndarray, s: np.ndarray) -> None:
        self.parts.append((asks, node, label, n, points, s))

    def _members(self) -> bool:
        """False if none was dealt to this page."""
        if self.parts:
            asks, self.node, self.label, self.n, points, self.s = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts, self.asks, self.start = [], asks > 0, np.cumsum(self.n) - self.n
            self.tree = CountTree(points, self.n)
        return self.tree is not None

    def _reached(self, point: np.ndarray, n: int, node: int) -> np.ndarray:
        x = self.tree.reach(point, n, self.percent)
        # of two that both ask, the smaller one does
        return x[~self.asks[x] | (self.node[x] > node)]

    def meet(self, node: np.ndarray, label: np.ndarray, n: np.ndarray, points: np.ndarray) -> None:
        """Joins queries with what they reach outside their components."""
        if not self._members():
            return
        at, keys = self._known(self.node), self._known(node)
        for q, key, own, size, point in zip(node.tolist(), keys.tolist(), label.tolist(), n.tolist(), points, strict=True):
            x = self._reached(point, size, q)
            x = at[x[self.label[x] != own]]
            while len(x := x[self.root[x] != self.root[key]]):
                self._join(key, x[0])

    def met(self) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, node) of what is joined; the smallest node names the cluster."""
        node = np.array(list(self.ids), np.int64)
        groups = [node[x] for x in self.joined.values() if len(x) > 1]
        if not groups:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.repeat([x.min() for x in groups], [len(x) for x in groups]), np.concatenate(groups)

    def links(self, node: np.ndarray, label: np.ndarray, n: np.ndarray, points: np.ndarray, s: np.ndarray) -> list[tuple[int, int]]:
        """(a, b) that link by their sets, one for two components of this page that become one: fewer than there are labels."""
        out: list[tuple[int, int]] = []
        if not self._members():
            return out
        at, keys = self._known(self.label), self._known(label)
        for q, key, size, point, set_ in zip(node.tolist(), keys.tolist(), n.tolist(), points, np.split(s, np.cumsum(n)[:-1]), strict=True):
            x, step = self._reached(point, size, q), 1
            while len(x := x[self.root[at[x]] != self.root[key]]):
                y, x = np.split(x, [max(1, min(step, CHUNK // int(self.n[x].max())))])
                step *= 8
                out += [(q, int(self.node[z])) for z in y[self._linked(set_, y)].tolist() if self._join(key, at[z])]
        return out

    def _linked(self, s: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Which members link with the set s."""
        n = self.n[members]
        begin = np.cumsum(n) - n
        every = self.s[np.repeat(self.start[members] - begin, n) + np.arange(n.sum())]
        common = np.add.reduceat(s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every, begin, dtype=np.int64)
        return 100 * common >= self.percent * (len(s) + n - common)


def _by_page(rows: DataFrame, ask: Callable, end: Callable, percent: int, schema: str) -> DataFrame:
    """Per page of a block its queries against its members, as what ``ask`` and, after the page, ``end`` return: two columns.

    Rows: content, page, asks, node, label, n and vector or s. Only a page's members are held, queries stream past.
    """
    kind = "s" if "s" in rows.columns else "vector"

    def given(batch: pa.RecordBatch, band: int) -> tuple[np.ndarray, ...]:
        node, label, n = (batch[x].to_numpy() for x in ("node", "label", "n"))
        if kind == "vector":
            return node, label, n, np.frombuffer(b"".join(batch["vector"].to_pylist()), _kind(band)).reshape(-1, coordinates(band)), np.zeros(0, np.uint64)
        s = batch["s"].flatten().to_numpy().view(np.uint64)
        return node, label, n, np.stack([count_vector(x, band) for x in np.split(s, np.cumsum(n)[:-1])]), s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, last = None, None
        for batch in _with_end(batches):
            out = [(np.zeros(0, np.int64),) * 2]
            if batch is None:
                out += [end(page)] if page else []
            else:
                c, p, late = batch["content"].to_numpy(), batch["page"].to_numpy(), batch["asks"].to_numpy() == 2
                # members of a page come before its queries
                edge = np.flatnonzero((c[1:] != c[:-1]) | (p[1:] != p[:-1]) | (late[1:] != late[:-1])) + 1
                for x, y in zip([0, *edge.tolist()], [*edge.tolist(), len(c)], strict=True):
                    if last != (c[x], p[x]):
                        out += [end(page)] if page else []
                        page, last = Page(int(c[x]) & 63, percent), (c[x], p[x])
                    part = batch.slice(x, y - x)
                    if late[x]:
                        out.append(ask(page, *given(part, page.band)))
                    else:
                        page.add(part["asks"].to_numpy(), *given(part, page.band))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out, strict=True)], names)

    names = [x.split()[0] for x in schema.split(", ")]
    ordered = rows.repartition(partitions(rows.sparkSession), "content", "page").sortWithinPartitions("content", "page", "asks")
    return ordered.mapInArrow(trimmed(run), schema)


def _near(rows: DataFrame, percent: int) -> DataFrame:
    """(content, node, band): clusters of nodes that the tree leaves together, in place of blocks; two that may link share one. Rows with vectors."""

    def ask(page: Page, node: np.ndarray, label: np.ndarray, n: np.ndarray, points: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        page.meet(node, label, n, points)
        return (np.zeros(0, np.int64),) * 2

    def end(page: Page) -> tuple[np.ndarray, np.ndarray]:
        cluster, node = page.met()
        return cluster & ~63 | page.band, node

    met = _by_page(rows, ask, end, percent, "content long, node long").distinct()
    return met.select("content", "node", F.col("content").bitwiseAND(F.lit(63)).cast("int").alias("band"))


def _probe(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of different components, for each two that become one in a page. Rows with sets."""

    def ask(page: Page, *given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.array(page.links(*given), np.int64).reshape(-1, 2).T
        return a, b

    def end(page: Page) -> tuple[np.ndarray, np.ndarray]:
        return (np.zeros(0, np.int64),) * 2

    return _by_page(rows, ask, end, percent, "a long, b long")


def _pages(open_rows: DataFrame, given: DataFrame, kind: str = "s") -> DataFrame:
    """Rows for ``_by_page``: members dealt over pages, and what is outside the largest component as queries to each page. given: vector by node and band, or s by node."""
    per = open_rows.groupBy("content", "label").agg(F.count("*").alias("c"))
    state = per.groupBy("content").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), F.sum("c").alias("size"))
    if kind == "s":  # eight bytes a shingle
        most, limit, key = 8 * F.pow(F.lit(2.0), (F.col("band") + 1) / 2), 4 * PAGE_BYTES, ["node"]
    else:
        most, limit, key = F.call_function("shiftleft", F.lit(1), F.least(F.lit(14), F.greatest(F.lit(4), F.floor(F.col("band") / 2).cast("int")))), PAGE_BYTES, ["node", "band"]
    placed = open_rows.join(state, "content").withColumn("pages", F.ceil(F.col("size") * most / F.lit(limit)))
    asks = (F.col("label") != F.col("largest")).cast("int")
    member = placed.select("content", "node", "band", "label", asks.alias("asks"), F.pmod(F.xxhash64("node"), F.col("pages")).alias("page"))
    query = placed.filter("label <> largest").select("content", "node", "band", "label", F.lit(2).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)).alias("page"))
    return member.unionByName(query).join(given.select(*key, "n", kind), key).select("content", "page", "asks", "node", "label", "n", kind)


def _sets(df: DataFrame, text: str, doc_id: str, k: int, percent: int, wanted: DataFrame) -> DataFrame:
    """(node, n, points (band, vector), s) of the wanted (doc_id, node). A bitmap of fixed size keeps most other texts out of the shuffle."""
    bit = lambda: F.xxhash64("doc_id").bitwiseAND(F.lit(BITMAP - 1))
    maps = wanted.select((bit() + 1).alias("x"))  # bucket numbers and places begin at 1
    maps = maps.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    bitmap = np.zeros(BITMAP, bool)
    for r in maps.collect():  # at most BITMAP / 32768 rows
        own = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        bitmap[((r["bucket"] - 1) * len(own) + np.flatnonzero(own)) % BITMAP] = True
    known = df.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in slices(batches):
            at = batch.column(2).to_numpy()
            yield batch.select(["doc_id", "text"]).filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("band", pa.int32()), ("vector", pa.binary())]))
        for batch in slices(batches):
            sets = shingles(_utf8(batch.column(0)), k)
            at = [i for i, (s, node) in enumerate(zip(sets, batch.column(1).to_pylist(), strict=True)) if len(s) and _node(s) == node]
            sets = [sets[i] for i in at]
            points = [[{"band": b, "vector": count_vector(s, b).tobytes()} for b, _ in _bands(len(s), percent)] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at, pa.int64())), pa.array([len(s) for s in sets], pa.int64()), pa.array(points, kind), _lists([s.view(np.int64) for s in sets])], ["node", "n", "points", "s"])

    rows = _texts(df, text, doc_id).filter("doc_id is not null").withColumn("bit", bit()).mapInArrow(trimmed(near), "doc_id long, text string")
    return rows.join(wanted, "doc_id").select("text", "node").mapInArrow(trimmed(run), "node long, n long, points array<struct<band:int,vector:binary>>, s array<long>").dropDuplicates(["node"])


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The (a, b, band) whose summed coordinate minima leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            va, vb, bands = (batch[x].to_pylist() for x in ("va", "vb", "band"))
            most = np.array([np.minimum(np.frombuffer(x, _kind(z)), np.frombuffer(y, _kind(z))).sum(dtype=np.int64) for x, y, z in zip(va, vb, bands, strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(most >= need(batch["na"].to_numpy(), batch["nb"].to_numpy(), percent)))

    a, b = (points.select(F.col("node").alias(x), "band", F.col("n").alias(f"n{x}"), F.col("vector").alias(f"v{x}")) for x in "ab")
    return pairs.join(a, ["a", "band"]).join(b, ["b", "band"]).select("a", "b", "band", "na", "nb", "va", "vb").mapInArrow(trimmed(run), "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.filter(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after links (a, b); a label is the smallest node of a component."""
    ends = _labelled(links, labels).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    merged = components(ends).select(F.col("node").alias("label"), "component")
    return cut(labels.join(merged, "label", "left").select("node", F.coalesce("component", "label").alias("label")))


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").filter("la <> lb")


def join(df: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of df, each judged by its own text. Rows that repeat an id are linked as rows of their own."""
    rows, key = by_row(df, text, doc_id)
    if key == doc_id:
        return _join(df, text, doc_id, k, percent)
    found, ids = _join(rows, text, key, k, percent), rows.select(F.col(key).alias("row"), F.col(doc_id).alias("id")).filter("row IS NOT NULL")
    # row numbers are in the order of the ids, so the least row of a component has its least id
    own, least = ids.withColumnsRenamed({"row": "r", "id": "own"}), ids.withColumnsRenamed({"row": "s", "id": "least"})
    out = found.join(own, found["doc_id"] == own["r"], "left").join(least, found["component_id"] == least["s"], "left")
    return out.select(F.col("own").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def _join(df: DataFrame, text: str, doc_id: str, k: int, percent: int) -> DataFrame:
    spark = df.sparkSession
    rows = cut(sizes(df, text, doc_id, k))
    firsts = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    with tidy(spark):
        hits, hit_path = store(shared(contents(df, text, doc_id, k, percent)))
        listed = cut(blocks(hits))
    discard(spark, hit_path)
    hubs = cut(listed.filter("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("c"), F.min("band").alias("band")))
    part = None
    if not hubs.isEmpty():
        with tidy(spark):
            wanted = cut(listed.select("node").distinct().join(firsts, "node").select(F.col("first").alias("doc_id"), "node"))
            sets, set_path = store(_sets(df, text, doc_id, k, percent, wanted))
        points = sets.select("node", "n", F.explode("points").alias("p")).select("node", "n", "p.band", "p.vector")
        labels = cut(sets.select("node", F.col("node").alias("label")))
        best = cut(hubs.groupBy("b").agg(F.max(F.struct("c", "a", "band")).alias("x")).select("x.a", "b", "x.band"))
        labels = _merge(labels, _verify(_bounded(best, points, percent), sets, percent))
        others = _labelled(hubs.join(best.select("a", "b"), ["a", "b"], "left_anti"), labels).select("a", "b", "band")
        labels = _merge(labels, _verify(_bounded(others, points, percent), sets, percent))
        known = listed.select("content", "node", "band").join(labels, "node")
        several = known.groupBy("content").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("content")
        open_rows = cut(known.join(several, "content"))
        close = cut(_near(_pages(open_rows, points, "vector"), percent).join(labels, "node"))
        labels = _merge(labels, _probe(_pages(close, sets), percent))
        part = labels.join(firsts, "node").groupBy("label").agg(F.min("first").alias("component_id"))
        part = cut(labels.join(part, "label").select("node", "component_id"))
        discard(spark, set_path)
    home = firsts.select("node", F.col("first").alias("component_id"))
    if part is not None:
        home = firsts.join(part, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    out = rows.join(home, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), k=4, percent=85)
