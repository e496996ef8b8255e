"""Exact Jaccard components inside candidate blocks, by T-occurrence search.

Items that candidate clusters connect form a block; a pair in different blocks is known not to be
linked. A block of more than ``MAX_ITEMS`` items is held together by chance as often as not. There,
each cluster of at most ``FEW`` members is a block of its own, and only larger clusters connect.
Within a block an inverted index maps shingles to item lists, and a query item's
partners are those in at least T of its lists. The search is DivideSkip: the L longest lists are
set aside, the short rest is merged with a heap, and whoever reaches T - L there is looked up in
the long lists by binary search.

Only connectivity is asked for, so a query need not be repeated inside one component: the most
central item is asked first, and the search ends once all items that were not asked are in one
component, because then every pair in different components has been looked at from one side.

A block of more than ``MAX_ITEMS`` items is dealt to several tasks (``resolve``): first parts of
the block by themselves, then one item of each part's components together, and at last the items
outside the block's largest component against all parts. No task holds more than two parts.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch, sized_join
from ._text import released
from .components import components

#: Items of a block that one task takes.
MAX_ITEMS = 1000
#: Members of a cluster that is searched by itself in a block of more than MAX_ITEMS.
FEW = 8
#: Payload whose sets are held at once, unless one group has more.
RUN_BYTES = 1 << 20
#: Look-ups that are done at once.
PROBES = 1 << 20
#: DivideSkip's constant: the larger it is, the fewer lists count as long.
MU = 0.01
#: Bits of a set in a block at most; larger sets are ruled out less often.
MOST_BITS = 1 << 13


def _bit_rows(shingles: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of bits for each set, one for each value of its shingles' low bits; of all sets equally many."""
    most = int(sizes.max()) if sizes.size else 0
    bits = 1 << (min(MOST_BITS, max(64, 2 * most)) - 1).bit_length()
    flags = np.zeros((sizes.size, bits), dtype=bool)
    flags[owner, (shingles & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, axis=1).view(np.uint64)


class Index:
    """Inverted index of one block: postings sorted by (list, item), so that a list is a slice and a probe a binary search."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([s.size for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.shingles, of, counts = np.unique(flat, return_inverse=True, return_counts=True)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.n = max(len(sets), 1)
        self.keys = np.sort(of * self.n + owner)
        self.lists = of  # the lists of item i are lists[begins[i]:begins[i + 1]]
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        alone = np.concatenate([[0], np.cumsum(counts[of] == 1)])
        self.own = alone[self.begins[1:]] - alone[self.begins[:-1]]
        self.bits = _bit_rows(flat, owner, self.sizes)
        self.merged, self.probed = 0, 0  # entries merged by the heap, and look-ups in long lists

    @cached_property
    def entries(self) -> np.ndarray:
        """The lists, one behind another."""
        return self.keys % self.n

    def among(self, lists: np.ndarray, wanted: np.ndarray) -> list[list[int]]:
        """The lists, without items that are not ``wanted``."""
        length = self.length(lists)
        ends = np.cumsum(length)
        items = self.entries[np.arange(int(length.sum())) + np.repeat(self.starts[lists] - (ends - length), length)]
        stay = wanted[items]
        cuts = np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], ends])].tolist()
        items = items[stay].tolist()
        return [items[a:z] for a, z in zip(cuts, cuts[1:]) if z > a]

    def lists_of(self, item: int) -> np.ndarray:
        return self.lists[self.begins[item] : self.begins[item + 1]]

    def length(self, lists: np.ndarray) -> np.ndarray:
        return self.starts[lists + 1] - self.starts[lists]

    def centrality(self) -> np.ndarray:
        """For each item, the share of its shingles' postings that others hold."""
        total = np.concatenate([[0], np.cumsum(self.length(self.lists))])
        return (total[self.begins[1:]] - total[self.begins[:-1]]) / np.maximum(self.sizes, 1)

    def partners(self, item: int, percent: int, wanted: np.ndarray) -> np.ndarray:
        """Items among ``wanted`` (a mask) whose Jaccard similarity with ``item`` is at least ``percent`` in a hundred.

        An item shares at most the shingles that anyone else has, and the bits in which two bitmaps
        differ number no more than the shingles in which the sets differ. Both rule most others out
        before a list is read, and no link.
        """
        size = int(self.sizes[item])
        most = np.minimum(self.sizes[item] - self.own[item], self.sizes - self.own)
        wanted = wanted & (most > 0) & ((100 + percent) * most >= percent * (size + self.sizes))
        wanted[item] = False
        near = np.flatnonzero(wanted)
        differ = np.bitwise_count(self.bits[near] ^ self.bits[item]).sum(axis=1, dtype=np.int64)
        wanted[near[(100 + percent) * differ > (100 - percent) * (size + self.sizes[near])]] = False
        least = self.sizes[wanted]
        if not least.size:
            return np.zeros(0, np.int64)
        need = max(1, -(-percent * (size + int(least.min())) // (100 + percent)))
        lists = self.lists_of(item)
        lengths = self.length(lists)
        lists, lengths = lists[lengths > 1], lengths[lengths > 1]
        order = np.argsort(lengths, kind="stable")
        lists, lengths = lists[order], lengths[order]
        long = min(need - 1, int(need / (MU * math.log2(max(2, int(lengths[-1]))) + 1)))
        short, long_lists = lists[: lists.size - long], lists[lists.size - long :]
        times = np.zeros(self.n, np.int64)
        counted = Counter(heapq.merge(*self.among(short, wanted)))
        times[list(counted.keys())] = list(counted.values())
        self.merged += counted.total()
        who = np.flatnonzero(wanted & (times >= need - long))
        step = max(1, PROBES // max(1, who.size))
        for at in range(0, long if who.size else 0, step):
            probes = long_lists[at : at + step, None] * self.n + who[None, :]
            found = np.minimum(np.searchsorted(self.keys, probes), self.keys.size - 1)
            times[who] += (self.keys[found] == probes).sum(axis=0)
            self.probed += probes.size
        return who[(100 + percent) * times[who] >= percent * (size + self.sizes[who])]


class Forest:
    """Union-find with the least index as root."""

    def __init__(self, labels: Iterable):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], dtype=np.int64)


def link(sets: list[np.ndarray], percent: int, known: list | None = None, ask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each item's root in the components of the links among ``sets``, and each item's centrality.

    known: labels of components found before. ask: only links with one of these items matter.
    """
    n = len(sets)
    forest = Forest(range(n) if known is None else known)
    if n < 2:
        return forest.roots(), np.zeros(n)
    index = Index(sets)
    central = index.centrality()
    open_ = np.ones(n, dtype=bool) if ask is None else ask.copy()
    waiting = [i for i in np.argsort(-central, kind="stable").tolist() if open_[i]]
    roots = forest.roots()
    first = ask is None
    while waiting:
        if ask is None:
            left, sizes = np.unique(roots[open_], return_counts=True)
            if left.size <= 1:
                break
            largest = left[np.argmax(sizes)]
            item = waiting[0] if first else next((i for i in waiting if roots[i] != largest), waiting[0])
            first = False
        elif (roots == roots[0]).all():
            break
        else:
            item = waiting[0]
        waiting.remove(item)
        open_[item] = False
        found = index.partners(item, percent, roots != roots[item])
        for other in found.tolist():
            forest.join(item, other)
        if found.size:
            roots = forest.roots()
    return roots, central


def link_small(sets: list[np.ndarray], blocks: np.ndarray, percent: int) -> np.ndarray:
    """Roots of the components of the links inside many small blocks at once: all overlaps are counted, no lists are searched.

    blocks: the block of each set, sets of a block side by side. The entries of all sets are sorted by
    block and shingle, and entries of one shingle that are d places apart are pairs of its list, for
    d = 1, 2, ... up to the largest block.
    """
    sizes = np.array([s.size for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    by = np.lexsort((flat, blocks[owner]))
    owner, flat = owner[by], flat[by]
    own = blocks[owner]
    most = int(np.unique(blocks, return_counts=True)[1].max())
    common = np.zeros((len(sets), most), np.int64)
    for d in range(1, most):
        same = np.flatnonzero((flat[d:] == flat[:-d]) & (own[d:] == own[:-d]))
        if not same.size:
            break
        a, b = np.minimum(owner[same], owner[same + d]), np.maximum(owner[same], owner[same + d])
        common += np.bincount(a * most + b - a, minlength=common.size).reshape(common.shape)
    a, apart = np.nonzero(common)
    b, n = a + apart, common[a, apart]
    linked = (100 + percent) * n >= percent * (sizes[a] + sizes[b])
    forest = Forest(range(len(sets)))
    for i, j in zip(a[linked].tolist(), b[linked].tolist()):
        forest.join(i, j)
    return forest.roots()


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])


def _columns(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy() for n in names])


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches, sorted by keys, cut so that no group of equal keys is in two of them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = _columns(batch, keys)
        last = int(_runs(own)[-2])
        if rest and (last or (_columns(rest[-1].slice(rest[-1].num_rows - 1), keys)[0] != own[0]).any()):
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest)


def _solve(make_sets: Callable[[pa.Array], tuple[list[np.ndarray], np.ndarray]], percent: int, counted: int = 0) -> Callable:
    """A mapInArrow function over (block, part, id, known, asks, payload) sorted by block and part.

    Groups are solved in runs of about RUN_BYTES of payload, so a task holds little more than its largest group. Groups
    of up to ``counted`` items of which nothing is known are solved together, by counting.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["block", "part"]):
            keys = _columns(table, ["block", "part"])
            ids, known, asks = (table.column(c).to_numpy() for c in ("id", "known", "asks"))
            payload = table.column("payload").cast(pa.large_string())
            size = np.concatenate([[0], np.cumsum(pc.binary_length(payload).to_numpy())])
            cuts = _runs(keys)
            first = 0
            while first < cuts.size - 1:
                last = first + 1
                while last < cuts.size - 1 and size[cuts[last + 1]] - size[cuts[first]] <= RUN_BYTES:
                    last += 1
                base = int(cuts[first])
                sets, own = make_sets(payload.slice(base, int(cuts[last]) - base).combine_chunks())
                parts, small = [], []
                for a, z in zip(cuts[first:last].tolist(), cuts[first + 1 : last + 1].tolist()):
                    order = a + np.lexsort((~asks[a:z], ids[a:z]))
                    order = order[own[order - base] == ids[order]]
                    if not order.size:
                        continue
                    order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
                    fresh = (known[order] < 0).all() and asks[order].all()
                    if fresh and order.size <= counted:
                        small.append(order)
                        continue
                    root, central = link([sets[i] for i in order - base], percent, None if fresh else known[order].tolist(), None if fresh else asks[order])
                    hub = np.zeros(order.size, dtype=bool)
                    best = np.lexsort((-central, root))
                    hub[best[np.concatenate([[True], root[best][1:] != root[best][:-1]])]] = True
                    parts.append((order, ids[order[root]], hub, np.bincount(root, minlength=order.size)[root] == 1))
                if small:
                    order = np.concatenate(small)
                    group = np.repeat(np.arange(len(small)), [o.size for o in small])
                    root = link_small([sets[i] for i in order - base], group, percent)
                    # Any item of a component may stand for it.
                    parts.append((order, ids[order[root]], root == np.arange(order.size), np.bincount(root, minlength=order.size)[root] == 1))
                if parts:
                    order, least, hub, alone = (np.concatenate(c) for c in zip(*parts))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[order, 0], keys[order, 1], ids[order], least, hub, alone)], ["block", "part", "a", "b", "hub", "alone"])
                first = last

    return released(run)


def resolve(
    candidates: DataFrame,
    fetch: Callable[[DataFrame, int], DataFrame],
    make_sets: Callable[[pa.Array], tuple[list[np.ndarray], np.ndarray]],
    percent: int,
    scratch: Scratch,
    max_items: int = MAX_ITEMS,
    counted: int = 0,
) -> DataFrame:
    """Columns ``id`` and ``component`` of the items that are linked with another.

    candidates: rows (cluster, id, head, members) of ``lists.candidate_clusters``. fetch: adds a
    column ``payload`` to rows with an ``id``, given their number. make_sets: sorted distinct
    uint64 arrays of payloads, and the ids of these payloads; rows with another id are passed over.
    A link is a Jaccard similarity of ``percent`` in a hundred at least. Items with an empty set
    are linked with nothing. Blocks of up to ``counted`` items are not searched, but all their
    overlaps counted.
    """
    candidates = scratch.keep(candidates, "clusters")
    blocks = scratch.keep(components(candidates.select(F.col("id").alias("a"), F.col("head").alias("b")), scratch).withColumnRenamed("component", "block"), "blocks")
    wide = scratch.keep(_sizes(blocks).where(F.col("items") > max_items), "wide")
    n_wide = wide.count()
    alone = F.lit(None).cast("long").alias("items")
    members = sized_join(blocks, wide.select("block"), "block", "left_anti", 16, n_wide).select("block", "id", alone)
    n_large = 0
    if n_wide:
        within = scratch.keep(sized_join(blocks, wide.select("block"), "block", "left_semi", 16, n_wide).select("id"), "within")
        theirs = scratch.keep(sized_join(candidates, within, "id", "left_semi", 16, within.count()), "theirs")
        few = theirs.where(F.col("members") <= FEW).select(F.col("cluster").alias("block"), "id", alone)
        many = theirs.where(F.col("members") > FEW).select(F.col("id").alias("a"), F.col("head").alias("b"))
        cores = scratch.keep(components(many, scratch).withColumnRenamed("component", "block"), "cores")
        large = scratch.keep(_sizes(cores).where(F.col("items") > max_items), "large")
        n_large = large.count()
        members = members.union(few).union(sized_join(cores, large, "block", "left", 32, n_large).select("block", "id", "items"))
    part = F.when(F.col("items").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("items") / max_items)))
    members = scratch.keep(members.select("block", "id", "items", part.cast("long").alias("part"), F.lit(-1).cast("long").alias("known"), F.lit(True).alias("asks")), "asked")
    dealt = fetch(members, members.count())
    if n_large:
        dealt = scratch.keep(dealt, "members")
    schema = "block long, part long, a long, b long, hub boolean, alone boolean"

    def solve(rows: DataFrame) -> DataFrame:
        rows = rows.select("block", "part", "id", "known", "asks", "payload").repartition("block", "part").sortWithinPartitions("block", "part")
        return rows.mapInArrow(_solve(make_sets, percent, counted), schema)

    links = scratch.keep(solve(dealt), "links")
    if not n_wide:  # no item is in two blocks
        return links.where("not alone").select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = links.select("a", "b")
    if n_large:
        apart = _join_parts(dealt.where("part >= 0"), links.where("part >= 0"), solve, max_items, n_large, scratch)
        found = links.where("part = -1").select("a", "b").union(apart.select("a", "b"))
    return components(found, scratch).select("id", "component")


def _sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block").agg(F.count("*").alias("items"))


def _join_parts(large: DataFrame, links: DataFrame, solve: Callable[[DataFrame], DataFrame], max_items: int, n_large: int, scratch: Scratch) -> DataFrame:
    """Links between the parts of the ``n_large`` blocks that were dealt to several tasks.

    Per block, one row is joined with its items, by broadcast as long as these rows are few: a
    block may hold a third of all items, and no task gathers them.
    """
    links = links.select("block", "part", "a", "b", "hub")
    hubs = scratch.keep(links.where("hub").select(F.col("a").alias("id"), "block").distinct(), "hubs")
    # The hubs of a block, again in parts of bounded size; one round brings most parts of a group of copies together.
    met = sized_join(large.drop("part"), hubs, ["block", "id"], "inner", 32, hubs.count()).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("items") / (max_items * max_items))))
    turns = Window.partitionBy("block", "part").orderBy("id")
    some = met.withColumn("turn", F.row_number().over(turns)).where(F.col("turn") <= max_items)
    links = scratch.keep(links.drop("hub").unionByName(solve(some).drop("hub", "alone")), "links")
    found = scratch.keep(components(links.select("a", "b"), scratch), "found")
    labelled = sized_join(large.drop("known", "asks"), found, "id", "left", 32, found.count()).withColumn("known", F.coalesce("component", "id")).drop("component")
    labelled = scratch.keep(labelled, "labelled")
    tops = labelled.groupBy("block", "known").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("known", F.struct("n", "known")).alias("top"))
    rest = sized_join(labelled, tops, "block", "inner", 32, n_large).where("known <> top")
    waves = scratch.keep(rest.groupBy("block").agg(F.ceil(F.count("*") / max_items).alias("waves")), "waves")
    if waves.isEmpty():
        return links
    asked = sized_join(rest, waves, "block", "inner", 32, n_large).withColumn("wave", F.pmod(F.xxhash64("id", F.lit(2)), "waves"))
    spread = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("items") / max_items) - 1).cast("int")))
    queries = asked.withColumn("part", spread).select("block", (F.col("part") * F.col("waves") + F.col("wave")).alias("part"), "id", "known", F.lit(True).alias("asks"), "payload")
    against = sized_join(labelled, waves, "block", "inner", 32, n_large).withColumn("wave", F.explode(F.sequence(F.lit(0), (F.col("waves") - 1).cast("int"))))
    against = against.select("block", (F.col("part") * F.col("waves") + F.col("wave")).alias("part"), "id", "known", F.lit(False).alias("asks"), "payload")
    return scratch.keep(links.unionByName(solve(queries.unionByName(against)).drop("hub", "alone")), "links")
