"""Candidate clusters from inverted lists, none of which is held whole or paired out.

A posting says that an item is in a list; two items that can be linked share a list. Lists with
the same members are one group. A group is compared by its members' bitmaps (``bitmap``): the
bits in which two of them differ number no more than the shingles in which the sets differ, so a
pair that differs in too many bits is no link, and no link is ruled out. Members that admitted
pairs connect are a cluster, and rows of clusters are what is handed on, not pairs.

Postings may carry a sketch, a word of 32 values of two bits. Where they are gathered, members of a
list whose sketches differ in more values than given are no pair, so that lists that items share by
chance, whose number grows with the square of the input, do not ask for bitmaps.

A list of more than ``LONGEST`` items is not compared here: it is a cluster as it is. Postings of
lists known to hold much of all postings (``spread`` above 0) become rows of such a cluster
wherever they are, so no task gathers them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, may_hold
from ._text import mix, released

#: Items of a list that are compared in one task.
LONGEST = 1000
#: Members of a group that is compared together with others of its batch.
TOGETHER = 12
#: Bits of a bitmap at most; a larger set is ruled out less often.
MOST_BITS = 1 << 16
#: Parts among which postings of a hot list are dealt.
SPREAD = 1 << 16
_U = np.uint64


def bitmaps(shingles: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Of sets that lie one behind another, each as flags, one for each value of a shingle's low bits; there are two to four times as many as shingles."""
    bits = np.left_shift(1, np.ceil(np.log2(np.clip(2 * counts, 64, MOST_BITS))).astype(np.int64))
    ends = np.cumsum(bits)
    flags = np.zeros(int(ends[-1]) if counts.size else 0, dtype=np.uint8)
    at = shingles & np.repeat((bits - 1).astype(_U), counts)
    at += np.repeat((ends - bits).astype(_U), counts)
    flags[at] = 1
    offsets = np.concatenate([[0], ends // 8]).astype(np.int64)
    data = np.packbits(flags, bitorder="little")
    return pa.Array.from_buffers(pa.large_binary(), counts.size, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _folded(b: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows) of fewer bits, as the low bits of shingles would give them."""
    while b.shape[1] > size:
        half = b.shape[1] // 2
        b = b[:, :half] | b[:, half:]
    return b


def _near(sketches: np.ndarray, starts: np.ndarray, sizes: np.ndarray, apart: int) -> np.ndarray:
    """The least row that each row of a list is connected with by sketches that differ in at most ``apart`` of their values."""
    label = np.arange(sketches.size)
    for m in np.unique(sizes).tolist():
        if m < 2:
            continue
        a, b = np.triu_indices(m, 1)
        firsts = starts[sizes == m]
        step = max(1, (1 << 20) // a.size)
        for k in range(0, firsts.size, step):
            i, j = ((firsts[k : k + step, None] + x).ravel() for x in (a, b))
            x = sketches[i] ^ sketches[j]
            good = np.bitwise_count((x | (x >> _U(1))) & _U(0x5555555555555555)) <= apart
            i, j = i[good], j[good]
            while i.size:
                np.minimum.at(label, j, label[i])
                np.minimum.at(label, i, label[j])
                left = label[i] != label[j]
                i, j = i[left], j[left]
    return label


def _gathered(apart: int | None = None) -> Callable:
    """A mapInArrow function from postings (list, spread, id, and a sketch if ``apart`` is given), sorted by list, to rows (group, id, sure).

    sure: the group is a list that is a cluster as it is. Without a sketch a group is a list, else the members of one that sketches connect.
    """

    def rows(group: np.ndarray, item: np.ndarray, sure: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(group), pa.array(item), pa.array(np.full(group.size, sure))], ["group", "id", "sure"])

    def closed(lists: np.ndarray, ids: np.ndarray, sketches: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole lists."""
        if lists.size < 2:
            return
        shared = np.concatenate([lists[1:] == lists[:-1], [False]])
        shared[1:] |= shared[:-1]
        lists, ids, sketches = lists[shared], ids[shared], sketches[shared]
        if not lists.size:
            return
        order = np.lexsort((ids, lists))
        lists, ids, sketches = lists[order], ids[order], sketches[order]
        fresh = np.concatenate([[True], (lists[1:] != lists[:-1]) | (ids[1:] != ids[:-1])])
        lists, ids, sketches = lists[fresh], ids[fresh], sketches[fresh]
        starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        sizes = np.diff(np.append(starts, lists.size))
        over = np.repeat(sizes > LONGEST, sizes)
        if over.any():
            yield rows(lists[over], ids[over], True)
        if apart is not None:
            label = _near(sketches, starts, np.where(sizes > LONGEST, 1, sizes), apart)
            order = np.lexsort((ids, label))
            lists, ids, label = lists[order], ids[order], label[order]
            starts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
            sizes = np.diff(np.append(starts, label.size))
        group = mix(np.add.reduceat(mix(ids.view(_U)), starts) + sizes.astype(_U))
        _, first = np.unique(group, return_index=True)
        once = np.zeros(starts.size, dtype=bool)
        once[first] = True
        take = np.repeat(once & (sizes > 1) & (sizes <= LONGEST), sizes)
        if take.any():
            yield rows(np.repeat(group, sizes)[take].view(np.int64), ids[take], False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, ids, sketches = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
        long: int | None = None
        for batch in batches:
            own, spread, item = (batch.column(c).to_numpy() for c in ("list", "spread", "id"))
            sketch = np.zeros(own.size, _U) if apart is None else batch.column("sketch").to_numpy().view(_U)
            hot = spread > 0
            if hot.any():
                yield rows(own[hot], item[hot], True)
                own, item, sketch = own[~hot], item[~hot], sketch[~hot]
            if long is not None and own.size:
                same = own == long
                if same.any():
                    yield rows(own[same], item[same], True)
                    own, item, sketch = own[~same], item[~same], sketch[~same]
                if own.size:
                    long = None
            lists, ids, sketches = np.concatenate([lists, own]), np.concatenate([ids, item]), np.concatenate([sketches, sketch])
            if not lists.size:
                continue
            before = np.flatnonzero(lists != lists[-1])
            last = int(before[-1]) + 1 if before.size else 0
            yield from closed(lists[:last], ids[:last], sketches[:last])
            lists, ids, sketches = lists[last:], ids[last:], sketches[last:]
            if lists.size > 4 * LONGEST:
                ids, first = np.unique(ids, return_index=True)
                lists, sketches = lists[: ids.size], sketches[first]
                if ids.size > LONGEST:
                    long = int(lists[0])
                    yield rows(lists, ids, True)
                    lists, ids, sketches = lists[:0], ids[:0], sketches[:0]
        yield from closed(lists, ids, sketches)

    return released(run)


_gather = _gathered()


def _two(n: list[int], maps: list[bytes], percent: int, exact: bool) -> bool:
    """Whether sizes and bitmaps admit a pair."""
    if exact and 100 * min(n) < percent * max(n):
        return False
    a, b = sorted(maps, key=len)
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = (y >> bits) | (y & ((1 << bits) - 1))
    return (100 + percent) * (x ^ y).bit_count() <= (100 - percent) * (n[0] + n[1])


def _pairs_admitted(n: np.ndarray, offsets: np.ndarray, data: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int, exact: bool) -> np.ndarray:
    """Which pairs of rows sizes and bitmaps (data, cut at offsets) admit, as ``_two`` would say."""
    length = np.diff(offsets)
    i, j = np.where(length[i] <= length[j], i, j), np.where(length[i] <= length[j], j, i)
    fit = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]) if exact else np.ones(i.size, dtype=bool)
    out = np.zeros(i.size, dtype=bool)
    kinds = length[i] * (1 << 32) + length[j]
    for kind in np.unique(kinds[fit]).tolist():
        at = np.flatnonzero(fit & (kinds == kind))
        short, long = kind >> 32, kind & (1 << 32) - 1
        step = max(1, (1 << 21) // long)
        for k in range(0, at.size, step):
            a, b = i[at[k : k + step]], j[at[k : k + step]]
            x, y = data[offsets[a][:, None] + np.arange(short)], _folded(data[offsets[b][:, None] + np.arange(long)], short)
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            out[at[k : k + step]] = (100 + percent) * differ <= (100 - percent) * (n[a] + n[b])
    return out


def _connected(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that pairs connect each row with."""
    label = np.arange(size)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if np.array_equal(new, label):
            return label
        label = new


def _cluster_rows(ids: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
    """Rows (cluster, id, head, members) of clusters of so many ids each, one behind another."""
    starts = np.cumsum(members) - members
    name = mix(np.add.reduceat(mix(ids.view(_U)), starts) + members.astype(_U)) if members.size else np.zeros(0, _U)
    heads = np.minimum.reduceat(ids, starts) if members.size else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(name.view(np.int64), members)), pa.array(ids), pa.array(np.repeat(heads, members)), pa.array(np.repeat(members, members))], ["cluster", "id", "head", "members"])


def _small_groups(batch: pa.RecordBatch, percent: int, exact: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Clusters of the groups of at most TOGETHER members that lie inside a batch, all compared at once; and the other rows."""
    group, item = batch.column("group").to_numpy(), batch.column("id").to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [group.size]])
    sizes = np.diff(cuts)
    inside = (sizes > 1) & (sizes <= TOGETHER) & (cuts[:-1] > 0) & (cuts[1:] < group.size)
    take = np.repeat(inside, sizes)
    rows = batch.filter(pa.array(take))
    sizes = sizes[inside]
    starts = np.cumsum(sizes) - sizes
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(sizes).tolist():
        a, b = np.triu_indices(m, 1)
        i.append((starts[sizes == m][:, None] + a).ravel())
        j.append((starts[sizes == m][:, None] + b).ravel())
    i, j = np.concatenate(i), np.concatenate(j)
    bits = rows.column("bits").cast(pa.large_binary())
    offsets = np.frombuffer(bits.buffers()[1], np.int64)[bits.offset : bits.offset + len(bits) + 1] if len(bits) else np.zeros(1, np.int64)
    data = np.frombuffer(bits.buffers()[2], np.uint8) if len(bits) else np.zeros(0, np.uint8)
    good = _pairs_admitted(rows.column("n").to_numpy(), offsets, data, i, j, percent, exact)
    label = _connected(len(rows), i[good], j[good])
    members = np.bincount(label, minlength=len(rows))
    by = np.argsort(label, kind="stable")
    by = by[members[label[by]] > 1]
    return _cluster_rows(item[take][by], members[members > 1]), batch.filter(pa.array(~take))


def clusters(sizes: list[int], maps: list[bytes], percent: int, exact: bool = True) -> list[list[int]]:
    """Places of members that pairs connect which sizes and bitmaps admit at ``percent`` in a hundred; single members are left out.

    exact: whether ``sizes`` are the sets' sizes; if not, they are no less, and rule nobody out by themselves.
    """
    if len(sizes) < 2:
        return []
    if len(sizes) == 2:
        return [[0, 1]] if _two(sizes, maps, percent, exact) else []
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    n = np.array([sizes[i] for i in order], np.int64)
    lengths = np.array([len(maps[i]) for i in order])
    levels = {}
    for size in np.unique(lengths).tolist():
        held = np.zeros((n.size, size), dtype=np.uint8)
        for i in np.flatnonzero(lengths >= size).tolist():
            held[i] = _folded(np.frombuffer(maps[order[i]], np.uint8)[None, :], size)[0]
        levels[size] = held.view(_U)
    label = np.arange(n.size)
    for i in range(n.size - 1):
        end = int(np.searchsorted(n, n[i] * 100 // percent, side="right")) if exact else n.size
        others = i + 1 + np.flatnonzero(label[i + 1 : end] != label[i])
        if not others.size:
            continue
        held = levels[int(lengths[i])]
        differ = np.bitwise_count(held[others] ^ held[i]).sum(axis=1, dtype=np.int64)
        for j in others[(100 + percent) * differ <= (100 - percent) * (n[i] + n[others])].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
    found: dict[int, list[int]] = {}
    for i, x in enumerate(label.tolist()):
        found.setdefault(x, []).append(order[i])
    return [c for c in found.values() if len(c) > 1]


def _admitted(percent: int, exact: bool) -> Callable:
    """mapInArrow function from (group, id, n, bits), sorted by group, to rows of clusters (cluster, id, head, members)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: int | None = None
        items: list[int] = []
        sizes: list[int] = []
        maps: list[bytes] = []
        out: list[list[int]] = []

        def table() -> pa.RecordBatch:
            members, ids = np.array([len(c) for c in out], np.int64), np.array([x for c in out for x in c], np.int64)
            out.clear()
            return _cluster_rows(ids, members)

        def close() -> None:
            out.extend([items[i] for i in c] for c in clusters(sizes, maps, percent, exact))
            items.clear(), sizes.clear(), maps.clear()

        for batch in batches:
            found, batch = _small_groups(batch, percent, exact)
            if found.num_rows:
                yield found
            for group, item, size, bits in zip(*(batch.column(c).to_pylist() for c in ("group", "id", "n", "bits"))):
                if group != own:
                    close()
                    own = group
                items.append(item)
                sizes.append(size)
                maps.append(bits)
            if len(out) > 10_000:
                yield table()
        close()
        yield table()

    return released(run)


def hot_spread(postings: DataFrame, total: int) -> Column:
    """The column ``spread`` of postings (list, id), ``total`` in number: above 0 in lists of more than a 1024th of them.

    Postings are counted by a hash of the list first, and only those of hashes that are hot by list:
    no more than 1 023 lists can be, so that they fit a literal.
    """
    limit = max(LONGEST, total >> 10)
    slot = F.pmod("list", F.lit(1 << 16))
    slots = [r[0] for r in postings.groupBy(slot.alias("slot")).count().where(F.col("count") > limit).select("slot").collect()]
    if not slots:
        return F.lit(0).cast("long")
    hot = [r[0] for r in postings.where(slot.isin(slots)).groupBy("list").count().where(F.col("count") > limit).select("list").collect()]
    return F.when(F.col("list").isin(hot), F.pmod(F.xxhash64("id"), F.lit(SPREAD)) + 1).otherwise(F.lit(0)).cast("long")


def candidate_clusters(postings: DataFrame | list[DataFrame], bits: DataFrame, percent: int, scratch: Scratch, exact: bool = True, apart: int | None = None) -> DataFrame:
    """Rows (cluster, id, head, members): two items that are linked are in one cluster at least.

    postings: long columns list, spread and id; or tables of them that have no list in common, which are dealt one after
    another, so that only one is on disk at a time. apart: postings have a long column sketch, too, and two items whose
    sketches differ in more of the 32 values are not linked. bits: id, n (size of the item's set; if not
    ``exact``, a bound of it) and bits (its bitmap, made with n); rows may repeat. Equal clusters
    have one name. head is the least member. Of a long list, cluster and head are the list, and
    members is ``LONGEST`` + 1.
    """
    parts = []
    for table in postings if isinstance(postings, list) else [postings]:
        dealt = table.select("list", "spread", "id", *([] if apart is None else ["sketch"])).repartition("list", "spread").sortWithinPartitions("list")
        parts.append(scratch.keep(dealt.mapInArrow(_gathered(apart), "group long, id long, sure boolean"), "gathered"))
    gathered = scratch.together(parts)
    groups = gathered.where("not sure").select("group", "id").distinct()
    bits = may_hold(bits.select("id", "n", "bits"), gathered.where("not sure"), "id", gathered.count())
    # Not a semi-join, which would be moved before the filter.
    own = bits.join(groups.select("id").distinct(), "id").dropDuplicates(["id"])
    held = groups.join(own, "id").select("group", "id", "n", "bits")
    found = held.repartition("group").sortWithinPartitions("group").mapInArrow(_admitted(percent, exact), "cluster long, id long, head long, members long")
    sure = gathered.where("sure").select(F.col("group").alias("cluster"), "id", F.col("group").alias("head"), F.lit(LONGEST + 1).cast("long").alias("members"))
    return found.distinct().union(sure.distinct())
