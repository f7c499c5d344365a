"""Exact Jaccard join on word n-grams, as a blocked sparse matrix product.

The rows of the incidence matrix are the different n-gram sets, the columns are n-grams,
and two rows link when ``100 * overlap >= percent * union``. Documents are dealt into row blocks, n-grams into
column blocks, and bounds that follow from the sizes discard pairs; none drops a link:

* Each row block sends each column block its part of the incidence, packed and without repeats, and gets back how
  common each n-gram is. Of a row of n n-grams only the rarest n - ceil(p n / 100) + 1 are multiplied: linked
  rows share one of them. Those that no other row has are left out, so most rows send nothing more.
* An entry of the product carries the row's size and 512 parities (of the numbers of its n-grams by hash). Two
  rows of a and b n-grams differ in as many n-grams as parities at least, and linked ones in (a + b)(100 - p) / (100 + p)
  at most: pairs that share an n-gram but differ by more, or in size, are discarded before anything is closed over.
* What then meets is one candidate component. Within it, overlaps are accumulated against a centre
  (the n-grams of most rows): overlap(x, y) = |centre| - r(x) - r(y) + common removals + common
  additions, so two rows without a common removal or addition are decided by their sizes alone.
* Only rows that the largest component doesn't hold need their exact overlaps: a sparse product
  of their removals and additions with those of all rows, some rows at a time.

Of the rows of a block that share an n-gram, those that differ by half of the bound at most are one entry (with its radius, so that
the bound stays valid): a column block gets few entries from each row block, however many near copies there are.
A component over ``component_cells`` n-grams is dealt into parts: each part alone, then the middle rows of
all parts, then the rows that are still outside the largest component against every part. Rows with the same
set are one row of the matrix from the start.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z as a-z. With fewer words than n,
the whole sequence is the only n-gram; null texts and texts without words have no n-gram and
link with nothing. Rows with a null id have component null and link with nothing. Rows with
the same id are one document with several sets: each is a row of the result. N-grams are
compared as 64-bit hashes, sets of equal hashes as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import arrays as A
from causeway.llm.components import components, joined, with_group
from causeway.runtime import forget, settled

#: n-grams that one block of rows, or of columns, holds.
BLOCK_CELLS = 750_000
#: Pairs of entries of one n-gram that are compared; the rest of its entries are linked without a bound, which costs work and changes no result.
MOST_PAIRS = 50_000_000
PARITIES = 512
_ENTRY = np.dtype([("h", "<u8"), ("node", "<i8"), ("low", "<u4"), ("high", "<u4"), ("radius", "<u4"), ("bits", "<u8", PARITIES // 64)])
_LISTS = "bucket int, grp int, size int, data binary"
_COUNTS = np.round(2.0 ** (np.arange(256) / 8)).astype(np.int64)


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different n-gram hashes of each text, one text after the other, and their numbers."""
    begins, ends, first = A.word_bounds(data, offsets)
    words = A.word_hashes(data, begins, ends, lower=True)
    grams = A.run_hashes(words, n)
    sets, sizes = [], np.zeros(len(first) - 1, np.int64)
    bounds = first.tolist()
    for k in range(len(sizes)):
        s, e = bounds[k], bounds[k + 1]
        if e - s >= n:
            found = np.unique(grams[s : e - n + 1])
        elif e > s:
            h = words[s : s + 1]
            for w in words[s + 1 : e]:
                h = A.mix(h * A.C3 + w)
            found = A.mix(h + np.uint64(e - s))
        else:
            continue
        sets.append(found)
        sizes[k] = len(found)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes


def set_digests(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One signed 64-bit node for each set that isn't empty; zero for the others."""
    out = np.zeros(len(sizes), np.uint64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    for part in _sums(rows, A.mix(grams * A.C1), len(sizes)):
        out = A.mix(out * A.C2 + part)
    return np.where(sizes > 0, A.mix(out + sizes.astype(np.uint64)), 0).view(np.int64)


def _sums(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key of the upper and the lower halves; exact below 2 ** 21 values of one key."""
    halves = values >> A.S32, values & np.uint64(0xFFFFFFFF)
    return tuple(np.bincount(keys, h.astype(np.float64), n).astype(np.uint64) for h in halves)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in A.text_slices(batch):
            grams, sizes = gram_sets(data, offsets, n)
            yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), rows["text_hash"].combine_chunks(), pa.array(sizes), pa.array(set_digests(grams, sizes))], ["doc_id", "text_hash", "n_shingles", "node"])


def _different(column: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams, sizes and nodes of the different sets of some texts."""
    grams, sizes = gram_sets(*A.text_bytes(column), n)
    nodes = set_digests(grams, sizes)
    once = np.zeros(len(nodes), bool)
    once[np.unique(nodes, return_index=True)[1]] = True
    once &= sizes > 0
    return grams[np.repeat(once, sizes)], sizes[once], nodes[once]


def _columns(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of some n-grams without repeats (column block, then 32 bits of the hash), and which of them each n-gram is."""
    return np.unique(A.mix(grams * A.C2) % np.uint64(buckets) << A.S32 | grams & np.uint64(0xFFFFFFFF), return_inverse=True)


def _cuts(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """Each of the ascending buckets, and where its entries begin and end."""
    if not len(buckets):
        return []
    starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    return list(zip(buckets[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(buckets)], strict=True))


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts by eighths of a power of two, as bytes; 0 for a single one."""
    return np.minimum(np.floor(8 * np.log2(counts)), 255).astype(np.uint8)


def rare_first(grams: np.ndarray, sizes: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams by which sets meet, and the index of the set of each: of the first n - ceil(p n / 100) + 1 by level and hash, those that another set has."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((grams, level, rows))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = sizes - -(-sizes * percent // 100) + 1
    chosen = order[(place < first[rows]) & (level[order] > 0)]
    return grams[chosen], rows[chosen]


def entries(grams: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """An entry for each n-gram by which a set meets others."""
    h, row = rare_first(grams, sizes, level, percent)
    used = np.zeros(len(sizes), bool)
    used[row] = True
    own = np.repeat(used, sizes)
    place = np.cumsum(used) - 1
    at = place[np.repeat(np.arange(len(sizes)), sizes)[own]] * PARITIES + (A.mix(grams[own] * A.C3) % np.uint64(PARITIES)).astype(np.int64)
    odd = np.bincount(at, minlength=int(used.sum()) * PARITIES) & 1
    bits = np.packbits(odd.astype(bool)).view("<u8").reshape(-1, PARITIES // 64)
    out = np.zeros(len(h), _ENTRY)
    out["h"], out["node"], out["low"], out["high"], out["bits"] = h, nodes[row], sizes[row], sizes[row], bits[place[row]]
    return out


def _may_link(x: np.ndarray, y: np.ndarray, percent: int, tight: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether the bounds let entries link (``tight``: whether they differ by half as much at most), and in how many parities they differ."""
    differ = np.bitwise_count(x["bits"] ^ y["bits"]).sum(axis=-1, dtype=np.int64)
    low, high = (np.stack(np.broadcast_arrays(x[c], y[c])).astype(np.int64) for c in ("low", "high"))
    sizes = (high[0] * 100 >= percent * low[1]) & (high[1] * 100 >= percent * low[0])
    if tight:
        return sizes & (2 * (differ + x["radius"] + y["radius"]) <= low.sum(axis=0) * (100 - percent) // (100 + percent)), differ
    return sizes & (differ <= high.sum(axis=0) * (100 - percent) // (100 + percent) + x["radius"] + y["radius"]), differ


def _clusters(e: np.ndarray, percent: int, tight: bool) -> np.ndarray:
    """The first entry of each one's cluster: entries of one n-gram, closed over pairs that may link (``tight``: those next to a first one alone)."""
    lead, work = np.full(len(e), -1), 0
    while (rest := np.flatnonzero(lead < 0)).size:
        top, front = rest[0], rest[:1]
        lead[top], rest = top, rest[1:]
        while front.size and rest.size:
            new = np.zeros(len(rest), bool)
            step = max(1, 200_000 // len(rest))
            for k in range(0, len(front), step):
                work += len(rest) * len(front[k : k + step])
                new |= work > MOST_PAIRS or _may_link(e[front[k : k + step]][:, None], e[rest][None], percent, tight)[0].any(axis=0)
            lead[rest[new]] = top
            front, rest = rest[:0] if tight else rest[new], rest[~new]
    return lead


def close(e: np.ndarray, percent: int, tight: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One entry for each cluster of entries that share an n-gram, and the links of its nodes to that one's node."""
    e = e[np.lexsort((e["node"], e["h"]))]
    starts = np.flatnonzero(np.concatenate(([True], e["h"][1:] != e["h"][:-1]))) if len(e) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(e)))
    lead = np.repeat(starts, sizes)
    near = _may_link(e, e[lead], percent, tight)[0] | (lead == np.arange(len(e)))
    known: dict[bytes, np.ndarray] = {}
    for s, n in zip(*(v[~np.logical_and.reduceat(near, starts)].tolist() for v in (starts, sizes)), strict=True) if len(e) else ():
        key = e["node"][s : s + n].tobytes()  # near copies meet by many n-grams, always the same rows
        if key not in known:
            known[key] = _clusters(e[s : s + n], percent, tight)
        lead[s : s + n] = known[key] + s
    far = np.bitwise_count(e["bits"] ^ e["bits"][lead]).sum(axis=-1, dtype=np.uint32)
    out = e.copy()
    np.maximum.at(out["radius"], lead, far + e["radius"])
    np.minimum.at(out["low"], lead, e["low"])
    np.maximum.at(out["high"], lead, e["high"])
    links = np.stack([e["node"], e["node"][lead]], 1)
    return out[lead == np.arange(len(e))], np.unique(links[links[:, 0] != links[:, 1]], axis=0)


def _meet(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """Links (a, b) of sets that may be similar, closed over what the bounds leave."""
    # a text that very many rows repeat, id and all, is in one block for each input partition; both uses read one exchange
    dealt = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(buckets)).cast("int"))

    def rows(out: list[tuple]) -> pa.Table:
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table({c: pa.array(v, pa.binary() if c == "data" else pa.int32()) for c, v in zip(("bucket", "grp", "size", "data"), columns, strict=True)})

    def ask(key, table):
        keys, of = _columns(_different(table["text"], n)[0], buckets)
        level = _level(np.bincount(of, minlength=len(keys)))
        A.release()
        return rows([(b, key[0].as_py(), e - s, keys[s:e].astype("<u4").tobytes() + level[s:e].tobytes()) for b, s, e in _cuts((keys >> A.S32).astype(np.int64))])

    def answer(table):
        sizes, data = table["size"].to_pylist(), table["data"].to_pylist()
        keys = np.concatenate([np.frombuffer(d, "<u4", k) for d, k in zip(data, sizes, strict=True)])
        counts = _COUNTS[np.concatenate([np.frombuffer(d, np.uint8, offset=4 * k) for d, k in zip(data, sizes, strict=True)])]
        _, of = np.unique(keys, return_inverse=True)
        level, ends = _level(np.bincount(of, counts))[of], np.cumsum(sizes).tolist()
        A.release()
        return table.set_column(3, "data", pa.array([level[e - k : e].tobytes() for e, k in zip(ends, sizes, strict=True)], pa.binary()))

    def meet(key, table, answers):
        grams, sizes, nodes = _different(table["text"], n)
        keys, of = _columns(grams, buckets)
        got = dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True))
        level = np.zeros(len(keys), np.uint8)
        for b, s, e in _cuts((keys >> A.S32).astype(np.int64)):
            level[s:e] = np.frombuffer(got[b], np.uint8)
        found, links = close(entries(grams, sizes, nodes, level[of], percent), percent, tight=True)
        del grams, keys, of
        A.release()
        bucket = (found["h"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out = [(b, key[0].as_py(), e - s, found[order[s:e]].tobytes()) for b, s, e in _cuts(bucket[order])]
        return rows([*out, (key[0].as_py(), key[0].as_py(), -1, links.astype("<i8").tobytes())])

    def link(table):
        sizes, data = table["size"].to_pylist(), table["data"].to_pylist()
        found = np.frombuffer(b"".join(d for d, k in zip(data, sizes, strict=True) if k >= 0), _ENTRY)
        known = np.frombuffer(b"".join(d for d, k in zip(data, sizes, strict=True) if k < 0), "<i8").reshape(-1, 2)
        links = np.unique(np.concatenate([close(found, percent)[1], known]), axis=0)
        A.release()
        return pa.table({"a": links[:, 0].copy(), "b": links[:, 1].copy()})

    asked = dealt.groupBy("grp").applyInArrow(ask, _LISTS)
    answered = asked.groupBy("bucket").applyInArrow(answer, _LISTS)
    met = dealt.groupBy("grp").cogroup(answered.groupBy("grp")).applyInArrow(meet, _LISTS)
    return met.groupBy("bucket").applyInArrow(link, "a long, b long")


def linked_rows(grams: np.ndarray, sizes: np.ndarray, percent: int, cells: int = 1_000_000) -> tuple[np.ndarray, int]:
    """For each set the index of the first one of its component, and the set next to the centre: the blocked product with its bounds."""
    m, p = len(sizes), percent
    top = np.arange(m)
    if m < 2:
        return top, 0
    rows = np.repeat(np.arange(m), sizes)
    _, item, count = np.unique(grams, return_inverse=True, return_counts=True)
    centre = count > m / 2
    total = int(centre.sum())
    inside = np.bincount(rows[centre[item]], minlength=m)
    cost = (100 + p) * (total - inside) + p * sizes  # linked without anything in common outside: cost(x) + cost(y) <= (100 + p) * total
    best = int(np.argmin(cost))
    near = cost + cost[best] <= (100 + p) * total
    near[best] = True
    top[near] = np.flatnonzero(near)[0]
    # what rows lack of the centre (odd items) and have besides it (even items)
    added = ~centre[item]
    place = np.cumsum(centre) - 1
    lacks_row, lacks_item = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = max(1, cells // max(1, total))
    for s in range(0, m if total else 0, step):
        e = min(m, s + step)
        has = np.zeros((e - s, total), bool)
        own = ~added & (rows >= s) & (rows < e)
        has[rows[own] - s, place[item[own]]] = True
        r, c = np.nonzero(~has)
        lacks_row, lacks_item = np.append(lacks_row, r + s), np.append(lacks_item, np.flatnonzero(centre)[c])
    r = np.concatenate([rows[added], lacks_row])
    k = np.concatenate([2 * item[added], 2 * lacks_item + 1])
    by_item, by_row = np.lexsort((r, k)), np.lexsort((k, r))
    names, starts = np.unique(k[by_item], return_index=True)
    holders, spans = r[by_item], np.append(starts, len(k))
    of_row = np.searchsorted(names, k[by_row])
    row_at = np.searchsorted(r[by_row], np.arange(m + 1))
    weight = np.diff(spans)

    largest = np.bincount(top, minlength=m).argmax()
    left = np.flatnonzero(top != largest)
    work = np.array([weight[of_row[row_at[x] : row_at[x + 1]]].sum() for x in left], np.int64)
    at = 0
    while at < len(left):
        to, sum_ = at + 1, work[at]
        while to < len(left) and sum_ + work[to] <= cells and (to + 1 - at) * m <= cells:
            sum_ += work[to]
            to += 1
        chosen = left[at:to]
        items = np.concatenate([of_row[row_at[x] : row_at[x + 1]] for x in chosen])
        line = np.repeat(np.arange(len(chosen)), row_at[chosen + 1] - row_at[chosen])
        n = weight[items]
        flat = np.repeat(spans[items] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(np.repeat(line, n) * m + holders[flat], minlength=len(chosen) * m).reshape(len(chosen), m)
        x, y = np.nonzero((common > 0) & (cost[chosen][:, None] + cost[None] <= (100 + p) * (total + common)))
        x = chosen[x]
        for a, b in zip(x[x != y].tolist(), y[x != y].tolist(), strict=True):
            _join(top, a, b)
        at = to
    return np.array([_root(top, x) for x in range(m)]), best


def _root(top: np.ndarray, x: int) -> int:
    while top[x] != x:
        top[x] = top[top[x]]
        x = top[x]
    return int(x)


def _join(top: np.ndarray, a: int, b: int) -> None:
    a, b = _root(top, a), _root(top, b)
    top[max(a, b)] = min(a, b)


_PRODUCT = "component long, part int, a long, b long, main boolean"


def _product(table: pa.Table, n: int, percent: int) -> pa.Table:
    """The rows of each (component, part) with another one of their true component; ``main`` is true in that of the row next to the centre, which then is the other one."""
    by: dict[tuple, list[int]] = {}
    for k, c in enumerate(zip(table["component"].to_pylist(), table["part"].to_pylist(), strict=True)):
        by.setdefault(c, []).append(k)
    out = [(np.zeros(0, np.int64),) * 5]
    for (component, part), rows in by.items():
        some = table.take(rows)
        grams, sizes = gram_sets(*A.text_bytes(some["text"]), n)
        digests = set_digests(grams, sizes)
        mine = np.zeros(len(rows), bool)
        mine[np.unique(digests, return_index=True)[1]] = True
        mine &= digests == some["node"].to_numpy()  # a repeated id can bring another text
        node = digests[mine]
        if not len(node):
            continue
        top, best = linked_rows(grams[np.repeat(mine, sizes)], sizes[mine], percent)
        main = top == top[best]
        out.append((np.full(len(node), component), np.full(len(node), part), node, node[np.where(main, best, top)], main))
    A.release()
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.table({"component": columns[0], "part": pa.array(columns[1], pa.int32()), "a": columns[2], "b": columns[3], "main": columns[4].astype(bool)})


def _verified(members: DataFrame, docs: DataFrame, n: int, percent: int, dealt: int, component_cells: int) -> DataFrame:
    """True links (a, b) of ``members`` (component, node, doc_id, cells): each component a task, or parts of a large one."""
    weight = members.groupBy("component").agg(F.count("*").alias("_n"), F.sum("cells").alias("weight"))
    weight = settled(weight.withColumn("cut", F.ceil(F.col("weight") / component_cells).cast("int")), "weight")

    def multiplied(texts: DataFrame) -> DataFrame:
        tasks = texts.select("component", "part", "node", "text").withColumn("task", F.pmod(F.xxhash64("component", "part"), F.lit(dealt)).cast("int"))
        return settled(tasks.groupBy("task").applyInArrow(lambda t: _product(t.drop(["task"]), n, percent), _PRODUCT), "product")

    cut = joined(members, weight, "component", members.count()).withColumn("part", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    # texts are shuffled at every size: members grow with the input, so that they are no side to broadcast
    texts = docs.join(cut.hint("merge"), "doc_id").select("component", "cut", "part", "node", "cells", "text")
    if weight.where("cut > 1").isEmpty():
        return multiplied(texts).select("a", "b")
    # of large components: each part alone, the middle rows of all parts, and what is still outside against every part
    pair = ["component", "node"]
    texts = settled(texts, "texts")
    alone, big = multiplied(texts), texts.where("cut > 1")
    middle = alone.where("main").select("component", F.col("b").alias("node")).distinct()
    links = alone.select("a", "b").union(multiplied(big.join(middle, pair, "left_semi").withColumn("part", F.lit(0))).select("a", "b"))
    light = big.select(*pair, "cells").distinct()
    light = settled(light.join(components(links).withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")), "light")
    sums = settled(light.groupBy("component", "label").agg(F.count("*").alias("rows")), "sums")
    sums = with_group(sums, "component", sums.count(), F.max(F.struct("rows", "label")).alias("largest")).select("component", "label", F.col("rows").alias("_n"), (F.col("largest.label") == F.col("label")).alias("inside"))
    left = settled(joined(light, sums, ["component", "label"], light.count()).where("not inside").select(*pair, "cells"), "left")
    pieces = left.groupBy("component").agg(F.ceil(F.sum("cells") / component_cells).cast("int").alias("pieces"))
    pieces = settled(pieces.join(weight.select("component", "_n"), "component"), "pieces")
    own = joined(left, pieces, "component", left.count()).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    outside = big.join(own.select(*pair, "piece"), pair).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    every = big.join(joined(light.select(*pair), pieces, "component", light.count()), pair).withColumn("other", F.col("part"))
    every = every.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    both = outside.select(*pair, "cut", "piece", "other", "text").union(every.select(*pair, "cut", "piece", "other", "text"))
    return links.union(multiplied(both.withColumn("part", F.col("piece") * F.col("cut") + F.col("other"))).select("a", "b"))


def document_classes(docs: DataFrame, n: int = 3, percent: int = 90, component_cells: int = 1_000_000) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, component, component_id), a row for each row of ``docs`` (doc_id, text).

    node names its set, component the sets that are linked; component_id is the smallest id of them.
    ``component_cells`` bounds the n-grams that one task holds for a candidate component.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    A.small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.withColumn("text_hash", F.xxhash64("text"))
    sets = settled(named.mapInArrow(lambda it: _sets(it, n), f"doc_id {kind}, text_hash long, n_shingles long, node long"), "sets")
    real = sets.where("n_shingles > 0 and doc_id is not null")
    total = real.agg(F.sum("n_shingles")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = settled(_meet(docs.where("doc_id is not null"), n, percent, max(parts, total // BLOCK_CELLS)), "met")
    classes = settled(real.groupBy("node").agg(F.count("*").alias("_n"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("cells")), "classes")
    members = settled(components(links).join(classes, "node").select("component", "node", F.col("least").alias("doc_id"), "cells"), "members")
    found = components(_verified(members, docs, n, percent, max(parts, 2 * (total // component_cells)), component_cells))
    forget(links, members)
    labels = settled(classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "labels")
    labels = settled(with_group(labels.select("node", "component", "least", F.col("_n").alias("rows")), "component", labels.count(), F.min("least").alias("component_id")), "labels")
    done = joined(real, labels.select("node", "component", "component_id", F.col("rows").alias("_n")), "node", real.count())
    nothing = sets.where("n_shingles = 0 or doc_id is null").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return done.select(nothing.columns).union(nothing)


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, component_cells: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs`` (doc_id, text): component_id is the smallest id reachable by links."""
    return document_classes(docs, n, percent, component_cells).select("doc_id", "n_shingles", "component_id")


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, component_cells: int = 1_000_000) -> DataFrame:
    """Of the rows of each component the one with the smallest (doc_id, node, hash of its text); one of equal rows.

    Rows without words and rows with a null id link with nothing and stay, repeated ones too.
    """
    row = ["doc_id", "text_hash"]
    classes = settled(document_classes(docs, n, percent, component_cells), "rows")
    linked = classes.where("component is not null")
    first = linked.groupBy("component").agg(F.min(F.struct("doc_id", "node", "text_hash")).alias("first")).select("first.doc_id", "first.text_hash")
    again = settled(linked.groupBy(*row).agg(F.count("*").alias("rows")).where("rows > 1").select(row).join(first, row, "left_semi"), "again")
    stay = first.union(classes.where("component is null and doc_id is not null").select(row)).hint("merge")
    packed = docs.select(F.struct(*(A.column(c) for c in docs.columns)).alias("r"), "doc_id", F.xxhash64("text").alias("text_hash"))  # names can't clash
    kept = packed.join(stay, row, "left_semi")
    if not again.isEmpty():
        once = kept.join(again.hint("merge"), row, "left_semi").groupBy(*row).agg(F.first("r").alias("r"))
        kept = kept.join(again.hint("merge"), row, "left_anti").select("r").union(once.select("r"))
    return kept.select("r.*").union(docs.where("doc_id is null"))
