"""N-gram Jaccard join: an exact metric-space join of shingle sets.

Jaccard distance is a metric. Documents at distance r = 0.25 at most are linked.

1. *Nodes.* Shingles that only one document holds count for a set's size alone; a document whose other shingles are fewer than
   0.75 |x| is alone for certain. Equal sets are one node.
2. *Pivots.* Documents that share nothing are all at distance 1, so pivots must come from a document's surroundings. Linked documents
   share one of their first |x| - ceil(0.75 |x|) + 1 shingles by rarity; the holders of such a shingle are a neighbourhood, and it
   elects the document with the largest share of shared shingles (the original among edited copies) as its pivot. Neighbourhoods with
   the same pivot are one region: any linked pair meets in one. Distances to its pivots are taken for every document; those within r link.
3. *Regions* whose members are not all in one component by then are joined exactly. A small one goes to one task, where pivots, balls
   and rings divide it further (``join_sets``). A large one is dealt in chunks to many tasks, each with the same new pivots, drawn from
   outside the region's largest component (of any two members in different components one is outside it). Pivots are compared with
   all members and are then done with. If they were not all such members, the others go to the Voronoi region of their nearest
   pivot; a boundary document also goes to each later pivot p with d(x, p) <= d(x, nearest) + 2 r, since
   d(x, p) <= d(x, y) + d(y, p) <= r + d(y, nearest of x) <= 2 r + d(x, nearest of x) for every y of region p within r of x.
   These regions are joined in the same way, level by level.
4. *Regions that do not divide* (the Voronoi regions together would leave over half of the pairs: many documents, none linked, and all
   at much the same distance of each other) take all members outside the largest component as pivots, some for each task, without
   a further level. No exact join avoids comparing these; time and rows sent grow with the square of such a region, memory of
   a task stays bounded by chunk and pivots.

No pair is left out and no region has a cap.

Edge cases
----------
* null or empty text, or no words: size 0, linked with nothing;
* fewer words than a shingle: the whole sequence is the one shingle;
* equal sets (copies): one node, whatever their number;
* repeated ids: each row is judged by its own text, component_id is the smallest id that this text reaches;
* null id: the row is returned with its size and a null component, and takes no part;
* empty table: empty result; extra columns are ignored.

Shingles are compared by at least 58 bits of a Rabin-Karp residue whose bases are drawn anew for each job, so that no text can be made to
collide; they are read within one pair of documents only. A set's size is counted on the whole residue of 61 bits. Words themselves
are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X
from . import words as W
from .components import components
from .scratch import Scratch

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A region of up to BLOCK members and WEIGHT shingles in all is joined in one task.
BLOCK = 192
WEIGHT = 4_000_000
#: Of a larger one a task gets CHUNK members (or WEIGHT shingles) and PIVOTS pivots.
CHUNK = 160
PIVOTS = 32
#: Shares of a region from which pivots are drawn first.
SHARES = 8
#: A region divides if its Voronoi regions have GROWTH times its members at most and, in all, WORK times its pairs.
GROWTH, WORK = 2, 0.5
_MANY = 0xFFFF
_DOCS = "id long, n int, s1 long, s2 long, tokens array<long>"


def _sets(data: np.ndarray, offsets: np.ndarray, k: int, key: W.Key) -> Iterator[np.ndarray]:
    """Per text, the hashes of its distinct shingles, ascending."""
    for at, to in W.chunks(offsets):
        w = W.split(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], W.SPACE, True)
        values = w.values(key.word[0])
        full = W.mix(W.rolling(values, k, key.window[0]))
        for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist()):
            if b - a >= k:
                yield np.unique(full[a : b - k + 1])
            elif b > a:
                # With the length as first digit: a sequence of fewer words is no shingle of k words.
                yield W.mix(W.rolling(np.concatenate([[np.uint64(b - a)], values[a:b]]), b - a + 1, key.window[0]))
            else:
                yield np.zeros(0, np.uint64)


def _mapper(bits: int, k: int, key: W.Key):
    salt = np.uint64(0xA5A5A5A55A5A5A5A)
    kept = np.uint64((1 << 64) - (1 << (64 - bits)) | (1 << 48) - 1)  # the bucket's bits and those that are sent

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, data, offsets in X.batches(source):
            ids = rows.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            sets = list(_sets(data, offsets, k, key))
            n = np.array([len(s) for s in sets], dtype=np.int32)
            token = np.concatenate(sets) & kept
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            sums = np.zeros((2, len(sets)), np.uint64)
            some = n > 0
            if len(token):
                first = (np.cumsum(n) - n)[some]
                sums[0, some] = np.add.reduceat(W.mix(token), first)
                sums[1, some] = np.add.reduceat(W.mix(token ^ salt), first)
            order = np.argsort(token, kind="stable")
            token, doc = token[order], doc[order]
            begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            size = np.diff(np.r_[begin, len(token)])
            many = size > 1
            inside = np.repeat(many, size)
            shared = np.array([int(many.sum())], np.int64).tobytes() + token[begin][many].tobytes() + size[many].astype(np.int64).tobytes() + doc[inside].tobytes()
            out = [(X.own_key(batch), batch, X.META, ids.tobytes(), n.tobytes(), sums.tobytes(), shared)]
            if len(token):
                token, doc = token[begin], np.where(many, _MANY, doc[begin]).astype(np.uint16)
                order, buckets, begin = X.by_bucket(token, bits)
                packed, doc, size = X.pack(token[order], 0, 6), doc[order], size[order].astype(np.uint32)
                for bucket, a, b in zip(buckets.tolist(), begin[:-1].tolist(), begin[1:].tolist()):
                    counts = size[a:b][doc[a:b] == _MANY]
                    out.append((bucket, batch, X.PART, packed[a:b].tobytes(), doc[a:b].tobytes(), counts.tobytes(), None))
            yield X.as_rows(out)

    return run


def _reducer(bits: int):
    """Replies with the shingles that more than one document holds, and in how many."""

    def run(bucket: int, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [X.unpack(a, 0, 6, bucket, bits) for a in rows["a"]]
        docs = [np.frombuffer(b, np.uint16) for b in rows["b"]]
        counts = [np.ones(len(p), np.int64) for p in parts]
        for c, d, given in zip(counts, docs, rows["c"]):
            c[d == _MANY] = np.frombuffer(given, np.uint32)
        unique, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)[inverse]
        out, at = [], 0
        for batch, part, doc in zip(rows["batch"], parts, docs):
            df = total[at : at + len(part)]
            at += len(part)
            mine = df > 1
            if mine.any():
                out.append((-1, batch, X.REPLY, X.pack(part[mine], 0, 8).tobytes(), doc[mine].tobytes(), np.minimum(df[mine], 0xFFFFFFFF).astype(np.uint32).tobytes(), None))
        return pd.DataFrame(out, columns=["key", "batch", "kind", "a", "b", "c", "d"])

    return run


def _assembler(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        meta = rows[rows["kind"] == X.META].iloc[0]
        replies = rows[rows["kind"] == X.REPLY]
        ids, n = np.frombuffer(meta["a"], np.int64), np.frombuffer(meta["b"], np.int32)
        sums = np.frombuffer(meta["c"], np.int64).reshape(2, -1)
        tokens: list = [None] * len(ids)
        if len(replies):
            token = np.concatenate([X.unpack(a, 0, 8, 0, 64) for a in replies["a"]])
            doc = np.concatenate([np.frombuffer(b, np.uint16) for b in replies["b"]])
            df = np.concatenate([np.frombuffer(c, np.uint32) for c in replies["c"]])
            m = int(np.frombuffer(meta["d"], np.int64, 1)[0])
            if m:
                held = np.frombuffer(meta["d"], np.uint64, m, 8)
                size = np.frombuffer(meta["d"], np.int64, m, 8 + 8 * m)
                holders = np.frombuffer(meta["d"], np.uint16, -1, 8 + 16 * m)
                begin = np.cumsum(size) - size
                many = np.flatnonzero(doc == _MANY)
                where = np.searchsorted(held, token[many])
                times = size[where]
                index = np.repeat(begin[where] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
                one = doc != _MANY
                token = np.concatenate([token[one], np.repeat(token[many], times)])
                df = np.concatenate([df[one], np.repeat(df[many], times)])
                doc = np.concatenate([doc[one], holders[index]])
            order = np.lexsort((token, df, doc))
            token, doc = token[order].view(np.int64), doc[order]
            edge = np.searchsorted(doc, np.arange(len(ids) + 1))
            for i in np.flatnonzero((np.diff(edge) * 100 >= n.astype(np.int64) * percent) & (n > 0)).tolist():
                tokens[i] = token[edge[i] : edge[i + 1]]
        return pd.DataFrame({"id": ids, "n": n, "s1": sums[0], "s2": sums[1], "tokens": tokens})

    return run


def _overlap(flat: np.ndarray, begin: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Size of the intersection of ``pivot`` (sorted) with every set of a concatenation."""
    at = np.searchsorted(pivot, flat)
    at[at == len(pivot)] = 0
    return np.add.reduceat((pivot[at] == flat).astype(np.int64), begin)


def join_sets(sets: list[np.ndarray], sizes: np.ndarray, component: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between members of different components, enough to join all that are linked: a recursive pivot join.

    ``sets`` hold the shared shingles of each member, ``sizes`` the sizes of the whole sets.
    """
    radius = 1 - percent / 100 + 1e-9
    root = np.unique(component, return_inverse=True)[1]
    sets = [np.sort(s) for s in sets]
    found: list[tuple[int, int]] = []
    todo = [np.arange(len(sets))]
    while todo:
        members = todo.pop()
        if len(members) < 2:
            continue
        # One of any two in different components is outside the largest: its members need not be pivots.
        outside = np.flatnonzero(root[members] != np.bincount(root[members]).argmax())
        if not len(outside):
            continue
        pivot, rest = members[outside[0]], np.delete(members, outside[0])
        flat = np.concatenate([sets[i] for i in rest])
        length = np.array([len(sets[i]) for i in rest])
        common = _overlap(flat, np.cumsum(length) - length, sets[pivot])
        union = sizes[rest] + sizes[pivot] - common
        for other in rest[100 * common >= percent * union]:
            if root[other] != root[pivot]:
                found.append((int(pivot), int(other)))
                root[root == root[other]] = root[pivot]
        ring = np.floor((1 - common / union) / radius).astype(int)
        groups = [rest[(ring == r) | (ring == r + 1)] for r in np.unique(ring)]
        if max(map(len, groups)) > 0.7 * len(rest):
            todo.append(rest)  # the windows would replicate most of it
        else:
            todo.extend(groups)
    return found


def _join_region(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy()
        sets = [np.asarray(t, dtype=np.int64) for t in rows["tokens"]]
        W.release()
        links = join_sets(sets, rows["n"].to_numpy().astype(np.int64), rows["component"].to_numpy(), percent)
        return pd.DataFrame({"a": [node[i] for i, _ in links], "b": [node[j] for _, j in links]}, dtype="int64")

    return run


def voronoi(distance: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, pivot) pairs of a matrix of distances, one row for each member: its nearest pivot, and the later ones in whose regions a
    document within ``radius`` of it may lie."""
    home = distance.argmin(axis=1)
    near = distance[np.arange(len(distance)), home]
    later = np.arange(distance.shape[1]) > home[:, None]
    into = later & (distance <= near[:, None] + 2 * radius)
    into[np.arange(len(distance)), home] = True
    return np.nonzero(into)


def _meet_pivots(percent: int):
    """Links of one chunk of members with some pivots (rows with ``pivot``) and, where the region divides, each other member's regions."""
    radius = 1 - percent / 100 + 1e-9

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pivots, members = rows[rows["pivot"]].sort_values("node"), rows[~rows["pivot"]]
        out = []
        if len(members) and len(pivots):
            sets = [np.asarray(t, dtype=np.int64) for t in members["tokens"]]
            length = np.array([len(s) for s in sets])
            flat, begin, n = np.concatenate(sets), np.cumsum(length) - length, members["n"].to_numpy().astype(np.int64)
            common = np.stack([_overlap(flat, begin, np.sort(np.asarray(t, dtype=np.int64))) for t in pivots["tokens"]], axis=1)
            union = n[:, None] + pivots["n"].to_numpy().astype(np.int64) - common
            differ = members["component"].to_numpy()[:, None] != pivots["component"].to_numpy()
            node, other = members["node"].to_numpy(), pivots["node"].to_numpy()
            for i, k in zip(*np.nonzero((100 * common >= percent * union) & differ)):
                out.append((False, int(node[i]), int(other[k])))
            if rows["divides"].iloc[0]:
                rest = np.flatnonzero(~np.isin(node, other))
                out += [(True, int(node[rest[i]]), int(other[k])) for i, k in zip(*voronoi(1 - common[rest] / union[rest], radius))] if len(rest) else []
        W.release()
        return pd.DataFrame(out, columns=["region", "a", "b"]).astype({"region": bool, "a": "int64", "b": "int64"})

    return run


def _relabel(known: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``known`` with the components that ``links`` put together."""
    a, b = known.select(F.col("node").alias("a"), F.col("component").alias("x")), known.select(F.col("node").alias("b"), F.col("component").alias("y"))
    merged = components(links.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("merged"))
    known = known.join(merged, "component", "left").select("node", "n", "weight", F.coalesce("merged", "component").alias("component"))
    return scratch.write(known, "known")[0]


def _join_regions(regions: DataFrame, nodes: DataFrame, known: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Components after all links within ``regions`` (region, node, stuck) are found, level by level."""
    sets = nodes.select("node", "tokens")
    while True:
        members = regions.join(known, "node")
        parts = members.groupBy("region", "stuck", "component").agg(F.count("*").alias("c"), F.sum("weight").alias("w"))
        sizes = parts.groupBy("region", "stuck").agg(F.sum("c").alias("members"), F.sum("w").alias("weight"), F.max(F.struct("c", "component")).alias("most"))
        sizes = sizes.select("region", "stuck", "members", "weight", (F.col("members") - F.col("most.c")).alias("outside"), F.col("most.component").alias("main")).filter("outside > 0")
        sizes = sizes.withColumn("large", (F.col("members") > BLOCK) | ((F.col("weight") > WEIGHT) & (F.col("members") > 2)))
        sizes, sizes_at = scratch.write(sizes, "sizes")
        n_all, n_large = sizes.agg(F.count("*"), F.sum(F.col("large").cast("int"))).first()
        if not n_all:
            return known
        small = members.join(sizes.filter("not large").select("region"), "region", "left_semi").join(sets, "node")
        links, links_at = scratch.write(small.select("region", "node", "n", "component", "tokens").groupBy("region").applyInPandas(_join_region(percent), "a long, b long").distinct(), "links")
        if not n_large:
            return _relabel(known, links, scratch)
        most = F.least(F.lit(PIVOTS), F.greatest(F.lit(1), F.floor(F.lit(WEIGHT) * F.col("members") / F.greatest("weight", F.lit(1))))).cast("long")
        large = sizes.filter("large").withColumn("most", most)
        # Few outside members are all pivots of one group; those of a region that does not divide make many groups.
        large = large.withColumn("divides", ~F.col("stuck") & (F.col("outside") > F.col("most"))).withColumn("groups", F.when(F.col("divides"), 1).otherwise(F.ceil(F.col("outside") / F.col("most"))).cast("int"))
        large = large.withColumn("chunks", F.ceil(F.greatest(F.col("members") / CHUNK, F.col("weight") / WEIGHT)).cast("int"))
        met = members.drop("stuck", "weight").join(large.select("region", "main", "most", "divides", "groups", "chunks"), "region")
        met, met_at = scratch.write(met, "met")  # so that a large region's rows need not be in one place for what follows
        hashed = F.xxhash64("node")
        # Drawn from shares of a region first, so that a large region's members stay where they are.
        rank = lambda *by: F.row_number().over(Window.partitionBy("region", *by).orderBy(hashed, "node"))
        outside = met.filter("component <> main")
        pivots = outside.filter("not divides").withColumn("group", F.pmod(hashed, F.col("groups")).cast("int"))
        drawn = outside.filter("divides").withColumn("share", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(SHARES))).withColumn("rank", rank("share")).filter(F.col("rank") <= PIVOTS)
        drawn = drawn.withColumn("rank", rank()).filter(F.col("rank") <= PIVOTS).filter("rank <= most").drop("rank", "share").withColumn("group", F.lit(0))
        pivots = pivots.unionByName(drawn).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("pivot", F.lit(True))
        dealt = met.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")).withColumn("pivot", F.lit(False))
        columns = ["region", "group", "chunk", "pivot", "divides", "node", "n", "component", "tokens"]
        task = dealt.unionByName(pivots).join(sets, "node").select(*columns)
        # Rows carry the region they come from along, for the names of the new ones.
        meet = _meet_pivots(percent)
        found = task.groupBy("region", "group", "chunk").applyInPandas(lambda key, rows: meet(rows).assign(parent=key[0])[["parent", "region", "a", "b"]], "parent string, region boolean, a long, b long")
        found, found_at = scratch.write(found, "found")
        known = _relabel(known, links.unionByName(found.filter("not region").select("a", "b").distinct()), scratch)
        inner = found.filter("region").select(F.concat_ws(".", "parent", "b").alias("region"), "parent", F.col("a").alias("node"))
        parents = large.filter("divides").select(F.col("region").alias("parent"), F.col("members").alias("size"))
        grown = inner.groupBy("parent", "region").agg(F.count("*").alias("c")).groupBy("parent").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("pairs"))
        worth = (F.col("all") <= GROWTH * F.col("size")) & (F.col("pairs") <= WORK * F.col("size") * F.col("size"))
        judged = parents.join(grown, "parent", "left").select("parent", F.coalesce(worth, F.lit(True)).alias("worth"))
        judged, judged_at = scratch.write(judged, "judged")
        inner = inner.join(judged.filter("worth"), "parent", "left_semi").select("region", "node", F.lit(False).alias("stuck"))
        whole = regions.join(judged.filter("not worth").withColumnRenamed("parent", "region"), "region", "left_semi").select("region", "node", F.lit(True).alias("stuck"))
        regions, _ = scratch.write(inner.unionByName(whole), "regions")
        scratch.drop(judged_at)
        scratch.drop(sizes_at, links_at, found_at, met_at)


def shared_sets(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n, s1, s2, tokens): the size and fingerprint of each set and, where links are possible, its shared shingles, rarest first."""
    docs = X.settled(docs.filter("id is not null"), scratch)
    bits = X.bucket_bits(docs)
    return X.exchange(docs, _mapper(bits, shingle, W.new_key()), _reducer(bits), _assembler(percent), _DOCS)


def _sizes(k: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            data, offsets = W.buffers(rows.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in _sets(data, offsets, k, W.FIXED)], pa.int32())], names=["n"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row."""
    docs = X.columns_of(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "jaccard", bounded=True)
    table, table_at = scratch.write(shared_sets(docs, scratch, shingle, percent), "sets")
    close = table.filter("tokens is not null")
    nodes = close.groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "tokens")).alias("x"))
    nodes, nodes_at = scratch.write(nodes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n", "x.id", "x.tokens"), "nodes")

    need = F.ceil(F.col("n") * percent / 100)
    homes = nodes.select("node", "n", (F.size("tokens") / F.col("n")).alias("share"), F.explode(F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.size("tokens") - need + 1).cast("int"))).alias("shingle"))
    homes, homes_at = scratch.write(homes, "homes")
    elected = homes.groupBy("shingle").agg(F.max(F.struct("share", (-F.col("node")).alias("node"), "n")).alias("x"), F.count("*").alias("members")).filter("members > 1")
    elected, elected_at = scratch.write(elected.select("shingle", (-F.col("x.node")).alias("pivot"), F.col("x.n").alias("pivot_n")), "pivots")
    # Sizes rule most pairs out before any token array is sent.
    fits = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent
    pairs = homes.join(elected, "shingle").filter("node <> pivot").filter(fits).select("node", "pivot").distinct()
    left = nodes.select("node", F.col("n").alias("n1"), F.col("tokens").alias("t1"))
    right = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("n2"), F.col("tokens").alias("t2"))
    common = F.size(F.array_intersect("t1", "t2"))
    links = pairs.join(left, "node").join(right, "pivot").filter(common * 100 >= (F.col("n1") + F.col("n2") - common) * percent)
    links, links_at = scratch.write(links.select(F.col("node").alias("a"), F.col("pivot").alias("b")), "links")
    joined = components(links, scratch)
    known = nodes.select("node", "n", F.size("tokens").alias("weight")).join(joined, "node", "left").select("node", "n", "weight", F.coalesce("component", "node").alias("component"))
    known, _ = scratch.write(known, "known")

    # Neighbourhoods whose members are not all in one component yet.
    mixed = homes.select("shingle", "node").join(known, "node").groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    regions = homes.select("shingle", "node").join(mixed.select("shingle").join(elected.drop("pivot_n"), "shingle"), "shingle").select(F.col("pivot").cast("string").alias("region"), "node", F.lit(False).alias("stuck")).distinct()
    regions, _ = scratch.write(regions, "regions")
    final = _join_regions(regions, nodes, known, percent, scratch)

    class_of = nodes.select("node", "s1", "s2", "id").join(final.select("node", "component"), "node")
    least, least_at = scratch.write(class_of.groupBy("component").agg(F.min("id").alias("least")), "least")
    class_of, classes_at = scratch.write(class_of.join(least, "component").select("s1", "s2", "least"), "classes")
    linked = close.select("id", "n", "s1", "s2").join(class_of, ["s1", "s2"]).select("id", "n", "least")
    alone = table.filter("tokens is null").select("id", "n", F.col("id").alias("least"))
    nameless = docs.filter("id is null").select("text").mapInArrow(_sizes(shingle), "n int").select(F.lit(None).cast("long").alias("id"), "n", F.lit(None).cast("long").alias("least"))
    out, _ = scratch.write(linked.unionByName(alone).unionByName(nameless), "result")
    scratch.drop(table_at, nodes_at, homes_at, elected_at, links_at, least_at, classes_at)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, all columns: that of the smallest id and, among its rows, of the smallest number; rows without an id or without words,
    which link with nothing, all stay.

    Rows are numbered in the order in which they are read and told apart by their number, since an id may stand for several texts, and a text for rows that differ elsewhere.
    """
    number, key = "__tessera_row", F.col(f"`{id_col}`").cast("long").alias("__tessera_id")
    rows, _ = Scratch(docs.sparkSession, "numbered").write(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    named = rows.filter(key.isNotNull())
    # A row of ids and numbers for each document, in files too small to show it, so the join is asked for: else all of them may pass through the driver.
    found = near_duplicates(named, number, text_col, **options).join(named.select(number, key).hint("merge"), number)
    kept = found.groupBy("component_id").agg(F.min(F.struct("__tessera_id", number)).alias("x")).select(F.col(f"x.{number}").alias("__tessera_kept"))
    one = named.join(kept, F.col(number) == F.col("__tessera_kept"), "left_semi").drop(number)
    return one.unionByName(rows.filter(key.isNull()).drop(number))
