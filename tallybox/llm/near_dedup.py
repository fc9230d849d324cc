"""Near-duplicate groups by MinHash, banding, verification and components.

A document is the set of its distinct runs of ``shingle`` words, as 64-bit hashes.
Documents with equal sets form a class, and its least id stands for it. Many universal
hash functions give each set a signature of minima; the bands of a signature are keys
of buckets. So many bands are taken that a pair at the threshold misses all buckets
with a probability of 1e-10.

In a bucket the member with most company over all bands is the pivot, and all members
join the pivot's group. A group is checked in blocks of bounded size: every member
against the pivot, then members that the pivot did not link against those members of
the block that share one of their rarest shingles: of linked sets one must, so nothing
is lost, and members that are not alike cost nothing. All links are confirmed on the
full sets. In a group of several blocks a member that the pivot did not link is sent to
those other blocks where one of its rarest shingles is also one of a member's rarest,
by counts over the whole group. So each pair of documents that share a bucket either is
compared, or ruled out by its rarest shingles, or lies in one component already.
Components come from alternating large-star and small-star.

Texts are read whole. A text with fewer words than a shingle is one shingle. Null
texts and texts without words have no shingles and link to nothing. Rows that share an
id are one node, which links to what any of their texts does. A null id links to nothing and stays. An empty table gives an empty
table; other columns are ignored by ``near_groups`` and kept by ``drop_near``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybox.llm.common import WordHash, lean, mix, short_batches, window_hashes, written
from tallybox.llm.components import connected_components
from tallybox.llm.tokens import forget

ROWS, MISS, BLOCK, BROADCAST = 5, 1e-10, 4_000_000, 100_000


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` minima with which a pair at the threshold is missed that rarely."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def shingle_set(text: str | None, n: int, hashes: WordHash) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; A-Z are lower-cased."""
    h = hashes((text or "").encode("utf-8", "surrogatepass").lower().split())
    return np.unique(window_hashes(h, min(n, len(h)))) if len(h) else h


class Signer:
    """Signatures of minima of universal hash functions a*x + b modulo 2**32, a odd."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.tags = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 128):
            np.minimum(out, (x[at : at + 128, None] * self.a + self.b).min(axis=0), out=out)
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """The bucket of each band, as a signed 64-bit integer."""
        part = signature.reshape(self.bands, self.rows).astype(np.uint64)
        key = self.tags.copy()
        for k in range(self.rows):
            key = mix(key + part[:, k])
        return key.view(np.int64)


def _signed(df: DataFrame, shingle: int, signer: Signer) -> DataFrame:
    """(id, text) to (id, n_shingles, k1, k2, keys): k1 and k2 identify the set, null if it is empty."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes = WordHash()
        for b in it:
            n, k1, k2, keys = [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), shingle, hashes)
                n.append(len(s))
                if len(s):
                    two = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    k1.append(int(two[0]))
                    k2.append(int(two[1]))
                    keys.append(signer.keys(signer.signature(s)).tobytes())
                else:
                    k1.append(None)
                    k2.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.binary())], ["id", "n_shingles", "k1", "k2", "keys"])

    return df.mapInArrow(lean(run), f"id {df.schema['id'].dataType.simpleString()}, n_shingles bigint, k1 bigint, k2 bigint, keys binary")


def _buckets(classes: DataFrame, bands: int) -> DataFrame:
    """(rep, keys) to (key, id), a row for each band."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys = np.frombuffer(b"".join(x.as_py() for x in b.column(1)), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), bands)))], ["key", "id"])

    return classes.select("rep", "keys").mapInArrow(lean(run), "key bigint, id bigint")


def prefix_length(n: int, percent: int) -> int:
    """Of the rarest shingles of a set of n, so many that a set linked with it must hold one of them among its own so many."""
    return n - -(-n * percent // 100) + 1


class Block:
    """The sets of a block: one set can be compared with all of them, or with those that share a rare shingle with it."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets], np.int64)
        self.ends = np.cumsum(self.size)
        self.every, self.codes, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.rank = np.empty(len(n), np.int64)
        self.rank[np.lexsort((self.every, n))] = np.arange(len(n))
        self.filed: tuple[np.ndarray, np.ndarray] | None = None
        self.mark = np.zeros(len(self.every), np.int64)

    def _known(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.every, s)
        at = at[at < len(self.every)]
        return at[np.isin(self.every[at], s, assume_unique=True)]

    def _linked(self, s: np.ndarray, both: np.ndarray, size: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (size + len(s) - both)

    def near_all(self, s: np.ndarray) -> np.ndarray:
        """The members linked with the set s, by comparing all."""
        known = self._known(s)
        self.mark[known] = 1
        both = np.add.reduceat(self.mark[self.codes], self.ends - self.size)
        self.mark[known] = 0
        return np.flatnonzero(self._linked(s, both, self.size))

    def near(self, s: np.ndarray) -> np.ndarray:
        """The same, by comparing the members whose rarest shingles meet those of s; shingles out of the block are the rarest."""
        if self.filed is None:
            ranks, owner = [], []
            for k, n in enumerate(self.size.tolist()):
                own = np.sort(self.rank[self.codes[self.ends[k] - n : self.ends[k]]])[: prefix_length(n, self.percent)]
                ranks.append(own)
                owner.append(np.full(len(own), k))
            ranks, owner = np.concatenate(ranks), np.concatenate(owner)
            order = np.argsort(ranks, kind="stable")
            self.filed = ranks[order], owner[order]
        known = self._known(s)
        left = prefix_length(len(s), self.percent) - (len(s) - len(known))
        if left <= 0:
            return np.zeros(0, np.int64)
        ranks, owner = self.filed
        own = np.sort(self.rank[known])[:left]
        spans = zip(np.searchsorted(ranks, own).tolist(), np.searchsorted(ranks, own, side="right").tolist(), strict=True)
        met = np.unique(np.concatenate([owner[a:b] for a, b in spans]))
        n = self.size[met]
        met = met[np.minimum(n, len(s)) * 100 >= self.percent * np.maximum(n, len(s))]
        self.mark[known] = 1
        both = np.array([self.mark[self.codes[self.ends[k] - self.size[k] : self.ends[k]]].sum() for k in met.tolist()], np.int64)
        self.mark[known] = 0
        return met[self._linked(s, both, self.size[met])]


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def block_links(ids: list, sets: list[np.ndarray], guests: Iterator[tuple[object, np.ndarray]], percent: int) -> Iterator[tuple]:
    """Links that connect all linked members of a block, whose first member is the pivot, and its guests."""
    block, root = Block(sets, percent), list(range(len(ids)))
    for x in range(len(ids)):
        if x and _find(root, x) == _find(root, 0):
            continue
        for y in (block.near(sets[x]) if x else block.near_all(sets[x])).tolist():
            a, b = _find(root, x), _find(root, y)
            if a != b:
                root[b] = a
                yield ids[x], ids[y]
    for guest, s in guests:
        met = set()
        for y in block.near(s).tolist():
            if (own := _find(root, y)) not in met:
                met.add(own)
                yield guest, ids[y]


def _checked(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(pivot, block, role, id, text) to links (a, b). role: 0 pivot, 1 member, 2 guest."""

    def groups(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        hashes = WordHash()
        for b in it:
            for pivot, block, role, own, text in zip(*(c for c in b.columns), strict=True):
                yield (pivot.as_py(), block.as_py()), role.as_py(), own.as_py(), shingle_set(text.as_py(), shingle, hashes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, found = pa.from_numpy_dtype(np.int64), []
        for _, own in groupby(groups(it), key=lambda r: r[0]):
            ids, sets, first, seen = [], [], None, set()
            for r in own:
                if r[1] == 2:
                    first = r
                    break
                if not ids or ids[-1] != r[2]:
                    seen.clear()
                if (text := r[3].tobytes()) not in seen:  # an id can have several texts, each of which links it
                    seen.add(text)
                    ids.append(r[2])
                    sets.append(r[3])

            def guests(first=first, own=own) -> Iterator[tuple]:
                if first is not None:
                    yield first[2], first[3]
                    for r in own:
                        yield r[2], r[3]

            found += block_links(ids, sets, guests(), percent)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k in (0, 1)], ["a", "b"])
                found = []
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k in (0, 1)], ["a", "b"])

    dealt = rows.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "role", "id")
    return dealt.select("pivot", "block", "role", "id", "text").mapInArrow(lean(run), "a bigint, b bigint")


def _by_block(it: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple]:
    """Batches sorted by pivot, block and role to ((pivot, block), ids, sets, shingles, totals) of each block."""

    def runs() -> Iterator[tuple]:
        for b in it:
            pivot, block, role = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.flatnonzero((np.diff(pivot) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if y > x:
                    yield (int(pivot[x]), int(block[x])), int(role[x]), b.slice(x, y - x)

    hashes = WordHash()
    for key, own in groupby(runs(), key=lambda r: r[0]):
        ids, sets, shingles, totals = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, role, b in own:
            if role:
                ids += b.column(3).to_pylist()
                sets += [shingle_set(t.as_py(), shingle, hashes) for t in b.column(4)]
            else:
                shingles.append(b.column(5).to_numpy(zero_copy_only=False).astype(np.int64))
                totals.append(b.column(6).to_numpy(zero_copy_only=False).astype(np.int64))
        yield key, ids, sets, np.concatenate(shingles).view(np.uint64), np.concatenate(totals)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "role", "id").select("pivot", "block", "role", "id", "text", "shingle", "total")


def _counted(seats: DataFrame, shingle: int) -> DataFrame:
    """(pivot, block, id, text) to (pivot, block, shingle, n): members of the block that hold it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, block), _, sets, _, _ in _by_block(it, shingle):
            every, n = np.unique(np.concatenate(sets), return_counts=True)
            for at in range(0, len(every), 100_000):
                part = every[at : at + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), pivot)), pa.array(np.full(len(part), block, np.int32)), pa.array(part), pa.array(n[at : at + 100_000])], ["pivot", "block", "shingle", "n"])

    rows = seats.withColumns({"role": F.lit(1), "shingle": F.lit(None).cast("bigint"), "total": F.lit(None).cast("bigint")})
    return _dealt(rows).mapInArrow(lean(run), "pivot bigint, block int, shingle bigint, n bigint")


def _rarest(seats: DataFrame, totals: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(pivot, block, id, shingle): those of each member's rarest shingles that other blocks hold too.

    totals: (pivot, block, shingle, total) for the shingles of a block that other blocks hold;
    of the rest the block's own counts are the group's.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, block), ids, sets, shared, total in _by_block(it, shingle):
            if not sets:
                continue
            every, codes, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            at = np.searchsorted(every, shared)
            n[at] = total
            abroad = np.zeros(len(every), bool)
            abroad[at] = True
            rank = np.empty(len(every), np.int64)
            order = np.lexsort((every, n))
            rank[order] = np.arange(len(every))
            end = 0
            for own, s in zip(ids, sets, strict=True):
                low = np.sort(rank[codes[end : end + len(s)]])[: prefix_length(len(s), percent)]
                end += len(s)
                sent = order[low]
                sent = every[sent[abroad[sent]]].view(np.int64)
                if len(sent):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sent), pivot)), pa.array(np.full(len(sent), block, np.int32)), pa.array(np.full(len(sent), own)), pa.array(sent)], ["pivot", "block", "id", "shingle"])

    none = {"role": F.lit(1), "shingle": F.lit(None).cast("bigint"), "total": F.lit(None).cast("bigint")}
    rows = seats.withColumns(none).unionByName(totals.withColumns({"role": F.lit(0), "id": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string")}))
    return _dealt(rows).mapInArrow(lean(run), "pivot bigint, block int, id bigint, shingle bigint")


def _guests(seats: DataFrame, left: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(pivot, block, id): the blocks that hold a possible partner of a member of another block.

    seats: (pivot, block, id, text) of the groups' members. left: (pivot, id) of those that
    need partners beyond their block. A shingle has at most a row for each block before
    its count is known, so that a frequent one is no hot key.
    """
    counts = written(_counted(seats, shingle), "block-counts")
    group = Window.partitionBy("pivot", "shingle")
    totals = counts.select("pivot", "block", "shingle", F.sum("n").over(group).alias("total"), F.count("*").over(group).alias("blocks")).where("blocks > 1").drop("blocks")
    rarest = written(_rarest(seats, totals, shingle, percent), "rarest")
    hosts = rarest.select("pivot", "shingle", F.col("block").alias("to")).distinct()
    sent = rarest.join(left, ["pivot", "id"]).join(hosts, ["pivot", "shingle"]).where("to <> block")
    return sent.select("pivot", F.col("to").alias("block"), "id").distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row: id, n_shingles, component_id, kept; see the module. The id is an integer.

    percent: pairs link if 100 * intersection >= percent * union. block: shingles that a
    task holds of a group, about; larger groups are checked in several blocks.
    """
    short_batches(df.sparkSession)
    signer = Signer(bands or bands_for(percent, rows), rows)
    if df.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must hold integers")
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = written(_signed(docs, shingle, signer), "signatures")
    known = signed.where("k1 IS NOT NULL AND id IS NOT NULL")
    first = known.groupBy("k1", "k2").agg(F.min(F.struct("id", "n_shingles", "keys")).alias("first"))
    classes = written(first.select("k1", "k2", F.col("first.id").alias("rep"), F.col("first.n_shingles").alias("n_shingles"), F.col("first.keys").alias("keys")), "classes")

    filed = _buckets(classes, signer.bands)
    shared = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(filed.join(shared.hint("merge"), "key"), "buckets")
    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    pivots = members.join(company, "id").groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("least"))).alias("best")).select("key", (-F.col("best.least")).alias("pivot"))
    joined = written(members.join(pivots, "key").where("id <> pivot").select("pivot", "id").distinct(), "groups")
    heavy = joined.join(classes.select(F.col("rep").alias("id"), "n_shingles"), "id").groupBy("pivot").agg(F.sum("n_shingles").alias("n")).select("pivot", F.ceil(F.col("n") / block).cast("int").alias("blocks")).where("blocks > 1")
    heavy = written(heavy, "heavy-groups")
    n_heavy = heavy.count()
    split = joined.join(F.broadcast(heavy) if n_heavy <= BROADCAST else heavy, "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = written(split.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "blocks")

    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = split.select("pivot", "block", F.lit(1).alias("role"), "id")
    lead = split.select("pivot", "blocks").distinct().select("pivot", each.alias("block"), F.lit(0).alias("role"), F.col("pivot").alias("id"))
    seats = own.unionByName(lead)

    def with_text(seats: DataFrame) -> DataFrame:
        return docs.join(seats.hint("merge"), "id")

    texts = known.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high")).where("low <> high").select("id")
    own = known.join(texts, "id", "left_semi").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = written(_checked(with_text(seats), shingle, percent).unionByName(own), "links")
    roots = connected_components(links)
    if n_heavy:
        many = split.where("blocks > 1")
        root_of = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
        left = many.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").join(root_of, "pivot", "left")
        left = written(left.where(F.coalesce("root", "id") != F.coalesce("pivot_root", "pivot")).select("pivot", "id"), "left")
        open_groups = many.join(left.select("pivot").distinct(), "pivot", "left_semi").select("pivot", "block", "id")
        guests = written(_guests(with_text(open_groups), left, shingle, percent), "guests")
        hosts = seats.join(guests.select("pivot", "block").distinct(), ["pivot", "block"], "left_semi")
        links = links.unionByName(written(_checked(with_text(hosts.unionByName(guests.withColumn("role", F.lit(2)))), shingle, percent), "links"))
        roots = connected_components(links)

    reps = classes.select("k1", "k2", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("root", "rep").alias("component"))
    found = signed.select("id", "n_shingles", "k1", "k2").join(reps, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that stay, one document of each group, with all its columns."""
    gone = near_groups(df, id_col, text_col, **how).where(~F.col("kept")).select(F.col(id_col).alias("gone_id")).distinct()
    return df.join(gone.hint("merge"), df[id_col] == gone["gone_id"], "left_anti")


def brute_groups(docs: list[tuple[int, str | None]], shingle: int, percent: int) -> dict[int, tuple[int, int]]:
    """id to (n_shingles, component) by comparing all pairs of sets of words, for tests."""
    sets: dict[int, set] = {}
    for i, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}
