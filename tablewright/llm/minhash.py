"""MinHash near-dedup with sequential Bayesian verification.

Documents are linked if the Jaccard similarity of their sets of word shingles reaches a least value.
Documents with one set are a class, linked without further work; a row of the class stands for it. Its
signature holds BANDS * ROWS min-hashes. Classes that agree in all rows of a band share a slot and are
candidates. A candidate pair is compared batch by batch of its signatures: after each batch
the similarity, uniform before, has a posterior (a beta distribution), and the pair is given up as soon
as the least value is reached with a probability below what the batch may miss. Survivors are verified
on the full sets, and only verified pairs are links.

No slot is paired out. First each member of a slot meets the slot's least member only. Then, in rounds,
slots whose members are not all connected yet are dealt into parts, and a part proposes, among the
survivors between unconnected members, no more pairs than would connect it. When a round connects
hardly any more, the members outside of a slot's largest group meet all members of their slot, a block of
each at a time; what survives is verified there, and no more links come out than connect groups.

With a radius given, classes whose SimHash fingerprints are that close are verified before all this; what they
connect needs no pairs of signatures any more.

A pair at the least similarity shares no slot once in 300,000 times (0.8, BANDS, ROWS), or less above it; a
batch gives it up with a probability of at most `miss` over all batches.

A text is read whole; its task holds some 100 bytes for each of its words.

Defined results: a null or empty text, or one without words, has the empty set, which is linked with
nothing; a null id is never a component's id unless all ids of the component are null, and such a row is
kept; repeated rows are of one class; an empty table gives an empty result. Shingles are known by
64-bit hashes, sets by 128-bit digests of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import connected
from tablewright.llm.simhash import fingerprint_links, fingerprints
from tablewright.llm.stages import release, releasing, settle
from tablewright.llm.text import whole_row
from tablewright.operators.joins import apart

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 20  # min-hashes that are compared at once
PART = 256  # members of a slot that propose pairs among themselves
GAIN = 50  # rounds go on while they link more than one in so many of the open members
QUERIES = 1 << 10  # members of a slot that all others are compared with in one task
HELD = 1 << 20  # their shingles, but for one larger set
STREAM = 1 << 14  # members that pass by them in one task
SEED = 42
_RNG = np.random.default_rng(11)
_FACTOR = _RNG.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_OFFSET = _RNG.integers(0, 1 << 32, HASHES, np.uint32)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of all `width`-word shingles; a shorter text is one shingle."""
    words = text.lower().split()  # on bytes both are ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]).tolist()
    spans = zip(starts, ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts))
    return np.unique(hashes)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        block = low[at : at + 256, None] * _FACTOR
        block += _OFFSET
        np.minimum(least, block.min(axis=0), out=least)
    return least


def _sketches(text: Column, width: int) -> Column:
    """(n, hi, lo, signature) of each text: its set's size, the set's digest, and the signature."""

    @F.arrow_udf("struct<n:long,hi:long,lo:long,signature:binary>")
    def of(texts: pa.Array) -> pa.Array:
        n, digests, signatures = [], [], []
        for t in texts:
            shingles = shingle_set(t.as_py() or b"", width)
            n.append(len(shingles))
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            signatures.append(signature(shingles).tobytes())
        release()
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        columns = [pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(signatures, pa.binary())]
        return pa.StructArray.from_arrays(columns, names=["n", "hi", "lo", "signature"])

    return of(text)


def needed_matches(least: float, miss: float) -> list[int]:
    """For each batch, the matches so far below which a pair is given up.

    With m of n matches and a uniform prior, the similarity reaches `least` with the probability that a
    binomial variable of n + 1 trials at `least` is at most m.
    """
    out, each = [], miss * BATCH / HASHES
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * least**m * (1 - least) ** (n + 1 - m)
            if total >= each:
                break
            m += 1
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, needed: list[int]) -> np.ndarray:
    """Indexes of the pairs of signatures a[i], b[i] that no batch gives up."""
    open_, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(needed):
        batch = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[open_, batch] == b[open_, batch]).sum(axis=1)
        stay = matches >= least
        open_, matches = open_[stay], matches[stay]
        if not len(open_):
            break
    return open_


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _likely(pairs: DataFrame, classes: DataFrame, least: float, needed: list[int]) -> DataFrame:
    """The pairs (a, b) of classes that sizes and signatures leave open."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stay = survivors(_signatures(batch.column(2)), _signatures(batch.column(3)), needed)
                yield batch.select(["a", "b"]).take(pa.array(stay))

    side = classes.select("c", "n", "signature")
    both = pairs.join(side.toDF("a", "n_a", "s_a"), "a").join(side.toDF("b", "n_b", "s_b"), "b")
    similar = both.where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9)
    return similar.select("a", "b", "s_a", "s_b").mapInArrow(chosen, "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs whose full sets reach the least similarity."""
    per_mille = round(least * 1000)

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, held = [], None, None
        for x, y in zip(a, b, strict=True):
            x = x.as_py() or b""
            if x != last:  # one class often stands in many pairs
                last, held = x, shingle_set(x, width)
            other = shingle_set(y.as_py() or b"", width)
            common = len(np.intersect1d(held, other, assume_unique=True))
            out.append(1000 * common >= per_mille * (len(held) + len(other) - common))
        return pa.array(out, pa.bool_())

    bodies = rows.select("row", "body")
    both = pairs.join(bodies.toDF("a", "x"), "a").join(bodies.toDF("b", "y"), "b")
    return both.where(similar("x", "y")).select("a", "b")


class _Groups:
    """Numbers that grow together by pairs."""

    def __init__(self, of: np.ndarray):
        self.of = of.copy()

    def join(self, a: int, b: int) -> bool:
        x, y = self.of[a], self.of[b]
        if x == y:
            return False
        self.of[self.of == y] = x
        return True


def _proposals(least: float, needed: list[int]):
    """For a partition sorted by slot and part: pairs between unconnected members that would connect a part."""

    def of_part(c: np.ndarray, root: np.ndarray, n: np.ndarray, signatures: np.ndarray) -> list[tuple[int, int]]:
        i, j = np.triu_indices(len(c), 1)
        small, big = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        fits = (root[i] != root[j]) & (small >= least * big - 1e-9)
        i, j = i[fits], j[fits]
        stay = survivors_at(signatures, i, j, needed)
        groups, out = _Groups(root), []
        for x, y in zip(i[stay].tolist(), j[stay].tolist(), strict=True):
            if groups.join(x, y):
                out.append((min(c[x], c[y]), max(c[x], c[y])))
        return out

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def parts(table: pa.Table, last: bool) -> tuple[list[tuple[int, int]], pa.Table]:
            slot, part = (table[k].to_numpy() for k in ("slot", "part"))
            cuts = np.flatnonzero((slot[1:] != slot[:-1]) | (part[1:] != part[:-1])) + 1
            cuts = [0, *cuts.tolist(), *([len(slot)] if last else [])]
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    t = table.slice(a, b - a)
                    columns = (t[k].to_numpy() for k in ("c", "root", "n"))
                    out += of_part(*columns, _signatures(t["signature"].combine_chunks()))
            return out, table.slice(cuts[-1])

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            ab = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            out, held = parts(held, False)
            yield batch_of(out)
        if held is not None and held.num_rows:
            yield batch_of(parts(held, True)[0])

    return proposed


def survivors_at(signatures: np.ndarray, i: np.ndarray, j: np.ndarray, needed: list[int]) -> np.ndarray:
    """As `survivors`, of the pairs (i, j) of rows, without copying whole signatures."""
    open_, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, least in enumerate(needed):
        part = signatures[:, k * BATCH : (k + 1) * BATCH]
        matches = matches + (part[i[open_]] == part[j[open_]]).sum(axis=1)
        stay = matches >= least
        open_, matches = open_[stay], matches[stay]
        if not len(open_):
            break
    return open_


class _Queries:
    """The members of a slot that others are compared with, in one task."""

    def __init__(self, key: tuple, band: int):
        self.key, self.band = key, band
        self.c, self.root, self.n = (np.zeros(0, np.int64) for _ in range(3))
        self.signatures = np.zeros((0, HASHES), np.uint32)
        self.sets: list[np.ndarray] = []
        self.parent: dict[int, int] = {}  # groups that verified links have joined here

    def add(self, c, root, n, signatures, sets) -> None:
        self.c, self.root = np.append(self.c, c), np.append(self.root, root)
        self.n, self.sets = np.append(self.n, n), self.sets + sets
        self.signatures = np.concatenate((self.signatures, signatures))

    def group(self, root: int) -> int:
        while root in self.parent:
            root = self.parent[root]
        return root

    def surviving(self, root, n, signatures, least: float, needed: list[int]):
        """(query, member) indexes that may be links, for which this slot is the first that they share."""
        i, j = (x.reshape(-1) for x in np.indices((len(self.c), len(n))))
        small, big = np.minimum(self.n[i], n[j]), np.maximum(self.n[i], n[j])
        fits = (self.root[i] != root[j]) & (small >= least * big - 1e-9)
        i, j = i[fits], j[fits]
        both = np.concatenate((self.signatures, signatures))
        stay = survivors_at(both, i, j + len(self.c), needed)
        i, j = i[stay], j[stay]
        earlier = np.zeros(len(i), bool)
        for k in range(self.band):
            columns = slice(k * ROWS, (k + 1) * ROWS)
            earlier |= (self.signatures[i, columns] == signatures[j, columns]).all(axis=1)
        return i[~earlier], j[~earlier]

    def links(self, at: np.ndarray, c: int, root: int, body: bytes, width: int, per_mille: int):
        """Verified links of a member with the queries `at`, one per group that is not linked yet."""
        at = np.array([i for i in at.tolist() if self.group(int(self.root[i])) != self.group(root)], np.int64)
        if not len(at):
            return
        own = shingle_set(body, width)
        sets = [self.sets[i] for i in at]
        sizes = np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        place = np.minimum(np.searchsorted(own, values), len(own) - 1)
        common = np.add.reduceat(own[place] == values, np.cumsum(sizes) - sizes, dtype=np.int64)
        for i in at[1000 * common >= per_mille * (sizes + len(own) - common)].tolist():
            x, y = self.group(int(self.root[i])), self.group(root)
            if x != y:
                self.parent[x] = y
                yield min(c, int(self.c[i])), max(c, int(self.c[i]))


def _crossings(least: float, needed: list[int], width: int | None = None):
    """For a partition sorted by slot, part and block, the block's queries in front: which rows have a partner
    that survives, or, with their bodies, the verified links."""
    per_mille = round(least * 1000)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: _Queries | None = None
        hits: set[int] = set()

        def asked() -> pa.RecordBatch:
            """The queries of the tile that is done which had a partner."""
            return named(queries.key, True, queries.c[sorted(hits)])

        def named(key: tuple, query: bool, c: np.ndarray) -> pa.RecordBatch:
            n = len(c)
            fixed = [pa.array(np.full(n, v), t) for v, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            return pa.RecordBatch.from_arrays(
                [*fixed, pa.array(np.full(n, query)), pa.array(c, pa.int64())], names=["slot", "part", "block", "query", "c"]
            )

        for batch in batches:
            slot, part, block, query = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            new = (slot[1:] != slot[:-1]) | (part[1:] != part[:-1]) | (block[1:] != block[:-1])
            cuts = [0, *(np.flatnonzero(new | (query[1:] != query[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                here, key = batch.slice(a, b - a), (slot[a], part[a], block[a])
                if queries is None or queries.key != key:
                    if hits:
                        yield asked()
                    queries, hits = _Queries(key, here.column(4)[0].as_py()), set()
                c, root, n = (here.column(k).to_numpy() for k in (5, 6, 7))
                signatures = _signatures(here.column(8))
                bodies = here.column(9) if width else None
                if query[a]:
                    sets = [shingle_set(t.as_py(), width) for t in bodies] if width else []
                    queries.add(c, root, n, signatures, sets)
                    continue
                for at in range(0, len(c) if len(queries.c) else 0, 512):
                    some = slice(at, at + 512)
                    i, j = queries.surviving(root[some], n[some], signatures[some], least, needed)
                    if not len(i):
                        continue
                    if not width:
                        hits.update(np.unique(i).tolist())
                        yield named(key, False, c[some][np.unique(j)])
                        continue
                    order = np.argsort(j, kind="stable")
                    i, j = i[order], j[order]
                    links = []
                    starts = np.flatnonzero(np.concatenate(([True], j[1:] != j[:-1])))
                    for first, end in zip(starts, np.append(starts[1:], len(j)), strict=True):
                        m = at + int(j[first])
                        body = bodies[m].as_py()
                        links += queries.links(i[first:end], int(c[m]), int(root[m]), body, width, per_mille)
                    ab = np.array(links, np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])
        if hits:
            yield asked()

    return crossed


def _slots() -> Column:
    width = 4 * ROWS
    return F.array(*[
        F.xxhash64(F.lit(k), F.substring("signature", k * width + 1, width)) for k in range(BANDS)
    ])


def _shared_slots(classes: DataFrame) -> DataFrame:
    """(slot, c, band, size, hub) of all slots with several members. Of slots with the same members the one
    of the first band is left, so every candidate pair keeps the first slot that it shares."""
    members = classes.select("c", F.posexplode(_slots()).alias("band", "slot"))
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "c")).alias(f"m{k}") for k in range(2)]
    crowds = members.groupBy("slot", "band").agg(
        F.count(F.lit(1)).alias("size"), F.min("c").alias("hub"), F.max("c").alias("last"), *mark
    )
    lists = crowds.where("size > 1").groupBy("size", "hub", "last", "m0", "m1").agg(F.min("band").alias("band"))
    kept = crowds.join(lists, ["size", "hub", "last", "m0", "m1", "band"]).select("slot", "band", "size", "hub")
    return settle(members.join(apart(kept, F.col("slot")), ["slot", "band"]), "slots")


def _open_members(slots: DataFrame, roots: DataFrame) -> DataFrame:
    """(slot, band, c, size, root) of the slots whose members are in several groups."""
    placed = slots.join(roots.toDF("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    ends = placed.groupBy("slot").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    open_ = ends.where("least <> most").select("slot")
    return placed.join(apart(open_, F.col("slot")), "slot")


def fingerprint_pairs(rows: DataFrame, classes: DataFrame, width: int, least: float, radius: int) -> DataFrame:
    """(a, b): verified links between classes that bit-sliced comparison of their fingerprints proposes."""
    heads = rows.join(classes.select(F.col("c").alias("row")), "row")
    known = settle(heads.select(F.col("row").alias("c"), fingerprints(F.col("body"), width).alias("fp")), "fingerprints")
    hubs = known.groupBy("fp").agg(F.min("c").alias("hub"))
    same = known.join(apart(hubs, F.col("fp")), "fp").where("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b"))
    close = fingerprint_links(hubs.select("fp"), radius).distinct()
    close = close.join(hubs.toDF("a", "x"), "a").join(hubs.toDF("b", "y"), "b")
    close = close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return settle(_verified(settle(same.unionByName(close).distinct(), "close"), rows, width, least), "links")


def similar_links(
    rows: DataFrame, classes: DataFrame, width: int, least: float, miss: float, given: DataFrame | None = None
) -> DataFrame:
    """(a, b): verified links between classes, the `given` ones among them; they connect what all links at
    `least` or more connect."""
    needed = needed_matches(least, miss)
    slots = _shared_slots(classes)
    spark = rows.sparkSession

    def confirm(pairs: DataFrame) -> DataFrame:
        return settle(_verified(pairs, rows, width, least), "links")

    hubs = slots.where("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct()
    links = confirm(_likely(hubs, classes, least, needed))
    links = links if given is None else links.unionByName(given)
    large = slots.where("size > 2").drop("hub")  # a slot of two has met its hub
    sides = classes.select("c", "n", "signature")
    tried = hubs
    turn, gained = 0, not large.isEmpty()
    while gained:
        turn += 1
        open_ = settle(_open_members(large, connected(links)), "open")
        part = F.pmod(F.xxhash64("c", F.lit(turn)), F.ceil(F.col("size") / PART))
        dealt = open_.withColumn("part", part).join(sides, "c").select("slot", "part", "c", "root", "n", "signature")
        pairs = (
            dealt.repartition("slot", "part")
            .sortWithinPartitions("slot", "part", "c")
            .mapInArrow(releasing(_proposals(least, needed)), "a long, b long")
            .distinct()
        )
        pairs = settle(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = confirm(pairs)
        gained = more.count() * GAIN > open_.count()
        links, tried = links.unionByName(more), tried.unionByName(pairs)
    if turn:
        open_ = settle(_open_members(large, connected(links)), "open")
        links = links.unionByName(_remaining(open_, rows, sides, width, least, needed))
    return links


def _remaining(open_, rows, sides, width: int, least: float, needed: list[int]) -> DataFrame:
    """Verified links between all members of a slot that are not in one group.

    The members outside of a slot's largest group are its queries. They are dealt into parts and copied
    to each block of members, and the members to each part; a task holds the queries' sets, at most `PART`
    of them or `HELD` shingles, and the members pass by. Texts are only sent where signatures survive.
    """
    held = open_.join(sides, "c")
    sizes = held.groupBy("slot", "root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    main = sizes.groupBy("slot").agg(
        F.max_by("root", "members").alias("main"),
        F.sum("members").alias("all"),
        F.max("members").alias("most"),
        F.sum("shingles").alias("shingles"),
    )
    columns = ["slot", "part", "block", "query", "band", "c", "root", "n", "signature"]
    placed = settle(
        held.join(apart(main, F.col("slot")), "slot").select(
            "slot", "band", "c", "root", "n", "signature",
            (F.col("root") != F.col("main")).alias("query"),
            F.ceil(F.greatest((F.col("all") - F.col("most")) / QUERIES, F.col("shingles") / HELD)).cast("int").alias("parts"),
            F.ceil(F.col("all") / STREAM).cast("int").alias("blocks"),
        ),
        "placed",
    )
    mix = F.xxhash64("c", F.lit("remaining"))
    queries = (
        placed.where("query")
        .withColumn("part", F.pmod(mix, F.col("parts")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    others = (
        placed.withColumn("query", F.lit(False))
        .withColumn("block", F.pmod(mix, F.col("blocks")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    tiles = queries.select(columns).unionByName(others.select(columns))

    def dealt(tiles: DataFrame) -> DataFrame:
        place = ["slot", "part", "block"]
        return tiles.repartition(*place).sortWithinPartitions(*place, F.desc("query"), "c")

    asked = dealt(tiles).mapInArrow(
        releasing(_crossings(least, needed)), "slot long, part int, block int, query boolean, c long"
    )
    asked = settle(asked, "asked")
    bodies = rows.select(F.col("row").alias("c"), "body")
    whole = asked.join(placed.select("slot", "band", "c", "root", "n", "signature"), ["slot", "c"]).join(bodies, "c")
    links = dealt(whole.select(*columns, "body")).mapInArrow(releasing(_crossings(least, needed, width)), "a long, b long")
    return settle(links.distinct(), "links")


def _grouped(docs: DataFrame, doc_id: str, text: str, width: int, least: float, miss: float, radius: int | None, whole: bool):
    """The written rows, with all columns of `docs` if `whole`, and the groups as `near_duplicates` gives them."""
    given = [F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")]
    if whole:
        given.append(whole_row(docs).alias("whole"))
    rows = settle(
        docs.select(given)
        .withColumn("sketch", _sketches(F.col("body"), width))
        .select("*", "sketch.*", F.monotonically_increasing_id().alias("row"))
        .drop("sketch"),
        "rows",
    )
    known = rows.where("n > 0").groupBy("hi", "lo").agg(F.min("row").alias("c"), F.min("doc_id").alias("least_id"))
    known = settle(known, "known")
    heads = known.select(F.col("c").alias("row"))
    classes = rows.select("row", "n", "signature").join(heads, "row").withColumnRenamed("row", "c")
    classes = settle(classes, "classes")
    given = None if radius is None else fingerprint_pairs(rows, classes, width, least, radius)
    roots = connected(similar_links(rows, classes, width, least, miss, given)).toDF("c", "root")
    placed = known.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    ids = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    placed = settle(placed.join(ids, "root").select("hi", "lo", "root", "component_id"), "placed")
    alone = F.col("n") == 0
    groups = (
        rows.select("doc_id", "n", "hi", "lo", "row")
        .join(placed, ["hi", "lo"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.when(alone, F.col("row")).otherwise(F.col("root")).alias("root"),
            "row",
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
    return rows, groups


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 4,
    least: float = 0.8,
    miss: float = 1e-6,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable) and kept, and what
    tells rows of one id apart: root (of the component) and row."""
    return _grouped(docs, doc_id, text, width, least, miss, None, whole=False)[1]


def drop_near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    least: float = 0.8,
    miss: float = 1e-6,
    radius: int | None = None,
) -> DataFrame:
    """One document of each component, one with its least doc_id, all columns unchanged."""
    rows, groups = _grouped(docs, doc_id, text, width, least, miss, radius, whole=True)
    heads = groups.where("kept").groupBy("root").agg(F.min("row").alias("row")).select("row")
    return rows.select("row", "whole").join(heads, "row", "left_semi").select("whole.*")
