"""MinHash near-dedup with DartMinHash signatures.

A text is the multiset of its runs of five words (a shorter text: the run of all its words);
similarity is the weighted Jaccard index of these multisets. A signature is made by
throwing darts: a shingle of weight w owns strips of unit weight (the last one w's fraction),
and on each strip hashed darts land as a Poisson process along the rank axis, the same
for every text that owns the strip. Darts of rank up to t / (total weight), t = k ln k + 2k,
are thrown, about t whatever the text's length; each goes to one of k coordinates, and a
coordinate keeps the earliest. If a coordinate stays empty, twice as many are thrown. Two
signatures agree at a coordinate with the probability of the similarity.

Links: equal texts collapse to their least doc_id first. Signatures are cut into bands; in each
band's bucket the most central member, the one with most bucket mates over all bands, meets every
other member. A document's pairs with its leaders are verified exactly on the whole texts, the
best first; pairs whose ends are already in one class need no verification.

Buckets that then still hold several classes are gone through whole: every pair of a bucket whose ends are in different
classes is compared exactly, so no two documents that share a bucket lack their link. The documents outside a bucket's largest class meet all
of its members, block by block, in tasks of two blocks each; a task counts what two texts share by
an index of its block's shingles, so no row stands for a pair and no bucket is collected or joined with itself. Buckets of the same
documents are gone through once. What is left to chance is only whether a link's ends share one of the buckets at all (at 0.8
with 24 bands of 5: all but 7 in 100,000). Texts travel compressed, and only those in some bucket.

Defined results: a text without words (null, empty, blank) has no shingles and is a class of
its own. A null doc_id has the class null and is never a duplicate. Rows with one doc_id
are one document, linked wherever one of their texts, however many, is. Empty tables give empty
tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Hashes, encode, materialize, mix, pieces, windows

SHINGLE = 5
#: Documents and bytes of text of a block, about; a bucket of more is several blocks.
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
_GOLD = 0x9E3779B97F4A7C15


def shingles(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text's word hashes, ascending, and how often each occurs."""
    return np.unique(windows(words, min(size, max(1, len(words)))), return_counts=True, sorted=True)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k coordinates, each the id of the earliest dart that fell on it. Weights may be fractions."""
    strips = np.ceil(weights).astype(np.int64)
    which = np.repeat(np.arange(len(elements)), strips)
    level = np.arange(len(which)) - np.repeat(np.cumsum(strips) - strips, strips)
    room = weights[which] - level  # 1 or more: a whole strip
    key = mix(elements[which] + level.astype(np.uint64) * np.uint64(_GOLD) + np.uint64(seed))
    most = (k * np.log(k) + 2 * k) / float(weights.sum())
    while True:
        alive, rank, n = key, np.zeros(len(key)), 0
        space = room
        ranks, ids = [], []
        while len(alive):
            n += 1
            dart = mix(alive + np.uint64(n * _GOLD % 2**64))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
            near = rank <= most
            alive, rank, dart, space = alive[near], rank[near], dart[near], space[near]
            ident = mix(dart)
            if len(space) and space.min() < 1:
                inside = (mix(ident) >> np.uint64(11)).astype(np.float64) / 2.0**53 < space
                ranks.append(rank[inside])
                ids.append(ident[inside])
            else:
                ranks.append(rank)
                ids.append(ident)
        ident, order = np.concatenate(ids), np.argsort(np.concatenate(ranks), kind="stable")[::-1]
        at = (ident % np.uint64(k)).astype(np.int64)
        first = np.full(k, -1, np.int64)
        first[at[order]] = order  # the earliest is written last
        if first.min() >= 0:
            return ident[first]
        most *= 2


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    out = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLD))
    for j in range(rows.shape[1]):
        out = mix(out * np.uint64(3) + rows[:, j])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard index of two multisets of shingles."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0]
    shared = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


SIGNED = "doc_id long, print binary, bands array<long>, size long, blob binary"


def sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """SIGNED: of each document with words a print of them, its band keys, the bytes of its words, these compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pack = Hashes(), zstandard.ZstdCompressor(level=3)
        for held in pieces(batches, "text"):
            part = pa.Table.from_batches(held)
            out: list[tuple] = []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                words = encode(text).split()
                if doc_id is not None and words:
                    raw = b" ".join(words)
                    found, count = shingles(hashes.of(words))
                    signature = dart_minhash(found, count.astype(np.float64), bands * rows)
                    out.append((doc_id, xxhash.xxh3_128_digest(raw), band_keys(signature, bands), len(raw), pack.compress(raw)))
            if out:
                ids, prints, keys, sizes, blobs = zip(*out, strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * bands, pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), lists, pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "print", "bands", "size", "blob"])

    return docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text")).mapInArrow(run, SIGNED)


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = Hashes(), zstandard.ZstdDecompressor()
        last, other = b"", None
        for batch in batches:
            alike = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                y = y.as_py()
                if y != last:  # rows come in b's order
                    last, other = y, shingles(hashes.of(unpack.decompress(y).split()))
                alike.append(similarity(shingles(hashes.of(unpack.decompress(x.as_py()).split())), other) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    left = texts.select(F.col("doc_id").alias("a"), F.col("blob").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("blob").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


Bag = tuple[np.ndarray, np.ndarray]


def cross_links(ids: list[int], classes: list[int], bags: list[Bag], members: list[int], outer: list[int], main: int, least: float) -> Iterator[tuple[int, int]]:
    """Links of ``outer`` to ``members`` (places in the lists) of other classes, but those that others already imply.

    All such pairs are compared; two documents outside the class ``main`` only if the member's id is the greater.
    """
    of = np.repeat(np.arange(len(members)), [len(bags[m][0]) for m in members])
    shingle, count = np.concatenate([bags[m][0] for m in members]), np.concatenate([bags[m][1] for m in members])
    order = np.argsort(shingle, kind="stable")
    of, shingle, count = of[order], shingle[order], count[order]
    total = np.array([bags[m][1].sum() for m in members])
    id_, class_ = np.array([ids[m] for m in members]), np.array([classes[m] for m in members])
    joined: dict[int, int] = {}

    def now(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    for x in outer:
        own, n = bags[x]
        low = np.searchsorted(shingle, own)
        found = np.searchsorted(shingle, own, "right") - low
        at = np.arange(int(found.sum())) + np.repeat(low - (np.cumsum(found) - found), found)
        shared = np.bincount(of[at], np.minimum(count[at], np.repeat(n, found)), len(members))
        alike = (shared / (total + n.sum() - shared) >= least) & (class_ != classes[x]) & ((class_ == main) | (id_ > ids[x]))
        for y in np.flatnonzero(alike).tolist():
            a, b = now(classes[x]), now(int(class_[y]))
            if a != b:
                joined[a] = b
                yield ids[x], int(id_[y])


def _blocks(n: str, size: str) -> Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK_DOCS, F.col(size) / BLOCK_BYTES)).cast("int")


def cross_classes(buckets: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between documents of one bucket and of different classes. buckets: band, doc_id, class, distinct.

    All pairs of a bucket that holds several classes are compared, except those within its largest class.
    Buckets of two documents are left out: these have met.
    """
    sized = buckets.join(texts.groupBy("doc_id").agg(F.sum("size").alias("size")), "doc_id")
    prints = [F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"print_{i}") for i in range(2)]
    by_class = sized.groupBy("band", "class").agg(F.count("*").alias("n"), F.sum("size").alias("size"), *prints)
    every = [F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("classes"), F.max(F.struct("n", "class", "size")).alias("main")]
    several = by_class.groupBy("band").agg(*every, *[F.bit_xor(f"print_{i}").alias(f"print_{i}") for i in range(2)]).where("classes > 1 and n > 2")
    outside = several.withColumn("n_out", F.col("n") - F.col("main.n")).withColumn("size_out", F.col("size") - F.col("main.size"))
    plan = F.struct("band", F.col("main.class").alias("main"), _blocks("n", "size").alias("blocks"), _blocks("n_out", "size_out").alias("outer_blocks"))
    once = outside.groupBy("print_0", "print_1", "n").agg(F.min(plan).alias("plan")).select("plan.*")

    placed = buckets.join(once, "band").withColumn("out", F.col("class") != F.col("main"))
    placed = placed.withColumn("i", F.expr("int(pmod(xxhash64(doc_id), outer_blocks))")).withColumn("j", F.expr("int(pmod(xxhash64(doc_id), blocks))"))
    # as a member to its block's meeting with each outer block; one outside the largest class as such to all other meetings of its outer block
    meets = """transform(sequence(0, outer_blocks - 1), k -> struct(k as i, j as j, true as member, out and k = i as outer))"""
    as_outer = """transform(filter(sequence(0, blocks - 1), k -> out and k <> j), k -> struct(i as i, k as j, false as member, true as outer))"""
    rows = placed.select("band", "doc_id", "class", "main", F.explode(F.concat(F.expr(meets), F.expr(as_outer))).alias("at"))
    rows = rows.select("band", "doc_id", "class", "main", "at.*").join(texts.select("doc_id", "blob"), "doc_id")
    task = ["band", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = Hashes(), zstandard.ZstdDecompressor()
        key, held = None, []

        def links() -> pa.RecordBatch:
            ids, classes, mains, member, outer, blobs = zip(*held, strict=True)
            found: list[tuple[int, int]] = []
            if any(member) and any(outer):
                bags = [shingles(hashes.of(unpack.decompress(b).split())) for b in blobs]
                found += cross_links(ids, classes, bags, [k for k, m in enumerate(member) if m], [k for k, o in enumerate(outer) if o], mains[0], least)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], ["a", "b"])

        for batch in batches:  # rows come task by task
            for *now, doc_id, class_, main, member, outer, blob in zip(*[batch[c].to_pylist() for c in [*task, "doc_id", "class", "main", "member", "outer", "blob"]], strict=True):
                if now != key and held:
                    yield links()
                    held.clear()
                key = now
                held.append((doc_id, class_, main, member, outer, blob))
        if held:
            yield links()

    return rows.repartition(*task).sortWithinPartitions(*task, "doc_id").mapInArrow(run, "a long, b long")


def _merge(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels after some more edges. Only classes that an edge joins are gone through."""
    if labels is None:
        return connected_components(edges)
    of_a, of_b = (labels.select(F.col("id").alias(c), F.col("label").alias(f"class_{c}")) for c in "ab")
    linked = edges.join(of_a, "a", "left").join(of_b, "b", "left")
    linked = linked.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b"))
    moved = connected_components(linked).select(F.col("id").alias("was"), F.col("label").alias("now"))
    known = labels.unionByName(moved.join(labels, F.col("was") == F.col("id"), "left_anti").select(F.col("was").alias("id"), F.col("was").alias("label")))
    return materialize(known.join(moved, F.col("label") == F.col("was"), "left").select("id", F.coalesce("now", "label").alias("label")), "classes")


def _with_rep(signed: DataFrame) -> DataFrame:
    """(doc_id, print, rep): the least doc_id with the same words.

    Prints that a thousandth of all rows or more have are at most a thousand: these are broadcast, so no
    task gets a hot one's rows.
    """
    copies = materialize(signed.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * 1000 >= total
    rows = signed.select("doc_id", "print").join(F.broadcast(copies.where(hot).select("print", F.col("rep").alias("hot_rep"))), "print", "left")
    return rows.where("hot_rep is not null").select("doc_id", "print", F.col("hot_rep").alias("rep")).unionByName(
        rows.where("hot_rep is null").select("doc_id", "print").join(copies.where(~hot).select("print", "rep"), "print")
    )


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = 24, rows: int = 5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, the least doc_id of its class."""
    signed = materialize(sign(docs, bands, rows), "signed")
    members = materialize(_with_rep(signed).distinct(), "members")
    leads = members.where("doc_id = rep").select("doc_id", "print").distinct()

    keys = signed.join(leads, ["doc_id", "print"], "left_semi").select("doc_id", F.explode("bands").alias("band"))
    keys = materialize(keys, "keys")
    crowds = keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    held = keys.join(crowds, "band")
    central = held.groupBy("doc_id").agg(F.sum("n").alias("mates"))
    held = materialize(held.select("band", "doc_id").join(central, "doc_id"), "held")
    # the most mates, then the least hash: both in one number
    rank = F.col("mates").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    leaders = held.groupBy("band").agg(F.max_by("doc_id", rank).alias("leader"))
    buckets = materialize(held.select("band", "doc_id").join(leaders, "band"), "buckets")
    pairs = materialize(buckets.where("doc_id <> leader").groupBy(F.col("doc_id").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("bands")), "pairs")
    needed = buckets.select("doc_id").distinct()
    # merged at every size, so that small inputs show the cost of large ones
    texts = materialize(signed.hint("merge").join(leads, ["doc_id", "print"]).select("doc_id", "size", "blob").join(needed.hint("merge"), "doc_id", "left_semi"), "texts")

    best = pairs.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("bands"), "b"))).where("turn = 1")
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").select("doc_id", "a")
    mixed = members.join(several, "doc_id").where("rep > a").select("a", F.col("rep").alias("b"))
    labels = connected_components(materialize(verify(best, texts, least).unionByName(mixed), "links"))

    def outside(found: DataFrame) -> DataFrame:
        """Pairs whose ends are in different classes so far."""
        of_a, of_b = (labels.select(F.col("id").alias(c), F.col("label").alias(f"class_{c}")) for c in "ab")
        return found.join(of_a, "a", "left").join(of_b, "b", "left").where("coalesce(class_a, a) <> coalesce(class_b, b)").select("a", "b")

    rest = outside(pairs.join(best.select("a", "b"), ["a", "b"], "left_anti"))
    links = materialize(verify(rest, texts, least), "links")
    if not links.isEmpty():
        labels = _merge(labels, links)

    classed = buckets.join(labels, F.col("doc_id") == F.col("id"), "left").select("band", "doc_id", F.coalesce("label", "doc_id").alias("class")).distinct()
    links = materialize(cross_classes(materialize(classed, "classed"), texts, least), "links")
    if not links.isEmpty():
        labels = _merge(labels, links)

    classes = members.join(labels, F.col("rep") == F.col("id"), "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("class_id"))
    ids = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"))
    return ids.join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = 24, rows: int = 5) -> DataFrame:
    """``docs``, all columns, with one row of each class: the one of least doc_id. Rows without an id stay.

    Of several rows with that id the one with the least text stays, then the one whose columns hash least.
    """
    classes = near_duplicates(docs, least, bands, rows)
    stay = classes.where("doc_id = class_id").select("doc_id").distinct()
    id_, every = F.col("`doc_id`"), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows_ = docs.where(id_.isNotNull()).join(stay, "doc_id", "left_semi")
    one = rows_.groupBy(id_).agg(F.min_by(every, F.struct(F.col("`text`"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))).alias("row"))
    return one.select("row.*").unionByName(docs.where(id_.isNull()))
