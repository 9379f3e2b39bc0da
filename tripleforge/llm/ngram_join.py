"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize, numbered, own_ids, small_enough
from .components import connected_components
from .hashing import U, byte_texts, mix, shingle_set, split_words, word_hashes

#: Documents and n-grams of a block of a large candidate group; a task holds two blocks.
BLOCK_DOCS = 4000
BLOCK_GRAMS = 2_000_000
#: In larger blocks, n-grams of at most so many of their documents are counted by their pairs, others in dense fragments.
RARE, DENSE_DOCS = 16, 64
#: Shared n-grams of a fragment in which a block's partial overlaps are counted at once.
FRAGMENT = 2048
#: Tables of ids (up to 50 bytes a row) of at most so many rows are broadcast, so texts need not be shuffled to meet them.
BROADCAST_IDS = 400_000
#: The lists of blocks that members of large groups meet have at most so many entries (up to 40 bytes each) in a broadcast.
BROADCAST_MEETS = 1_000_000
#: Of groups larger than a block, members of a bucket of at most so many are compared pair by pair (by sketch), of larger ones in blocks.
PAIRED = 32


def most_difference(sizes: int, percent: int) -> int:
    """Largest symmetric difference of two sets with ``sizes`` n-grams together that are similar enough."""
    return sizes * (100 - percent) // (100 + percent)


def levels(percent: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, fragments) of each size level. Sets meet at the level of the larger one.

    There are more fragments than two sets of a level may differ in n-grams, so at least
    one fragment is the same in both; some more are for fragments without n-grams."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, int(low * 1.5) - 1)
        d = most_difference(2 * high, percent)
        out.append((low, high, d + 1 + (d // 10 + 1 if d else 0)))
        low = high + 1
    return out


def fragment_signatures(grams: np.ndarray, percent: int, cuts: list[tuple[int, int, int]]) -> np.ndarray:
    """Signatures of the fragments of a set, at each level (``cuts``) where it may meet a similar one.

    The order of n-grams is that of their hashes; ``k`` fragments cut it evenly. A signature stands for a
    fragment's n-grams, all of them. Fragments without n-grams have none; where a set
    has so few others that a similar one might share none, it has signatures of twice as many fragments too."""
    n, out = len(grams), []
    if not n:
        return np.empty(0, U)
    mixed, high_bits = mix(grams), grams >> U(32)
    for level, (low, high, k) in enumerate(cuts):
        if low * percent > n * 100:
            break
        if high < n:
            continue
        most = most_difference(n + min(high, n * 100 // percent), percent)
        while True:
            at = (high_bits * U(k)) >> U(32)
            starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
            tag = mix(U((level << 48) + k) + (at[starts] << U(24)))
            out.append(mix(np.add.reduceat(mixed, starts) ^ tag))
            if len(starts) > most or k >= 1 << 31:
                break
            k *= 2
    return np.unique(np.concatenate(out))


def parity_sketch(grams: np.ndarray) -> bytes:
    """For each of at least as many places as there are n-grams (a power of two, 64 at least) one bit: whether an odd number of them falls there.

    Sets differ in at least as many n-grams as their sketches in bits, so sketches rule pairs out and never lose one."""
    places = 64
    while places < len(grams):
        places *= 2
    return np.packbits(np.bincount((grams & U(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1, bitorder="little").tobytes()


def _stacked(sketches: list[bytes], words: int) -> np.ndarray:
    """A row of 64-bit words of each sketch, folded to ``words`` words."""
    out, lengths = np.empty((len(sketches), words), U), np.fromiter(map(len, sketches), np.int64, len(sketches))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        part = np.frombuffer(b"".join([sketches[k] for k in at]), U).reshape(len(at), -1)
        while part.shape[1] > words:
            part = part[:, : part.shape[1] // 2] ^ part[:, part.shape[1] // 2 :]
        out[at] = part
    return out


def _tested(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            most = most_difference(n_a + n_b, percent)
            close = np.abs(n_a - n_b) <= most
            first, second = batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()
            words = np.fromiter((min(len(x), len(y)) // 8 for x, y in zip(first, second, strict=True)), np.int64, len(first))
            for w in np.unique(words):
                at = np.flatnonzero(words == w)
                differ = np.bitwise_count(_stacked([first[k] for k in at], w) ^ _stacked([second[k] for k in at], w)).sum(axis=1, dtype=np.int64)
                close[at] &= differ <= most[at]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(close)), batch.column("b").filter(pa.array(close))], ["a", "b"])

    return run


def _join_roots(root: np.ndarray, part: np.ndarray, cols: np.ndarray, link: np.ndarray) -> None:
    for row, linked in zip(part[link.any(1)], link[link.any(1)], strict=True):
        roots = np.unique(np.append(root[cols[linked]], root[row]))
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]


def _close(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, size, known, block, low, high = (table.column(c).to_numpy() for c in ("doc_id", "n", "known", "block", "low", "high"))
        sketches = table.column("sketch").to_pylist()
        stacked = _stacked(sketches, min(map(len, sketches)) // 8)
        rows = np.flatnonzero(block == low)
        cols = rows if low[0] == high[0] else np.flatnonzero(block == high)
        values, counts = np.unique(known, return_counts=True)
        major = known == values[counts.argmax()]  # what is connected already is not compared again
        compared = [(rows[~major[rows]], cols)] + ([] if cols is rows else [(rows[major[rows]], cols[~major[cols]])])
        root = np.arange(len(ids))
        for some, others in compared:
            for at in range(0, len(some) if len(others) else 0, 256):
                part = some[at : at + 256]
                most = most_difference(size[part][:, None] + size[others][None, :], percent)
                differ = np.abs(size[part][:, None] - size[others][None, :])
                bits = np.zeros(differ.shape, np.int64)
                for w in range(stacked.shape[1]):
                    bits += np.bitwise_count(stacked[part, w][:, None] ^ stacked[others, w][None, :])
                _join_roots(root, part, others, (np.maximum(bits, differ) <= most) & (known[part][:, None] != known[others][None, :]))
        smallest = ids.copy()
        np.minimum.at(smallest, root, ids)
        moved = smallest[root] != ids
        return pa.table({"a": smallest[root][moved], "b": ids[moved]})

    return run


def close_edges(met: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all similar sets that meet in buckets ``met`` (signature, doc_id), by ``sketches`` (doc_id, n, sketch).

    A bucket's members first meet its smallest one. Then those that aren't connected yet meet each other: pair by pair in buckets
    of at most PAIRED members, else in blocks of BLOCK_DOCS, of which only a spanning forest leaves a task. Pairs that sketches rule out give no
    edge, so a frequent n-gram doesn't connect what is not similar. Buckets with the same members are looked at once."""

    def near(pairs: DataFrame) -> DataFrame:
        side = lambda k: sketches.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
        return materialize(pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(_tested(percent), "a long, b long"))

    least = met.groupBy("signature").agg(F.min("doc_id").alias("a"))
    first = near(met.join(least, "signature").filter("doc_id <> a").select("a", F.col("doc_id").alias("b")))
    named = met.join(connected_components(first), F.col("doc_id") == F.col("node"), "left").select("signature", "doc_id", F.coalesce("label", "doc_id").alias("known"))
    named = materialize(named)
    unlike = named.groupBy("signature").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.min("doc_id").alias("a"), F.min("known").alias("k"), F.max("known").alias("l"))
    unlike = materialize(unlike.filter("size > 2 AND k <> l").groupBy("size", "x", "a").agg(F.min("signature").alias("signature")).select("signature", "size"))
    left = materialize(named.join(unlike, "signature"))
    few, many = left.filter(F.col("size") <= PAIRED), left.filter(F.col("size") > PAIRED)
    side = lambda k: few.select("signature", F.col("doc_id").alias(k), F.col("known").alias(f"known_{k}"))
    second = near(side("a").join(side("b"), "signature").filter("a < b AND known_a <> known_b").select("a", "b"))
    blocks = F.ceil(F.col("size") / BLOCK_DOCS).cast("long")
    own = F.pmod(F.xxhash64("doc_id"), blocks)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.struct(F.least(own, k).alias("low"), F.greatest(own, k).alias("high")))
    dealt = many.join(sketches, "doc_id").select("signature", "doc_id", "known", "n", "sketch", own.alias("block"), F.explode(meets).alias("meet"))
    dealt = dealt.select("signature", "doc_id", "known", "n", "sketch", "block", "meet.low", "meet.high")
    third = materialize(dealt.groupBy("signature", "low", "high").applyInArrow(_close(percent), "a long, b long"))
    return first.unionByName(second).unionByName(third)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, first, second, sketches = [], [], [], []
            for text in byte_texts(batch.column(1)):
                grams = shingle_set(word_hashes(split_words(text)), n)
                size.append(len(grams))
                first.append(int(np.add.reduce(mix(grams)).view(np.int64)) if len(grams) else 0)
                second.append(int(np.bitwise_xor.reduce(mix(grams ^ U(0x5851F42D4C957F2D))).view(np.int64)) if len(grams) else 0)
                sketches.append(parity_sketch(grams))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "n", "d1", "d2", "sketch"])

    return run


def _signatures(n: int, percent: int):
    cuts = levels(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fragment_signatures(shingle_set(word_hashes(split_words(t)), n), percent, cuts).view(np.int64) for t in byte_texts(batch.column(1))]
            ids = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64()), pa.array(ids, pa.int64())], ["signature", "doc_id"])

    return run


def overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``rows`` with those at ``cols``: the order of the n-grams that
    two or more sets share is cut into fragments, each gives partial overlaps, and these are summed."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
    code = np.cumsum(new) - 1
    holders = np.bincount(code)[code] if len(code) else code
    total = np.zeros((len(rows), len(cols)), np.float32)
    row_of, col_of = np.full(len(sets), -1), np.full(len(sets), -1)
    row_of[rows], col_of[cols] = np.arange(len(rows)), np.arange(len(cols))
    same = rows is cols
    rare = RARE if len(sets) > DENSE_DOCS else 0
    for m in range(2, rare + 1):  # the fragment of rare n-grams: the holders of each, side by side
        held = owner[holders == m].reshape(-1, m)
        for a in range(m):
            for b in range(m):
                if a != b and len(held):
                    r, c = row_of[held[:, a]], col_of[held[:, b]]
                    both = (r >= 0) & (c >= 0)
                    np.add.at(total, (r[both], c[both]), 1)
    often = holders > max(1, rare)
    owner, code = owner[often], code[often]
    if not len(code):
        return total
    code = np.unique(code, return_inverse=True)[1]
    cuts = np.searchsorted(code, np.arange(0, code[-1] + 1 + FRAGMENT, FRAGMENT))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a == b:
            continue
        own, col = owner[a:b], code[a:b] - k * FRAGMENT
        width = int(col[-1]) + 1
        left = np.zeros((len(rows), width), np.float32)
        at = row_of[own]
        left[at[at >= 0], col[at >= 0]] = 1
        if same:
            right = left
        else:
            right = np.zeros((len(cols), width), np.float32)
            at = col_of[own]
            right[at[at >= 0], col[at >= 0]] = 1
        total += left @ right.T
    return total


def _linked(n: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        copies = table.column("copies").to_numpy().astype(np.float64)
        block, low, high = (table.column(c).to_numpy() for c in ("block", "low", "high"))
        sets = [shingle_set(word_hashes(split_words(t)), n).view(np.int64) for c in table.column("text").chunks for t in byte_texts(c)]
        size = np.array([len(x) for x in sets], float)
        rows = np.flatnonzero(block == low)
        cols = rows if low[0] == high[0] else np.flatnonzero(block == high)
        degree, root = np.zeros(len(ids)), np.arange(len(ids))
        total = overlaps(sets, rows, cols) if len(rows) and len(cols) else np.zeros((0, 0))
        for at in range(0, len(total), 256):
            part, both = rows[at : at + 256], total[at : at + 256].astype(float)
            link = both * 100 >= percent * (size[part][:, None] + size[cols][None, :] - both)
            if cols is rows:
                link[np.arange(len(part)), np.arange(at, at + len(part))] = False
            else:
                degree[cols] += link.T @ copies[part]
            degree[part] += link @ copies[cols]
            _join_roots(root, part, cols, link)
        smallest = ids.copy()
        np.minimum.at(smallest, root, ids)
        return pa.table({"doc_id": ids, "root": smallest[root], "links": degree.astype(np.int64)})

    return run


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose n-gram sets have a Jaccard similarity of ``percent`` or more; exact.

    Returns (doc_id, n_shingles, component_id, n_links), one row a row of ``docs``.

    1. Documents with the same set become one class; copies are counted, never compared.
    2. The global order of n-grams is cut into fragments, more than similar sets can differ in. So they share a whole
       fragment; classes meet by its signature in an aggregation (no pairs), which gives candidate groups.
    3. Groups larger than a block fall apart where sketches of the sets that met rule their similarity out (``close_edges``).
    4. In each group, partial overlaps are counted fragment by fragment and summed per pair, in blocks of
       BLOCK_DOCS documents or BLOCK_GRAMS n-grams: a large group is cut into bands of size, of which only neighbouring ones
       can hold similar sets, and is dealt by pairs of blocks over many tasks.
       Only a spanning forest and numbers of links leave a task, no pairs.
    5. Components of the forests, then the copies.

    Words are lower-cased (A-Z) runs of other than blanks; a text with fewer words than ``n`` is one n-gram. Null and
    empty texts have no n-gram, no link, and are their own component. A null id has a null component and
    links with nothing. Rows that share an id are judged each by its own text; each counts as a link of the others where texts are
    similar. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not rows.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        each = numbered(rows)
        nodes = materialize(_join_unique(each.select(F.when(F.col("doc_id").isNotNull(), F.col("number")).alias("doc_id"), "text"), n, percent))
        named = nodes.withColumnRenamed("doc_id", "number").join(each.select("number", "doc_id"), "number")
        least = named.groupBy("component_id").agg(F.min("doc_id").alias("smallest"))
        named = named.join(least, "component_id").select("doc_id", "n_shingles", F.col("smallest").alias("component_id"), "n_links")
        return named.unionByName(nodes.filter("doc_id IS NULL"))
    return _join_unique(rows, n, percent)


def _join_unique(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """``ngram_join`` of rows (doc_id, text) whose ids are unique where they aren't null."""
    sets = materialize(rows.mapInArrow(_sets(n), "doc_id long, n long, d1 long, d2 long, sketch binary"))
    known = sets.filter("doc_id IS NOT NULL AND n > 0")
    classes = materialize(known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    others = materialize(known.select("doc_id").join(classes.select("rep"), known["doc_id"] == F.col("rep"), "left_anti"))
    reps = rows.filter("doc_id IS NOT NULL").join(F.broadcast(others) if small_enough(others, BROADCAST_IDS) else others, "doc_id", "left_anti")
    signatures = reps.mapInArrow(_signatures(n, percent), "signature long, doc_id long")
    buckets = materialize(signatures.groupBy("signature").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("signature"))
    met = materialize(signatures.hint("merge").join(buckets, "signature"))
    least = met.groupBy("signature").agg(F.min("doc_id").alias("a"))
    groups = connected_components(met.join(least, "signature").select("a", F.col("doc_id").alias("b")))
    described = lambda nodes: materialize(nodes.join(classes.select(F.col("rep").alias("node"), F.col("n").alias("grams_n"), "copies"), "node"))
    groups = described(groups)
    count = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("grams_n") / BLOCK_GRAMS)).cast("long").alias("blocks")
    diffuse = materialize(groups.groupBy("label").agg(count).filter("blocks > 1").select("label"))
    if not diffuse.isEmpty():
        unsure = groups.join(diffuse, "label", "left_semi").select(F.col("node").alias("doc_id"))
        close = close_edges(materialize(met.join(unsure, "doc_id", "left_semi")), known.select("doc_id", "n", "sketch"), percent)
        groups = materialize(groups.join(diffuse, "label", "left_anti").unionByName(described(connected_components(close)).select(groups.columns)))
    large = groups.groupBy("label").agg(count).filter("blocks > 1").select("label", F.lit(True).alias("large"))
    # similar sets of a large group are in the same or in neighbouring bands of size
    band = F.when(F.col("large"), F.floor(F.log(F.col("grams_n").cast("double")) / (1.0001 * math.log(100 / percent)))).otherwise(0).cast("long").alias("band")
    member = groups.join(large, "label", "left").select("label", "node", "copies", "grams_n", band)
    bands = materialize(member.groupBy("label", "band").agg(count))
    beside = lambda step, name: bands.select("label", (F.col("band") + step).alias("band"), F.col("blocks").alias(name))
    bands = bands.join(beside(-1, "above"), ["label", "band"], "left").join(beside(1, "below"), ["label", "band"], "left").fillna(0, ["above", "below"])
    code = lambda at, k: (at * (1 << 32) + k).cast("long")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(F.array().cast("array<bigint>"))
    pair = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    meets = F.concat(
        F.transform(upto("blocks"), lambda k: pair(code(F.col("band"), F.least(own, k)), code(F.col("band"), F.greatest(own, k)))),
        F.transform(upto("above"), lambda k: pair(code(F.col("band"), own), code(F.col("band") + 1, k))),
        F.transform(upto("below"), lambda k: pair(code(F.col("band") - 1, k), code(F.col("band"), own))),
    )
    member = materialize(member.join(bands, ["label", "band"]).select("label", "node", "copies", code(F.col("band"), own).alias("block"), meets.alias("meets")))
    few = small_enough(member, BROADCAST_IDS) and small_enough(member.select(F.explode("meets")), BROADCAST_MEETS)
    texts = reps.join(F.broadcast(member) if few else member, reps["doc_id"] == member["node"])
    dealt = texts.withColumn("meet", F.explode("meets")).select("label", "doc_id", "copies", "block", "meet.low", "meet.high", "text")
    found = materialize(dealt.groupBy("label", "low", "high").applyInArrow(_linked(n, percent), "doc_id long, root long, links long"))
    forest = connected_components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    degrees = found.groupBy("doc_id").agg(F.sum("links").alias("links")).select(F.col("doc_id").alias("node"), "links")
    label = classes.join(forest.select(F.col("node").alias("rep"), "label"), "rep", "left").join(degrees.select(F.col("node").alias("rep"), "links"), "rep", "left")
    label = label.select("n", "d1", "d2", F.coalesce("label", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = known.select("doc_id", "n", "d1", "d2").join(label, ["n", "d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = sets.filter("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component one with the smallest id, or one without an id if it has none.

    Rows are judged each by its own text, also where ids are shared or null. Texts without words stay."""
    if own_ids(docs):
        out = ngram_join(docs, n, percent).filter("doc_id <> component_id").select("doc_id")
        return docs.join(out, "doc_id", "left_anti").select(docs.columns)
    each = numbered(docs)
    found = _join_unique(each.select(F.col("number").alias("doc_id"), "text"), n, percent).select(F.col("doc_id").alias("number"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "number"))
    stays = found.join(each.select("number", "doc_id"), "number").groupBy("component_id").agg(first.alias("first")).select("first.number")
    return each.join(stays, "number", "left_semi").select("row.*")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(load(spark, sf_dir, "documents"), n=3, percent=90)
