"""Substring deduplication: seed on winnowed anchors, extend both ways, drop maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize
from .hashing import U, byte_texts, long_runs, mix, rolling, split_words, winnowed, word_hashes

WINDOW_WORDS = 35
ANCHOR_WORDS = 16
#: Windows that a shard holds on average; the number of shards grows with the input.
SHARD_WINDOWS = 500_000
#: Windows that a task combines before it hands them on.
COMBINE_WINDOWS = 1_500_000

_EMPTY = hashlib.sha256(b"").hexdigest()


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def _anchors(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchor n-grams by place, and the place of each window's anchor."""
    grams = rolling(h, anchor)
    return grams, winnowed(grams, window - anchor + 1)


def _scan(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sha, first, second, seeds = [], [], [], [], []
            for text in byte_texts(batch.column(1)):
                words = split_words(text, lower=False)
                body, h = b" ".join(words), word_hashes(words)
                digest = hashlib.sha256(body)
                size.append(len(words))
                sha.append(digest.hexdigest())
                first.append(int.from_bytes(digest.digest()[:8], "big", signed=True))
                second.append(int.from_bytes(digest.digest()[8:16], "big", signed=True))
                grams, at = _anchors(h, window, anchor)
                seeds.append(grams[np.unique(at)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), _lists(seeds, pa.int64())], ["id", "n", "sha", "d1", "d2", "seeds"])

    return run


def _extend(window: int, anchor: int, shards: int):
    """Windows around repeated anchors: hashes of the runs that extend an anchor both ways to the window's length.

    Of windows that are the same within a task, all are known to repeat; one of them goes on as a witness, to the shard of its hash.
    So a hot window is one row a task, and the windows of a hot anchor are spread. Known ones need to meet nothing: they go by their
    document, in shards after the others. Ids, and places of known ones, are sent as differences, which compress well."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        ids, places, runs = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((np.arange(len(runs)), runs))
        same = np.concatenate(([False], runs[order][1:] == runs[order][:-1]))
        multi = np.zeros(len(runs), bool)
        multi[order] = same | np.concatenate((same[1:], [False]))
        witness = np.ones(len(runs), bool)
        witness[order] = ~same
        out = {c: [] for c in ("shard", "ids", "places", "runs", "multi", "known_ids", "known_places")}
        spread = lambda h: ((h >> U(32)) * U(shards) >> U(32)).astype(np.int64)
        empty = np.empty(0, np.int64)
        for known, picked, shard in ((False, np.flatnonzero(witness), spread(runs[witness])), (True, np.flatnonzero(multi), shards + spread(mix(ids[multi].astype(np.int64).view(U))))):
            by = np.argsort(shard, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1) if len(by) else []:
                at = picked[part]
                own, near = np.diff(ids[at], prepend=0), np.diff(places[at], prepend=0)
                out["shard"].append(int(shard[part[0]]))
                out["runs"].append(empty if known else runs[at].view(np.int64))
                out["multi"].append(empty if known else multi[at].astype(np.int8))
                for name, mine in (("", not known), ("known_", known)):
                    out[f"{name}ids"].append(own if mine else empty)
                    out[f"{name}places"].append(near if mine else empty)
        kinds = {"multi": pa.int8(), "places": pa.int32(), "known_places": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) if c == "shard" else _lists([x.astype(kinds.get(c, pa.int64()).to_pandas_dtype()) for x in v], kinds.get(c, pa.int64())) for c, v in out.items()], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for doc, text, seeds in zip(batch.column(0).to_numpy(), byte_texts(batch.column(1)), batch.column(2), strict=True):
                h = word_hashes(split_words(text, lower=False))
                grams, at = _anchors(h, window, anchor)
                wanted = np.sort(seeds.values.to_numpy().view(U))
                near = grams[at]
                found = wanted[np.minimum(np.searchsorted(wanted, near), len(wanted) - 1)] == near if len(wanted) else np.zeros(len(near), bool)
                places = np.flatnonzero(found)
                if not len(places):
                    continue
                held.append((np.full(len(places), doc), places, long_runs(h, window)[places]))
                count += len(places)
                if count >= COMBINE_WINDOWS:
                    yield from flush(held)
                    held, count = [], 0
        if held:
            yield from flush(held)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """(id, places) of the windows of a shard that occur again."""
    ids, places, runs, multi = [], [], [], []
    known_ids, known_places = [], []
    for row in range(table.num_rows):
        take = lambda c: table.column(c)[row].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
        ids.append(np.cumsum(take("ids")))
        places.append(np.cumsum(take("places"), dtype=np.int32))
        runs.append(take("runs"))
        multi.append(take("multi") > 0)
        known_ids.append(np.cumsum(take("known_ids")))
        known_places.append(np.cumsum(take("known_places"), dtype=np.int32))
    ids, places, runs, multi = (np.concatenate(x) for x in (ids, places, runs, multi))
    order = np.argsort(runs, kind="stable")
    same = np.concatenate(([False], runs[order][1:] == runs[order][:-1]))
    again = np.zeros(len(runs), bool)
    again[order] = same | np.concatenate((same[1:], [False]))
    again &= ~multi  # the others are among the known
    ids = np.concatenate([ids[again], *known_ids])
    places = np.concatenate([places[again], *known_places])
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    if not len(ids):
        return pa.table({"id": pa.array([], pa.int64()), "first": pa.array([], pa.list_(pa.int32())), "last": pa.array([], pa.list_(pa.int32()))})
    # runs of consecutive windows of a document
    new_run = np.concatenate(([True], (ids[1:] != ids[:-1]) | (places[1:] != places[:-1] + 1)))
    first = np.flatnonzero(new_run)
    last = np.concatenate((first[1:], [len(ids)])) - 1
    doc = np.flatnonzero(np.concatenate(([True], ids[first][1:] != ids[first][:-1])))
    offsets = pa.array(np.concatenate((doc, [len(first)])).astype(np.int32))
    lists = {name: pa.ListArray.from_arrays(offsets, pa.array(places[at], pa.int32())) for name, at in (("first", first), ("last", last))}
    return pa.table({"id": ids[first][doc], **lists})


def _cut(window: int):
    """Removes the words that repeats cover: (id, n_removed, sha, repeats), a maximal repeat as [first word, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha, starts, ends = [], [], [], []
            for text, first, last in zip(byte_texts(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                words = split_words(text, lower=False)
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, first.values.to_numpy(), 1)
                np.add.at(step, last.values.to_numpy() + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                starts.append(edge[::2])
                ends.append(edge[1::2])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), _lists(starts, pa.int64()), _lists(ends, pa.int64())], ["id", "n_removed", "kept_sha", "starts", "ends"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the words that lie in a run of ``window`` words which starts anywhere else too, its own text included.

    Returns (doc_id, n_words, n_removed, kept_sha256, starts, ends): the maximal repeats are [starts, ends), in words.

    1. Texts with the same words form a class; with ``window`` words or more and a copy, all is a repeat, and one
       member stands for the class.
    2. Seeds: each window selects its smallest ``anchor``-gram, so equal windows have the same anchor. Anchors are
       counted over the corpus, and texts are joined with their repeated ones.
    3. Extension: a repeated anchor is extended to the windows that selected it, by hashes of whole windows. These
       meet in shards of their hashes; a task first combines its own, so a hot passage is one row a task.
    4. Windows that meet are joined to maximal repeats, and their words are cut out.

    Windows are judged on the input. They are compared by a 64-bit hash. Null and
    empty texts have no words; a null id is carried along; rows that share an id are judged each on its own, and each is
    the other's copy where the words are the same. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, sha string, d1 long, d2 long, seeds array<long>"
    scanned = materialize(rows.mapInArrow(_scan(window, anchor), schema))
    names = None
    if not scanned.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty():
        numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
        names = numbered.select(F.col("row").alias("id"), F.col("id").alias("doc_id"))
        rows = numbered.select(F.col("row").alias("id"), "text")
        scanned = materialize(rows.mapInArrow(_scan(window, anchor), schema))
    long_ones = scanned.filter(F.col("n") >= window)
    classes = materialize(long_ones.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    own = long_ones.join(classes.select("rep"), long_ones["id"] == F.col("rep"), "left_semi").select("id", F.explode("seeds").alias("seed"))
    repeated = own.groupBy("seed").count().filter("count > 1").select("seed")
    seeds = materialize(own.join(materialize(repeated), "seed").groupBy("id").agg(F.collect_set("seed").alias("seeds")))
    total = seeds.agg(F.sum(F.size("seeds"))).first()[0] or 0
    shards = max(1, -(-total * (window - anchor + 2) // 2 // SHARD_WINDOWS))
    texts = rows.join(seeds, "id").select("id", "text", "seeds")
    windows = texts.mapInArrow(_extend(window, anchor, shards), "shard long, ids array<long>, places array<int>, runs array<long>, multi array<byte>, known_ids array<long>, known_places array<int>")
    parts = windows.groupBy("shard").applyInArrow(_repeated, "id long, first array<int>, last array<int>")
    copied = long_ones.join(classes.filter("copies > 1"), ["d1", "d2"]).select("id")
    found = parts.groupBy("id").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last")).join(copied, "id", "left_anti")
    cut = rows.join(materialize(found), "id").select("id", "text", "first", "last").mapInArrow(_cut(window), "id long, n_removed long, kept_sha string, starts array<long>, ends array<long>")
    whole = scanned.select("id", "n", "sha").join(copied.withColumn("copied", F.lit(True)), "id", "left").join(cut, "id", "left")
    nothing = F.array().cast("array<long>")
    out = whole.select(
        "id",
        F.col("n").alias("n_words"),
        F.when(F.col("copied"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(F.col("copied"), F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", nothing)).alias("starts"),
        F.when(F.col("copied"), F.array(F.col("n"))).otherwise(F.coalesce("ends", nothing)).alias("ends"),
    )
    out = out.join(names, "id").drop("id") if names is not None else out.withColumnRenamed("id", "doc_id")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "starts", "ends")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents")).drop("starts", "ends")
