"""Size-aware similarity join of documents as sets of word shingles.

Documents with the same set are one class, and a class takes part once.  Two classes link
when ``100 * intersection >= threshold * union``.  For sets of n and m shingles that is
an intersection of at least c(n, m); the join treats sets by size:

* light sets write out all their subsets of c(n, m) shingles for every m they can meet.
  Equal subsets of classes of sizes n and m prove the link; nothing is left to check;
* heavy sets would have too many subsets.  They scan inverted lists: a set's rarest
  n - c + 1 shingles must hold one of any partner's, so only these are listed, and those
  of light sets that are large enough for a heavy partner.  Shingles that no other class
  has are left out, which leaves few lists.  Listed pairs are checked on the whole sets.

The boundary is the size at which writing subsets costs more rows than the lists.

A list is not expanded into pairs.  All its members are first compared with one of them;
members that the links found so far connect need no more comparing.  Only what is then
left unconnected in a list is compared pair by pair.

Links connect classes to components; ``component_id`` is the smallest id in one.

Cases: null, empty and blank texts have no shingles, link with nothing and are their own
component; texts of fewer words than a shingle are one shingle; repeated rows are a class;
a null id gets its component's smallest id, or null; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.llm._blocks import (Block, BlockTable, CodeSpace, block_table, pack_codes, texts_of, unpack_codes,
                                   windows)
from plumbline.llm._components import components
from plumbline.llm._memory import tidy
from plumbline.session import cut_lineage

#: Words in a shingle, and the similarity in hundredths.
WORDS, THRESHOLD = 5, 80
#: No set above this size is light, whatever the costs.
MOST_LIGHT = 24

FACTS = "block long, row long, doc_id long, n_shingles long, digest binary"
LISTS = "bucket long, block long, width int, codes binary, counts binary"
CLASSES = "block long, bucket long, classes binary, used long"
POSTINGS = "key long, low int, high int, class long, n int, place int"


def least_overlap(n: int, m: int, threshold: int) -> int:
    """Shared shingles that sets of n and m need."""
    return -(-threshold * (n + m) // (100 + threshold))


def partners(n: int, threshold: int) -> range:
    """Sizes that a set of n can meet."""
    return range(-(-threshold * n // 100), 100 * n // threshold + 1)


def similar_documents(docs: DataFrame, *, words: int = WORDS, threshold: int = THRESHOLD,
                      id_col: str = "doc_id", text_col: str = "text",
                      block_bytes: int | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``class_id`` (the smallest id with the
    same set) and ``first`` (whether the row comes first in its component), for each row of
    ``docs``."""
    blocks = block_table(docs, id_col, text_col, block_bytes)
    try:
        return cut_lineage(_joined(blocks, words, threshold).drop("block", "row"))
    finally:
        blocks.drop()


def one_of_each(docs: DataFrame, *, words: int = WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id",
                text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """``docs`` with the first row of each component, in order of id, and nothing else.  The
    rows come from the blocks, so texts are shuffled once."""
    others = [c for c in docs.columns if c != text_col]
    beside = F.struct(F.col(text_col).isNull().alias("missing"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    blocks = block_table(docs, id_col, text_col, block_bytes, beside)
    try:
        rows = blocks.rows(rest=True)
        dropped = _joined(blocks, words, threshold).where(~F.col("first")).select("block", "row")
        kept = blocks.with_facts(cut_lineage(dropped), "row", rest=True) \
            .select("block", "sizes", "payload", "rest", "row") \
            .mapInArrow(tidy(_kept), T.StructType([T.StructField("text", T.BinaryType()), T.StructField("rest", rows.schema["rest"].dataType.elementType)]))
        columns = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)}
        columns[text_col] = F.when(~F.col("rest.missing"), F.col("text").cast(docs.schema[text_col].dataType))
        return cut_lineage(kept.select(*[columns[c].alias(c) for c in docs.columns]))
    finally:
        blocks.drop()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block but for those of its list."""
    for b in batches:
        block, sizes, payload, rest, rows = b.columns
        for i in range(b.num_rows):
            stays = np.ones(len(sizes[i]), bool)
            stays[np.array(rows[i].as_py() or [], np.int64) - block[i].as_py()] = False
            texts = texts_of(payload[i].as_py(), sizes[i].as_py())
            at = np.flatnonzero(stays)
            yield pa.RecordBatch.from_arrays(
                [pa.array([texts[k] for k in at], pa.binary()), rest[i].values.take(pa.array(at))], ["text", "rest"])


def _joined(blocks: BlockTable, words: int, threshold: int) -> DataFrame:
    """Each row of the blocks with its component."""
    facts = cut_lineage(blocks.rows().mapInArrow(tidy(_facts(words)), FACTS))
    classes = cut_lineage(
        facts.where("n_shingles > 0").groupBy("digest")
        .agg(F.min(F.struct("row", "block")).alias("at"), F.min("doc_id").alias("class_id"),
             F.first("n_shingles").cast("int").alias("n"))
        .select("digest", F.col("at.row").alias("class"), F.col("at.block").alias("block"), "class_id", "n"))
    reps = classes.select("block", F.col("class").alias("rep"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    space = CodeSpace.of(total, blocks.scale)
    lists = blocks.with_facts(reps, "rep").mapInArrow(tidy(_lister(words, space)), LISTS)
    counted = cut_lineage(lists.groupBy("bucket").applyInPandas(_counter, CLASSES)
                          .select("block", F.struct("bucket", "classes").alias("fact"), "used"))
    light = _boundary(classes, counted, threshold)
    postings = _postings(blocks, reps, counted, _poster(words, space, threshold, light))
    links = _light_links(postings.where("low > 0")).unionByName(
        _heavy_links(blocks, reps, postings.where("low = 0"), words, threshold, light))
    linked = components(links)
    groups = classes.join(linked, classes["class"] == linked["node"], "left") \
        .withColumn("component", F.coalesce("component", "class"))
    smallest = groups.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = groups.join(smallest, "component").select("digest", "class_id", "component_id", "component")
    return facts.join(named, "digest", "left").select(
        "block", "row", "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        (F.col("row") == F.coalesce("component", "row")).alias("first"))


def _sets(block: Block, words: int) -> Iterator[np.ndarray]:
    """Each document's distinct shingles, sorted."""
    whole = windows(block.words, words, 3)
    for a, z in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist()):
        if z - a >= words:
            yield np.unique(whole[a:z - words + 1])
        elif z > a:
            yield windows(block.words[a:z], z - a, 3 + words - (z - a))
        else:
            yield np.zeros(0, np.uint64)


def _facts(words: int):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, fold_case=True)
                sets = [(len(s), xxhash.xxh128_digest(s.tobytes())) for s in _sets(block, words)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(sets), pa.int64()),
                     pa.array(row["block"] + np.arange(len(sets)), pa.int64()),
                     pa.array(block.doc_ids, pa.int64()), pa.array([n for n, _ in sets], pa.int64()),
                     pa.array([d if n else None for n, d in sets], pa.binary())],
                    ["block", "row", "doc_id", "n_shingles", "digest"])

    return facts


def _chosen(row: dict, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Class and set of the block's documents that stand for a class."""
    wanted = set(row["rep"] or ())
    if wanted:
        for k, s in enumerate(_sets(Block(row, fold_case=True), words)):
            if row["block"] + k in wanted:
                yield row["block"] + k, s


def _lister(words: int, space: CodeSpace):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                codes, n = _block_codes([s for _, s in _chosen(row, words)], space)
                out, done = [], 0
                for bucket, width, filled in space.split(codes):
                    top = np.searchsorted(codes, np.uint64(bucket + 1) << np.uint64(space.bits - space.bucket_bits))
                    own = codes[done:top] & np.uint64((1 << space.bits - space.bucket_bits) - 1)
                    several = np.flatnonzero(n[done:top] > 1)
                    counts = np.stack([np.searchsorted(filled, own[several]), n[done:top][several]], axis=1)
                    out.append((bucket, row["block"], width, pack_codes(filled, width), counts.astype("<u4").tobytes()))
                    done = top
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(),
                                                                    pa.binary(), pa.binary()))],
                        ["bucket", "block", "width", "codes", "counts"])

    return lists


def _block_codes(sets: list[np.ndarray], space: CodeSpace) -> tuple[np.ndarray, np.ndarray]:
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(space.codes(np.concatenate(sets)), return_counts=True)


def _counter(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
    """How many documents have each code: 0 for one, else one more than the power of two."""
    parts = [unpack_codes(c, w) for c, w in zip(lists["codes"], lists["width"])]
    sizes = np.array([len(p) for p in parts])
    n = np.ones(sizes.sum(), np.int64)
    for start, packed in zip(np.cumsum(sizes) - sizes, lists["counts"]):
        several = np.frombuffer(packed, "<u4").reshape(-1, 2)
        n[start + several[:, 0].astype(np.int64)] = several[:, 1]
    _, which = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(which, weights=n)
    kind = np.where(total > 1, np.floor(np.log2(total)) + 1, 0).astype(np.uint8)
    out = np.split(kind[which], np.cumsum(sizes)[:-1])
    found = [bool(o.any()) for o in out]
    return pd.DataFrame({
        "block": lists["block"].to_numpy()[found], "bucket": key[0],
        "classes": [_squeeze(o) for o, f in zip(out, found) if f],
        "used": [int((o > 0).sum()) for o, f in zip(out, found) if f]})


def _squeeze(kinds: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(kinds.tobytes())


def _boundary(classes: DataFrame, counted: DataFrame, threshold: int) -> int:
    """The largest size at which writing out subsets costs no more than scanning lists.

    A set's share of the lists is its listed shingles times the mean length of a list,
    as far as its shingles are shared at all; both are measured on the whole input.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    shared = counted.agg(F.sum("used")).first()[0] or 0
    if not total:
        return 0
    length = 1 + shared / total * max(1, shared / max(1, total - shared))
    light = 0
    for n in range(1, MOST_LIGHT + 1):
        subsets = sum(comb(n, min(n, least_overlap(n, m, threshold))) for m in partners(n, threshold))
        scanned = (n - least_overlap(n, -(-threshold * n // 100), threshold) + 1) * (1 + length) * 2
        if subsets > scanned:
            break
        light = n
    return light


def _postings(blocks: BlockTable, reps: DataFrame, counted: DataFrame, poster) -> DataFrame:
    both = reps.withColumn("fact", F.lit(None).cast("struct<bucket:bigint,classes:binary>")) \
        .unionByName(counted.select("block", F.lit(None).cast("long").alias("rep"), "fact"))
    rows = cut_lineage(blocks.with_facts(both, "rep", "fact").mapInArrow(tidy(poster), POSTINGS))
    # A key that one class alone has joins nothing.
    keys = rows.groupBy("key", "low", "high").agg(F.min("class").alias("one"), F.max("class").alias("other")) \
        .where("one != other").select("key", "low", "high")
    return cut_lineage(rows.join(keys, ["key", "low", "high"], "left_semi"))


def _poster(words: int, space: CodeSpace, threshold: int, light: int):
    """Keys of a class: subsets (``low`` and ``high`` are the two sizes) or listed shingles."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            for row in b.to_pylist():
                chosen = list(_chosen(row, words))
                codes, _ = _block_codes([s for _, s in chosen], space)
                facts = {f["bucket"]: np.frombuffer(zstandard.ZstdDecompressor().decompress(f["classes"]), np.uint8)
                         for f in row["fact"] or ()}
                kinds = space.places(codes, facts)
                keys, columns = [], []
                for name, s in chosen:
                    n = len(s)
                    kind = kinds[np.searchsorted(codes, space.codes(s))]
                    if n <= light:
                        own, sizes = _subsets(s, threshold, light)
                        keys.append(own)
                        columns.append(np.column_stack([sizes, np.tile([name, n, 0], (len(own), 1))]))
                    if n > light or 100 * n >= threshold * (light + 1):
                        order = np.argsort(kind, kind="stable")  # rare first, then by hash
                        listed = order[:n - least_overlap(n, -(-threshold * n // 100), threshold) + 1]
                        place = np.flatnonzero(kind[listed] > 0)
                        keys.append(s[listed[place]])
                        columns.append(np.column_stack(
                            [np.tile([0, 0, name, n], (len(place), 1)), place]))
                if keys:
                    table = np.concatenate(columns)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64), pa.int64()),
                         pa.array(table[:, 0], pa.int32()), pa.array(table[:, 1], pa.int32()),
                         pa.array(table[:, 2], pa.int64()), pa.array(table[:, 3], pa.int32()),
                         pa.array(table[:, 4], pa.int32())],
                        ["key", "low", "high", "class", "n", "place"])

    return postings


def _subsets(s: np.ndarray, threshold: int, light: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the subsets that a partner of each size would share, and the two sizes."""
    n, keys, sizes = len(s), [], []
    for m in partners(n, threshold):
        if m <= light:
            for chosen in combinations(range(n), least_overlap(n, m, threshold)):
                keys.append(xxhash.xxh64_intdigest(s[list(chosen)].tobytes(), m + n))
                sizes.append((min(n, m), max(n, m)))
    return np.array(keys, np.uint64), np.array(sizes, np.int64).reshape(-1, 2)


def _light_links(postings: DataFrame) -> DataFrame:
    """Stars over each key's classes: of one size all link; of two, those of the one with
    those of the other."""
    key = ["key", "low", "high"]
    ends = postings.groupBy(*key).agg(
        F.min(F.when(F.col("n") == F.col("low"), F.col("class"))).alias("small"),
        F.min(F.when(F.col("n") == F.col("high"), F.col("class"))).alias("large"))
    hub = F.when(F.col("n") == F.col("low"), F.col("large")).otherwise(F.col("small"))
    return postings.join(ends, key).select(hub.alias("a"), F.col("class").alias("b")) \
        .where("a IS NOT NULL AND a != b").distinct()


def _heavy_links(blocks: BlockTable, reps: DataFrame, postings: DataFrame, words: int,
                 threshold: int, light: int) -> DataFrame:
    needed = postings.select(F.col("class").alias("rep")).distinct()
    sets = cut_lineage(blocks.with_facts(reps.join(needed, "rep", "left_semi"), "rep")
                       .mapInArrow(tidy(_set_rows(words)), "class long, shingles binary"))
    lists = cut_lineage(postings.select("key", "class", "n", "place"))
    one = lists.groupBy("key").agg(F.min(F.struct("class", "n", "place")).alias("p")) \
        .select("key", F.col("p.class").alias("a"), F.col("p.n").alias("na"), F.col("p.place").alias("pa"))
    tested = cut_lineage(_check(_pairs(lists, one, F.col("class") > F.col("a"), threshold, light), sets, threshold))
    links = tested.where("linked").select("a", "b")
    # Lists that hold more than one component yet, without the member all others have met.
    named = lists.join(components(links), F.col("class") == F.col("node"), "left") \
        .withColumn("component", F.coalesce("component", "class")).drop("node")
    rest = named.join(one.select("key", "a"), "key").where("class != a").drop("a")
    ends = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rest = cut_lineage(rest.join(ends.where("low != high").select("key"), "key", "left_semi"))
    if rest.isEmpty():
        return links
    others = rest.select("key", F.col("class").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"),
                         F.col("component").alias("ca"))
    pairs = _pairs(rest, others, (F.col("class") > F.col("a")) & (F.col("ca") != F.col("component")), threshold, light) \
        .join(tested.select("a", "b"), ["a", "b"], "left_anti")
    return links.unionByName(_check(pairs, sets, threshold).where("linked").select("a", "b"))


def _pairs(lists: DataFrame, others: DataFrame, condition: Column, threshold: int, light: int) -> DataFrame:
    return lists.join(others, "key").where(condition & _can_link(threshold) & (F.greatest("n", "na") > light)) \
        .select("a", F.col("class").alias("b")).distinct()


def _can_link(threshold: int) -> Column:
    """Sizes fit, and if this shingle is the first shared one, enough others can follow."""
    fits = (100 * F.least("n", "na") >= threshold * F.greatest("n", "na"))
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("na") - F.col("pa")) - 1
    return fits & ((100 + threshold) * most >= threshold * (F.col("n") + F.col("na")))


def _set_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found = [(name, s.tobytes()) for name, s in _chosen(row, words)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())],
                        ["class", "shingles"])

    return rows


def _check(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``a``, ``b``, ``linked`` on the whole sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= threshold * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())],
                                             ["a", "b", "linked"])

    return pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a") \
        .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b") \
        .select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long, linked boolean")
