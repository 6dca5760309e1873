"""SimHash near-duplicates: 64-bit fingerprints, compared tile by tile with exclusive-or and bit counts.

Fingerprints fall into cells by the population counts of their four 16-bit quarters. The sum of the differences of
those counts never exceeds the number of differing bits, so only cells within the radius of one another can hold
linked fingerprints; every other pair of tiles is skipped. There are at most 17**4 cells whatever the input size,
and a cell above `TILE` fingerprints is cut into tiles by hash, so no task holds more than one tile and the tiles
of 65 neighbouring cells. Equal fingerprints (exact copies) are one node. Inside a task the links are reduced to a
spanning forest, never written pair by pair.

`similar_components` and `keep_one` link by similarity instead: two documents link if the sets of their five-word
shingle hashes have a Jaccard similarity of 0.8 or more. 256-bit prints of those sets only name candidates, within a
radius wide enough (`reach_of`) that a pair at the limit is missed about once in ten million. Sets whose sizes differ by
more than a factor 0.8 cannot link, so cells are bands of set sizes and only neighbouring bands meet. The whole sets of
documents with a candidate then meet in tiles below their candidate component, every pair there is intersected, and
only links that hold leave the task, again as a spanning forest. Documents with equal sets are one node.

Defined cases: null or empty text has fingerprint zero and links like any other; rows with a null id get a
fingerprint and the smallest non-null id reachable (null if there is none); repeated rows each come back; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.llm.common import Forest, components, cut

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints in a tile; it sets memory and the number of copies shuffled, never the result.
TILE = 16384
#: Linking by similarity: words in a shingle, least Jaccard similarity, 64-bit words of a print, prints in a tile.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
WORDS = 4
WIDE_TILE = 4096
#: Sets, and shingle hashes, in a tile of whole sets; they set memory and copies, never the result.
SET_TILE = 1024
SET_HASHES = 1 << 20
#: Shingle hashes counted at a time, and cells of a comparison block.
CHUNK = 1 << 16
BLOCK = 1 << 20


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle of a whole text, in order; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = max(0, len(words) - shingle)
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:last + 1].tolist(), ends[len(words) - last - 1:].tolist(), strict=True)),
        dtype="<u8", count=last + 1,
    ) if words else np.zeros(0, dtype="<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text: a bit is set if more than half of the shingle hashes have it."""
    hashes, counts = shingle_hashes(text, shingle), np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _stamp(rows: DataFrame, shingle: int) -> DataFrame:
    """The rows with `fp`, the 64 bits as a signed long, in place of the text, which is their last column."""
    names = [*rows.columns[:-1], "fp"]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=names)

    return rows.mapInArrow(run, schema)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """(id, fp) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return _stamp(rows, shingle)


def _cell(fp) -> F.Column:
    quarters = [F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    return F.struct(*(c.cast("int").alias(f"q{q}") for q, c in enumerate(quarters)))


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Half of the cell offsets within the radius, zero included: each pair of cells is met from one side."""
    span = range(-radius, radius + 1)
    return [d for d in product(span, repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def compare(mine: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two arrays of fingerprints, by exact comparison of every pair."""
    forest, rows = Forest(len(mine) + len(others)), max(1, BLOCK // max(1, len(others)))
    for at in range(0, len(mine), rows):
        near = np.bitwise_count(mine[at:at + rows, None] ^ others[None, :]) <= radius
        u, v = np.nonzero(near)
        if len(u):
            forest.link(u + at, v + len(mine))
    child, root = forest.links()
    every = np.concatenate([mine, others])
    a, b = every[child], every[root]
    return a[a != b], b[a != b]


def _compare_tiles(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, others in zip(batch.column(0), batch.column(1), strict=True):
                a, b = compare(
                    mine.values.to_numpy(zero_copy_only=False).view(np.uint64),
                    others.values.to_numpy(zero_copy_only=False).view(np.uint64), radius,
                )
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
                    )
    return run


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column fp) that differ in at most `radius` bits."""
    cells = prints.select("fp", _cell(F.col("fp")).alias("cell"))
    # At most 17**4 rows, so it may be broadcast at any size of the input.
    filled = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = (
        cells.join(F.broadcast(filled), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    steps = F.array(*(
        F.struct(*((F.col(f"cell.q{q}") + d[q]).cast("int").alias(f"q{q}") for q in range(4))) for d in _offsets(radius)
    ))
    reach = F.broadcast(filled.select("cell"))
    sent = tiles.select(F.explode(steps).alias("cell"), "part", "fps").join(reach, "cell", "left_semi")
    others = sent.groupBy("cell", "part").agg(F.flatten(F.collect_list("fps")).alias("others"))
    # The part numbers that reach a cell: again at most 17**4 rows.
    depth = filled.select(F.explode(steps).alias("cell"), "parts").groupBy("cell").agg(F.max("parts").alias("deep"))
    mine = tiles.join(F.broadcast(depth), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("deep") - 1)).alias("part"), F.col("fps").alias("mine")
    )
    return mine.join(others, ["cell", "part"]).select("mine", "others").mapInArrow(
        _compare_tiles(radius), "a long, b long"
    )


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE,
    shingle: int = SHINGLE,
) -> DataFrame:
    """One row per document: id, fp, component_id (smallest id reachable) and the component's own print `root_fp`.

    `root_fp` is the fingerprint of the component's first document (smallest id, then smallest print), so that
    (component_id, root_fp) names one document even where ids are null or repeated.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    found = components(links(nodes, radius, tile))
    return _known(prints, nodes.withColumn("node", F.col("fp")), found, ["fp"])


def _known(prints: DataFrame, nodes: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """The prints with their component's smallest id and the key of its first document as root_*."""
    labelled = nodes.join(found, "node", "left").select(*key, "first_id", F.coalesce("label", "node").alias("label"))
    first = labelled.groupBy("label").agg(
        F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", *key)).alias("first")
    )
    known = labelled.join(first, "label").select(
        *key, F.col("first.first_id").alias("component_id"), *(F.col(f"first.{k}").alias(f"root_{k}") for k in key)
    )
    return prints.join(known, key).select("id", *key, "component_id", *(f"root_{k}" for k in key))


def wide_print(text: str | None, shingle: int = SIMILAR_SHINGLE) -> tuple[bytes, int]:
    """256-bit SimHash of the set of shingles of a whole text, and the size of that set."""
    hashes = np.unique(shingle_hashes(text, shingle))
    return _wide_bits(hashes), len(hashes)


def _wide_bits(hashes: np.ndarray) -> bytes:
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # splitmix64
            part = (part ^ (part >> np.uint64(shift))) * np.uint64(factor)
        part = np.ascontiguousarray(part ^ (part >> np.uint64(31)))
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def radius_of(similarity: float) -> int:
    """Most differing bits of a wide print at which the estimated cosine is still `similarity`."""
    return math.floor(math.acos(similarity) / math.pi * 64 * WORDS)


def reach_of(similarity: float) -> tuple[int, int]:
    """Differing bits, of a wide print and of its first half, that sets of this Jaccard similarity do not exceed.

    The cosine is least, and a bit differs most often, where both sets have one size; majority ties of very short sets
    add up to a quarter (5 shingles against 4: 3/16 of the bits). The bits are independent: 5.5 standard deviations more.
    """
    chance = 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi
    whole, half = (math.floor(n * chance + 5.5 * math.sqrt(n * chance * (1 - chance))) for n in (64 * WORDS, 32 * WORDS))
    return whole, half


def compare_wide(
    mine: np.ndarray, others: np.ndarray, radius: int, half_radius: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two arrays of wide prints (rows of words), as places in mine followed by others.

    With `half_radius`, the first half of the words may not differ in more bits than that.
    """
    first = radius if half_radius is None else half_radius
    forest, rows = Forest(len(mine) + len(others)), max(1, BLOCK // max(1, len(others)))
    ones, ones_b = np.bitwise_count(mine).sum(1, dtype=np.int64), np.bitwise_count(others).sum(1, dtype=np.int64)
    order, order_b = np.argsort(ones, kind="stable"), np.argsort(ones_b, kind="stable")
    a, b, ones_b = mine[order], others[order_b], ones_b[order_b]
    half = WORDS // 2
    for at in range(0, len(a), rows):
        part = a[at:at + rows]
        low, high = np.searchsorted(ones_b, [ones[order[at]] - radius, ones[order[min(at + rows, len(a)) - 1]] + radius + 1])
        near = b[low:high]
        far = sum(np.bitwise_count(part[:, None, w] ^ near[None, :, w]) for w in range(half))
        u, v = np.nonzero(far <= first)
        left = far[u, v].astype(np.int64) + np.bitwise_count(part[u, half:] ^ near[v, half:]).sum(1, dtype=np.int64)
        u, v = u[left <= radius], v[left <= radius]
        if len(u):
            forest.link(order[u + at], order_b[v + low] + len(mine))
    return forest.links()


def link_sets(
    mine: list[np.ndarray], others: list[np.ndarray], similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between sets of that Jaccard similarity or more, by the intersection of every pair of fitting size."""
    forest, sizes = Forest(len(mine) + len(others)), np.array([len(x) for x in others], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    ends = np.cumsum(sizes)
    number = np.unique(np.concatenate([*mine, *(others[j] for j in order)]), return_inverse=True)[1]
    at = sum(map(len, mine))
    mark, flat, at = np.zeros(len(number) + 1, dtype=np.uint8), number[at:], 0
    for i, own in enumerate(mine):
        ids = number[at:at + len(own)]
        at += len(own)
        low = np.searchsorted(sizes, max(1, math.floor(len(own) * similarity)))
        high = np.searchsorted(sizes, math.ceil(len(own) / similarity), side="right")
        if low >= high:
            continue
        base = ends[low] - sizes[low]
        mark[ids] = 1
        shared = np.add.reduceat(mark[flat[base:ends[high - 1]]], ends[low:high] - sizes[low:high] - base, dtype=np.int64)
        mark[ids] = 0
        v = order[low + np.flatnonzero(shared / (len(own) + sizes[low:high] - shared) >= similarity)]
        if len(v):
            forest.link(np.full(len(v), i), v + len(mine))
    return forest.links()


def _tile_task(link, read):
    """A task over rows of (mine, others), arrays of (node, bytes): the links that `link` finds between what `read` reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                (node, data), (node_b, data_b) = left.values.flatten(), right.values.flatten()
                child, root = link(read(data), read(data_b))
                every = np.concatenate([node.to_numpy(), node_b.to_numpy()])
                yield pa.RecordBatch.from_arrays([pa.array(every[child]), pa.array(every[root])], names=["a", "b"])
    return run


def _prints(data: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), dtype="<u8").reshape(-1, WORDS)


def _sets(data: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u8") for x in data]


def _stamp_wide(rows: DataFrame, shingle: int, whole: bool = False) -> DataFrame:
    """The rows with `set_id`, a 128-bit hash of the shingle set, and `fp` and `size`, or the `whole` set, in place of
    the text, which is their last column."""
    fields = [T.StructField("set_id", T.BinaryType())]
    fields += [T.StructField("hashes", T.BinaryType())] if whole else [T.StructField("fp", T.BinaryType()), T.StructField("size", T.LongType())]
    schema = T.StructType([*rows.schema.fields[:-1], *fields])

    def of(text: str | None) -> tuple:
        hashes = np.unique(shingle_hashes(text, shingle))
        data = hashes.tobytes()
        set_id = xxhash.xxh3_128_digest(data)
        return (set_id, data) if whole else (set_id, _wide_bits(hashes), len(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            step = 256 if whole else len(batch)
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                made = zip(*(of(t.as_py()) for t in part.column(part.num_columns - 1)), strict=True)
                made = [pa.array(x, pa.int64() if f.name == "size" else pa.binary()) for x, f in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def _band(similarity: float) -> F.Column:
    """Sets of that Jaccard similarity are in one band of sizes or in neighbouring ones."""
    # A little wider than the similarity, so that rounding does not part two sets at the limit by two bands.
    return F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / (-math.log(similarity) * 1.0001)).cast("int")


def _candidates(nodes: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Spanning links (a, b) between nodes whose prints are near enough for that Jaccard similarity."""
    cells = nodes.select("node", "fp", _band(similarity).alias("band"))
    # A row for each band: as many as the logarithm of the longest text.
    filled = cells.groupBy("band").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = (
        cells.join(F.broadcast(filled), "band")
        .groupBy("band", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list(F.struct("node", "fp")).alias("prints"))
    )
    steps = F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band")
    sent = tiles.select(steps, "part", "prints").join(F.broadcast(filled.select("band")), "band", "left_semi")
    others = sent.groupBy("band", "part").agg(F.flatten(F.collect_list("prints")).alias("others"))
    depth = filled.select(steps, "parts").groupBy("band").agg(F.max("parts").alias("deep"))
    mine = tiles.join(F.broadcast(depth), "band").select(
        "band", F.explode(F.sequence(F.lit(0), F.col("deep") - 1)).alias("part"), F.col("prints").alias("mine")
    )
    whole, half = reach_of(similarity)
    task = _tile_task(lambda a, b: compare_wide(a, b, whole, half), _prints)
    return mine.join(others, ["band", "part"]).select("mine", "others").mapInArrow(task, "a long, b long")


def _proved(rows: DataFrame, nodes: DataFrame, near: DataFrame, similarity: float, shingle: int, tile: int) -> DataFrame:
    """Spanning links (a, b) between nodes of one candidate component whose whole sets have that Jaccard similarity."""
    ends = near.union(near.select("label", "label").distinct())
    asked = cut(nodes.join(ends, "node").select("node", "label", "size", "set_id", "first_id"))
    known = asked.where("first_id is not null").select(F.col("first_id").alias("id")).distinct()
    texts = rows.join(known, "id", "left_semi").select("t").union(rows.where("id is null").select("t"))
    sets = _stamp_wide(texts, shingle, whole=True)
    sets = cut(asked.drop("first_id").join(sets, "set_id").dropDuplicates(["node"]))
    # A component that fits one tile is one cell; a larger one has a cell for each band of sizes.
    fits = (F.count("*") <= tile) & (F.sum("size") <= SET_HASHES)
    small = sets.groupBy("label").agg(fits.alias("fits"))
    cells = sets.join(small, "label").select(
        "label", "node", "size", "hashes", F.when(F.col("fits"), 0).otherwise(_band(similarity)).alias("band"))
    parts = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") / SET_HASHES)).cast("int")
    filled = cells.groupBy("label", "band").agg(parts.alias("parts"))
    tiles = (
        cells.join(filled, ["label", "band"])
        .groupBy("label", "band", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list(F.struct("node", "hashes")).alias("sets"))
    )
    steps = F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band")
    sent = tiles.select("label", steps, "part", "sets").join(filled.select("label", "band"), ["label", "band"], "left_semi")
    others = sent.groupBy("label", "band", "part").agg(F.flatten(F.collect_list("sets")).alias("others"))
    depth = filled.select("label", steps, "parts").groupBy("label", "band").agg(F.max("parts").alias("deep"))
    mine = tiles.join(depth, ["label", "band"]).select(
        "label", "band", F.explode(F.sequence(F.lit(0), F.col("deep") - 1)).alias("part"), F.col("sets").alias("mine")
    )
    task = _tile_task(lambda a, b: link_sets(a, b, similarity), _sets)
    return mine.join(others, ["label", "band", "part"]).select("mine", "others").mapInArrow(task, "a long, b long")


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    shingle: int = SIMILAR_SHINGLE, tile: int = WIDE_TILE, set_tile: int = SET_TILE,
) -> DataFrame:
    """One row per document: id, set_id (a hash of its shingle set), component_id and root_set_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    prints = cut(_stamp_wide(rows, shingle))
    nodes = cut(
        prints.groupBy("set_id").agg(F.min("id").alias("first_id"), F.first("fp").alias("fp"), F.first("size").alias("size"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    near = components(_candidates(nodes, similarity, tile))
    found = components(_proved(rows, nodes, near, similarity, shingle, set_tile))
    return _known(prints, nodes, found, ["set_id"])


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    shingle: int = SIMILAR_SHINGLE,
) -> DataFrame:
    """One document of each group of similar ones with its own columns: the one with the smallest id.

    Rows whose id is null or repeated are matched by their shingle set as well, and repeats of one row leave one.
    """
    found = cut(similar_components(docs, id_col, text_col, similarity, shingle))
    winners = found.where(
        F.col("id").eqNullSafe(F.col("component_id")) & (F.col("set_id") == F.col("root_set_id"))
    ).select("id", "set_id").distinct()
    several = cut(found.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    alone = winners.where("id is not null").join(several, "id", "left_anti").select(F.col("id").alias("__id"))
    row_id = F.col(id_col).cast("long")
    plain = docs.join(alone, row_id == F.col("__id"), "left_semi")
    odd = docs.join(several.withColumnRenamed("id", "__id"), row_id == F.col("__id"), "left_semi").union(docs.where(row_id.isNull()))
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = odd.select(F.struct(*names).alias("__row"), row_id.alias("id"), F.col(text_col).cast("string").alias("t"))
    stamped = _stamp_wide(marked, shingle).dropDuplicates(["id", "set_id"])
    chosen = winners.select(F.col("id").alias("w_id"), F.col("set_id").alias("w_set_id"))
    match = F.col("id").eqNullSafe(F.col("w_id")) & (F.col("set_id") == F.col("w_set_id"))
    return plain.select(*names).union(stamped.join(chosen, match, "left_semi").select("__row.*"))
