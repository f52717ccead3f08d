"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared only inside tiles. A tile holds the fingerprints that
agree on all but ``radius`` of some blocks of bits (a pair within the radius
agrees on such a choice of blocks, so no link is lost) and whose population
count lies in one band of ``radius + 1`` values; those of the band below visit
it. Tile pairs with counts further apart are thus never met. Inside a tile numpy takes
exclusive-or and bit counts. A tile with over ``tile_rows`` rows is dealt again
by more bits, which bounds it by the few bits left open.

64 bits cannot tell texts whose 5-word shingles have a similarity of 0.8 from
less similar ones. ``keep_one`` therefore takes 256 bits. Its tiles hold the
fingerprints that agree on one of the twenty blocks of 12 bits they are cut into,
however many texts there are: two texts of similarity 0.8, which differ in 15% of
bits, share a tile with a probability of 95%, and of over 99.9% from 0.9 on. The
blocks are the same for every input, so whether two texts meet does not depend on
the number of others; tiles grow with it, and comparisons with its square. A tile
with over ``slice_rows`` rows is cut into slices, and each pair of slices is compared.

Such links are only candidates. Texts that agree on one of ``BANDS`` bands of
``BAND`` least shingle hashes are candidates too, whatever their fingerprints.
Of pairs with similarity 0.8 the bands miss 0.007%, the tiles and the radius
about 20%. The distinct texts of each component of
candidates meet with their sets of shingles, and only links of exact similarity
``SIMILARITY`` or more make the components by which texts go. A component with
over ``SLICE`` shingles is cut into slices, and each pair of slices meets in a task
of its own, so a task's memory does not grow with a component.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flagged, map_rows, materialize, read_table, whole_row
from .components import connected_components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: For near copies. Similarity 0.8 is expected at 39 of 256 differing bits, 0.7 at 49, 0.6 at 59.
WIDE_SHINGLE, WIDE_RADIUS, WIDE = 5, 44, ("f0", "f1", "f2", "f3")
#: Bits of a block, on all inputs.
BLOCK = 12
#: Shingles that a slice of a component of candidates holds when it is verified.
SLICE = 1 << 21
#: Least Jaccard similarity of the shingle sets of near copies.
SIMILARITY = 0.8
#: Two texts of similarity s share none of the bands with a probability of (1 - s ** BAND) ** BANDS.
BAND, BANDS = 5, 24
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BAND * BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a UTF-8 text; 0 if it has no word."""
    from xxhash import xxh64_intdigest as h

    words = (text or b"").lower().split()
    if words and len(words) < shingle:
        return h(b" ".join(words), seed)
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for values in _hashes(words, shingle, seed):
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if words else 0


def wide_fingerprint(text: bytes | None, shingle: int = WIDE_SHINGLE, seed: int = SEED) -> np.ndarray:
    """256-bit SimHash of a UTF-8 text as four integers, 0 if it has no word. Each is over the shingle hashes mixed in its own way."""
    words = (text or b"").lower().split()
    counts, n = np.zeros(64 * len(WIDE), np.int64), max(1, len(words) - shingle + 1)
    for values in _hashes(words, min(shingle, len(words)), seed) if words else ():
        x = values[:, None] * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype="<u8")
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")


def shingle_set(text: bytes | None, shingle: int = WIDE_SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    return np.unique(np.concatenate([*_hashes(words, min(shingle, len(words)), seed)])) if words else np.zeros(0, "<u8")


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash for each band of the least mixed hashes of a shingle set; none for an empty set."""
    from xxhash import xxh64_intdigest as h

    if not len(shingles):
        return np.zeros(0, "<u8")
    least = np.full(BAND * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        x = (shingles[at : at + 512, None] ^ _MIX[0]) * _MIX[1]
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
    return np.array([h(b.tobytes(), k) for k, b in enumerate(least.astype("<u8").reshape(BANDS, BAND))], dtype="<u8")


def _hashes(words: list[bytes], shingle: int, seed: int):
    """Hashes of the shingles, in arrays of bounded size."""
    from xxhash import xxh64_intdigest as h

    join, n = b" ".join, len(words) - shingle + 1
    for at in range(0, n, 65_536):
        part = words[at : at + 65_536 + shingle - 1]
        yield np.array([h(join(s), seed) for s in zip(*(part[k:] for k in range(shingle)), strict=False)], dtype="<u8")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every row of ``docs``; a null text has no word."""

    def rows(source):
        for r in source:
            fp = fingerprint(r["text"], shingle, seed)
            yield r["doc_id"], fp - (1 << 64) if fp >> 63 else fp

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, fp long")


def _key() -> Column:
    return F.xxhash64(F.col("text"), F.lit(1), F.col("doc_id").cast("long"))


def _masks(blocks: int, radius: int) -> list[int]:
    """Masks of all choices of ``blocks - radius`` of ``blocks`` blocks of the 64 bits, as signed longs."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(blocks)]
    out = [sum(c) for c in combinations(one, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _tiles(fps: DataFrame, blocks: int, radius: int) -> DataFrame:
    """A row for each tile a fingerprint belongs to (own) or visits."""

    def tile(k: int, mask: int, above: int) -> Column:
        band = F.floor(F.bit_count("fp") / (radius + 1))
        key = F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask).cast("long")), band + F.lit(above))
        return F.struct(key.alias("tile"), F.lit(above == 0).alias("own"))

    rows = [tile(k, m, d) for k, m in enumerate(_masks(blocks, radius)) for d in (0, 1)]
    return fps.select("fp", F.explode(F.array(*rows)).alias("t")).select("t.tile", "t.own", "fp")


def _components_in(x: np.ndarray, radius: int, block: int = 1024) -> np.ndarray:
    """For each of the fingerprints, the place of the least linked one, by comparing blocks pairwise."""
    order = np.argsort(np.bitwise_count(x), kind="stable")
    y, counts = x[order], np.bitwise_count(x[order]).astype(np.int16)
    label, starts = np.arange(len(y)), range(0, len(y), block)
    while True:
        old = label.copy()
        for i in starts:
            for j in starts:
                if j < i or counts[j] - counts[min(i + block, len(y)) - 1] > radius:
                    continue
                a, b = slice(i, i + block), slice(j, j + block)
                near = np.bitwise_count(y[a, None] ^ y[None, b]) <= radius
                far = len(y)
                label[a] = np.minimum(label[a], np.where(near, label[None, b], far).min(axis=1))
                label[b] = np.minimum(label[b], np.where(near, label[a, None], far).min(axis=0))
        while (label != label[label]).any():
            label = label[label]
        if (label == old).all():
            break
    out = np.empty_like(label)
    out[order] = order[label]
    return out


def _compare(rows: DataFrame, radius: int, small: int = 16) -> DataFrame:
    """Links ``a, b`` of each tile: all pairs of a small tile, of a larger one a star for each of its components."""

    def links(tile: np.ndarray, fp: np.ndarray):
        fp = fp[:, 0]
        ends = np.flatnonzero(np.append(tile[1:] != tile[:-1], True)) + 1
        starts = np.append(0, ends[:-1])
        length = np.repeat(ends - starts, ends - starts)
        a, b = [], []
        for d in range(1, min(small, len(fp))):
            i = np.flatnonzero((tile[d:] == tile[:-d]) & (length[d:] <= small))
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
            a.append(fp[i])
            b.append(fp[i + d])
        for s, e in zip(starts, ends, strict=True):
            if e - s > small:
                x = np.unique(fp[s:e])
                root = _components_in(x, radius)
                i = np.flatnonzero(root != np.arange(len(x)))
                a.append(x[i])
                b.append(x[root[i]])
        return (np.concatenate(a)[:, None], np.concatenate(b)[:, None]) if a else (fp[:0, None], fp[:0, None])

    return _by_tile(rows, ("fp",), links, "a long, b long")


def _by_tile(rows: DataFrame, parts: tuple[str, ...], find: Callable, schema: str) -> DataFrame:
    """Applies ``find`` to whole tiles: arrays of tiles and of fingerprints, a column for each of ``parts``, give two of linked fingerprints."""

    def run(batches):
        def out(held):
            tile, fp = (np.concatenate(p) for p in zip(*held, strict=True))
            columns = [np.ascontiguousarray(c) for side in find(tile, fp) for c in side.T]
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=names)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            tile = batch.column(0).to_numpy()
            fp = np.stack([batch.column(k + 1).to_numpy().view(np.uint64) for k in range(len(parts))], axis=1)
            if not len(tile):
                continue
            last = int(np.searchsorted(tile, tile[-1], side="left"))  # the last tile may go on in the next batch
            if last or held and held[-1][0][-1] != tile[0]:
                yield out([*held, (tile[:last], fp[:last])])
                held = []
            held.append((tile[last:], fp[last:]))
        if held:
            yield out(held)

    names = [f.split()[0] for f in schema.split(", ")]
    parted = rows.select("tile", *parts).repartition("tile").sortWithinPartitions("tile")
    return parted.mapInArrow(run, schema)


def _stars(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Every wide fingerprint but the first of each component, and that first one.

    A component is searched from its first member. Those found leave the rows
    still to compare, so a dense group costs little more than its size. Rows
    whose population counts differ by more than the radius are not compared.
    """
    count = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    order = np.argsort(count, kind="stable")
    x, count = x[order], count[order]
    # The rows left, word by word: a comparison then runs over whole columns.
    left, words, bits, a, b = np.arange(len(x)), np.ascontiguousarray(x.T), count, [x[:0]], [x[:0]]
    while len(left) > 1:
        root, front = left[0], [left[0]]
        left, words, bits = left[1:], words[:, 1:], bits[1:]
        while front and len(left):
            now = front.pop()
            lo, hi = np.searchsorted(bits, (count[now] - radius, count[now] + radius + 1))
            far = np.zeros(hi - lo, np.uint16)
            for column, own in zip(words, x[now], strict=True):
                far += np.bitwise_count(column[lo:hi] ^ own)
            near = lo + np.flatnonzero(far <= radius)
            if len(near):
                hit = left[near]
                a.append(x[hit])
                b.append(np.broadcast_to(x[root], (len(hit), x.shape[1])))
                front.extend(hit.tolist())
                stays = np.ones(len(left), bool)
                stays[near] = False
                left, words, bits = left[stays], words[:, stays], bits[stays]
    return np.concatenate(a), np.concatenate(b)


def _node() -> Column:
    return F.xxhash64(*WIDE)


def block_bits(n: int) -> int:
    """Bits of a block with which a tile of ``n`` fingerprints is expected to hold at most 512, 12 at least.

    For callers of ``wide_links`` who would rather lose links than compare more;
    ``near_classes`` does not use it, as its results would follow the number of texts.
    """
    return min(32, max(12, math.ceil(math.log2(max(n, 1) / 512))))


def wide_links(fps: DataFrame, radius: int = WIDE_RADIUS, slice_rows: int = 16_384, small: int = 256, bits: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between hashes of the distinct wide fingerprints ``fps`` that share a tile of ``bits`` equal bits and lie within ``radius`` bits."""
    per = 64 // bits
    blocks = [F.struct(F.lit(w * per + k).cast("long").alias("block"), F.shiftrightunsigned(f, bits * k).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("bits")) for w, f in enumerate(WIDE) for k in range(per)]
    rows = fps.select(*WIDE, F.explode(F.array(*blocks)).alias("t")).select(*WIDE, (F.col("t.block") * (1 << bits) + F.col("t.bits")).alias("place"))
    # Tiles of one slice, by far the most, need no table of sizes.
    heavy = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > slice_rows).select(F.col("place").alias("heavy"), F.ceil(F.col("n") / slice_rows).alias("s"))
    heavy = materialize(heavy, "heavy")
    cut = F.coalesce("s", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64(*WIDE, F.lit(1)), cut)
    dealt = rows.join(heavy, F.col("place") == F.col("heavy"), "left").withColumn("s", cut).select("place", *WIDE, own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("other"))
    tiles = dealt.select(F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), *WIDE)

    def find(tile: np.ndarray, fp: np.ndarray):
        ends = np.flatnonzero(np.append(tile[1:] != tile[:-1], True)) + 1
        a, b = [fp[:0]], [fp[:0]]
        for s, e in zip(np.append(0, ends[:-1]), ends, strict=True):
            x = fp[s:e]
            if 1 < len(x) <= small:  # most tiles hold no link; one comparison of all settles them
                far = np.zeros((len(x), len(x)), np.uint16)
                for column in x.T:
                    far += np.bitwise_count(column[:, None] ^ column[None])
                x = x[(far <= radius).sum(axis=1) > 1]
            if len(x) > 1:
                for held, part in zip((a, b), _stars(x, radius), strict=True):
                    held.append(part)
        return np.concatenate(a), np.concatenate(b)

    found = _by_tile(tiles, WIDE, find, ", ".join(f"{side}{f} long" for side in "ab" for f in WIDE))
    return found.select(*[F.xxhash64(*[f"{side}{f}" for f in WIDE]).alias(side) for side in "ab"])


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = 8192) -> DataFrame:
    """Links that join all distinct fingerprints within ``radius`` bits, perhaps by way of others of them."""
    blocks, fine_blocks = radius + 2, radius + 6
    rows = materialize(_tiles(fps, blocks, radius), "tiles")
    sizes = rows.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("own")).where("n > 1 and own > 0")
    heavy = materialize(sizes.where(F.col("n") > tile_rows).select("tile"), "heavy")
    if heavy.isEmpty():
        return _compare(rows, radius)
    again = materialize(rows.join(heavy, "tile", "left_semi").select("fp").distinct(), "again")
    return _compare(rows.join(heavy, "tile", "left_anti"), radius).union(_compare(_tiles(again, fine_blocks, radius), radius))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the least ``doc_id`` reachable by links. Rows with a
    null ``doc_id`` take part and get the component's least id, null if it has
    none. Repeated rows are repeated in the result. A text that is null, empty
    or only white space has fingerprint zero; a bit set in exactly half the
    shingles is 0. Texts of any length count whole. No rows give no rows. Other
    columns of ``docs`` are ignored.
    """
    each = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(links(distinct.select("fp"), radius))
    members = materialize(found.join(distinct, found["node"] == distinct["fp"]).select("fp", "root", "least"), "members")
    least = materialize(members.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    joined = members.join(least, "root").select("fp", "component_id")
    lookup = materialize(distinct.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "lookup")
    return each.join(lookup, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_roots(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each of the sets, none empty, the place of the first one it is joined to by links of that Jaccard similarity.

    A component is searched from its first member, and those found leave the
    sets still to compare.
    """
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    root, left, flat, mark = np.arange(len(sets)), np.arange(len(sets)), ids, np.zeros(ids.max() + 1, bool)
    while len(left):
        first, front = left[0], [left[0]]
        left, flat = left[1:], flat[size[left[0]] :]
        while front and len(left):
            now = front.pop()
            own = ids[ends[now] - size[now] : ends[now]]
            mark[own] = True
            both = np.add.reduceat(mark[flat], np.cumsum(size[left]) - size[left], dtype=np.int64)
            mark[own] = False
            near = both >= similarity * (size[left] + size[now] - both) - 1e-9
            if near.any():
                root[left[near]] = first
                front.extend(left[near].tolist())
                flat = flat[np.repeat(~near, size[left])]
                left = left[~near]
    return root


def _candidates(texts: DataFrame, radius: int) -> DataFrame:
    """Edges ``a, b`` between the nodes of ``texts`` that may be similar, perhaps by way of others."""
    rows = materialize(texts.select("node", F.explode("buckets").alias("bucket")), "buckets")
    shared = materialize(rows.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("bucket", "least"), "shared")
    stars = rows.join(shared, "bucket").select(F.col("node").alias("a"), F.col("least").alias("b")).where("a <> b")
    first = materialize(texts.groupBy(_node().alias("fp")).agg(F.min("node").alias("least")), "first")
    found = materialize(wide_links(texts.select(*WIDE).distinct(), radius, bits=BLOCK).distinct(), "links")
    ends = [first.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_least")) for x in "ab"]
    return stars.union(found.join(ends[0], "a").join(ends[1], "b").select("a_least", "b_least"))


def _verified(docs: DataFrame, each: DataFrame, loose: DataFrame, shingle: int, seed: int, similarity: float, most: int) -> DataFrame:
    """``node, top`` of every text of the components ``loose``: one top for those joined by links of exact similarity."""
    reps = materialize(each.groupBy("node").agg(F.min("key").alias("rep"), F.max("size").alias("size")).join(loose, "node"), "reps")
    asked = flagged(docs.select("text", _key().alias("key")), F.col("key"), reps, "rep").where("_flag").select("text", "key")

    def rows(source):
        for r in source:
            yield r["key"], shingle_set(r["text"], shingle, seed).tobytes()

    heavy = reps.groupBy(F.col("root").alias("r")).agg(F.sum("size").alias("total")).where(F.col("total") > most).select("r", F.ceil(F.col("total") / most).alias("s"))
    heavy = materialize(heavy, "heavy")
    cut = F.coalesce("s", F.lit(1).cast("long"))
    placed = reps.join(heavy, F.col("root") == F.col("r"), "left").select("node", "rep", "root", cut.alias("s")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("s")))
    sets = map_rows(asked, rows, "key long, shingles binary").join(placed, F.col("key") == F.col("rep"))
    sets = sets.select("node", "shingles", "root", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("other"))
    sets = sets.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "node", "shingles")

    def run(batches):
        def out(held):
            sets = {n: np.frombuffer(s, "<u8") for n, s in held if s}
            nodes = list(sets)
            roots = similar_roots(list(sets.values()), similarity) if nodes else []
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([nodes[k] for k in roots], pa.int64())], names=["node", "top"])

        part, held = None, []
        for batch in batches:
            for p, n, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part and held:
                    yield out(held)
                    held = []
                part = p
                held.append((n, s))
        if held:
            yield out(held)

    found = materialize(sets.repartition("part").sortWithinPartitions("part").mapInArrow(run, "node long, top long"), "verified")
    if heavy.isEmpty():
        return found
    joined = connected_components(found.where("node <> top"), "node", "top")
    alone = found.select("node").distinct().join(joined.select("node"), "node", "left_anti")
    return materialize(joined.select("node", F.col("root").alias("top")).union(alone.select("node", F.col("node").alias("top"))), "joined")


def near_classes(docs: DataFrame, shingle: int = WIDE_SHINGLE, radius: int = WIDE_RADIUS, seed: int = SEED, similarity: float = SIMILARITY, most: int = SLICE) -> DataFrame:
    """``doc_id, key, root`` of every row of ``docs``: rows with one root are near copies, ``key`` is a hash of id and text.

    A null, empty or white text has no shingle and is like others of its kind; a
    text of fewer words is one shingle. Rows with null or repeated ids take part,
    no rows give no rows, texts of any length count whole, other columns are
    ignored.
    """

    def rows(source):
        from xxhash import xxh64_intdigest as h

        for r in source:
            node, own = h(b" ".join((r["text"] or b"").lower().split()), seed), shingle_set(r["text"], shingle, seed)
            yield r["doc_id"], r["key"], node - (1 << 64) if node >> 63 else node, *wide_fingerprint(r["text"], shingle, seed).view(np.int64).tolist(), len(own), bands(own).view(np.int64).tolist()

    asked = docs.select(F.col("doc_id").cast("long"), "text", _key().alias("key"))
    each = materialize(map_rows(asked, rows, "doc_id long, key long, node long, f0 long, f1 long, f2 long, f3 long, size long, bands array<long>"), "fingerprints")
    # All rows of a node have equal fingerprints and bands, so the row of the least key stands for them.
    reps = each.groupBy("node").agg(F.min("key").alias("key"))
    texts = materialize(each.join(reps, ["node", "key"], "left_semi").dropDuplicates(["node"]).select("node", *WIDE, F.concat("bands", F.array(_node())).alias("buckets")), "texts")
    loose = connected_components(_candidates(texts, radius))
    found = _verified(docs, each, loose, shingle, seed, similarity, most)
    return each.select("doc_id", "key", "node").join(found, "node", "left").select("doc_id", "key", F.coalesce("top", "node").alias("root"))


def keep_one(docs: DataFrame, shingle: int = WIDE_SHINGLE, radius: int = WIDE_RADIUS, seed: int = SEED, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the least ``doc_id`` stays, null last.

    Of rows equal in id and text one stays. Rows that only share an id are
    judged each by its own text. Null, empty and white texts are copies of each
    other. No rows give no rows, texts of any length are compared whole, other
    columns stay as they are. Texts are moved only where a bitmap of fixed size says that their row
    may have to go.
    """
    found = materialize(near_classes(docs, shingle, radius, seed, similarity), "classes")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = materialize(best.select("root", F.col("b.key").alias("best")), "best")
    others = materialize(found.join(best, "root").select(F.col("key").alias("gone"), (F.col("key") == F.col("best")).alias("stays")).distinct(), "others")
    keyed = flagged(docs.select(_key().alias("key"), whole_row(docs)), F.col("key"), others, "gone")
    asked = keyed.where("_flag").join(others, F.col("key") == F.col("gone"), "left").where("stays is null or stays")
    twice = asked.where("stays").dropDuplicates(["key"])
    return keyed.where("not _flag").select("row.*").union(asked.where("stays is null").select("row.*")).union(twice.select("row.*"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
