"""Problem 5: near-duplicate records with small edits, by tiled exact comparison.

Every record becomes a set of distinct words. Two sets A, B with Jaccard similarity >= t differ in at
most r = floor((|A| + |B|)(1 - t)/(1 + t)) words. A parity signature (each word flips one bit) changes by at
most one bit per differing word, so popcount(sig_A xor sig_B) <= r for every such pair: the comparison of
signatures loses no pair, and an exact check of the words follows. A signature has at least 1.6 bits for each
word of its set, from 256 bits on by doubling; the wider of two is folded to the narrower (its halves are
exclusive-ored), so long texts are told apart as well as short ones.

Records with equal word sets are one class and are compared once. Classes are sorted by their
population count (number of words), cut into tiles, and only tile pairs whose population counts can be
within the radius are compared, with numpy exclusive-or and bit counts. Tiles have a fixed maximal size,
so a hot group of copies (one class) or of equal sizes (several tiles) makes no large task. Partners of a tile
are the tiles from it to the last one that begins within the radius; each tile is shuffled once for every
comparison it takes part in, and the driver holds three numbers a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.components import connected_components
from weftline.session import cut

#: 64-bit words of the narrowest signature and how many words of a set it serves; wider ones serve as many times more.
WORDS, SERVES = 4, 160
#: For all pairs of a strip two words are compared, three where the radius is above the first bound, above the second
#: one for each PER_WORD of the radius: a signature must have several times as many bits as the radius.
THREE_WORDS, FOUR_WORDS, PER_WORD = 34, 60, 16
#: Rows of a tile and of a strip of it that is compared at once.
TILE_MIN, TILE_MAX, STRIP, WIDTH = 16_384, 262_144, 16, 4096


def word_sets(df: DataFrame, id_col: str, text: list[str], arrays: list[str]) -> DataFrame:
    """(id, words): distinct longest runs of letters and digits of all fields, in lower case."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text]
    parts += [F.coalesce(F.array_join(F.col(c), " "), F.lit("")) for c in arrays]
    words = F.split(F.lower(F.concat_ws(" ", *parts)), r"[^\p{L}\p{N}]+")
    return df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.array_remove(F.array_distinct(words), "").alias("words")
    )


_SIG_SCHEMA = "id long, n int, f1 long, f2 long, sig binary"


def _widths(n: np.ndarray) -> np.ndarray:
    """64-bit words of the signature of a set of n words: WORDS times the least power of two that serves it."""
    times = np.maximum(1, -(-n.astype(np.int64) // SERVES))
    return WORDS << np.ceil(np.log2(times)).astype(np.int64)


def _signatures(batches):
    for b in batches:
        ids = b.column(0)
        hashes = b.column(1)
        off = hashes.offsets.to_numpy()
        flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        n = np.diff(off).astype(np.int32)
        rows = len(n)
        if not rows:
            continue
        row = np.repeat(np.arange(rows), n)
        flat = flat[off[0] - hashes.offsets[0].as_py() :]
        width = _widths(n)
        sig: list[bytes] = [b""] * rows
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            place = np.full(rows, -1)
            place[own] = np.arange(len(own))
            mine = place[row] >= 0
            bits = int(w) * 64
            bit = (flat[mine] & np.uint64(bits - 1)).astype(np.int64)
            par = (np.bincount(place[row[mine]] * bits + bit, minlength=len(own) * bits) & 1).astype(np.uint8)
            for r, x in zip(own, np.packbits(par.reshape(len(own), bits), axis=1)):
                sig[r] = x.tobytes()
        # order-free fingerprints of the set: sums of two mixings of the 64-bit word hashes
        m1 = (flat ^ (flat >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        m2 = (flat ^ (flat >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        c1 = np.concatenate([[np.uint64(0)], np.cumsum(m1 ^ (m1 >> np.uint64(32)), dtype=np.uint64)])
        c2 = np.concatenate([[np.uint64(0)], np.cumsum(m2 ^ (m2 >> np.uint64(30)), dtype=np.uint64)])
        edge = np.concatenate([[0], np.cumsum(n)])
        f1, f2 = c1[edge[1:]] - c1[edge[:-1]], c2[edge[1:]] - c2[edge[:-1]]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(sig, pa.binary())],
            names=["id", "n", "f1", "f2", "sig"],
        )


def _last_partners(meta: list, t: float) -> list[tuple[int, int]]:
    """For each tile the last tile whose population counts can be within the radius: n <= m <= n / t. Tiles are
    numbered in order of population count, so its partners are all from it to that one."""
    meta = sorted((m["tile"], m["lo"], m["hi"]) for m in meta)
    tile, lo = [m[0] for m in meta], np.array([m[1] for m in meta], float)
    return [(a, tile[int(np.searchsorted(lo * t, hi + 1e-9, side="right")) - 1]) for a, _, hi in meta]


def _folded(sigs: bytes, rows: int, words: int) -> np.ndarray:
    """The signatures of a tile, exclusive-ored down to ``words`` 64-bit words a row."""
    s = np.frombuffer(sigs, np.uint64).reshape(rows, -1)
    return s if s.shape[1] == words else np.bitwise_xor.reduce(s.reshape(rows, -1, words), axis=1)


def _compare(t: float):
    q = (1 - t) / (1 + t)

    def run(batches):
        diff = np.empty((STRIP, WIDTH), np.uint64)
        far, add, far2 = np.empty((STRIP, WIDTH), np.uint8), np.empty((STRIP, WIDTH), np.uint8), np.empty((STRIP, WIDTH), np.uint16)
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                na, nb = np.frombuffer(x.ns_a, np.int32), np.frombuffer(x.ns_b, np.int32)
                ia, ib = np.frombuffer(x.ids_a, np.int64), np.frombuffer(x.ids_b, np.int64)
                words = min(len(x.sigs_a) // (8 * len(na)), len(x.sigs_b) // (8 * len(nb)))
                sa, sb = _folded(x.sigs_a, len(na), words), _folded(x.sigs_b, len(nb), words)
                cols: dict[int, np.ndarray] = {}
                left, right = [], []
                for s in range(0, len(na), STRIP):
                    e = min(s + STRIP, len(na))
                    # rows are sorted by population count within a tile: partners form one range
                    lo = s + 1 if x.ta == x.tb else np.searchsorted(nb, np.ceil(na[s] * t - 1e-9))
                    hi = np.searchsorted(nb, np.floor(na[e - 1] / t + 1e-9), side="right")
                    for u in range(int(lo), int(hi), WIDTH):
                        v = min(u + WIDTH, int(hi))
                        near = int((int(na[e - 1]) + int(nb[v - 1])) * q + 1e-9)
                        dense = min(words, 2 if near <= THREE_WORDS else 3 if near <= FOUR_WORDS else -(-near // PER_WORD))
                        d, g = diff[: e - s, : v - u], add[: e - s, : v - u]
                        f = (far if dense <= 3 else far2)[: e - s, : v - u]  # 192 bits fit in a byte
                        for k in range(dense):
                            if k not in cols:
                                cols[k] = np.ascontiguousarray(sb[:, k])
                            np.bitwise_xor(sa[s:e, k : k + 1], cols[k][None, u:v], out=d)
                            np.bitwise_count(d, out=g if k else f)
                            if k:
                                np.add(f, g, out=f)
                        hit = np.flatnonzero(np.less_equal(f, near, out=g.view(bool)))
                        if not len(hit):
                            continue
                        i, j = np.divmod(hit, v - u)
                        if dense < words:  # one more word thins the few that are left
                            so_far = f[i, j] + np.bitwise_count(sa[i + s, dense] ^ sb[j + u, dense])
                            i, j = i[so_far <= near], j[so_far <= near]
                        i, j = i + s, j + u
                        if x.ta == x.tb:
                            keep = j > i
                            i, j = i[keep], j[keep]
                        r = np.floor((na[i].astype(np.int64) + nb[j]) * q + 1e-9)
                        far_all = np.bitwise_count(sa[i] ^ sb[j]).sum(axis=1, dtype=np.int64)
                        keep = far_all <= r
                        left.append(ia[i[keep]])
                        right.append(ib[j[keep]])
                if left:
                    yield pd.DataFrame({"x": np.concatenate(left), "y": np.concatenate(right)})

    return run


def _pack_tile(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "id"], kind="stable")
    return pd.DataFrame(
        {
            "tile": [key[0]],
            "lo": [int(pdf.n.iloc[0])],
            "hi": [int(pdf.n.iloc[-1])],
            "sigs": [b"".join(pdf.sig)],
            "ns": [pdf.n.to_numpy(np.int32).tobytes()],
            "ids": [pdf.id.to_numpy(np.int64).tobytes()],
        }
    )


#: Bits of the filter of :func:`likely`, in rows of 2^15: 1 MB at most is broadcast.
FILTER_BITS, ROW_BITS = 1 << 23, 1 << 15


def likely(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of ``df`` whose key may be among the wanted ones, all those whose key is among them: a bitmap of their hashes,
    of fixed size, is broadcast."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    row = lambda p: F.floor(p / ROW_BITS).cast("int")
    p = place(F.col(wanted_key))
    bits = wanted.groupBy(row(p).alias("_likely_row")).agg(F.bitmap_construct_agg(p % ROW_BITS).alias("_likely_bits"))
    own = place(key)
    j = df.withColumn("_likely_row", row(own)).withColumn("_likely_at", (own % ROW_BITS).cast("int")).join(F.broadcast(bits), "_likely_row")
    byte = F.conv(F.hex(F.substring("_likely_bits", F.expr("_likely_at div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    return j.where(F.floor(byte / F.pow(F.lit(2), F.col("_likely_at") % 8)) % 2 == 1).select(*df.columns)


def near_duplicates(
    df: DataFrame,
    id_col: str = "obs_id",
    text: tuple[str, ...] = ("title", "narrative"),
    arrays: tuple[str, ...] = ("facts",),
    threshold: float = 0.7,
) -> tuple[DataFrame, DataFrame]:
    """(links, members) of all records with Jaccard similarity of word sets >= threshold.

    links (a, b, similarity): pairs of classes, a < b, each class named by its smallest id; a class is
    the group of records with equal word sets. members (id, rep, n): the class of every record that has
    words. Records without any word (all fields null or empty) are alike to nothing and are in neither.
    Nulls in a field count as empty, repeated rows of one id count once (one with several texts is alike to what
    any of them is alike to), other columns are ignored, an empty table gives two empty results. Nothing is capped: every pair within the radius is compared.
    """
    spark = df.sparkSession
    df = df.select(id_col, *text, *arrays)
    sets = word_sets(df, id_col, list(text), list(arrays)).where(F.size("words") > 0)
    hashed = sets.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    sig = cut(hashed.mapInArrow(_signatures, _SIG_SCHEMA))
    classes = sig.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.min("sig").alias("sig"))
    classes = cut(classes.select("id", "n", "sig", "f1", "f2"))
    members = (
        sig.select("id", "n", "f1", "f2")
        .join(classes.select("f1", "f2", "n", F.col("id").alias("rep")), ["f1", "f2", "n"])
        .select("id", "rep", "n")
        .distinct()
    )
    # Tiles: positions in the order of population count come from counts per population count; signatures of one
    # width form one stretch of that order, and a tile holds one width. As many rows as there are different set sizes.
    per_n = classes.groupBy("n", F.octet_length("sig").alias("width")).agg(F.count("*").alias("c"))
    earlier = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_n = per_n.withColumn("before", earlier(Window.partitionBy("width").orderBy("n")))
    total = classes.count()
    tile_rows = int(min(TILE_MAX, max(TILE_MIN, total / 48)))
    stretch = per_n.groupBy("width").agg(F.ceil(F.sum("c") / tile_rows).alias("c"))
    stretch = stretch.select("width", earlier(Window.orderBy("width")).alias("first_tile"))
    spread = classes.join(F.broadcast(per_n.join(stretch, "width").select("n", "before", "c", "first_tile")), "n")
    pos = F.col("before") + F.pmod(F.xxhash64("id"), F.col("c"))
    tiles = cut(
        spread.select((F.col("first_tile") + F.floor(pos / tile_rows)).cast("int").alias("tile"), "id", "n", "sig")
        .groupBy("tile")
        .applyInPandas(_pack_tile, "tile int, lo int, hi int, sigs binary, ns binary, ids binary")
    )
    last = _last_partners(tiles.select("tile", "lo", "hi").collect(), threshold)  # one row a tile
    todo = spark.createDataFrame(last or [(-1, -1)], "ta int, last int").select("ta", F.explode(F.sequence("ta", "last")).alias("tb"))
    tasks = max(1, sum(z - a + 1 for a, z in last))

    def side(s: str) -> DataFrame:
        blobs = tiles.select(F.col("tile").alias(f"t{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("sigs", "ns", "ids")])
        return blobs.join(F.broadcast(todo) if tasks <= 100_000 else todo, f"t{s}").repartition(tasks, "ta", "tb")

    near = cut(side("a").join(side("b"), ["ta", "tb"]).mapInPandas(_compare(threshold), "x long, y long").where("x <> y"))
    # Exact check on the words of the few rows that occur in a candidate pair.
    ends = cut(near.select(F.col("x").alias("_end")).union(near.select("y")).distinct())
    some = likely(df.where(F.col(id_col).isNotNull()), F.col(id_col).cast("long"), ends, "_end")  # few texts are shuffled
    words = word_sets(some, id_col, list(text), list(arrays)).join(ends, F.col("id") == F.col("_end"), "left_semi").distinct()
    both = F.size(F.array_intersect("wx", "wy"))
    links = (
        near.join(words.select(F.col("id").alias("x"), F.col("words").alias("wx")), "x")
        .join(words.select(F.col("id").alias("y"), F.col("words").alias("wy")), "y")
        .withColumn("common", both)
        .withColumn("similarity", F.col("common") / (F.size("wx") + F.size("wy") - F.col("common")))
        .where(F.col("similarity") >= threshold)
        .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .agg(F.max("similarity").alias("similarity"))
    )
    return links, members


def near_duplicate_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records of one class or of two linked classes. A class of k records gives
    k (k - 1) / 2 pairs, and two linked ones the product of their sizes."""
    m = members.select("id", "rep")
    side = lambda x, y: m.select(F.col("id").alias(x), F.col("rep").alias(y))
    linked = links.select("a", "b").join(side("p", "a"), "a").join(side("q", "b"), "b").select("p", "q")
    within = side("p", "rep").join(side("q", "rep"), "rep").where("p < q").select("p", "q")
    return linked.union(within).select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))


def near_duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per record; group_id is the smallest id reachable over
    links, n_links the number of other classes its class is linked to."""
    links = cut(links)
    comp = connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("group_id"))
    deg = (
        links.select(F.col("a").alias("rep"))
        .union(links.select("b"))
        .groupBy("rep")
        .agg(F.count("*").alias("n_links"))
    )
    return (
        members.join(comp, "rep", "left")
        .join(deg, "rep", "left")
        .select(
            "id",
            F.col("rep").alias("class_id"),
            F.coalesce("group_id", "rep").alias("group_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )
