"""N-gram Jaccard join by parity sketches: shingles are XOR-hashed into blocks, so two texts differ in at most as many blocks as their sets differ in shingles; sketches of a size band join on equal blocks by the pigeonhole principle, and candidates are verified on whole sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import Scratch, WordHashes, hash_words, join_each, lean, masked, materialise, mix, rolling, ship, with_rids
from lariat.llm.shared_keys import shared_keys

SHINGLE = 5
#: Two texts link when PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Up to this size a shingle is a block of its own.
SMALL = 32
#: After the star around hubs: how many of the nearest texts, by sketch, of each other component are verified in each round; then all that are left meet by blocks.
NEAREST = (2, 16)
#: A bucket is compared in blocks of at most so many texts outside its largest component by so many texts.
BLOCK = (2_000, 20_000)
#: Links are counted in blocks of about so many texts and shingles of a component.
LINK_BLOCK = (400, 500_000)
#: Columns of the matrices whose product counts common shingles.
LINK_COLUMNS = 8_192


def shingle_set(text: str | None, cache: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles; fewer words are one shingle."""
    return np.unique(rolling(hash_words(text.encode("utf-8", "surrogatepass").lower().split(), cache), k)) if text else np.empty(0, np.uint64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    m = mix(s + np.uint64(0x1234567))
    return int(m.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(m), initial=np.uint64(0)).view(np.int64))


def band_blocks(band: int) -> int:
    """Blocks of the sketch for sets of 2^band to 2^(band+1) shingles: few enough that a block holds several shingles, enough that the blocks in use outnumber the largest symmetric difference, a quarter of a set."""
    top = 2 << band
    return int(top / (3.0 if top <= 64 else 3.2 if top <= 256 else 3.5)) + 1


def sketch_keys(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, limits, in use) of a set, for each band in which it may meet a partner.

    Sets of a <= b shingles with Jaccard >= 0.8 have b <= 1.25 a and differ in (a + b) / 9 <= a / 4 shingles at most, so at least (blocks in use) - a / 4 blocks agree. A set close below a band's start joins that band too. Blocks that hold nothing count only where a set has no more than a / 4 blocks in use: then they are keys as well, last in the order.
    """
    n = len(s)
    band = n.bit_length() - 1
    out, most = [], n // 4
    for b in (band, band + 1):
        start = 1 << b
        if b > band and n * 100 < PERCENT * start:
            continue
        salt = np.uint64(b + 1)
        if start * 2 <= SMALL:
            keys = mix(s + salt)
            used, empty = len(keys), keys[:0]
        else:
            blocks = band_blocks(b)
            m = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            at = ((m >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            o = np.argsort(at, kind="stable")
            at, m = at[o], mix(s)[o]
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            parity = np.bitwise_xor.reduceat(m, starts)
            place = at[starts]
            keys = mix(mix(parity + salt) ^ (place * np.uint64(0x9E3779B97F4A7C15) + salt))
            used = len(keys)
            empty = keys[:0]
            if used <= most:
                missing = np.setdiff1d(np.arange(blocks, dtype=np.uint64), place)
                empty = mix(missing * np.uint64(0x9E3779B97F4A7C15) + salt)
        out.append((np.concatenate((keys, empty)), most, used, b))
    keys = np.concatenate([k for k, *_ in out])
    return keys >> np.uint64(16), np.concatenate([np.full(len(k), b, np.int64) for k, _, _, b in out]), np.array([len(k) for k, *_ in out])


def parity_sketch(s: np.ndarray) -> bytes:
    """XOR of one bit a shingle, in as many bits as the next power of two above the size (512 at least). The sketches' Hamming distance is at most the symmetric difference; halves XOR to the sketch of half the bits."""
    bits = max(512, 1 << len(s).bit_length())
    at = (mix(s ^ np.uint64(0x5BF03635)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(sketch: bytes, size: int) -> np.ndarray:
    words = np.frombuffer(sketch, np.uint64)
    while len(words) * 8 > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (u, v), root the smallest node of its component: alternating large and small stars, each a combined aggregate and a join, until nothing changes."""
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == mark or not now.n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row; component_id is the smallest doc_id reachable by links, n_links how many other rows link with the row, its copies among them. Without ``links`` n_links is null.

    Texts without words (null, empty, white space) have no shingles and link with nothing. Equal sets (exact copies, and repeated rows) are one class, joined once. doc_id must be integral; rows with a null doc_id are members of classes like others, and a class of null ids alone has a null component. If an id repeats with different texts, hashes stand in for ids while joining. Texts of any length are taken whole. An empty table gives no rows. Other columns are ignored whatever their names.

    Nothing about all documents reaches the driver. A block that one class alone holds goes no further; each class publishes its rarest blocks only, as many as exactness needs, so a passage or line that many texts share yields candidates only where texts have little else. A bucket is first tried as a star around one member; then texts of different components are compared by sketch and the nearest verified; what sketches still allow after that is settled by products of incidence matrices, block by block, of which a task gives a spanning forest. Links stand inside components only: there they are counted by such products, and no pair is a row.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    d = F.col(doc_id).cast("bigint")
    rows = docs.select(d.alias("id"), F.col(text).alias("text"))

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for b in batches:
            out, more = [], []
            for t in b["text"]:
                s = shingle_set(t, cache)
                out.append((len(s), *fingerprint(s)))
                more.append((parity_sketch(s), *_key_bytes(s)))
            f = np.array(out, np.int64).reshape(-1, 3)
            # Two tables: the keys go as soon as the shared ones are known.
            yield pd.DataFrame({"kind": 0, "id": b["id"], "rid": b["rid"], "size": f[:, 0], "f1": f[:, 1], "f2": f[:, 2], "sketch": None, "keys": [k for _, k, _ in more], "bands": [x for *_, x in more]})
            yield pd.DataFrame({"kind": 1, "id": None, "rid": b["rid"], "size": f[:, 0], "f1": 0, "f2": 0, "sketch": [k for k, *_ in more], "keys": None, "bands": None})

    # Ids name rows while they are unique and there is none missing; else hashes of id and text do.
    odd = rows.agg(F.count("*").alias("n"), F.count("id").alias("k")).first()
    unique = odd.n == odd.k and rows.select("id").distinct().count() == odd.n
    rid = F.col("id") if unique else F.xxhash64("id", "text")
    rows = rows.select("id", "text", rid.alias("rid"))
    read, sketched = scratch.split(rows.mapInPandas(lean(sizes), "kind int, id bigint, rid bigint, size bigint, f1 bigint, f2 bigint, sketch binary, keys binary, bands binary"), "kind", (0, 1))
    worded = read.where("size > 0")
    classes = worded.groupBy("size", "f1", "f2").agg(F.min("rid").alias("node"), F.min("id").alias("low"), F.count("*").alias("n"))
    placed = join_each(worded.select("id", "rid", "size", "f1", "f2"), classes, ["size", "f1", "f2"], "n", odd.n).select("id", "rid", "size", "node", "low")
    nothing = F.lit(None).cast("bigint")
    table = materialise(placed.unionByName(read.where("size = 0").select("id", "rid", "size", nothing.alias("node"), nothing.alias("low"))))
    nodes = table.where("node is not null").groupBy("node").agg(F.first("size").alias("size"), F.min("low").alias("low"), F.count("*").alias("rows"))
    of_row = table.where("node is not null").groupBy("rid").agg(F.min("node").alias("node"), F.min("size").alias("size"))

    shared = scratch(_shared_blocks(read, (table.agg(F.sum("size").alias("s")).first().s or 0) * 0.5))
    scratch.drop(0)
    published = scratch(_publish(shared, of_row))
    scratch.drop(2)
    total = published.count()
    met = published.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    published = scratch(join_each(published, met, ["key"], "n", total))
    scratch.drop(3)
    keys = published.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("hub"))

    members = published.select("node").distinct()
    sketches = scratch(sketched.select(F.col("rid").alias("node"), "sketch").join(members, "node").dropDuplicates(["node"]))
    scratch.drop(1)
    texts = _packed_texts(rows, members, scratch)
    tested = roots = None  # roots: node -> root so far
    for most in (0, *NEAREST):
        if most == 0:
            # A star: each text against the bucket member that most of its blocks name.
            pairs = join_each(published, keys, ["key"], "n", total).select(F.col("node").alias("x"), F.col("size").alias("sx"), F.col("hub.node").alias("y"), F.col("hub.size").alias("sy"))
            pairs = pairs.where((F.col("x") != F.col("y")) & (100 * F.least("sx", "sy") >= PERCENT * F.greatest("sx", "sy"))).groupBy("x", "y").agg(F.count("*").alias("votes"))
            pairs = pairs.groupBy("x").agg(F.max_by("y", F.struct("votes", "y")).alias("y"))
        else:
            pairs = _near(_rooted(published, roots), total, sketches, most)
            pairs = pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti")
        pairs = materialise(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not pairs.take(1):
            continue
        found = materialise(_verify(pairs, texts))
        if not found.take(1):
            continue
        roots = _joined(found.select(F.col("x").alias("u"), F.col("y").alias("v")), roots)
    left = materialise(_near(_rooted(published, roots), total, sketches, None))
    if left.take(1):
        found = materialise(_forest(left, texts))
        if found.take(1):
            roots = _joined(found, roots)
    component, n_links = nodes.select("node", F.lit(None).cast("bigint").alias("component")), F.lit(None).cast("bigint")
    if roots is not None:
        every = materialise(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
        lows = every.join(nodes, "node").groupBy("root").agg(F.min("low").alias("component"))
        component = every.join(lows, "root").select("node", "component")
    if links:
        # Of a class of n rows each links with the n - 1 others, and with all rows of the classes that its class links with.
        n_links = F.coalesce("n_links", F.lit(0)).cast("bigint")
        ends = nodes.select("node", (F.col("rows") - 1).alias("n"))
        if roots is not None:
            ends = ends.unionByName(_count_links(every.join(nodes, "node").select("node", "root", "size", "rows"), texts))
        component = ends.groupBy("node").agg(F.sum("n").alias("n_links")).join(component, "node", "left")
    # A class of many rows is joined by broadcast as well.
    described = nodes.select("node", "rows").join(component, "node", "left")
    out = join_each(table.where("node is not null"), described, ["node"], "rows", odd.n)
    last = [F.col("id").alias("doc_id"), F.col("size").alias("n_shingles")]
    out = out.select(*last, F.coalesce("component", "low", "id").alias("component_id"), n_links.alias("n_links"))
    none = table.where("node is null").select(*last, F.col("id").alias("component_id"), F.lit(0 if links else None).cast("bigint").alias("n_links"))
    out = Scratch(spark)(out.unionByName(none))
    scratch.drop()
    return out


def _rooted(published: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The published keys with each text's root so far."""
    if roots is None:
        return published.withColumn("root", F.col("node"))
    return published.join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").drop("__n").withColumn("root", F.coalesce("root", "node"))


def _joined(edges: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Roots after further links; roots so far stand for the links so far."""
    return connected(edges if roots is None else edges.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def _key_bytes(s: np.ndarray) -> tuple[bytes, bytes]:
    """The blocks of a set as six bytes each, and (band, blocks) of each of its bands."""
    if not len(s):
        return b"", b""
    keys, band, counts = sketch_keys(s)
    ends = np.cumsum(counts)
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), np.stack((band[ends - 1], counts), 1).astype("<u4").tobytes()


def _shared_blocks(read: DataFrame, total: float) -> DataFrame:
    """(key, rid, band, n) of the blocks that occur more than once, n times."""

    def emit():
        seen = set()

        def keys_of(b: pd.DataFrame):
            new = []
            for f in zip(b["f1"], b["f2"], strict=True):
                new.append(f not in seen)  # a copy in this task adds nothing
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(f)
            b = b[new]
            raw = np.frombuffer(b"".join(b["keys"]), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :6] = raw
            bands = [np.frombuffer(x, "<u4").reshape(-1, 2).astype(np.int64) for x in b["bands"]]
            # The blocks in use ride along: the publishing rule needs how many there are.
            flat = np.concatenate([*bands, np.empty((0, 2), np.int64)])
            rids = np.repeat(b["rid"].to_numpy(np.int64), [int(x[:, 1].sum()) for x in bands])
            return wide.view("<u8").ravel(), [rids, np.repeat(flat[:, 0] << 32 | flat[:, 1], flat[:, 1])]

        return keys_of

    return shared_keys(read.where("size > 0").select("rid", "f1", "f2", "keys", "bands"), emit, ["rid", "band"], total, "rid")


def _publish(shared: DataFrame, of_row: DataFrame) -> DataFrame:
    """(node, size, key): the (size / 4 + 1) rarest blocks of each class and band, without those that nobody shares."""
    # Publish the (size / 4 + 1) rarest blocks of each band; blocks that nobody shares are rarest and need no row.
    known = shared.join(of_row, "rid").select("node", "size", F.shiftright("band", 32).alias("band"), F.col("band").bitwiseAND((1 << 32) - 1).alias("used"), "key", "n").dropDuplicates(["node", "band", "key"])
    order = F.sort_array(F.collect_list(F.struct("n", "key")))
    room = F.floor(F.col("size") / 4) + 1 - (F.col("used") - F.size("keys"))
    lists = known.groupBy("node", "size", "band", "used").agg(order.alias("keys"))
    return lists.select("node", "size", F.explode(F.slice("keys", 1, F.greatest(F.lit(0), room).cast("int"))).alias("k")).select("node", "size", F.col("k.key").alias("key"))


def _near(state: DataFrame, total: int, sketches: DataFrame, most: int | None) -> DataFrame:
    """(x, y), x < y: pairs of a bucket in different components whose sizes and sketches allow a link; of each text and component the ``most`` nearest. Without ``most`` no pairs, but the texts that are in any: (bucket, node, size, root).

    Buckets with the same least member are one, so texts with many blocks in common meet once. Only texts outside a bucket's largest component are compared, with all of the bucket, inside tasks of bounded blocks: pairs that the sketches rule out are never rows.
    """
    state = materialise(state)
    open_ = state.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("node").alias("bucket"), F.count("*").alias("n")).where("a <> b").select("key", "bucket", "n")
    met = materialise(join_each(state, open_, ["key"], "n", total).select("bucket", "node", "size", "root").distinct())
    counts = met.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("k")).where("k > 1")
    n_met = met.count()
    rows = join_each(met, buckets.withColumn("n", F.col("all")), ["bucket"], "n", n_met).withColumn("outside", F.col("root") != F.col("main"))
    rows = rows.withColumns({"na": F.ceil((F.col("all") - F.col("top")) / BLOCK[0]).cast("int"), "nb": F.ceil(F.col("all") / BLOCK[1]).cast("int")})
    deal = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    # One row serves both sides where a bucket is one block, else each side's rows are dealt to its blocks.
    one = (F.col("na") == 1) & (F.col("nb") == 1)
    left = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(deal("na", 1).alias("i"), j.cast("int").alias("j"), F.lit(True).alias("a"), F.lit(False).alias("b")))).otherwise(F.array())
    right = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda i: F.struct(i.cast("int").alias("i"), deal("nb", 2).alias("j"), F.lit(False).alias("a"), F.lit(True).alias("b")))
    both = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("outside").alias("a"), F.lit(True).alias("b")))
    # Small buckets share a task's group.
    groups = max(1, n_met // 5_000)
    dealt = rows.select("bucket", "node", "size", "root", F.when(one, F.pmod(F.xxhash64("bucket"), F.lit(groups))).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("bucket"), 1)).alias("g"), F.inline(F.when(one, both).otherwise(F.concat(left, right)))).join(sketches, "node")

    nothing = pd.DataFrame({"x": [], "y": [], "r": [], "far": []}).astype("int64")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([nothing, *(one_bucket(part) for _, part in group.groupby("bucket", sort=False))])

    def one_bucket(group: pd.DataFrame) -> pd.DataFrame:
        bucket, seen = group["bucket"].iloc[0], np.zeros(len(group), bool)
        size = min(map(len, group["sketch"]))
        bits = np.stack([fold(z, size) for z in group["sketch"]])
        node, n, root = (group[c].to_numpy(np.int64) for c in ("node", "size", "root"))
        b = np.flatnonzero(group["b"].to_numpy(bool))
        out = []
        for x in np.flatnonzero(group["a"].to_numpy(bool)):
            fits = b[(root[b] != root[x]) & (100 * np.minimum(n[b], n[x]) >= PERCENT * np.maximum(n[b], n[x]))]
            far = np.bitwise_count(bits[fits] ^ bits[x]).sum(1, dtype=np.int64)
            fits, far = fits[9 * far <= n[fits] + n[x]], far[9 * far <= n[fits] + n[x]]
            if most is not None and len(fits) > most:
                o = np.lexsort((node[fits], far, root[fits]))
                fits, far = fits[o], far[o]
                starts = np.flatnonzero(np.concatenate(([True], root[fits][1:] != root[fits][:-1])))
                rank = np.arange(len(fits)) - np.repeat(starts, np.diff(np.append(starts, len(fits))))
                fits, far = fits[rank < most], far[rank < most]
            if most is None:
                seen[fits] = True
                seen[x] |= len(fits) > 0
            elif len(fits):
                out.append(np.stack((np.full(len(fits), node[x]), node[fits], root[fits], far), 1))
        if most is None:
            return pd.DataFrame({"x": node[seen], "y": n[seen], "r": root[seen], "far": bucket})
        return pd.DataFrame(np.concatenate(out), columns=["x", "y", "r", "far"]) if out else nothing

    near = dealt.groupBy("g", "i", "j").applyInPandas(compare, "x bigint, y bigint, r bigint, far bigint").distinct()
    if most is None:
        return near.select(F.col("far").alias("bucket"), F.col("x").alias("node"), F.col("y").alias("size"), F.col("r").alias("root"))
    best = near.groupBy("x", "r").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "y"))), 1, most).alias("best"))
    near = best.select("x", F.explode("best").alias("p")).select("x", "p.y")
    return near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _packed_texts(rows: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, z): compressed texts of the classes that have candidates."""

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["rid"], "z": [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in b["text"]]})

    packed = rows.select("rid", "text").mapInPandas(lean(squeeze), "node bigint, z binary")
    return scratch(packed.join(members, "node").dropDuplicates(["node"]))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link. Texts travel packed, first to the one side, then to the other; a task keeps a few of the last sets, for a hub comes many times."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        last: dict[int, np.ndarray] = {}

        def of(node: int, z: bytes) -> np.ndarray:
            if node not in last:
                if len(last) >= 64:
                    last.clear()
                last[node] = shingle_set(zlib.decompress(z).decode("utf-8", "surrogatepass"), cache)
            return last[node]

        for b in batches:
            keep = [_linked(of(x, zx), of(y, zy)) for x, y, zx, zy in zip(b["x"], b["y"], b["zx"], b["zy"], strict=True)]
            yield b.loc[keep, ["x", "y"]]

    one = pairs.join(texts.select(F.col("node").alias("x"), F.col("z").alias("zx")), "x")
    two = one.join(texts.select(F.col("node").alias("y"), F.col("z").alias("zy")), "y")
    return two.mapInPandas(lean(check), "x bigint, y bigint")


def _block_pairs(members: DataFrame, group: str, texts: DataFrame) -> DataFrame:
    """The members of each group dealt to the pairs (i, j), i <= j, of its blocks, with their texts; b is a member's own block. Small groups share a task."""
    sizes = members.groupBy(group).agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / LINK_BLOCK[0], F.col("shingles") / LINK_BLOCK[1])).cast("int").alias("blocks")
    total = members.count()
    groups = max(1, total // 1_000)
    dealt = join_each(members, sizes.select(group, "n", blocks), [group], "n", total).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("b", k.cast("int")).alias("i"), F.greatest("b", k.cast("int")).alias("j")))
    g = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(group), F.lit(groups))).otherwise(-1 - F.shiftrightunsigned(F.xxhash64(group), 1)).alias("g")
    return dealt.select(*members.columns, "b", g, F.inline(pairs)).join(texts, "node")


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets a and each of the sets b have in common: a product of incidence matrices over the shingles that two sets or more have."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    there = times[column] > 1
    row, column = row[there], number[column[there]]
    o = np.argsort(column, kind="stable")
    row, column = row[o], column[o]
    out = np.zeros((len(a), len(b)), np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, width, LINK_COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + LINK_COLUMNS))
        used = np.zeros((len(sets), min(LINK_COLUMNS, width - first)), np.float32)
        used[row[lo:hi], column[lo:hi] - first] = 1
        out += (used[a] @ used[b].T).astype(np.int64)
    return out


def _linked_blocks(group: pd.DataFrame, by: str) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """For each group of the task: its members, the places of its block i and of its block j, which of them link, and whether these are two blocks."""
    cache = WordHashes()
    for _, part in group.groupby(by, sort=False):
        sets = [shingle_set(zlib.decompress(z).decode("utf-8", "surrogatepass"), cache) for z in part["z"]]
        size, b, i, j = np.array([len(s) for s in sets]), part["b"].to_numpy(), part["i"].iloc[0], part["j"].iloc[0]
        x, y = np.flatnonzero(b == i), np.flatnonzero(b == j)
        both = _common(sets, x, y)
        linked = 100 * both >= PERCENT * (size[x, None] + size[None, y] - both)
        yield part, x, y, linked & (x[:, None] != y[None, :]), bool(i != j)


def _count_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, n): of each class of (node, root, size, rows), partial sums of the rows of the other classes that it links with. Two texts that link are in one component, so a component's texts meet block by block, each pair of blocks in a task of its own."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        nodes, sums = [], []
        for part, x, y, linked, two in _linked_blocks(group, "root"):
            node, rows = part["node"].to_numpy(np.int64), part["rows"].to_numpy(np.int64)
            nodes += [node[x]] + [node[y]] * two
            sums += [linked @ rows[y]] + [rows[x] @ linked] * two
        return pd.DataFrame({"node": np.concatenate(nodes), "n": np.concatenate(sums)})

    return _block_pairs(members, "root", texts).groupBy("g", "i", "j").applyInPandas(count, "node bigint, n bigint")


def _forest(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links between texts of (bucket, node, size, root) with different roots, as many as connect what links connect: fewer than the texts of a task."""

    def connect(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for part, x, y, linked, _ in _linked_blocks(group, "bucket"):
            node, root = part["node"].to_numpy(np.int64), part["root"].to_numpy(np.int64)
            linked &= root[x][:, None] != root[y][None, :]
            above: dict[int, int] = {}

            def top(r: int, above: dict[int, int] = above) -> int:
                while r in above:
                    above[r] = above.get(above[r], above[r])
                    r = above[r]
                return r

            for a, b in zip(*(k.tolist() for k in np.nonzero(linked)), strict=True):
                p, q = top(int(root[x[a]])), top(int(root[y[b]]))
                if p != q:
                    above[p] = q
                    out.append((int(node[x[a]]), int(node[y[b]])))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return _block_pairs(members, "bucket", texts).groupBy("g", "i", "j").applyInPandas(connect, "u bigint, v bigint").distinct()


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, the one with the smallest id; all rows without words stay. Rows with a missing or repeated id are numbered after their ids and judged each."""
    plain, restore = masked(docs, text, doc_id)
    rows = with_rids(plain, "text", "doc_id")
    found = jaccard_components(rows.select("rid", "text"), doc_id="rid", links=False)
    firsts = found.where("doc_id = component_id").select(F.col("doc_id").alias("rid"))
    return restore(rows.join(firsts, "rid", "left_semi"))
