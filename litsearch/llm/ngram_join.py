"""N-gram Jaccard join by MinHash signatures in the layout of an LSH forest, read at one depth.

Documents are sets of hashed five-word shingles. Each gets ``TREES`` signatures of ``DEPTH`` minimum hashes;
a tree is the signatures in sorted order, and a prefix is a node of its trie. Starting from whole
signatures, the matched prefix is shortened until pairs at the threshold share one in some tree with at
least the target recall: 1 - (1 - s^d)^trees. That depth follows from the target alone and is the same for all
documents, so what runs is banding by prefixes of d hashes, not a descent per document: with the target a pair
may miss at any greater depth, whatever a document has met there. Documents below such a node are candidates of
each other; those whose signatures agree in enough places are joined, and each component of candidates
is verified exactly: true Jaccard similarity of all its pairs, in tiles. Links are counted there
and never written out pair by pair.

Documents with equal shingle sets are worked on once and counted as often as they occur. Large
trie nodes and components are cut into tiles of ``TILE`` documents (of ``TILE_SHINGLES`` shingles, where texts
are compared), a task per pair of tiles.

Defined results: words are separated by white space and lower-cased. A text of one to four words is
one shingle of all its words; texts without words (null, empty) are copies of each other and link
with nothing else. Repeated rows are copies. A row without id counts, but no class is named after it
unless no other is there; a class of such rows only has a null class_id. Exactly one row of each class is kept,
also where an id is repeated or missing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import components, files_like, forest, map_slices, mix, stored

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 6
TARGET = 0.9999
#: Share of agreeing hashes from which a pair goes on to exact verification; pairs at the threshold
#: fall below it with a chance of about one in a hundred million.
AGREEING = 0.6
#: Documents, and shingles of documents, that one side of a comparison holds at about.
TILE, TILE_SHINGLES = 512, 500_000
REMEMBERED = 200_000

_WORDS: dict[str, int] = {}


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> int:
    """Longest prefix with which pairs at the threshold meet in some tree often enough."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the text's runs of ``words`` words."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    new = set(found).difference(_WORDS)
    if new:
        if len(_WORDS) + len(new) > REMEMBERED:
            _WORDS.clear()
            new = set(found)
        for w in new:
            _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    size = len(h) - n + 1
    total = np.full(size, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):  # a polynomial in the words' hashes, which are scrambled already
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + size]
    return np.unique(mix(total))


_SALTS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_XOR = _SALTS.astype(np.uint32)[:, None]
_TIMES = (_SALTS >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
#: Items hashed at a time: TREES * DEPTH rows of them stay in a core's cache.
BLOCK = 512


def signature(items: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minimum hashes (32 bits each) of a set."""
    low = np.full(len(_SALTS), 0xFFFFFFFF, np.uint32)
    high = (items >> np.uint64(32)).astype(np.uint32)
    block = np.empty((len(_SALTS), BLOCK), np.uint32)
    for at in range(0, len(high), BLOCK):
        some = high[at : at + BLOCK]
        x = np.bitwise_xor(some, _XOR, out=block[:, : len(some)])
        np.multiply(x, _TIMES, out=x)
        np.minimum(low, x.min(1), out=low)
    return low


def prefix_keys(sign: np.ndarray, depth: int) -> np.ndarray:
    """Per tree one number for the first ``depth`` hashes of its signature."""
    parts = sign.reshape(TREES, DEPTH)[:, :depth].astype(np.uint64)
    h = np.arange(1, TREES + 1, dtype=np.uint64)
    for column in parts.T:
        h = mix(h ^ column)
    return h.view(np.int64)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, class_id (smallest id of the component), n_links (documents at or above the
    threshold, copies included), kept (the one document of its class that stays)."""
    depth = prefix_depth()

    def signed(got: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": got["id"], "row": got["row"], "node": [], "sign": [], "size": []}
        for text in got["text"]:
            items = shingles(text or "")
            out["node"].append(xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63))
            out["sign"].append(signature(items).tobytes() if len(items) else None)
            out["size"].append(len(items))
        return out

    rows = stored(map_slices(docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                                         F.col(text_col).alias("text")), signed,
                             "id bigint, row bigint, node bigint, sign binary, size bigint"), "signed")
    files = files_like(rows)  # no table but the shingles is larger than this one
    # the row that stays: smallest id, rows without id last
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("first")
    sets = stored(rows.groupBy("node").agg(first, F.count("*").alias("n"), F.any_value("sign").alias("sign"), F.any_value("size").alias("size"))
                  .withColumn("rep", F.col("first.id")), "sets", files)

    def keyed(got: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"node": [], "key": []}
        for node, sign in zip(got["node"], got["sign"], strict=True):
            out["node"] += [node] * TREES
            out["key"] += prefix_keys(np.frombuffer(sign, np.uint32), depth).tolist()
        return out

    leaves = stored(map_slices(sets.where("sign is not null").select("node", "sign"), keyed, "node bigint, key bigint"), "leaves")
    busy = leaves.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    below = leaves.join(busy, "key")
    # prefixes are mostly shared by few: a partition's groups stream through one Python call
    nodes_below = _dealt(below, sets.select("node", "sign")).select("key", "low", "high", "tile", "node", "sign")
    edges = stored(nodes_below.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
                   .mapInArrow(_agreeing, "a bigint, b bigint").distinct(), "agreeing", files)
    candidates = components(edges, "candidates", files)
    sized = candidates.join(sets.select("node", "rep", "n", "size"), "node")
    total = sized.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("work"))
    inside = stored(sized.drop("size").join(total, "root"), "inside", files)

    # the texts of candidates only, one per set, as shingles, with the set's number
    def itemised(got: dict[str, list]) -> dict[str, list]:
        data = [shingles(t or "").tobytes() for t in got["text"]]
        return {"node": got["node"], "found": [xxhash.xxh3_64_intdigest(d) - (1 << 63) for d in data], "data": data}

    wanted = inside.select("node", F.col("rep").alias("id")).where("id is not null")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id")
    items = map_slices(texts.select("node", "text"), itemised, "node bigint, found bigint, data binary")
    # an id that is repeated with other texts brings other sets: keep the one that is meant
    items = items.where("found = node").select("node", "data")
    # sets that only rows without id have are found by the set itself
    unnamed = map_slices(docs.where(F.col(id_col).cast("long").isNull()).select(F.lit(0).cast("long").alias("node"), F.col(text_col).alias("text")),
                         itemised, "node bigint, found bigint, data binary").select(F.col("found").alias("node"), "data")
    unnamed = unnamed.join(inside.where("rep is null").select("node"), "node", "left_semi")
    items = stored(items.unionAll(unnamed).dropDuplicates(["node"]), "shingles")
    verified = stored(_tiled(inside, items, ["root"], _verified, "a bigint, b bigint, links bigint"), "verified")
    links = verified.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(verified.where("b is not null").select("a", "b"), "classes", files)
    named = classes.join(sets.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("stays"))
    by_set = (sets.select("node", "first", "n").join(classes.join(named, "root").select("node", "stays"), "node", "left")
              .join(links, "node", "left")
              .select("node", F.coalesce("stays", "first").alias("stays"),
                      (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    return rows.select("id", "row", "node").join(by_set, "node").select(
        F.col("id").alias(id_col), F.col("stays.id").alias("class_id"), F.col("n_links").cast("long").alias("n_links"),
        (F.col("row") == F.col("stays.row")).alias("kept"))


def _dealt(members: DataFrame, data: DataFrame) -> DataFrame:
    """``members`` (with m, the size of their group, and work, its shingles, if they are to be
    compared) once per pair of tiles, with their data."""
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    if "work" in members.columns:
        # no more tiles than documents
        tiles = F.least(F.col("m").cast("int"), F.greatest(tiles, F.ceil(F.col("work") / TILE_SHINGLES).cast("int")))
    tile = F.pmod(F.xxhash64(F.lit(7), "node"), F.greatest(F.lit(1), tiles)).cast("int")
    return (members.withColumn("tile", tile).withColumn("tiles", tiles)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
            .join(data, "node"))


def _tiled(members: DataFrame, data: DataFrame, group: list[str], fn, schema: str) -> DataFrame:
    """``fn`` on every pair of tiles of every group of ``members`` (with m, the group's size)."""
    dealt = _dealt(members, data)
    columns = [c for c in ("node", "n", "tile", "low", "high", "data") if c in dealt.columns]
    return dealt.select(*group, *columns).groupBy(*group, "low", "high").applyInPandas(fn, schema)


def _sides(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    low, high = batch["low"].iloc[0], batch["high"].iloc[0]
    tile = batch["tile"].to_numpy()
    return np.flatnonzero(tile == low), np.flatnonzero(tile == high), bool(low == high)


def _forest_rows(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = forest(len(nodes), i, j)
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the pairs whose signatures agree in enough places.

    Rows come sorted by group (key, low, high). A group that goes on in the next batch is carried
    over; it holds two tiles at most.
    """
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if carried is not None:
            now = pa.concat_tables([carried, now])
        starts = _group_starts(now)
        carried = now.slice(starts[-1])
        if starts[-1]:
            yield _group_edges(now.slice(0, starts[-1]), starts)
    if carried is not None:
        yield _group_edges(carried, np.array([0, carried.num_rows]))


def _group_starts(rows: pa.Table) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for name in ("key", "low", "high"):
        column = rows.column(name).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _group_edges(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
    """Edges within the groups that lie between neighbouring ``bounds``."""
    nodes, low, high, tile = (rows.column(c).to_numpy() for c in ("node", "low", "high", "tile"))
    signs = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint32).reshape(len(nodes), -1)
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        apart = low[begin] != high[begin]  # pairs within one tile belong to that tile's own group
        for x in range(begin, end - 1):
            agree = (signs[x + 1 : end] == signs[x]).mean(1) >= AGREEING
            if apart:
                agree &= tile[x + 1 : end] != tile[x]
            y = np.flatnonzero(agree) + x + 1
            if len(y):
                i.append(np.full(len(y), x))
                j.append(y)
    known, place = np.unique(nodes, return_inverse=True)
    got = _forest_rows(known, place[np.concatenate(i)], place[np.concatenate(j)])
    return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["a", "b"])


def _verified(batch: pd.DataFrame) -> pd.DataFrame:
    """Links per document (b null) and spanning edges (links 0), by true Jaccard similarity."""
    nodes, weight = batch["node"].to_numpy(), batch["n"].to_numpy()
    a, b, same = _sides(batch)
    sets = [np.frombuffer(d, np.uint64) for d in batch["data"]]
    sizes = np.array([len(s) for s in sets])
    # number the shingles that two or more documents have; the others cannot be common
    value, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(often > 1) - 1
    shared = [common[p[often[p] > 1]] for p in np.split(place, np.cumsum(sizes)[:-1])]
    links = np.zeros(len(batch), np.int64)
    i, j = [], []
    marks = np.zeros(max(1, int((often > 1).sum())), np.int32)
    flat = np.concatenate([shared[y] for y in b]) if len(b) else np.zeros(0, int)
    lengths = np.array([len(shared[y]) for y in b], np.int64)
    owner = np.repeat(np.arange(len(b)), lengths)
    for x in a:
        marks[shared[x]] = 1
        both = np.bincount(owner[marks[flat] == 1], minlength=len(b)) if len(flat) else np.zeros(len(b), int)
        marks[shared[x]] = 0
        # J >= 0.8 as whole numbers: 5 * both >= 4 * either
        hit = 5 * both >= 4 * (sizes[x] + sizes[b] - both)
        hit &= b != x
        links[x] += weight[b[hit]].sum()
        if not same:
            links[b[hit]] += weight[x]
        i.append(np.full(int(hit.sum()), x))
        j.append(b[hit])
    e = _forest_rows(nodes, np.concatenate(i).astype(int), np.concatenate(j).astype(int)) if i else (nodes[:0], nodes[:0])
    return pd.DataFrame({"a": np.r_[nodes, e[0]], "b": pd.array([None] * len(nodes) + e[1].tolist(), "Int64"),
                         "links": np.r_[links, np.zeros(len(e[0]), np.int64)]})
