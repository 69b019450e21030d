"""Near-duplicate documents by DartMinHash (operator 4).

A document is the weighted set of its runs of five words; the weight of a run is the number of its
places. Darts are points of a random process over (run, weight, rank) that is a pure function of
hashes: each run's weight axis is cut into cells [2^v - 1, 2^(v+1) - 1), and in each cell darts
arrive along the rank axis with exponential gaps. A document takes the darts under its weights up
to a rank at which about k (ln k + 2) are expected (twice that, if a coordinate got none), each dart
belongs to one of k coordinates, and the earliest dart of each coordinate is the signature. Two
signatures agree in a coordinate with the probability of the documents' weighted Jaccard similarity.

1. Equal word sequences form a class by an aggregate; one document of each goes on.
2. Bands of signature coordinates are joined: every document is linked to the smallest of its
   bucket only, and connected components of these links hold all candidate pairs.
3. Inside a component signatures are compared. Pairs whose estimate lies less than six standard errors
   below `threshold` are verified on their runs, unless links join them already, and are links if their
   exact weighted Jaccard similarity reaches it. Runs are gathered for these components only, the n-th
   place of a run as an element of its own, so that sets stand for weights. Components of up to `shard` documents are compared pair by pair in one
   task. Larger ones are dealt to shards; each shard hands on the document with the most links as a
   pivot, all documents meet all pivots, and documents that are still outside the component's
   largest class meet every shard, so that no pair outside a class stays uncompared.
4. Connected components of the verified links are the classes.

Defined results: texts without words are copies of each other; a text of fewer than five words is
one run; rows with one id and one text are one document; a class is named by its smallest id, null
ids being smaller than all (the name is null then), and an id of -2^63 counts as null; ids of other
types than whole numbers are a TypeError; a very long text is one chunk and needs memory in proportion;
ties are broken by id, then by the hash of the text; other columns are kept, those with clashing names
too; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from .common import Scratch, in_arrow, unused
from .graph import components
from .linededup import document_key, keyed, need, place_hash, place_marks, text_key

K, BANDS, ROWS = 256, 36, 7
SHINGLE = 5
THRESHOLD = 0.8
NULL_ID = -(2**63)


def unit(h: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1] from 64-bit hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, k: int = K) -> np.ndarray:
    """Signatures of weighted sets: element hashes and positive weights of each row, each element once in a row. Rows without elements get zeros.

    A coordinate keeps 16 bits of its dart's name: different darts look alike in one of 65536 cases."""
    out = np.zeros((n_rows, k), np.uint16)
    total = np.bincount(row, weight, minlength=n_rows)
    todo = np.flatnonzero(total > 0)
    darts = k * (np.log(k) + 2)
    while len(todo):
        place = np.full(n_rows, -1)
        place[todo] = np.arange(len(todo))
        mine = np.flatnonzero(place[row] >= 0)
        best = _throw(place[row[mine]], element[mine], weight[mine], darts / total[todo], len(todo), k)
        full = (best != np.uint64(2**64 - 1)).all(1)
        out[todo[full]] = (best[full] & np.uint64(0xFFFF)).astype(np.uint16)
        todo, darts = todo[~full], darts * 2
    return out


def _throw(row: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """Earliest dart of each coordinate: its rank in the upper half and its name in the lower half of 64 bits."""
    best = np.full(n_rows * k, 2**64 - 1, np.uint64)
    cell = 0
    while len(row):
        low, width = 2.0**cell - 1, 2.0**cell
        has = weight > low
        row, element, weight = row[has], element[has], weight[has]
        r, cover = row, np.minimum(1.0, (weight - low) / width)
        seed = B.mix(element + np.uint64(cell * 0x632BE59BD9B4E019 % 2**64))
        rank, most, step = np.zeros(len(r)), limit[r] * width, 0
        while len(r):
            step += 1
            dart = B.mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
            rank = rank - np.log(unit(dart))
            live = rank <= most
            r, seed, rank, most, cover, dart = r[live], seed[live], rank[live], most[live], cover[live], dart[live]
            name = B.mix(dart ^ np.uint64(0x2545F4914F6CDD1D))
            under = slice(None) if (cover >= 1).all() else unit(B.mix(name + np.uint64(3))) <= cover
            at = r[under] * k + (name[under] >> np.uint64(33)).astype(np.int64) % k
            order = (rank[under] / width).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
            np.minimum.at(best, at, order | (name[under] & np.uint64(0xFFFFFFFF)))
        cell += 1
    return best.reshape(n_rows, k)


def weighted(row: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each element of a row once, with its count."""
    if len(row) == 0:
        return row, element, np.zeros(0)
    key = B.mix(element + B.mix(row.astype(np.uint64) + np.uint64(0xABCD)))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return row[first], element[first], count.astype(float)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """(doc, hash, h1, h2, sketch): keys of the document, 128 bits of its word sequence, and the signature."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk in B.chunks(pc.utf8_lower(batch.column(2))):
            w = B.words(chunk, B.WORDLIKE)
            n = np.arange(len(w), dtype=np.uint64) - w.first[w.row].astype(np.uint64)
            sums = []
            for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(B.mix(w.hash + B.mix(n + np.uint64(salt))))))
                sums.append(B.mix(total[w.first[1:]] - total[w.first[:-1]]))
            made, row = B.shingles(w, shingle)
            sketch = signatures(*weighted(row, made), chunk.rows, k)
            cut = slice(chunk.first, chunk.last)
            none = np.diff(w.first) == 0
            data = pa.array([None if none[i] else sketch[i].tobytes() for i in range(chunk.rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0)[cut], batch.column(1)[cut], pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), data], ["doc", "hash", "h1", "h2", "sketch"])

    return in_arrow(docs, run, "doc long, hash long, h1 long, h2 long, sketch binary")


def numbered(row: np.ndarray, element: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements of each row with their repetitions numbered, so that each is there once, in ascending order; and where each row begins."""
    order = np.lexsort((element, row))
    row, element = row[order], element[order]
    fresh = np.append(True, (row[1:] != row[:-1]) | (element[1:] != element[:-1]))[: len(row)]
    nth = np.arange(len(row)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    name = B.mix(element + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return name[np.lexsort((name, row))], np.searchsorted(row, np.arange(n_rows + 1))


def run_lists(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(doc, hash, runs) of the wanted documents (doc, hash). A bit table of them keeps other documents out of the shuffle."""

    marked = place_marks(wanted.select("doc", F.col("hash").alias("place")))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(pa.array(marked.value.has(place_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy()))))
        for chunk in B.chunks(pc.utf8_lower(batch.column(2))):
            made, row = B.shingles(B.words(chunk, B.WORDLIKE), shingle)
            name, first = numbered(row, made, chunk.rows)
            runs = pa.array([name[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            cut = slice(chunk.first, chunk.last)
            yield pa.RecordBatch.from_arrays([batch.column(0)[cut], batch.column(1)[cut], runs], ["doc", "hash", "runs"])

    return in_arrow(docs, run, "doc long, hash long, runs binary").dropDuplicates(["doc", "hash"])


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two ascending lists of numbered elements have a Jaccard similarity of at least the threshold."""
    least = need(len(a), len(b), threshold)
    if min(len(a), len(b)) < least:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # merges the two
    return np.count_nonzero(both[1:] == both[:-1]) >= least


def matrix(sketches: pd.Series | list, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, k)


def band_keys(reps: DataFrame, bands: int, rows: int, k: int) -> DataFrame:
    """(band, node): one hash of each band of each signature."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            s = matrix(part.column(1).to_pylist(), k)
            h = np.zeros((len(s), bands), np.uint64)
            for i in range(rows):
                h = B.mix(h + s[:, i : bands * rows : rows].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            h = B.mix(h + np.arange(bands, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), bands))], ["band", "node"])

    return in_arrow(reps.where(F.col("sketch").isNotNull()).select("node", "sketch"), run, "band long, node long")


def agreeing(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b that agree in at least the threshold of their coordinates, and in how many, block by block."""
    step = max(1, (8 << 20) // max(1, b.size))
    least = threshold * a.shape[1] - 1e-9
    for at in range(0, len(a), step):
        same = np.count_nonzero(a[at : at + step, None, :] == b[None, :, :], axis=2)
        i, j = np.nonzero(same >= least)
        yield i + at, j, same[i, j]


def _roots(n: int) -> tuple[list[int], callable]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find


def compare_shard(pdf: pd.DataFrame, k: int, threshold: float) -> pd.DataFrame:
    """Spanning links of one shard. Rows with probe meet the others; without any, all meet all and the row with the most links, as estimated, is the pivot."""
    node, s, probe = pdf["node"].to_numpy(), matrix(pdf["sketch"].tolist(), k), pdf["probe"].to_numpy(bool)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["runs"]]
    name = np.unique(node, return_inverse=True)[1]
    loose = threshold - 6 * np.sqrt(threshold * (1 - threshold) / k)
    some = probe.any()
    mine, theirs = (np.flatnonzero(probe), np.flatnonzero(~probe)) if some else (np.arange(len(node)),) * 2
    parent, find = _roots(len(node))
    degree = np.zeros(len(node), np.int64)
    u, v = [], []
    for i, j, same in agreeing(s[mine], s[theirs], loose):
        i, j = mine[i], theirs[j]
        degree += np.bincount(i[same >= threshold * k - 1e-9], minlength=len(node))
        pairs = np.flatnonzero(name[i] != name[j] if some else i < j)
        pairs = pairs[np.argsort(-same[pairs], kind="stable")]
        for x, y in zip(i[pairs].tolist(), j[pairs].tolist(), strict=True):
            p, q = find(int(name[x])), find(int(name[y]))
            if p != q and similar(sets[x], sets[y], threshold):
                parent[max(p, q)] = min(p, q)
                u.append(node[x])
                v.append(node[y])
    top = [] if some else [node[int(np.lexsort((node, -degree))[0])]]
    return pd.DataFrame({"u": np.array([*u, *top], np.int64), "v": np.array([*v, *top], np.int64), "pivot": [False] * len(u) + [True] * len(top)})


def compared(rows: DataFrame, k: int, threshold: float) -> DataFrame:
    return rows.groupBy("label", "part").applyInPandas(lambda key, pdf: compare_shard(pdf, k, threshold).assign(label=key[0]), "u long, v long, pivot boolean, label long")


def links(nodes: DataFrame, scratch: Scratch, k: int, threshold: float, shard: int) -> DataFrame:
    """Verified links inside components. nodes: label, node, sketch, runs."""
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    many = sizes.where(F.col("n") > shard).withColumn("parts", F.ceil(F.col("n") / F.lit(shard)).cast("int"))
    dealt = nodes.join(many.drop("n"), "label", "left").withColumns({"part": F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(0)), "probe": F.lit(False)})
    dealt = scratch.keep(dealt, "dealt")
    found = scratch.keep(compared(dealt.select("label", "part", "node", "probe", "sketch", "runs"), k, threshold), "links")
    out = found.where("u <> v").select("u", "v")
    large = scratch.keep(dealt.where(F.col("parts").isNotNull()), "large")
    if large.isEmpty():
        return out

    def against(probes: DataFrame, name: str) -> DataFrame:
        """Links of the probes (label, node, sketch, parts) with all documents of their component."""
        every = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("probe", F.lit(True))
        names = ["label", "part", "node", "probe", "sketch", "runs"]
        return scratch.keep(compared(large.select(names).unionByName(every.select(names)), k, threshold).select("u", "v"), name)

    pivots = found.where("pivot").select(F.col("u").alias("node"))
    out = scratch.keep(out.union(against(large.join(pivots, "node", "left_semi"), "pivot_links")), "with_pivots")
    classes = components(out, scratch, "inner").withColumnRenamed("label", "class")
    placed = large.select("label", "node").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    counts = placed.groupBy("label", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("label").agg(F.max(F.struct("n", "class")).alias("x")).select("label", F.col("x.class").alias("class"))
    outside = placed.join(largest, ["label", "class"], "left_anti").select("node")
    probes = large.join(outside, "node", "left_semi")
    if probes.isEmpty():
        return out
    return out.union(against(probes, "outside_links"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, shingle: int = SHINGLE, k: int = K, bands: int = BANDS, rows: int = ROWS, shard: int = 1000, salts: int = 8) -> tuple[DataFrame, bool]:
    """(doc, hash, class_doc, class_hash) for each row of the table: its keys and those of its class's first document; and whether two rows have the same keys."""
    scratch = Scratch(docs.sparkSession, "dart")
    source = keyed(docs, id_col, text_col)
    prints = scratch.keep(fingerprints(source, shingle, k), "prints")
    reps = prints.groupBy("h1", "h2").agg(F.min(F.struct("doc", "hash", "sketch")).alias("f"))
    reps = scratch.keep(reps.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "f.*"), "reps")  # the written numbers are the nodes
    prints = scratch.keep(prints.drop("sketch"), "keys")
    scratch.drop("prints")
    keys = band_keys(reps, bands, rows, k)
    buckets = keys.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = keys.join(buckets, "band").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    groups = components(near, scratch, "candidates")
    nodes = scratch.keep(groups.join(reps.select("node", "doc", "hash", "sketch"), "node"), "nodes")
    nodes = nodes.join(run_lists(source, nodes, shingle), ["doc", "hash"]).select("label", "node", "sketch", "runs")
    found = components(links(nodes, scratch, k, threshold, shard), scratch, "classes")
    named = reps.select("node", "h1", "h2", "doc", "hash").join(found, "node", "left").withColumn("class", F.coalesce("label", "node")).drop("label", "node")
    first = named.groupBy("class").agg(F.min(F.struct(F.col("doc").alias("class_doc"), F.col("hash").alias("class_hash"))).alias("c"))
    named = named.select("class", "h1", "h2").join(first, "class").select("h1", "h2", "c.*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    out = prints.select("doc", "hash", "h1", "h2", F.pmod(F.xxhash64("doc", "hash"), F.lit(salts)).cast("int").alias("salt")).join(named, ["h1", "h2", "salt"])
    repeated = not prints.groupBy("doc", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return out.select("doc", "hash", "class_doc", "class_hash"), repeated


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The id of each row and class_id, the smallest id of its class."""
    found, _ = classes(docs, id_col, text_col, **options)
    kind = docs.schema[id_col].dataType
    plain = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).cast(kind)
    return found.select(plain("doc").alias(id_col), plain("class_doc").alias("class_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the first document of each class, all columns; of equal rows one."""
    found, repeated = classes(docs, id_col, text_col, **options)
    keys = unused(docs, "id", "hash")
    first = found.where((F.col("doc") == F.col("class_doc")) & (F.col("hash") == F.col("class_hash"))).select("doc", "hash").distinct().toDF(*keys)
    out = docs.withColumns({keys[0]: document_key(id_col), keys[1]: text_key(text_col)}).join(first, keys, "left_semi")
    if repeated:
        out = out.dropDuplicates(keys)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
