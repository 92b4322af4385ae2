"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are 64-bit SimHashes of word shingles. Bit planes of many fingerprints are
stored vertically, one machine word holding one bit of 64 fingerprints; distances of all of
them are kept as carry-save bitwise counters that each plane updates at once, and a block is
abandoned as soon as every distance in it exceeds the radius.

Fingerprints meet in buckets. With a small radius r, masks over r + 2 bit ranges, two of
which two close fingerprints must share (pigeonhole), lose no link; fingerprints are
distinct there, so copies cost nothing; with more fingerprints the bits are cut into more ranges, of which
more must be shared, so that buckets stay small. Large buckets are dealt out as pairs of chunks, and
each comparison returns a spanning forest of its links, never all pairs.

For similarity joins on shingles (a radius too wide for pigeonholes) buckets come from
min-hash bands, and links that survive the bit-sliced radius are held against the
min-hash signatures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, signed, texts, wide_batches
from quarry.llm.components import best_forest, connected_components, stars

SEED = 42
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Members of a bucket that are compared with as many others in one task.
CHUNK = 1024
#: Bytes of texts that are held against as many others in one task.
HELD_BYTES = 1 << 24
#: How far a signature's estimate may fall short of the similarity before the exact check: at 0.8,
#: 40 of 128 two-bit values may differ, where 19.2 are expected and one pair in a million has more.
MARGIN = 0.22


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the shingles of ``width`` words, A-Z lower-cased, repeats included; fewer words
    make one shingle, no words make none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if n <= width:
        return np.array([h(joined, SEED)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    spans = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter([h(joined[i:j], SEED) for i, j in spans], np.uint64, n - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        count += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): row k holds bit k of all fingerprints, 64 to a word, padded with zeros."""
    wide = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    wide[: len(fps)] = fps
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _over(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counters are over the radius, compared from the highest plane."""
    beyond, level = np.zeros_like(counter[0]), np.full_like(counter[0], ONES)
    for w in range(len(counter) - 1, -1, -1):
        if radius >> w & 1:
            level &= counter[w]
        else:
            beyond |= level & counter[w]
            level &= ~counter[w]
    return beyond


def count_within(diff: Callable[[int, np.ndarray], np.ndarray], over: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
    """Lanes whose count of set bits over 64 planes is within the radius, and how many blocks' planes were read.

    ``diff(k, blocks)`` is plane k of the blocks (machine words of 64 lanes) that are still open; ``over`` marks the
    lanes that don't count, such as padding. Counters are held as bit planes that each plane updates at once;
    a block in which every lane is over the radius is abandoned."""
    width = max(1, radius.bit_length())
    out = np.zeros_like(over)
    blocks = np.nonzero(over != ONES)[0]
    counter, over = np.zeros((width, len(blocks)), np.uint64), over[blocks].copy()
    read = 0
    for k in range(64):
        if not len(blocks):
            break
        carry = diff(k, blocks)
        read += len(blocks)
        for plane in counter:  # half adders, lowest plane first
            carry, plane[...] = plane & carry, plane ^ carry
        over |= carry
        if k >= radius:
            over |= _over(counter, radius)
            if k % 4 == 3:
                live = over != ONES
                if not live.all():
                    blocks, over, counter = blocks[live], over[live], np.ascontiguousarray(counter[:, live])
    out[blocks] = ~over
    return out, read


def near(queries: np.ndarray, fps: np.ndarray, radius: int, upper: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, fingerprint) at most ``radius`` bits apart, by bit-sliced comparison. With ``upper`` the
    queries are the fingerprints themselves and only pairs with the smaller index first count."""
    cols = planes(fps)
    words = cols.shape[1]
    bits = np.unpackbits(queries.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    flip = [np.where(bits[:, k], ONES, np.uint64(0)) for k in range(64)]
    lanes = np.arange(words * 64)
    closed = lanes[None, :] >= len(fps) if not upper else (lanes[None, :] >= len(fps)) | (lanes[None, :] <= np.arange(len(queries))[:, None])
    closed = np.broadcast_to(closed, (len(queries), words * 64))
    over = np.packbits(closed, axis=1, bitorder="little").view(np.uint64).ravel()
    ok, _ = count_within(lambda k, blocks: cols[k][blocks % words] ^ flip[k][blocks // words], over, radius)
    hits = np.unpackbits(ok.reshape(len(queries), words).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
    return np.nonzero(hits)


def near_lanes(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs a[i], b[i] are at most ``radius`` bits apart: a pair to a lane."""
    if not len(a):
        return np.zeros(0, bool)
    cols = planes(a ^ b)
    padding = np.packbits(np.arange(cols.shape[1] * 64) >= len(a), bitorder="little").view(np.uint64)
    ok, _ = count_within(lambda k, blocks: cols[k][blocks], padding, radius)
    return np.unpackbits(ok.view(np.uint8), bitorder="little")[: len(a)].astype(bool)


#: Fingerprints of a bucket, on average and if they were random, beyond which buckets take more bits.
PER_BUCKET = 64


def ranges_for(radius: int, n: int) -> int:
    """Into how many ranges the bits are cut: those on which two close fingerprints agree have bits enough to
    tell ``n`` fingerprints apart."""
    parts = radius + 2
    while parts < 2 * radius and n > PER_BUCKET << (64 * (parts - radius) // parts):
        parts += 1
    return parts


def masks(radius: int, parts: int | None = None) -> list[int]:
    """Masks such that two fingerprints within the radius agree on all bits of at least one: all but ``radius``
    of the ``parts`` ranges (two more than the radius, if not given)."""
    parts = parts or radius + 2
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    ranges = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(parts)]
    return [sum(x) for x in combinations(ranges, parts - radius)]


def _fingerprints(width: int, minhashes: int, bands: int, rows: int):
    scale = _permutations(minhashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sigs = [], []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, width)
                if minhashes:  # similarity is that of sets
                    h = np.unique(h)
                fps.append(signed(fingerprint(h)))
                if minhashes:
                    sigs.append(signature(h, scale, bands, rows))
            out = [batch.column(0), pa.array(fps, pa.int64())]
            if minhashes:
                out += [pa.array([x[0] for x in sigs], pa.list_(pa.int64())), pa.array([x[1] for x in sigs], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "fp", "bands", "sig"][: len(out)])

    return run


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of 64 bits: with smaller ones products don't wrap, and all orders are nearly the same."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    mul, add = (rng.integers(0, (1 << 64) - 1, n, np.uint64, endpoint=True) for _ in range(2))
    return mul | np.uint64(1), add


def signature(hashes: np.ndarray, scale: tuple[np.ndarray, np.ndarray], bands: int, rows: int) -> tuple[list[int], bytes]:
    """Min-hash of the set of shingles: a hash of each band of ``rows`` values, and two bits of every
    value. No shingles have no bands."""
    mul, add = scale
    if not len(hashes):
        return [], bytes(len(mul) // 4)
    low = np.full(len(mul), 0xFFFFFFFF, np.uint64)
    folded = np.unique(hashes) >> np.uint64(32)
    for i in range(0, len(folded), 2048):
        low = np.minimum(low, ((folded[i : i + 2048, None] * mul + add) >> np.uint64(32)).min(axis=0))
    values = low.astype(np.uint32)
    keys = [signed(xxhash.xxh64_intdigest(values[k * rows : (k + 1) * rows].tobytes(), k)) for k in range(bands)]
    two = (values * np.uint32(2654435761) >> np.uint32(30)).astype(np.uint8).reshape(-1, 4)
    return keys, (two << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the two-bit values of two rows of words differ."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, minhashes: int = 0, bands: int = 0, rows: int = 0) -> DataFrame:
    """``(doc_id, fp long[, bands array<long>, sig binary])`` of every document: one narrow pass over the texts.
    With min-hashes the fingerprint too is that of the set of shingles."""
    out = "doc_id long, fp long" + ", bands array<long>, sig binary" * (minhashes > 0)
    return texts(docs, id_col, text_col).mapInArrow(_fingerprints(width, minhashes, bands, rows), out)


def _links(side: np.ndarray, fp: np.ndarray, sig: np.ndarray | None, first: int, radius: int, agree: float):
    """Links within a cell whose first row is ``first``: ``(a, b, cost)``."""
    one, two = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    q, m = near(fp[one], fp[two] if len(two) else fp[one], radius, upper=not len(two))
    a, b = one[q], (two if len(two) else one)[m]
    return _alike(a + first, b + first, sig, agree)


def _alike(a: np.ndarray, b: np.ndarray, sig: np.ndarray | None, agree: float):
    if sig is None:
        return a, b, np.zeros(len(a), np.int64)
    cost = np.zeros(len(a), np.int64)
    if len(a):
        # values that differ agree in two bits one time in four
        most = 0.75 * (1 - agree) * sig.shape[1] * 32
        cost = np.concatenate([differing(sig[a[i : i + 4096]], sig[b[i : i + 4096]]) for i in range(0, len(a), 4096)]).astype(np.int64)
        keep = cost <= most
        a, b, cost = a[keep], b[keep], cost[keep]
    return a, b, cost


def _linker(radius: int, agree: float):
    """Comparison of bucket cells. Rows come sorted by (key, i, j); side says whether a member is of
    chunk i (0) or chunk j (1); within a chunk all are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is not None:
                t = pa.Table.from_batches([batch])
                left = t if left is None else pa.concat_tables([left, t])
                if left.num_rows < 20_000:
                    continue
            if left is None or not left.num_rows:
                continue
            cell = left.column("cell").to_numpy()
            starts = np.concatenate([[0], np.nonzero(cell[1:] != cell[:-1])[0] + 1, [len(cell)]])
            if batch is not None:  # the last cell may go on
                starts = starts[:-1]
                if len(starts) < 2:
                    continue
            upto = int(starts[-1])
            part, left = left.slice(0, upto).combine_chunks(), left.slice(upto)
            node, fp = part.column("node").to_numpy(), part.column("fp").to_numpy().view(np.uint64)
            side = part.column("side").to_numpy()
            sig = None
            if "sig" in part.column_names:
                raw = part.column("sig").combine_chunks()
                sig = np.frombuffer(b"".join(raw.to_pylist()), np.uint64).reshape(len(node), -1)
            lens = np.diff(starts)
            found = []
            for s, n in zip(starts[:-1][lens >= 24], lens[lens >= 24], strict=True):
                own = slice(s, s + n)
                found.append(_links(side[own], fp[own], sig, int(s), radius, agree))
            small = np.repeat(lens < 24, lens)
            which = np.repeat(np.arange(len(lens)), lens)
            for d in range(1, 24):
                i = np.nonzero(small[:-d] & (which[:-d] == which[d:]) & ((side[:-d] == 0) & (side[d:] == 0) | (side[:-d] != side[d:])))[0] if len(which) > d else np.zeros(0, np.int64)
                if not len(i):
                    continue
                i = i[near_lanes(fp[i], fp[i + d], radius)]
                found.append(_alike(i, i + d, sig, agree))
            a, b, cost = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            if len(a):
                # rows are of one cell each, so that the forests are the cells' own
                if sig is None:
                    a, b = stars(node[a], node[b])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    continue
                a, b = best_forest(a, b, cost)
                root = np.arange(len(node))
                own, least = stars(a, b)
                root[own] = least
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[a], node[b], part.column("cell").to_numpy()[a], node[root[a]])], ["a", "b", "cell", "tree"])

    return run


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def bucket_links(members: DataFrame, radius: int, agree: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` between members ``(bucket, node, fp[, sig])`` of a bucket, a spanning forest of
    each compared cell; with signatures ``(a, b, cell, tree)``, which tree of which cell they are of. A
    bucket of more than ``chunk`` members is dealt out as pairs of
    chunks to different tasks, so no task holds more than two chunks."""
    wide_batches(members.sparkSession)
    sizes = members.groupBy("bucket").count().where("count > 1")
    met = members.join(sizes, "bucket").withColumn("n", F.ceil(F.col("count") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    cell = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    cols = ["node", "fp", *(["sig"] if "sig" in members.columns else [])]
    met = met.select(cell.alias("cell"), "side", *cols).repartition("cell").sortWithinPartitions("cell", "side")
    return met.mapInArrow(_linker(radius, agree), "a long, b long" + ", cell long, tree long" * ("sig" in members.columns))


def fingerprint_components(prints: DataFrame, radius: int) -> DataFrame:
    """``(doc_id, fp, component_id)``: documents linked through fingerprints at most ``radius`` bits
    apart. Only distinct fingerprints are compared. A null id can't be a component's name;
    such a row takes the smallest id that it reaches, or null."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.lit(0).alias("z")).select("fp", F.coalesce("node", "fp").alias("node"), F.col("node").isNull().alias("nameless")))
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks(radius, ranges_for(radius, nodes.count())))))
    members = nodes.where("not nameless").select(F.explode(keys).alias("bucket"), "node", "fp")
    found = connected_components(bucket_links(members, radius))
    named = nodes.join(found, "node", "left").select("fp", F.when(~F.col("nameless"), F.coalesce("component", "node")).alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """SimHash near-duplicate groups: ``(doc_id, fingerprint, component_id)``, one row per document.

    ``fingerprint`` is 16 lowercase hex digits. Fingerprints link at ``radius`` or fewer
    differing bits; ``component_id`` is the smallest id reachable, itself included. Null and
    empty texts have fingerprint zero and link like any other. Repeated rows share a component.
    Rows with a null id keep their fingerprint; they are linked only to equal fingerprints. An
    empty table gives no rows. Other columns are not read."""
    prints = cut(fingerprints(docs, id_col, text_col, width))
    out = fingerprint_components(prints, radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similar(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (x, s, t) in enumerate(zip(a, batch.column(2), batch.column(3), strict=True)):
                if x != last[0]:
                    last = x, np.unique(shingle_hashes(s.as_py(), width))
                other = np.unique(shingle_hashes(t.as_py(), width))
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                if both >= similarity * (len(last[1]) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return run


def exact_links(docs: DataFrame, links: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The texts ``(doc_id, text)`` of documents with links, a row an id, and the links whose documents' shingle sets
    have that Jaccard similarity."""
    ends = links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # the ids grow with the table: a merge join at every size
    own = cut(texts(docs, id_col, text_col).join(ends.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    pairs = links.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("s")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("t")), "b")
    return own, pairs.select("a", "b", "s", "t").mapInArrow(_similar(width, similarity), "a long, b long")


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text, width)).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def joining(a: np.ndarray, b: np.ndarray, label: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a[i], b[i] those that have the Jaccard similarity and join nodes that no label and
    no earlier link joins. A link is left unchecked only if its nodes are joined by then."""
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    first = np.cumsum(size) - size
    root = np.unique(label, return_inverse=True)[1]
    mark = np.zeros(len(flat), bool)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    edges = np.concatenate([[0], np.nonzero(a[1:] != a[:-1])[0] + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
    out: list[tuple[int, int]] = []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        x, ys = a[i], b[i:j]
        ys = ys[root[ys] != root[x]]
        if not len(ys):
            continue
        own, n = flat[first[x] : first[x] + size[x]], size[ys]
        mark[own] = True
        start = np.cumsum(n) - n
        both = np.add.reduceat(mark[flat[np.arange(n.sum()) + np.repeat(first[ys] - start, n)]], start, dtype=np.int64)
        mark[own] = False
        for y in ys[both >= similarity * (size[x] + n - both)]:
            if root[x] != root[y]:
                root[root == root[y]] = root[x]
                out.append((x, y))
    return np.array([x for x, _ in out], np.int64), np.array([y for _, y in out], np.int64)


def _join_tree(radius: int, agree: float, similarity: float):
    def run(part: pa.Table) -> pa.Table:
        node, fp = part.column("node").to_numpy(), part.column("fp").to_numpy().view(np.uint64)
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint64).reshape(len(node), -1)
        side, label = part.column("side").to_numpy(), part.column("label").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()]
        a, b, _ = _links(side, fp, sig, 0, radius, agree)
        a, b = joining(a, b, label, sets, similarity)
        return pa.table({"a": node[a], "b": node[b]})

    return run


def open_links(linked: DataFrame, nodes: DataFrame, forest: DataFrame, found: DataFrame, width: int, similarity: float, radius: int, agree: float) -> DataFrame:
    """The exact links ``(a, b)`` that ``forest`` leaves out and that join components of ``found``.

    Where a forest's link failed the exact check, its tree may hold nodes of several components, and
    links between them that the forest left out. In each such tree of three nodes or more (two
    have no other link) every link between different components is checked. Trees of the same nodes
    are taken once; one of much text is dealt out as pairs of chunks."""
    ends = forest.select("cell", "tree", F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = ends.join(found, "node", "left").withColumn("label", F.coalesce("component", "node"))
    key = [F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all")]
    trees = ends.groupBy("cell", "tree").agg(*key, F.min("label").alias("low"), F.max("label").alias("high"))
    trees = trees.where("n > 2 and low < high").groupBy("n", "all").agg(F.min(F.struct("cell", "tree")).alias("t")).select("t.cell", "t.tree")
    ends = cut(ends.join(trees, ["cell", "tree"]).select("cell", "tree", "node", "label"))
    wanted = ends.select(F.col("node").alias("doc_id")).distinct()
    own = linked.join(wanted.hint("merge"), "doc_id", "left_semi")  # of the linked documents' texts only
    sets = cut(own.mapInArrow(_shingle_sets(width), "node long, shingles binary"))
    held = ends.join(sets.select("node", F.octet_length("shingles").alias("bytes")), "node")
    chunks = held.groupBy("cell", "tree").agg(F.ceil(F.sum("bytes") / HELD_BYTES).cast("int").alias("n"))
    met = ends.join(chunks, ["cell", "tree"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    met = met.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    met = met.join(nodes.select("node", "fp", "sig"), "node").join(sets, "node")
    return met.groupBy("cell", "tree", "i", "j").applyInArrow(_join_tree(radius, agree, similarity), "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 24, minhashes: int = 128, bands: int = 16, rows: int = 4) -> DataFrame:
    """``(doc_id, component_id)``: documents linked when their shingle sets are alike.

    For similarities that SimHash pigeonholes can't reach: buckets are min-hash bands of ``rows``
    values; members within ``radius`` SimHash bits (bit-sliced) whose signatures of ``minhashes`` values
    come near the similarity are linked, a forest of the closest links is kept of each bucket, and each of
    these is held against the exact Jaccard similarity of the texts' shingle sets. Where one fails, the
    links that its tree left out are checked too (:func:`open_links`). Documents of equal
    signature and fingerprint are compared once. Documents without words form one group with each other;
    rows with a null id are left out. Other columns are not read."""
    prints = cut(fingerprints(docs, id_col, text_col, width, minhashes, bands, rows).where("doc_id is not null"))
    nodes = cut(prints.groupBy("fp", "sig", "bands").agg(F.min("doc_id").alias("node")))
    members = nodes.select(F.explode("bands").alias("bucket"), "node", "fp", "sig")
    agree = similarity - MARGIN
    forest = cut(bucket_links(members, radius, agree))
    near_links = cut(forest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    linked, exact = exact_links(docs, near_links, id_col, text_col, width, similarity)
    exact = cut(exact)
    found = cut(connected_components(exact))
    more = cut(open_links(linked, nodes, forest, found, width, similarity, radius, agree))
    if not more.isEmpty():
        found = connected_components(exact.unionByName(more))
    named = nodes.join(found, "node", "left").select("fp", "sig", "bands", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, ["fp", "sig", "bands"]).select("doc_id", "component_id")
