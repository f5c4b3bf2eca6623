"""N-gram Jaccard join: a metric-space join of shingle sets under the Jaccard distance, exact.

Documents that share nothing are all at distance 1 from each other, so regions around whole documents would put nearly every
document on every boundary.  The first level therefore takes single shingles as pivots: a set is at distance
``1 - 1/|x|`` from each of its shingles and at 1 from any other, so it lies in the regions of its own shingles only.  A partner at
distance 0.2 or less misses at most a fifth of a set, so the window in which a document must be replicated is its rarest
``|x| - ceil(0.8 |x|) + 1`` shingles: by the triangle inequality a pair within the distance meets in one of these regions.
Rarest first means that the window of most documents holds only shingles nobody else has, and they leave at once.

Regions that overlap are joined as one.  Inside, pivots are documents: links to a pivot are found directly, and a pair that is
not yet connected is compared only where ``|d(x, p) - d(y, p)|`` is within the distance for every pivot.  A region above
``REGION_TOKENS`` is not given to one task: each round compares all its documents, wherever they lie, with a few pivots, and
recurses on the documents outside the largest component plus the boundary documents inside their window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.graph import components
from tidemark.llm.store import stage

SHINGLE = 5
NEAR = 80  # per cent
BITS = 48  # of a shingle's hash
CHUNK = 1_000_000  # shingles of a chunk that a task sorts at a time
CHUNK_DOCS = 60_000
MEMO = 300_000  # words whose hashes a task remembers
PIVOTS = 16
REGION_TOKENS = 200_000

MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


class WordHashes(dict):
    """word bytes -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes | None, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words are one sequence."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and only [\x20\x09-\x0D] separate
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = (out ^ hashes[j : j + len(out)]) * MIX[j]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def needed(n):
    """Shingles of a set of n that a partner must share: ceil(0.8 n)."""
    return -(-n * NEAR // 100)


def _planes(values: np.ndarray) -> bytes:
    """Sorted integers as byte planes of their differences: high planes are nearly empty and compress well."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    width = max(1, int(np.flatnonzero(gaps.any(axis=0)).max(initial=0)) + 1)
    return bytes([width]) + np.ascontiguousarray(gaps[:, :width].T).tobytes()


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, : raw[0]] = np.frombuffer(raw, np.uint8, n * raw[0], 1).reshape(raw[0], n).T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def scatter(buckets: int):
    """docs (doc_id, row, text bytes) -> packets (dest, batch, bucket, payload).

    A chunk of documents becomes one packet per bucket of the hash space (bucket -1: the documents themselves).
    A set that the task has already sent is sent as a document without shingles.
    """

    def packet(dest, batch, bucket, payload):
        return {"dest": dest, "batch": batch, "bucket": bucket, "payload": payload}

    def flush(batch: int, docs: list, sets: list) -> list[dict]:
        meta = np.array([(0 if d is None else d, d is None, row, n, a, b) for d, row, n, a, b in docs],
                        dtype=[("doc", "<i8"), ("none", "?"), ("row", "<i8"), ("n", "<i8"), ("a", "<i8"), ("b", "<i8")])
        out = [packet(batch % buckets, batch, -1, meta.tobytes())]
        filled = [(i, s) for i, s in sets if len(s)]
        if filled:
            values = np.concatenate([s for _, s in filled]) >> np.uint64(64 - BITS)
            owner = np.repeat(np.array([i for i, _ in filled], np.uint16), [len(s) for _, s in filled])
            bucket = (values % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((values, bucket))
            values, owner, bucket = values[order] // np.uint64(buckets), owner[order], bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            for lo, hi in zip(at, np.append(at[1:], len(bucket))):
                out.append(packet(int(bucket[lo]), batch, int(bucket[lo]), int(hi - lo).to_bytes(4, "little") + owner[lo:hi].tobytes() + _planes(values[lo:hi])))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, seq = WordHashes(), set(), 0
        first = TaskContext.get().partitionId() << 24
        schema = pa.schema([("dest", pa.int32()), ("batch", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
        docs, sets, held = [], [], 0
        for batch in batches:
            for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tokens = shingle_set(text, memo)
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                a, b = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
                docs.append((doc, row, len(tokens), a, b))
                if digest not in seen:
                    seen.add(digest)
                    sets.append((len(docs) - 1, tokens))
                    held += len(tokens)
                if held >= CHUNK or len(docs) >= CHUNK_DOCS:
                    yield pa.RecordBatch.from_pylist(flush(first + seq, docs, sets), schema)
                    docs, sets, held, seq = [], [], 0, seq + 1
        if docs:
            yield pa.RecordBatch.from_pylist(flush(first + seq, docs, sets), schema)

    return run


def _runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of equal keys, across batches."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            value = tuple(row[k] for k in keys)
            if rows and value != now:
                yield now, rows
                rows = []
            now = value
            rows.append(row)
    if rows:
        yield now, rows


def count_shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets sorted by bucket -> the same chunks with only the shingles that two sets or more hold, and how many hold them."""
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
    for (bucket,), rows in _runs(batches, "bucket"):
        if bucket < 0:
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)
            continue
        sizes = [int.from_bytes(r["payload"][:4], "little") for r in rows]
        owner = np.concatenate([np.frombuffer(r["payload"], "<u2", n, 4) for r, n in zip(rows, sizes)])
        values = np.concatenate([_unplanes(r["payload"][4 + 2 * n :], n) for r, n in zip(rows, sizes)])
        chunk = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(values, kind="stable")
        sorted_ = values[order]
        at = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        held = np.diff(np.append(at, len(sorted_)))
        df = np.empty(len(values), np.uint32)
        df[order] = np.repeat(held, held)
        keep = df > 1
        values, owner, chunk, df = values[keep], owner[keep], chunk[keep], df[keep]
        ends = np.searchsorted(chunk, np.arange(len(rows) + 1))
        out = [{"batch": r["batch"], "bucket": bucket, "payload": int(hi - lo).to_bytes(4, "little") + owner[lo:hi].tobytes() + df[lo:hi].tobytes() + values[lo:hi].tobytes()}
               for r, lo, hi in zip(rows, ends[:-1], ends[1:]) if hi > lo]
        yield pa.RecordBatch.from_pylist(out, schema)


def windows(buckets: int):
    """Packets sorted by chunk -> a row per document: doc, row, n, a, b (hash of the set), rid, k, tokens.

    ``tokens`` are the shared shingles in the global order (rarest first, then by hash), the first ``k`` of them the window.
    Documents with fewer shared shingles than a partner would need have neither.
    """
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("rid", pa.int64()), ("k", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (batch,), rows in _runs(batches, "batch"):
            meta = np.frombuffer(next(r["payload"] for r in rows if r["bucket"] < 0), [("doc", "<i8"), ("none", "?"), ("row", "<i8"), ("n", "<i8"), ("a", "<i8"), ("b", "<i8")])
            owner, df, values = [np.empty(0, np.int64)], [np.empty(0, np.uint32)], [np.empty(0, np.uint64)]
            for r in rows:
                if r["bucket"] >= 0:
                    n = int.from_bytes(r["payload"][:4], "little")
                    owner.append(np.frombuffer(r["payload"], "<u2", n, 4).astype(np.int64))
                    df.append(np.frombuffer(r["payload"], "<u4", n, 4 + 2 * n))
                    values.append(np.frombuffer(r["payload"], "<u8", n, 4 + 6 * n) * np.uint64(buckets) + np.uint64(r["bucket"]))
            owner, df, values = np.concatenate(owner), np.concatenate(df), np.concatenate(values)
            k = np.bincount(owner, minlength=len(meta)) - needed(meta["n"]) + 1
            k = np.where((k > 0) & (meta["n"] > 0), k, 0)
            mine = k[owner] > 0
            owner, df, values = owner[mine], df[mine], values[mine].astype(np.int64)
            order = np.lexsort((values, df, owner))
            owner, values = owner[order], values[order]
            ends = np.searchsorted(owner, np.arange(len(meta) + 1))
            yield pa.RecordBatch.from_arrays([
                pa.array(meta["doc"], mask=meta["none"]), pa.array(meta["row"]), pa.array(meta["n"]), pa.array(meta["a"]), pa.array(meta["b"]),
                pa.array((batch << 16) + np.arange(len(meta))), pa.array(k.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], schema=schema)

    return run


def _linked(inter: np.ndarray, n_x: int, n_y: np.ndarray) -> np.ndarray:
    return 100 * inter >= NEAR * (n_x + n_y - inter)


def join_region(rids: np.ndarray, sizes: np.ndarray, token_lists: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is connected in one region, exact: every pair is compared, or connected, or ruled out by a pivot."""
    m = len(rids)
    flat = np.concatenate(token_lists)
    _, flat = np.unique(flat, return_inverse=True)
    starts = np.append(0, np.cumsum([len(t) for t in token_lists]))
    comp, far, links = np.arange(m), [], []
    mark = np.zeros(int(flat.max(initial=0)) + 1, np.int64)
    for p in range(m - 1):
        later = np.flatnonzero(comp[p + 1 :] != comp[p]) + p + 1
        for d in far:
            later = later[np.abs(d[later] - d[p]) <= 1 - NEAR / 100 + 1e-9]
        if not len(later):
            continue
        own = flat[starts[p] : starts[p + 1]]
        mark[own] = 1
        if len(far) < PIVOTS:
            inter = np.add.reduceat(mark[flat], starts[:-1])
            far.append(1 - inter / (sizes[p] + sizes - inter))
            inter = inter[later]
        else:
            inter = np.array([mark[flat[starts[y] : starts[y + 1]]].sum() for y in later])
        mark[own] = 0
        for y in later[_linked(inter, sizes[p], sizes[later])]:
            if comp[y] != comp[p]:
                links.append((int(rids[p]), int(rids[y])))
                comp[comp == comp[y]] = comp[p]
    return links


def join_regions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (region, rid, n, tokens) sorted by region -> links (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for _, rows in _runs(batches, "region"):
        links = join_region(np.array([r["rid"] for r in rows]), np.array([r["n"] for r in rows]), [np.array(r["tokens"], np.int64) for r in rows]) if len(rows) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], schema=schema)


def to_pivots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (region, part, kind, rid, n, tokens, axis) sorted by (region, part, kind): the region's pivots (kind 0), then the part's
    documents -> (region, rid, far: distances to the pivots that are axes, edges that connect what is linked)."""
    edge = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    schema = pa.schema([("region", pa.int64()), ("rid", pa.int64()), ("far", pa.list_(pa.float64())), ("edges", edge)])
    for (region, _), rows in _runs(batches, "region", "part"):
        pivots = [r for r in rows if r["kind"] == 0]
        names, sizes = np.array([p["rid"] for p in pivots]), np.array([p["n"] for p in pivots])
        axes = np.array([p["axis"] for p in pivots])
        held = np.concatenate([np.array(p["tokens"], np.int64) for p in pivots])
        owner = np.repeat(np.arange(len(pivots)), [len(p["tokens"]) for p in pivots])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        group = np.arange(len(pivots))
        out = []
        for r in rows[len(pivots) :]:
            tokens = np.array(r["tokens"], np.int64)
            lo, hi = np.searchsorted(held, tokens, "left"), np.searchsorted(held, tokens, "right")
            counts = hi - lo
            at = np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            inter = np.bincount(owner[at], minlength=len(pivots))
            linked = np.flatnonzero(_linked(inter, r["n"], sizes) & (names != r["rid"]))
            edges = [{"a": r["rid"], "b": int(names[linked[0]])}] if len(linked) else []
            for other in linked[1:]:
                if group[other] != group[linked[0]]:
                    edges.append({"a": int(names[linked[0]]), "b": int(names[other])})
                    group[group == group[other]] = group[linked[0]]
            out.append({"region": region, "rid": r["rid"], "far": (1 - inter / (r["n"] + sizes - inter))[axes].tolist(), "edges": edges})
        yield pa.RecordBatch.from_pylist(out, schema)


def split_large(members: DataFrame, cap: int) -> tuple[DataFrame, list[DataFrame]]:
    """members (region, rid, n, tokens) -> the regions within ``cap`` shingles, and the links found while splitting the rest.

    A region above the cap is dealt to parts of about ``cap`` shingles by hash, and every part gets the round's pivots: ``PIVOTS`` in the
    first round, later as many unsettled documents as hold ``cap`` shingles.  So a task sees two times the cap at most.
    """
    links: list[DataFrame] = []
    small = None
    members = members.withColumn("open", F.lit(True))
    while True:
        sizes = members.groupBy("region").agg(F.sum(F.size("tokens")).alias("held"), F.count("*").alias("docs"), F.sum(F.col("open").cast("long")).alias("unsettled"))
        told = stage(members.join(sizes, "region").where("unsettled > 0"), "regions")
        fits = told.where(F.col("held") <= cap).select("region", "rid", "n", "tokens")
        small = fits if small is None else small.union(fits)
        big = told.where(F.col("held") > cap)
        if big.isEmpty():
            return small, links
        want = F.greatest(F.lit(PIVOTS), F.floor(F.lit(cap) * F.col("docs") / F.col("held"))) if links else F.lit(PIVOTS)
        # A draw by hash, and one document for certain.
        draw = F.pmod(F.xxhash64("rid", F.lit(len(links))), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("unsettled")
        chosen = big.where("open").withColumn("draw", draw)
        least = chosen.groupBy("region").agg(F.min("rid").alias("least"))
        sure = F.col("rid") == F.col("least")
        chosen = chosen.join(least, "region").where((F.col("draw") < want) | sure).withColumn("axis", (F.col("draw") < PIVOTS) | sure)
        parts = F.ceil(F.col("held") / cap).cast("int")
        pivots = stage(chosen.select("region", parts.alias("parts"), "rid", "n", "tokens", "axis"), "pivots")
        columns = ["region", "part", "kind", "rid", "n", "tokens", "axis"]
        rows = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(0)).select(*columns)
        rows = rows.union(big.withColumn("part", F.pmod(F.xxhash64("rid"), parts).cast("int")).withColumn("kind", F.lit(1)).withColumn("axis", F.lit(False)).select(*columns))
        seen = rows.repartition("region", "part").sortWithinPartitions("region", "part", "kind", "rid").mapInArrow(
            to_pivots, "region long, rid long, far array<double>, edges array<struct<a: long, b: long>>")
        seen = stage(seen, "distances")
        links.append(seen.select(F.inline("edges")))
        every = links[0]
        for part in links[1:]:
            every = every.union(part)
        label = stage(components(every), "labels")
        placed = big.select("region", "rid", "n", "tokens").join(label.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        used = pivots.select("region", "rid").withColumn("used", F.lit(True))
        placed = placed.join(used, ["region", "rid"], "left").where("used is null").join(seen.select("region", "rid", "far"), ["region", "rid"])
        largest = placed.groupBy("region", "root").agg(F.count("*").alias("c")).groupBy("region").agg(F.max_by("root", F.struct("c", "root")).alias("top"))
        placed = stage(placed.join(largest, "region").withColumn("open", F.col("root") != F.col("top")), "placed")
        box = placed.where("open").select("region", F.posexplode("far").alias("i", "d")).groupBy("region", "i").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
        box = box.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("box"))
        slack = 1 - NEAR / 100 + 1e-9
        inside = F.forall(F.arrays_zip("far", "box"), lambda z: (z["far"] >= z["box"]["lo"] - slack) & (z["far"] <= z["box"]["hi"] + slack))
        members = placed.join(box, "region").where(F.col("open") | inside).select("region", "rid", "n", "tokens", "open")


def near_duplicates(docs: DataFrame, region_tokens: int = REGION_TOKENS) -> DataFrame:
    """docs (doc_id, text) -> one row per document: doc_id, row (hash of the text), rid, n_shingles, component_id, a, b.

    A set is the distinct 5-word shingles of the A-Z-lowered text; fewer words are one shingle; documents without words or
    text have none and are linked with nothing.  Links are ``100 |x & y| >= 80 |x or y|``; component_id is the smallest doc_id
    reachable.  Equal sets are one set, and copies come back through its hash.  A null doc_id never names a component (null if
    all are null).  Rows repeated are documents of their own.  Shingles are told apart by 48 bits of their hash.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("binary"))
    packets = source.mapInArrow(scatter(buckets), "dest int, batch long, bucket int, payload binary")
    shared = packets.repartition(parts, "dest").sortWithinPartitions("bucket").mapInArrow(count_shared, "batch long, bucket int, payload binary")
    rows = shared.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(
        windows(buckets), "doc long, row long, n long, a long, b long, rid long, k int, tokens array<long>")
    rows = stage(rows, "documents")
    sets = stage(rows.where("n > 0").groupBy("a", "b").agg(F.min("doc").alias("doc"), F.min("rid").alias("rid")), "sets")
    held = rows.where("k > 0").groupBy("a", "b").agg(F.max("n").alias("n"), F.max("k").alias("k"), F.max_by("tokens", "k").alias("tokens"))
    held = stage(held.join(sets.select("a", "b", "rid"), ["a", "b"]).select("rid", "n", "k", "tokens"), "windows")
    visits = stage(held.select("rid", F.explode(F.slice("tokens", F.lit(1), F.col("k"))).alias("token")), "visits")
    leads = visits.groupBy("token").agg(F.min("rid").alias("lead"), F.count("*").alias("c")).where("c > 1").select("token", "lead")
    regions = components(visits.join(leads, "token").select(F.col("rid").alias("a"), F.col("lead").alias("b")))
    members = held.join(regions.select(F.col("node").alias("rid"), F.col("root").alias("region")), "rid").select("region", "rid", "n", "tokens")
    small, links = split_large(members, region_tokens)
    joined = small.repartition("region").sortWithinPartitions("region", "rid").mapInArrow(join_regions, "a long, b long")
    for part in links:
        joined = joined.union(part)
    label = components(joined)
    named = sets.join(label.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    known = stage(named.join(least, "root").select("a", "b", "component_id"), "components")
    told = rows.join(known, ["a", "b"], "left")
    return told.select(F.col("doc").alias("doc_id"), "row", "rid", F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"), "a", "b")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component: the row of the smallest doc_id.  Documents without words stay."""
    names = docs.columns
    found = stage(near_duplicates(docs), "near")
    group = F.when(F.col("n_shingles") > 0, F.struct("component_id", F.when(F.col("component_id").isNull(), F.struct("a", "b")).alias("null_set"))).otherwise(None)
    whole = found.where("n_shingles > 0").groupBy(group.alias("g")).agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("first")).select("first.doc_id", "first.row")
    empty = found.where("n_shingles = 0").select("doc_id", "row").distinct()
    repeated = not found.where("n_shingles > 0").groupBy("doc_id", "row").agg(F.count("*").alias("copies")).where("copies > 1").isEmpty()
    kept = whole.withColumn("words", F.lit(True)).union(empty.withColumn("words", F.lit(False))).select(F.struct("doc_id", "row").alias("__key"), F.col("words").alias("__words"))
    keyed = docs.withColumn("__key", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row")))
    stay = keyed.join(stage(kept, "kept").hint("shuffle_hash"), "__key", "inner" if repeated else "left_semi")
    if repeated:
        # A row repeated whole is one document of its group; rows without words belong to none and all stay.
        stay = stay.withColumn("__own", F.when(~F.col("__words"), F.monotonically_increasing_id())).dropDuplicates(["__key", "__own"])
    return stay.select(*names)
