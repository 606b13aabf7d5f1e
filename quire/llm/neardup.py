"""MinHash near-deduplication: DartMinHash signatures, banded joining, exact verification, classes.

Two texts are near duplicates when the weighted Jaccard similarity of their bags of five-word shingles is at least
THRESHOLD. Texts with equal bags are one node from the start, so copies are never paired. A bucket (band, hash) is
worked off by leaders: members of other classes are compared with its best-linked member. A share of the
large buckets comes first, so that most of a large group is one class before the others are worked off. Where members of several
classes are left in a bucket, they are compared with all members of other classes, in blocks, by their whole bags. The
rows of every step grow with the members of buckets, beyond BLOCK members of several classes in one bucket with their
square over BLOCK; the comparisons inside a block are its pairs of different classes. No member is capped or dropped.
BANDS bands of ROWS rows put a pair of similarity 0.8 into one bucket at least with probability 1 - 5e-6, and every pair
in a bucket is compared unless links connect it already.

Defined results: a null text is a class of its own; rows with a null id are classed like others, and the class id is null
only if all ids of the class are; different texts may share an id; texts without words are equal if their characters are; a text of
one to four words has one shingle of all of them; repeated rows are copies of each other; an empty table gives no rows;
very long texts are read whole; other columns are ignored or, in deduplicate(), kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, slices
from .dartminhash import band_hashes, shingle_columns, signatures, similarity

THRESHOLD = 0.8
BANDS, ROWS = 40, 6
#: Leaders work these twentieths of the large buckets (of so many members) first, so that the rest finds most classes made.
FIRST_BUCKETS, HOT_BUCKET = ((0, 1), (1, 5)), 20
#: Members of a bucket that one block has about; each pair of blocks is a piece of work of its own.
BLOCK = 2000
#: And shingles, if its texts are long.
BLOCK_SHINGLES = 400_000


def _key(what: bytes) -> bytes:
    return hashlib.blake2b(what, digest_size=16).digest()


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, digest (of the text), key (equal for texts with equal bags), n (shingles), bands (bucket names; empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True)
            for group in slices(((i, t.as_py(), d) for i, t, d in rows_), lambda x: len(x[1] or "") + 64):
                texts = [t or "" for _, t, _ in group]
                columns, owner, made = shingle_columns(texts)
                some = np.flatnonzero(made > 0)
                names: list = [[]] * len(texts)
                if len(some):
                    rank = np.zeros(len(texts), dtype=np.int64)
                    rank[some] = np.arange(len(some))
                    for at, row in zip(some, band_hashes(signatures(columns, rank[owner], len(some), bands * rows), rows).tolist(), strict=True):
                        names[at] = row
                start = np.concatenate([[0], np.cumsum(made)])
                keys = []
                for at, (i, t, _) in enumerate(group):
                    own = columns[start[at] : start[at + 1]]
                    what = b"null:" + str(i).encode() if t is None else b"text:" + t.encode("utf-8", "surrogatepass") if not len(own) else np.sort(own).tobytes()
                    keys.append(_key(what))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in group], pa.int64()), pa.array([d for _, _, d in group], pa.int64()), pa.array(keys, pa.binary()), pa.array(made, pa.int64()), pa.array(names, pa.list_(pa.int64()))], ["id", "digest", "key", "n", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("digest")).mapInArrow(run, "id long, digest long, key binary, n long, bands array<long>")


def _bags(texts: DataFrame) -> DataFrame:
    """key and bag: the sorted shingle columns of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in slices(batch.column(0).to_pylist(), lambda x: len(x) + 64):
                columns, _, made = shingle_columns(group)
                start = np.concatenate([[0], np.cumsum(made)])
                bags = [np.sort(columns[start[k] : start[k + 1]]).tobytes() for k in range(len(group))]
                yield pa.RecordBatch.from_arrays([pa.array([_key(bag) for bag in bags], pa.binary()), pa.array(bags, pa.binary())], ["key", "bag"])

    return texts.select("text").mapInArrow(run, "key binary, bag binary")


def _linked(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose bags are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = [similarity(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)) >= threshold for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), "a").join(bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")), "b")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """id and root: the least id that the undirected edges (a, b) connect it with (within so many rounds, if given).

    Every node takes its neighbours' least label, then its label's label; hubs are only ever summed up (min), never
    gathered.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    done = 0
    while rounds is None or done < rounds:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("near"))
        above = labels.select(F.col("id").alias("next"), F.col("root").alias("above"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        moved = cut(step.join(above, "next").select("id", F.least("next", "above").alias("root"), "was"))
        labels = moved.select("id", "root")
        done += 1
        if rounds is None and moved.where("root <> was").isEmpty():
            break
    return labels


def _left_over(seats: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between classes that meet in a bucket: every pair of members of different classes is compared by its
    bags, block by block. A pair is skipped only when links that hold connect its classes already.

    seats: bucket, id, n, root (the class so far). The members of a bucket's largest class are compared with all others,
    but not with each other. A block pair puts out no more links than it has classes.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        for batch in batches:
            bags_ = batch.column("bag")
            rows = zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "high", "root", "side")), strict=True)
            out: list[tuple[int, int]] = []
            for at, (bucket, low, high, root, side) in enumerate(rows):
                if (bucket, low, high) != now:
                    out += _block_links(members, threshold)
                    now, members = (bucket, low, high), []
                members.append((root, side, np.frombuffer(bags_[at].as_buffer(), dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=schema)
        out = _block_links(members, threshold)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=schema)

    classes = seats.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    total = classes.groupBy("bucket").agg(F.max(F.struct("rows", "root", "shingles")).alias("most"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    blocks = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    # a bucket that fits into one block is one; in others the largest class has blocks of its own
    whole = blocks(F.col("rows"), F.col("shingles")) == 1
    total = total.where(F.col("rows") > F.col("most.rows")).select("bucket", F.when(~whole, F.col("most.root")).alias("largest"), F.when(whole, 1).otherwise(blocks(F.col("rows") - F.col("most.rows"), F.col("shingles") - F.col("most.shingles"))).alias("rest_blocks"), F.when(whole, 0).otherwise(blocks(F.col("most.rows"), F.col("most.shingles"))).alias("blocks"))
    rows = seats.join(total, "bucket")
    largest = F.coalesce(F.col("root") == F.col("largest"), F.lit(False))
    at = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    rows = rows.withColumn("block", F.when(largest, F.col("rest_blocks") + at(F.col("blocks"))).otherwise(at(F.col("rest_blocks"))))
    # a member meets each block of its bucket once, but those of the largest class don't meet each other; side 2: a block with itself
    last = F.when(largest, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("blocks")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last))).join(bags, "id")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    key = ["bucket", "low", "high"]
    rows = rows.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "root", side.alias("side"), "bag")
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "a long, b long").distinct()


def _block_links(members: list[tuple[int, int, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Links (class, class) among (class, side, bag) of one pair of blocks; members of one side (0 or 1) aren't compared."""
    if len(members) < 2 or all(m[0] == members[0][0] for m in members):
        return []
    members = sorted(members, key=lambda m: len(m[2]))
    n = np.array([len(m[2]) for m in members])
    names, own = np.unique(np.array([m[0] for m in members], dtype=np.int64), return_inverse=True)
    side = np.array([m[1] for m in members])
    start = np.concatenate([[0], np.cumsum(n)])
    values, spots = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True)
    there = np.zeros(len(values), dtype=np.int32)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    # every pair has a member outside the largest class, or on the smaller side: only these are held against the others
    sides = np.bincount(side, minlength=3)
    if sides[2]:
        asking = np.flatnonzero(own != np.bincount(own).argmax())
    else:
        asking = np.flatnonzero(side == int(sides[1] < sides[0]))
    low = np.searchsorted(n, n * threshold - 1e-6)
    high = np.searchsorted(n, n / threshold + 1e-6, side="right")
    out = []
    for i in asking.tolist():
        first, last = int(low[i]), int(high[i])
        mine = spots[start[i] : start[i + 1]]
        there[mine] = 1
        common = np.add.reduceat(there[spots[start[first] : start[last]]], start[first:last] - start[first])
        there[mine] = 0
        near = (common / (n[i] + n[first:last] - common) >= threshold) & (own[first:last] != own[i])
        if side[i] != 2:
            near &= side[first:last] != side[i]
        for other in np.unique(own[first:last][near]).tolist():
            x, y = find(int(own[i])), find(other)
            if x != y:
                root[x] = y
                out.append((int(names[own[i]]), int(names[other])))
    return out


def _with_classes(seats: DataFrame, links: DataFrame | None) -> DataFrame:
    """seats with root (roughly the class so far) and degree (links so far)."""
    if links is None:
        return seats.withColumn("root", F.col("id")).withColumn("degree", F.lit(0).cast("long"))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    known = components(links, rounds=2).join(degree, "id")
    return seats.join(known, "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"), F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, digest (of the text) and class (a number) of every row."""
    marks = cut(signed(docs, id_col, text_col, bands, rows))
    # texts with equal bags are a node, which is numbered, as ids may be null or shared by several texts
    nodes = marks.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "n", "bands")).alias("x"))
    nodes = cut(nodes.select("key", F.monotonically_increasing_id().alias("id"), F.col("x.id").alias("doc"), "x.digest", "x.n", "x.bands"))
    seats = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = seats.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    seats = cut(seats.join(shared, "bucket").join(nodes.select("id", "n"), "id"))
    seated = nodes.join(seats.select("id").distinct(), "id", "left_semi").select("id", "key", "doc", "digest")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("digest"))
    same = source["doc"].eqNullSafe(seated["doc"]) & (source["digest"] == seated["digest"])
    made = _bags(source.join(seated, same, "left_semi").dropDuplicates(["doc", "digest"]))
    bags = cut(made.join(seated.select("key", "id"), "key").dropDuplicates(["id"]).select("id", "bag"))
    ratio = F.least("n", "leader_n") >= F.greatest("n", "leader_n") * F.lit(threshold)
    tested = links = led = None
    share = F.pmod("bucket", F.lit(20))
    for here in (*(seats.where((share >= a) & (share < b) & (F.col("size") >= HOT_BUCKET)) for a, b in FIRST_BUCKETS), seats):
        now = _with_classes(here.select("bucket", "id", "n"), links)
        best = F.struct("degree", (-F.col("id")).alias("first"))
        leaders = now.groupBy("bucket").agg(F.max(F.struct(best.alias("best"), "id", "n", "root")).alias("x")).select("bucket", F.col("x.id").alias("leader"), F.col("x.n").alias("leader_n"), F.col("x.root").alias("leader_root"))
        leaders = cut(leaders)
        led = leaders if led is None else led.unionByName(leaders)
        pairs = now.join(leaders, "bucket").where((F.col("root") != F.col("leader_root")) & ratio).select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = cut(_linked(pairs, bags, threshold))
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
    classes = nodes.select("key", "id", F.col("id").alias("class_id")) if links is None else nodes.select("key", "id").join(components(links), "id", "left").select("key", "id", F.coalesce("root", "id").alias("class_id"))
    classes = cut(classes)
    # a leader has met all members of its bucket that aren't in its class, so only the others are left to be compared
    rest = seats.join(led.select("bucket", F.col("leader").alias("id")), ["bucket", "id"], "left_anti").join(classes.select("id", F.col("class_id").alias("root")), "id")
    more = cut(_left_over(rest.select("bucket", "id", "n", "root"), bags, threshold))
    if not more.isEmpty():
        joined = components(more).withColumnRenamed("id", "class_id")
        classes = classes.join(joined, "class_id", "left").withColumn("class_id", F.coalesce("root", "class_id"))
    classes = classes.select("key", "class_id")
    return marks.select("id", "digest", "key").join(classes, "key").select("id", "digest", F.col("class_id").alias("class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id_col and class_id (the least id of its class) of every row."""
    found = cut(_classes(docs, id_col, text_col, **options))
    least = found.groupBy("class").agg(F.min("id").alias("class_id"))
    return found.join(least, "class").select(F.col("id").alias(id_col), "class_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: a row of the least id (null ids last), all its columns kept."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("x")
    kept = _classes(docs, id_col, text_col, **options).groupBy("class").agg(first).select(F.col("x.id").alias("_kept_id"), F.col("x.digest").alias("_kept_digest"))
    name, digest = free_name(docs, "_kept_id"), free_name(docs, "_digest")
    kept = kept.withColumnsRenamed({"_kept_id": name, "_kept_digest": f"{digest}_kept"})
    rows = docs.withColumn(digest, F.xxhash64(F.col(text_col)))
    # rows that share id and text are copies; the others of an id are texts of their own
    same = F.col(id_col).cast("long").eqNullSafe(F.col(name)) & (F.col(digest) == F.col(f"{digest}_kept"))
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, digest]).select(*docs.columns)
