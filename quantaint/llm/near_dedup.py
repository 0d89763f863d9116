"""Near-duplicate groups by MinHash bands, verified by odd sketches and full shingle sets.

1. Documents with the same shingle set form one class; a class goes on once.
2. MinHash bands put classes into buckets. A bucket's members are first compared with few
   centres, the members that share most buckets with others, so a hot bucket costs as many
   pairs as it has members. Only buckets whose members still lie in several components and
   were not all centres go on: their full sets are compared in bounded blocks, exactly.
   In the end every pair of a bucket that could join two components was compared.
3. The odd sketches of a pair (parity bitmaps of its MinHash samples) are compared by the
   population count of their XOR; pairs far below the wanted similarity go.
4. The rest is confirmed on the full shingle sets, in integers.
5. Links are contracted to components by rounds of stars.

A pair at the wanted similarity of 0.85 shares no bucket with a chance of 3e-7, and fails
the sketch test with one below 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantaint.llm.batches import keep_texts
from quantaint.llm.shingles import mix, shingle_set
from quantaint.sources.store import keep

# A link: 100 * intersection >= SIMILAR * union.
SIMILAR = 85
BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
WORDS = SKETCH_BITS // 64
# Estimates below the wanted similarity by more than this are dropped before confirmation.
MARGIN = 0.2
# Centres of each bucket in the rounds of pairs; what is then open is compared in blocks.
CENTRES = (1, 8)
# A block has about this many members, or this many shingles.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
# Candidate ids up to this number are broadcast to the scan of the documents, more are joined by shuffle.
BROADCAST_IDS = 500_000

_draw = np.random.Generator(np.random.PCG64(20_05))
_A = (_draw.integers(0, 1 << 31, SAMPLES, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _draw.integers(0, 1 << 32, SAMPLES, dtype=np.int64).astype(np.uint32)
_SKETCHED = (
    "n_shingles long, cls binary, bands array<long>, "
    + ", ".join(f"s{i} long" for i in range(WORDS))
)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a non-empty set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 2048):
        values = short[i : i + 2048, None] * _A[None, :]
        values += _B
        np.minimum(least, values.min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name per band."""
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Each (function, least value) flips one of the bits; 64-bit words."""
    named = (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)) | samples.astype(np.uint64)
    places = mix(mix(named)) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
    parity = np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def most_flips(similarity: float) -> int:
    """Expected population count of the XOR of two odd sketches of that similarity.

    The sample sets differ in 2 * SAMPLES * (1 - similarity) members, each of which flips one bit.
    """
    differing = 2 * SAMPLES * (1 - similarity)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing))


def sketch_documents(documents: DataFrame) -> DataFrame:
    """Shingle count, class (digest of the shingle set), bucket names and odd sketch of each text."""
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = StructType([rows.schema["doc_id"], *StructType.fromDDL(_SKETCHED)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, bands, sketches = [], [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py())
                sizes.append(len(shingles))
                if len(shingles):
                    samples = minhash(shingles)
                    classes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    bands.append(band_keys(samples))
                    sketches.append(odd_sketch(samples))
                else:
                    classes.append(None)
                    bands.append(None)
                    sketches.append(np.zeros(WORDS, np.int64))
            words = np.array(sketches, np.int64).reshape(-1, WORDS).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    *[pa.array(w) for w in words],
                ],
                names=out.fieldNames(),
            )

    return rows.mapInArrow(run, out)


def _classes(sketched: DataFrame) -> DataFrame:
    names = ["n_shingles", "bands", *[f"s{i}" for i in range(WORDS)]]
    return (
        sketched.filter(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("cls")
        .agg(F.min("doc_id").alias("doc_id"), *[F.first(n).alias(n) for n in names])
    )


def _bucket_members(classes: DataFrame) -> DataFrame:
    """(bucket, cls, degree) of all buckets with two classes or more.

    ``degree`` counts the other members of a class's buckets: the text that the others were made
    from shares more buckets than they share with each other.
    """
    banded = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keep(banded.join(shared, "bucket"), "bucket-members")
    degrees = members.groupBy("cls").agg(F.sum("n").alias("degree"))
    return keep(members.join(degrees, "cls").select("bucket", "cls", "degree"), "ranked-members")


def _flips() -> Column:
    total = F.lit(0)
    for i in range(WORDS):
        total = total + F.bit_count(F.col(f"u.s{i}").bitwiseXOR(F.col(f"v.s{i}")))
    return total


def _close_pairs(pairs: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """Pairs (u, v) whose odd sketches and set sizes allow the similarity."""
    sketch = F.struct("n_shingles", *[f"s{i}" for i in range(WORDS)])
    left = classes.select(F.col("cls").alias("u_cls"), sketch.alias("u"))
    right = classes.select(F.col("cls").alias("v_cls"), sketch.alias("v"))
    least, most = F.least("u.n_shingles", "v.n_shingles"), F.greatest("u.n_shingles", "v.n_shingles")
    return (
        pairs.join(left, "u_cls")
        .join(right, "v_cls")
        .filter((100 * least >= similar * most) & (_flips() <= most_flips(similar / 100 - MARGIN)))
        .select("u_cls", "v_cls")
    )


def _shingle_sets(documents: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, shingles) of every class that shares a bucket, from the whole text of one document."""
    wanted = keep(
        classes.join(members.select("cls").distinct(), "cls", "left_semi").select(
            "doc_id", F.col("cls").alias("wanted")
        ),
        "wanted-classes",
    )
    small = wanted.count() <= BROADCAST_IDS
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(wanted) if small else wanted, "doc_id"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sets = [], []
            for text, name in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                data = shingle_set(text.as_py()).tobytes()
                # A repeated id may carry another text.
                if xxhash.xxh3_128_digest(data) == name:
                    classes.append(name)
                    sets.append(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "shingles"]
            )

    found = rows.mapInArrow(run, "cls binary, shingles binary")
    repeated = wanted.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return found if repeated else found.dropDuplicates(["cls"])


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity, with both sizes of overlap."""
    both = pairs.join(sets.select(F.col("cls").alias("u_cls"), F.col("shingles").alias("u_set")), "u_cls").join(
        sets.select(F.col("cls").alias("v_cls"), F.col("shingles").alias("v_set")), "v_cls"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("u_set"), batch.column("v_set"), strict=True):
                u, v = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                linked.append(100 * both >= similar * (len(u) + len(v) - both))
            yield batch.select(["u_cls", "v_cls"]).filter(pa.array(linked, pa.bool_()))

    return both.select("u_cls", "v_cls", "u_set", "v_set").mapInArrow(run, "u_cls binary, v_cls binary")


def components(links: DataFrame) -> DataFrame:
    """(cls, root) of all linked classes; ``root`` is the least class of the component.

    Large-star and small-star steps alternate until only stars are left. Each step takes a
    minimum per class and joins it back; neighbourhoods are never gathered.
    """
    high, low = F.greatest("u_cls", "v_cls").alias("high"), F.least("u_cls", "v_cls").alias("low")
    edges = keep(links.select(high, low).distinct(), "edges")
    state = _fingerprint(edges)
    while state[0]:
        edges = keep(_small_star(_large_star(edges)), "edges")
        latest = _fingerprint(edges)
        if latest == state:
            break
        state = latest
    return edges.select(F.col("high").alias("cls"), F.col("low").alias("root"))


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: only the components that these links join are contracted."""
    if roots is None:
        return components(links)
    for side in ("u_cls", "v_cls"):
        named = roots.select(F.col("cls").alias(side), F.col("root").alias("_root"))
        links = links.join(named, side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    joined = components(links.filter("u_cls <> v_cls"))
    moved = joined.select(F.col("cls").alias("root"), F.col("root").alias("_new"))
    older = roots.join(moved, "root", "left").select("cls", F.coalesce("_new", "root").alias("root"))
    return older.unionByName(joined)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    around = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
        edges.select(F.col("low").alias("u"), F.col("high").alias("v"))
    )
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        around.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    moved = edges.join(least, "high").select(F.col("low").alias("high"), F.col("m").alias("low"))
    own = least.select("high", F.col("m").alias("low"))
    return moved.unionByName(own).filter("high <> low").distinct()


def _open_members(members: DataFrame, roots: DataFrame, centres: int) -> DataFrame:
    """Members with their component, of buckets that hold several components and more members
    than have been centres."""
    labelled = members.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = labelled.groupBy("bucket").agg(
        F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n")
    )
    still = mixed.filter((F.col("a") != F.col("b")) & (F.col("n") > centres + 1))
    return labelled.join(still.select("bucket"), "bucket", "left_semi")


def _round_pairs(members: DataFrame, after: int, upto: int) -> DataFrame:
    """Pairs of the centres number ``after + 1`` to ``upto`` of each bucket with later members
    of other components."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("degree"), "cls"))
    centres = (
        members.withColumn("_rank", rank)
        .filter((F.col("_rank") <= upto) & (F.col("_rank") > after))
        .select("bucket", F.col("cls").alias("c"), F.col("degree").alias("c_degree"), F.col("root").alias("c_root"))
    )
    later = (F.col("degree") < F.col("c_degree")) | (
        (F.col("degree") == F.col("c_degree")) & (F.col("cls") > F.col("c"))
    )
    return (
        members.join(centres, "bucket")
        .filter(later & (F.col("root") != F.col("c_root")))
        .select(F.least("cls", "c").alias("u_cls"), F.greatest("cls", "c").alias("v_cls"))
        .distinct()
    )


def _block_links(members: DataFrame, classes: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links (u_cls, v_cls) inside the buckets of a table (bucket, cls, root) between components.

    A bucket is cut into blocks by hash; each pair of blocks is one bounded group, which yields
    links that connect what is connected, not all of them.
    """
    sized = members.join(classes.select("cls", "n_shingles"), "cls")
    blocks = sized.groupBy("bucket").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
        ).alias("blocks")
    )
    own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    placed = (
        members.join(blocks, "bucket")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "bucket",
            F.least("own", "other").alias("a"),
            F.greatest("own", "other").alias("b"),
            "own",
            "cls",
            "root",
        )
    )
    rows = placed.join(sets, "cls").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "cls")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "a", "b", "own", "cls", "root", "shingles"))
            for bucket, a, b, *member in zip(*columns, strict=True):
                if (bucket, a, b) != at:
                    if group:
                        yield _links_of_block(at, group, similar)
                    at, group = (bucket, a, b), []
                group.append(member)
        if group:
            yield _links_of_block(at, group, similar)

    return rows.mapInArrow(run, "u_cls binary, v_cls binary")


def _links_of_block(key: tuple, group: list[list], similar: int) -> pa.RecordBatch:
    """Links of one pair of blocks; ``group`` holds [own block, class, root, shingles]."""
    names = [x[1] for x in group]
    links: list[tuple[bytes, bytes]] = []
    if len({x[2] for x in group}) > 1:
        sets = [np.frombuffer(x[3], "<u8") for x in group]
        sizes = np.array([len(x) for x in sets])
        common = _intersections(sets)
        similar_pairs = 100 * common >= similar * (sizes[:, None] + sizes[None, :] - common)
        block = np.array([x[0] for x in group])
        if key[1] != key[2]:
            similar_pairs &= block[:, None] != block[None, :]
        number = {root: i for i, root in enumerate(dict.fromkeys(x[2] for x in group))}
        root = np.array([number[x[2]] for x in group])
        similar_pairs &= root[:, None] != root[None, :]
        over = list(range(len(number)))

        def top(x: int) -> int:
            while over[x] != x:
                over[x] = over[over[x]]
                x = over[x]
            return x

        for u, v in zip(*np.nonzero(np.triu(similar_pairs)), strict=True):
            a, b = top(root[u]), top(root[v])
            if a != b:
                over[b] = a
                links.append((names[u], names[v]))
    return pa.RecordBatch.from_arrays(
        [pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["u_cls", "v_cls"]
    )


def _intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over shared shingles."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    shared = counts[column] > 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(number[-1]) + 1, width):
        low, high = np.searchsorted(column, [first, first + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[low:high], column[low:high] - first] = 1
        total += (held @ held.T).astype(np.int64)
    return total


def near_duplicates(
    documents: DataFrame, similar: int = SIMILAR, centres: tuple[int, ...] = CENTRES, key: Column | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Documents whose five-word shingle sets have a Jaccard similarity of ``similar`` percent or
    more are linked; ``component_id`` is the least id reachable over links, ``kept`` says that it
    is the document's own. With fewer than five words the whole sequence is the one shingle.
    Documents without words or text, and rows without an id, are linked with nothing; a row
    without an id has no component and is kept. Rows that repeat an id are judged one by one.
    Empty tables give no rows. ``documents`` is read twice. ``key``, of any type with an order,
    takes the place of ``doc_id``.
    """
    name = F.col("doc_id").cast("long") if key is None else key
    documents = documents.select(name.alias("doc_id"), "text")
    sketched = keep_texts(sketch_documents(documents), "sketches")
    classes = keep(_classes(sketched), "classes")
    members = _bucket_members(classes)
    roots = None
    if not members.isEmpty():
        sets = keep_texts(_shingle_sets(documents, classes, members), "shingle-sets")
        current, after = members.withColumn("root", F.col("cls")), 0
        for upto in centres:
            pairs = keep(_close_pairs(_round_pairs(current, after, upto), classes, similar), "close-pairs")
            found = keep_texts(_confirmed(pairs, sets, similar), "links")
            roots, after = keep(_merged(roots, found), "roots"), upto
            current = keep(_open_members(members, roots, after), "open-members")
        if not current.isEmpty():
            found = keep_texts(_block_links(current, classes, sets, similar), "links")
            roots = keep(_merged(roots, found), "roots")
    return _memberships(sketched, classes, roots)


def _memberships(sketched: DataFrame, classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        named = classes.select("cls", F.col("doc_id").alias("component"))
    else:
        rooted = classes.select("cls", "doc_id").join(roots, "cls", "left")
        rooted = rooted.withColumn("root", F.coalesce("root", "cls"))
        least = rooted.groupBy("root").agg(F.min("doc_id").alias("component"))
        named = rooted.join(least, "root").select("cls", "component")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return sketched.select("doc_id", "n_shingles", "cls").join(named, "cls", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )
