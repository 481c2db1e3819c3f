"""Jaccard join on word n-grams with prefix filters under several global orders.

A document's set holds the hashes of its distinct ``GRAM``-word shingles. Two
sets at or above the threshold ``t`` must overlap in ``o = t / (1 + t) * (n + m)``
tokens, so they share a token among their first ``n - o + 1`` and ``m - o + 1`` under
*every* global order of tokens, and ``k`` tokens among ``k - 1`` more. All three
orders put rare shingles first, so common ones make no candidates: order 1 by
estimated document frequency, orders 2 and 3 by its magnitude, then by two
opposite orders of a hash. Frequencies come from a sketch of fixed size that
counts all documents; where ``load`` other shingles fall on a slot its error is about the square
root of the load, so shingles held by a few times that many documents still come last.

Candidates meet by a shared prefix token under order 1. Before any text is read, the
prefixes of a pair are compared: ``SHARED`` tokens must be common under
order 1 (or all that a small set must share), and the prefixes must meet under orders 2 and 3 too. Only what passes all
three filters is verified on its full sets.

Copies and clusters: documents with equal sets are one class. Each class is first
tried against the hub it shares most prefix tokens with (the member of a token
group whose own tokens are shared most often, as an original's are), linked
ones are merged, and only token groups that still hold several components go on:
twice to hubs of other components, then to pairs across components: in each token group the
members outside its largest component meet the others at the places that their sizes allow, where their signatures (256 bits, each the
parity of the tokens that fall on it) differ in no more bits than linked sets differ in tokens. A group of near copies so
costs about one comparison a member, and no link between components is lost.
Centres with many members are salted; token groups stream through sorted buckets.

Edge cases: null text, empty text and text without words have no shingles and
link with nothing (component_id is their own doc_id); fewer words than ``GRAM``
make one shingle of all of them; rows that share a doc_id are one node, which links where any of its
texts does; a null doc_id has a null component; empty tables give no rows; other columns are
ignored, whatever their names. Keys are whole numbers. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossbook.llm.arrow import map_batches
from lossbook.llm.store import saved
from lossbook.llm.substring_dedup import ANSWERED, BATCH_WINDOWS, SENT, Owned, answer_places, n_buckets, send_counted, sorted_by_bucket
from lossbook.llm.words import Chunk, chunks, mix, spans_hash

GRAM, THRESHOLD = 5, 80
SKETCH_BITS = 22
SLICE = 1 << 17
BROADCAST_PAIRS = 200_000
#: A bitmap of ids has 2**BITMAP_BITS bits (2 MB), whatever the input; 2**15 of them make a row.
BITMAP_BITS = 24
MEMBERS_PER_TASK = 32
#: Longs of a set's signature.
SIGNATURE = 4
SIGNED = tuple(f"bits{k}" for k in range(SIGNATURE))
#: Prefix tokens that a candidate pair must share, or all that a small set must share.
SHARED = 8


def shingle_sets(chunk: Chunk, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and the offsets of the documents."""
    hashes = chunk.hashes()
    at, grams = chunk.rolling(gram, hashes)
    doc = chunk.doc[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < gram))
    if len(short):
        grams = np.concatenate([grams, spans_hash(hashes, chunk.word_offsets[short], chunk.word_offsets[short + 1])])
        doc = np.concatenate([doc, short])
    order = np.argsort(grams)
    order = order[np.argsort(doc[order].astype(np.uint16 if chunk.n < 1 << 16 else np.int64), kind="stable")]
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=chunk.n))]).astype(np.int64)


def prefix_size(n: np.ndarray | int) -> np.ndarray | int:
    return n - -(-THRESHOLD * n // 100) + 1


def shared_tokens(n):
    """Prefix tokens under order 1 that a set of n must share with any set it links to; n: a number or an array."""
    return np.minimum(SHARED, -(-THRESHOLD * n // 100))


def signatures(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of SIGNATURE longs for each set: bit k is the parity of the number of its tokens that fall on k.

    A token that only one of two sets has flips one bit, so signatures differ in no more bits than the sets do in tokens.
    """
    bits = 64 * SIGNATURE
    n = len(offsets) - 1
    at = np.repeat(np.arange(n) * bits, np.diff(offsets)) + (mix(grams ^ np.uint64(0x9FB21C651E98DF25)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, SIGNATURE)


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """Documents by shingle, counted in 2**SKETCH_BITS slots: a bound that doesn't grow with the input."""
    codec, width = "zstd", SLICE * 4

    def packed(slices: list[int], counts: list[np.ndarray]) -> pa.RecordBatch:
        data = [pa.compress(c.astype(np.uint32).tobytes(), codec=codec, asbytes=True) for c in counts]
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(data, pa.binary())], names=["slice", "counts"])

    def unpacked(data: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(data, decompressed_size=width, codec=codec, asbytes=True), np.uint32)

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, chunk in chunks(batch, lower=True):
                grams, _ = shingle_sets(chunk)
                np.add.at(total, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        slices = [k for k in range(len(total) // SLICE) if total[k * SLICE : (k + 1) * SLICE].any()]
        if slices:
            yield packed(slices, [total[k * SLICE : (k + 1) * SLICE] for k in slices])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + unpacked(data).astype(np.int64)
        if sums:
            yield packed(list(sums), [np.minimum(x, np.iinfo(np.uint32).max) for x in sums.values()])

    parts = map_batches(docs.select("text"), count, "slice int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for k, data in map_batches(parts.repartition("slice"), add, "slice int, counts binary").collect():
        out[k * SLICE : (k + 1) * SLICE] = unpacked(bytes(data))
    return out


def _ranked(doc: np.ndarray, rank: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Positions by document, then rank (below 2**16), then the upper bits of tie."""
    if not len(doc) or doc[-1] >= 1 << 16:
        return np.lexsort((tie, rank, doc))
    return np.argsort((doc.astype(np.uint64) << np.uint64(48)) | (rank.astype(np.uint64) << np.uint64(32)) | (tie >> np.uint64(32)))


def _described(docs: DataFrame, sketch) -> DataFrame:
    """id, n, d1, d2 (a 128-bit digest of the set), its prefix under order 1, of each order's prefix tokens 32 bits (order 1) or 16, and its signature.

    p1 is empty where two of its tokens have the same 32 bits, so that counts never fall short.
    """
    names = ["id", "n", "d1", "d2", "prefix", "p1", "p2", "p3", *SIGNED]

    def run(batches):
        load = np.median(sketch.value)
        for batch in batches:
            for row, chunk in chunks(batch, lower=True):
                grams, offsets = shingle_sets(chunk)
                n = np.diff(offsets)
                doc = np.repeat(np.arange(chunk.n), n)
                common = sketch.value[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                magnitude = np.log2(1 + np.maximum(common - load - 3 * np.sqrt(load), 0)).astype(np.int64)
                tie = mix(grams ^ np.uint64(0xA0761D6478BD642F))
                orders = (
                    _ranked(doc, np.minimum(common, 0xFFFF), mix(grams)), _ranked(doc, magnitude, tie), _ranked(doc, magnitude // 2, ~tie),
                )
                depth, deep = (np.where(n > 0, prefix_size(n) + more, 0) for more in (0, shared_tokens(n) - 1))
                inside = np.arange(len(grams)) - offsets[:-1][doc]
                lists = []
                for order, size, width in zip(orders, (deep, depth, depth), (4, 2, 2), strict=True):
                    tokens = grams[order][inside < size[doc]].astype(f"u{width}")
                    of = doc[inside < size[doc]]
                    if width == 4:
                        pairs, seen = np.unique((of.astype(np.uint64) << np.uint64(32)) | tokens, return_counts=True)
                        good = ~np.isin(of, (pairs[seen > 1] >> np.uint64(32)).astype(np.int64))
                        tokens, of = tokens[good], of[good]
                    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=chunk.n))]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(ends, pa.array(tokens.view(f"i{width}"))))
                ranked = grams[orders[0]]
                total = np.zeros(len(grams) + 1, np.uint64)
                np.cumsum(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
                columns = [
                    batch.column(0).slice(row, chunk.n), pa.array(n, pa.int64()),
                    pa.array(spans_hash(grams, offsets[:-1], offsets[1:]).view(np.int64)),
                    pa.array((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)),
                    pa.array([ranked[o : o + s].tobytes() for o, s in zip(offsets[:-1], depth, strict=True)], pa.binary()), *lists,
                    *[pa.array(column) for column in signatures(grams, offsets).T],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs.select("id", "text"), run, f"id long, n long, d1 long, d2 long, prefix binary, p1 array<int>, p2 array<smallint>, p3 array<smallint>, {', '.join(f'{c} long' for c in SIGNED)}")


def _token_groups(classes: DataFrame) -> DataFrame:
    """token, class, place (in the class's prefix) for prefix tokens that two classes or more have. classes: class, prefix."""
    owned = Owned(n_buckets(classes))

    def send(batches):
        parts, held = ([], [], []), 0
        for batch in batches:
            for key, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(prefix, np.uint64)
                for part, new in zip(parts, (tokens, np.full(len(tokens), key), np.arange(len(tokens))), strict=True):
                    part.append(new)
                held += len(tokens)
                if held >= BATCH_WINDOWS:
                    yield from send_counted(owned, parts[0], *parts)
                    parts, held = ([], [], []), 0
        if held:
            yield from send_counted(owned, parts[0], *parts)

    sent = map_batches(classes.select("class", "prefix"), send, SENT)
    return map_batches(sorted_by_bucket(sent), answer_places, ANSWERED).select("token", F.col("key").alias("class"), F.col("value").alias("place"))


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id may be in ids (one column): most others are dropped before a join shuffles them.

    Ids are hashed to the bits of a map of fixed size. It drops no row whose id is there, and fewer of the others the more ids there are.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    place = at(F.col(ids.columns[0]))
    maps = ids.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"))
    bit = at(F.col("id")).bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substr("bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.shiftright(at(F.col("id")), 15) == F.col("part"))
    return met.filter(F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1).select(*rows.columns)


def _overlap(a: str, b: str):
    """Tokens that sets of a and b must have in common."""
    return F.ceil((F.col(a).cast("long") + F.col(b)) * THRESHOLD / (100 + THRESHOLD))


def _filtered(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """Of the pairs (class, centre), those whose prefixes meet under every order, deep enough under order 1; no text is read.

    With ``o`` the overlap that the sizes ask for, ``k`` shared tokens stand among the first ``n - o + k`` of both sets.
    """
    wanted = pairs.select(F.explode(F.array("class", "centre")).alias("wanted"))
    prefixes = saved(_likely(described.select("id", "n", "p1", "p2", "p3").filter("n > 0"), wanted), "jaccard-prefixes")
    a, b = (prefixes.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "p1", "p2", "p3")]) for k in ("class", "centre"))
    both = pairs.join(a, "class").join(b, "centre").withColumn("o", _overlap("n_class", "n_centre"))
    k = F.least(F.lit(SHARED), F.ceil(F.least("n_class", "n_centre") * THRESHOLD / 100))
    first = lambda p, more: [F.slice(f"{p}_{x}", F.lit(1), F.greatest(F.col(f"n_{x}") - F.col("o") + more, F.lit(0)).cast("int")) for x in ("class", "centre")]
    counted = (F.size("p1_class") == 0) | (F.size("p1_centre") == 0) | (F.size(F.array_intersect(*first("p1", k))) >= k)
    meet = counted & F.arrays_overlap(*first("p2", 1)) & F.arrays_overlap(*first("p3", 1))
    return both.filter(_sized("n_class", "n_centre")).filter(meet).select("class", "centre").distinct()


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """a and b are sorted."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= THRESHOLD * (len(a) + len(b) - common)


def _verified(docs: DataFrame, pairs: DataFrame, counted: int) -> DataFrame:
    """Of the pairs (class, centre), those whose sets reach the threshold."""
    salts = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).cast("int").alias("salts"))
    salted = pairs.join(salts, "centre").select("class", "centre", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    own = salts.select(F.col("centre").alias("class"), "centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    asked = saved(salted.unionByName(own), "jaccard-asked")
    if counted <= BROADCAST_PAIRS:
        asked = F.broadcast(asked)
    else:
        docs = _likely(docs, asked.select("class"))
    texts = docs.join(asked, F.col("id") == F.col("class")).select("class", "centre", "salt", "role", "text")

    def judge(batches):
        at, centres = None, []
        for batch in batches:
            good: list[tuple[int, int]] = []
            keys, at_centre, salt, role = (batch.column(k).to_numpy() for k in range(4))
            for row, chunk in chunks(batch, lower=True):
                grams, offsets = shingle_sets(chunk)
                for i in range(chunk.n):
                    tokens, place = grams[offsets[i] : offsets[i + 1]], (at_centre[row + i], salt[row + i])
                    if at != place:
                        at, centres = place, []
                    if role[row + i] == 0:
                        centres.append(tokens)
                    elif any(_alike(tokens, c) for c in centres):
                        good.append((keys[row + i], at[0]))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*good, strict=True)], names=["class", "centre"])

    met = texts.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")
    return saved(map_batches(met, judge, "class long, centre long"), "jaccard-links")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component. edges: a, b."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = (
            labels.join(near, "node").join(jump, "label")
            .select("node", F.col("label").alias("old"), F.least("label", "near", "further").alias("label"))
        )
        step = saved(step, "labels")
        labels = step.select("node", "label")
        if not step.filter("old <> label").limit(1).count():
            return labels


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after merging the components that links connect."""
    if labels is None:
        return components(links.select(F.col("class").alias("a"), F.col("centre").alias("b")))
    up = {c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("class", "centre")}
    lifted = links.join(up["class"], "class", "left").join(up["centre"], "centre", "left")
    edges = lifted.select(F.coalesce("class_label", "class").alias("a"), F.coalesce("centre_label", "centre").alias("b")).filter("a <> b")
    top = components(edges)
    raised = top.select(F.col("node").alias("label"), F.col("label").alias("new"))
    old = labels.join(raised, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = top.join(labels, "node", "left_anti").select("node", "label")
    return saved(old.unionByName(fresh), "labels")


def _sized(a: str, b: str):
    """False where sizes rule a link out; a null size (a doc_id with several sets) rules nothing out."""
    return F.when(F.col(a).isNull() | F.col(b).isNull(), True).otherwise(F.least(a, b).cast("long") * 100 >= F.greatest(a, b).cast("long") * THRESHOLD)


def _open_groups(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of token groups that hold several components, with the hubs of the first and the last component there.

    Merging only closes groups, so each round starts from the members that the one before left.
    """
    if labels is None:
        marked = groups.withColumn("component", F.col("class"))
    else:
        marked = groups.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("label", "class")).drop("label")
    hub = F.struct("component", "degree", "class", "n")
    ends = marked.groupBy("token").agg(
        F.min(F.struct("component", (-F.col("degree")).alias("order"), "class", "n")).alias("low"), F.max(hub).alias("high"),
    ).filter(F.col("low.component") < F.col("high.component"))
    return saved(marked.join(ends, "token"), "jaccard-open")


def _towards_hubs(members: DataFrame) -> DataFrame:
    """class, centre: the hub of another component that a member shares most tokens with."""
    centre = F.when(F.col("component") != F.col("low.component"), F.struct("low.class", "low.n")).otherwise(F.struct("high.class", "high.n"))
    pairs = members.withColumn("c", centre).filter(_sized("n", "c.n")).groupBy("class", F.col("c.class").alias("centre")).agg(F.count(F.lit(1)).alias("shared"))
    return pairs.groupBy("class").agg(F.max_by("centre", F.struct("shared", -F.col("centre"))).alias("centre"))


def _towards_first_hubs(groups: DataFrame) -> DataFrame:
    """class, centre: for each class the hub of its token groups that it shares most tokens with."""
    hubs = groups.groupBy("token").agg(F.max(F.struct("degree", (-F.col("class")).alias("order"), "n")).alias("hub"))
    pairs = groups.join(hubs, "token").withColumn("centre", -F.col("hub.order")).filter((F.col("class") != F.col("centre")) & _sized("n", "hub.n"))
    pairs = pairs.groupBy("class", "centre").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.groupBy("class").agg(F.max_by("centre", F.struct("shared", -F.col("centre"))).alias("centre"))


def _differ_little(a: str, b: str):
    """False where the signatures differ in more bits than linked sets of these sizes differ in tokens; unknown sizes or signatures rule nothing out."""
    apart = sum((F.bit_count(F.col(f"{c}_{a}").bitwiseXOR(F.col(f"{c}_{b}"))) for c in SIGNED), F.lit(0))
    return F.coalesce(apart <= F.col(f"n_{a}") + F.col(f"n_{b}") - 2 * _overlap(f"n_{a}", f"n_{b}"), F.lit(True))


def _across(members: DataFrame, described: DataFrame) -> DataFrame:
    """Pairs of different components with a token at places where a linked pair may share its first one, and with signatures that a linked pair may have.

    One side of a pair is outside the token group's largest component, so what has merged already never meets itself.
    """
    sizes = members.groupBy("token", "component").agg(F.count(F.lit(1)).alias("held"))
    largest = sizes.groupBy("token").agg(F.max_by("component", F.struct("held", "component")).alias("largest"))
    one = [F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in SIGNED]
    signed = _likely(described.select("id", *SIGNED), members.select("class")).groupBy(F.col("id").alias("class")).agg(*one)
    marked = members.join(largest, "token").join(signed, "class").select("token", "class", "component", "n", "place", (F.col("component") != F.col("largest")).alias("small"), *SIGNED)
    marked = saved(marked, "jaccard-across")
    a, b = (marked.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("class", "component", "n", "place", "small", *SIGNED)]) for k in "ab")
    o = _overlap("n_a", "n_b")
    early = F.coalesce((F.col("place_a") <= F.col("n_a") - o) & (F.col("place_b") <= F.col("n_b") - o), F.lit(True))
    once = F.col("small_a") & (~F.col("small_b") | (F.col("class_a") > F.col("class_b")))
    pairs = a.filter("small_a").join(b, "token").filter(once & (F.col("component_a") != F.col("component_b")) & _sized("n_a", "n_b") & early & _differ_little("a", "b"))
    return pairs.select(F.greatest("class_a", "class_b").alias("class"), F.least("class_a", "class_b").alias("centre")).distinct()


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles (long), component_id: one row for each document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs))
    described = saved(_described(docs, sketch), "jaccard-sets")
    small = described.select("id", "n", "d1", "d2")
    sets = saved(small.filter("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("class")), "jaccard-classes")
    first = described.filter("n > 0").join(sets.select(F.col("class").alias("id")).distinct(), "id", "left_semi")
    groups = saved(_token_groups(first.select(F.col("id").alias("class"), "prefix")), "jaccard-tokens")
    own = first.groupBy(F.col("id").alias("class")).agg(F.when(F.min("n") == F.max("n"), F.max("n")).cast("int").alias("n"))
    known = groups.groupBy("class").agg(F.count(F.lit(1)).cast("int").alias("degree")).join(own, "class")
    groups = saved(groups.join(known, "class"), "jaccard-groups")
    labels, done, members = None, None, groups
    for step in ("first hubs", "hubs", "hubs", "all"):
        if step == "first hubs":
            pairs = _towards_first_hubs(groups)
        else:
            members = _open_groups(members.select(*groups.columns), labels)
            pairs = _across(members, described) if step == "all" else _towards_hubs(members)
        if done is not None:
            pairs = pairs.join(done, ["class", "centre"], "left_anti")
        pairs = saved(pairs, "jaccard-pairs")
        done = pairs if done is None else done.unionByName(pairs)
        chosen = saved(_filtered(pairs, described), "jaccard-candidates")
        counted = chosen.count()
        if not counted:
            continue
        links = _verified(docs, chosen, counted)
        labels = _merged(labels, links)
    out = small.join(sets, ["d1", "d2", "n"], "left")
    if labels is None:
        component = F.coalesce("class", "id")
    else:
        out, component = out.join(labels.withColumnRenamed("node", "class"), "class", "left"), F.coalesce("label", "class", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
