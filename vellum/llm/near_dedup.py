"""MinHash near-deduplication by fast similarity sketching.

A text is the set of its word shingles. The sketch fills T bins in rounds: round i throws
every shingle into one hashed bin and a bin keeps the least (round, value); should bins be
left after T rounds, round T + b puts all shingles into bin b, so every coordinate fills.
Rounds of low number win, so a sketch is finished as soon as it is full. Two coordinates
agree with the probability of the sets' similarity, with the concentration of independent
hashing. Bands of coordinates give the candidates; links are confirmed on the full sets.

A node is a distinct set, whatever the ids of its rows. In each bucket every node is first
compared with one centre (another one in each band); the links found give components. The
nodes of the buckets that still hold several components are then joined once more, exactly,
by an inverted index of shingles: two sets as similar as asked must share a shingle among
the first fifth of each, in any common order. The order puts frequent shingles last, so
that the lists of the index are short; what is frequent all the same is compared tile by
tile. Components come by stars, within parts of the edges and then between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, few, join_groups, map_arrow, release, stored

WORDS, PERCENT = 5, 80
#: 42 bands of 6 coordinates: a pair at the threshold of 0.8 is missed with a chance below 1e-5.
BANDS, ROWS = 42, 6
#: Partners of a centre, or rows of a list of the inverted index, that one task handles at once, and the shingles in them.
SLICE, SLICE_ITEMS = 128, 1 << 20
#: Shingles in one product of a tile.
COLUMNS = 1 << 14
#: Pairs with both of their sets, and sets or rows of an index with theirs, that a task takes at least.
WIDE_ROWS = 1_000
#: Edges in one part of the components' first step.
PART_EDGES = 20_000
#: Distinct words whose hashes a worker keeps.
CACHE = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Bits of a value within its round.
_VALUE = 40


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct hashes of a text's word shingles. Words: [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""

    def __init__(self, words: int):
        self.words = words
        self.seen: dict[bytes, int] = {}

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(_LOWER).split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen = self.seen
        for w in set(words):
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.words, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            out = out * _P + h[i : i + n]
        return np.unique(mix(out))


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row per set (none empty), `size` coordinates each: (round << 40 | value) of the least shingle in each bin."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    out = np.full(len(sets) * size, np.iinfo(np.uint64).max, dtype=np.uint64)
    low = np.uint64((1 << _VALUE) - 1)
    for i in range(2 * size):
        if not len(x):
            break
        with np.errstate(over="ignore"):
            v = mix(x + np.uint64(i + 1) * _P)
        bins = ((v >> np.uint64(_VALUE)) * np.uint64(size) >> np.uint64(64 - _VALUE)).astype(np.int64) if i < size else i - size
        np.minimum.at(out, owner * size + bins, np.uint64(i << _VALUE) | (v & low))
        open_ = (out.reshape(-1, size) == np.iinfo(np.uint64).max).any(axis=1)
        keep = open_[owner]
        x, owner = x[keep], owner[keep]
    return out.reshape(-1, size)


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    rows = sketch.shape[1] // bands
    parts = sketch.reshape(len(sketch), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mix(out * _P + parts[:, :, r])
    return out.view(np.int64)


def _lists(values: np.ndarray, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th, n_shingles, d1 and d2 (a 128-bit digest of the whole set), bands. docs: doc_id, th (a hash of the text), _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            sets = [shingles.of(t) for t in batch.column(2).to_pylist()]
            n = [len(s) for s in sets]
            hashes = band_hashes(sketches([s for s in sets if len(s)], bands * rows), bands)
            digests = _digests(sets)
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), _lists(hashes.ravel(), [bands * (k > 0) for k in n])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n_shingles", "d1", "d2", "bands"])

    return map_arrow(docs.select("doc_id", "th", F.col("_text").cast("binary")), run, "doc_id long, th long, n_shingles long, d1 long, d2 long, bands array<long>")


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """node, items: the whole shingle sets of the rows (node, d1, d2, _text) whose digest is the node's; a node that a task meets again is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, met = Shingles(words), set()
        for batch in batches:
            nodes, d1, d2, found = *(batch.column(i).to_pylist() for i in range(3)), []
            for node, want, text in zip(nodes, zip(d1, d2, strict=True), batch.column(3).to_pylist(), strict=True):
                if node not in met and tuple(_digests([s := shingles.of(text)])[0].tolist()) == want:
                    met.add(node)
                    found.append((node, s))
            values = np.concatenate([np.empty(0, np.uint64), *[s for _, s in found]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), _lists(values, [len(s) for _, s in found])], names=["node", "items"])

    return map_arrow(texts.select("node", "d1", "d2", F.col("_text").cast("binary")), run, "node long, items array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, centre) whose full sets are similar enough. A centre's partners are dealt to slices, so none is hot."""
    rows = pairs.count()
    fans = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("n"))
    pairs = join_groups(pairs, fans, "centre", "n", rows)
    pairs = pairs.select("node", "centre", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SLICE)).alias("slice"))
    centres = pairs.select("centre", "slice").distinct().join(sets.select(F.col("node").alias("centre"), F.col("items").alias("other")), "centre")
    both = few(pairs.join(sets, "node"), rows, WIDE_ROWS).join(few(centres, rows, WIDE_ROWS), ["centre", "slice"])
    shared = F.size(F.array_intersect("items", "other"))
    alike = both.filter(shared * 100 >= percent * (F.size("items") + F.size("other") - shared)).select("node", "centre")
    return few(few(alike, rows, WIDE_ROWS).distinct(), rows)


def _forest(edges: pa.Table) -> pa.Table:
    """Edges (a, b) replaced by as few as can be: each node of theirs to the least that it reaches, by union-find."""
    a, b = edges["a"].to_numpy(), edges["b"].to_numpy()
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in zip(place[: len(a)].tolist(), place[len(a) :].tolist(), strict=True):
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    least = np.array([root(i) for i in range(len(nodes))], dtype=np.int64)
    own = np.flatnonzero(least != np.arange(len(nodes)))
    return pa.table([pa.array(nodes[own], pa.int64()), pa.array(nodes[least[own]], pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on stored edges (a, b), a > b: the neighbours of each node that are larger (or else, those that are not) move to its least neighbour."""
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        around = around.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    total = edges.count() * (2 if large else 1)
    met = join_groups(around, least, "u", "n", total)
    moved = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(few(least.select(F.col("u").alias("a"), F.col("m").alias("b")), total))
    return few(moved.filter("a <> b").distinct(), total)


def settled(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b), a > b, are stars around least nodes: no node has an edge to a lesser one and another edge besides."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.max("up").alias("up"), F.count(F.lit(1)).alias("n"))
    return few(nodes, 2 * edges.count()).agg(F.count_if((F.col("up") == 1) & (F.col("n") > 1))).first()[0] == 0


def components(edges: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """node, label of all nodes with an edge (a, b), a <> b: the least node reachable.

    First each part of about `part_edges` edges is replaced by its own forest. Then large
    and small stars alternate until every node has one edge, to its least, which a round
    would leave as it is: after about log(n) rounds. All tables are narrow; hot nodes
    are joined by broadcast; of each round only its outcome is kept.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    plain = edges.filter("a <> b").select(most.alias("a"), least.alias("b")).distinct()
    held = stored(plain, "edges")
    parts = max(1, -(-held.count() // part_edges))

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _forest(pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))).to_batches()

    # Parts are what they are, however many partitions the session deals keys to.
    now = stored(few(held.repartition(parts, "b").coalesce(parts).mapInArrow(forest, "a long, b long").distinct(), parts * part_edges), "edges")
    release(held)
    while not settled(now):
        large = stored(_star(now, True), "edges")
        small = stored(_star(large, False), "edges")
        release(now, large)
        now = small
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = cut(ends.unionByName(few(ends.select("label").distinct(), ends.count()).select(F.col("label").alias("node"), "label")))
    release(now)
    return out


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b: products of their incidence, COLUMNS shingles at a time."""
    flat, owner = zip(*[(np.concatenate([np.empty(0, np.int64), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])) for sets in (a, b)], strict=True)
    common = np.intersect1d(*flat)
    out = np.zeros((len(a), len(b)), np.float32)
    held = []
    for items, of in zip(flat, owner, strict=True):
        at = np.searchsorted(common, items)
        hit = common[np.minimum(at, len(common) - 1)] == items if len(common) else np.zeros(len(items), bool)
        order = np.argsort(at[hit], kind="stable")
        held.append((at[hit][order], of[hit][order]))
    for low in range(0, len(common), COLUMNS):
        sides = []
        for (at, of), n in zip(held, (len(a), len(b)), strict=True):
            part = slice(*np.searchsorted(at, [low, low + COLUMNS]))
            side = np.zeros((n, min(COLUMNS, len(common) - low)), np.float32)
            side[of[part], at[part] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _cross(percent: int):
    def cross(odd: pa.Table, rows: pa.Table) -> pa.Table:
        """Links between nodes of different components, one of each side."""
        a = b = np.empty(0, np.int64)
        if len(odd) and len(rows):
            left, right = ([np.asarray(v) for v in t[c].combine_chunks().to_numpy(zero_copy_only=False)] for t, c in ((odd, "odd_items"), (rows, "items")))
            shared = shared_counts(left, right)
            union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right]) - shared
            i, j = np.nonzero((odd["odd_label"].to_numpy()[:, None] != rows["label"].to_numpy()) & (shared * 100 >= percent * union))
            a, b = odd["odd_node"].to_numpy()[i], rows["node"].to_numpy()[j]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return cross


def prefix_length(n: int, percent: int) -> int:
    """Of a set of n shingles: any set similar enough shares one of the first so many, in any order that both follow."""
    return n - -(-percent * n // 100) + 1


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """item, node, label, n: the first shingles of each set (node, label, items) in the order of (rows that have them, shingle), without those that no other set has."""
    items = sets.select("node", "label", F.size("items").cast("long").alias("n"), F.explode("items").alias("item"))
    shared = items.groupBy("item").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    met = join_groups(items, shared, "item", "rows", items.count())
    own = met.groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("rows", "item"))).alias("shared"))  # at most a set's own shingles
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1  # prefix_length()
    first = F.slice("shared", F.lit(1), F.greatest(F.lit(0), length - F.col("n") + F.size("shared")).cast("int"))
    return own.select("node", "label", "n", F.explode(first).alias("t")).select("t.item", "node", "label", "n")


def leftovers(entries: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components, of all nodes in buckets that hold several. entries: bucket, node."""
    nodes, n = entries.select("node").distinct(), entries.count()
    known = stored(few(nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")), n), "labels")
    of = entries.join(known, "node").groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.min("label").alias("low"), F.max("label").alias("high"))
    # With two rows, the centre has met the other; with one component, nothing is left.
    mixed = of.filter("low < high AND rows > 2").select("bucket", "rows")
    asked = stored(few(join_groups(entries, mixed, "bucket", "rows", n).select("node").distinct().join(known, "node"), n), "asked")
    held = stored(few(asked.join(sets, "node").select("node", "label", "items"), asked.count(), WIDE_ROWS), "asked-sets")
    lists = stored(few(prefixes(held, percent), held.count(), WIDE_ROWS), "lists")
    totals = lists.groupBy("item").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("items"), F.min("label").alias("low"), F.max("label").alias("high"))
    totals = stored(few(totals.filter("low < high").select("item", "rows", "items"), lists.count()), "totals")
    # Short lists: pairs of other components whose sizes allow the similarity, each once, then confirmed.
    short = lists.join(totals.filter(F.col("rows") <= SLICE).select("item"), "item")
    other = short.select(*[F.col(c).alias(f"other_{c}") for c in ("item", "node", "label", "n")])
    fits = (F.col("item") == F.col("other_item")) & (F.col("node") < F.col("other_node")) & (F.col("label") != F.col("other_label")) & (F.least("n", "other_n") * 100 >= percent * F.greatest("n", "other_n"))
    pairs = stored(few(short.join(other, fits).select("node", F.col("other_node").alias("centre")).distinct(), lists.count()), "pairs")
    links = [confirmed(pairs, held.select("node", "items"), percent).select(F.col("node").alias("a"), F.col("centre").alias("b"))]
    # Long lists: tiles of both sides, bounded in rows and shingles; only links come out.
    long = totals.filter(F.col("rows") > SLICE)
    if not long.isEmpty():
        parts = F.greatest(F.ceil(F.col("rows") / SLICE), F.ceil(F.col("items") / SLICE_ITEMS))
        placed = join_groups(lists.select("item", "node", "label"), long.select("item", "rows", parts.alias("parts")), "item", "rows", lists.count()).select("item", "node", "label", "parts")
        full = placed.join(held.select("node", "items"), "node")
        deal = F.pmod(F.xxhash64("node"), F.col("parts"))
        spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        rows = full.select("item", deal.alias("i"), spread.alias("j"), "node", "label", "items")
        # Each pair once: the side that is dealt to the lower part, or within a part both.
        odd = full.select(F.col("item").alias("odd_item"), deal.alias("j"), spread.alias("i"), F.col("node").alias("odd_node"), F.col("label").alias("odd_label"), F.col("items").alias("odd_items")).filter("i <= j")
        links.append(odd.groupBy("odd_item", "i", "j").cogroup(rows.filter("i <= j").groupBy("item", "i", "j")).applyInArrow(_cross(percent), "a long, b long"))
    out = cut(few((links[0] if len(links) == 1 else links[0].unionByName(links[1])).distinct(), lists.count()))
    release(known, asked, held, lists, totals, pairs)
    return out


def near_rows(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, th (text_hash()), n_shingles, component_id, component (a number for each component; null for rows that are linked with nothing by definition): one row per input row, as near_dedup() says."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text")).withColumn("th", text_hash(F.col("_text")))
    signed = stored(signatures(docs, words, bands, rows), "signatures")
    keys, row, n = ["d1", "d2"], ["doc_id", "th"], signed.count()
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # One row stands for each distinct set: one with its least id.
    groups = some.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.min_by("th", "doc_id").alias("th"), F.count(F.lit(1)).alias("size"))
    groups = stored(few(groups, n).withColumn("node", F.monotonically_increasing_id()), "groups")
    chosen = groups.select(*keys, F.col("least").alias("doc_id"), "th", "node")
    nodes = stored(some.select(*row, *keys, "bands").join(chosen.hint("shuffle_hash"), [*row, *keys]).select("node", "bands"), "nodes")
    if nodes.count() > groups.count():  # rows that are there several times
        repeated, nodes = nodes, stored(nodes.dropDuplicates(["node"]), "nodes")
        release(repeated)
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    # The centre is the node that is least after an exclusive or with the bucket's hash: any node, another one in each bucket.
    mask = F.xxhash64("bucket")
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("node").bitwiseXOR(mask)).alias("least")).filter("n > 1")
    most = groups.count() * bands
    buckets = cut(few(buckets.select("bucket", "n", F.col("least").bitwiseXOR(mask).alias("centre")), most))
    met = stored(join_groups(entries, buckets, "bucket", "n", most).select("bucket", "node", "centre"), "buckets")
    release(nodes)
    pairs = cut(few(met.filter("node <> centre").select("node", "centre").distinct(), met.count()))
    asked = few(chosen.join(met.select("node").distinct(), "node", "left_semi"), n)
    sets = stored(full_sets(docs.join(asked.hint("shuffle_hash"), row).select("node", *keys, "_text"), words), "sets")
    links = cut(confirmed(pairs, sets, percent).select(F.col("node").alias("a"), F.col("centre").alias("b")))
    labels = components(links)
    extra = leftovers(met.select("bucket", "node"), labels, sets, percent)
    if not extra.isEmpty():
        labels = components(links.unionByName(extra))
    release(met, sets)
    # The least id of each component, then of each set, then of each row; hot ones are joined by broadcast.
    of = labels.join(groups.select("node", "least"), "node")
    of = few(of, groups.count())
    least = of.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    found = join_groups(labels, least, "label", "n", labels.count()).select("node", "label", "component_id")
    labelled = few(groups.join(found, "node", "left"), groups.count()).select(*keys, "size", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("label", "node").alias("component"))
    columns = ["doc_id", "th", "n_shingles", "component_id", "component"]
    linked = join_groups(some.select("doc_id", "th", "n_shingles", *keys), labelled, keys, "size", n)
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
    return linked.select(*columns).unionByName(alone.select(*columns))


def text_hash(text: Column) -> Column:
    """With the id, it names the rows of one text."""
    return F.xxhash64(text)


def near_kept(docs: DataFrame, text: str = "text", **options: int) -> DataFrame:
    """doc_id, th, n: the one row of each component that stays, by its id and text_hash(); n rows have both.

    It is a row with the smallest doc_id, then text_hash(). Rows without words or id are linked with nothing:
    all of them stay, and n is 1.
    """
    rows = cut(near_rows(docs, text, **options))
    own = rows.filter("component IS NOT NULL AND doc_id = component_id")
    alone = rows.filter("component IS NULL").select("doc_id", "th").distinct().withColumn("n", F.lit(1).cast("long"))
    # Texts of one component that share the smallest id: few, but for a hot id.
    texts = own.groupBy("component", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    best = texts.groupBy("component").agg(F.min_by(F.struct("doc_id", "th", "n"), "th").alias("b"))
    return best.select("b.*").unionByName(alone)


def near_dedup(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Two texts are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable by links, and the row with that id is
    kept. A text of fewer than `words` words has its whole sequence as one shingle.

    * null text, or one without words: n_shingles 0, linked with nothing, kept.
    * null doc_id: links with nothing, component_id null, kept.
    * repeated rows: same component, and each row whose doc_id is component_id is kept.
    * rows that share a doc_id but not their text: each has the component of its own text.
    * equally similar partners (ties): all of them are linked; nothing is chosen.
    * very long texts: read whole; a set is in one task's memory (8 bytes a shingle).
    * an empty table gives no rows; other columns are ignored, whatever their names.
    """
    out = near_rows(docs, text, words, percent, bands, rows)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
