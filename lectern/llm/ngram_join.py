"""Self-join of documents by the Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

Two sets with |A & B| >= t |A | B| share at least L shingles of their prefixes when a prefix is the first
|A| - ceil(t |A|) + L shingles in one global order.  The order is by the rarest word of a shingle, rare first: a sketch of the corpus's word
counts gives a bound on how many documents can hold the shingle, and words are far fewer than shingles.  Each
document takes the L of least estimated cost: where its prefix is common, it takes a longer one and asks for more matches.

Sets that are equal are one class from the start.  A shingle that two prefixes share is a bucket; its documents meet in
tiles of bounded size, where size, a parity bitmap (whose difference cannot exceed the sets' difference) and the number of
shared prefix shingles rule pairs out.  What passes is verified on the whole sets.  Since components are asked for, not
pairs, each document first offers two candidates of a tile only, its nearest and the one of smallest id; what these links
tie together gets a common label, though not always all of a component.  The second round then takes every candidate pair of
different labels, so that no link is lost, while a large group of near copies costs a few verifications a document.

Defined cases: a null or empty text has no shingles and links with nothing; a text of fewer than k words is one shingle;
a text of any length counts whole; a null id links with nothing and has no component; rows that repeat an id are one node
with all their links; of equally near candidates the one of smallest id counts; an empty table gives an empty one; other
columns are ignored, whatever they are named.  Shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, store, text
from .components import connected_components, within_tasks

U = np.uint64
#: Slots of the word sketch: one for so many bytes of input, within these powers of two.
SLOT_BYTES, SKETCH = 128, (16, 22)
WORDS = 16  # of 64 bits in a parity bitmap
LENGTHS = (1, 2, 4, 8, 16, 32)
TILE = 512
#: So many times a large bucket is dealt into tiles in the first round.
DEALS = 2
FILTER = 21
HUB = 500
#: Relative costs of a posting, of a candidate met in a bucket, and of one verified.
POSTING, MET, VERIFIED = 1.0, 0.02, 2.0


def overlap(percent: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of shared shingles for 100 |A & B| >= percent |A | B|."""
    return -(-percent * (a + b) // (100 + percent))


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a set, by sums of two mixtures."""
    with np.errstate(over="ignore"):
        return np.array([text.mix(s ^ U(0x243F6A8885A308D3)).sum(dtype=U), text.mix(s * U(0x9E3779B97F4A7C15)).sum(dtype=U)], U).tobytes() if len(s) else b""


def bitmap(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((s & U(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8)).tobytes()


def prefix(s: np.ndarray, count: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a sorted set in the global order, and how many shingles of it a partner has to share.

    count: bounds on the numbers of documents with each shingle.
    """
    n = len(s)
    order = np.argsort(count, kind="stable")
    need = -(-percent * n // 100)
    shortest = n - need + 1
    hot = np.cumsum(np.maximum(count[order[: min(n, shortest + LENGTHS[-1])]] - 1.0, 0.0))
    best, length = np.inf, 1
    for m in LENGTHS:
        p = shortest + m - 1
        if m > need or p > n:
            break
        cost = POSTING * p + MET * hot[p - 1] + VERIFIED * hot[p - 1] / m
        if cost < best:
            best, length = cost, m
    return s[order[: shortest + length - 1]], length


def _sets(batches, k: int):
    for batch, data, at in text.pieces(batches):
        h, n = text.word_hashes(data, at)
        yield batch, text.shingles(h, n, k), h, n


def rarest(h: np.ndarray, n: np.ndarray, sets: list[np.ndarray], count: np.ndarray, k: int):
    """For each row the sketch's least count among the words of each shingle, in the order of the row's set."""
    bits = U(64 - (len(count).bit_length() - 1))
    c = count[(h >> bits).astype(np.int64)]
    m = len(c) - k + 1
    low = c[:m].copy() if m > 0 else c[:0]
    for j in range(1, k):
        if m > 0:
            np.minimum(low, c[j : m + j], out=low)
    at = text.shingle_hashes(h, k)
    i = 0
    for words, s in zip(n.tolist(), sets, strict=True):
        if words >= k:
            _, first = np.unique(at[i : i + words - k + 1], return_index=True)
            yield low[i : i + words - k + 1][first]
        else:
            yield c[i : i + words].min(keepdims=True) if words else c[:0]
        i += words


def candidates(tile: np.ndarray, ids: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, bits: np.ndarray, percent: int):
    """Pairs of positions within a tile that size and bitmap let pass, of different label (and side, where sides count).

    tile is sorted; pairs come by the distance of their places, so that no position is twice on one side of a yield.  The
    third array is the bitmaps' difference relative to the sizes.
    """
    i = np.arange(len(tile))
    d = 0
    while True:
        d += 1
        i = i[i + d < len(tile)]
        i = i[tile[i] == tile[i + d]]
        if not len(i):
            return
        j = i + d
        ok = (label[i] != label[j]) & (ids[i] != ids[j]) & ((side[i] != side[j]) | (side[i] == 2))
        ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        a, b = i[ok], j[ok]
        if len(a):
            total = n[a] + n[b]
            x = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
            ok = x <= total - 2 * overlap(percent, n[a], n[b])
            yield a[ok], b[ok], x[ok] / total[ok]


def offers(pairs, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each position's nearest partner, and its partner of smallest id: positions, partners, differences."""
    near, at, low = np.full(len(ids), np.inf), np.full(len(ids), -1), np.full(len(ids), -1)
    far_low = np.full(len(ids), np.inf)
    for a, b, far in pairs:
        for x, y in ((a, b), (b, a)):
            better = (far < near[x]) | ((far == near[x]) & (ids[y] < ids[at[x]]))
            near[x[better]], at[x[better]] = far[better], y[better]
            lower = (low[x] < 0) | (ids[y] < ids[low[x]])
            low[x[lower]], far_low[x[lower]] = y[lower], far[lower]
    has = np.flatnonzero(at >= 0)
    other = has[low[has] != at[has]]
    return np.concatenate([has, other]), np.concatenate([at[has], low[other]]), np.concatenate([near[has], far_low[other]])


def either(pairs: DataFrame) -> DataFrame:
    """The ids of both sides."""
    return pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))


def _slot(ids: np.ndarray) -> np.ndarray:
    return (text.mix(ids.astype(np.int64).view(U)) >> U(64 - FILTER)).astype(np.int64)


CARD = "id long, fp binary, twin boolean, n long, ell int, bits binary, tokens array<long>"


class Join:
    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str):
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        self.folder = store.new_folder(self.spark, "ngrams")
        size = store.input_bytes(docs, SLOT_BYTES << SKETCH[0])
        self.bits = min(max((max(size, 1) // SLOT_BYTES).bit_length(), SKETCH[0]), SKETCH[1])
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def first_pass(self) -> DataFrame:
        """Set sizes and fingerprints, and the word sketch's parts, from one reading of the texts."""
        k, bits = self.k, self.bits

        def run(batches):
            sketch = np.zeros(1 << bits, np.int64)
            for batch, sets, h, _ in _sets(batches, k):
                np.add.at(sketch, (h >> U(64 - bits)).astype(np.int64), 1)
                m = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([fingerprint(x) for x in sets], pa.binary()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=["id", "n", "fp", "name", "slice", "counts"])
            for r in arrays.parts("sketch", sketch):
                m = r.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), *r.columns], names=["id", "n", "fp", "name", "slice", "counts"])

        return store.saved(self.docs.mapInArrow(run, "id long, n long, fp binary, " + arrays.ROWS), self.folder, "first")

    def marks(self, ids: DataFrame):
        """A filter of fixed size that lets these ids pass, and few others, as a broadcast array of booleans."""

        def mark(batches):
            seen = np.zeros(1 << FILTER, np.int64)
            for b in batches:
                seen[_slot(b.column(0).to_numpy())] = 1
            yield from arrays.parts("ids", seen)

        got = arrays.collected(ids.select("id").mapInArrow(mark, arrays.ROWS), 1 << FILTER).get("ids", np.zeros(1 << FILTER, np.int64)) > 0
        return self.spark.sparkContext.broadcast(got)

    def cards(self, sketch: np.ndarray, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """Size, prefix, match number and bitmap of each class's first document.

        Only documents that may have equal ones, by a filter, go through the join that keeps the first.
        """
        k, percent = self.k, self.percent
        shared = self.spark.sparkContext.broadcast(sketch.astype(np.float32))
        twins = self.marks(rows.join(classes.where("docs > 1").select("fp"), "fp", "left_semi").where("id is not null"))

        def run(batches):
            count = shared.value
            for batch, sets, h, words in _sets(batches, k):
                got = [prefix(s, c, percent) if len(s) else (s, 1) for s, c in zip(sets, rarest(h, words, sets, count, k), strict=True)]
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p, _ in got])]).astype(np.int32)), pa.array(np.concatenate([p for p, _ in got]).view(np.int64)))
                twin = pa.array(twins.value[_slot(batch.column("id").to_numpy())])
                out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array([fingerprint(s) for s in sets], pa.binary()), twin, pa.array([len(s) for s in sets], pa.int64()), pa.array([m for _, m in got], pa.int32()), pa.array([bitmap(s) for s in sets], pa.binary()), tokens], names=["id", "fp", "twin", "n", "ell", "bits", "tokens"])
                yield out.filter(pa.array([len(s) > 0 for s in sets]))

        rows = self.docs.where("id is not null and text is not null")
        every = store.saved(rows.mapInArrow(run, CARD), self.folder, "cards").withColumn("card", F.xxhash64("id", "fp"))
        first = classes.select("fp", F.col("rep").alias("id"))
        return every.where("not twin").unionByName(every.where("twin").join(first, ["fp", "id"], "left_semi")).drop("fp", "twin")

    def live(self, cards: DataFrame) -> DataFrame:
        """Cards that share a prefix shingle with another, with those shingles, and the size and a mark of each one's bucket.

        Buckets of the same cards have the same mark, so that these meet once and not for each shingle that they share.
        """
        posts = cards.select("card", F.explode("tokens").alias("token")).repartition("token")  # one exchange, for counting and for the join
        buckets = posts.groupBy("token").agg(F.count("card").alias("c"), F.bit_xor("card").alias("mark")).where("c > 1")
        shared = posts.join(buckets, "token").groupBy("card").agg(F.collect_list(F.struct("token", "c", "mark")).alias("shared"))
        return store.saved(cards.drop("tokens").join(shared, "card").drop("card"), self.folder, "live")

    def tiles(self, live: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Rows (tile, id, n, bits, label, side) of bounded tiles; a tile's number is a hash of what it is for.

        Without labels, a large bucket is dealt into tiles by hash, twice.  With labels, all pairs of different labels meet:
        of a large bucket the rows with its commonest label stand on one side, the others on the other.
        """
        rows = live.withColumn("label", F.col("id")) if labels is None else live.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        marks = F.array_distinct(F.transform("shared", lambda t: F.struct(t["mark"].alias("token"), t["c"].alias("c"))))
        rows = rows.withColumn("t", F.explode(marks)).select("id", "n", "bits", "label", "t.token", "t.c")
        columns = [F.xxhash64("token", "kind", "i", "j").alias("tile"), "id", "n", "bits", "label", "side"]
        if labels is None:
            parts = F.ceil(F.col("c") / TILE)
            deals = F.when(F.col("c") > TILE, F.sequence(F.lit(0), F.lit(DEALS - 1))).otherwise(F.array(F.lit(0)))
            rows = rows.withColumn("j", F.explode(deals)).withColumn("i", F.pmod(F.xxhash64("id", "j"), parts).cast("int"))
            return rows.withColumns({"kind": F.lit(0), "side": F.lit(2)}).select(columns)
        small = rows.where(F.col("c") <= TILE).withColumns({"kind": F.lit(0), "i": F.lit(0), "j": F.lit(0), "side": F.lit(2)}).select(columns)
        large = rows.where(F.col("c") > TILE)
        by_label = large.groupBy("token", "label").agg(F.count("*").alias("m"))
        top = by_label.groupBy("token").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all"), F.count("*").alias("labels")).where("labels > 1")
        top = top.select("token", F.col("top.label").alias("most"), F.ceil(F.col("top.m") / TILE).cast("int").alias("bm"), F.ceil((F.col("all") - F.col("top.m")) / TILE).cast("int").alias("bn"))
        top = store.saved(top, self.folder, "top")  # stored, so that the join can split a token with many rows
        large = large.join(top, "token").withColumn("minor", F.col("label") != F.col("most"))
        to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        h = F.xxhash64("id", F.lit(DEALS))
        place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
        major = large.where("not minor").withColumn("own", F.pmod(h, F.col("bm")).cast("int")).withColumn("at", F.transform(to("bn"), lambda x: place(1, x, F.col("own"), 0)))
        minor = large.where("minor").withColumn("own", F.pmod(h, F.col("bn")).cast("int"))
        minor = minor.withColumn("at", F.concat(F.transform(to("bm"), lambda x: place(1, F.col("own"), x, 1)), F.transform(to("bn"), lambda x: place(2, F.least("own", x), F.greatest("own", x), 2))))
        spread = major.unionAll(minor).withColumn("at", F.explode("at")).select("id", "n", "bits", "label", "token", "at.*").select(columns)
        return small.unionAll(spread)

    def met(self, tiles: DataFrame, every: bool) -> DataFrame:
        """Candidate pairs (a, b), a < b, that size and bitmap let pass: each document's nearest and smallest, or every one."""
        percent = self.percent

        def found(t: pa.Table):
            ids, n, label, side, tile = (t.column(c).to_numpy() for c in ("id", "n", "label", "side", "tile"))
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), U).reshape(-1, WORDS)
            pairs = candidates(tile, ids, n, label, side, bits, percent)
            if every:
                got = [*pairs] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                a, b, far = map(np.concatenate, zip(*got, strict=True))
            else:
                a, b, far = offers(pairs, ids)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(far)], names=["a", "b", "far"])

        def run(batches):
            """Whole tiles at a time; a tile that a batch cuts waits for its rest."""
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.num_rows
                if size >= 2 * TILE:
                    t = pa.Table.from_batches(held).combine_chunks()
                    tile = t.column("tile").to_numpy()
                    last = int(np.searchsorted(tile, tile[-1]))
                    if last:
                        yield found(t.slice(0, last).combine_chunks())
                    held = t.slice(last).combine_chunks().to_batches()
                    size = t.num_rows - last
                    size = size if size < 2 * TILE else 0
            if held and (t := pa.Table.from_batches(held).combine_chunks()).num_rows:
                yield found(t)

        out = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long, far double")
        if not every:
            out = out.groupBy("a").agg(F.min(F.struct("far", "b")).alias("m"), F.min("b").alias("b")).select("a", F.explode(F.array("m.b", "b")).alias("b"))
        return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def agreeing(self, pairs: DataFrame, live: DataFrame) -> DataFrame:
        """The pairs that share enough prefix shingles."""
        own = lambda side: live.select(F.col("id").alias(side), F.col("ell").alias(f"ell_{side}"), F.col("shared.token").alias(f"tokens_{side}"))
        both = pairs.join(own("a"), "a").join(own("b"), "b")
        return both.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.least("ell_a", "ell_b")).select("a", "b")

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """Whole sets of these distinct ids' documents, and of few others, which a filter of fixed size lets pass."""
        k = self.k

        shared = self.marks(ids)

        def run(batches):
            some = ((b, shared.value[_slot(b.column("id").to_numpy())]) for b in batches)
            for batch, sets, _, _ in _sets((b.filter(pa.array(m)) for b, m in some if m.any()), k):
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

        rows = self.docs.where("id is not null and text is not null").mapInArrow(run, "id long, set binary")
        return store.saved(rows, self.folder, name)

    def verified(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs whose whole sets are similar enough.  The partners of a document that many name are dealt out."""
        percent = self.percent
        hubs = store.saved(pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")), self.folder, f"hubs-{name}")
        with_a = pairs.join(hubs, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).join(sets.select(F.col("id").alias("a"), "set"), "a").select("b", "part", "a", "set")
        with_b = hubs.join(sets.select(F.col("id").alias("b"), "set"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "set")

        def run(batches):
            key, own = None, []
            for batch in batches:
                out: list[tuple[int, int]] = []
                for b, part, a, s in zip(*(batch.column(c).to_pylist() for c in ("b", "part", "a", "set")), strict=True):
                    s = np.frombuffer(s, U)
                    if a is None:
                        own = [*own, s] if key == (b, part) else [s]
                        key = (b, part)
                    else:
                        for o in own:
                            both = len(np.intersect1d(s, o, assume_unique=True))
                            if len(s) and 100 * both >= percent * (len(s) + len(o) - both):
                                out.append((a, b))
                                break
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

        rows = with_b.unionAll(with_a).repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
        return store.saved(rows.mapInArrow(run, "a long, b long"), self.folder, name)

    def same_ids(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """Links between an id that has several sets and the first documents of their classes; seldom any."""
        several = rows.where("n > 0 and id is not null").groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("id")
        if several.isEmpty():
            return self.spark.createDataFrame([], "a long, b long")
        return rows.where("n > 0").join(several, "id").join(classes, "fp").where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b"))

    def labels(self, links: DataFrame) -> DataFrame:
        """(node, component) of the links' nodes: a node of the same component, the same for most of its nodes.

        Every node takes the smallest one next to it, and then twice the one which that has taken.
        """
        links = within_tasks(links)
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        out = store.saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), self.folder, "next")
        for step in range(2):
            out = store.saved(out.join(out.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.coalesce("c", "component").alias("component")), self.folder, f"jump{step}")
        return out

    def run(self) -> DataFrame:
        first = self.first_pass()
        rows = first.where("name is null").select("id", "n", "fp")
        sketch = arrays.collected(first.where("name is not null").select("name", "slice", "counts"), 1 << self.bits).get("sketch", np.zeros(1 << self.bits, np.int64))
        classes = store.saved(rows.where("n > 0 and id is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("docs")), self.folder, "classes")
        live = self.live(self.cards(sketch, rows, classes))
        near = store.saved(self.agreeing(self.met(self.tiles(live, None), False), live), self.folder, "near0")
        sets = self.sets(either(near).distinct(), "sets0")
        links = self.verified(near, sets, "links0")
        near = store.saved(self.agreeing(self.met(self.tiles(live, self.labels(links)), True), live), self.folder, "near1")
        if not near.isEmpty():
            new = store.saved(either(near).distinct().join(sets, "id", "left_anti"), self.folder, "new1")
            if not new.isEmpty():
                sets = sets.unionAll(self.sets(new, "sets1"))
            links = links.unionAll(self.verified(near, sets, "links1"))
        labels = connected_components(links.unionAll(self.same_ids(rows, classes)), self.folder)
        # a class's component is that of its first document
        known = classes.join(labels, F.col("node") == F.col("rep"), "left").select("fp", F.coalesce("component", "rep").alias("c"))
        out = rows.join(known, "fp", "left")
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))


def components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link from a Jaccard similarity of percent / 100 on."""
    return Join(docs, k, percent, id_col, text_col).run()
