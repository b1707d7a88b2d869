"""Near-duplicate components by MinHash bands and sequential Bayesian verification.

1. Every text becomes the set of its distinct word shingles, kept as a digest of
   the set, its size and a MinHash signature. Equal sets collapse to their
   least document by a grouped minimum, so copies cost one row.
2. Signature bands put the remaining sets in buckets. With ``BANDS`` bands of
   ``ROWS`` values a pair at the threshold of 0.8 shares no bucket with
   probability (1 - 0.8**4)**24, about 3e-6.
3. A bucket's members are first compared with the bucket's least member. Each
   comparison reads the signatures a batch at a time; under a uniform prior the
   posterior probability that the similarity reaches the threshold after m of n
   equal values is P(Binomial(n + 1, threshold) <= m), and the pair is dropped
   once that falls below ``miss``. Survivors are confirmed on the full sets.
4. Pairs of one component need no comparison, so in each bucket only members
   outside its most frequent component, the minority, are compared with the others,
   each pair in the first band that it shares. Sets whose sizes are too far apart for the
   threshold need no comparison either, so a large bucket is cut into cells of like
   sizes, each of two neighbouring classes. Members of a cell are dealt out in blocks of
   bounded rows and bytes; each goes once to every block of the minority, of which
   there is one unless it is large itself. Before that, a round deals each member to
   one block of each bucket, by another hash in every band, confirms its likeliest
   partner there and merges components anew, so the rest is small. What is then still
   apart brings its texts to its block pair, where the exact test runs over all
   surviving pairs and returns one link for each two components that prove to be
   one. So no link is lost, and rows grow with a group's size times its unlinked rest.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.arrowtext import Texts, Words, bounded_batches, mix64, ngram_hashes, pieces, release, row_sums, tidied
from parchmint.llm.components import connected_components
from parchmint.llm.scratch import Scratch

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Signature values read before each decision of the sequential test.
STEPS = (16, 32, 64, HASHES)
#: Members of a bucket in a block, and about how many bytes their texts have; a task compares two blocks.
BLOCK = 256
BLOCK_BYTES = 4 << 20
_FACTORS = np.random.default_rng(8675309).integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text (A-Z lower-cased), repeated ones included."""
    words = Words(Texts(column, lower=True))
    return ngram_hashes(words.hashes(), words.at, size)


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each step, the fewest equal values whose posterior still reaches ``miss``."""
    found = []
    for n in STEPS:
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return found


def _sketcher(size: int):
    @tidied("near_dedup")
    def sketch(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                h, at = shingles(batch.column("text"), size)
                n = np.zeros(batch.num_rows, np.int64)
                digests: list[bytes | None] = [None] * batch.num_rows
                full = np.flatnonzero(np.diff(at))
                for i in full:
                    own = np.unique(h[at[i] : at[i + 1]])
                    n[i], digests[i] = len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                signatures = np.zeros((batch.num_rows, HASHES), np.uint32)
                for k, factor in enumerate(_FACTORS):
                    if len(full):
                        signatures[full, k] = np.minimum.reduceat((h * factor) >> np.uint64(32), at[full])
                rows = [signatures[i].tobytes() if d else None for i, d in enumerate(digests)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n), pa.array(digests, pa.binary()), pa.array(rows, pa.binary()), pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())],
                    names=["id", "n", "digest", "signature", "weight"],
                )

    return sketch


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    key = np.zeros((len(signatures), BANDS), np.uint64) + mix64(np.arange(BANDS, dtype=np.uint64))
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        key = mix64(key ^ rows[:, :, r])
    return key


@tidied("near_dedup")
def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        key = band_keys(_matrix(batch.column("signature")))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)),
                pa.array(key.ravel().view(np.int64)),
                pa.array(np.repeat(batch.column("id").to_numpy(), BANDS)),
            ],
            names=["band", "bucket", "id"],
        )


def _sequential(left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the row pairs that pass every step, and their equal values."""
    alive, equal, begin = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for end, need in zip(STEPS, least, strict=True):
        equal = equal + (left[alive, begin:end] == right[alive, begin:end]).sum(axis=1)
        ok = equal >= need
        alive, equal, begin = alive[ok], equal[ok], end
    return alive, equal


def _fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _pruner(percent: int, miss: float):
    least = least_matches(percent / 100, miss)

    @tidied("near_dedup")
    def prune(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ok, _ = _sequential(_matrix(batch.column("sa")), _matrix(batch.column("sb")), least)
            sizes = _fits(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(ok[sizes[ok]])) for c in ("a", "b")], names=["a", "b"])

    return prune


class _Block:
    """A block of a bucket's minority (part 0) against one of its members (part 1), or a block within itself (part 2)."""

    def __init__(self, key, table: pa.Table, percent: int, least: list[int]):
        self.ids, self.labels, self.n, self.part = (table.column(c).to_numpy() for c in ("id", "label", "n", "part"))
        self.major = table.column("major")[0].as_py()
        self.signatures = _matrix(table.column("signature").combine_chunks())
        self.keys = band_keys(self.signatures)[:, : key[0].as_py()]
        self.percent, self.least = percent, least
        self.minority, self.members = np.flatnonzero((self.part == 0) | (self.part == 2) & (self.labels != self.major)), np.flatnonzero(self.part != 0)
        self.sizes, self.cell = table.column("class").to_numpy(), key[2].as_py()

    def partners(self, i: int) -> np.ndarray:
        """Members of other components that may be similar to row i, likeliest first, each pair in its first band."""
        j = self.members
        once = (self.labels[j] == self.major) | (self.ids[j] > self.ids[i])
        once &= (self.sizes[j] != self.sizes[i]) | (self.sizes[i] == self.cell)  # sets of one class meet in two cells
        j = j[(self.labels[j] != self.labels[i]) & once & _fits(self.n[j], self.n[i], self.percent)]
        ok, equal = _sequential(np.broadcast_to(self.signatures[i], (len(j), HASHES)), self.signatures[j], self.least)
        j = j[ok[np.lexsort((self.ids[j[ok]], -equal))]]
        return j[~(self.keys[j] == self.keys[i]).any(axis=1)]


def _likeliest(percent: int, miss: float):
    least = least_matches(percent / 100, miss)

    def pick(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = _Block(key, table, percent, least)
        found = [(int(block.ids[i]), int(block.ids[j])) for i in block.minority for j in block.partners(i)[:1]]
        return pa.table({"a": pa.array([max(f) for f in found], pa.int64()), "b": pa.array([min(f) for f in found], pa.int64())})

    return pick


def _open_members(percent: int, miss: float):
    least = least_matches(percent / 100, miss)

    def look(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = _Block(key, table, percent, least)
        needed = np.zeros(len(block.ids), bool)
        for i in block.minority:
            j = block.partners(i)
            needed[j] = True
            needed[i] |= len(j) > 0
        return table.filter(pa.array(needed))

    return look


class _Forest:
    """Union-find over the labels of a block."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up]
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        self.parent[x] = y
        return x != y


def _block_links(size: int, percent: int, miss: float):
    least = least_matches(percent / 100, miss)

    def link(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, forest, found = _Block(key, table, percent, least), _Forest(), []
        sets: list[np.ndarray] = []
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for piece in pieces(batch, "text"):
                h, at = shingles(piece.column("text"), size)
                sets += [np.unique(h[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
        labels = block.labels.tolist()
        for i in block.minority:
            partners = block.partners(i)
            for begin in range(0, len(partners), 64):
                mine = forest.root(labels[i])
                j = np.array([x for x in partners[begin : begin + 64] if forest.root(labels[x]) != mine], np.int64)
                if not len(j):
                    continue
                ends = np.cumsum([0, *(len(sets[x]) for x in j)])
                values = np.concatenate([sets[x] for x in j])
                place = np.minimum(np.searchsorted(sets[i], values), len(sets[i]) - 1)
                common = row_sums((sets[i][place] == values).astype(np.int64), ends)
                linked = 100 * common >= percent * (len(sets[i]) + np.diff(ends) - common)
                found += [(int(block.ids[i]), int(block.ids[x])) for x in j[linked & (common > 0)] if forest.join(labels[i], labels[x])]
        if table.nbytes > BLOCK_BYTES:
            release()
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return link


def _confirmer(size: int, percent: int):
    def sets(column: pa.Array) -> list[np.ndarray]:
        h, at = shingles(column, size)
        return [np.unique(h[at[i] : at[i + 1]]) for i in range(len(at) - 1)]

    @tidied("near_dedup")
    def confirm(batches):
        held: tuple[int | None, str | None, np.ndarray | None] = (None, None, None)  # a hub's rows follow each other
        for whole in batches:
            for batch in pieces(whole, "tb"):
                keep = []
                for i, (a, text, other) in enumerate(zip(batch.column("a").to_pylist(), batch.column("ta"), sets(batch.column("tb")), strict=True)):
                    if held[0] != a or held[1] != text.as_py():
                        held = (a, text.as_py(), sets(pa.array([text.as_py()], pa.string()))[0])
                    one = held[2]
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    if common and 100 * common >= percent * (len(one) + len(other) - common):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return confirm


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """Rows (id, n_shingles, component), one for each row of ``docs``.

    component is the least id reachable over links of 100 * intersection >=
    ``percent`` * union. A text without words (null, empty, blanks) has no
    shingles and links with nothing. Rows that share an id are one node; a null
    id has a null component. An empty table gives no rows; further columns of
    ``docs``, whatever their names, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = scratch.save(source.mapInArrow(_sketcher(shingle), "id long, n long, digest binary, signature binary, weight long"), "sketch")
    known = sketch.where("digest IS NOT NULL AND id IS NOT NULL")
    sets = scratch.save(known.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.min_by("weight", "id").alias("weight")), "sets")
    signed = sets.select("id", "n", "signature")

    band = scratch.save(signed.select("id", "signature").mapInArrow(_bands, "band int, bucket long, id long"), "bands")
    buckets = band.groupBy("band", "bucket").agg(F.count("*").alias("size"), F.min("id").alias("hub"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("content"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("content2")).where("size > 1")
    members = scratch.save(band.join(buckets, ["band", "bucket"]), "members")
    scratch.drop("bands")

    needed = members.select("id").distinct()
    texts = scratch.save(source.where("id IS NOT NULL").join(needed, "id", "left_semi"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        return rows.select("a", "b", "ta", "tb").mapInArrow(_confirmer(shingle, percent), "a long, b long")

    hubs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    both = hubs.join(signed.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb")), "b")
    both = both.join(signed.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa")), "a")
    pairs = scratch.save(both.mapInArrow(_pruner(percent, miss), "a long, b long").distinct(), "pairs-0")
    links = scratch.save(confirmed(pairs), "links-0")
    labels = connected_components(scratch, "labels-0", links)

    # Buckets with the same members are one, that of the first band.
    crowd = members.where("size > 2")
    once = crowd.groupBy("size", "content", "content2").agg(F.min(F.struct("band", "bucket")).alias("first")).select("first.*")
    crowd = crowd.select("band", "bucket", "size", "id").join(once, ["band", "bucket"], "left_semi").join(sets.select("id", "n", "signature", "weight"), "id")
    # Sets that can reach the threshold are of one class or of neighbouring ones; a little more than the exact ratio covers rounding.
    like = F.when(F.col("size") > BLOCK, F.floor(F.log("n") / math.log(100.01 / percent))).otherwise(0).cast("int")
    cells = F.when(F.col("size") > BLOCK, F.array(F.col("class"), F.col("class") + 1)).otherwise(F.array(F.col("class")))
    crowd = scratch.save(crowd.withColumn("class", like).withColumn("cell", F.explode(cells)).drop("size"), "crowded")
    scratch.drop("members")
    cell = ["band", "bucket", "cell"]
    group = [*cell, "low", "high"]
    told = [*group, "id", "label", "n", "class", "signature", "part", "major"]

    def mixed() -> DataFrame:
        """Members of the cells that hold several components; those with one are done."""
        now = crowd.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        each = now.groupBy(*cell, "label").agg(F.count("*").alias("rows"), F.sum("weight").alias("bytes"), F.max("class").alias("most"))
        several = each.groupBy(*cell).agg(F.max_by("label", F.struct("rows", "label")).alias("major"), F.max(F.struct("rows", "label", "bytes")).alias("top"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count("*").alias("labels"), F.max("most").alias("most")).where("labels > 1 AND most = cell")

        def blocks(rows, size):
            return F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")

        several = several.select(*cell, "major", blocks(F.col("rows"), F.col("bytes")).alias("highs"), blocks(F.col("rows") - F.col("top.rows"), F.col("bytes") - F.col("top.bytes")).alias("lows"))
        return now.join(several, cell)

    def within() -> DataFrame:
        """Each member in one block of its cell."""
        place = F.pmod(F.xxhash64("id", "band"), F.col("highs")).cast("int")
        return mixed().select("*", F.lit(0).alias("low"), place.alias("high"), F.lit(2).alias("part")).select(*told)

    def dealt() -> DataFrame:
        """Each member against every block of the minority, and each of the minority against every block; one block is a group by itself."""
        open_ = mixed().withColumn("side", F.pmod(F.xxhash64("id"), F.col("highs")).cast("int")).withColumn("few", F.pmod(F.xxhash64("id", F.lit(1)), F.col("lows")).cast("int"))
        deals = F.transform(F.sequence(F.lit(0), F.col("lows") - 1), lambda x: F.struct(x.alias("low"), F.col("side").alias("high"), F.lit(1).alias("part")))
        again = F.transform(F.sequence(F.lit(0), F.col("highs") - 1), lambda x: F.struct(F.col("few").alias("low"), x.alias("high"), F.lit(0).alias("part")))
        alone = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(2).alias("part")))
        return open_.withColumn("deal", F.explode(F.when(F.col("highs") == 1, alone).when(F.col("label") == F.col("major"), deals).otherwise(F.concat(deals, again)))).select("*", "deal.*").select(*told)

    likely = scratch.save(within().groupBy(*group).applyInArrow(_likeliest(percent, miss), "a long, b long").distinct(), "pairs-1")
    links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(scratch.save(confirmed(likely), "links-1"))
    labels = connected_components(scratch, "labels-1", links)
    open_ = dealt()
    needed = scratch.save(open_.groupBy(*group).applyInArrow(_open_members(percent, miss), open_.schema), "open")
    links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(scratch.save(needed.join(texts, "id").groupBy(*group).applyInArrow(_block_links(shingle, percent, miss), "a long, b long"), "links-2"))
    labels = connected_components(scratch, "labels-2", links)
    for name in ("texts", "pairs-0", "pairs-1", "links-0", "links-1", "links-2", "labels-0", "labels-1", "crowded", "open"):
        scratch.drop(name)

    label = labels.select(F.col("node").alias("first"), "label")
    reach = sets.select("digest", F.col("id").alias("first")).join(label, "first", "left").select("digest", F.coalesce("label", "first").alias("label"))
    if not _shares_ids(known):
        return sketch.join(reach, "digest", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component"))
    # Rows that share an id join the components of all their sets.
    tie = known.join(reach, "digest").select(F.col("id").alias("a"), F.col("label").alias("b"))
    final = connected_components(scratch, "cc-ids", tie).select(F.col("node").alias("id"), "label")
    return sketch.join(final, "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component"))


def _shares_ids(known: DataFrame) -> bool:
    """Whether some id stands on rows with different sets."""
    return not known.groupBy("id").agg((F.min("digest") != F.max("digest")).alias("mixed")).where("mixed").isEmpty()
