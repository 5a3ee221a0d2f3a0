"""Near-duplicate detection with HyperMinHash registers.

A document is its set of word shingles.  Sets that are equal form a class, and only a class's
smallest document goes on.  Its shingles fall into buckets by hash; each bucket keeps of its
smallest hash the number of leading zeros and a few mantissa bits, which is a HyperMinHash
register.  128 registers are made of it at every size: a set of 256 shingles or more fills 128
buckets once; smaller sets fill fewer buckets under several permutations, so that a register
seldom is empty (a set just below a limit also takes the tier above, for partners beyond it).
Four registers in a row make a band.  Documents that share a band are candidates: at a
similarity of 0.8, 32 bands miss with a probability near 5e-8.  Sets of up to 11 shingles are
found exactly: their partners differ in two shingles at most on either side, so the hashes of
the set with up to a fifth of its shingles left out take the place of bands.

Within a band no pairs are enumerated.  In rounds, one document of each band's open group, the
hub, is compared with the others that are not yet in its component; the hub is the document
that shares the most bands with the most others (in a group of copies, the original), ties to
the smallest id.  The collision-corrected estimate of 64 further registers (chance agreements removed)
drops the hopeless pairs, and the exact similarity on full sets decides.  Documents joined to
one component need no further comparison, so a large group of near copies ends after a round
or two.  Once the groups left are so small that their pairs are few for their rows - or after
``rounds`` - every pair of different components in a group is compared, so no link is lost to
the short cut.  Documents of groups beyond a tile are first dealt anew, by their rarest shingles:
sets of n shingles that are similar enough share one of the first n - ceil(0.8 n) + 1 in any
common order, and in an order by frequency documents that only hold the same passages share none.

Defined cases: null or blank texts have an empty set and link with nothing; texts with fewer
words than a shingle are one shingle, the whole sequence.  Rows that repeat a doc_id are one
document in the result, with the size of the largest of its sets, but each of its sets is compared, and
what links with any of them is linked with the document.  Rows with a null doc_id are left out of
the result, and ``dedup`` keeps them.  Shingles are compared by 64-bit hash, sets by 128-bit hash;
ids are below 2^62, where the numbers of further sets of a document begin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import arrow_batches, result, written
from weftline.llm._text import Spans, U, Words, mix, mix_int, slices
from weftline.llm.components import components

REGISTERS, ROWS = 128, 4
MANTISSA = 8
EXACT = 11
#: Pairs are listed in full once the open groups hold so few for each of their rows.
PAIRS_A_ROW = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """For each text the sorted distinct hashes of its shingles."""
    words = Words(data, offsets, lower=True)
    spans, first = Spans(words.hashes()), words.first
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if a == b:
            yield np.zeros(0, U)
        else:
            n = min(size, b - a)
            start = np.arange(a, b - n + 1)
            yield np.unique(spans.hash(start, start + n))


_SALTS = np.array([mix_int(0x5EED + i) for i in range(REGISTERS)], U)


def _register(smallest: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of hashes of 48 bits."""
    with np.errstate(divide="ignore"):
        top = np.floor(np.log2(np.maximum(smallest, U(1)).astype(np.float64))).astype(np.int64)
    mantissa = np.where(top >= MANTISSA, smallest >> np.maximum(top - MANTISSA, 0).astype(U), smallest << np.maximum(MANTISSA - top, 0).astype(U)) & U(2**MANTISSA - 1)
    return ((47 - top) * 2**MANTISSA).astype(np.uint16) + mantissa.astype(np.uint16) + np.uint16(1)


def registers(shingles: np.ndarray, tier: int, repeats: int | None = None) -> np.ndarray:
    """Registers of ``uint16``, 0 where a bucket is empty.  tier: the number of buckets of a permutation."""
    repeats = repeats or REGISTERS // tier
    h = mix(shingles[None, :] ^ _SALTS[:repeats, None])
    bucket = (h >> U(48)).astype(np.int64) % tier + np.arange(repeats)[:, None] * tier
    out = np.full(repeats * tier, 2**48, U)
    np.minimum.at(out, bucket.ravel(), (h & U(2**48 - 1)).ravel())
    full = out < U(2**48)
    reg = np.zeros(len(out), np.uint16)
    reg[full] = _register(out[full])
    return reg


def tiers(n: int) -> list[int]:
    """Numbers of buckets for a set of n: its own tier, and the one above for sets near the limit."""
    own = 128
    while own > 4 and n < 2 * own:
        own //= 2
    return [own, own * 2] if own < 128 and n >= 0.8 * 4 * own else [own]


def band_keys(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """64-bit keys; documents that link share one."""
    n = len(shingles)
    keys = []
    if 0 < n <= EXACT / similarity:
        total, spare = shingles.sum(dtype=U), int((1 - similarity) * n + 1e-9)
        keys = [np.array([total], U)]
        if spare >= 1:
            keys.append(total - shingles)
        if spare >= 2:
            i, j = np.triu_indices(n, 1)
            keys.append(total - shingles[i] - shingles[j])
        keys = [mix(np.concatenate(keys) ^ U(0xE7AC7))]
    if n > EXACT:
        for tier in tiers(n):
            reg = registers(shingles, tier).reshape(-1, ROWS).astype(U)
            held = reg[:, 0] | reg[:, 1] << U(16) | reg[:, 2] << U(32) | reg[:, 3] << U(48)
            band = np.arange(len(reg), dtype=U) + U(tier * 1000)
            keys.append(mix(mix(held) ^ (band * U(0x9E3779B97F4A7C15)))[held != 0])
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, U)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


#: Registers of the sketch that stands before verification, and the words that hold it.
SKETCH = 64
#: Members of a group that are compared at a time when its pairs are listed in full.
TILE = 512
WORDS = [f"w{i}" for i in range(SKETCH // 16)]
PASS = "doc_id long, n long, s1 long, s2 long, keys array<long>"


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _long(np.concatenate([np.zeros(0, U), *parts])))


def _signature(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return s.sum(dtype=U), mix(s ^ U(0xA5)).sum(dtype=U)


def _bands(size: int, similarity: float):
    def run(batches):
        for batch, data, offsets in slices(batches):
            n, keys, sums = [], [], np.zeros((2, batch.num_rows), U)
            for i, s in enumerate(shingle_sets(data, offsets, size)):
                n.append(len(s))
                sums[:, i] = _signature(s)
                keys.append(band_keys(s, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _long(sums[0]), _long(sums[1]), _lists(keys)], ["doc_id", "n", "s1", "s2", "keys"])

    return run


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH one-bucket registers of as many permutations, the low four mantissa bits of each, in 64-bit words."""
    low = np.array([(mix(shingles ^ salt) & U(2**48 - 1)).min() for salt in _SALTS[:SKETCH]], U)
    nibbles = (_register(low) & np.uint16(15)).astype(U).reshape(-1, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=U) * U(4)), axis=1)


def _sets(size: int):
    def run(batches):
        for batch, data, offsets in slices(batches):
            want, sets, words, ok = batch.column(2).to_numpy().view(U), [], [], []
            for i, s in enumerate(shingle_sets(data, offsets, size)):
                ok.append(len(s) > 0 and _signature(s)[0] == want[i])
                sets.append(s)
                words.append(sketch(s) if ok[-1] else np.zeros(SKETCH // 16, U))
            columns = [_long(np.ascontiguousarray(c)) for c in np.array(words).reshape(-1, SKETCH // 16).T]
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *columns, _lists(sets)], ["id", "size", *WORDS, "set"])
            yield rows.filter(pa.array(ok, pa.bool_()))

    return run


def _hopeful(percent: int):
    """Do sizes and sketches of two rows (columns x_ and y_) allow the similarity?

    The share of equal nibbles is corrected for the sixteenth that chance makes equal, and the
    bound lies six standard errors below the similarity.
    """
    p = percent / 100 + (1 - percent / 100) / 16
    least = int(SKETCH * (p - 6 * (p * (1 - p) / SKETCH) ** 0.5))
    differ = F.lit(0)
    for w in WORDS:
        x = F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}"))
        half = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(half.bitwiseOR(F.shiftrightunsigned(half, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    sizes = F.col("x_size"), F.col("y_size")
    return (100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & (SKETCH - differ >= least)


def _as(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c != "key"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    met = pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return met.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _tile(percent: int):
    p = percent / 100 + (1 - percent / 100) / 16
    least = int(SKETCH * (p - 6 * (p * (1 - p) / SKETCH) ** 0.5))
    ones = U(0x1111111111111111)

    def run(rows: pa.Table) -> pa.Table:
        rep, comp, size, tile = (rows.column(c).to_numpy() for c in ("rep", "comp", "size", "tile"))
        words = np.array([rows.column(w).to_numpy() for w in WORDS]).view(U)
        sets = rows.column("set").combine_chunks()
        flat, ends = sets.flatten().to_numpy().view(U), np.concatenate([[0], np.cumsum(size)])
        ti, tj = rows.column("ti")[0].as_py(), rows.column("tj")[0].as_py()
        ys, a, b = np.flatnonzero(tile == tj), [], []
        for x in np.flatnonzero(tile == ti):
            fit = ys[(comp[ys] != comp[x]) & ((rep[ys] > rep[x]) | (ti != tj)) & (100 * np.minimum(size[ys], size[x]) >= percent * np.maximum(size[ys], size[x]))]
            differ = words[:, fit] ^ words[:, x][:, None]
            differ |= differ >> U(1)
            differ |= differ >> U(2)
            fit = fit[SKETCH - np.bitwise_count(differ & ones).sum(0, dtype=np.int64) >= least]
            own = flat[ends[x] : ends[x + 1]]
            for at in range(0, len(fit), 64):
                part = fit[at : at + 64]
                n = size[part]
                other = flat[np.repeat(ends[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                same = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                both = np.bincount(np.repeat(np.arange(len(part)), n), same, len(part)).astype(np.int64)
                good = part[100 * both >= percent * (n + size[x] - both)]
                a.append(np.full(len(good), rep[x]))
                b.append(rep[good])
        a, b = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _in_tiles(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components within the groups, all pairs considered.

    A group is dealt into tiles of about TILE members; each pair of tiles is compared by itself,
    so no task holds more than two tiles, and only links come out.
    """
    tiles = written(open_.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
    rows = open_.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("rep", "key"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.join(sets.select(F.col("id").alias("rep"), "set"), "rep").select("key", "rep", "comp", "size", *WORDS, "set", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"))
    return rows.groupBy("key", "ti", "tj").applyInArrow(_tile(percent), "a long, b long").distinct()


#: Shingles are put in order by the frequency of their hash bucket, so that the table of frequencies is bounded.
RARITY = 1 << 20


def _rarity_bucket(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles ^ U(0x4A4E)) & U(RARITY - 1)).astype(np.int64)


def _frequencies(batches):
    total = np.zeros(RARITY, np.int64)
    for batch in batches:
        total += np.bincount(_rarity_bucket(batch.column(0).flatten().to_numpy().view(U)), minlength=RARITY)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])


def _rarest(held, percent: int):
    def run(batches):
        often = held.value
        for batch in batches:
            of, keys = [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for i, own in enumerate(batch.column(1)):
                s = own.values.to_numpy().view(U)
                n = often[_rarity_bucket(s)]
                first = np.lexsort((s, n))[: len(s) + percent * -len(s) // 100 + 1]
                first = first[n[first] > 1]  # what one document alone holds leads to none
                of.append(np.full(len(first), i))
                keys.append(s[first])
            rows = batch.drop_columns(["set"]).take(pa.array(np.concatenate(of)))
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(keys)), *rows.columns], ["key", *rows.schema.names])

    return run


def _by_rarest(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The documents of the open groups, grouped by each of their rarest shingles; groups of one component are left out."""
    spark = open_.sparkSession
    docs = open_.select("rep", "comp", "size", *WORDS).distinct()
    docs = written(docs.join(sets.select(F.col("id").alias("rep"), "set"), "rep").select("rep", "set", "comp", "size", *WORDS))
    counts = docs.select("set").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most RARITY rows
    often = np.zeros(RARITY, np.int64)
    often[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    held = spark.sparkContext.broadcast(np.minimum(often, 2**32 - 1).astype(np.uint32))
    rows = written(docs.mapInArrow(_rarest(held, percent), f"key long, rep long, comp long, size long, {', '.join(w + ' long' for w in WORDS)}"))
    several = written(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
    return rows.join(several, "key")


def near_duplicates(documents: DataFrame, size: int = 2, percent: int = 80, rounds: int = 2, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): a row for each non-null doc_id.

    class_id is the smallest doc_id with an equal set, component_id the smallest reachable.
    """
    return result(lambda: _near_duplicates(documents, size, percent, rounds, broadcast_ids), documents.sparkSession)


def _near_duplicates(documents: DataFrame, size: int, percent: int, rounds: int, broadcast_ids: int) -> DataFrame:
    assert percent >= 80, "the exact keys of small sets hold from a similarity of 0.8"
    spark = documents.sparkSession
    arrow_batches(spark)
    docs = documents.where(F.col("doc_id").isNotNull()).selectExpr("cast(doc_id as long) doc_id", "text")
    one = docs.mapInArrow(_bands(size, percent / 100), PASS).groupBy("doc_id").agg(F.max(F.struct("n", "s1", "s2", "keys")).alias("x"), F.min(F.struct("n", "s1", "s2")).alias("other"))
    one = written(one.select("doc_id", "x.*", (F.col("other") != F.struct("x.n", "x.s1", "x.s2")).alias("several")))
    full, edges = one.where("n > 0").select("doc_id", F.col("doc_id").alias("node"), "n", "s1", "s2", "keys"), None
    several = one.where("several").select("doc_id", F.struct("n", "s1", "s2").alias("held"))
    if not several.isEmpty():  # the other sets of documents whose rows differ, as nodes that are linked with theirs
        rows = docs.join(several.select("doc_id"), "doc_id", "left_semi").mapInArrow(_bands(size, percent / 100), PASS).where("n > 0").dropDuplicates(["doc_id", "n", "s1", "s2"])
        rows = rows.join(several, "doc_id").where(F.struct("n", "s1", "s2") != F.col("held"))
        number = F.xxhash64("doc_id", "n", "s1", "s2").bitwiseAND(F.lit(2**61 - 1)) + F.lit(2**62)
        more = written(rows.select("doc_id", number.alias("node"), "n", "s1", "s2", "keys"))
        full, edges = full.unionByName(more), more.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    classes = written(full.groupBy("n", "s1", "s2").agg(F.min(F.struct("node", "doc_id")).alias("x"), F.first("keys").alias("keys")).select("n", "s1", "s2", F.col("x.node").alias("rep"), F.col("x.doc_id").alias("of"), "keys"))
    if edges is not None:  # a set is the node of its class
        held = classes.select("n", "s1", "s2", "rep")
        edges = written(more.join(held, ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).unionByName(one.join(several.select("doc_id"), "doc_id", "left_semi").join(held, ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))).where("a <> b"))
    banded = classes.select("rep", F.explode("keys").alias("key"))
    shared = written(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    groups = written(banded.join(shared, "key"))
    ids = groups.select(F.col("rep")).distinct().join(classes.select("rep", "of", "s1"), "rep")
    ids = written(ids)
    few = ids.count() <= broadcast_ids
    mine = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("of")).select(F.col("rep").alias("doc_id"), "text", "s1")
    sets = written(mine.mapInArrow(_sets(size), f"id long, size long, {', '.join(w + ' long' for w in WORDS)}, set array<long>").dropDuplicates(["id"]))
    hubs = groups.groupBy("rep").agg(F.sum("c").alias("deg"))
    held = ["rep", "deg", "size", *WORDS]
    groups = written(groups.join(hubs.join(sets.drop("set").withColumnRenamed("id", "rep"), "rep"), "rep").select("key", *held))
    labels = None
    for turn in range(rounds + 1):
        if labels is None:
            open_ = groups.withColumn("comp", F.col("rep"))
        else:
            named = groups.join(labels, F.col("rep") == F.col("node"), "left").select("key", *held, F.coalesce("comp", "rep").alias("comp"))
            still = written(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
            open_ = written(named.join(still, "key"))
        rows, all_pairs = open_.groupBy("key").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2), F.lit(0.0))).first()
        if not rows and labels is not None:
            break
        last = turn == rounds or all_pairs <= PAIRS_A_ROW * rows
        best = open_.groupBy("key").agg(F.max(F.struct("deg", (-F.col("rep")).alias("neg"))).alias("p")).select("key", (-F.col("p.neg")).alias("rep"))
        if last:
            large = written(open_.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > TILE).select("key"))
            small = _in_tiles(open_.join(large, "key", "left_anti"), sets, percent)
            found = written(small.unionByName(_in_tiles(_by_rarest(open_.join(large, "key"), sets, percent), sets, percent)))
        else:
            fit = F.col("x_comp") != F.col("y_comp")
            met = _as(open_.join(best, ["key", "rep"]), "x").join(_as(open_, "y"), "key")
            pairs = met.where(fit & _hopeful(percent)).select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"))
            found = written(_links(pairs.distinct(), sets, percent))
        edges = found if edges is None else edges.unionByName(found)
        if labels is None or not found.isEmpty():
            labels = components(edges, "a", "b")
        if last:
            break
        groups = written(open_.join(best, ["key", "rep"], "left_anti").select("key", *held))
    members = one.join(classes.select("n", "s1", "s2", F.when(F.col("rep") < 2**62, F.col("rep")).alias("rep")), ["n", "s1", "s2"], "left")
    out = members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id")).join(labels, F.col("class_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", "class_id", F.coalesce("comp", "class_id").alias("component_id"))


def dedup(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which one of each component, the smallest doc_id, stays; null ids stay."""
    out = near_duplicates(documents, size, percent)
    gone = out.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__weft_gone"))
    return documents.join(gone, F.col("doc_id") == F.col("__weft_gone"), "left_anti")


def report(documents: DataFrame) -> DataFrame:
    out = near_duplicates(documents, 2, 80)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
