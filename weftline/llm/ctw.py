"""Language-model scoring with context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, most significant bit first.  Every decision (the bits of the
byte so far) has a context tree over the preceding bytes, up to ``DEPTH`` of them; each node
counts its zeros and ones and estimates them after Krichevsky and Trofimov.  A node's weighted
probability is half its own estimate's and half its children's product, which gives every node
a posterior weight; the prediction mixes the estimates of all depths along the path by these
weights.  A text is its bytes and one end symbol (0xFF), its context begins with zero bytes,
and the score is the base-10 logarithm of its probability.

Counting is distributed: tasks send sums of (DEPTH + 1)-byte grams, which give the counts of
all nodes.  Every context that occurs is a node of the model, whatever the size of the input.
(``min_count`` above 1 leaves rarer contexts out; their occurrences still count in the
shallower nodes, and for their own depth as one pooled child.)

The tree is never in one place.  Grams are dealt by the ``SPLIT`` bytes next to the symbol, so
that all deeper contexts of a path meet in one group; groups give the sums that their parents
need, at most 255 nodes a context of the top, and the driver sends the top back.  Predictions
of grams of at least ``HOT_GRAMS`` of all occurrences (so at most 1 / HOT_GRAMS of them) are
broadcast; the other grams of the documents are sent to their group, behind the counts of that
group in the same sorted stream, and come back as a sum for each document.  Both ways give the
same value.

Beside it stands the base score, of single words with 1/2 added to each count.  Words of at
least ``HOT_SHARE`` of all tokens (so at most 1 / HOT_SHARE words) are broadcast; all others
are joined by hash, where no word has more than that share of the rows.

Defined cases: null text is empty and scores its end symbol alone; rows with a null doc_id are
scored, not learned from and not held out; without training rows every bit has probability
1/2 and the base has N = V = 0.  Repeated rows are learned from and scored each.  Words are
counted by 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import arrow_batches, remainder, written
from weftline.llm._text import Counts, SortedHashes, U, Words, mix, mix_int, slices

DEPTH = 5
#: A context enters the tree from so many occurrences on: all do.
MIN_COUNT = 1
SPLIT = 2
HOT_GRAMS = 2.0**-21
#: Kinds of grams and occurrences of a group, on average.
GROUP, GROUP_BYTES = 100_000, 8_000_000
ROWS = 50_000
HOT_SHARE = 2.0**-17
END = mix_int(0xE0F)
WORD, GRAM = 0, 1


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def gram_codes(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and each end symbol the code of it and the ``depth`` bytes before; where each text begins."""
    count = len(offsets) - 1
    first = offsets + np.arange(count + 1)
    held = np.empty(len(data) + count, np.uint8)
    end = np.zeros(len(held), bool)
    end[first[1:] - 1] = True
    held[~end], held[end] = data, 0xFF
    place = np.arange(len(held)) - np.repeat(first[:-1], np.diff(first))
    code = held.astype(U)
    for back in range(1, depth + 1):
        before = np.zeros(len(held), U)
        before[back:] = held[: len(held) - back]
        before[place < back] = 0
        code |= before << U(8 * back)
    return code, first


def _gather(depth: int):
    def run(batches):
        sums = {WORD: Counts(), GRAM: Counts()}

        def give(kind):
            keys, n = sums[kind].take()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        for batch, data, offsets in slices(batches):
            sums[WORD].add(Words(data, offsets, lower=True).hashes())
            sums[WORD].add(np.array([END], U), np.array([batch.num_rows]))
            sums[GRAM].add(gram_codes(data, offsets, depth)[0])
            for kind in sums:
                if sums[kind].full():
                    yield give(kind)
        for kind in sums:
            yield give(kind)

    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _odds(one: np.ndarray) -> np.ndarray:
    """The logarithm of the odds of a one: unlike a probability it keeps what little is left for the other bit in single precision."""
    one = np.clip(one, 2.0**-50, 1 - 2.0**-50)
    return np.log(one) - np.log1p(-one)


def _parents(keys: np.ndarray, depth: int) -> np.ndarray:
    """The keys of the nodes one context byte above nodes of this depth."""
    return (((keys >> U(8)) & U((1 << (8 * (depth - 1))) - 1)) << U(8)) | (keys & U(0xFF))


def _levels(codes: np.ndarray, n: np.ndarray, first: int, depth: int, min_count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The grams of the depths from ``first`` on whose contexts are nodes, from counted grams of the last."""
    out = []
    for d in range(depth, first - 1, -1):
        codes, at = np.unique(codes & U((1 << (8 * (d + 1))) - 1), return_inverse=True)
        n = np.bincount(at, n, len(codes)).astype(np.int64)
        contexts, at = np.unique(codes >> U(8), return_inverse=True)
        enough = np.bincount(at, n, len(contexts))[at] >= min_count
        out.append((codes[enough], n[enough]))
    return out[::-1]


class Tree:
    """The mixed prediction of every node, for look-up.

    levels: (codes of d + 1 bytes, counts) for each depth, from the root on or from below ``top``.
    under: what the nodes of the last level have below them, where that is elsewhere: (node, weighted, zeros, ones), sorted.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], top: Tree | None = None, under: tuple | None = None):
        first = top.depth + 1 if top else 0
        self.depth = first + len(levels) - 1
        nodes = [self._nodes(*level) for level in levels]
        above = [None] + [np.searchsorted(nodes[d - 1][0], _parents(nodes[d][0], first + d)) for d in range(1, len(nodes))]
        kt = [_log_kt(z, o) for _, z, o in nodes]
        weight = [np.ones(len(k)) for k in kt]  # of a node's own estimate against its children's
        weighted = kt[-1]
        for d in range(len(nodes) - 1, -1, -1):
            keys, zeros, ones = nodes[d]
            n = len(keys)
            if d + 1 < len(nodes):
                at, sums = above[d + 1], (weighted, *nodes[d + 1][1:])
            elif under is not None:
                at, sums = np.searchsorted(keys, under[0]), under[1:]
            else:
                continue
            below, below0, below1 = (np.bincount(at, x, n).astype(np.float64) for x in sums)
            below += _log_kt(np.maximum(zeros - below0, 0), np.maximum(ones - below1, 0))
            inner = np.bincount(at, minlength=n) > 0
            weight[d] = np.where(inner, 1 / (1 + np.exp(np.clip(below - kt[d], -700, 700))), 1.0)
            weighted = np.where(inner, np.logaddexp(kt[d], below) - np.log(2), kt[d])
        self.roots = (*nodes[0], weighted)
        if top:
            own = np.searchsorted(top.last[0], _parents(nodes[0][0], first))
            mixed, rest = (x[own] for x in top.last[1:])
        else:
            mixed, rest = np.zeros(len(kt[0])), np.ones(len(kt[0]))
        self.nodes = list(top.nodes) if top else []
        for d, (keys, zeros, ones) in enumerate(nodes):
            if d:
                mixed, rest = (x[above[d]] for x in (mixed, rest))
            before = (ones + 0.5) / (zeros + ones + 1)
            self.nodes.append(self._sorted(keys, _odds(mixed + rest * before)))
            mixed, rest = mixed + rest * weight[d] * before, rest * (1 - weight[d])
        self.last = (nodes[-1][0], mixed, rest)

    @staticmethod
    def _nodes(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, zeros, ones) of the binary decisions; key: context bytes, then the bits so far behind a one."""
        parts = []
        for b in range(8):
            symbol = codes & U(0xFF)
            keys, at = np.unique((codes >> U(8) << U(8)) | U(1 << b) | (symbol >> U(8 - b)), return_inverse=True)
            one = ((symbol >> U(7 - b)) & U(1)).astype(bool)
            parts.append((keys, np.bincount(at[~one], counts[~one], len(keys)), np.bincount(at[one], counts[one], len(keys))))
        keys, zeros, ones = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        return keys[order], zeros[order], ones[order]

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[SortedHashes, np.ndarray]:
        hashed = mix(keys)
        order = np.argsort(hashed)
        return SortedHashes(hashed[order]), values[order].astype(np.float32)

    def slow(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's last byte: every bit from the deepest node that its path has."""
        total = np.zeros(len(codes))
        for b in range(8):
            symbol = codes & U(0xFF)
            bit = ((symbol >> U(7 - b)) & U(1)).astype(bool)
            prefix = U(1 << b) | (symbol >> U(8 - b))
            odds = np.zeros(len(codes))
            left = np.arange(len(codes))
            for d in range(self.depth, -1, -1):
                index, values = self.nodes[d]
                context = (codes[left] >> U(8)) & U((1 << (8 * d)) - 1)
                at = index.find(mix(context << U(8) | prefix[left]))
                hit = at >= 0
                odds[left[hit]] = values[at[hit]]
                left = left[~hit]
            total -= np.logaddexp(0, np.where(bit, -odds, odds))
        return total / np.log(10)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        kinds, back = np.unique(codes, return_inverse=True)
        return self.slow(kinds)[back]


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[c].to_numpy().astype(np.int64) for c in names]


class Forest:
    """The model over a table of gram counts (key, n), in groups below one small top."""

    def __init__(self, counts: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT):
        self.depth, self.min_count, self.split = depth, min_count, min(SPLIT, depth)
        self.total, self.kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.counts = counts.select("key", "n")
        self.groups = max(64, self.kinds // GROUP, self.total // GROUP_BYTES)
        self.held = counts.sparkSession.sparkContext.broadcast(self._top() if self.split else None)

    def _dealt(self, rows: DataFrame, code: str = "key") -> DataFrame:
        context = F.shiftright(code, 8).bitwiseAND(F.lit((1 << (8 * self.split)) - 1))
        return rows.withColumn("b", F.pmod(F.xxhash64(context), F.lit(self.groups)))

    def _own_levels(self):
        first, depth, min_count = self.split, self.depth, self.min_count

        def run(rows: pa.Table):
            codes, n = _columns(rows, "key", "n")
            return _levels(codes.view(U), n, first, depth, min_count)

        return run

    def _top(self) -> Tree:
        first, levels = self.split, self._own_levels()

        def roots(rows: pa.Table) -> pa.Table:
            keys, zeros, ones, weighted = Tree(levels(rows), Above(first)).roots
            parents, at = np.unique(_parents(keys, first), return_inverse=True)
            return pa.table({"node": parents.view(np.int64)} | {k: np.bincount(at, x, len(parents)).astype(np.float64) for k, x in (("weighted", weighted), ("zeros", zeros), ("ones", ones))})

        sums = self._dealt(self.counts).groupBy("b").applyInArrow(roots, "node long, weighted double, zeros double, ones double")
        got = sums.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("weighted", "zeros", "ones")]).toArrow()  # at most 255 x 256**(SPLIT - 1) rows
        near = self.counts.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * first)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 256**SPLIT rows
        codes, n = _columns(near, "key", "n")
        node = got["node"].to_numpy().astype(np.int64).view(U)
        order = np.argsort(node)
        return Tree(_levels(codes.view(U), n, 0, first - 1, self.min_count), under=(node[order], *(got[c].to_numpy()[order] for c in ("weighted", "zeros", "ones"))))

    def hot(self, share: float) -> tuple[SortedHashes, np.ndarray]:
        """The grams of at least this share of all occurrences, and log10 of their predictions."""
        least, levels, held = max(1.0, self.total * share), self._own_levels(), self.held

        def run(rows: pa.Table) -> pa.Table:
            codes, n = _columns(rows, "key", "n")
            codes = codes[n >= least].view(U)
            return pa.table({"code": codes.view(np.int64), "worth": Tree(levels(rows), held.value).slow(codes) if len(codes) else np.zeros(0)})

        got = self._dealt(self.counts).groupBy("b").applyInArrow(run, "code long, worth double").toArrow()  # at most 1 / share rows
        return Tree._sorted(_columns(got, "code")[0].view(U), got["worth"].to_numpy())

    def sums(self, rows: DataFrame) -> DataFrame:
        """(uid, rest): the sum of n times log10 of the prediction, over rows of (uid, code, n) with uid from 0."""
        first, depth, min_count, held = self.split, self.depth, self.min_count, self.held

        def run(batches):
            group, parts, tree = None, [], None
            for batch in batches:
                b, uid, codes, n = (batch.column(i).to_numpy() for i in range(4))
                codes = codes.view(U)
                ends = [0, *(np.flatnonzero(np.diff(b)) + 1), len(b)]
                for i, j in zip(ends[:-1], ends[1:], strict=True):
                    if i == j:
                        continue
                    if b[i] != group:
                        group, parts, tree = b[i], [], None
                    to = i + int(np.searchsorted(uid[i:j], 0))  # the counts come first
                    parts += [(codes[i:to], n[i:to])] if to > i else []
                    if to == j:
                        continue
                    if tree is None:
                        own, count = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, t) for k, t in ((0, U), (1, np.int64)))
                        tree, parts = Tree(_levels(own, count, first, depth, min_count), held.value), []
                        index, values = Tree._sorted(own, tree.slow(own))
                    far = codes[to:j]
                    at = index.find(mix(far))
                    worth = values[at].astype(np.float64) if len(values) else np.zeros(len(far))
                    miss = at < 0
                    if miss.any():
                        worth[miss] = tree.log10(far[miss]).astype(np.float32)
                    docs, back = np.unique(uid[to:j], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(np.bincount(back, worth * n[to:j], len(docs)))], ["uid", "rest"])

        counted = self._dealt(self.counts.select(F.lit(-1).cast("long").alias("uid"), F.col("key").alias("code"), "n"), "code")
        both = counted.unionByName(self._dealt(rows.select("uid", "code", F.col("n").cast("long").alias("n")), "code"))
        stream = both.select("b", "uid", "code", "n").repartition(self.groups, "b").sortWithinPartitions("b", "uid")
        return stream.mapInArrow(run, "uid long, rest double").groupBy("uid").agg(F.sum("rest").alias("rest"))


class Above:
    """Stands for a top that is not known yet."""

    def __init__(self, first: int):
        self.depth, self.nodes = first - 1, []
        self.last = (np.zeros(0, U), np.zeros(1), np.ones(1))


HEADER = "doc_id long, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<long>, times array<int>, far array<long>, met array<int>"


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *parts])))


def _score(held):
    def run(batches):
        (grams, values), depth, hot, counts, has_end = held.value
        worth = np.log10(counts + 0.5)
        for batch, data, offsets in slices(batches):
            codes, begin = gram_codes(data, offsets, depth)
            near = grams.find(mix(codes))
            cold = near < 0
            sums = np.concatenate([[0.0], np.cumsum(np.where(cold, 0.0, values[near] if len(values) else 0.0), dtype=np.float64)])
            words = Words(data, offsets, lower=True)
            hashes, first = words.hashes(), words.first
            at = hot.find(hashes)
            known = at >= 0
            seen = np.concatenate([[0], np.cumsum(known)])
            value = np.concatenate([[0.0], np.cumsum(np.where(known, worth[at], 0.0) if len(worth) else np.zeros(len(at)))])
            rare, times, far, met = [], [], [], []
            for i in range(batch.num_rows):
                a, b = first[i], first[i + 1]
                keys, n = np.unique(hashes[a:b][~known[a:b]], return_counts=True)
                rare.append(keys.view(np.int64))
                times.append(n.astype(np.int32))
                keys, n = np.unique(codes[begin[i] : begin[i + 1]][cold[begin[i] : begin[i + 1]]], return_counts=True)
                far.append(keys.view(np.int64))
                met.append(n.astype(np.int32))
            columns = [np.diff(first) + 1, np.diff(seen[first]) + has_end, np.diff(value[first]), sums[begin[1:]] - sums[begin[:-1]], np.diff(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), _lists(rare, np.int64), _lists(times, np.int32), _lists(far, np.int64), _lists(met, np.int32)], ["doc_id", "n_tokens", "n_known", "base", "score", "n_bytes", "rare", "times", "far", "met"])

    return run


def score(documents: DataFrame, training: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``documents``."""
    spark = documents.sparkSession
    arrow_batches(spark)
    counts = written(training.select("text").mapInArrow(_gather(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("h"), F.col("n").alias("c"))
    n_all, n_kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    forest = Forest(counts.where(F.col("kind") == GRAM), depth, min_count)
    is_hot = F.col("c") >= max(1.0, n_all * HOT_SHARE)
    hot = words.where(is_hot).toPandas()  # at most 1 / HOT_SHARE words
    keys, c = hot["h"].to_numpy().astype(np.int64).view(U), hot["c"].to_numpy().astype(np.int64)
    ends = int(words.where(F.col("h") == _signed(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    order = np.argsort(keys)
    held = spark.sparkContext.broadcast((forest.hot(HOT_GRAMS), depth, SortedHashes(keys[order]), c[order], int(ends > 0)))
    rows = documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_score(held), HEADER)
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()))
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("h"), F.col("x.times").alias("t"))
    met = rare.join(words.where(~is_hot), "h", "left")
    more = met.groupBy("uid").agg(F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("t")).otherwise(0)).alias("met"))
    far = rows.select("uid", F.explode(F.arrays_zip("far", "met")).alias("x")).select("uid", F.col("x.far").alias("code"), F.col("x.met").alias("n"))
    arrow_batches(spark, ROWS)
    rest = written(forest.sums(far))
    arrow_batches(spark)
    per = float(np.log10(n_all + 0.5 * (n_kinds + 1)))
    out = rows.drop("rare", "times", "far", "met").join(more, "uid", "left").join(rest, "uid", "left").withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    base = F.col("base") + float(np.log10(ends + 0.5)) + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * per
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def report(documents: DataFrame) -> DataFrame:
    left = remainder(F.col("doc_id"), 5)
    out = score(documents, documents.where(left != 1))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
