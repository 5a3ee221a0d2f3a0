"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of order 4 over lower-case letters, with one boundary symbol for
every run of other characters.  The models of all languages share sorted arrays of n-gram
hashes, one for each order, with the languages that have each and their log probabilities - nothing is
kept for a language that has not seen it - and a language backs off to its next shorter n-gram through
its context weights.  A text gets the language with the lowest cross-entropy per symbol.

Models are fitted on a bounded sample: about ``max_docs`` whole labelled documents of each
language, chosen by a hash of doc_id; a fifth of them is set aside to calibrate rejection: a
text is rejected if its cross-entropy exceeds the language's mean by more than ``z`` standard
errors, which combine the spread between documents and the spread between symbols at the
text's length, and by ``margin`` nats at least.  Languages of fewer than ``SMALL`` labelled rows are
calibrated by cross-fit instead: each document is measured by a model of the language without
that document's part of ``FOLDS``.  A language that has no other document to be measured by
takes the pooled values of the others (or, alone, those of its own documents), so every
language has a bound.  Everything else covers whole texts of all documents.

Defined cases: null text or text without letters is ``und`` with score 0, and rejected; with no
labelled rows everything is.  Rows with a null doc_id or null lang are scored but not learned
from.  Letters outside the basic plane count as one symbol.  Ties go to the language that sorts
first.  Repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._spark import arrow_batches, remainder
from weftline.llm._text import Counts, SortedHashes, U, mix, slices

ORDER = 4
SMALL, FOLDS = 50, 10
_tables: list = []


def _letters() -> np.ndarray:
    """For each code point its symbol: the lower-case letter, or 0."""
    if not _tables:
        table = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = min(ord(low[0]) if len(low) == 1 else c, 0xFFFF)
        _tables.append(table)
    return _tables[0]


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts laid end to end, and where each text begins."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=count[1:])
    first = count[offsets]
    sym = _letters()[points]
    solid = sym != 0
    keep = solid.copy()
    if len(sym):
        keep[1:] |= solid[:-1]
        inner = first[(first > 0) & (first < len(sym))]
        keep[inner] = solid[inner]
    kept = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return sym[keep], kept[first]


def grams(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each symbol, as four 16-bit fields; boundaries stand before a text."""
    place = np.arange(len(sym)) - np.repeat(first[:-1], np.diff(first))
    code = sym.astype(U)
    for back in range(1, ORDER):
        before = np.zeros(len(sym), U)
        before[back:] = sym[: len(sym) - back]
        before[place < back] = 0
        code |= before << U(16 * back)
    return code


def _mask(code: np.ndarray, order: int) -> np.ndarray:
    return code if order == 4 else code & U((1 << (16 * order)) - 1)


def _salted(code: np.ndarray, salt: int) -> np.ndarray:
    return mix(code ^ U(salt * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def _key(code: np.ndarray, order: int) -> np.ndarray:
    return _salted(_mask(code, order), order)


class _Table:
    """Sorted hashes with the languages that have each, and a value for each of them."""

    def __init__(self, hashes: list[np.ndarray], values: list[np.ndarray]):
        """hashes, values: of each language."""
        all_ = np.concatenate(hashes)
        lang = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])
        order = np.lexsort((lang, all_))
        keys, start = np.unique(all_[order], return_index=True)
        self.start = np.append(start, len(all_)).astype(np.int32 if len(all_) < 2**31 else np.int64)
        self.index, self.lang, self.value = SortedHashes(keys), lang[order], np.concatenate(values)[order].astype(np.float32)

    def cells(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, language, value) of the hashes that are here."""
        at = self.index.find(hashes)
        row = np.flatnonzero(at >= 0)
        begin, n = self.start[at[row]], self.start[at[row] + 1] - self.start[at[row]]
        flat = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(row, n), self.lang[flat], self.value[flat]


class Model:
    """Tables of all languages, of what each of them has.  counts: language -> (4-gram codes, counts)."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        grams_, heads_ = ({k: ([], []) for k in range(1, ORDER + 1)} for _ in range(2))
        floor = []
        for lang in self.languages:
            levels = {ORDER: (counts[lang][0], counts[lang][1].astype(np.float64))}
            for k in range(ORDER - 1, 0, -1):  # lower orders count distinct continuations
                codes, n = np.unique(_mask(levels[k + 1][0], k), return_counts=True)
                levels[k] = codes, n.astype(np.float64)
            prob = np.zeros(0)
            for k in range(1, ORDER + 1):
                codes, n = levels[k]
                once, twice = (n == 1).sum(), (n == 2).sum()
                d = once / (once + 2 * twice) if once and twice else 0.5
                heads, at = np.unique(codes >> U(16) if k > 1 else np.zeros(len(codes), U), return_inverse=True)
                total = np.bincount(at, n)
                weight = d * np.bincount(at) / total
                below = 1 / 65536 if k == 1 else prob[np.searchsorted(levels[k - 1][0], _mask(codes, k - 1))]
                prob = np.maximum(n - d, 0) / total[at] + weight[at] * below
                grams_[k][0].append(_key(codes, k))
                grams_[k][1].append(np.log(prob))
                heads_[k][0].append(_salted(heads, k + 8))
                heads_[k][1].append(np.log(weight))
                if k == 1:
                    floor.append(np.log(weight[0] / 65536) if len(weight) else 0.0)
        self.floor = np.array(floor, np.float32)
        self.tables = {k: _Table(*grams_[k]) for k in grams_}
        self.contexts = {k: _Table(*heads_[k]) for k in heads_ if k > 1}

    def log_probs(self, code: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last symbol, a column per language: of the longest gram that it has, with the weights of longer contexts."""
        out = np.repeat(self.floor[None, :], len(code), 0)
        for k in range(1, ORDER + 1):
            if k > 1:
                row, lang, value = self.contexts[k].cells(_salted(_mask(code, k) >> U(16), k + 8))
                out[row, lang] += value
            row, lang, value = self.tables[k].cells(_key(code, k))
            out[row, lang] = value
        return out


def _remember(bits: int):
    def run(batches):
        held: dict[str, Counts] = {}
        for batch, data, offsets in slices(batches):
            sym, first = symbols(data, offsets)
            code = grams(sym, first)
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = np.concatenate([np.zeros(0, U), *(code[first[i] : first[i + 1]] for i in np.flatnonzero(langs == lang))])
                held.setdefault(lang, Counts()).add(own)
        for lang, counts in held.items():
            keys, n = counts.take()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    return run


#: Cells of log probabilities that are held at a time.
CELLS = 1 << 20


def _measure(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple:
    """For each text: symbols, letters or not, and by language the mean negative log probability and its mean square."""
    sym, first = symbols(data, offsets)
    n, code = np.diff(first), grams(sym, first)
    sums, squares = (np.zeros((len(n), len(model.languages))) for _ in range(2))
    step = max(1, CELLS // len(model.languages))
    for at in range(0, len(code), step):
        end = min(at + step, len(code))
        kinds = pa.array(code[at:end]).dictionary_encode()
        lp = -model.log_probs(kinds.dictionary.to_numpy())
        a, b = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, end)
        edges = np.clip(first[a : b + 1], at, end) - at
        full = a + np.flatnonzero(np.diff(edges) > 0)
        own = lp[kinds.indices.to_numpy()].astype(np.float64)
        sums[full] += np.add.reduceat(own, edges[full - a])
        own *= own
        squares[full] += np.add.reduceat(own, edges[full - a])
    most = np.maximum(n, 1)[:, None]
    return n, sums / most, squares / most


def _calibrate(held):
    def run(batches):
        model = held.value
        for batch, data, offsets in slices(batches):
            n, mean, square = _measure(model, data, offsets)
            rows = [(lang, float(mean[i, j]), float(square[i, j] - mean[i, j] ** 2)) for i, lang in enumerate(batch.column(1).to_pylist()) if n[i] and (j := model.languages.index(lang)) >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.float64()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.float64())], ["lang", "mean", "var"])

    return run


def learn(labelled: DataFrame, max_docs: int = 1000) -> tuple[Model, dict] | None:
    """The model, and for each language (mean, variance between documents, variance between symbols)."""
    spark = labelled.sparkSession
    arrow_batches(spark)
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("_h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1_000_000, int(1_000_000 * max_docs / n) + 1))])
    sample = rows.where(F.col("_h") < share[F.col("lang")])
    test = (F.col("_h") % 5 == 0) & (share[F.col("lang")] > 5) & F.col("lang").isin([x for x, n in sizes.items() if n >= SMALL])
    counts = sample.where(~test).select("text", "lang").mapInArrow(_remember(ORDER), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # bounded by the sample
    by = {lang: (x["code"].to_numpy().astype(np.int64).view(U), x["n"].to_numpy()) for lang, x in got.groupby("lang")}
    if not by:
        return None
    model = Model({k: (c[np.argsort(c)], n[np.argsort(c)]) for k, (c, n) in by.items()})
    held = spark.sparkContext.broadcast(model)
    own = sample.where(F.col("lang").isin(model.languages)).where(test).select("text", "lang")
    limits = _fit(own, held)
    few = sample.where(F.col("lang").isin([x for x in model.languages if sizes[x] < SMALL]))
    limits = _cross_fit(few) | limits
    if not limits:
        limits = _fit(sample.select("text", "lang"), held)
    m, v, s = np.mean(list(limits.values()), 0) if limits else (0.0, 0.0, 0.0)
    return model, {x: limits.get(x, (float(m), float(v), float(s))) for x in model.languages}


def _fit(rows: DataFrame, held) -> dict[str, tuple]:
    """For each language (mean, variance between documents, variance between symbols) of rows (text, lang)."""
    return _spread(rows.mapInArrow(_calibrate(held), "lang string, mean double, var double"))


def _spread(measured: DataFrame) -> dict[str, tuple]:
    fit = measured.groupBy("lang").agg(F.avg("mean").alias("m"), F.coalesce(F.var_pop("mean"), F.lit(0.0)).alias("v"), F.avg("var").alias("s"))
    return {r["lang"]: (r["m"], r["v"], r["s"]) for r in fit.collect()}  # a row a language


def _cross_fit(few: DataFrame) -> dict[str, tuple]:
    """The same for languages of few rows, each document measured by a model without its fold."""
    order = Window.partitionBy("lang").orderBy("_h", F.xxhash64("text"))
    rows = few.select("text", F.concat_ws("#", F.pmod(F.row_number().over(order), F.lit(FOLDS)), "lang").alias("lang"))
    got = rows.mapInArrow(_remember(ORDER), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()  # less than SMALL documents a language
    folds: dict = {}
    for name, x in got.groupby("lang"):
        fold, lang = name.split("#", 1)
        folds.setdefault(lang, {})[fold] = (x["code"].to_numpy().astype(np.int64).view(U), x["n"].to_numpy())
    counts = {}
    for lang, parts in folds.items():
        for fold in parts:
            others = [x for k, x in parts.items() if k != fold]
            if others:
                codes, at = np.unique(np.concatenate([x[0] for x in others]), return_inverse=True)
                counts[f"{fold}#{lang}"] = (codes, np.bincount(at, np.concatenate([x[1] for x in others])).astype(np.int64))
    if not counts:
        return {}
    held = few.sparkSession.sparkContext.broadcast(Model(counts))
    measured = rows.where(F.col("lang").isin(list(counts))).mapInArrow(_calibrate(held), "lang string, mean double, var double")
    return _spread(measured.withColumn("lang", F.expr("substring(lang, locate('#', lang) + 1)")))


def _predict(held, z: float, margin: float = 1.0, evidence: int = 100):
    def run(batches):
        model, limits = held.value
        bounds = np.array([limits[x] for x in model.languages])
        for batch, data, offsets in slices(batches):
            n, mean, _ = _measure(model, data, offsets)
            best = mean.argmin(1)
            rows = np.arange(len(n))
            odds = np.exp(-(mean - mean[rows, best][:, None]) * np.minimum(n, evidence)[:, None])
            score = np.where(n > 0, 1 / odds.sum(1), 0.0)
            m, v, s = bounds[best].T
            fits = (n > 0) & (mean[rows, best] <= m + np.maximum(margin, z * np.sqrt(v + s / np.maximum(n, 1))))
            names = np.array([*model.languages, "und"], object)[np.where(n > 0, best, len(model.languages))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(np.where(n > 0, mean[rows, best], np.nan), mask=n == 0), pa.array(fits)], ["doc_id", "lang_pred", "score", "cross_entropy", "accepted"])

    return run


PREDICTION = "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean"


def predict(documents: DataFrame, learned: tuple[Model, dict] | None, z: float = 6.0, evidence: int = 100) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, accepted) for every row.

    The language, the cross-entropy and the acceptance are those of the whole text; the score, a
    softmax over the languages, takes the mean cross-entropy of the whole text for that of
    ``evidence`` symbols at most, since symbols are not independent and it would be 1 for all
    longer texts.
    """
    arrow_batches(documents.sparkSession)
    rows = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    if learned is None:
        return rows.selectExpr("doc_id", "'und' lang_pred", "0D score", "cast(null as double) cross_entropy", "false accepted")
    held = documents.sparkSession.sparkContext.broadcast(learned)
    return rows.mapInArrow(_predict(held, z, evidence=evidence), PREDICTION)


def _keep(held, z: float, schema: pa.Schema):
    predicted = _predict(held, z)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["doc_id", "text"])
            ok = [x for part in predicted(iter([own])) for x in part.column(4).to_pylist()]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return run


def keep_accepted(documents: DataFrame, learned: tuple[Model, dict] | None, z: float = 6.0) -> DataFrame:
    """The documents whose language is recognised, unchanged."""
    arrow_batches(documents.sparkSession)
    if learned is None:
        return documents.where(F.lit(False))
    held = documents.sparkSession.sparkContext.broadcast(learned)
    return documents.mapInArrow(_keep(held, z, None), documents.schema)


def training_rows(documents: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id) modulo 4 is not 2."""
    return documents.where(remainder(F.col("doc_id"), 4) != 2)


def report(documents: DataFrame) -> DataFrame:
    out = predict(documents, learn(training_rows(documents)))
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
