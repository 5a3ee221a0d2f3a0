"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary file is read, never trained.  Encoding runs the agenda of a BPE model: adjacent
symbols that together are a piece are candidates, and the candidate with the best score (the
leftmost of equals) merges first.  With dropout, a candidate is skipped for good if the keyed
hash of seed, doc_id, the word's place in the document and the candidate's place in the word
falls below ``dropout``; so every occurrence of a word is segmented on its own, and the same
seed gives the same result on any cluster.  Dropout 0 is the plain encoding.

An occurrence none of whose candidates on the way to the plain encoding is skipped has that
encoding, which is kept from slice to slice with these candidates; only the others take the
agenda.

Merges never cross the start of a run of spaces nor a character that is no piece, so those cut
a text into words.  The words of a slice are encoded together, one merge of each per round, as
arrays; words of more than ``LONG`` characters take a heap instead, with the same result.

Characters without a piece - and the sign U+2581 itself, which stands for a space inside pieces
- become byte pieces, so decoding gives back every text exactly.  Defined cases: null and empty
texts have no tokens (null stays null); repeated rows get equal results; a null doc_id is
hashed as 0.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import arrow_batches
from weftline.llm._text import SortedHashes, Spans, U, mix, mix_int, slices

LONG = 64
#: Bytes of text encoded at once; the arrays of a slice take many times as much.
SLICE = 1 << 18
#: Symbols whose words are encoded together, so that the arrays stay in the processor's cache.
AT_ONCE = 1 << 16
SPACE_SIGN = "▁"
NORMAL, BYTE = 1, 6


class Vocabulary:
    """Pieces, merges and byte pieces of a BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        pieces = [sp.id_to_piece(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.bytes = [b"" if special[i] else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        by_score = sorted(ids.values(), key=lambda i: -sp.get_score(i))
        rank, scores, last = np.zeros(n, np.int64), 0, None
        for i in by_score:
            if sp.get_score(i) != last:
                scores, last = scores + 1, sp.get_score(i)
            rank[i] = scores
        self.rank, self.size = rank, n
        self.first = np.full(0x110000, -1, np.int32)
        pairs = {}
        for p, i in ids.items():
            if len(p) == 1:
                self.first[ord(p)] = i
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        self.space = ids[SPACE_SIGN]
        self.first[ord(SPACE_SIGN)] = -1
        self.first[ord(" ")] = self.space
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        hashed = mix(keys.view(U))
        order = np.argsort(hashed)
        self.index = SortedHashes(hashed[order])
        self.merged = np.fromiter(pairs.values(), np.int32, len(pairs))[order]

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids])[1:].decode()


def _places(left, middle, right):
    """A candidate's character places as one number."""
    return left.astype(U) << U(42) | middle.astype(U) << U(21) | right.astype(U)


def _packed(places: np.ndarray) -> np.ndarray:
    """Places in a word of ``LONG`` characters at most, as 32 bits."""
    return (places >> U(42) << U(14) | (places >> U(21) & U(127)) << U(7) | places & U(127)).astype(np.uint32)


def _unpacked(packed: np.ndarray) -> np.ndarray:
    return _places(packed >> np.uint32(14), packed >> np.uint32(7) & np.uint32(127), packed & np.uint32(127))


def _dropped(key, left, middle, right, cut: np.uint64):
    """Is the candidate over these character places skipped?"""
    if not cut:
        return np.zeros(np.shape(left), bool)
    return mix(key ^ _places(left, middle, right)) < cut


def agenda(vocabulary: Vocabulary, symbols: list[int], key: int, cut: np.uint64) -> list[int]:
    """One word by a heap: piece ids, or symbols below 0 as they came."""
    n = vocabulary.size
    ids, start = list(symbols), list(range(len(symbols)))
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    end = list(range(1, len(ids) + 1))
    heap: list = []
    k = np.array([key], U)

    def push(a):
        b = after[a]
        if a < 0 or b >= len(ids) or ids[a] < 0 or ids[b] < 0:
            return
        to = vocabulary.pairs.get(ids[a] * n + ids[b])
        if to is not None and not _dropped(k, np.array([start[a]]), np.array([start[b]]), np.array([end[b]]), cut)[0]:
            heapq.heappush(heap, (int(vocabulary.rank[to]), start[a], a, b, end[b], to))

    alive = [True] * len(ids)
    for a in range(len(ids) - 1):
        push(a)
    while heap:
        _, _, a, b, e, to = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or after[a] != b or end[b] != e or vocabulary.pairs.get(ids[a] * n + ids[b]) != to:
            continue
        ids[a], end[a], alive[b], after[a] = to, end[b], False, after[b]
        if after[a] < len(ids):
            before[after[a]] = a
        if before[a] >= 0:
            push(before[a])
        push(a)
    return [i for i, ok in zip(ids, alive, strict=True) if ok]


def batch_agenda(vocabulary: Vocabulary, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, cut: np.uint64, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Many words together: (ids laid end to end, how many of each word); ``seen`` takes (word, places) of all candidates."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    ids = symbols.astype(np.int64)
    left = np.arange(len(ids)) - begin[word]
    right = left + 1
    done: list[tuple] = []
    none = np.iinfo(np.int64).max
    fresh = np.ones(len(ids), bool)  # the candidate with the next symbol has to be looked up
    to, order = np.zeros(len(ids), np.int32), np.full(len(ids), none)
    while len(ids):
        look = np.flatnonzero(fresh[:-1] & (word[:-1] == word[1:])) if len(ids) > 1 else np.zeros(0, np.int64)
        order[fresh] = none
        look = look[(ids[look] >= 0) & (ids[look + 1] >= 0)]
        at = vocabulary.index.find(mix((ids[look] * vocabulary.size + ids[look + 1]).astype(U)))
        look, at = look[at >= 0], at[at >= 0]
        if seen is not None:
            seen.append((word[look], _places(left[look], left[look + 1], right[look + 1])))
        stay = ~_dropped(keys[word[look]], left[look], left[look + 1], right[look + 1], cut)
        look, at = look[stay], at[stay]
        to[look] = vocabulary.merged[at]
        order[look] = vocabulary.rank[to[look]] << 21 | left[look]
        fresh[:] = False
        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(order, head)
        size = np.diff(np.append(head, len(ids)))
        best = np.repeat(best, size)
        over = best == none
        if over.any():
            done.append((word[over], left[over], ids[over]))
        merge = np.flatnonzero((order == best) & ~over)
        ids[merge], right[merge] = to[merge], right[merge + 1]
        fresh[merge] = True
        back = merge[merge > 0] - 1
        fresh[back] = True
        keep = ~over
        keep[merge + 1] = False
        word, ids, left, right, fresh, to, order = (x[keep] for x in (word, ids, left, right, fresh, to, order))
    if not done:
        return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
    word, left, ids = (np.concatenate(x) for x in zip(*done, strict=True))
    by = np.lexsort((left, word))
    return ids[by], np.bincount(word, minlength=len(lengths))


def _expand(vocabulary: Vocabulary, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols without a piece (-1 - code point) become byte pieces."""
    lost = np.flatnonzero(ids < 0)
    if not len(lost):
        return ids.astype(np.int32), count
    raw = [np.frombuffer(chr(-1 - int(c)).encode(), np.uint8) for c in ids[lost]]
    size = np.ones(len(ids), np.int64)
    size[lost] = [len(r) for r in raw]
    out = np.repeat(ids, size).astype(np.int32)
    at = np.repeat(ids < 0, size)
    out[at] = vocabulary.byte_ids[np.concatenate(raw)]
    ends = np.concatenate([[0], np.cumsum(size)])
    marks = np.concatenate([[0], np.cumsum(count)])
    return out, np.diff(ends[marks])


def _encode_words(vocabulary: Vocabulary, sym: np.ndarray, begin: np.ndarray, lengths: np.ndarray, keys: np.ndarray, cut: np.uint64, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids laid end to end, how many of each) of the words at these places; ``seen`` takes the candidates of all but long words."""
    short = lengths <= LONG
    n = lengths[short]
    flat = np.repeat(begin[short] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    ends, own_keys, which, parts = np.concatenate([[0], np.cumsum(n)]), keys[short], np.flatnonzero(short), []
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(flat), AT_ONCE)), len(n)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        met = None if seen is None else []
        parts.append(batch_agenda(vocabulary, sym[flat[ends[a] : ends[b]]], n[a:b], own_keys[a:b], cut, met))
        if seen is not None:
            seen += [(which[a + w], places) for w, places in met]
    ids, sizes = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if short.all():
        return ids.astype(np.int32), sizes
    size = np.zeros(len(lengths), np.int64)
    size[short] = sizes
    own = {i: agenda(vocabulary, sym[begin[i] : begin[i] + lengths[i]].tolist(), int(keys[i]), cut) for i in np.flatnonzero(~short)}
    for i, got in own.items():
        size[i] = len(got)
    out, at = np.empty(size.sum(), np.int32), np.concatenate([[0], np.cumsum(size)])
    out[np.repeat(short, size)] = ids
    for i, got in own.items():
        out[at[i] : at[i + 1]] = got
    return out, size


class Cache:
    """Plainly encoded words and their candidates by key, from slice to slice of a worker; starts anew when it holds ``most`` words.

    A candidate is three places in a word of ``LONG`` characters at most, in one number of 32 bits.  Ids and
    candidates are appended in place, so that a slice copies its own alone.
    """

    def __init__(self, most: int = 400_000):
        self.most = most
        self.ids, self.places = np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.clear()

    def clear(self) -> None:
        self.keys, self.spans = np.zeros(0, U), np.zeros((0, 4), np.int32)
        self.n_ids = self.n_places = 0

    def find(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The spans (ids from, how many, places from, how many) of each, and whether it is held."""
        if not len(self.keys):
            return np.zeros((len(kinds), 4), np.int64), np.zeros(len(kinds), bool)
        at = np.minimum(np.searchsorted(self.keys, kinds), len(self.keys) - 1)
        return self.spans[at].astype(np.int64), self.keys[at] == kinds

    def keep(self, kinds: np.ndarray, ids: np.ndarray, n: np.ndarray, places: np.ndarray, n_places: np.ndarray) -> np.ndarray:
        """Takes words that are not held, by rising key, and gives their spans; they stay until ``settle``."""
        spans = np.stack([self.n_ids + _starts(n), n, self.n_places + _starts(n_places), n_places], 1)
        self.ids, self.n_ids = _appended(self.ids, self.n_ids, ids)
        self.places, self.n_places = _appended(self.places, self.n_places, places)
        if len(self.keys) + len(kinds) <= self.most:
            at = np.searchsorted(self.keys, kinds)
            self.keys, self.spans = np.insert(self.keys, at, kinds), np.insert(self.spans, at, spans.astype(np.int32), 0)
        else:
            self.keys = np.zeros(0, U)
        return spans

    def settle(self) -> None:
        """At the end of a slice: lets all words go if they were too many."""
        if not len(self.keys) or max(self.n_ids, self.n_places) > 16 * self.most:
            self.clear()
        if max(len(self.ids), len(self.places)) > 32 * self.most:
            self.__init__(self.most)


def _appended(held: np.ndarray, n: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """An array with ``more`` behind its first n values, and how many they are now."""
    if n + len(more) > len(held):
        held, old = np.empty(max(n + len(more), 2 * n), held.dtype), held
        held[:n] = old[:n]
    held[n : n + len(more)] = more
    return held, n + len(more)


def _starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64)


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of these spans, one after another."""
    return np.repeat(begin - _starts(n), n) + np.arange(n.sum())


def encode_texts(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray, doc_ids: np.ndarray, seed: int = 0, dropout: float = 0.1, cache: Cache | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts laid end to end, and where each text's begin."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=count[1:])
    edge = count[offsets]
    some = np.diff(edge) > 0
    held = np.insert(points, edge[:-1][some], 0x20)  # the space that the model puts before a text
    first = edge + np.concatenate([[0], np.cumsum(some)])
    sym = vocabulary.first[held].astype(np.int64)
    lost = sym < 0
    sym[lost] = -1 - held[lost]
    if not len(sym):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    space = held == 0x20
    cut = np.zeros(len(sym) + 1, bool)
    cut[first] = True
    cut[:-1] |= lost
    cut[1:] |= lost
    cut[1:-1] |= space[1:] & ~space[:-1]
    begin = np.flatnonzero(cut[:-1])
    lengths = np.diff(np.append(begin, len(sym)))
    text = np.searchsorted(first, begin, "right") - 1
    place = begin - first[text]
    word_hash = Spans(mix(sym.view(U))).hash(begin, begin + lengths)
    kinds, at, back = np.unique(word_hash, return_index=True, return_inverse=True)
    cache = cache or Cache()
    spans, known = cache.find(kinds)
    new, seen = np.flatnonzero(~known), []
    got, n = _encode_words(vocabulary, sym, begin[at[new]], lengths[at[new]], kinds[new], U(0), seen)
    word, places = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, U), zip(*seen, strict=True), strict=True)) if seen else (np.zeros(0, np.int64), np.zeros(0, U))
    spans[new] = cache.keep(kinds[new], got, n, _packed(places[np.argsort(word, kind="stable")]), np.bincount(word, minlength=len(new)))
    ids, n_ids = cache.ids, cache.n_ids
    where, size = spans[back, 0], spans[back, 1]
    if dropout > 0:
        keys = mix(mix(doc_ids[text].view(U) ^ U(mix_int(seed))) + place.astype(U))
        limit = U(min(2**64 - 1, int(dropout * 2**64)))
        n_places = spans[back, 2:].T
        skipped = mix(np.repeat(keys, n_places[1]) ^ _unpacked(cache.places[_spread(*n_places)])) < limit
        far = lengths > LONG
        far[np.repeat(np.arange(len(begin)), n_places[1])[skipped]] = True
        own, n = _encode_words(vocabulary, sym, begin[far], lengths[far], keys[far], limit)
        where[far], size[far] = n_ids + _starts(n), n
        ids, _ = _appended(ids, n_ids, own)  # behind the words that are held, which the next slice writes over
    ends = np.cumsum(size)
    out = ids[_spread(where, size)]
    cache.settle()
    marks = np.concatenate([[0], ends])[np.searchsorted(begin, first)]
    out, n_tokens = _expand(vocabulary, out.astype(np.int64), np.diff(marks))
    return out, np.concatenate([[0], np.cumsum(n_tokens)])


_held: dict[str, Vocabulary] = {}
_caches: dict[str, Cache] = {}


def vocabulary(name: str) -> Vocabulary:
    """The vocabulary of a file that the driver has sent, read once in a worker."""
    if name not in _held:
        _held[name] = Vocabulary(SparkFiles.get(name))
    return _held[name]


ENCODED = "doc_id long, n_tokens long, ids array<int>, lossless boolean"


def _encode(name: str, seed: int, dropout: float):
    def run(batches):
        v = vocabulary(name)
        cache = _caches.setdefault(name, Cache())
        for batch, data, offsets in slices(batches, limit=SLICE):
            docs = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, marks = encode_texts(v, data, offsets, docs, seed, dropout, cache)
            view, flat = memoryview(data), ids.tolist()
            same = [b"".join([v.bytes[k] for k in flat[marks[i] : marks[i + 1]]])[1:] == view[offsets[i] : offsets[i + 1]] for i in range(batch.num_rows)]
            lists = pa.ListArray.from_arrays(pa.array(marks.astype(np.int32)), pa.array(ids))
            null = batch.column(1).is_null()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(marks)), pa.ListArray.from_arrays(lists.offsets, lists.values, mask=null) if batch.column(1).null_count else lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "lossless"])

    return run


def encode(documents: DataFrame, model_file: str, seed: int = 0, dropout: float = 0.1) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless): tokens of whole texts, and whether decoding gives the text back."""
    spark = documents.sparkSession
    arrow_batches(spark)
    spark.sparkContext.addFile(model_file)
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_encode(model_file.rsplit("/", 1)[-1], seed, dropout), ENCODED)


def decode(encoded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """The rows with ``text``, decoded from their token ids; null ids give null."""
    spark = encoded.sparkSession
    arrow_batches(spark)
    spark.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]

    def run(batches):
        v = vocabulary(name)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = pa.array([None if x is None else v.decode(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "text"])

    return encoded.drop("text").mapInArrow(run, encoded.drop("text").withColumn("text", F.lit(None).cast("string")).schema)
