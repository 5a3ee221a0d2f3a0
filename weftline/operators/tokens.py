"""Tokenizers, label masks, length rules, padding and position ids."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE = -100
START, STOP = "<|im_start|>", "<|im_end|>"
#: Fixed marks of the chat form, each one token behind the vocabulary.
SPECIALS = (START, STOP, "<|vision_start|>", "<|vision_end|>", "<|image_pad|>", "<|endoftext|>")
#: Tokens that a task makes or decodes together.
AT_ONCE = 1 << 20
_MARK = re.compile("(" + "|".join(map(re.escape, SPECIALS)) + ")")


class Tokenizer:
    """Plain text by the subclass, chat marks as single ids from ``size`` on; pickled to the workers by its file name."""

    size = 0
    eos, pad = "<|endoftext|>", None

    def plain(self, text: str) -> list[int]:
        raise NotImplementedError

    def text(self, ids: np.ndarray) -> str:
        raise NotImplementedError

    def told(self) -> dict:
        """What a dataset says of its tokenizer: enough to load it again, and to tell another vocabulary."""
        return {"kind": "bytes", "size": self.size, "specials": list(SPECIALS)}

    def special(self, mark: str) -> int:
        return self.size + SPECIALS.index(mark)

    @property
    def pad_id(self) -> int:
        """The padding id; that of the end mark where no padding mark is set."""
        return self.special(self.pad or self.eos)

    def array(self, text: str) -> np.ndarray:
        """The ids of a text; marks stand for themselves."""
        parts = [np.array([self.special(x)] if x in SPECIALS else self.plain(x), np.int32) for x in _MARK.split(text) if x]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def encode(self, text: str) -> list[int]:
        return self.array(text).tolist()

    def decode(self, ids, skip_marks: bool = False) -> str:
        x, out, at = np.asarray(ids, np.int64), [], 0
        for i in [*np.flatnonzero(x >= self.size).tolist(), len(x)]:
            out.append(self.text(x[at:i]) if i > at else "")
            if i < len(x) and not skip_marks and x[i] - self.size < len(SPECIALS):
                out.append(SPECIALS[x[i] - self.size])
            at = i + 1
        return "".join(out)


class ByteTokenizer(Tokenizer):
    """The built-in one: a token for each UTF-8 byte, so that nothing is lost and lengths can be told from the text."""

    size = 256

    def plain(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode(), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        return ids.astype(np.uint8).tobytes().decode(errors="replace")


class FileTokenizer(Tokenizer):
    """A public vocabulary file: .json (tokenizers), .tiktoken or .model (sentencepiece); read once in each worker.

    pattern: the splitting pattern that a .tiktoken file goes with.
    """

    def __init__(self, path: str, pattern: str = r"\S+|\s+"):
        self.path, self.pattern, self._held = path, pattern, None
        self.size = self._size()

    def told(self) -> dict:
        with open(self.path, "rb") as f:
            own = hashlib.file_digest(f, "sha256").hexdigest()
        return super().told() | {"kind": "file", "path": self.path, "pattern": self.pattern, "sha256": own}

    def __getstate__(self):
        return self.__dict__ | {"_held": None}

    @property
    def held(self):
        if self._held is None:
            self._held = self._load()
        return self._held

    def _load(self):
        if self.path.endswith(".json"):
            from tokenizers import Tokenizer as Own

            out = Own.from_file(self.path)
            out.encode_special_tokens = True
            return out
        if self.path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        if self.path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            return SentencePieceProcessor(model_file=self.path)
        raise ValueError(f"unknown vocabulary file {self.path!r}; known: .json, .tiktoken, .model")

    def _size(self) -> int:
        own = self.held
        return own.get_vocab_size() if self.path.endswith(".json") else own.n_vocab if self.path.endswith(".tiktoken") else own.get_piece_size()

    def plain(self, text: str) -> list[int]:
        if self.path.endswith(".json"):
            return self.held.encode(text, add_special_tokens=False).ids
        return self.held.encode_ordinary(text) if self.path.endswith(".tiktoken") else self.held.encode(text)

    def text(self, ids: np.ndarray) -> str:
        return self.held.decode(ids.tolist())


def load_tokenizer(path: str | None = None, **options) -> Tokenizer:
    """The tokenizer of a vocabulary file, or the built-in one."""
    return FileTokenizer(path, **options) if path else ByteTokenizer()


def told_tokenizer(told: dict, path: str | None = None) -> Tokenizer:
    """The tokenizer that a dataset names, its vocabulary at the place that it names or at another; a different vocabulary is an error."""
    own = load_tokenizer(path or told["path"], pattern=told["pattern"]) if told["kind"] == "file" else ByteTokenizer()
    if own.told().get("sha256") != told.get("sha256") or own.size != told["size"]:
        raise ValueError(f"{own.path} is not the vocabulary of the dataset")
    return own


def turn_text(role: str, content: str) -> str:
    return f"{START}{role}\n{content}{STOP}\n"


def pieces(sizes: np.ndarray, most: int = AT_ONCE) -> list[tuple[int, int]]:
    """Stretches of rows that begin within the same ``most`` tokens, so that each has at most that and its last row."""
    before = np.cumsum(sizes) - sizes
    return list(pairwise([0, *(np.flatnonzero(np.diff(before // most)) + 1).tolist(), len(sizes)])) if len(sizes) else []


def mapped(rows: DataFrame, sizes, make, without: tuple = (), **added: str) -> DataFrame:
    """The rows with columns ``added`` (name: type) from ``make(part)``, and without others, a few MB of tokens at a time.

    A batch is told by its rows, whose token arrays may be long; sizes(batch) gives about the tokens of each.
    """
    rows = rows.drop(*added)
    own = [c for c in rows.columns if c not in without]
    schema = rows.select(*own, *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema

    def run(batches):
        for batch in batches:
            for a, b in pieces(sizes(batch)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *make(part)], [*own, *added])

    return rows.mapInArrow(run, schema)


def id_lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))


def _turn_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Where the turns of each row begin and end among all, and their roles and contents."""
    messages = batch.column("messages")
    flat = messages.flatten()
    fields = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    counts = pc.fill_null(pc.list_value_length(messages), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), fields["role"], fields["content"]


def turn_sizes(batch: pa.RecordBatch) -> np.ndarray:
    """The bytes of each row's contents."""
    ends, _, content = _turn_columns(batch)
    size = pc.fill_null(pc.binary_length(content), 0).to_numpy(zero_copy_only=False)
    return np.diff(np.concatenate([[0], np.cumsum(size)])[ends])


def turns(batch: pa.RecordBatch) -> list[list[tuple[str, str]]]:
    """(role, content) of the turns of each row; no content is an empty one."""
    ends, role, content = _turn_columns(batch)
    own = [(r, c or "") for r, c in zip(role.to_pylist(), content.to_pylist(), strict=True)]
    return [own[a:b] for a, b in pairwise(ends.tolist())]


def array_columns(rows) -> tuple[pa.Array, ...]:
    """Columns of (ids, labels) for each row."""
    ids, labels = zip(*rows, strict=True)
    return id_lists(ids), id_lists(labels)


def count_columns(rows) -> tuple[pa.Array, ...]:
    """Columns of the counts of ids, of labels, and of labels that are not -100, for (ids, labels) of each row."""
    found = [(len(ids), len(labels), int(np.count_nonzero(labels != IGNORE))) for ids, labels in rows]
    return tuple(pa.array(x, pa.int32()) for x in zip(*found, strict=True))


#: What a row gets from its ids and labels: both, or their counts alone, for which no array leaves the worker.
ARRAYS, COUNTS = {"input_ids": "array<int>", "labels": "array<int>"}, {"n_tokens": "int", "n_labels": "int", "n_supervised": "int"}


def encoded(part: pa.RecordBatch, tok: Tokenizer, all_roles: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, labels) of each row, one by one."""
    none = np.zeros(0, np.int32)
    for row in turns(part):
        own = [tok.array(turn_text(role, text)) for role, text in row]
        told = [x if role == "assistant" or (all_roles and role != "user") else np.full(len(x), IGNORE, np.int32) for x, (role, _) in zip(own, row, strict=True)]
        yield np.concatenate([none, *own]), np.concatenate([none, *told])


def tokenize(conversations: DataFrame, max_length: int, tokenizer=None, all_roles: bool = False, counted: bool = False) -> DataFrame:
    """Adds input_ids, labels and n_tokens from ``messages``; rows beyond ``max_length`` go, and empty ones.

    Labels are the ids of assistant turns (``all_roles``: of every turn but the user's) and -100
    elsewhere.  A turn ends in marks that are tokens by themselves, so turns are encoded one by one.
    With ``counted`` the rows get n_tokens, n_labels and n_supervised in place of the arrays.
    """
    tok, told = tokenizer or ByteTokenizer(), count_columns if counted else array_columns
    rows = mapped(conversations, turn_sizes, lambda part: told(encoded(part, tok, all_roles)), ("messages",), **(COUNTS if counted else ARRAYS))
    return length_filter(rows if counted else rows.withColumn("n_tokens", F.size("input_ids")), 1, max_length)


def tokenize_mode(conversations: DataFrame, mode: str, max_length: int, tokenizer=None, counted: bool = False, **vision) -> DataFrame:
    """Tokens by mode: with images for panorama and multi-view modes, else text alone; with ``counted`` their counts alone."""
    from weftline.operators import conversations as known
    from weftline.operators import vision as images

    if mode not in known.MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(known.MODES)}")
    if mode == "panorama" or mode in known.MULTI_VIEW:
        return images.tokenize(conversations, max_length, tokenizer, counted=counted, **vision)
    return tokenize(conversations, max_length, tokenizer, counted=counted)


def discarded(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after a filter, and those discarded."""
    n = before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after")))  # one row each
    return n.withColumn("discarded", F.col("before") - F.col("after"))


def length_filter(tokens: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Both ends belong to the range; works on the stored ``n_tokens``, so it reaches the scan."""
    kept = tokens.where(F.col("n_tokens") >= least)
    return kept if most is None else kept.where(F.col("n_tokens") <= most)


def aligned_labels(ids: Column, labels: Column) -> Column:
    """Labels as long as the ids: cut at the right, or filled up with -100 at the left."""
    return F.when(F.size(labels) >= F.size(ids), F.slice(labels, F.lit(1), F.size(ids))).otherwise(F.concat(F.array_repeat(F.lit(IGNORE), F.size(ids) - F.size(labels)), labels))


def padded(column: Column, to: Column, fill: int) -> Column:
    cut = F.slice(column, F.lit(1), to)
    return F.concat(cut, F.array_repeat(F.lit(fill), to - F.size(cut)))


def collate(rows: DataFrame, batch_size: int, pad_id: int, order: list[str], max_length: int | None = None, fixed: bool = False) -> DataFrame:
    """Adds batch_id and attention_mask, and pads input_ids and labels to the longest of the batch (or to max_length if ``fixed``).

    Longer rows are cut to ``max_length``.  They are cut before they are numbered, which writes them.
    """
    from weftline.operators.ranks import batches

    cut = (lambda c: F.slice(c, F.lit(1), F.lit(max_length))) if max_length else F.col
    held = batches(rows.withColumns({"input_ids": cut("input_ids"), "labels": cut("labels")}), batch_size, order)
    longest = held.groupBy("batch_id").agg(F.lit(max_length).alias("_to") if fixed and max_length else F.max(F.size("input_ids")).alias("_to"))
    held = held.join(longest, "batch_id").withColumn("_n", F.size("input_ids"))
    mask = F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), F.col("_to") - F.col("_n")))
    out = held.withColumns({"attention_mask": mask, "input_ids": padded(F.col("input_ids"), F.col("_to"), pad_id), "labels": padded(F.col("labels"), F.col("_to"), IGNORE)})
    return out.drop("_n", "_to")


def id_arrays(column: pa.ListArray) -> list[np.ndarray | None]:
    """The arrays of a column of lists, null for null."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] if there else None for a, b, there in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_valid().to_pylist(), strict=True)]


def decoded(rows: DataFrame, tokenizer=None) -> DataFrame:
    """Adds ``text`` (decoded input_ids) and ``label_text`` (decoded labels without -100)."""
    tok = tokenizer or ByteTokenizer()

    def sizes(batch):
        return pc.fill_null(pc.list_value_length(batch.column("input_ids")), 0).to_numpy(zero_copy_only=False)

    def make(part):
        ids, labels = (id_arrays(part.column(c)) for c in ("input_ids", "labels"))
        return pa.array([None if x is None else tok.decode(x) for x in ids], pa.string()), pa.array([None if x is None else tok.decode(x[x != IGNORE]) for x in labels], pa.string())

    return mapped(rows, sizes, make, text="string", label_text="string")


def rendered(conversations: DataFrame, max_length: int, tokenizer=None) -> DataFrame:
    """What ``decoded`` gives for the rows of ``tokenize``, with n_tokens and without the arrays, which no worker hands on."""
    tok = tokenizer or ByteTokenizer()

    def make(part):
        found = [(len(ids), tok.decode(ids), tok.decode(labels[labels != IGNORE])) for ids, labels in encoded(part, tok)]
        return tuple(pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.string(), pa.string()), strict=True))

    return length_filter(mapped(conversations, turn_sizes, make, ("messages",), n_tokens="int", text="string", label_text="string"), 1, max_length)


def position_ids(lengths: Column, to: Column) -> Column:
    """Positions that start anew at each sub-sequence and in the padding, cut at ``to``."""
    total = F.aggregate(lengths, F.lit(0), lambda a, n: a + n)
    whole = F.concat(lengths, F.when(to > total, F.array(to - total)).otherwise(F.array().cast("array<int>")))
    runs = F.transform(F.filter(whole, lambda n: n > 0), lambda n: F.sequence(F.lit(0), n - 1))
    return F.slice(F.flatten(runs), F.lit(1), to)


def boundaries(lengths: Column) -> Column:
    """Prefix sums from 0: [3, 4, 2] gives [0, 3, 7, 9]."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def parse_batches(spec) -> list[int]:
    """5, "1-5" or [0, "5-10", 15] to a sorted list of batch numbers."""
    out: set[int] = set()
    for item in spec if isinstance(spec, (list, tuple)) else [spec]:
        low, dash, high = str(item).strip().partition("-")
        first, last = int(low), int(high) if dash else int(low)
        if last < first:
            raise ValueError(f"bad batch range {item!r}")
        out.update(range(first, last + 1))
    return sorted(out)
