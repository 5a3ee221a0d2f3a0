"""Line dedup with DataFrame functions only.

Texts are split at newlines; a line's key is the line stripped of ASCII white space and with
A-Z in lower case.  Keys of at least ``min_chars`` code points that ``min_docs`` or more
documents hold lose all their lines, but not those of the largest doc_id that holds them.

Only 128-bit key hashes and positions are shuffled for counting: each document sends a key
once, partial aggregation brings a hot key to one row a task.  The verdicts, a row for each key
that goes, are written out first: the join that carries them back then has a bare shuffle on
both sides, which AQE splits where a key is hot.  The texts move once, to meet their verdicts.

Defined cases: null or empty text is one empty line.  A document is a distinct pair of doc_id
and text: repeated rows count once for the threshold, and each loses the same lines; rows of
one doc_id with different texts count one by one.  Rows with a null doc_id never count and
keep all lines.  Further columns pass
through ``dedup_lines`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\f\r"


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; the general lower() only where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _long_keys(lines: Column, min_chars: int) -> Column:
    """(pos, key) of the lines whose key is long enough, in order."""
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key")))
    return F.filter(numbered, lambda x: F.char_length(x["key"]) >= min_chars)


def dropped_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, th, pos array<int>): the positions that go, for documents (by id and text hash) that lose any."""
    docs = documents.where(F.col("doc_id").isNotNull())
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(_long_keys(F.split(F.coalesce("text", F.lit("")), "\n", -1), min_chars)).alias("x"))
    key = ascii_lower(F.col("x.key"))
    lines = lines.select("doc_id", "th", F.col("x.pos").alias("pos"), key.alias("key")).select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    once = lines.groupBy("doc_id", "th", "h1", "h2").agg(F.collect_set("pos").alias("pos"))
    held = once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner")).where(F.col("n_docs") >= min_docs).select("h1", "h2", "owner")
    held = written(held)
    gone = once.join(held, ["h1", "h2"]).where(F.col("doc_id") < F.col("owner"))
    return gone.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("pos")).alias("pos"))


def with_kept_text(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The rows of ``documents`` with __weft_kept (text), __weft_n_lines and __weft_n_dropped."""
    gone = dropped_lines(documents, min_chars, min_docs).select(F.col("doc_id").alias("__weft_id"), F.col("th").alias("__weft_th"), F.col("pos").alias("__weft_gone"))
    joined = documents.withColumn("__weft_hash", F.xxhash64("text")).join(gone, (F.col("doc_id") == F.col("__weft_id")) & (F.col("__weft_hash") == F.col("__weft_th")), "left")
    joined = joined.withColumn("__weft_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))  # behind the join: only the text is shuffled
    n = F.size("__weft_lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__weft_gone"))
    kept = F.when(F.col("__weft_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("__weft_lines"), i)), "\n"))
    return joined.withColumns({"__weft_kept": kept, "__weft_n_lines": n.cast("long"), "__weft_n_dropped": F.coalesce(F.size("__weft_gone"), F.lit(0)).cast("long")}).drop("__weft_lines", "__weft_gone", "__weft_id", "__weft_th", "__weft_hash")


def dedup_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents with their kept lines as text (null stays null); n_chars follows where it exists."""
    out = with_kept_text(documents, min_chars, min_docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("__weft_kept")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)


def report(documents: DataFrame) -> DataFrame:
    return with_kept_text(documents).select("doc_id", F.col("__weft_n_lines").alias("n_lines"), F.col("__weft_n_dropped").alias("n_dropped"), F.sha2(F.col("__weft_kept").cast("binary"), 256).alias("kept_sha256"))
