"""Column expressions of the feed. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import (
    CAP_BYTES,
    CLASSES,
    DONE_NAME,
    PAD,
    SHARD_ID_PATTERN,
    SHARD_NAME_PATTERN,
    VOCAB,
    WORD_BYTES,
)


def whole_div(value: Column, divisor: Column | int) -> Column:
    """Integer quotient on bigint, without a detour through double."""
    divisor = F.lit(divisor) if isinstance(divisor, int) else divisor
    return F.call_function("div", value, divisor)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, for uses that would repeat it per array element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# -- shard names ----------------------------------------------------------------------------------

def shard_index(path: Column) -> Column:
    """Number in a shard's file name; null where the name has none."""
    digits = F.regexp_extract(path, SHARD_ID_PATTERN, 1)
    return F.when(digits != "", digits.cast("bigint"))


def is_publishable(name: Column) -> Column:
    """True for a finished shard file, so never for one still under its temporary name."""
    return name.rlike(SHARD_NAME_PATTERN)


def is_leftover(name: Column, strict: bool = True) -> Column:
    """True for what a new run has to clear away: the end marker and earlier shards.

    ``strict`` asks for the shard suffixes as well as the prefix.
    """
    shard = name.startswith("shard_")
    if strict:
        shard = shard & (name.endswith(".pt") | name.endswith(".pt.tmp"))
    return shard | (name == DONE_NAME)


# -- shapes and sizes -----------------------------------------------------------------------------

def batch_bytes(n: Column, sample_size: Column | int) -> Column:
    """Bytes of a batch, computed in bigint so that large shapes do not wrap."""
    size = F.lit(sample_size) if isinstance(sample_size, int) else sample_size
    return n.cast("bigint") * size.cast("bigint")


def batch_fault(n: Column, sample_size: Column | int, cap: int = CAP_BYTES) -> Column:
    """Why a batch is refused (``empty`` or ``over cap``), or null for one that is accepted."""
    size = batch_bytes(n, sample_size)
    return F.when(size <= 0, F.lit("empty")).when(size >= cap, F.lit("over cap"))


def valid_batch(n: Column, sample_size: Column | int, cap: int = CAP_BYTES) -> Column:
    return batch_fault(n, sample_size, cap).isNull()


def split_valid(df: DataFrame, n: Column, sample_size: Column | int, cap: int = CAP_BYTES):
    """(accepted, rejected); the rejected rows carry the ``reason``."""
    judged = df.withColumn("reason", batch_fault(n, sample_size, cap))
    accepted = judged.where(F.col("reason").isNull()).drop("reason")
    return accepted, judged.where(F.col("reason").isNotNull())


def sample_bytes(seq_len: Column) -> Column:
    """Bytes of a sample of ``seq_len`` token words and one label word."""
    return (seq_len.cast("bigint") + 1) * WORD_BYTES


def human_bytes(n: Column) -> Column:
    """Byte count with a binary unit, one decimal, right-aligned in six places.

    Halves go to the even digit.
    """

    def shown(power: int, unit: str) -> Column:
        return F.format_string(f"%6.1f {unit}", F.bround(n / float(1024**power), 1))

    text = shown(4, "TiB")
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB"), (0, "B")):
        text = F.when(n < 1024 ** (power + 1), shown(power, unit)).otherwise(text)
    return text


# -- words, tokens, labels ------------------------------------------------------------------------

def clamp_tokens(x: Column, vocab: int = VOCAB) -> Column:
    """Every word brought into ``[0, vocab)``; negative words too."""
    return F.transform(x, lambda word: F.pmod(word, F.lit(vocab).cast("bigint")))


def clamp_labels(y: Column, classes: int = CLASSES) -> Column:
    return F.pmod(y, F.lit(classes).cast("bigint"))


def token_ids(text: Column, vocab: int = VOCAB) -> Column:
    """Ids of the whitespace-separated words of a whole text.

    The feed itself starts from ids; this is the rule that turns the given text tables into ids.
    """
    words = F.filter(F.split(text, "[ \\t\\n\\r\\f]+"), lambda w: w != "")
    return F.transform(
        words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % vocab
    )


def fixed_rows(x: Column, seq_len: int, pad: int = PAD) -> Column:
    """A sequence cut into rows of exactly ``seq_len``, the last one padded. No token is lost.

    An empty sequence gives one row of padding.
    """
    rows = F.greatest(F.lit(1), F.ceil(F.size(x) / F.lit(seq_len)).cast("int"))
    padding = F.array_repeat(F.lit(pad).cast("bigint"), seq_len)

    def row(i: Column) -> Column:
        part = F.slice(x, i * seq_len + 1, F.lit(seq_len))
        return F.when(F.size(part) == seq_len, part).otherwise(
            F.slice(F.concat(part, padding), 1, seq_len)
        )

    return F.transform(F.sequence(F.lit(0), rows - 1), row)


def reshape_words(words: Column, n: Column, seq_len: int) -> Column:
    """Struct ``(x, y)`` of a shard's words: the block of ``n`` rows, then the block of ``n`` labels.

    Null where there are fewer words than the shape asks for.
    """
    rows = F.transform(
        F.sequence(F.lit(0), n.cast("int") - 1),
        lambda i: F.slice(words, i * seq_len + 1, F.lit(seq_len)),
    )
    labels = F.slice(words, n.cast("int") * seq_len + 1, n.cast("int"))
    enough = (n > 0) & (F.size(words) >= n * (seq_len + 1))
    return F.when(enough, F.struct(rows.alias("x"), labels.alias("y")))


# -- times ----------------------------------------------------------------------------------------

def to_ms(seconds: Column) -> Column:
    return seconds * 1000.0


def load_time(host: Column, injected: Column) -> Column:
    """Host time less the injected wait, never below zero."""
    return F.greatest(F.lit(0.0), host - injected)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, and 0 where there is no whole to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
