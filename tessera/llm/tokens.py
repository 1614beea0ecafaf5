"""Token counts by a whole-token shortcut."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import prepare

VOCABULARY = "word_bpe_49k.json"

#: The pattern by which the vocabulary's own file splits text, and its two special strings.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

#: Below this character lower-casing is plain and nothing composes, so that the file's normaliser is ``str.lower``.
PLAIN_BELOW = "İ"
#: Python splits at these as well; the library does not.
EXTRA_SPACE = regex.compile("[\x1c-\x1f]")
#: A worker forgets its chunks beyond so many.
CACHE = 400_000


def load(vocabulary: str):
    """The library's tokenizer for a file of the public vocabularies (a name of theirs, or a path)."""
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))


def _bytes_of() -> dict[str, int]:
    """Byte that each letter of the vocabulary's byte alphabet stands for: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def whole_tokens(vocabulary: str = VOCABULARY) -> frozenset[str]:
    """Vocabulary strings that the library itself encodes alone as one token, and that are one pre-token."""
    tok, byte_of = load(vocabulary), _bytes_of()
    strings = []
    for piece in tok.get_vocab():
        try:
            strings.append(bytes(byte_of[c] for c in piece.removesuffix("</w>")).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    strings = [s for s in set(strings) if s and max(s) < PLAIN_BELOW and s == s.lower() and PRETOKEN.fullmatch(s)]
    found = tok.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, found, strict=True) if len(e.ids) == 1)


class TokenCounter:
    """Counts the library's tokens of a text, encoding only what the shortcut doesn't cover."""

    def __init__(self, vocabulary: str, whole: frozenset[str]) -> None:
        self.tok, self.whole = load(vocabulary), whole
        self.chunks: dict[str, int] = {}
        self.rest: dict[str, int] = {}

    def _encoded(self, s: str) -> int:
        return len(self.tok.encode(s, add_special_tokens=False).ids)

    def _merged(self, pretoken: str) -> int:
        n = self.rest.get(pretoken)
        if n is None:
            if len(self.rest) > CACHE:
                self.rest.clear()
            n = self.rest[pretoken] = self._encoded(pretoken)
        return n

    def _chunk(self, chunk: str) -> int:
        if max(chunk) >= PLAIN_BELOW:
            return self._encoded(chunk)
        whole = self.whole
        return sum(1 if p in whole else self._merged(p) for p in PRETOKEN.findall(chunk.lower()))

    def count(self, text: str) -> int:
        """No pre-token holds white space, so that a text's count is the sum over its chunks between white space."""
        if EXTRA_SPACE.search(text) or "<|" in text and any(s in text for s in SPECIAL):
            return self._encoded(text)
        known, n = self.chunks, 0
        for chunk in text.split():
            k = known.get(chunk)
            if k is None:
                if len(known) > CACHE:
                    known.clear()
                k = known[chunk] = self._chunk(chunk)
            n += k
        return n


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = 2048
) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_tokens, over_limit``.

    Tokens are those of the library for ``vocabulary``, without special tokens added; its special
    strings inside a text count as it counts them. Null and empty texts have none; repeated rows stay;
    other columns are ignored. The proven strings (at most the vocabulary) are the only thing sent to
    the tasks; texts of any length are read once, whole, and nothing is shuffled; an empty table gives an
    empty result.
    """
    prepare(docs.sparkSession)
    spark: SparkSession = docs.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary, whole.value)
        for b in batches:
            n = [counter.count(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
