"""Language identification by unigram pieces, summed over all segmentations of a word."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import prepare

VOCABULARY = "piece_bpe_32k.model"

#: Letters in the sense of Unicode, which number signs such as Roman numerals are not.
LETTERS = regex.compile(r"\p{L}+")
#: Longest piece used, and the length at which longer words are cut into several, in characters.
PIECE_CHARS, WORD_CHARS = 8, 24
#: Probability of a character that no piece covers.
UNKNOWN = 1e-8
#: Marks the beginning of a word in the vocabulary.
START = "▁"
#: A worker scores texts together until they have so many words, and forgets its words beyond so many.
CHUNK, CACHE = 200_000, 300_000

BASE, TWIST = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def vocabulary_pieces(vocabulary: str) -> list[str]:
    """The lower-case pieces of letters, with or without the mark of a word's beginning, up to ``PIECE_CHARS``."""
    import os

    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    sp = SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if len(p) <= PIECE_CHARS and p == p.lower() and LETTERS.fullmatch(p.removeprefix(START) or "a"))


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each with the mark of its beginning, as (n, longest) and the lengths."""
    marked = np.array([START + w for w in words], dtype=f"U{WORD_CHARS + 1}")
    grid = marked.view(np.uint32).reshape(len(words), -1)
    n = (grid > 0).sum(axis=1)
    return grid[:, : n.max()], n


def spans(grid: np.ndarray) -> list[np.ndarray]:
    """For each length from 1, hashes of the substrings that begin at each place."""
    out, h = [], np.zeros(grid.shape, np.uint64)
    for k in range(min(PIECE_CHARS, grid.shape[1])):
        h = (h[:, : grid.shape[1] - k] * BASE + grid[:, k:].astype(np.uint64) + np.uint64(1)) * TWIST
        out.append(h)
    return out


class PieceModel:
    """Piece probabilities per language, and the forward sums of words."""

    def __init__(self, languages: list[str], pieces: list[str]) -> None:
        self.languages = languages
        grid = np.array(pieces, dtype=f"U{PIECE_CHARS}").view(np.uint32).reshape(len(pieces), -1)
        size = (grid > 0).sum(axis=1)
        keys = np.zeros(len(pieces), np.uint64)
        for k, h in enumerate(spans(grid)):
            keys[size == k + 1] = h[size == k + 1, 0]
        order = np.argsort(keys)
        self.keys = keys[order]
        # The last row is for what is no piece.
        self.p = np.vstack([np.full((len(pieces), len(languages)), 1.0 / len(pieces)), np.zeros(len(languages))])

    def lookup(self, grid: np.ndarray) -> list[np.ndarray]:
        found = []
        for k, h in enumerate(spans(grid)):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            at[self.keys[at] != h] = len(self.keys)
            found.append(at)
            if k == 0:
                self.single = at == len(self.keys)
        return found

    def _step(self, found: list[np.ndarray], i: int, k: int) -> np.ndarray:
        p = self.p[found[k][:, i]]
        if k == 0:
            p = np.maximum(p, UNKNOWN)
        return p

    def forward(self, found: list[np.ndarray], length: int, rows: int) -> np.ndarray:
        """(place, word, language): probability of all segmentations of what stands before the place."""
        a = np.zeros((length + 1, rows, len(self.languages)))
        a[0] = 1
        for j in range(1, length + 1):
            for k in range(min(j, len(found))):
                a[j] += a[j - 1 - k] * self._step(found, j - 1 - k, k)
        return a

    def log_words(self, words: list[str]) -> np.ndarray:
        """(word, language) log-probabilities."""
        grid, n = codes(words)
        a = self.forward(self.lookup(grid), grid.shape[1], len(words))
        return np.log(np.maximum(a[n, np.arange(len(words))], 1e-300))

    def expected(self, words: list[str], weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece; ``weight`` is (word, language)."""
        grid, n = codes(words)
        found, longest = self.lookup(grid), grid.shape[1]
        a = self.forward(found, longest, len(words))
        b = np.zeros_like(a)
        b[n, np.arange(len(words))] = 1
        out = np.zeros_like(self.p)
        scale = weight / np.maximum(a[n, np.arange(len(words))], 1e-300)
        for i in range(longest - 1, -1, -1):
            for k in range(min(longest - i, len(found))):
                step = self._step(found, i, k) * b[i + 1 + k]
                b[i] += step
                use = a[i] * step * scale
                for g in range(out.shape[1]):
                    out[:, g] += np.bincount(found[k][:, i], use[:, g], len(out))
        return out

    def fit(self, words: list[str], counts: np.ndarray, rounds: int, block: int = 10_000) -> None:
        for _ in range(rounds):
            total = np.zeros_like(self.p)
            for at in range(0, len(words), block):
                total += self.expected(words[at : at + block], counts[at : at + block])
            total[-1] = 0
            self.p[:-1] = (total[:-1] + 1e-3) / (total[:-1] + 1e-3).sum(axis=0)


def cut_words(text: str) -> list[str]:
    """Lower-case letter runs of a text, those beyond ``WORD_CHARS`` in several."""
    words = LETTERS.findall(text.lower())
    if words and max(map(len, words)) > WORD_CHARS:
        words = [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]
    return words


def train(docs: DataFrame, text_col: str, lang_col: str, learn: Column, vocabulary: str, per_language: int, rounds: int, seed_cols: list[str]) -> PieceModel:
    """Fit on a sample of about ``per_language`` rows of each language, drawn by a hash of the row's id."""
    known = docs.where(learn & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    pieces = vocabulary_pieces(vocabulary)
    model = PieceModel(languages or ["und"], pieces)
    if not languages:
        return model
    share = F.create_map(*[x for g in languages for x in (F.lit(g), F.lit(per_language / sizes[g]))])
    draw = F.pmod(F.xxhash64(*seed_cols), F.lit(1 << 20)) / float(1 << 20) < share[F.col(lang_col)]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, word = [], []
            for g, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = cut_words(t.as_py())
                lang += [g] * len(found)
                word += found
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string())], ["lang", "word"])

    sample = known.where(draw & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = sample.mapInArrow(words, "lang string, word string").groupBy("lang", "word").count().toPandas()
    if len(counted):
        wide = counted.pivot(index="word", columns="lang", values="count").reindex(columns=languages).fillna(0.0).sort_index()
        model.fit(wide.index.tolist(), wide.to_numpy(), rounds)
    return model


def identify_languages(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary: str = VOCABULARY,
    per_language: int = 400,
    rounds: int = 3,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per input row: ``id_col``, the columns ``keep``, ``lang_pred`` and ``score``.

    The model learns from text and language of rows where ``learn`` holds and the language is not null:
    about ``per_language`` rows of each (drawn by a hash of the id), whose distinct words reach the
    driver. Piece probabilities over the fixed vocabulary start even and are fitted by ``rounds`` of
    expectation maximisation over all segmentations. A text's score of a language is the product over
    its words of the sum over all segmentations of each; ``score`` is the posterior of the best language
    under even priors, ties going to the first by name. Null texts and texts without a letter give
    ``und`` and 0; so do all texts where there is nothing to learn from. Whole texts are scored, once,
    without a shuffle, however long they are; repeated rows stay; other columns are ignored, whatever
    their names, and those in ``keep`` passed on; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    model = train(docs, text_col, lang_col, learn, vocabulary, per_language, rounds, [id_col])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    extra = list(keep or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        place: dict[str, int] = {}
        table = np.zeros((0, len(m.languages)))
        for b in batches:
            at, ids, ends = 0, [], []
            for i, t in enumerate(b.column(b.num_columns - 1)):
                for w in cut_words(t.as_py() or ""):
                    ids.append(place.setdefault(w, len(place)))
                ends.append(len(ids))
                if len(ids) < CHUNK and i + 1 < b.num_rows:
                    continue
                fresh = list(itertools.islice(place, len(table), None))
                table = np.concatenate([table] + [m.log_words(fresh[k : k + 10_000]) for k in range(0, len(fresh), 10_000)])
                used = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[np.array(ids, np.int64)], axis=0)])
                total = np.diff(used[[0, *ends]], axis=0)
                rel = np.exp(total - total.max(axis=1, keepdims=True))
                some = np.diff([0, *ends]) > 0
                lang = [m.languages[g] if s else "und" for g, s in zip(total.argmax(axis=1), some, strict=True)]
                score = np.where([x != "und" for x in lang], 1 / rel.sum(axis=1), 0.0)
                part = b.slice(at, len(ends))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(b.num_columns - 1)), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    [*b.schema.names[:-1], "lang_pred", "score"],
                )
                at, ids, ends = i + 1, [], []
                if len(place) > CACHE:
                    place, table = {}, table[:0]

    kinds = dict(docs.dtypes)
    rows = docs.select(id_col, *extra, F.col(text_col).cast("string").alias("text to score"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [id_col, *extra]) + ", lang_pred string, score double"
    return rows.mapInArrow(run, schema)
