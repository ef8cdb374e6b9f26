"""Language identification of code-switched text with a linear-chain conditional random field.

Each word is labelled with a language.  Emission scores add up learned weights
of its affixes (1 to 3 bytes at both ends), its byte trigrams and, for words
of the lexicon, of the word itself; learned transition scores say how languages
follow each other.  Forward-backward gives every word's label probabilities,
and a document's language is the one with the largest expected number of words.

The model is fitted on a bounded sample of labelled rows: the first ones of each
language by a hash of their ids, at most ``PER_LANG`` and only while their texts
together are under an equal share of ``SAMPLE_BYTES`` (one at least).  Their
whole texts are used, and runs of their words are spliced to code-switched
sequences.  Prediction covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import byte_slices, lean, mix64

#: Bounds of the training sample: rows of a language, bytes of all texts.
PER_LANG, SAMPLE_BYTES = 250, 8 << 20
#: Languages that a model may have, which is checked, and cells of its feature table: its size is bounded by both.
MAX_LANGS, CELLS = 100, 1 << 22
TABLE_BITS = 17
LENGTH, SEQUENCES, EPOCHS, BATCH = 48, 4000, 6, 200
#: A word is in the lexicon if the sample holds it this often.
LEXICON_MIN = 3
CHUNK = 64
UNDETERMINED = "und"


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Words:
    """Words of some texts: document of each, feature rows, whether it has a letter."""

    doc: np.ndarray
    affixes: np.ndarray  # (words, 6) table rows, 0 for none
    trigrams: np.ndarray  # table rows of all trigrams, word by word
    counts: np.ndarray  # trigrams of each word
    name: np.ndarray  # 64-bit hash of the word
    letter: np.ndarray


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[97:123] = True
_ALPHA[128:] = True


def table_bits(langs: int) -> int:
    return min(TABLE_BITS, (CELLS // max(langs, 1)).bit_length() - 1)


def _row(code: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Table rows 1 to 2^bits - 1; row 0 stays zero."""
    salt = np.uint64(kind * 0xD6E8FEB86659FD93 % 2**64)
    mixed = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) >> np.uint64(64 - bits)
    return np.maximum(mixed, np.uint64(1)).astype(np.int32)


def words_in(offsets: np.ndarray, data: np.ndarray, bits: int = TABLE_BITS) -> Words:
    b = _LOWER[data]
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    start[inner] = word[inner]  # a document's first byte starts a word, whatever stands before it
    stop = word.copy()
    stop[:-1] &= ~word[1:] | start[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    size = e - s
    doc = np.searchsorted(offsets, s, "right") - 1
    wide = np.concatenate((b, np.zeros(3, np.uint8))).astype(np.uint32)
    three = wide[:-3] << 16 | wide[1:-2] << 8 | wide[2:-1]
    affixes = np.zeros((len(s), 6), np.int32)
    for n, code in ((1, wide[:-3]), (2, wide[:-3] << 8 | wide[1:-2]), (3, three)):
        has = size >= n
        affixes[has, n - 1] = _row(code[s[has]], n, bits)
        affixes[has, n + 2] = _row(code[e[has] - n], n + 3, bits)
    counts = np.maximum(size - 2, 0)
    total = int(counts.sum())
    at = np.arange(total) + np.repeat(s - (np.cumsum(counts) - counts), counts)
    code = three[at]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(code.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)))
    last = np.cumsum(counts)
    edge = np.minimum(size, 3)
    ends = (three[s] >> (24 - 8 * edge).astype(np.uint32)).astype(np.uint64) << np.uint64(8) | np.minimum(size, 255).astype(np.uint64)
    name = mix64(sums[last] - sums[last - counts] + mix64(ends))
    letters = np.concatenate(([0], np.cumsum(_ALPHA[b])))
    return Words(doc, affixes, _row(code, 7, bits), counts, name, letters[e] > letters[s])


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows; empty groups are 0."""
    out = np.zeros((len(counts), values.shape[1]), np.float32)
    some = counts > 0
    if len(values):
        starts = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(values, starts, axis=0)
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (2^bits, langs)
    names: np.ndarray  # sorted lexicon
    entries: np.ndarray  # (lexicon + 1, langs), the last row for words outside
    moves: np.ndarray  # (langs, langs) transition scores

    def lexicon_row(self, name: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(name), np.int64)
        at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        return np.where(self.names[at] == name, at, len(self.names))

    def emissions(self, w: Words) -> np.ndarray:
        out = _sums(self.table[w.trigrams], w.counts)
        for j in range(w.affixes.shape[1]):
            out += self.table[w.affixes[:, j]]
        return out + self.entries[self.lexicon_row(w.name)]


def forward_backward(psi: np.ndarray, moves: np.ndarray, real: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Label probabilities (n, t, l) of n sequences at once.

    ``psi``: exponentials of emissions; ``moves``: of transitions; ``real`` marks
    steps that exist (padding is at the end); ``left`` and ``right`` (n, l): what
    comes in from before and after.
    """
    n, t, size = psi.shape
    alpha = np.empty_like(psi)
    a = left
    for i in range(t):
        step = (a @ moves) * psi[:, i]
        step /= np.maximum(step.sum(axis=1, keepdims=True), 1e-30)
        a = np.where(real[:, i, None], step, a)
        alpha[:, i] = a
    b = right
    for i in range(t - 1, -1, -1):
        alpha[:, i] *= b
        step = (b * psi[:, i]) @ moves.T
        step /= np.maximum(step.sum(axis=1, keepdims=True), 1e-30)
        b = np.where(real[:, i, None], step, b)
    return alpha / np.maximum(alpha.sum(axis=2, keepdims=True), 1e-30)


def _laid_out(emissions: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, ...]:
    """(psi, real, place of each word, first chunk and number of chunks of each document): words in chunks side by side."""
    n = np.bincount(doc, minlength=n_docs)
    chunks = -(-n // CHUNK)
    total = int(chunks.sum())
    first = np.cumsum(chunks) - chunks
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = first[doc] + inside // CHUNK, inside % CHUNK
    psi = np.ones((total, CHUNK, emissions.shape[1]))
    psi[at] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    real = np.zeros((total, CHUNK), bool)
    real[at] = True
    return psi, real, at, first, chunks


def _carries(psi: np.ndarray, real: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The product of the step matrices of each chunk."""
    total, _, size = psi.shape
    carry = np.broadcast_to(np.eye(size), (total, size, size)).copy()
    for i in range(CHUNK):
        after = (carry.reshape(-1, size) @ step).reshape(total, size, size) * psi[:, i, None, :]
        after /= np.maximum(after.sum(axis=(1, 2), keepdims=True), 1e-300)
        carry = np.where(real[:, i, None, None], after, carry)
    return carry


def document_mass(
    emissions: np.ndarray, doc: np.ndarray, letter: np.ndarray, n_docs: int, moves: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None
) -> np.ndarray:
    """(documents, labels): expected numbers of words with a letter per label.

    Documents are cut to chunks; each chunk's product of step matrices carries
    messages across it, so the recursions run over all chunks side by side and a
    very long document costs no more per word than a short one.  ``before`` and
    ``after`` are the messages that come in from outside (none: from a text's ends).
    """
    size = emissions.shape[1]
    out = np.zeros((n_docs, size))
    psi, real, at, first, chunks = _laid_out(emissions, doc, n_docs)
    total = len(psi)
    if not total:
        return out
    step = np.exp(moves - moves.max())
    carry = _carries(psi, real, step)
    left, right = np.empty((total, size)), np.empty((total, size))
    left[first[chunks > 0]] = 1.0 / size if before is None else before
    lasts = (first + chunks - 1)[chunks > 0]
    right[lasts] = 1.0 if after is None else after
    for j in range(1, int(chunks.max())):
        own = first[chunks > j] + j
        a = np.einsum("nl,nlm->nm", left[own - 1], carry[own - 1])
        left[own] = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
        own = (first + chunks - 1)[chunks > j] - j
        b = np.einsum("nlm,nm->nl", carry[own + 1], right[own + 1])
        right[own] = b / np.maximum(b.sum(axis=1, keepdims=True), 1e-300)
    p = forward_backward(psi, step, real, left, right)[at] * letter[:, None]
    for c in range(size):
        out[:, c] = np.bincount(doc, weights=p[:, c], minlength=n_docs)
    return out


def piece_bytes(size: int) -> int:
    """Bytes of text whose messages are held at once: their arrays grow with words times languages, and chunks times languages squared."""
    return int(min(1 << 20, 6 * min((1 << 20) * CHUNK // size**2, (1 << 21) // size)))


def pieces_of(data: np.ndarray, limit: int) -> list[np.ndarray]:
    """A text in pieces of about ``limit`` bytes that end between words; a longer word is not divided."""
    spaces = np.flatnonzero(_SPACE[data])
    out, at = [], 0
    while len(data) - at > limit:
        i = int(np.searchsorted(spaces, at + limit))
        end = int(spaces[i]) + 1 if i < len(spaces) else len(data)
        out.append(data[at:end])
        at = end
    return [*out, data[at:]]


def long_mass(data: np.ndarray, model: Model, limit: int) -> np.ndarray:
    """:func:`document_mass` of one text of any length, piece by piece.

    A first pass keeps each piece's product of step matrices; these carry the
    messages from both ends of the text to both ends of each piece, and a
    second pass counts inside them.  Besides one piece, a matrix a piece is held.
    """
    size, bits = len(model.langs), table_bits(len(model.langs))
    step = np.exp(model.moves - model.moves.max())
    pieces, across = pieces_of(data, limit), []

    def words(piece: np.ndarray) -> Words:
        return words_in(np.array([0, len(piece)]), piece, bits)

    for piece in pieces:
        w = words(piece)
        psi, real, *_ = _laid_out(model.emissions(w), w.doc, 1)
        whole = np.eye(size)
        for carry in _carries(psi, real, step):
            whole = whole @ carry
            whole /= np.maximum(whole.sum(), 1e-300)
        across.append(whole)
    left, right = [np.full(size, 1.0 / size)], [np.ones(size)]
    for one, other in zip(across[:-1], across[:0:-1], strict=True):
        a, b = left[-1] @ one, other @ right[-1]
        left.append(a / np.maximum(a.sum(), 1e-300))
        right.append(b / np.maximum(b.sum(), 1e-300))
    out = np.zeros((1, size))
    for piece, before, after in zip(pieces, left, right[::-1], strict=True):
        w = words(piece)
        out += document_mass(model.emissions(w), w.doc, w.letter, 1, model.moves, before, after)
    return out


def fit(pieces: list[tuple[str, str]], seed: int = 6) -> Model:
    """The model from (language, piece of text) pairs, by stochastic gradients on spliced sequences."""
    langs = sorted({lang for lang, _ in pieces})
    size = len(langs)
    rng = np.random.default_rng(seed)
    index = {lang: i for i, lang in enumerate(langs)}
    pieces = sorted(pieces)
    raw, bits = [t.encode("utf-8", "surrogatepass") for _, t in pieces], table_bits(size)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    w = words_in(offsets, np.frombuffer(b"".join(raw), np.uint8), bits)
    label = np.array([index[lang] for lang, _ in pieces])[w.doc]
    names, counts = np.unique(w.name, return_counts=True)
    names = names[counts >= LEXICON_MIN]
    model = Model(langs, np.zeros((2**bits, size), np.float32), names, np.zeros((len(names) + 1, size), np.float32), np.zeros((size, size)))
    lexicon = model.lexicon_row(w.name)
    begin = np.cumsum(w.counts) - w.counts
    by_lang = [own for i in range(size) if len(own := np.flatnonzero(label == i))]
    if not by_lang:
        return model
    squares, squares_e, squares_m = np.full_like(model.table, 1e-6), np.full_like(model.entries, 1e-6), np.full((size, size), 1e-6)
    for _ in range(EPOCHS):
        for _ in range(SEQUENCES // BATCH):
            # splice: runs of 4 to 28 words of one language follow each other
            seq = np.empty((BATCH, LENGTH), np.int64)
            for i in range(BATCH):
                got = 0
                while got < LENGTH:
                    run, own = min(int(rng.integers(4, 29)), LENGTH - got), by_lang[rng.integers(len(by_lang))]
                    at = int(rng.integers(max(1, len(own) - run)))
                    part = own[at : at + run]
                    seq[i, got : got + len(part)] = part
                    got += len(part)
            words = seq.reshape(-1)
            n = w.counts[words]
            flat = w.trigrams[np.arange(int(n.sum())) + np.repeat(begin[words] - (np.cumsum(n) - n), n)]
            scores = _sums(model.table[flat], n) + model.table[w.affixes[words]].sum(axis=1) + model.entries[lexicon[words]]
            y = label[words].reshape(BATCH, LENGTH)
            psi = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(BATCH, LENGTH, size).astype(np.float64)
            step = np.exp(model.moves)
            real = np.ones((BATCH, LENGTH), bool)
            p = forward_backward(psi, step, real, np.full((BATCH, size), 1.0 / size), np.ones((BATCH, size)))
            pairs = _pair_counts(psi, step, size)
            seen = np.zeros((size, size))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
            residual = -p.reshape(-1, size)
            residual[np.arange(len(words)), label[words]] += 1.0
            rows = np.concatenate((flat, w.affixes[words].T.ravel()))
            value = np.concatenate((np.repeat(residual, n, axis=0), np.tile(residual, (6, 1))))
            grad = np.stack([np.bincount(rows, weights=value[:, c], minlength=2**bits) for c in range(size)], axis=1)
            grad[0] = 0.0
            grad_e = np.stack([np.bincount(lexicon[words], weights=residual[:, c], minlength=len(names) + 1) for c in range(size)], axis=1)
            grad_e[-1] = 0.0
            for target, total, g in ((model.table, squares, grad), (model.entries, squares_e, grad_e), (model.moves, squares_m, seen - pairs)):
                total += g * g
                target += (0.1 * g / np.sqrt(total)).astype(target.dtype)
    return model


def _pair_counts(psi: np.ndarray, step: np.ndarray, size: int) -> np.ndarray:
    """Expected numbers of neighbouring label pairs over all sequences."""
    n, t, _ = psi.shape
    alpha, beta = np.empty_like(psi), np.empty_like(psi)
    a = np.full((n, size), 1.0 / size)
    for i in range(t):
        a = (a @ step) * psi[:, i]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, i] = a
    b = np.ones((n, size))
    for i in range(t - 1, -1, -1):
        beta[:, i] = b
        b = (b * psi[:, i]) @ step.T
        b /= b.sum(axis=1, keepdims=True)
    joint = alpha[:, :-1, :, None] * step * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
    return (joint / joint.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))


def training_texts(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, whole text) pairs of the bounded sample, as many and as long as the module's bounds allow."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    langs = rows.select("lang").distinct().limit(MAX_LANGS + 1).count()
    if langs > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages: give coarser labels")
    own = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    order = Window.partitionBy("lang").orderBy(own, "_bytes")
    ranked = rows.select("doc_id", "lang", F.octet_length("text").alias("_bytes")).withColumn("_n", F.row_number().over(order))
    first = ranked.filter(F.col("_n") <= PER_LANG)
    first = first.withColumn("_upto", F.sum("_bytes").over(Window.partitionBy("lang").orderBy("_n")))
    first = first.filter((F.col("_n") == 1) | (F.col("_upto") <= SAMPLE_BYTES // max(langs, 1)))
    chosen = first.select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), F.col("_bytes").alias("_b")).distinct()
    # at most PER_LANG rows for each of at most MAX_LANGS languages
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("lang") == F.col("_l")) & (F.octet_length("text") == F.col("_b"))
    sample = rows.join(F.broadcast(chosen), same, "left_semi")
    # rows that repeat id, language and length would be more than was ranked
    texts = sample.select("lang", "text").distinct().orderBy("lang", F.md5("text"), "text").limit(PER_LANG * max(langs, 1))
    return [(r[0], r[1]) for r in texts.collect() if r[1].strip()]


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score, n_langs) of every row.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if no language was learned; ``score`` is the expected share of the
    predicted language's words; ``n_langs`` counts languages with an expected
    tenth of the words or more.  Repeated rows repeat; null ids are kept; no rows
    give an empty result.  Ids may be of any type.  Over ``MAX_LANGS`` languages
    are an error.
    """
    if model is None:
        pieces = training_texts(docs)
        model = fit(pieces) if pieces else None
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            pred, score = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            several = np.zeros(batch.num_rows, np.int64)
            texts = batch.column(2)
            if m is not None:
                limit = piece_bytes(len(m.langs))
                for first, offsets, data in byte_slices(texts, limit):
                    if len(data) > limit:  # one long text
                        mass = long_mass(data, m, limit)
                    else:
                        w = words_in(offsets, data, table_bits(len(m.langs)))
                        mass = document_mass(m.emissions(w), w.doc, w.letter, len(offsets) - 1, m.moves)
                    total = mass.sum(axis=1)
                    best = mass.argmax(axis=1)
                    for i in np.flatnonzero(total > 0).tolist():
                        text = texts[first + i].as_py()
                        if any(map(str.isalpha, text)):
                            pred[first + i] = m.langs[best[i]]
                            score[first + i] = min(1.0, mass[i, best[i]] / total[i])
                            several[first + i] = int((mass[i] >= 0.1 * total[i]).sum())
            arrays = [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(several)]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "held_out", "lang_pred", "score", "n_langs"])

    rows = docs.select(id_col, held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, n_langs long")


def op6_language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_langs) of every document."""
    return identify(docs)
