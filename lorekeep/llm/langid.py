"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary, estimated by expectation-maximisation over
all segmentations of its training words. A word's probability is the sum over all its segmentations, by a forward
recursion that runs over many words at once; a text's score is the sum over its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import crc_mod, slices, texts_of, tokens

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of each language to learn from, about, by a hash of doc_id.
SAMPLE = 300
ROUNDS = 6
#: Longer pieces are not used; longer words are scored in consecutive parts of WORD letters.
PIECE, WORD = 10, 32
#: The probability of a letter by itself besides the vocabulary: no word is impossible.
LETTER = 1e-7
BASE = np.uint64(1_099_511_628_211)
MARK = "▁"


def pieces_of(path: str = VOCABULARY) -> list[str]:
    """The pieces of a sentencepiece model that can be part of lower-case words; only the driver reads the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    all_pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in all_pieces if len(p) <= PIECE and p == p.lower() and (p == MARK or p.removeprefix(MARK).isalpha())})


class Pieces:
    """Finds the pieces at every place of many words by hashing."""

    def __init__(self, pieces: list[str]):
        self.count = len(pieces)
        keys = np.array([_hash_all(np.frombuffer(p.encode("utf-32-le"), np.uint32), len(p))[0] for p in pieces], np.uint64)
        left, self.tables = np.arange(len(pieces)), []
        for k in range(64):  # whoever finds its place taken goes to the next, differently mixed, table
            if not len(left):
                break
            mix = np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x51_7CC1_B727_2205)
            place = ((keys[left] * mix) >> np.uint64(45)).astype(np.int64)
            _, first = np.unique(place, return_index=True)
            of, key = np.full(1 << 19, -1, np.int32), np.zeros(1 << 19, np.uint64)
            of[place[first]], key[place[first]] = left[first], keys[left[first]]
            self.tables.append((mix, of, key))
            left = np.delete(left, first)

    def find(self, chars: np.ndarray, length: int) -> np.ndarray:
        """The piece of `length` letters at each place that has as many, or -1."""
        h = _hash_all(chars, length)
        out = np.full(len(h), -1, np.int32)
        for mix, of, key in self.tables:
            place = ((h * mix) >> np.uint64(45)).astype(np.int64)
            hit = (key[place] == h) & (of[place] >= 0)
            out[hit] = of[place[hit]]
        return out


def _hash_all(chars: np.ndarray, length: int) -> np.ndarray:
    n = max(0, len(chars) - length + 1)
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = (h ^ chars[k : k + n].astype(np.uint64)) * BASE
    return h


def lattices(words: list[str], pieces: Pieces):
    """Groups of words of equal length: (their places, piece ids [word, end, length - 1], with -1 for none)."""
    text = "".join(MARK + w for w in words)
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    found = [pieces.find(chars, k) for k in range(1, PIECE + 1)]
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        for a in range(0, len(at), 8192):
            part = at[a : a + 8192]
            ids = np.full((len(part), n + 1, PIECE), -1, np.int32)
            for k in range(1, min(n, PIECE) + 1):
                for j in range(k, n + 1):
                    ids[:, j, k - 1] = found[k - 1][start[part] + j - k]
            yield part, ids


def _steps(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability [word, end, length - 1, language] of the piece that ends there; p's last row is that of no piece."""
    out = p[ids]
    out[:, 1:, 0] += LETTER
    return out


def forward(step: np.ndarray) -> np.ndarray:
    n = step.shape[1] - 1
    alpha = np.zeros((step.shape[0], n + 1, step.shape[3]))
    alpha[:, 0] = 1
    for j in range(1, n + 1):
        for k in range(1, min(j, PIECE) + 1):
            alpha[:, j] += alpha[:, j - k] * step[:, j, k - 1]
    return alpha


def learn(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, probability [piece or none, language]) from the word counts of each language."""
    index, columns = Pieces(pieces), []
    languages = sorted(counts)
    for language in languages:
        words = sorted(counts[language])
        weight = np.array([counts[language][w] for w in words], float)
        p = np.append(np.full(len(pieces), 1 / max(1, len(pieces))), 0.0)
        groups = list(lattices(words, index))
        for _ in range(rounds):
            expected = np.zeros(len(pieces) + 1)
            for at, ids in groups:
                step = _steps(ids, p[:, None])
                alpha, n = forward(step), ids.shape[1] - 1
                beta = np.zeros_like(alpha)
                beta[:, n] = 1
                for j in range(n, 0, -1):
                    for k in range(1, min(j, PIECE) + 1):
                        beta[:, j - k] += beta[:, j] * step[:, j, k - 1]
                scale = weight[at] / np.maximum(alpha[:, n, 0], 1e-300)
                for j in range(1, n + 1):
                    for k in range(1, min(j, PIECE) + 1):
                        use = scale * alpha[:, j - k, 0] * p[ids[:, j, k - 1]] * beta[:, j, 0]
                        expected += np.bincount(ids[:, j, k - 1] % (len(pieces) + 1), use, len(pieces) + 1)
            p = (expected + 0.01) / (expected[:-1].sum() + 0.01 * len(pieces))
            p[-1] = 0.0
        columns.append(p)
    return languages, np.stack(columns, axis=1) if columns else np.zeros((len(pieces) + 1, 0))


def words_of(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(place of each word among the different ones, those, words of each text); words are runs of letters, lower-cased."""
    flat, counts = tokens(pc.replace_substring_regex(pc.utf8_lower(texts_of(column)), r"[^\p{L}]+", " "))
    long = pc.greater(pc.utf8_length(flat), WORD)
    if pc.any(long).as_py():
        row = np.repeat(np.arange(len(counts)), counts)
        parts = [[w[a : a + WORD] for a in range(0, len(w), WORD)] for w in flat.to_pylist()]
        size = np.array([len(x) for x in parts])
        counts = np.bincount(row, size, len(counts)).astype(np.int64)
        flat = pa.array([w for x in parts for w in x], pa.string())
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist(), counts


def _counter(batches):
    for b in slices(batches, text=0):
        for language in pc.unique(b.column(1)).to_pylist():
            ids, words, _ = words_of(b.column(0).filter(pc.equal(b.column(1), language)))
            n = np.bincount(ids, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(n.astype(np.int64))], ["lang", "word", "n"])


class Model:
    def __init__(self, languages: list[str], p: np.ndarray, pieces: list[str]):
        self.languages, self.p, self.pieces = languages, p, pieces
        self.index: Pieces | None = None

    def __getstate__(self):
        return self.languages, self.p, self.pieces

    def __setstate__(self, state):
        self.__init__(*state)

    def words(self, words: list[str]) -> np.ndarray:
        """The log probability of each word in each language."""
        self.index = self.index or Pieces(self.pieces)
        out = np.zeros((len(words), len(self.languages)))
        for at, ids in lattices(words, self.index):
            out[at] = np.log(np.maximum(forward(_steps(ids, self.p))[:, -1], 1e-300))
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        ids, words, counts = words_of(column)
        if not self.languages:
            return ["und"] * len(counts), np.zeros(len(counts))
        each = self.words(words)
        row = np.repeat(np.arange(len(counts)), counts)
        total = np.stack([np.bincount(row, each[ids, k] if len(ids) else None, len(counts)) for k in range(len(self.languages))], axis=1)
        best = total.argmax(axis=1)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share = share[np.arange(len(best)), best] / share.sum(axis=1)
        none = counts == 0
        return ["und" if e else self.languages[k] for e, k in zip(none.tolist(), best.tolist(), strict=True)], np.where(none, 0.0, share)


def fitted(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of documents whose crc32 of doc_id mod 3 is not 1: of each language about `sample`, by a hash of doc_id."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").filter(crc_mod("doc_id", 3) != 1)
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    share = F.lit(None)
    for language, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == language, spread <= int(1_000_003 * min(1.0, sample / n))).otherwise(share)
    counts: dict[str, dict[str, int]] = {language: {} for language in sizes}
    if sizes:
        rows = known.filter(share).select("text", "lang").mapInArrow(_counter, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        for language, word, n in rows.collect():  # the words of the bounded sample
            counts[language][word] = n
    pieces = pieces_of(path)
    return Model(*learn(counts, pieces), pieces)


def _predictor(model: Model):
    def run(batches):
        for b in slices(batches):
            language, score = model.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(language, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest learned language and its share of the likelihood, 0 to 1.

    A null text or one without a letter is `und` with score 0; so is every text where nothing was learned. Ties go to
    the first language by name. Repeated rows keep a row each; extra columns are ignored; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double")
