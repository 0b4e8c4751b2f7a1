"""Language identification by words first, then ever shorter character n-grams.

Model: for each language the log frequency of every word learned, and of every character n-gram
(n = 5 ... 1) of these words, a word being framed by ``_``. A known word scores by its own log frequency. An unseen word
scores by the mean log frequency of its known n-grams of the greatest length of which any is known. A text scores by
the sum over its words; the winner's share after normalisation is the score. A word is a letter with the letters and marks
that follow it, in lower case; learning and predicting cut words by the same function.

Fitting is counted by Spark on a bounded sample of labelled documents (about ``sample_docs``, those of smallest hash of
their id, whole texts). All their words and n-grams are kept, so the model is as large as the sample's vocabulary, and no larger
when the corpus grows. It is collected and broadcast. Scoring is one Arrow pass without a shuffle; workers keep a bounded memo of words.

Edge cases: NULL, empty and letter-free texts are ``und`` with score 0; so is everything if nothing was learned (an empty table,
no labelled row). Equal scores: the first language by code point. Rows are independent, so repeated rows get equal answers. Texts of any
length count whole. Other columns are kept; columns of the outputs' names are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.session import written

LONGEST = 5
UNKNOWN = "und"
SMOOTH = 0.1
MEMO_SIZE = 300_000
FLUSH_WORDS = 200_000
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


@dataclass(frozen=True)
class Model:
    """Languages in code-point order; per word and n-gram a row of log frequencies."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_rows: np.ndarray
    gram_rows: np.ndarray


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to word counts, summed per task up to ``FLUSH_WORDS`` words."""
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "item", "n"])
        counts.clear()
        return out

    for batch in batches:
        for lang, text in zip(*batch.columns, strict=True):
            lang = lang.as_py()
            for word, n in Counter(words_of(text.as_py())).items():
                counts[lang, word] += n
            if len(counts) > FLUSH_WORDS:
                yield rows()
    yield rows()


def _log_rows(counted: pa.Table, langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Rows (lang, item, n), one per pair, to the items' places and their log frequencies."""
    items = counted["item"].combine_chunks().dictionary_encode()
    counts = np.zeros((len(items.dictionary), len(langs)))
    of_lang = pc.index_in(counted["lang"], pa.array(langs, pa.string()))
    counts[np.asarray(items.indices), np.asarray(of_lang)] = np.asarray(counted["n"])
    sizes = counts.sum(axis=0) + SMOOTH * (len(counts) + 1)
    return {w: i for i, w in enumerate(items.dictionary.to_pylist())}, np.log((counts + SMOOTH) / sizes).astype(np.float32)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = 5_000) -> Model:
    """Learn from ``labelled`` rows (NULL texts and languages are left out)."""
    usable = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    n = usable.count()
    share = min(1.0, sample_docs / max(n, 1))
    order = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("lang")), F.lit(1 << 30))
    sample = usable.filter(order < int(share * (1 << 30))) if share < 1 else usable
    found = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_count, "lang string, item string, n long")
    words = written(found.groupBy("lang", "item").agg(F.sum("n").alias("n")), "lang-words")
    framed = F.concat(F.lit("_"), "item", F.lit("_"))

    def cut(k: int) -> Column:
        # (A second parameter of the lambda would be the place in the array.)
        every = F.transform(F.sequence(F.lit(1), F.length(framed) - k + 1), lambda i: F.substring(framed, i, F.lit(k)))
        return F.when(F.length(framed) >= k, every).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[cut(k) for k in range(1, LONGEST + 1)]))
    counted = words.select("lang", "n", F.explode(grams).alias("item")).groupBy("lang", "item").agg(F.sum("n").alias("n")).toArrow()
    known = words.toArrow()
    langs = sorted(pc.unique(known["lang"]).to_pylist())
    word_at, word_rows = _log_rows(known, langs)
    gram_at: dict[str, int] = {}
    gram_rows = [np.zeros((0, len(langs)), np.float32)]
    length = pc.utf8_length(counted["item"])
    for k in range(1, LONGEST + 1):
        at, rows = _log_rows(counted.filter(pc.equal(length, k)), langs)
        base = len(gram_at)
        gram_at.update({g: base + i for g, i in at.items()})
        gram_rows.append(rows)
    return Model(langs, word_at, gram_at, word_rows, np.concatenate(gram_rows))


class _Scorer(dict):
    """word -> row of scores; unseen words are worked out once and remembered."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.unseen = model, []
        self.gram_rows = np.concatenate((model.gram_rows, np.zeros((1, len(model.langs)), np.float32)))
        self.table = np.concatenate((model.word_rows, np.zeros((1024, len(model.langs)), np.float32)))

    def _known_grams(self, word: str) -> list[int]:
        """Of the greatest length at which the word has known n-grams, their rows (behind all others: no evidence)."""
        framed, get = f"_{word}_", self.model.grams.get
        for k in range(min(LONGEST, len(framed)), 0, -1):
            hits = [i for i in map(get, [framed[j:j + k] for j in range(len(framed) - k + 1)]) if i is not None]
            if hits:
                return hits
        return [-1]

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.unseen.append(self._known_grams(word))
        return at

    def _work_out(self) -> None:
        """Fill in the rows of the words that ``__missing__`` has numbered."""
        n, done = len(self.unseen), len(self) - len(self.unseen)
        if len(self) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros((len(self.table) // 2 + n, self.table.shape[1]), np.float32)))
        sizes = np.fromiter(map(len, self.unseen), np.int64, n)
        flat = np.fromiter((i for hits in self.unseen for i in hits), np.int64, int(sizes.sum()))
        self.table[done:done + n] = np.add.reduceat(self.gram_rows[flat], np.cumsum(sizes) - sizes) / sizes[:, None]
        self.unseen.clear()

    def trim(self) -> None:
        if len(self) > len(self.model.words) + MEMO_SIZE:
            self.clear()
            self.update(self.model.words)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not counts or not self.model.langs:
            return UNKNOWN, 0.0
        n = len(counts)
        at = np.fromiter(map(self.__getitem__, counts), np.int64, n)
        if self.unseen:
            self._work_out()
        total = np.fromiter(counts.values(), np.float32, n) @ self.table[at]
        best = int(total.argmax())
        return self.model.langs[best], 1.0 / float(np.exp(np.clip(total - total[best], -700, 0)).sum())


_worker: dict[str, _Scorer] = {}


def predict(df: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``df`` with the predicted language and its score in place of ``text``."""
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = T.StructType([f for f in df.schema if f.name not in (text, lang_out, score_out)] + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _worker:
            _worker.clear()
            _worker[key] = _Scorer(shared.value)
        scorer = _worker[key]
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = []
            for x in batch.column(at):
                found.append(scorer.predict(x.as_py()))
                scorer.trim()
            keep = [i for i in range(batch.num_columns) if batch.schema.field(i).name not in (text, lang_out, score_out)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                names=[batch.schema.field(i).name for i in keep] + [lang_out, score_out])

    return df.mapInArrow(run, schema)


def held_out(key: Column, folds: int = 5, fold: int = 0) -> Column:
    """Is a row in the fold that is kept from learning? (crc32 of the id as text, modulo)"""
    return F.crc32(key.cast("string")) % folds == fold
