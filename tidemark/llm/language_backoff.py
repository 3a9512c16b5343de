"""Language ID (operator 4): word-first backoff.

A word known from training scores by its per-language log frequency.  An unseen word is
read left to right: at each position the longest known character n-gram (4, 3, 2, then 1
characters, with word borders marked) gives its per-language log frequency.  A text adds up
the scores of its words and the language priors; the posterior of the best language is the
score.

Training counts words and n-grams of labelled documents in Spark (partial counts per Arrow
batch, summed after a shuffle).  It uses at most about ``docs_per_lang`` documents of each of
the ``max_langs`` most frequent languages, chosen by a hash of the id: that bound on labelled
rows is the only one.  Every word and n-gram of those documents is kept.

Scoring works in whole batches: each distinct chunk of text is cut into words once, each
distinct word is looked up once, and the n-grams of all unseen words of a batch are added up
by one sum over row numbers.  The memos of a worker are bounded by entries and bytes.

A text that is null or has no letter gets ``und`` and score 0, and so does every text if
there is nothing to learn from.  Languages are tied in alphabetical order.  Texts are read
whole; a very long one is cut at its white space.  Repeated rows give equal rows; an empty
table gives an empty result.  Only the named columns are read, so others may have any name."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import (
    INTERNER_BYTES, Interner, claim, map_arrow, raw_texts, slices, table)

DOCS_PER_LANG = 2_000
MAX_LANGS = 1_000
ORDER = 4
SMOOTHING = 0.5
SAMPLE_STEPS = 1 << 30
#: Entries of each of a worker's two memos (chunks and words): an entry takes some 200 bytes beside its key.
MEMO_ENTRIES = 250_000
UNDETERMINED = "und"

_LETTERS = regex.compile(r"\p{L}+")


def letter_runs(text: bytes | None) -> list[str]:
    return _LETTERS.findall(text.decode("utf-8", "replace").lower()) if text else []


def _words(chunk: bytes) -> list[str]:
    """Letter runs of a chunk; most chunks are one word of ASCII letters."""
    return [chunk.decode("ascii").lower()] if chunk.isalpha() else letter_runs(chunk)


class Model:
    """Log frequencies, a column per language.  The entry of a word or n-gram has the row of its
    place in ``word_list`` or ``gram_list``; the logs of a gram of k characters, which overlaps
    k - 1 others, are divided by k.  The driver and the broadcast hold flat arrays; a worker
    builds its dictionaries when it first scores."""

    def __init__(self, langs: list[str], prior: np.ndarray, word_list: pa.Array, word_logs: np.ndarray,
                 gram_list: pa.Array, gram_logs: np.ndarray) -> None:
        self.key, self.langs, self.prior = uuid.uuid4().hex, langs, prior
        self.word_list, self.word_logs, self.gram_list, self.gram_logs = word_list, word_logs, gram_list, gram_logs

    @cached_property
    def words(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.word_list.to_pylist())}

    @cached_property
    def grams(self) -> dict[str, int]:
        return {g: i for i, g in enumerate(self.gram_list.to_pylist())}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "grams")}

    def backoff(self, word: str) -> list[int]:
        """Rows of the longest known n-grams of a word, read left to right."""
        rows, marked, known = [], f"^{word}$", self.grams.get
        for i in range(len(marked)):
            for k in range(ORDER, 0, -1):
                row = known(marked[i:i + k])
                if row is not None:
                    rows.append(row)
                    break
        return rows

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        rows = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        unseen = np.flatnonzero(rows < 0)
        if not len(self.word_logs):
            out = np.zeros((len(words), len(self.langs)))
        else:
            out = self.word_logs[rows]
            out[unseen] = 0.0
        return _add_rows(out, unseen, [self.backoff(words[i]) for i in unseen.tolist()], self.gram_logs)


def _add_rows(out: np.ndarray, at: np.ndarray, lists: list[list[int]], source: np.ndarray) -> np.ndarray:
    """Add the sum of the rows in ``lists[j]`` of ``source`` to ``out[at[j]]``, as one summation."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    some = sizes > 0
    if some.any():
        flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
        out[at[some]] += np.add.reduceat(source[flat], (np.cumsum(sizes) - sizes)[some])
    return out


class Memo(Interner):
    """key -> row of scores, for the keys met so far."""

    def __init__(self, columns: int) -> None:
        super().__init__()
        self.rows = np.zeros((1024, columns))

    def take(self) -> tuple[list, int]:
        """The new keys and the number of the first; there is a row for each of them."""
        todo, self.todo = self.todo, []
        if len(self) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((len(self), self.rows.shape[1]))])
        return todo, len(self) - len(todo)

    def full(self) -> bool:
        return len(self) > MEMO_ENTRIES or self.nbytes > INTERNER_BYTES


class Scorer:
    """Scores texts by their chunks: each distinct chunk, and each distinct word, once per worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.index, self.words = Memo(len(self.model.langs) + 1), Memo(len(self.model.langs))

    def _learn(self) -> None:
        chunks, start = self.index.take()
        met = [list(map(self.words.__getitem__, _words(c))) for c in chunks]
        words, first = self.words.take()
        if words:
            self.words.rows[first:first + len(words)] = self.model.score_words(words)
        at = np.arange(start, start + len(chunks))
        self.index.rows[at, :-1] = _add_rows(np.zeros((len(chunks), len(self.model.langs))), at - start, met, self.words.rows)
        self.index.rows[at, -1] = list(map(len, met))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], np.zeros(len(texts))
        for a, b in slices(texts):
            if self.index.full() or self.words.full():
                self.reset()
            look, met = self.index.__getitem__, []
            for t in texts[a:b]:
                chunks = t.split() if t else []
                met.append(np.fromiter(map(look, chunks), np.int64, len(chunks)))
            self._learn()
            for i, at in enumerate(met, a):
                total = self.index.rows[at].sum(axis=0)
                if not total[-1] or not self.model.langs:
                    langs.append(UNDETERMINED)
                    continue
                weight = total[:-1] + self.model.prior
                weight = np.exp(weight - weight.max())
                best = int(weight.argmax())
                langs.append(self.model.langs[best])
                scores[i] = weight[best] / weight.sum()
        return langs, scores


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, gram, n): words (kind 0) and n-grams (kind = characters) of each batch."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for text, lang in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(letter_runs(text))
        for lang, found in words.items():
            kinds = [found, *(Counter() for _ in range(ORDER))]
            for word, n in found.items():
                marked = f"^{word}$"
                for k in range(1, ORDER + 1):
                    grams = kinds[k]
                    for i in range(len(marked) - k + 1):
                        grams[marked[i:i + k]] += n
            for kind, counter in enumerate(kinds):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counter), pa.string()), pa.array([kind] * len(counter), pa.int32()),
                     pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())],
                    names=["lang", "kind", "gram", "n"])


def fit(docs: DataFrame, training: Column, docs_per_lang: int = DOCS_PER_LANG, max_langs: int = MAX_LANGS,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of ``docs`` where ``training`` holds and the language is not null."""
    labelled = docs.where(training).where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    langs = sorted(sizes)
    if not langs:
        none, empty = np.zeros((0, 0)), pa.array([], pa.string())
        return Model([], np.zeros(0), empty, none, empty, none)
    # one lookup whatever the number of languages; null (and so left out) for one that is not learnt
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, docs_per_lang / sizes[lang]) * SAMPLE_STEPS))])
    chosen = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(SAMPLE_STEPS)) < F.element_at(share, F.col("lang"))
    counted = (labelled.where(chosen).select("text", "lang")
               .transform(map_arrow, _counts, "lang string, kind int, gram string, n bigint")
               .groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n")))
    # every word and n-gram of the sampled documents: bounded by docs_per_lang and max_langs
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    found = counted.select("kind", "gram", F.element_at(place, F.col("lang")).alias("lang"), "n").toArrow()
    logs, lists = [], []
    for kind in range(ORDER + 1):
        part = found.filter(pc.equal(found["kind"], kind)).combine_chunks()
        coded = pc.dictionary_encode(part["gram"]).combine_chunks() if len(part) else pa.array([], pa.string()).dictionary_encode()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        counts = np.zeros((len(coded.dictionary), len(langs)))
        np.add.at(counts, (coded.indices.to_numpy(), part["lang"].to_numpy()), part["n"].to_numpy())
        logs.append((np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * max(1, len(counts)))) / max(kind, 1))
        lists.append(coded.dictionary)
    prior = np.array([sizes[x] for x in langs], float)
    return Model(langs, np.log(prior / prior.sum()), lists[0], logs[0], pa.concat_arrays(lists[1:]), np.concatenate(logs[1:]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words and n-grams of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = claim(("language", shared.value.key), lambda: Scorer(shared.value))
        for batch in batches:
            langs, scores = scorer.predict(raw_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)],
                                             names=["doc_id", "lang_pred", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .transform(map_arrow, run, f"doc_id {id_type}, lang_pred string, score double"))


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined with ``min_score``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = claim(("language", shared.value.key), lambda: Scorer(shared.value))
        for batch in batches:
            langs, scores = scorer.predict(raw_texts(batch.column(at)))
            yield batch.filter(pa.array([x != UNDETERMINED and s >= min_score for x, s in zip(langs, scores)], pa.bool_()))

    return docs.transform(map_arrow, run, docs.schema)


def fold(id_col: str = "doc_id") -> Column:
    """0 to 3 from the CRC-32 of the id as text; 2 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 4


def op4_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, fold() != 2)
    return predict(docs, model).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"),
                                       "lang_pred", "score")


QUERIES = {"op4_language_backoff": op4_language_backoff}
ORACLE: dict[str, str] = {}
