"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its words' character n-grams (hashed to buckets), and
a linear layer with softmax gives the language; both are trained together by stochastic gradient
descent in numpy.  A calibration fold fits a temperature and the threshold of rejection.

Training uses a bounded sample: at most about ``ROWS_PER_LANGUAGE`` labelled rows of each
language, taken by a hash of the id and text, as bucket counts of their whole texts, which the tasks
that read the texts compute.  Prediction is one pass over whole texts; a word's part of the result is
looked up after its first time.

Defined results: a text that is null or has no letter is ``und`` with score 0 and is rejected; with
no labelled rows every text is ``und``; rows are answered one by one; an empty table gives no rows;
other columns are ignored by ``predict`` and kept by ``drop_rejected``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, spread

BUCKETS, DIMENSIONS = 1 << 14, 16
GRAMS = (1, 2, 3)
ROWS_PER_LANGUAGE = 800
EPOCHS, BATCH, RATE, EMBEDDING_RATE = 8, 32, 1.0, 10.0
#: Rejection costs at most this share of rightly labelled calibration rows, and takes no score above the other.
REJECT_AT_MOST, REJECT_BELOW = 0.002, 0.4
_WORD = re.compile(r"[^\W\d_]+")
#: The sample's most rows in all, so that the driver's share is bounded however many languages there are.
MOST_ROWS = 40_000
#: Bytes of a task's table of word results, whatever the number of languages, and its most words.
_TABLE_BYTES, _CACHED = 8 << 20, 60_000
#: Most n-grams whose buckets a task keeps.
_GRAMS = 100_000


def held_out(doc_id="doc_id"):
    """Rows that training never sees: crc32 of the id's text leaves 1 when divided by 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def word_buckets(word: str) -> list[int]:
    marked = f"<{word}>"
    return [zlib.crc32(marked[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)]


class _Grams(dict):
    """n-gram -> bucket, as ``word_buckets`` has it."""

    def __missing__(self, gram: str) -> int:
        found = self[gram] = zlib.crc32(gram.encode()) % BUCKETS
        return found


def words_of(text: str | None) -> list[str]:
    """Lower-case words; none when the text has no letter."""
    words = _WORD.findall(text.lower()) if text else []
    return words if any(any(map(str.isalpha, w)) for w in words) else []


def text_features(text: str | None, table: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of the whole text; ``table`` keeps the buckets of words met before."""
    table, found = {} if table is None else table, Counter(words_of(text))
    if len(table) > _CACHED:
        table.clear()
    for word in found.keys() - table.keys():
        table[word] = np.array(word_buckets(word), np.int64)
    total = np.zeros(BUCKETS)
    if found:
        buckets = [table[w] for w in found]
        total = np.bincount(np.concatenate(buckets), np.repeat(np.array(list(found.values()), float), [len(b) for b in buckets]), BUCKETS)
    at = np.nonzero(total)[0]
    return at.astype(np.int32), (total[at] / max(total.sum(), 1)).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    parts: np.ndarray  # bucket -> its addend to the logits, temperature included
    bias: np.ndarray
    threshold: float
    temperature: float = 1.0
    calibration_accuracy: float | None = None

    def predictor(self):
        """A function text -> (language, score), with a bounded table of words seen."""
        size = len(self.languages)
        most = max(1, min(_CACHED, _TABLE_BYTES // (8 * (size + 1))))
        rows, table, grams = np.zeros((most, size + 1)), {}, _Grams()
        # So many words at once that the parts of their n-grams are of the table's size.
        step = max(1, most // 32)

        def enter(words: list[str]) -> None:
            """Rows of new words, all in one sum: most texts bring some, and rare words are most of all different ones."""
            found, sizes = [], []
            for word in words:
                m = f"<{word}>"
                found += map(grams.__getitem__, m)
                found += [grams[x + y] for x, y in zip(m, m[1:])]
                found += [grams[x + y + z] for x, y, z in zip(m, m[1:], m[2:])]
                sizes.append(3 * len(m) - 3)
            if len(grams) > _GRAMS:
                grams.clear()
            at = len(table)
            rows[at : at + len(words), :size] = np.add.reduceat(self.parts[found], np.cumsum([0, *sizes[:-1]]), axis=0)
            rows[at : at + len(words), size] = sizes
            table.update(zip(words, range(at, at + len(words))))

        def predict(text: str | None) -> tuple[str, float]:
            words = words_of(text)
            if not words or not size:
                return "und", 0.0
            total = np.zeros(size + 1)
            for start in range(0, len(words), step):
                part = words[start : start + step]
                places = list(map(table.get, part))
                if None in places:
                    new = list(dict.fromkeys(w for w, p in zip(part, places) if p is None))
                    if len(table) + len(new) > most:
                        table.clear()
                        new = list(dict.fromkeys(part))
                    enter(new)
                    places = list(map(table.get, part))
                total += rows[places].sum(axis=0)
            logits = total[:size] / total[size] + self.bias
            logits = np.exp(logits - logits.max())
            best = int(logits.argmax())
            return self.languages[best], float(logits[best] / logits.sum())

        return predict


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray, bool]], seed: int = 7) -> LanguageModel:
    """Fit on (language, buckets, shares, whether for calibration)."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    size = len(languages)
    if not size:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0)
    rng = np.random.default_rng(seed)
    embed, out, bias = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, size)), np.zeros(size)
    code = {name: k for k, name in enumerate(languages)}
    fit = [r for r in rows if not r[3]] or rows
    y = np.array([code[r[0]] for r in fit])
    weight = (len(fit) / (size * np.maximum(np.bincount(y, minlength=size), 1)))[y]
    steps, done = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for start in range(0, len(order), BATCH):
            pick = order[start : start + BATCH]
            at = np.concatenate([fit[i][1] for i in pick])
            share = np.concatenate([fit[i][2] for i in pick])[:, None]
            n = np.array([len(fit[i][1]) for i in pick])
            mean = np.add.reduceat(embed[at] * share, np.concatenate(([0], np.cumsum(n)[:-1])), axis=0)
            slope = _softmax(mean @ out + bias)
            slope[np.arange(len(pick)), y[pick]] -= 1
            slope *= weight[pick][:, None]
            rate = RATE * (1 - done / steps)
            back = slope @ out.T
            out -= rate * mean.T @ slope / len(pick)
            bias -= rate * slope.sum(axis=0) / len(pick)
            np.add.at(embed, at, -rate * EMBEDDING_RATE * share * np.repeat(back, n, axis=0))
            done += 1
    parts = embed @ out
    check = [r for r in rows if r[3]]
    if not check:
        return LanguageModel(languages, parts, bias, 0.0)
    z = np.array([(parts[r[1]] * r[2][:, None]).sum(axis=0) + bias for r in check])
    truth = np.array([code[r[0]] for r in check])
    loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean() for t in np.geomspace(0.25, 4, 41)}
    heat = float(min(loss, key=loss.get))
    p = _softmax(z / heat)
    right = p.argmax(axis=1) == truth
    scores = np.sort(p.max(axis=1)[right])
    least = float(scores[int(len(scores) * REJECT_AT_MOST)]) if len(scores) else 0.0
    return LanguageModel(languages, parts / heat, bias / heat, min(REJECT_BELOW, least), heat, float(right.mean()))


def training_rows(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> list:
    """The bounded sample, as features, on the driver."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.withColumn("digest", F.sha2("text", 256))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    rows_per_language = min(rows_per_language, max(1, MOST_ROWS // len(counts)))
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1 << 20)) / (1 << 20)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_language / n)))])
    # The sample is bounded, so all cores may share its texts.
    sample = labelled.where(unit < F.element_at(share, F.col("lang"))).repartition(docs.sparkSession.sparkContext.defaultParallelism)

    def features(batches):
        table: dict = {}
        for b in batches:
            found = [text_features(t.as_py(), table) for t in b.column(1)]
            check = [zlib.crc32(f"calibration {d}".encode()) % 4 == 0 for d in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [b.column(2), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float32())), pa.array(check), b.column(0), b.column(3)],
                ["lang", "buckets", "shares", "calibration", "doc_id", "digest"],
            )

    found = in_batches(sample).mapInArrow(features, "lang string, buckets array<int>, shares array<float>, calibration boolean, doc_id long, digest string")
    # The limit binds only where one id and text repeat so often that the hash takes all of them.
    got = found.limit(2 * rows_per_language * len(counts)).toArrow()
    # The order of arrival depends on tasks; training must not.
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("digest", "ascending")]).drop_columns(["doc_id", "digest"])
    lang, calibration = got["lang"].to_pylist(), got["calibration"].to_pylist()
    columns = [[x.values.to_numpy() for x in got[c]] for c in ("buckets", "shares")]
    return list(zip(lang, *columns, calibration))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    return train(training_rows(docs, rows_per_language))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected."""

    def run(batches):
        one = model.predictor()
        for b in batches:
            found = [one(t.as_py()) for t in b.column(2)]
            lost = [name == "und" or score < model.threshold for name, score in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(lost, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return in_batches(spread(rows)).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out, then predict every row."""
    return predict(docs, fit(docs))


def drop_rejected(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """``docs`` without the rows whose language is rejected, all columns kept."""
    model = model or fit(docs)

    def accepted(batches):
        one = model.predictor()
        for texts in batches:
            found = (one(t.as_py()) for t in texts)
            yield pa.array([name != "und" and score >= model.threshold for name, score in found], pa.bool_())

    accepted.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return in_batches(docs).where(F.arrow_udf(accepted, "boolean")(F.col("text").cast("string")))
