"""Language identification by interpolated Kneser-Ney character models.

One model per learned language predicts each character of a word from the characters
before it.  All languages share sorted arrays of n-gram hashes, with one column of
probabilities per language, so a lookup serves every language.  The language with the
lowest cross-entropy per character is chosen, and texts whose cross-entropy is far
above what that language's own documents have are rejected.

The models are fitted on a bounded sample of labelled rows (``PER_LANGUAGE``); every
text is scored whole.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, worker_cache
from gleaner.plans.sizing import materialise

ORDER = 4
# Labelled documents drawn per language (in expectation) for fitting and calibration.
PER_LANGUAGE = 800
# One in so many of the drawn documents calibrates instead of being learned from.
CALIBRATION = 5
# Rejected: this many deviations and this factor above the language's own mean.
DEVIATIONS, FACTOR = 6.0, 1.5
# Sharpness of the score: nats per character that separate languages.
SHARPNESS = 8.0
UNKNOWN = "und"
CACHE_PIECES = 250_000
# New words that are scored at once.
CHUNK_WORDS = 1 << 14

_LETTERS = re.compile(r"[^\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(piece: str) -> list[str]:
    return [run for run in _LETTERS.findall(piece.lower()) if any(c.isalpha() for c in run)]


def _hashes(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """By order: hashes of the n-gram and of its context at every predicted character.

    Words are padded so that each predicted character has a full context.  The third
    value holds the number of characters predicted in each word.
    """
    padded = [" " * (ORDER - 1) + w + " " for w in words]
    sizes = np.array([len(p) for p in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    at = np.flatnonzero(place >= ORDER - 1)
    grams, contexts = [], []
    for k in range(1, ORDER + 1):
        value = np.full(len(at), k, np.uint64)
        for back in range(k - 1, 0, -1):
            value = (value ^ codes[at - back]) * _MULTIPLIER
            value ^= value >> np.uint64(29)
        contexts.append(value)
        value = (value ^ codes[at]) * _MULTIPLIER
        grams.append(value ^ (value >> np.uint64(29)))
    return grams, contexts, sizes - (ORDER - 1)


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    shares: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)
    floor: float = 1e-4
    # Per language: mean cross-entropy, and its deviation at one character.
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_probabilities(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: log probability in each language, and the number of characters."""
        grams, contexts, sizes = _hashes(words)
        p = np.full((len(grams[0]), len(self.languages)), self.floor)
        for k in range(ORDER):
            p = _rows(self.grams[k], self.shares[k], grams[k], 0.0) + p * _rows(
                self.contexts[k], self.backoffs[k], contexts[k], 1.0
            )
        return np.add.reduceat(np.log(p), np.cumsum(sizes) - sizes, axis=0), sizes


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], default)


def fit(counts: dict[str, dict[str, int]]) -> Model:
    """Kneser-Ney models from the word counts of each language."""
    languages = sorted(counts)
    model = Model(languages)
    characters = {c for words in counts.values() for w in words for c in w}
    model.floor = 1.0 / (len(characters) + 1000)
    per = []
    for language in languages:
        words = list(counts[language])
        grams, contexts, sizes = _hashes(words)
        weight = np.repeat(np.array([counts[language][w] for w in words], float), sizes)
        orders = []
        for k in range(ORDER):
            if k + 1 < ORDER:  # in how many longer n-grams it stands
                _, first = np.unique(grams[k + 1], return_index=True)
                gram, context, count = grams[k][first], contexts[k][first], np.ones(len(first))
            else:
                gram, context, count = grams[k], contexts[k], weight
            keys, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
            count = np.bincount(inverse, count)
            context = context[first]
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = min(max(once / (once + 2 * twice) if once + twice else 0.5, 0.1), 0.9)
            before, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, count), np.bincount(inverse)
            orders.append((keys, (count - discount) / total[inverse], before, discount * kinds / total))
        per.append(orders)
    for k in range(ORDER):
        for part, (keys_at, values_at, default) in {"g": (0, 1, 0.0), "c": (2, 3, 1.0)}.items():
            keys = np.unique(np.concatenate([orders[k][keys_at] for orders in per]))
            table = np.full((len(keys), len(languages)), default)
            for j, orders in enumerate(per):
                table[np.searchsorted(keys, orders[k][keys_at]), j] = orders[k][values_at]
            (model.grams if part == "g" else model.contexts).append(keys)
            (model.shares if part == "g" else model.backoffs).append(table)
    model.mean = np.full(len(languages), np.inf)
    model.spread = np.full(len(languages), np.inf)
    return model


def _entropies(model: Model, key: str, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: nats per character in each language, and the characters predicted."""
    store = worker_cache(key)
    sums = np.zeros((len(texts), len(model.languages) + 1))
    parts = [(t or "").split() for t in texts]
    met = set().union(*parts)
    if not store:
        store.update(at={}, table=np.zeros((1 << 16, len(model.languages) + 1), np.float32))
    fresh = list(met.difference(store["at"]))
    if len(store["at"]) + len(fresh) > CACHE_PIECES:
        kept = [piece for piece in met if piece in store["at"]]
        rows = store["table"][[store["at"][piece] for piece in kept]]
        store.update(at={piece: i for i, piece in enumerate(kept)}, table=np.concatenate([rows, np.zeros_like(rows[:1])]))
    at, table = store["at"], store["table"]
    runs = [letter_runs(piece) for piece in fresh]
    words = list(dict.fromkeys(w for r in runs for w in r))
    score = {}
    for i in range(0, len(words), CHUNK_WORDS):
        some = words[i : i + CHUNK_WORDS]
        logs, sizes = model.log_probabilities(some)
        score.update(zip(some, np.column_stack([logs, sizes]).astype(np.float32), strict=True))
    if len(at) + len(fresh) > len(table):
        room = np.zeros((len(fresh) + CHUNK_WORDS, table.shape[1]), np.float32)
        table = store["table"] = np.concatenate([table, room])
    for piece, own in zip(fresh, runs, strict=True):
        place = at[piece] = len(at)
        table[place] = sum(score[w] for w in own) if own else 0
    for i, own in enumerate(parts):
        if own:
            sums[i] = table[np.fromiter(map(at.__getitem__, own), np.int64, len(own))].sum(axis=0, dtype=float)
    n = sums[:, -1]
    return -sums[:, :-1] / np.maximum(n, 1)[:, None], n


def _predictor(model: Model):
    """A vectorised column function: text -> struct(lang, score, entropy, n, rejected)."""
    key = f"language {uuid.uuid4().hex}"

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            entropy, n = _entropies(model, key, texts.tolist())
            best = entropy.argmin(axis=1)
            own = entropy[np.arange(len(best)), best]
            weight = np.exp(-SHARPNESS * (entropy - own[:, None]))
            over = own - model.mean[best]
            far = (over > (FACTOR - 1) * model.mean[best]) & (
                over > DEVIATIONS * model.spread[best] / np.sqrt(np.maximum(n, 1))
            )
            known = n > 0
            yield pd.DataFrame(
                {
                    "lang_pred": np.where(known, np.array(model.languages, object)[best], UNKNOWN),
                    "score": np.where(known, 1.0 / weight.sum(axis=1), 0.0),
                    "entropy": np.where(known, own, 0.0),
                    "characters": n.astype(np.int64),
                    "rejected": ~known | far,
                }
            )

    schema = "lang_pred string, score double, entropy double, characters long, rejected boolean"
    return F.pandas_udf(predict, schema)


def _calibration(model: Model, held: DataFrame) -> DataFrame:
    """Per language, over the rows (lang, text) it is right about: mean entropy, and its deviation at one character."""
    # Else the filter would move below and predict once more, in a second worker of each task.
    predicted = _predictor(model).asNondeterministic()(F.col("text"))
    return (
        held.select("lang", predicted.alias("p"))
        .filter("lang = p.lang_pred and p.characters > 0")
        .groupBy("lang")
        .agg(
            F.avg("p.entropy").alias("mean"),
            F.stddev_pop(F.col("p.entropy") * F.sqrt("p.characters")).alias("spread"),
        )
    )


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit and calibrate on about ``per_language`` rows of each language.

    Rows without an id, a text or a label are not learned from.  Which rows are drawn
    depends on a hash of the id alone.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    drawn = materialise(
        rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .join(F.broadcast(sizes), "lang")
        .filter(place_of("id", 4) * F.col("n") < per_language)
        .select("lang", "text", (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(CALIBRATION)) == 0).alias("held"))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for piece, n in Counter(text.split()).items():
                    for run in letter_runs(piece):
                        words[lang, run] += n
        langs, runs = ([k[i] for k in words] for i in (0, 1))
        columns = [pa.array(langs, pa.string()), pa.array(runs, pa.string()), pa.array(list(words.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

    counted = (
        drawn.filter("not held")
        .select("lang", "text")
        .mapInArrow(count, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    if not len(counted):
        return Model([])
    model = fit({lang: dict(zip(g["word"], g["n"], strict=True)) for lang, g in counted.groupby("lang")})
    for row in _calibration(model, drawn.filter("held")).collect():
        j = model.languages.index(row["lang"])
        model.mean[j], model.spread[j] = row["mean"], row["spread"]
    return model


def place_of(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / F.lit(1 << 30)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct ``out_col`` (lang_pred, score, entropy, characters,
    rejected).

    Null texts and texts without a letter are ``und`` with score 0 and rejected, and so is
    every text if no language was learned.  A language without calibration documents
    rejects nothing else.  Equal texts always get equal results.
    """
    bounded_batches(docs.sparkSession)
    if not model.languages:
        nothing = F.struct(
            F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"),
            F.lit(0).cast("long").alias("characters"), F.lit(True).alias("rejected"),
        )
        return docs.withColumn(out_col, nothing)
    return docs.withColumn(out_col, _predictor(model)(F.col(text_col)))
