"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams, hashed to ``BUCKETS`` rows; a linear layer and a softmax
give the languages. Embeddings and layer are trained together by stochastic gradient descent in numpy, on windows of a
bounded sample of labelled rows. A temperature, fitted on sampled rows kept back from training, makes the score a
calibrated probability. A text is rejected if its score is near chance, or if fewer of its n-grams are known from
training than rows kept back from training lead one to expect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..runtime import cut
from .common import bytes_of, forget, mixed, slices, tidy

UNKNOWN = "und"
ORDERS = (2, 3, 4)  # lengths of the byte n-grams
BUCKETS = 1 << 16
WIDTH = 16  # of an embedding
SAMPLE_ROWS = 600  # distinct texts a language gives for fitting, at most: the documented bound of the sample
WINDOWS, WINDOW_CHARS = 4, 240  # of a sampled row: stretches spread over its whole text
EPOCHS, RATE, SEED = 6, 0.5, 7
NEAR_CHANCE = 0.13  # of the way from a guess to certainty: a calibrated score below is rejected; short clean texts score above it
LEAST = 0.01  # quantile of the shares of known n-grams among windows kept back
_SLICE = 1 << 18  # bytes of text; what is made of them takes many times as much


def _byte_table() -> np.ndarray:
    """ASCII letters and all bytes of other scripts stay, the rest becomes a blank."""
    table = np.full(256, 32, np.uint64)
    table[128:] = np.arange(128, 256)
    for a, z in ((65, 90), (97, 122)):
        table[a : z + 1] = np.arange(97, 123)
    return table


def _grams(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of the n-grams of each order that lie in one text and have a letter."""
    b = _byte_table()[raw]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for n in ORDERS:
        if len(b) < n:
            continue
        m = len(b) - n + 1
        code, seen = np.zeros(m, np.uint64), np.zeros(m, bool)
        for k in range(n):
            part = b[k : k + m]
            code = (code << np.uint64(8)) | part
            seen |= part != 32
        good = seen & (owner[:m] == owner[n - 1 :])
        yield (mixed(code[good] + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64), owner[:m][good]


@dataclass
class Model:
    """``table @ layer + bias`` over the mean of a text's rows, divided by ``temperature``."""

    languages: list[str]
    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    known: np.ndarray | None = None  # buckets that training has seen
    known_limit: float = 0.0  # least share of known n-grams that a text of these languages has

    @cached_property
    def rows(self) -> np.ndarray:
        """What a text's n-grams are summed over: for few languages their share in each logit."""
        return (self.table @ self.layer if len(self.languages) <= WIDTH else self.table).astype(np.float32)

    def logits(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, n-grams, those of them that training has seen) of each text."""
        n = len(at) - 1
        small, table = len(self.languages) <= WIDTH, self.rows
        total, seen, met = np.zeros((n, table.shape[1])), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for bucket, owner in _grams(raw, at):
            seen += np.bincount(owner, minlength=n)
            met += np.bincount(owner if self.known is None else owner[self.known[bucket]], minlength=n)
            where = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(where):
                total[owner[where]] += np.add.reduceat(table[bucket], where, axis=0, dtype=np.float64)
        mean = total / np.maximum(seen, 1)[:, None]
        return (mean if small else mean @ self.layer) + self.bias, seen, met

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``languages``, calibrated score); a text without n-grams gets the bias alone."""
        return self.judge(raw, at)[:2]

    def judge(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``predict`` and whether the text fits one of the languages at all.

        The share of known n-grams is that of a sample of the language's n-grams: only if it lies below the limit by two
        standard deviations, which are wide for a short text, the text is none of theirs.
        """
        z, seen, met = self.logits(raw, at)
        p = _softmax(z / self.temperature)
        chance = 1 / max(1, len(self.languages))
        n = np.maximum(seen, 1)
        strange = met / n + 1 / np.sqrt(n) < self.known_limit
        near = p.max(1) < chance + NEAR_CHANCE * (1 - chance)
        return p.argmax(1), p.max(1), ~(strange | near)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, key, piece): windows of up to ``SAMPLE_ROWS`` distinct texts of each language, picked by a digest of the text.

    Texts without a letter do not count, and copies count once. A first cut by the digest leaves about four times as many
    texts of a language, however many it has and however many tasks read them; only their windows are shuffled, copies
    folded before, and ranked.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    share = cut(rows.groupBy("lang").agg((F.lit(4.0 * SAMPLE_ROWS) / F.count_distinct("key")).alias("share")))
    room = F.greatest(F.length("text") - WINDOW_CHARS, F.lit(0))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: (room * k / (WINDOWS - 1)).cast("int")))
    few = rows.join(share, "lang").where(F.pmod("key", F.lit(1 << 30)) < F.col("share") * (1 << 30)).withColumn("text", F.lower("text")).select(
        "lang", "key", F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(WINDOW_CHARS))).alias("pieces")).groupBy(
        "lang", "key").agg(F.first("pieces").alias("pieces"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return few.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_ROWS).select("lang", "key", F.explode("pieces").alias("piece"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of the labelled rows of ``docs``; without any, one that knows no language."""
    rows = sorted((r.lang, r.key, r.piece) for r in sample(docs, text, lang).collect())
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, WIDTH)), np.zeros((WIDTH, 0)), np.zeros(0))
    number = {name: k for k, name in enumerate(languages)}
    y = np.array([number[r[0]] for r in rows])
    back = np.array([r[1] % 5 == 0 for r in rows])  # whole rows are kept back, not single windows
    if back.all() or len({*y[~back].tolist()}) < len(languages):
        back[:] = False
    raw, at = bytes_of(pa.array([r[2] for r in rows], pa.string()))
    bags = _bags(raw, at)
    del rows, raw, at
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    layer, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    train = np.flatnonzero(~back)
    share = np.bincount(y[train], minlength=len(languages))
    weight = np.sqrt(len(train) / len(languages) / np.maximum(share, 1))
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            rate = RATE * (1 - done / steps) * weight[y[i]]
            done += 1
            bucket, part = bags[i]
            if not len(bucket):
                continue
            rows_of = table[bucket]
            mean = part @ rows_of
            error = _softmax(mean @ layer + bias)
            error[y[i]] -= 1
            pull = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            table[bucket] = rows_of - (rate * len(bucket) * part)[:, None] * pull
    model = Model(languages, table, layer, bias)
    held = np.flatnonzero(back)
    if len(held):
        z = np.array([bags[i][1] @ table[bags[i][0]] for i in held]) @ layer + bias
        grid = np.geomspace(0.25, 16, 49)
        loss = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        model.known = np.zeros(BUCKETS, bool)
        for i in train:
            model.known[bags[i][0]] = True
        # midway between texts of other scripts, whose n-grams meet seen buckets by chance, and what rows kept back have at least
        own = np.quantile([bags[i][1][model.known[bags[i][0]]].sum() for i in held if len(bags[i][0])] or [0.0], LEAST)
        model.known_limit = float(max(0.0, own + model.known.mean()) / 2) if own > model.known.mean() else 0.0
    return model


def _bags(raw: np.ndarray, at: np.ndarray, some: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their shares) of each text; ``some`` texts are in work at once, so the driver's peak is small."""
    bags = []
    for a in range(0, len(at) - 1, some):
        part = at[a : a + some + 1]
        found = list(_grams(raw[part[0] : part[-1]], part - part[0]))
        keys = np.concatenate([owner * BUCKETS + bucket for bucket, owner in found]) if found else np.zeros(0, np.int64)
        key, count = np.unique(keys, return_counts=True)
        ends = np.searchsorted(key, np.arange(len(part)) * BUCKETS)
        bags += [((key[i:j] % BUCKETS).astype(np.int32), (count[i:j] / max(1, count[i:j].sum())).astype(np.float32)) for i, j in zip(ends, ends[1:])]
    return bags


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
             lang: str = "lang_pred", score: str = "score", fits: str | None = None) -> DataFrame:
    """``keep`` columns, the predicted language of the whole text and its calibrated score; ``fits`` names a column for
    whether the text is accepted (``Model.judge``; false for ``und``).

    Null texts and texts without a letter are ``und`` with score 0, and so is all if no language was learned. Equal
    texts get equal predictions; only the text is read. Other columns are left out, so their names cannot clash.
    """
    rows = docs.select(*(F.col(k).alias(f"__{n}") for n, k in enumerate(keep)), F.lower(text).alias("__text"),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    names = [f"__{n}" for n in range(len(keep))]
    out = T.StructType([*(f for f in rows.schema.fields if f.name in names),
                        T.StructField("__lang", T.StringType(), False), T.StructField("__score", T.DoubleType(), False),
                        T.StructField("__fits", T.BooleanType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([*model.languages, UNKNOWN], object)
        forget()
        for batch in slices(batches, "__text", _SLICE):
            n = batch.num_rows
            place, p, good = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
            if model.languages:
                place, p, good = model.judge(*bytes_of(batch.column("__text")))
                bare = ~batch.column("__letter").to_numpy(zero_copy_only=False)
                place[bare], p[bare], good[bare] = -1, 0.0, False
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(known[place], pa.string()), pa.array(p), pa.array(good)], names=out.names)

    done = rows.mapInArrow(tidy(run), out)
    return done.select(*(F.col(c).alias(k) for c, k in zip(names, keep)), F.col("__lang").alias(lang), F.col("__score").alias(score),
                       *([F.col("__fits").alias(fits)] if fits else []))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept out of fitting: a quarter, by a digest of the id as text (null: the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
