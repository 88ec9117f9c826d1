"""Quality classifier by co-training of a text view and a metadata view.

The text view sees only what is in the text (byte and word statistics of the whole text), the metadata view only
the other columns (language, source, length). Both start from the labelled documents. In every round each view
calibrates itself on held-out labels and hands the other one the unlabelled documents that it is surest of, as
pseudo-labels. At the end the two calibrated views are combined by a logistic model on held-out labels, and every
document is scored. Below 0.5 a document is rejected.

Bounds: the classifiers are fitted on at most ``MAX_LABELLED`` labelled and about ``MAX_UNLABELLED`` unlabelled
documents, drawn by a seeded hash of the doc_id; everything else covers every row and whole texts.

Results for the unusual cases: null text counts as empty, null metadata as a value of its own; labels without a
matching document, null labels and repeated ones (the lower quality counts) are no error; without both classes among
the labels nothing can be learned, and every document is kept with a null score; an empty table gives an empty
result; rows that repeat are scored each; extra columns pass through ``filter_quality``.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_LABELLED = 6_000
MAX_UNLABELLED = 6_000
ROUNDS = 3
#: Calibrated probability from which a view is sure, for either class.
SURE = 0.98
#: Pseudo-labels that a view hands over in a round, as a share of the unlabelled sample.
SHARE = 0.2
RIDGE = 1.0
THRESHOLD = 0.5
SEED = 23
META = ("lang", "source", "n_chars")
_SLOTS = 64


def text_features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    m = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:])) / m
    distinct = len(set(words)) / m
    extra = [counts[128:].sum() / n, counts[65:91].sum() / n, counts[48:58].sum() / n, again, distinct, distinct * math.log1p(m), len(data) / m / 10, math.log1p(len(data)) / 10]
    return np.concatenate([np.sqrt(counts[:128] / n), extra]).astype(np.float32)


def meta_features(row: tuple) -> np.ndarray:
    """Categories fall into hashed slots, numbers count as their logarithm."""
    out = np.zeros(_SLOTS + len(row), dtype=np.float32)
    for i, value in enumerate(row):
        if isinstance(value, (int, float, np.number)) and not isinstance(value, bool) and value == value:
            out[_SLOTS + i] = math.log1p(abs(float(value))) / 10
        else:
            known = value is not None and value == value
            out[zlib.crc32(f"{i}:{value if known else ''}:{known}".encode()) % _SLOTS] = 1
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Logistic:
        x = x.astype(np.float64)
        self.mean, deviation = x.mean(0), x.std(0)
        self.scale = np.where(deviation > 1e-9, deviation, 1.0)
        design = self._design(x)
        self.weights = np.zeros(design.shape[1])
        penalty = np.full(design.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ self.weights, -30, 30)))
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty), design.T @ (y - p) - penalty * self.weights)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x.astype(np.float64)) @ self.weights, -30, 30)


@dataclass
class View:
    model: Logistic
    calibration: Logistic

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.logit(self.model.logit(x)[:, None])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class CoTrained:
    text: View
    meta: View
    combined: Logistic

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text), self.meta.logit(meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.combined.logit(np.column_stack([a, b])))


def _view(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> View:
    model = Logistic().fit(x, y)
    return View(model, Logistic().fit(model.logit(held_x)[:, None], held_y, ridge=0.1))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray, more_text: np.ndarray, more_meta: np.ndarray, rounds: int = ROUNDS) -> CoTrained:
    """held marks the labelled rows kept for calibration; the others start both views."""
    fit = ~held
    views = {}
    own = {"text": (text, more_text), "meta": (meta, more_meta)}
    given = {"text": np.full(len(more_text), np.nan), "meta": np.full(len(more_text), np.nan)}  # pseudo-labels each view has received
    for turn in range(rounds + 1):
        for name, (x, more) in own.items():
            got = ~np.isnan(given[name])
            views[name] = _view(np.vstack([x[fit], more[got]]), np.concatenate([y[fit], given[name][got]]), x[held], y[held])
        if turn == rounds or not len(more_text):
            break
        for name, other in (("text", "meta"), ("meta", "text")):
            p = _sigmoid(views[name].logit(own[name][1]))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                new = np.flatnonzero((sure >= SURE) & np.isnan(given[other]))
                most = int(SHARE * len(p) * (y[fit] == label).mean()) + 1
                given[other][new[np.argsort(-sure[new], kind="stable")][:most]] = label
    z = np.column_stack([views[n].logit(own[n][0][held]) for n in ("text", "meta")])
    return CoTrained(views["text"], views["meta"], Logistic().fit(z, y[held], ridge=0.1))


def _sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, meta: list[str]) -> pd.DataFrame:
    """Bounded: ids, label (null if unlabelled) and both views' features of the sampled documents."""
    draw = f"xxhash64(`{id_col}`, {SEED})"
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("double").alias("label"))
    known = known.orderBy(F.expr(draw)).limit(MAX_LABELLED).select(F.col(id_col).alias("known_id"), "label")
    n = max(1, df.count())
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(meta)])
    rows = rows.join(F.broadcast(known), F.col("id") == F.col("known_id"), "left")  # at most MAX_LABELLED rows
    rows = rows.where(F.col("label").isNotNull() | F.expr(f"pmod(xxhash64(id, {SEED + 1}), {n}) < {MAX_UNLABELLED}"))
    names = [f"m{i}" for i in range(len(meta))]

    def run(frames):
        for frame in frames:
            ms = list(zip(*[frame[c] for c in names], strict=True)) if names else [()] * len(frame)
            yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "t": [text_features(t).tobytes() for t in frame["text"]], "m": [meta_features(x).tobytes() for x in ms]})

    out = rows.select("id", "label", "text", *names).mapInPandas(run, "id long, label double, t binary, m binary")
    return out.toPandas().sort_values("id", kind="stable")


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta: tuple[str, ...] = META) -> CoTrained | None:
    found = _sample(df, labels, id_col, text_col, label_col, [c for c in meta if c in df.columns])
    marked = found[found["label"].notna()].drop_duplicates("id")
    rest = found[found["label"].isna()].drop_duplicates("id").head(2 * MAX_UNLABELLED)
    y = (marked["label"].to_numpy() > 0.5).astype(np.float64)
    held = np.array([zlib.crc32(f"{SEED}:{i}".encode()) % 4 == 0 for i in marked["id"]], dtype=bool)
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return None
    stack = lambda frame, c: np.frombuffer(b"".join(frame[c]), dtype=np.float32).reshape(len(frame), -1 if len(frame) else len(marked[c].iloc[0]) // 4)
    model = co_train(stack(marked, "t"), stack(marked, "m"), y, held, stack(rest, "t"), stack(rest, "m"))
    del found, marked, rest
    common.release(df.sparkSession)  # the sample is the most that this operator holds on the driver
    return model


def scores(df: DataFrame, model: CoTrained | None, text_col: str = "text", meta: tuple[str, ...] = META) -> Column:
    """Struct of text, meta and score: the calibrated probability of good quality by view and combined."""
    if model is None:
        return F.lit(None).cast("struct<text:double,meta:double,score:double>")
    held = df.sparkSession.sparkContext.broadcast(model)  # a few hundred weights
    names = [c for c in meta if c in df.columns]

    @F.pandas_udf("text double, meta double, score double")
    def score(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = list(zip(*[frame[f"m{i}"] for i in range(len(names))], strict=True)) if names else [()] * len(frame)
        for at in range(0, len(frame), 256):
            t = np.vstack([text_features(x) for x in frame["text"].iloc[at : at + 256]])
            out.append(np.column_stack(held.value.scores(t, np.vstack([meta_features(x) for x in rows[at : at + 256]]))))
        return pd.DataFrame(np.vstack(out) if out else np.empty((0, 3)), columns=["text", "meta", "score"])

    return score(F.struct(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"m{i}") for i, c in enumerate(names)]))


def score_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta: tuple[str, ...] = META) -> DataFrame:
    """One row per row of df: id, text_score, meta_score, score, kept."""
    model = train(df, labels, id_col, text_col, label_col, meta)
    s = df.select(F.col(id_col), scores(df, model, text_col, meta).alias("s"))
    return s.select(id_col, F.round("s.text", 6).alias("text_score"), F.round("s.meta", 6).alias("meta_score"), F.round("s.score", 6).alias("score"), F.coalesce(F.col("s.score") >= THRESHOLD, F.lit(True)).alias("kept"))


def filter_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta: tuple[str, ...] = META) -> DataFrame:
    """The rows of df that are not rejected, with all their columns."""
    model = train(df, labels, id_col, text_col, label_col, meta)
    if model is None:
        return df
    return df.where(scores(df, model, text_col, meta)["score"] >= THRESHOLD)


def op4_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
