"""Operator 10: toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A text is read as units: its words (lower-cased; characters that aren't letters stay as gaps) and runs of
single letters, joined. The kernel of two units compares their gapped subsequences of three letters:
each occurrence that spans at most SPAN characters counts DECAY to the power of its gaps, so insults that
are stretched by inserted characters, hyphens or spaces stay close to their plain form. Units are scaled
by the length of their occurrence weights.

Training sees labelled rows with crc32(doc_id as text) mod 3 other than 1, at most TOXIC toxic and CLEAN
other documents, taken in the order of a hash of their identifiers: a bound that doesn't grow with the
corpus. Texts over LONGEST bytes are left out, and of rows that share an identifier the one with the smallest
text is taken; the next documents in the order take their places. Each class has a bound of
SAMPLE_BYTES of text of its own, so neither one text nor one identifier nor the other class shuts documents out.
One task reads the sample and fits the machine; the driver only hands it on. Character runs that toxic documents hold far more often name the first toxic
units; units of clean documents are the others, and the worst mistaken ones are added in rounds. The
machine works on Nyström features of LANDMARKS units. As it is linear in subsequence counts, landmarks
and weights fold into one table of subsequence weights, so that scoring a unit takes a few lookups a
character. A document's score is a logistic function of a smooth maximum of its units.

Labels, language, source and identifier are never inputs of a score.

Defined results: null and empty texts, and texts without letters, score like texts with no suspicious
unit; a null identifier is not held out and never trained on; labels of one identifier that differ count
as toxic; without labels of both kinds every score is 0; repeated rows are scored each; columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import bounded, encoded, fresh, release, slices, split_words

#: Documents, bytes of text of each class, and bytes of one text.
TOXIC, CLEAN, SAMPLE_BYTES, LONGEST = 1200, 3600, 12 << 20, 256 << 10
LANDMARKS, ROUNDS = 160, 4
SPAN, DECAY = 6, 0.6
THRESHOLD = 0.7
#: Toxic documents whose highest unit is no higher than in this share of the others (mislabelled, or toxic in
#: ways that no unit shows) don't shape the logistic function.
EXPLAINED = 0.995
#: Letters: a to z are 1 to 26, others share the symbols after that; 0 is a gap.
SYMBOLS = 48
STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a)]
RUN = 4
#: Documents whose letter runs are counted in one step.
STEP = 150
LOWEST, SHARP = -3.0, 10.0


def symbols(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all units, with gaps before, between and after, and the unit of each."""
    text = "\0" * SPAN + ("\0" * SPAN).join(pc.utf8_lower(units).to_pylist()) + "\0" * SPAN if len(units) else ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(points), np.int32)
    plain = (points >= 97) & (points <= 122)
    out[plain] = points[plain] - 96
    wide = (points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points < 0x2C00)) & (points != 0xFEFF)
    out[wide] = 27 + points[wide] % (SYMBOLS - 27)
    part = points == 0
    of = np.cumsum(part) // SPAN - 1
    return out, np.minimum(of, max(0, len(units) - 1))


def occurrences(units: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of steps: the units, subsequences and weight of the occurrences."""
    code, of = symbols(units)
    for a, b in STEPS:
        x, y, z = code[: len(code) - a - b], code[a : len(code) - b], code[a + b :]
        at = np.flatnonzero((x > 0) & (y > 0) & (z > 0) & (of[: len(x)] == of[a + b :]))
        yield of[at], (x[at] * SYMBOLS + y[at]) * SYMBOLS + z[at], DECAY ** (a + b - 2)


def lengths(units: pa.Array) -> np.ndarray:
    """What a unit's kernel values are divided by."""
    total = np.zeros(len(units))
    for of, _, weight in occurrences(units):
        total += weight * weight * np.bincount(of, minlength=len(units))
    return np.sqrt(np.maximum(total, 1e-12))


def raw(units: pa.Array, table: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """The sum of the table's weights over a unit's subsequences, scaled.

    table: a weight for each subsequence, or, with the ``place`` of each, a row of weights for each place.
    """
    out, norm = np.zeros((len(units), *table.shape[1:]), np.float64 if table.ndim == 1 else np.float32), np.zeros(len(units))
    for of, index, weight in occurrences(units):
        if place is None:
            out += weight * np.bincount(of, table[index], len(units))
        else:
            for at in range(0, len(of), 20_000):
                some = of[at : at + 20_000]  # ascending
                new = np.flatnonzero(np.diff(some, prepend=-1))
                out[some[new]] += weight * np.add.reduceat(table[place[index[at : at + 20_000]]], new)
        norm += weight * weight * np.bincount(of, minlength=len(units))
    return out / np.sqrt(np.maximum(norm, 1e-12)).reshape(-1, *[1] * (table.ndim - 1))


def features(units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled counts of the subsequences that the units have, one column a unit (and a row of zeros for all others), each one's number, and the place of any."""
    found = [(of, index, weight) for of, index, weight in occurrences(units)]
    used = np.unique(np.concatenate([index for _, index, _ in found]))
    place = np.full(SYMBOLS**3, len(used), np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(used) + 1, len(units)), np.float32)
    for of, index, weight in found:
        np.add.at(out, (place[index], of), weight)
    return out / lengths(units).astype(np.float32), used, place


def spelled(words: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of each row and, after all words, each run of three or more single letters as one unit; with the unit's row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    single = pc.equal(pc.utf8_length(pc.replace_substring_regex(words, r"[^\p{L}]+", "")), 1).to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])) | np.concatenate([[0], np.diff(rows), [0]]) * np.concatenate([[False], single]).astype(np.int64)) if len(words) else np.zeros(0, np.int64)
    joined, of = [], []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= 3 and single[a] and rows[a] == rows[b - 1]:
            joined.append("".join(words.slice(a, b - a).to_pylist()))
            of.append(int(rows[a]))
    return pa.concat_arrays([words, pa.array(joined, words.type)]), np.concatenate([rows, np.array(of, np.int64)])


@dataclass
class Model:
    """The folded machine: weights of subsequences, offset, and the logistic function over a document's units."""

    table: np.ndarray = field(default_factory=lambda: np.zeros(SYMBOLS**3, np.float32))
    offset: float = LOWEST
    logistic: tuple[float, float] = (0.0, -50.0)

    def units(self, units: pa.Array) -> np.ndarray:
        parts = [raw(units.slice(at, 40_000), self.table) for at in range(0, len(units), 40_000)]
        return np.maximum(LOWEST, np.concatenate([np.zeros(0), *parts]) + self.offset)

    def summary(self, text: pa.Array) -> np.ndarray:
        """Of each row, a smooth maximum of its units: somewhat above the highest if several are as high."""
        units, rows = spelled(*split_words(text))
        codes, names = encoded(units)
        values = self.units(names)[codes]
        top = np.full(len(text), LOWEST)
        np.maximum.at(top, rows, values)
        more = np.bincount(rows, np.exp(SHARP * (values - top[rows])), len(text))
        return top + np.log(np.maximum(more, 1.0)) / SHARP

    def scores(self, text: pa.Array) -> np.ndarray:
        slope, level = self.logistic
        return 1 / (1 + np.exp(-np.clip(slope * self.summary(text) + level, -50, 50)))


def _suspicious(names: pa.Array, codes: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each unit, the surest of its letter runs: a lower bound of the log odds that toxic documents have it."""
    held = np.unique(rows * len(names) + codes)
    doc, unit = held // len(names), held % len(names)
    parts = []
    for base in range(0, len(names), 40_000):
        code, of = symbols(names.slice(base, 40_000))
        runs = np.zeros(max(0, len(code) - RUN + 1), np.int64)
        whole = np.ones(len(runs), bool)
        for k in range(RUN):
            part = code[k : k + len(runs)]
            runs, whole = runs * SYMBOLS + part, whole & (part > 0)
        at = np.flatnonzero(whole & (of[: len(runs)] == of[RUN - 1 :]))
        parts.append((runs[at], (of[at] + base).astype(np.int32)))
    kinds, run = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    run, by_unit = run.astype(np.int32), np.concatenate([p[1] for p in parts])  # ascending
    del parts
    n_runs = np.bincount(by_unit, minlength=len(names))
    first = np.cumsum(n_runs) - n_runs
    pos, neg = np.full(len(kinds), 0.5), np.full(len(kinds), 0.5)
    for some in np.split(np.arange(len(held)), np.searchsorted(doc, np.arange(STEP, doc[-1] + 1, STEP))):
        n = n_runs[unit[some]]
        spots = np.repeat(first[unit[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(doc[some], n) * len(kinds) + run[spots])
        with_run = toxic[pairs // len(kinds)]
        pos += np.bincount((pairs % len(kinds))[with_run], minlength=len(kinds))
        neg += np.bincount((pairs % len(kinds))[~with_run], minlength=len(kinds))
    odds = np.log(pos / (toxic.sum() + 1)) - np.log(neg / ((~toxic).sum() + 1)) - 1.5 * np.sqrt(1 / pos + 1 / neg)
    best = np.full(len(names), -9.0)
    np.maximum.at(best, by_unit, odds[run])
    return best


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by Newton steps; the last weight is the offset."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-8
    for _ in range(30):
        inside = y * (x @ w) < 1
        z, v = x[inside], weight[inside, None]
        new = np.linalg.solve(keep + (z * v).T @ z, z.T @ (y[inside] * v[:, 0]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2e-3) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(text: pa.Array, toxic: np.ndarray) -> Model:
    """The machine of labelled texts."""
    if not toxic.any() or toxic.all():
        return Model()
    units, rows = spelled(*split_words(text))
    codes, names = encoded(units)
    if not len(names):
        return Model()
    odds = _suspicious(names, codes, rows, toxic)
    held = np.unique(rows * len(names) + codes)
    del units, codes, rows
    in_toxic = np.bincount(held % len(names), toxic[held // len(names)], len(names))
    in_clean = np.bincount(held % len(names), minlength=len(names)) - in_toxic
    bad = np.flatnonzero((odds > 1.5) & (in_toxic > in_clean))
    if not len(bad):
        return Model()
    bad = bad[np.lexsort((bad, -in_toxic[bad]))][:2000]
    good = np.flatnonzero((in_clean > 0) & ~np.isin(np.arange(len(names)), bad))
    good = good[np.lexsort((good, -in_clean[good]))]
    chosen = np.unique(np.concatenate([good[:1500], good[:: max(1, len(good) // 4500)]]))
    model = Model()
    for _ in range(ROUNDS):
        model = _fold(names, bad, chosen, in_toxic)
        worst = good[np.argsort(-model.units(names.take(pa.array(good))), kind="stable")[:400]]
        chosen = np.union1d(chosen, worst)
    x = np.concatenate([model.summary(text.slice(at, 500)) for at in range(0, len(text), 500)])
    found = ~toxic | (x > np.quantile(x[~toxic], EXPLAINED))
    slope, level = _logistic(x[found, None], toxic[found].astype(float)).tolist()
    model.logistic = (slope, level)
    return model


def _fold(names: pa.Array, bad: np.ndarray, good: np.ndarray, in_toxic: np.ndarray) -> Model:
    half = LANDMARKS // 2
    marks = np.concatenate([bad[:half], good[:: max(1, len(good) // (LANDMARKS - half))][: LANDMARKS - half]])
    basis, used, place = features(names.take(pa.array(marks)))
    values, vectors = np.linalg.eigh((basis.T @ basis).astype(np.float64))
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    trained = np.concatenate([bad, good])
    x = raw(names.take(pa.array(trained)), basis, place) @ root
    y = np.where(np.arange(len(trained)) < len(bad), 1.0, -1.0)
    weight = np.where(y > 0, in_toxic[trained], 1.0)
    weight = np.where(y > 0, weight / weight[y > 0].sum(), 1 / (y < 0).sum())
    w = _machine(x, y, weight)
    table = np.zeros(SYMBOLS**3, np.float32)
    table[used] = basis[:-1] @ (root @ w[:-1]).astype(np.float32)
    return Model(table, float(w[-1]))


def sampled(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, most_bytes: int = SAMPLE_BYTES, longest: int = LONGEST) -> DataFrame:
    """doc_id, text and toxic of the labelled documents that are trained on."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.pmod(_crc("doc_id"), F.lit(3)) != 1).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    fit_in = docs.select("doc_id", "text").where("doc_id IS NOT NULL").where(F.octet_length("text") <= longest)
    known = known.join(fit_in.select("doc_id").distinct(), "doc_id", "left_semi")
    order = _order()
    taken = known.where("toxic").orderBy(order, "doc_id").limit(toxic).unionByName(known.where("NOT toxic").orderBy(order, "doc_id").limit(clean))
    rows = fit_in.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # at most toxic + clean rows
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("doc_id", "text", "toxic")


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, most_bytes: int = SAMPLE_BYTES, longest: int = LONGEST) -> pa.Table:
    """text and toxic of the labelled documents that are trained on, in their order."""
    return sampled(docs, labels, toxic, clean, most_bytes, longest).orderBy(_order(), "doc_id").select("text", "toxic").toArrow()


def _order() -> Column:
    return F.xxhash64("doc_id")


def _crc(column: str) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def scored(docs: DataFrame, model: Model, carry: str | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; carry: all columns of ``docs`` and the score by this name instead."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = bounded(docs)
    held_out = F.col("doc_id").isNotNull() & (F.pmod(_crc("doc_id"), F.lit(3)) == 1)
    frame = docs if carry else docs.select("doc_id", "text", held_out.alias("held_out"))
    name = carry or "score"
    kept = docs.columns if carry else ["doc_id", "held_out"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            scores = pa.array(shared.value.scores(rows.column("text")))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), scores], [*kept, name])

    fields = [f for f in frame.schema.fields if f.name in kept]
    made = frame.mapInArrow(score, StructType(fields).add(name, DoubleType()))
    return made if carry else made.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of the machine of all rows (text, toxic)."""
    if held := [b for b in batches if b.num_rows]:
        rows = pa.Table.from_batches(held)
        held.clear()
        text, toxic = rows["text"].combine_chunks(), rows["toxic"].to_numpy().astype(bool)
        del rows
        model = fit(text, toxic)
        del text
        parts = [model.table.tobytes(), model.offset, *model.logistic]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in parts], ["weights", "offset", "slope", "level"])
    release()


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The machine of the sample; one task fits it, so neither the texts nor the work reach the driver."""
    rows = bounded(sampled(docs, labels)).repartition(1).sortWithinPartitions(_order(), "doc_id")
    for m in rows.select("text", "toxic").mapInArrow(learnt, "weights binary, offset double, slope double, level double").collect():
        return Model(np.frombuffer(m.weights, np.float32), m.offset, (m.slope, m.level))
    return Model()


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text); labels: doc_id, toxic."""
    return scored(docs, trained(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    (name,) = fresh(docs, "score")
    return scored(docs, trained(docs, labels), carry=name).where(F.col(name) < threshold).drop(name)
