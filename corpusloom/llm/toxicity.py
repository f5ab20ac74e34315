"""Toxicity of texts by a convolutional classifier trained in numpy (operator 11).

Words are hashed to embeddings; filters of one, two and three words run over the
whole text, and the most that each filter finds anywhere (max pooling) goes into
a logistic output. It is trained by Adam on a bounded sample of labelled rows,
``SAMPLE`` of each label drawn by a digest of their id, texts of over
``LONGEST`` words left out of the sample. A quarter of the sample is not trained
on: on it a threshold is chosen for each language, and scores are shifted so
that 0.5 is that threshold. The language of a text is found from its own hashed
words; what a row declares is only what this is learnt from. So labels, lang,
source and doc_id are no inputs of a score.

How it scales: labels are grouped and drawn before they meet the documents, by
a broadcast of at most two samples of ids; the model has a fixed size (2 MB), is
trained on the driver from word buckets of the sample, and goes to all tasks,
which read every text once, whole, in pieces of ``PIECE`` words.

Cases: a null or empty text has the score of no finding; a row without label is
scored all the same; labels that differ for one doc_id count as toxic, null
ones as none; without any label of either kind all scores are 0; a null doc_id
has the empty text's digest; repeated rows get equal scores; an empty table
gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import ONE, spans

#: Sampled rows of each label; words of the longest sampled text; least rows of a language (and of each label in it) with a threshold of its own.
SAMPLE, LONGEST, OWN = 5000, 4000, 20
#: Buckets of words, numbers of an embedding, filters of each width, widths.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 4, 32, 0.01, 1e-4
#: Words of a bucket that fewer sampled texts have say nothing: they would be learnt by heart.
SEEN = 5
#: Words that a task runs the filters over at a time; bytes that it cuts into words at a time.
PIECE, BYTES = 1 << 16, 1 << 21
PAD = BUCKETS

#: A-Z become lower case; other ASCII signs than letters separate words.
SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def buckets(data: bytes) -> np.ndarray:
    """The bucket of each word of a text in UTF-8."""
    out = []
    at = 0
    while at < len(data):
        end = min(len(data), at + BYTES)
        # A cut moves on to the next sign, so no word is cut.
        while end < len(data) and SIGNS[data[end]] != 32:
            end += 1
        letters = np.frombuffer(data[at:end].translate(SIGNS), np.uint8)
        starts, ends = spans(letters != 32)
        out.append((ONE.of(letters, starts, ends) >> np.uint64(49)).astype(np.int32))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass
class Model:
    """Embeddings with a zero row for padding, filters by width and word, their offsets, the output, and languages with their thresholds."""

    embeddings: np.ndarray
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    output: np.ndarray
    bias: float
    langs: np.ndarray
    thresholds: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """What each word adds to the filters at each place: a filter over words is then a sum of rows."""
        return [[self.embeddings @ f[o] for o in range(len(f))] for f in self.filters]


def pooled(model: Model, tables, ids: list[np.ndarray]) -> np.ndarray:
    """For each text the most that each filter finds, 0 at least."""
    out = np.zeros((len(ids), FILTERS * len(WIDTHS)), np.float32)
    most = max(WIDTHS) - 1
    parts: list[np.ndarray] = []
    owners: list[int] = []

    def run() -> None:
        row = np.concatenate(parts)
        # A piece's last words are padding or the next piece's first ones, and begin nothing.
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        for k, of in enumerate(tables):
            found = of[0][row]
            for o in range(1, len(of)):
                found[:-o] += of[o][row[o:]]
            for p, owner, at in zip(parts, owners, starts):
                best = found[at : at + len(p) - most].max(0) + model.offsets[k]
                view = out[owner, k * FILTERS : (k + 1) * FILTERS]
                np.maximum(view, best, out=view)

    size = 0
    for i, words in enumerate(ids):
        for at in range(0, len(words), PIECE):
            part = words[at : at + PIECE + most]
            short = most - max(0, len(words) - at - PIECE)
            parts.append(np.concatenate([part, np.full(short, PAD, np.int32)]) if short > 0 else part)
            owners.append(i)
            size += len(part)
            if size >= PIECE:
                run()
                parts, owners, size = [], [], 0
    if parts:
        run()
    return out


def languages(model: Model, ids: list[np.ndarray]) -> np.ndarray:
    """For each text the number of the language that its words fit best."""
    return np.array([int(model.langs[words].sum(0, dtype=np.float64).argmax()) if len(words) else 0 for words in ids], np.int64)


def logits(model: Model, tables, ids: list[np.ndarray]) -> np.ndarray:
    return pooled(model, tables, ids) @ model.output + model.bias


def scores(model: Model, tables, ids: list[np.ndarray]) -> np.ndarray:
    z = logits(model, tables, ids) - model.thresholds[languages(model, ids)]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _trained(ids: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """The network after EPOCHS over the texts; the filters' greatest places alone are corrected, as max pooling asks."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    e = normal(BUCKETS + 1, DIM, scale=0.1)
    seen = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=BUCKETS + 1) >= SEEN
    seen[PAD] = False
    e[~seen] = 0
    filters = [normal(w, DIM, FILTERS, scale=(w * DIM) ** -0.5) for w in WIDTHS]
    offsets = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    output = normal(FILTERS * len(WIDTHS), scale=0.1)
    bias = np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1))], np.float32)
    whole = [*filters, *offsets, output, bias]
    first, second = [np.zeros_like(p) for p in whole], [np.zeros_like(p) for p in whole]
    rows1, rows2 = np.zeros_like(e), np.zeros_like(e)
    most, step = max(WIDTHS) - 1, 0
    padded = [np.concatenate([x, np.full(most, PAD, np.int32)]) for x in ids]
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for begin in range(0, len(order), BATCH):
            batch = order[begin : begin + BATCH]
            grads = [np.zeros_like(p) for p in whole]
            touched: list[np.ndarray] = []
            given: list[np.ndarray] = []
            row = np.concatenate([padded[i] for i in batch])
            vectors = e[row]
            maps = []
            for f in filters:
                found = vectors @ f[0]
                for o in range(1, len(f)):
                    found[:-o] += vectors[o:] @ f[o]
                maps.append(found)
            at = 0
            for i in batch:
                n = len(ids[i])
                if n:
                    places = [m[at : at + n].argmax(0) + at for m in maps]
                    top = [m[p, np.arange(FILTERS)] + b for m, p, b in zip(maps, places, offsets)]
                else:
                    places, top = [], [np.zeros(FILTERS, np.float32)] * len(maps)
                hidden = np.maximum(0, np.concatenate(top))
                z = float(hidden @ output + bias[0])
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(batch)
                grads[-2] += g * hidden
                grads[-1] += g
                back = (g * output * (hidden > 0)).astype(np.float32)
                for k, p in enumerate(places):
                    own = back[k * FILTERS : (k + 1) * FILTERS]
                    grads[len(WIDTHS) + k] += own
                    for o in range(WIDTHS[k]):
                        grads[k][o] += vectors[p + o].T * own
                        touched.append(row[p + o])
                        given.append((filters[k][o] * own).T)
                at += n + most
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, a, b in zip(whole, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * a / (np.sqrt(b) + 1e-8)
            if touched:
                words, where = np.unique(np.concatenate(touched), return_inverse=True)
                g = np.zeros((len(words), DIM), np.float32)
                np.add.at(g, where, np.concatenate(given))
                g += DECAY * e[words]
                rows1[words] += 0.1 * (g - rows1[words])
                rows2[words] += 0.001 * (g * g - rows2[words])
                e[words] -= (rate * rows1[words] / (np.sqrt(rows2[words]) + 1e-8)) * seen[words, None]
    return Model(e, filters, offsets, output, float(bias[0]), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32))


def _cutoff(z: np.ndarray, y: np.ndarray) -> float:
    """The logit at which precision and recall together (F1) are best, in the middle of a gap; of equal ones the highest."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[1:] == z[:-1]] = -1
    at = int(f1.argmax())
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at])


def fit(ids: list[np.ndarray], toxic: np.ndarray, lang: list[str], apart: np.ndarray) -> Model | None:
    """The classifier of labelled texts given as buckets; ``apart`` marks those that thresholds are chosen on. None without both labels."""
    if len(set(toxic[~apart].tolist())) < 2:
        return None
    model = _trained([x for x, a in zip(ids, apart) if not a], toxic[~apart].astype(np.float32))
    names = [k for k in sorted(set(lang)) if k != "" and lang.count(k) >= OWN]
    if names:
        counts = np.full((len(names), BUCKETS), 0.1)
        for x, k in zip(ids, lang):
            if k in names:
                counts[names.index(k)] += np.bincount(x, minlength=BUCKETS)
        model.langs = np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)
    held = [i for i in range(len(ids)) if apart[i]]
    if len(set(toxic[held].tolist())) < 2:
        held = list(range(len(ids)))
    z, y, of = logits(model, model.tables(), [ids[i] for i in held]), toxic[held], languages(model, [ids[i] for i in held])
    every = _cutoff(z, y)
    model.thresholds = np.full(max(1, len(names)), every, np.float32)
    for k in range(len(names)):
        own = of == k
        if min(y[own].sum(), (1 - y[own]).sum()) >= OWN:
            model.thresholds[k] = _cutoff(z[own], y[own])
    return model


def part(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, lang, text) of the bounded sample: labelled rows that aren't held out, those of the smallest digests of each label."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic")).where(part(F.col("doc_id")) != 0)
    draw = lambda label: known.where(F.col("_toxic") == label).orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(sample)
    drawn = draw(0).unionByName(draw(1)).withColumnRenamed("doc_id", "_id")
    return docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", F.col("_toxic").alias("toxic"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The classifier, from the sample's word buckets, which come to the driver: at most ``2 * sample * LONGEST`` numbers."""

    def cut(batches):
        for b in batches:
            ids = [buckets((x or "").encode("utf-8", "replace")) for x in b.column("text").to_pylist()]
            at = [i for i, x in enumerate(ids) if len(x) <= LONGEST]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "toxic", "lang")], pa.array([ids[i].astype("<i2").tobytes() for i in at], pa.binary())], ["doc_id", "toxic", "lang", "ids"])

    rows = labelled(docs, labels, sample)
    kind = dict(rows.dtypes)["doc_id"]
    # Repeated rows of an id count once, so that they don't widen the sample.
    found = rows.mapInArrow(cut, f"doc_id {kind}, toxic int, lang string, ids binary").dropDuplicates(["doc_id"]).withColumn("_draw", F.xxhash64("doc_id")).orderBy("_draw", "doc_id").toArrow()
    ids = [np.frombuffer(x, "<i2").astype(np.int32) for x in found.column("ids").to_pylist()]
    draws = found.column("_draw").to_numpy()
    return fit(ids, found.column("toxic").to_numpy().astype(np.int64), found.column("lang").to_pylist(), draws % 4 == 0) if len(ids) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    held = docs.select(F.col("doc_id"), (part(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    if model is None:
        return held.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def put(batches):
        own = sent.value
        tables = own.tables()
        for b in batches:
            done, size, found = [], 0, []
            for text in b.column("text"):
                done.append(buckets((text.as_py() or "").encode("utf-8", "replace")))
                size += len(done[-1])
                if size >= PIECE:
                    found.append(scores(own, tables, done))
                    done, size = [], 0
            found.append(scores(own, tables, done) if done else np.zeros(0))
            s = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return held.mapInArrow(put, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document scored by a classifier learnt on the labelled ones."""
    return score(docs, learn(docs, labels))
