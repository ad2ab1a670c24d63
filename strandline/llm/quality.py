"""Document quality from a linear-chain conditional random field that labels every line good or bad."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import Texts, chunks, tidy, words

#: Bounds of the training sample: labelled documents, and lines of all of them.
SAMPLE_ROWS = 3000
SAMPLE_LINES = 200_000
THRESHOLD = 0.3

NAMES = (
    "length", "words", "letters", "capitals", "digits", "spaces", "stops", "loud", "bars", "symbols", "beyond_ascii",
    "word_length", "same_as_last_word", "seen_in_line", "short", "line_seen",
)
OWN = len(NAMES)
#: A line's features, those of the line before and after it, and a constant.
FEATURES = 3 * OWN + 1

_CLASSES = {
    "letters": [*range(65, 91), *range(97, 123), *range(0x80, 0x100)], "capitals": [*range(65, 91)], "digits": [*range(48, 58)], "spaces": [0x20, 9, 11, 12, 13],
    "stops": [*b".,;:?'\"()-"], "loud": [*b"!"], "bars": [*b"|"], "symbols": [*b"*$&%#@^~=_<>{}[]\\/+"], "beyond_ascii": [*range(0x80, 0x100)],
}
_IS = {k: np.isin(np.arange(256), v).astype(np.int32) for k, v in _CLASSES.items()}


def lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of all lines; lines are what line feeds separate, so every text has one at least."""
    feeds = np.flatnonzero(texts.data == 10)
    # A text starts where its offset is; a line that starts behind a feed belongs to the text of that feed.
    of_feed = texts.doc_of(feeds)
    key_doc = np.concatenate([np.arange(len(texts)), of_feed])
    key_at = np.concatenate([texts.offsets[:-1], feeds + 1])
    order = np.lexsort((key_at, key_doc))
    start, doc = key_at[order], key_doc[order]
    end = np.empty_like(start)
    end[:-1] = np.where(doc[1:] == doc[:-1], start[1:] - 1, texts.offsets[doc[:-1] + 1])
    end[-1:] = texts.offsets[doc[-1:] + 1]
    return start, end, doc


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of FEATURES numbers, document, bytes) of all lines, in order. Sums over lines come from running sums."""
    start, end, doc = lines(texts)
    n = len(start)
    size = (end - start).astype(np.float64)
    safe = np.maximum(size, 1)
    own = np.zeros((n, OWN))
    own[:, 0] = np.log1p(size) / 5
    for k, name in enumerate(NAMES):
        if name in _IS:
            total = np.zeros(len(texts.data) + 1, np.int32)
            np.cumsum(_IS[name][texts.data], out=total[1:])
            own[:, k] = (total[end] - total[start]) / safe
    first, last, hashed = words(texts)
    if len(first):
        line = np.searchsorted(start, first, side="right") - 1
        # Empty texts start where others do; searchsorted finds the last of them, which holds the word.
        count = np.bincount(line, minlength=n).astype(np.float64)
        some = np.maximum(count, 1)
        sizes = (last - first).astype(np.float64)
        again = np.zeros(len(first))
        again[1:] = (hashed[1:] == hashed[:-1]) & (line[1:] == line[:-1])
        order = np.lexsort((hashed, line))
        twin = np.zeros(len(first))
        twin[1:] = (hashed[order][1:] == hashed[order][:-1]) & (line[order][1:] == line[order][:-1])
        own[:, 1] = np.log1p(count) / 4
        own[:, NAMES.index("word_length")] = np.bincount(line, sizes, n) / some / 8
        own[:, NAMES.index("same_as_last_word")] = np.bincount(line, again, n) / some
        own[:, NAMES.index("seen_in_line")] = np.bincount(line[order], twin, n) / some
        own[:, NAMES.index("short")] = np.bincount(line, sizes <= 2, n) / some
        with np.errstate(over="ignore"):
            rank = np.arange(len(first)) - np.searchsorted(line, line)
            sums = np.zeros(n, np.uint64)
            np.add.at(sums, line, hashed * (2 * rank.astype(np.uint64) + np.uint64(1)))
        order = np.lexsort((np.arange(n), sums, doc))
        seen = np.zeros(n)
        seen[order[1:]] = (sums[order][1:] == sums[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (sums[order][1:] != 0)
        own[:, NAMES.index("line_seen")] = seen
    same = (doc[1:] == doc[:-1])[:, None]
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1] * same
    out[:-1, 2 * OWN : 3 * OWN] = own[1:] * same
    out[:, -1] = 1
    return out, doc, size


# ---- the field ----


@dataclass
class LineField:
    """Weights of a two-label chain: `emit` scores label good against bad by features, `move[a, b]` a step from a to b;
    shift and scale turn the documents' mean marginals into scores."""

    mean: np.ndarray
    deviation: np.ndarray
    emit: np.ndarray
    move: np.ndarray
    shift: float = 0.0
    scale: float = 1.0

    def potentials(self, rows: np.ndarray) -> np.ndarray:
        """Log potentials (n, 2) of the labels bad and good."""
        x = (rows - self.mean) / self.deviation @ self.emit
        return np.stack([np.zeros_like(x), x], axis=1)

    def marginals(self, rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """P(line is good), by forward and backward sums over each document's chain. rows are in order of doc."""
        own = self.potentials(rows)
        at, length = np.unique(doc, return_index=True, return_counts=True)[1:]
        ahead, behind, _ = chain_sums(own, self.move, at, length)
        joint = ahead + behind
        return 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -500, 500)))

    def scores(self, rows: np.ndarray, doc: np.ndarray, size: np.ndarray, docs: int) -> np.ndarray:
        """Scores of documents 0 .. docs - 1: marginals weighted by length (a line counts one more than its bytes), calibrated."""
        weight = size + 1
        good = np.bincount(doc, self.marginals(rows, doc) * weight, docs) / np.maximum(np.bincount(doc, weight, docs), 1e-9)
        return self.calibrated(good)

    def calibrated(self, good: np.ndarray) -> np.ndarray:
        p = np.clip(good, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.shift + self.scale * np.log(p / (1 - p)))))


def chain_sums(own: np.ndarray, move: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward with own potential, backward without it, log normaliser per chain); chains run side by side, longest first."""
    ahead, behind = own.copy(), np.zeros_like(own)
    order = np.argsort(-length, kind="stable")
    at, length = at[order], length[order]
    most = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, most + 1), side="right")  # chains with more than k lines
    for k in range(1, most):
        i = at[: active[k]] + k
        p = ahead[i - 1]
        ahead[i, 0] += np.logaddexp(p[:, 0] + move[0, 0], p[:, 1] + move[1, 0])
        ahead[i, 1] += np.logaddexp(p[:, 0] + move[0, 1], p[:, 1] + move[1, 1])
    for k in range(most - 1, 0, -1):
        i = at[: active[k]] + k
        q = behind[i] + own[i]
        behind[i - 1, 0] = np.logaddexp(q[:, 0] + move[0, 0], q[:, 1] + move[0, 1])
        behind[i - 1, 1] = np.logaddexp(q[:, 0] + move[1, 0], q[:, 1] + move[1, 1])
    last = ahead[at + length - 1]
    z = np.empty(len(at))
    z[order] = np.logaddexp(last[:, 0], last[:, 1])
    return ahead, behind, z


def fit(rows: np.ndarray, doc: np.ndarray, size: np.ndarray, good: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> LineField:
    """Weights that make the documents' labels likely, where each line has its document's label.

    Batch gradient steps with adaptive rates on the mean log-likelihood per line, each document counting as one; the
    gradient is observed minus expected features and steps, the latter by forward-backward. rows are in order of doc,
    0 .. len(good) - 1. The calibration is a logistic regression on the same documents.
    """
    mean, deviation = rows.mean(0), rows.std(0)
    mean[-1], deviation[deviation < 1e-6] = 0, 1
    deviation[-1] = 1
    x = ((rows - mean) / deviation).astype(np.float64)
    at, length = np.unique(doc, return_index=True, return_counts=True)[1:]
    y = good[doc].astype(np.float64)
    weight = (1 / length)[doc] / len(good)
    inner = np.ones(len(doc), bool)
    inner[at] = False
    i = np.flatnonzero(inner)
    field = LineField(mean, deviation, np.zeros(x.shape[1]), np.zeros((2, 2)))
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[doc[i]].astype(int), good[doc[i]].astype(int)), weight[i])
    m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for t in range(1, rounds + 1):
        score = x @ field.emit
        own = np.stack([np.zeros_like(score), score], axis=1)
        ahead, behind, z = chain_sums(own, field.move, at, length)
        joint = ahead + behind
        p = 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -500, 500)))
        steps = np.zeros((2, 2))
        zz = z[doc[i]]
        for a in (0, 1):
            for b in (0, 1):
                steps[a, b] = (weight[i] * np.exp(np.minimum(0, ahead[i - 1, a] + field.move[a, b] + own[i, b] + behind[i, b] - zz))).sum()
        g = np.concatenate([x.T @ (weight * (y - p)) - ridge * field.emit, (seen - steps - ridge * field.move).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        field.emit = field.emit + step[:-4]
        field.move = field.move + step[-4:].reshape(2, 2)
    raw = np.bincount(doc, field.marginals(rows, doc) * (size + 1), len(good)) / np.bincount(doc, size + 1, len(good))
    p = np.clip(raw, 1e-6, 1 - 1e-6)
    u = np.log(p / (1 - p))
    a, b = 0.0, 0.1
    for _ in range(50):  # Newton steps
        q = 1 / (1 + np.exp(-(a + b * u)))
        w = np.maximum(q * (1 - q), 1e-9)
        h = np.array([[w.sum() + 1e-2, (w * u).sum()], [(w * u).sum(), (w * u * u).sum() + 1e-2]])
        d = np.linalg.solve(h, [(good - q).sum() - 1e-2 * a, (u * (good - q)).sum() - 1e-2 * b])
        a, b = a + d[0], b + d[1]
        if np.abs(d).max() < 1e-6:
            break
    field.shift, field.scale = float(a), float(max(b, 1e-3))
    return field


# ---- tables ----


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the decimal doc_id is divisible by 5: such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_lines: int = SAMPLE_LINES) -> LineField | None:
    """A field from at most `rows` labelled documents that are not held out, those whose hashed doc_id is least, with all of
    their lines, as long as these are at most `most_lines` together: in the order of the hashes a document that would
    exceed that is passed over (a row that repeats one counts again).

    The ids are bounded by `rows` and so are broadcast; what is collected is bounded by both (FEATURES numbers a line). A
    doc_id that is labelled more than once has its least label. None if there is no labelled document.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    ids = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    text = common.written(text, "labelled_texts")
    counted = text.groupBy(F.xxhash64("doc_id").alias("h"), "doc_id").agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    taken, total = [], 0
    for r in counted.orderBy("h", "doc_id").limit(rows).collect():
        if total + r.lines <= most_lines:
            taken.append(r.doc_id)
            total += r.lines
    if not taken:
        return None
    sample = text.where(F.col("doc_id").isin(taken)).select("doc_id", "quality", "text")
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def run(batches):
        for b in batches:
            for t in chunks(b["text"]):
                x, doc, size = features(t)
                for k in range(len(t)):
                    a, z = np.searchsorted(doc, [k, k + 1])
                    yield pa.RecordBatch.from_arrays(
                        [b["doc_id"].slice(t.first + k, 1), b["quality"].cast(pa.int32()).slice(t.first + k, 1), pa.array([x[a:z].astype("<f4").tobytes()], pa.binary()), pa.array([size[a:z].astype("<f8").tobytes()], pa.binary())],
                        ["doc_id", "quality", "rows", "size"],
                    )

    for r in sorted(sample.mapInArrow(tidy(run), "doc_id long, quality int, rows binary, size binary").collect(), key=lambda r: (r.doc_id, r.rows)):
        x, size = np.frombuffer(r.rows, "<f4").reshape(-1, FEATURES), np.frombuffer(r.size, "<f8")
        parts.append((x, np.full(len(x), len(parts)), size, np.array([r.quality == 1])))
    if not parts:
        return None
    return fit(*(np.concatenate(p) for p in zip(*parts)))


def score_documents(documents: DataFrame, field: LineField | None) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, score in 0 to 1.

    Null texts are empty; an empty text is one empty line. Without a field every score is 0.5. Texts are scored where they
    are read, in groups of a few MB; nothing is shuffled and other columns are not read.
    """
    sent = field

    def run(batches):
        for b in batches:
            out = [np.zeros(0)]
            for t in chunks(b["text"]):
                if sent is None:
                    out.append(np.full(len(t), 0.5))
                else:
                    out.append(sent.scores(*features(t), len(t)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.concatenate(out), pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents without those whose score is below the threshold; all columns and repeated rows stay as they are."""
    field = train(documents, labels)
    schema = documents.schema

    def run(batches):
        for b in batches:
            keep = [np.zeros(0, bool)]
            for t in chunks(b["text"]):
                keep.append(np.ones(len(t), bool) if field is None else field.scores(*features(t), len(t)) >= threshold)
            yield b.filter(pa.array(np.concatenate(keep)))

    return documents.mapInArrow(tidy(run), schema)

