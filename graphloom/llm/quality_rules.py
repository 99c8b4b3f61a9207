"""Quality rules: base counts, and hashed n-gram logistic regression trained on labelled rows.

The base counts are exact. The model has two heads over hashed n-grams of the whole text. The
quality head sees counts of word unigrams, word bigrams and byte 4-grams, each family
divided by the root of its number of grams. The toxicity head, whose evidence is a few words
anywhere, sees which words and which beginnings of words (5 bytes with the space before
them, lower-cased) occur, with an L1 penalty. Both are fitted by Adam on a bounded sample of
labelled rows (``per_class`` rows of each class, taken by hash), then calibrated on a
fifth of it held out (Platt scaling with the classes' true frequencies as weights). A text
is kept if it passes the base rules, its probability of good quality is at least
``min_quality`` and its probability of being toxic at most ``max_toxic``.

Defined results: a null text has no words and fails. Texts without labels are scored like others.
Without labelled rows of both classes a head has no say (probability null). A null label is
no label; a document labelled twice counts twice in training. Repeated rows get equal rows; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, encode, materialize, mix, other_columns, pieces, windows

BITS = 17
FAMILIES = 3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
REPEAT = 8
#: Hashes of words that a worker remembers; half a million would take it 50 MB more, and no less time.
REMEMBERED = 1 << 15


def base_counts(text: str | None, hashes: Hashes) -> tuple[np.ndarray, int, int, int, int]:
    """Word hashes, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return np.zeros(0, np.uint64), 0, 0, 0, 0
    h = hashes.of(encode(text).split())
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    w = windows(h, REPEAT)
    repeated = 0
    if len(w) > 1:
        ordered = np.sort(w)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            steps = np.zeros(len(h) + 1, np.int64)
            at = np.flatnonzero(np.isin(w, twice))
            np.add.at(steps, at, 1)
            np.add.at(steps, at + REPEAT, -1)
            repeated = int((np.cumsum(steps) > 0).sum())
    return h, chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def quality_features(raw: bytes, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the quality head; a gram that occurs again comes again."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    grams = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24 if len(b) >= 4 else b[:0]
    top = np.uint64(64 - BITS)
    families = [mix(h) >> top, windows(h, 2) >> top, (grams * np.uint32(2654435769)) >> np.uint32(32 - BITS)]
    slots = np.concatenate([x.astype(np.int64) + (i << BITS) for i, x in enumerate(families)])
    return slots, np.concatenate([np.full(len(x), 1 / max(1, len(x)) ** 0.5) for x in families])


def toxic_features(raw: bytes, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and values of the toxicity head."""
    low = raw.lower()
    h = hashes.of(low.split())
    b = np.frombuffer(b" " + low.translate(_BLANK) + b"    ", np.uint8).astype(np.uint64)
    at = np.flatnonzero(b[:-4] == 32)
    grams = sum(b[at + j] << np.uint64(8 * j) for j in range(5))
    top = np.uint64(64 - BITS)
    slots = np.unique(np.concatenate([(mix(h) >> top).astype(np.int64), (mix(grams) >> top).astype(np.int64) + (1 << BITS)]))
    return slots, np.full(len(slots), 4 / max(1, len(h)) ** 0.25)


_BLANK = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


@dataclass
class Head:
    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, slots: np.ndarray, values: np.ndarray) -> float:
        raw = float((self.weights.take(slots) * values).sum())
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -60, 60))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


Row = tuple[np.ndarray, np.ndarray]  # slots (int32) and values (float32)


def blocks(rows: list[Row], most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows a..b with about ``most`` values: a, b, the row (from a) of each value, slots, values."""
    a = n = 0
    for b, row in enumerate(rows, 1):
        n += len(row[0])
        if n >= most or b == len(rows):
            part = rows[a:b]
            yield a, b, np.repeat(np.arange(b - a, dtype=np.int32), [len(r[0]) for r in part]), np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            a, n = b, 0


def fit_head(rows: list[Row], y: np.ndarray, frequency: np.ndarray, steps: int = 50, l1: float = 0.0) -> Head | None:
    """Fit on four of five rows, calibrate on the fifth. frequency: what a row stands for.

    Gradients are summed over blocks of rows, so beside the rows themselves only one block is held.
    """
    if len(set(y.tolist())) < 2:
        return None
    size = FAMILIES << BITS
    held = np.arange(len(rows)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(rows), bool)
    share = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    raw = np.zeros(len(rows))
    for t in range(1, steps + 2):
        g, gb = 1e-5 * w, 0.0
        for start, stop, row, slot, value in blocks(rows):
            raw[start:stop] = np.bincount(row, w[slot] * value, stop - start)
            err = share[start:stop] * (_sigmoid(raw[start:stop] + b) - y[start:stop])
            g += np.bincount(slot, err[row] * value, size)
            gb += err.sum()
        if t > steps:  # the last pass is for raw
            break
        if l1:  # a slope under l1 doesn't move a weight away from 0
            g = np.where(w != 0, g + l1 * np.sign(w), np.sign(g) * np.maximum(np.abs(g) - l1, 0))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 / (1 + t / 40)
        was, w = w, w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        if l1:
            w[was * w < 0] = 0
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    on = held if held.any() else ~held
    a, c = _platt(raw[on] + b, y[on], frequency[on])
    return Head(w.astype(np.float32), a, c + a * b)


def _platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrated log odds, by damped Newton steps on softened labels."""
    positive, negative = weight[y == 1].sum(), weight[y == 0].sum()
    scale = len(y) / weight.sum()
    goal = np.where(y == 1, (positive * scale + 1) / (positive * scale + 2), 1 / (negative * scale + 2))
    p = np.array([1.0, 0.0])
    x = np.stack([raw, np.ones_like(raw)], 1)
    for _ in range(50):
        q = _sigmoid(x @ p)
        g = x.T @ (weight * scale * (q - goal)) + 1e-3 * (p - [1.0, 0.0])
        hess = (x * (weight * scale * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        p = p - np.clip(np.linalg.solve(hess, g), -1, 1)
    return max(float(p[0]), 1e-3), float(p[1])


def sample_labels(labels: DataFrame, per_class: int) -> DataFrame:
    """Up to ``per_class`` labelled rows of each class, by hash, with what each row stands for."""
    found = labels.select(F.col("`doc_id`").alias("doc_id"), F.col("`quality`").cast("int").alias("quality"), F.coalesce(F.col("`toxic`").cast("int"), F.lit(0)).alias("toxic")).where("doc_id is not null and quality in (0, 1)")
    sizes = {(r["quality"], r["toxic"] == 1): r["n"] for r in found.groupBy("quality", (F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    parts = []
    for (quality, toxic), n in sorted(sizes.items()):
        part = found.where((F.col("quality") == quality) & ((F.col("toxic") == 1) == toxic))
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)  # a top-k: no task sees more than its own k
        parts.append(part.withColumn("stands_for", F.lit(n / min(n, per_class))))
    if not parts:
        return found.withColumn("stands_for", F.lit(1.0)).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1000, sample_bytes: int = 256 << 20) -> tuple[Head | None, Head | None]:
    """The quality and the toxicity head, fitted by one executor task.

    The sample is bounded twice: ``per_class`` rows of a class, and of these, in the order of a hash, so many that
    their features take up ``sample_bytes``. Features are a written table; the task keeps them as they are read,
    32 bits a number, and the driver gets the two heads' weights, whose size is fixed.
    """
    sample = sample_labels(labels, per_class)
    rows = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text")).where("text is not null").join(F.broadcast(sample), "doc_id")
    rows = rows.select("text", "quality", "toxic", "stands_for", F.xxhash64("doc_id").alias("turn"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(REMEMBERED)
        for batch in batches:
            for held in pieces([batch], "text"):
                part = pa.Table.from_batches(held)
                out = {c: part[c] for c in ("turn", "quality", "toxic", "stands_for")}
                cells: dict[str, list[bytes]] = {"q_slots": [], "q_values": [], "t_slots": [], "t_values": []}
                for text in part["text"].to_pylist():
                    raw = encode(text)
                    for head, (slots, values) in (("q", quality_features(raw, hashes.of(raw.split()))), ("t", toxic_features(raw, hashes))):
                        used, back = np.unique(slots, return_inverse=True)
                        cells[f"{head}_slots"].append(used.astype(np.int32).tobytes())
                        cells[f"{head}_values"].append(np.bincount(back, values, len(used)).astype(np.float32).tobytes())
                yield from pa.table(out | {c: pa.array(x, pa.binary()) for c, x in cells.items()}).to_batches()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("quality", "toxic", "stands_for")
        known: dict[str, list] = {c: [] for c in names}
        features: dict[str, list[Row]] = {"q": [], "t": []}
        taken = 0
        for batch in batches:
            for i in range(batch.num_rows):
                cells = {c: batch[c][i].as_py() for c in batch.schema.names}
                taken += sum(len(cells[f"{h}_{k}"]) for h in "qt" for k in ("slots", "values"))
                if taken > sample_bytes:
                    continue
                for c in names:
                    known[c].append(cells[c])
                for h in "qt":
                    features[h].append((np.frombuffer(cells[f"{h}_slots"], np.int32), np.frombuffer(cells[f"{h}_values"], np.float32)))
        weight = np.array(known["stands_for"])
        heads = [fit_head(features[h], np.array([int(x == 1) for x in known[label]]), weight, l1=l1) for label, h, l1 in (("quality", "q", 0.0), ("toxic", "t", 6e-3))]
        yield pa.RecordBatch.from_pydict({"heads": pa.array([pickle.dumps([h and (h.weights.tobytes(), h.slope, h.offset) for h in heads])], pa.binary())})

    schema = "turn long, quality int, toxic int, stands_for double, q_slots binary, q_values binary, t_slots binary, t_values binary"
    table = materialize(rows.mapInArrow(run, schema), "features")
    one = table.repartition(1).sortWithinPartitions("turn", "quality", "toxic", "stands_for", F.xxhash64("q_slots", "t_slots"))
    got = one.mapInArrow(fit, "heads binary").first()
    return tuple(h and Head(np.frombuffer(h[0], np.float32), h[1], h[2]) for h in (pickle.loads(got["heads"]) if got else (None, None)))


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_quality double, p_toxic double"


def judge(texts: list[str | None], heads: tuple[Head | None, Head | None], hashes: Hashes, min_quality: float, max_toxic: float) -> dict[str, list]:
    out: dict[str, list] = {c.split()[0]: [] for c in RESULT.split(", ")}
    for text in texts:
        h, chars, symbols, dup, repeat = base_counts(text, hashes)
        failed = base_failed(len(h), repeat)
        raw = encode(text)
        quality = heads[0] and heads[0].probability(*quality_features(raw, h))
        toxic = heads[1] and heads[1].probability(*toxic_features(raw, hashes))
        kept = not failed and (quality is None or quality >= min_quality) and (toxic is None or toxic <= max_toxic)
        for c, x in zip(out, (len(h), chars, symbols, dup, repeat, failed, kept, quality, toxic), strict=True):
            out[c].append(x)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, per_class: int = 1000, min_quality: float = 0.4, max_toxic: float = 0.5) -> DataFrame:
    """``docs`` with the columns of RESULT; like-named columns of ``docs`` give way to them."""
    heads = train(docs, labels, per_class)
    names = [c.split()[0] for c in RESULT.split(", ")]
    kept = other_columns(docs, names)
    source = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(REMEMBERED)
        for held in pieces(batches, "text"):
            part = pa.Table.from_batches(held)
            found = judge(part["text"].to_pylist(), heads, hashes, min_quality, max_toxic)
            arrays = [pa.array(found[c], t) for c, t in zip(names, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2, strict=True)]
            yield from pa.Table.from_arrays([*part.columns, *arrays], [*part.column_names, *names]).combine_chunks().to_batches()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{ddl}, {RESULT}")
