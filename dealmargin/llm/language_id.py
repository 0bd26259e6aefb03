"""Language ID: a byte convolutional network trained and applied in numpy.

Filters of several widths slide over windows of WINDOW bytes; each filter keeps
its largest response in the window (max pooling), and a softmax layer turns
these into language scores. A document is cut into windows from end to end and
takes the mean of its windows' logits, weighted by their bytes.

The network is fitted on the driver on a sample bounded by SAMPLE_WINDOWS;
everything else runs in the tasks over all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_WINDOWS = 16_000  # training windows of all languages together, in expectation
WINDOWS_PER_ROW = 4
EPOCHS = 6
BATCH = 256
RATE = 0.01
UNDETERMINED = "und"
_CHUNK = 64
_LETTER = regex.compile(r"\p{L}")


def windows_of(text: bytes) -> np.ndarray:
    """The whole text as rows of WINDOW bytes, A-Z in lower case, the last one filled with 0."""
    count = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(
        text.lower().ljust(count * WINDOW, b"\0"), dtype=np.uint8
    ).reshape(count, WINDOW)


@dataclass
class ByteNetwork:
    """filters[width] has the shape (width, 256, FILTERS), output (features + 1, languages)."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    output: np.ndarray

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        """Every filter of a width at every place of some windows."""
        length = x.shape[1] - width + 1
        total = self.filters[width][0][x[:, :length]]
        for j in range(1, width):
            total += self.filters[width][j][x[:, j : j + length]]
        return total

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Each width's filters as tables over two bytes at a time, the last one maybe over one."""
        out = {}
        for width, w in self.filters.items():
            pairs = [
                (w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, -1)
                for j in range(0, width - 1, 2)
            ]
            out[width] = pairs + ([w[width - 1]] if width % 2 else [])
        return out

    def logits(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Logits of each window, a few windows at a time so that responses stay in cache."""
        out = np.empty((len(x), len(self.languages)))
        for at in range(0, len(x), _CHUNK):
            part = x[at : at + _CHUNK].astype(np.intp)
            pairs = (part[:, :-1] << 8) | part[:, 1:]
            pooled = []
            for width, steps in tables.items():
                length = WINDOW - width + 1
                total = steps[0].take(pairs[:, :length], axis=0)
                for i, table in enumerate(steps[1:], 1):
                    source = pairs if len(table) > 256 else part
                    total += table.take(source[:, 2 * i : 2 * i + length], axis=0)
                pooled.append(total.max(axis=1))
            features = np.maximum(np.concatenate(pooled, axis=1), 0)
            out[at : at + _CHUNK] = features @ self.output[:-1] + self.output[-1]
        return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(x: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> ByteNetwork:
    """Cross-entropy by Adam. A maximum passes its gradient to one place alone, so bytes are
    never expanded: each step touches width rows of each filter and window."""
    rng = np.random.default_rng(seed)
    size = FILTERS * len(WIDTHS)
    net = ByteNetwork(
        languages,
        {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.vstack([rng.normal(0, 0.3, (size, len(languages))), np.zeros(len(languages))]).astype(
            np.float32
        ),
    )
    weight = len(labels) / (len(languages) * np.bincount(labels, minlength=len(languages)))
    values = [*(net.filters[w] for w in WIDTHS), net.output]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            part, want = x[chosen].astype(np.intp), labels[chosen]
            rows = np.arange(len(chosen))
            places, pooled = {}, []
            for w in WIDTHS:
                out = net.responses(part, w)
                places[w] = out.argmax(axis=1)
                pooled.append(np.take_along_axis(out, places[w][:, None, :], axis=1)[:, 0])
            features = np.maximum(np.concatenate(pooled, axis=1), 0)
            slope = softmax(features @ net.output[:-1] + net.output[-1])
            slope[rows, want] -= 1
            slope *= (weight[want] / len(chosen))[:, None]
            back = (slope @ net.output[:-1].T) * (features > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                grad = np.zeros_like(net.filters[w])
                own = back[:, i * FILTERS : (i + 1) * FILTERS].astype(np.float32)
                for j in range(w):
                    found = part[rows[:, None], places[w] + j]
                    np.add.at(grad[j], (found, np.arange(FILTERS)[None, :]), own)
                grads.append(grad)
            grads.append(np.vstack([features.T @ slope, slope.sum(axis=0)]).astype(np.float32))
            step += 1
            for v, (m, s), g in zip(values, moments, grads, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def sampled_windows(
    labelled: DataFrame, lang_column: str, text_column: str, key: Column, windows: int
) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Training windows, the number of their language each, and the languages.

    Rows are chosen by a hash, as many of each language in expectation; each
    gives at most WINDOWS_PER_ROW windows, spread over its text. The sample
    doesn't depend on partitions or their order.
    """
    rows = labelled.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_column).count().collect()}
    languages = sorted(counts)
    if not languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = windows / (len(languages) * WINDOWS_PER_ROW)
    limits = labelled.sparkSession.createDataFrame(
        [(code, min(1.0, share / n)) for code, n in counts.items()], "_code string, _share double"
    )
    part = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), key), 11) / F.lit(float(1 << 53))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, found = [], []
            for code, text in zip(batch.column(0), batch.column(1), strict=True):
                own = windows_of(text.as_py().encode())
                for i in range(min(WINDOWS_PER_ROW, len(own))):
                    at = i * len(own) // min(WINDOWS_PER_ROW, len(own))
                    codes.append(code.as_py())
                    found.append(own[at].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes, pa.string()), pa.array(found, pa.binary())], ["code", "window"]
            )

    sample = (
        rows.withColumn("_part", part)
        .join(F.broadcast(limits), F.col(lang_column) == F.col("_code"))  # one row a language
        .where(F.col("_part") < F.col("_share"))
        .select(lang_column, text_column)
        .mapInArrow(cut, "code string, window binary")
        .toArrow()
    )
    pairs = sorted(zip(sample["code"].to_pylist(), sample["window"].to_pylist(), strict=True))
    numbers = {code: i for i, code in enumerate(languages)}
    x = np.frombuffer(b"".join(w for _, w in pairs), dtype=np.uint8).reshape(-1, WINDOW)
    return x, np.array([numbers[c] for c, _ in pairs], dtype=np.int64), languages


def fit(
    labelled: DataFrame,
    key: Column,
    lang_column: str = "lang",
    text_column: str = "text",
    windows: int = SAMPLE_WINDOWS,
) -> ByteNetwork | None:
    """A network for the languages of the labelled rows; None if none has a language and a text."""
    x, labels, languages = sampled_windows(labelled, lang_column, text_column, key, windows)
    present = sorted(set(labels.tolist()))
    if not present:
        return None
    renumbered = np.searchsorted(present, labels)
    return train(x, renumbered, [languages[i] for i in present])


def predict(
    docs: DataFrame,
    network: ByteNetwork | None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: its id, lang_pred and score, the softmax of the mean logits.

    NULL texts and texts without a letter are 'und' with score 0, as is every
    row where nothing could be learned. Nothing but the text is read; other
    columns are left aside. Repeated rows are judged alike; no rows give no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else {}
        for batch in batches:
            codes = [UNDETERMINED] * batch.num_rows
            scores = [0.0] * batch.num_rows
            for i, text in enumerate(batch.column(1)):
                body = text.as_py()
                if not network or body is None or not _LETTER.search(body):
                    continue
                raw = body.encode("utf-8", "surrogatepass")
                logits = network.logits(windows_of(raw), tables)
                length = np.full(len(logits), float(WINDOW))
                length[-1] = len(raw) - WINDOW * (len(logits) - 1)
                chances = softmax(length @ logits / length.sum())
                best = int(chances.argmax())
                codes[i], scores[i] = network.languages[best], float(chances[best])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codes, pa.string()), pa.array(scores, pa.float64())],
                ["_id", "lang_pred", "score"],
            )

    return (
        docs.select(F.col(id_column).alias("_id"), text_column)
        .mapInArrow(each, f"_id {kind}, lang_pred string, score double")
        .withColumnRenamed("_id", id_column)
    )
