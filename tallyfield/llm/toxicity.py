"""Toxicity by compression distance with two zstandard dictionaries.

One dictionary is trained on windows of toxic texts, the other on windows of ordinary texts, by the same
steps and to the same size. Both stand behind one background, trained on ordinary texts alone, so that
what any text holds compresses alike with both: without it, chance matches outweigh the rest. Of each
class the dictionaries learn the half of the windows that the background compresses worst.

A window is ``WIDTH`` consecutive words. Its gain is its compressed length with the ordinary dictionary
less that with the toxic one. A text is described by how many of its windows, and what share, reach each
gain threshold, and the thresholds are calibrated into a probability on labelled texts that no
dictionary has seen.

zstandard neither compresses very short inputs nor starts a match in the last bytes, so every window is
followed by one filler that both dictionaries end with. Dictionaries are loaded as content.

Learned from a bounded sample of labelled rows (``SAMPLE`` per class, texts up to ``SAMPLE_BYTES``); every
text is scored whole, however long. Defined results: null and empty texts have no windows and get the
score of that; a null id is never held out; repeated rows and ties are scored alike; of a class with
fewer than three sampled texts each serves for the dictionary and for the calibration; without labels of both
classes every score is 0; extra columns of any name are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .linear import Logistic

SAMPLE, SAMPLE_BYTES = 2000, 20_000
WIDTH, BACKGROUND_WIDTH = 3, 8
BACKGROUND_BYTES, CLASS_BYTES = 262_144, 8192
THRESHOLDS = np.arange(-1, 9)
FILLER = b"\x01the filler that both dictionaries end with, so that one match covers it and short windows compress\x02"


def windows(text: str | None, width: int = WIDTH) -> list[bytes]:
    """Consecutive windows of lower-cased (A-Z) words over the whole text; the last may be shorter."""
    words = (text or "").encode().lower().split()
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(0, len(words), width)]


def _trained(size: int, samples: list[bytes], segment: int, gram: int) -> bytes:
    """A trained dictionary; too little text for training is its own dictionary."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=gram).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Lengths:
    """Compressed lengths of windows with a dictionary's content."""

    def __init__(self, content: bytes):
        parameters = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_BTLAZY2, min_match=3, window_log=19, hash_log=18, chain_log=18, search_log=7, target_length=64,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        dictionary = zstandard.ZstdCompressionDict(content + FILLER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        self._compress = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress

    def __call__(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter((len(self._compress(w + FILLER)) for w in found), np.int64, len(found))


class Model:
    """The contents of the two dictionaries and the calibration; picklable, compressors are made per worker."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        learned: dict[int, list[str]] = {}
        seen, labels = [], []
        for label in (0, 1):
            own = [t for t, y in zip(texts, toxic, strict=True) if y == label]
            learned[label] = [t for i, t in enumerate(own) if i % 3 < 2 or len(own) < 3]
            kept = [t for i, t in enumerate(own) if i % 3 == 2 or len(own) < 3]
            seen, labels = seen + kept, labels + [float(label)] * len(kept)
        background = _trained(BACKGROUND_BYTES, [w for t in learned[0] for w in windows(t, BACKGROUND_WIDTH)], 64, 8)
        lengths, self.contents = Lengths(background), []
        for label in (0, 1):
            found = [w for t in learned[label] for w in windows(t)]
            size = lengths(found)
            worst = [w for w, n in zip(found, size >= np.median(size), strict=True) if n] if found else []
            self.contents.append(background + _trained(CLASS_BYTES, worst, 16, 8))
        gain = Gain(self.contents)
        self.calibration = Logistic(np.stack([describe(gain(t)) for t in seen]), np.array(labels))


class Gain:
    """Gains of the windows of a text."""

    def __init__(self, contents: list[bytes]):
        self.ordinary, self.toxic = (Lengths(c) for c in contents)

    def __call__(self, text: str | None) -> np.ndarray:
        found = windows(text)
        return self.ordinary(found) - self.toxic(found)


def describe(gains: np.ndarray) -> np.ndarray:
    """Counts and shares of windows at each threshold, the largest and the mean gain, and the number of windows."""
    reached, n = (gains[:, None] >= THRESHOLDS).sum(0), max(1, len(gains))
    return np.concatenate([np.log1p(reached), np.sqrt(reached / n), [gains.max(initial=-4), gains.sum() / n, np.log1p(len(gains))]])


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, left_out: int = 0) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    texts, known = common.labelled_sample(docs, labels, label, modulus, left_out, SAMPLE, SAMPLE_BYTES)
    held_out = ~common.in_training(F.col("doc_id"), modulus, left_out)
    read = docs.select("doc_id", held_out.alias("held_out"), F.col("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if len(set(known)) < 2:
        return read.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model = docs.sparkSession.sparkContext.broadcast(Model(texts, np.array(known)))

    def scored(batches):
        gain, calibration = Gain(model.value.contents), model.value.calibration
        for batch in batches:
            if batch.num_rows:
                x = np.stack([describe(gain(t)) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(calibration(x))})

    rows = read.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
