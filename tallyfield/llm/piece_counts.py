"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Every node has a failure link, the node where matching goes on once
the greedy pieces of the text so far are taken off, and the number of pieces that are taken off on the
way (1 at a node that is a piece itself). A text's count is then a walk that adds those numbers; no piece
is ever built. A word is matched with the space before it, and every byte is a piece, so that all words
have a count. Words of a batch are walked side by side, each distinct word once.

Rows are independent: no shuffle. Defined results: null and empty texts have no words and no pieces;
repeated rows and ties are counted alike; very long texts are read whole; extra columns of any name are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizers file; all single bytes are among them."""
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    # byte-level vocabularies write each byte as a printable character
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [bytes(byte[c] for c in name) for name in names if all(c in byte for c in name)]


class Automaton:
    """Sorted transitions (node and byte to node), failure links and popped counts."""

    def __init__(self, pieces: list[bytes]):
        child: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in {*pieces, *(bytes([b]) for b in range(256))} - {b""}:
            node = 0
            for b in piece:
                if b not in child[node]:
                    child[node][b] = len(child)
                    child.append({})
                    is_piece.append(False)
                node = child[node][b]
            is_piece[node] = True
        fail, popped, order = [0] * len(child), [0] * len(child), [0]
        for node in order:  # by depth: nodes are added behind while the list is read
            for b, below in child[node].items():
                order.append(below)
                if is_piece[below]:
                    popped[below] = 1
                else:
                    z, n = fail[node], popped[node]
                    while b not in child[z]:
                        n, z = n + popped[z], fail[z]
                    fail[below], popped[below] = child[z][b], n
        keys = sorted((node << 8 | b, below) for node, x in enumerate(child) for b, below in x.items())
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*keys, strict=True))
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(words) or b" ", np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ordered = -sizes[order]
        for t in range(int(sizes.max(initial=0))):
            going = np.arange(np.searchsorted(ordered, -t, side="left"))
            byte = data[starts[going] + t].astype(np.int64)
            while len(going):
                key = state[going] << 8 | byte
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                state[going[hit]] = self.to[at[hit]]
                going, byte = going[~hit], byte[~hit]
                total[going] += self.popped[state[going]]
                state[going] = self.fail[state[going]]
        while state.any():
            total += self.popped[state]
            state = self.fail[state]
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out


def count(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary(tokenizer)))

    def counted(batches):
        for batch in batches:
            texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
            each = shared.value.count([b" " + w for w in words.dictionary.to_pylist()])[words.indices.to_numpy()]
            reached = np.concatenate([[0], np.cumsum(each)])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(sizes), "n_pieces": pa.array(reached[ends] - reached[ends - sizes])})

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(counted, f"doc_id {kind}, n_words long, n_pieces long")
