"""Text embeddings: a pluggable embedder with a deterministic one built in.

HashingEmbedder adds signed hashes of words and word pairs into a unit vector. OnnxEmbedder runs a model file, where one
is given, with masked mean pooling. Both run in mapInArrow, one instance for each worker.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DIM = 384
_WORD = re.compile(r"\w+")


def unit(v: np.ndarray) -> np.ndarray:
    """Unit length; a near-zero vector becomes the uniform one, one with a NaN the zero vector."""
    n = float(np.linalg.norm(v))
    if np.isnan(n):
        return np.zeros_like(v)
    return np.full_like(v, 1 / np.sqrt(len(v))) if n < 1e-6 else v / n


class HashingEmbedder:
    def __init__(self, dim: int = DIM):
        self.dim = dim

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            found = _WORD.findall((t or "").lower())
            for f in [*found, *map(" ".join, zip(found, found[1:], strict=False))]:
                h = zlib.crc32(f.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
            out[i] = unit(out[i])
        return out


class OnnxEmbedder:
    def __init__(self, model_path: str, tokenizer_path: str, max_tokens: int = 256):
        self.paths, self.max_tokens, self.parts = (model_path, tokenizer_path), max_tokens, None

    def __getstate__(self):
        return {**self.__dict__, "parts": None}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.parts is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(self.paths[1])
            tok.enable_truncation(self.max_tokens)
            tok.enable_padding()
            self.parts = onnxruntime.InferenceSession(self.paths[0]), tok
        session, tok = self.parts
        got = tok.encode_batch([t or "" for t in texts])
        feeds = {"input_ids": np.array([g.ids for g in got]), "attention_mask": np.array([g.attention_mask for g in got]), "token_type_ids": np.array([g.type_ids for g in got])}
        states = session.run(None, {i.name: feeds[i.name] for i in session.get_inputs()})[0]
        mask = feeds["attention_mask"][:, :, None]
        return np.array([unit(v) for v in (states * mask).sum(1) / np.maximum(mask.sum(1), 1)])


def embedded(files: DataFrame, text: str, embedder=None, column: str = "embedding") -> DataFrame:
    """files with a vector of a text column."""
    embed = embedder or HashingEmbedder()
    names = files.columns

    def run(batches):
        for b in batches:
            v = embed(b.column(names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(v), pa.list_(pa.float32()))], [*names, column])

    return files.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), f"{column} array<float>"]))
