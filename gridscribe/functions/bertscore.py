"""BERTScore: the tokens of two texts matched by the vectors that a transformer gives them, in Arrow batches on the CPU."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Setting of a session: a folder that all executors read, with tokenizer.json and model.onnx, whose first output are the vectors of the tokens (of the layer that is to be compared).
MODEL = "spark.gridscribe.bertscore.model"
#: Tokens that the model reads at once where tokenizer.json does not say; longer texts are read in stretches of as many, and all of them count.
LIMIT = 512
#: Tokens of the text whose likenesses to all of the reference are held at once.
ROWS = 1024


class Encoder:
    def __init__(self, folder: str):
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # a core a task
        self.model = onnxruntime.InferenceSession(f"{folder}/model.onnx", options, providers=["CPUExecutionProvider"])
        self.takes = [x.name for x in self.model.get_inputs()]
        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        self.tokenizer.no_padding()
        self.tokenizer.enable_truncation((self.tokenizer.truncation or {}).get("max_length", LIMIT))

    def vectors(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of length one of all tokens, and which of these are the text's own: the marks that the model puts around it may be matched, but do not count."""
        first = self.tokenizer.encode(text.strip())
        found, own = [np.zeros((0, 0))], []
        for part in [first, *first.overflowing]:
            if not part.ids:
                continue
            ids = np.array([part.ids], np.int64)
            given = {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)}
            v = self.model.run(None, {k: given[k] for k in self.takes})[0][0].astype(float)
            size = np.sqrt((v * v).sum(1))
            found.append(v / np.where(size > 0, size, 1.0)[:, None])
            own += [not x for x in part.special_tokens_mask]
        return (np.concatenate(found[1:]) if own else found[0]), np.array(own, bool)


def f1(text: tuple[np.ndarray, np.ndarray], reference: tuple[np.ndarray, np.ndarray]) -> float:
    """Each token's likeness to the nearest of the other side by cosine: the mean over the text's is precision, that over the reference's recall. 0 where either has none."""
    (x, of_x), (y, of_y) = text, reference
    if not of_x.any() or not of_y.any():
        return 0.0
    best_x, best_y = np.empty(len(x)), np.full(len(y), -np.inf)
    for lo in range(0, len(x), ROWS):
        like = x[lo : lo + ROWS] @ y.T
        best_x[lo : lo + ROWS] = like.max(1)
        np.maximum(best_y, like.max(0), out=best_y)
    p, q = best_x[of_x].mean(), best_y[of_y].mean()
    return float(2 * p * q / (p + q)) if p + q else 0.0


@lru_cache(maxsize=1)
def encoder(folder: str) -> Encoder:
    return Encoder(folder)


@lru_cache(maxsize=8)
def _vectors(folder: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Of the last texts only: those about one table follow each other and have one reference."""
    return encoder(folder).vectors(text)


def bert_scores(folder: str):
    """Column function (generated, reference) -> (bertscore_f1, error) by the model of the folder. What cannot be scored is 0 and says why; a missing text is 0."""

    @F.pandas_udf("bertscore_f1 double, error string")
    def scored(generated: pd.Series, reference: pd.Series) -> pd.DataFrame:
        out = []
        for g, r in zip(generated, reference):
            try:
                out.append((0.0 if g is None or r is None else f1(_vectors(folder, g), _vectors(folder, r)), None))
            except Exception as e:
                out.append((0.0, f"bertscore_f1: {e}"))
        return pd.DataFrame(out, columns=["bertscore_f1", "error"])

    return scored
