"""Scorers backed by a user's model, fed with Arrow batches of the text column.

Only the text crosses to the Python worker; the other columns stay in the JVM.
The model is built once per worker and batch size bounds its memory.
"""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from postlab import rules
from postlab.functions.text import _col, flatten_newlines, truncate


def label_batches(text, factory: Callable[[], Callable[[Sequence[str]], Sequence[str]]],
                  batch_size: int = 64, max_chars: int | None = None) -> Column:
    """Struct (label, score_error) of each text.

    ``factory`` builds a model that maps texts to labels. Blank text is neutral
    without a call. When a batch fails its rows are retried alone, so one bad
    text costs only itself; it becomes neutral and its error is reported.
    """

    @pandas_udf("label string, score_error string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()

        def safe(chunk):
            try:
                return [(label.lower(), None) for label in model(chunk)]
            except Exception as error:
                if len(chunk) == 1:
                    return [("neutral", f"{type(error).__name__}: {error}")]
                return [row for one in chunk for row in safe([one])]

        for series in batches:
            rows = [("neutral", None)] * len(series)
            wanted = [i for i, t in enumerate(series) if isinstance(t, str) and t.strip()]
            for start in range(0, len(wanted), batch_size):
                ids = wanted[start:start + batch_size]
                for i, row in zip(ids, safe([series.iloc[i] for i in ids])):
                    rows[i] = row
            yield pd.DataFrame(rows, columns=["label", "score_error"])

    text = _col(text)
    return score(truncate(text, max_chars) if max_chars else text)


def infer_batches(text, factory: Callable[[], Callable], batch_size: int = 32) -> Column:
    """Struct (sentiment, neg_score, neu_score, pos_score, score_error).

    ``factory`` builds a model that maps texts to an (n, 3) array of logits. When a batch fails
    its rows are retried alone; a text that fails by itself gets neutral scores and its error is reported.
    """
    failed = rules.FAILED_BATCH_SCORES

    @pandas_udf("sentiment string, neg_score double, neu_score double, pos_score double, "
                "score_error string")
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        model = factory()
        names = np.array(["Negative", "Neutral", "Positive"])
        for series in batches:
            texts = ["" if t is None else t for t in series]
            parts = []
            todo = [texts[start:start + batch_size] for start in range(0, len(texts), batch_size)][::-1]
            while todo:
                chunk = todo.pop()
                try:
                    logits = np.asarray(model(chunk), dtype="float64")
                    exps = np.exp(logits - logits.max(axis=1, keepdims=True))
                    p = exps / exps.sum(axis=1, keepdims=True)
                    labels, error = names[p.argmax(axis=1)], None
                except Exception as problem:
                    if len(chunk) > 1:
                        todo += [[text] for text in reversed(chunk)]
                        continue
                    p = np.tile(failed, (len(chunk), 1))
                    labels = ["Neutral"] * len(chunk)
                    error = f"{type(problem).__name__}: {problem}"
                parts.append(pd.DataFrame({
                    "sentiment": labels, "neg_score": p[:, 0], "neu_score": p[:, 1],
                    "pos_score": p[:, 2], "score_error": error}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(
                columns=["sentiment", "neg_score", "neu_score", "pos_score", "score_error"])

    return infer(flatten_newlines(F.coalesce(_col(text), F.lit(""))))
