"""Token counts by a public vocabulary, in place of the estimate from lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Vocabulary:
    """Counts of a `tokenizers` file at a path that every machine has: for one text by calling it, for a column in Arrow batches.

    Texts that look like special tokens are counted as the ordinary text that they are.
    """

    def __init__(self, path: str):
        self.path, self._loaded = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_loaded": None}

    def _tokenizer(self):
        if self._loaded is None:
            from tokenizers import Tokenizer

            self._loaded = Tokenizer.from_file(self.path)
            self._loaded.encode_special_tokens = True
        return self._loaded

    def __call__(self, text: str | None) -> int:
        return len(self._tokenizer().encode(text, add_special_tokens=False).ids) if text else 0

    def column(self, c: Column | str) -> Column:
        """A long for each text; 0 for null."""
        counter = self

        @F.pandas_udf("long")
        def count(texts: pd.Series) -> pd.Series:
            return texts.map(counter).astype("int64")

        return count(c)
