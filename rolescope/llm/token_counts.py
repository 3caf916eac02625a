"""Token counts without encoding most words.

Which vocabulary strings encode alone as one token is proven beforehand, by encoding each. It is also proven from the
vocabulary where a text may be cut: no piece reaches from a non-blank into a blank, or over a line break, so merges never
cross there. Pre-tokens between cuts that are proven strings count one; only the others are merged by the library, and
their counts remembered, in a table of bounded size. A vocabulary without these cuts is encoded whole.

Defined cases: null and empty texts have no tokens; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescope.session import ship_package

BLANK = "▁"
#: A line break; or blanks with the non-blanks after them; or blanks at a line's end.
PRE_TOKENS = re.compile(f"\n|[ {BLANK}]*[^ {BLANK}\n]+|[ {BLANK}]+")
#: Characters of a text that are cut into pre-tokens at once, so that a long text does not become one long list.
SLICE = 1 << 20


class PreTokenCounts(dict):
    """Tokens per pre-token: the proven strings, and what the library said about others."""

    def __init__(self, processor, remembered: int):
        super().__init__()
        self.processor, self.room = processor, remembered
        vocabulary = [processor.id_to_piece(at) for at in range(processor.get_piece_size())
                      if not (processor.is_byte(at) or processor.is_control(at) or processor.is_unknown(at))]
        self.cuts = not any(re.search(f"[^{BLANK}]{BLANK}", piece) or ("\n" in piece and piece != "\n") for piece in vocabulary)
        for piece in vocabulary if self.cuts else ():
            text = piece.replace(BLANK, " ")
            if PRE_TOKENS.fullmatch(text) and self.merged(text) == 1:
                self[text] = 1
        self.proven = len(self)

    def merged(self, text: str) -> int:
        """Tokens of a pre-token; the library puts a blank before what it encodes."""
        if text[0] in (" ", BLANK):
            return len(self.processor.encode(text[1:])) if len(text) > 1 else len(self.processor.encode("\n")) - 1
        return len(self.processor.encode("\n" + text)) - 2

    def __missing__(self, text: str) -> int:
        count = self.merged(text)
        if len(text) < 64:
            if len(self) >= self.proven + self.room:
                for key in list(self)[self.proven:]:
                    del self[key]
            self[text] = count
        return count

    def of(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.processor.encode(text))
        text = " " + text
        total, begin = 0, 0
        while begin < len(text):
            end = begin + SLICE
            if end < len(text):
                cut = re.compile(f"(?<=[^ {BLANK}])(?=[ {BLANK}])|\n").search(text, end)
                end = cut.start() if cut else len(text)
            total += sum(map(self.__getitem__, PRE_TOKENS.findall(text, begin, end)))
            begin = end
        return total


@functools.lru_cache(maxsize=2)
def counter(model: str, remembered: int) -> PreTokenCounts:
    """One table per worker process and vocabulary."""
    import sentencepiece
    return PreTokenCounts(sentencepiece.SentencePieceProcessor(model_file=model), remembered)


def token_counts(documents: DataFrame, model: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 limit: int = 4096, remembered: int = 500_000) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_tokens`` and ``over_limit``; the model file's path must hold on every executor."""
    ship_package(documents.sparkSession)

    @F.pandas_udf("long")
    def n_tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = counter(model, remembered)
        for part in parts:
            yield pd.Series([counts.of(value) if value is not None else 0 for value in part], dtype="int64")

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return documents.select(*keep, size.alias("n_bytes"), n_tokens(F.col(text)).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit)
