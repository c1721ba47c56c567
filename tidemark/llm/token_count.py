"""Operator 8, token counts: a compiled transducer counts the tokens of whole texts."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import prepare_workers
from tidemark.llm.token_transducer import Transducer, Vocabulary


@lru_cache(maxsize=1)
def transducer(model_path: str) -> Transducer:
    """The transducer of a byte-pair ``.model`` file, once per worker process."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = (
        k
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))
    )
    scores = {model.id_to_piece(k): model.get_score(k) for k in plain}
    return Transducer(Vocabulary.from_scores(scores))


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text"
) -> DataFrame:
    """``docs`` plus ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    The model is a byte-pair one with byte fallback, identity normalisation and a space
    put before every text, as ``piece_bpe_32k.model``; the file lies at ``model_path`` on
    every executor. Null and empty texts have no bytes and no tokens. Strings of special
    tokens inside texts are ordinary text. Columns called like the added ones are
    replaced, all others and repeated rows stay. One map-only pass; a worker holds the
    table of the transducer and half a million characters at a time, however long a text.
    """

    @F.pandas_udf(LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(transducer(model_path).count(texts.tolist()), dtype="int64")

    prepare_workers(docs.sparkSession)
    known = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumns(
        {"n_bytes": F.octet_length(known).cast("long"), "n_tokens": tokens(known)}
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
