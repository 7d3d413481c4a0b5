"""Language identification by compression.

Each language gets a zstandard raw-content dictionary made of pieces of its
training texts. A text is cut into blocks, every block is compressed once per
language with that language's dictionary, and the language with the fewest bytes
in total wins. A narrow margin between the best two is marked as rejected.

Texts and dictionaries are lower-cased, so that capitals do not hide a language.
Blocks keep the dictionary relevant on long texts (a long text would soon be
compressed against itself), and bound the memory of a call. The whole text counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riskframe.llm.common import give_back, held_out, ship_by_value

ship_by_value(__name__)

UNDETERMINED = "und"
#: Compression: matches of three bytes and a lazy search, so that word parts of a short text are found in the dictionary.
SEARCH = {"window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 4, "min_match": 3, "target_length": 16}
LETTER = re.compile(r"[^\W\d_]")


def training_pieces(docs: DataFrame, id_col: str, text_col: str, lang_col: str, modulus: int, remainder: int,
                    docs_per_lang: int, piece_chars: int) -> DataFrame:
    """(lang, piece): up to ``docs_per_lang`` training rows of each language, chosen by a hash of the id.

    The piece starts at a hash-chosen place of the text. Rows are ranked inside 64 hash buckets first,
    so that a language with most rows is not ranked by one task.
    """
    t = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    t = t.filter(F.col("l").isNotNull() & (F.length("t") > 0) & ~held_out(F.col("i"), modulus, remainder))
    t = t.withColumn("h", F.xxhash64("i")).select("l", "h", "i", F.pmod("h", F.lit(64)).alias("b"), F.substring(
        F.col("t"), F.pmod(F.xxhash64(F.lit(1), F.col("i")), F.greatest(F.length("t") - piece_chars, F.lit(1))).cast("int") + 1,
        F.lit(piece_chars)).alias("piece"))
    first = t.withColumn("r", F.row_number().over(Window.partitionBy("l", "b").orderBy("h", "i", "piece"))).filter(F.col("r") <= docs_per_lang)
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i", "piece"))).filter(F.col("r") <= docs_per_lang)
    return top.select(F.col("l").alias("lang"), "piece")


def fit_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     modulus: int = 4, remainder: int = 2, docs_per_lang: int = 120, piece_chars: int = 500,
                     model_chars: int = 16_000_000) -> dict[str, bytes]:
    """Language -> raw dictionary. The sample is at most ``model_chars`` characters in all.

    Every language keeps a dictionary; with very many languages each gets fewer pieces.
    """
    langs = docs.filter(F.col(lang_col).isNotNull()).agg(F.approx_count_distinct(lang_col)).first()[0]
    per_lang = max(4, min(docs_per_lang, model_chars // (piece_chars * max(1, langs))))
    rows = training_pieces(docs, id_col, text_col, lang_col, modulus, remainder, per_lang, piece_chars).collect()
    pieces: dict[str, list[str]] = {}
    for lang, piece in sorted((r["lang"], r["piece"]) for r in rows):
        pieces.setdefault(lang, []).append(piece)
    return {lang: "\n".join(ps).lower().encode("utf-8", "replace") for lang, ps in sorted(pieces.items())}


def classify(dictionaries: dict[str, bytes], block_chars: int, scale: float):
    """text -> (language, score, relative margin); compressors are built once per call."""
    import zstandard as zstd

    langs = list(dictionaries)
    packs = []
    how = zstd.ZstdCompressionParameters(strategy=zstd.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False, **SEARCH)
    for lang in langs:
        d = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        packs.append(zstd.ZstdCompressor(dict_data=d, compression_params=how))

    def one(text: str | None) -> tuple[str, float, float]:
        if text is None or not langs or LETTER.search(text) is None:
            return UNDETERMINED, 0.0, 0.0
        sizes = [0] * len(langs)
        for at in range(0, len(text), block_chars):
            block = text[at:at + block_chars].lower().encode("utf-8", "replace")
            for k, pack in enumerate(packs):
                sizes[k] += len(pack.compress(block))
        order = sorted(range(len(langs)), key=lambda k: (sizes[k], langs[k]))
        best = sizes[order[0]]
        score = 1.0 / sum(math.exp(max(-700.0, (best - s) / scale)) for s in sizes)
        margin = 1.0 if len(order) < 2 else (sizes[order[1]] - best) / max(1, sizes[order[1]])
        return langs[order[0]], score, margin

    return one


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", block_chars: int = 1024,
                      scale: float = 4.0, min_margin: float = 0.005, reject_as: str | None = None) -> DataFrame:
    """``docs`` plus lang_pred, score (0 to 1), margin (relative, of the best two) and rejected.

    ``score`` is the softmax of the byte counts at ``scale`` bytes. ``rejected`` marks margins below
    ``min_margin``; with ``reject_as`` set, those rows get that value as lang_pred.

    * NULL or empty text, text without a letter, or no dictionary: ``und`` with score 0, rejected.
    * Ties go to the language first by name. Repeated rows are scored alike; an empty table gives no rows.
    * All other columns pass through; existing columns named like an added one are replaced.
    """
    @pandas_udf("lang_pred string, score double, margin double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = classify(dictionaries, block_chars, scale)
        for batch in texts:
            yield pd.DataFrame([one(t) for t in batch], columns=["lang_pred", "score", "margin"])
        give_back()

    added = ("lang_pred", "score", "margin", "rejected")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    out = docs.select(*keep, predict(F.col(text_col)).alias("__p"))
    rejected = (F.col("__p.lang_pred") == UNDETERMINED) | (F.col("__p.margin") < min_margin)
    name = F.col("__p.lang_pred")
    if reject_as is not None:
        name = F.when(rejected, F.lit(reject_as)).otherwise(name)
    return out.select(*keep, name.alias("lang_pred"), "__p.score", "__p.margin", rejected.alias("rejected"))
