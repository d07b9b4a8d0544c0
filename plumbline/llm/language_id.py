"""Language identification by compression.

Each language has a dictionary: raw text of some of its labelled documents.  A text is
compressed with the dictionary of each language in turn; the language that leaves the
fewest bytes wins.  Texts are compressed in pieces of ``CHUNK`` bytes, every one of them,
so that the dictionary counts as much at the end of a long text as at its start.  Case is
folded on both sides.

Cases: a null text, or one without letters, is ``und`` with score 0; ties go to the first
language by name; repeated rows each get their row; without any labelled text all are
``und``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.window import Window

#: The bounded sample: documents of each language, and characters of each from a place
#: that its id's hash picks.  Languages beyond MAX_LANGUAGES (the rarest) are refused.
SAMPLE_DOCS, SAMPLE_CHARS, MAX_LANGUAGES = 128, 1024, 256
CHUNK = 4096
LEVEL = 6
#: A text is rejected if the best language saves less than this part of the second best.
MARGIN = 0.003
UNDETERMINED = "und"


def learn(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary from a bounded sample of labelled rows, picked by hash of id.

    At most ``SAMPLE_DOCS * SAMPLE_CHARS`` characters of a language reach the driver.
    """
    named = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    mixed = F.xxhash64(F.col(id_col).cast("string"))
    size = F.length(text_col)
    at = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("place")),
                F.greatest(size - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    cut = F.substring(F.col(text_col), at, F.lit(SAMPLE_CHARS))
    # Only ids and places go through the window; ranks are limited before the shuffle.
    order = Window.partitionBy("lang").orderBy("mixed", "cut")
    rows = named.select(F.col(lang_col).alias("lang"), mixed.alias("mixed"), cut.alias("cut")) \
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCS) \
        .orderBy("lang", "n").limit(SAMPLE_DOCS * MAX_LANGUAGES + 1).collect()
    if len(rows) > SAMPLE_DOCS * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, list[str]] = {}
    for row in rows:
        out.setdefault(row["lang"], []).append(row["cut"])
    return {lang: "\n".join(texts).lower().encode() for lang, texts in out.items()}


class Classifier:
    """The languages' compressors."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.languages = sorted(dictionaries)
        self.compressors = []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(
                level=level, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Bytes that each language leaves of the whole text."""
        raw = text.lower().encode()
        chunks = [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)]
        return np.array([sum(len(c.compress(x)) for x in chunks) for c in self.compressors])

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin: the share of the second smallest size that the smallest
        saves, so 0 says that two languages fit alike."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0, 1.0
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        second = float(np.delete(sizes, best).min())
        margin = 1 - float(sizes[best]) / second
        return self.languages[best], min(1.0, max(0.0, margin)), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, id_col: str = "doc_id",
             text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` (narrow margin or ``und``)."""
    made = "lang_pred string, score double, rejected boolean"

    def classify(texts):
        own = _classifier(dictionaries)
        rows = [own.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
             pa.array([r[0] == UNDETERMINED or r[2] < margin for r in rows], pa.bool_())],
            ["lang_pred", "score", "rejected"])

    classify = F.arrow_udf(classify, made, ArrowUDFType.SCALAR)
    # Marked so that a filter on its result does not make Spark evaluate it twice.
    once = classify.asNondeterministic()
    return docs.withColumn("_language", once(F.col(text_col))).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")], "_language.*")


_made: dict[int, Classifier] = {}


def _classifier(dictionaries: dict[str, bytes]) -> Classifier:
    key = hash(tuple(sorted(dictionaries.items())))
    if key not in _made:
        _made.clear()
        _made[key] = Classifier(dictionaries)
    return _made[key]


def held_out(id_col: str = "doc_id"):
    """A third of the documents, by their id, from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
