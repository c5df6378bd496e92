"""Language identification by compression.

Each language has a zstandard raw-content dictionary: the words of its sample texts, each once, the most frequent last.  A text
is compressed with every dictionary, all of it, in blocks of ``BLOCK`` bytes so that it can't learn from itself, and belongs to the
language whose dictionary makes it smallest.  The margin is the share by which the second smallest is larger; a margin under
``min_margin`` is rejected.

Texts are folded before: lower case, every run of other characters than letters one space.  So a text has the same language
with shouting, digits or junk marks.  The dictionaries are fitted on a bounded sample: of the ``LANGUAGES`` languages with the most different labelled
texts, the ``SAMPLE_ROWS`` of the lowest hash each, as far as they have ``SAMPLE_BYTES`` together, and of their words the most frequent ones up to
``DICTIONARY_BYTES``.  A text that is repeated under a language counts once.  Each language's dictionary is made in a task.

Null texts and texts without a letter are ``und`` with score 0.  Without any labelled text every text is ``und``.  Ties go to the
language with more sample bytes, then to the first by name; repeated rows are repeated.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, partitions, staged, text_key

#: Sample texts of a language at most.
SAMPLE_ROWS = 200
#: Bytes of a language's sample texts together at most.
SAMPLE_BYTES = 2 << 20
#: Languages that are told apart at most, those of the most labelled texts; each compresses every text once.
LANGUAGES = 128
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
BLOCK = 600
MIN_MARGIN = 0.002
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "ignore")


def dictionary(counts: Counter[bytes], limit: int = DICTIONARY_BYTES) -> bytes:
    """A language's raw dictionary content from the counts of its words: the most frequent ones, each once, the most frequent last."""
    kept, size = [], 1
    for word, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if (size := size + len(word) + 1) > limit:
            break
        kept.append(word)
    return b" " + b" ".join(reversed(kept)) + b" "


@dataclass
class LanguageModel:
    content: dict[str, bytes]
    min_margin: float = MIN_MARGIN
    level: int = LEVEL

    def __post_init__(self):
        self._compressors = None

    def __getstate__(self):
        return {"content": self.content, "min_margin": self.min_margin, "level": self.level, "_compressors": None}

    def sizes(self, raw: bytes) -> list[tuple[str, int]]:
        if self._compressors is None:
            self._compressors = []
            for lang, content in self.content.items():
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._compressors.append((lang, zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False)))
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        return [(lang, sum(len(c.compress(x)) for x in blocks)) for lang, c in self._compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, whether the margin is too narrow)."""
        raw = fold(text or "")
        if not raw or not self.content or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        found = self.sizes(raw)
        if len(found) == 1:
            return found[0][0], 1.0, False
        (best, least), (_, second) = sorted(found, key=lambda x: x[1])[:2]
        margin = (second - least) / second
        return best, margin / (margin + 0.02), margin < self.min_margin


def fit_languages(docs: DataFrame, trainable: Column | None = None, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, languages: int = LANGUAGES) -> LanguageModel:
    """Only text and non-null language of the rows for which ``trainable`` holds; only dictionaries reach the driver."""
    bounded_batches(docs.sparkSession)
    usable = docs.where(F.col(lang).isNotNull() & (trainable if trainable is not None else F.lit(True)))
    slim = usable.select(F.col(lang).cast("string").alias("__of"), text_key(text).alias("__key"), F.coalesce(F.octet_length(text), F.lit(0)).alias("__bytes"), F.col(text).cast("string").alias("__text"))
    texts = slim.groupBy("__of", "__key").agg(F.min("__bytes").alias("__bytes")).where((F.col("__bytes") > 0) & (F.col("__bytes") <= sample_bytes))
    most = texts.groupBy("__of").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "__of").limit(languages)
    by = Window.partitionBy("__of").orderBy(F.xxhash64("__key"), "__key")
    first = texts.join(F.broadcast(most.select("__of")), "__of").withColumn("__nth", F.row_number().over(by)).where(F.col("__nth") <= sample_rows)
    so_far = F.sum("__bytes").over(Window.partitionBy("__of").orderBy("__nth"))
    chosen = staged(first.withColumn("__so_far", so_far).where(F.col("__so_far") <= sample_bytes).select("__of", "__key", "__nth"), "language-sample")
    # At most sample_rows rows of each of so many languages are left here.
    rows = slim.join(F.broadcast(chosen), ["__of", "__key"]).select("__of", "__key", "__nth", "__text").dropDuplicates(["__of", "__key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, Counter()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([counts.total()], pa.int64()), pa.array([dictionary(counts)], pa.binary())], ["lang", "size", "content"])

        for batch in batches:
            for of, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of != now:
                    if counts:
                        yield done()
                    now, counts = of, Counter()
                counts.update(fold(body).split())
        if counts:
            yield done()

    dealt = rows.repartition(partitions(docs.sparkSession), "__of").sortWithinPartitions("__of", "__nth").select("__of", "__text")
    found = dealt.mapInArrow(run, "lang string, size long, content binary").collect()
    return LanguageModel({r["lang"]: bytes(r["content"]) for r in sorted(found, key=lambda r: (-r["size"], r["lang"]))})


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected): the closest language, and whether its margin is too narrow to trust."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(shared.value.predict, batch.column(1).to_pylist()))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "rejected"])

    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
