"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers with the characters up to the next marker. If no piece of the
model has a marker after another character, merges never cross a chunk's start, so the ids of a text
are those of its chunks in turn. Each distinct chunk is given to the library once, kept in a table, and
ids are joined back by position. The table belongs to a task and is emptied when it holds
``TABLE_CHUNKS`` chunks, so memory is bounded and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import read, ship, widened

MARK = "▁"
TABLE_CHUNKS = 500_000
GROUP_CHARS = 1 << 20
MODEL = "piece_bpe_32k.model"


def chunks_are_separate(processor) -> bool:
    """Whether the model's pieces allow chunks to be encoded one by one."""
    return all(MARK not in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.vocab_size()))


class ChunkTable:
    """Encodes and decodes whole texts like the library, asking it once for each distinct chunk."""

    def __init__(self, model_file: str, end_id: bool = True, size: int = TABLE_CHUNKS):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if self.processor.encode(" a") == self.processor.encode("a") or not chunks_are_separate(self.processor):
            raise ValueError("pieces of this model may cross whitespace markers, or its white space is normalised")
        self.end = str(self.processor.eos_id()) if end_id else ""
        self.names = [str(i) for i in range(self.processor.vocab_size())]
        self.size = size
        self.ids: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    @staticmethod
    def split(text: str) -> list[str]:
        """The chunks of a text, each without its first marker."""
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return words
        out, run = [], 0
        for w in words[:-1]:
            if w:
                out.append(" " * run + w)
                run = 0
            else:
                run += 1
        out.append(" " * run + words[-1])
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > self.size:
            self.ids.clear()
            self.odd.clear()
            new = list(words)
        names = self.names
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            coded = self.processor.encode(part, num_threads=1)
            for w, ids in zip(part, coded, strict=True):
                self.ids[w] = " ".join([names[i] for i in ids])
            if self.processor.decode([i for ids in coded for i in ids]) != " ".join(part):
                self.odd.update((w, back) for w, back in zip(part, self.processor.decode(coded, num_threads=1), strict=True) if w != back)
        if "" in words:  # a last marker alone; the library adds none to an empty string
            self.ids[""] = str(self.processor.piece_to_id(MARK))

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """(decimal ids joined by one space, decoded text) of each text; what is new is learned in one call."""
        split = [self.split(t) if t else [] for t in texts]
        self.learn({w for words in split for w in words})
        table, odd, out = self.ids, self.odd, []
        for words in split:
            ids = " ".join([table[w] for w in words])
            back = " ".join([odd.get(w, w) for w in words] if odd else words)
            out.append((f"{ids} {self.end}" if ids and self.end else ids or self.end, back))
        return out


def groups(texts: list[str], chars: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` characters together; a longer text stands alone."""
    lo = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > chars:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def encode(
    docs: DataFrame, model_file: str, text: str = "text", end_id: bool = True, table_chunks: int = TABLE_CHUNKS
) -> DataFrame:
    """Every row of ``docs`` with ``piece_ids`` (decimal ids joined by one space) and ``decoded``.

    A null text counts as empty and has the end id only. Other columns pass through unread; columns of
    ``docs`` with the two new names are replaced. Repeated rows are encoded alike. An empty table gives
    an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.drop("piece_ids", "decoded")
    at = docs.columns.index(text)
    schema = widened(docs, "piece_ids string, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_file, end_id, table_chunks)
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            for lo, hi in groups(texts):
                part, coded = batch.slice(lo, hi - lo), table.encode(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c[0] for c in coded], pa.string()), pa.array([c[1] for c in coded], pa.string())],
                    names=[*part.schema.names, "piece_ids", "decoded"],
                )

    return docs.mapInArrow(run, schema)


def n_ids(ids: Column) -> Column:
    """How many ids a ``piece_ids`` string holds."""
    return F.when(ids == "", F.lit(0)).otherwise(F.length(ids) - F.length(F.replace(ids, F.lit(" "), F.lit(""))) + 1).cast("long")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the digests of its ids, with an end id, and of their decoded text."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path(MODEL))
    return coded.select(
        "doc_id",
        n_ids(F.col("piece_ids")).alias("n_tokens"),
        F.sha2("piece_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_pieces": op7_pieces}
ORACLE_SQL: dict[str, str] = {}
