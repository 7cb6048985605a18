"""SentencePiece encoding and decoding by a table of distinct marked words.

In a model none of whose pieces continue past a white-space marker, the marked words of a text
(a run of markers and what follows up to the next marker) are segmented independently. A task
keeps a table of the distinct words it has met, has the library segment each of them once, and
joins the ids back by position. The table is bounded (``TABLE_WORDS``), starts anew when full, and
goes with the task.
If a model has pieces that cross markers, whole texts go to the library.

Cases: a null or empty text has no ids and decodes to an empty text; all other columns are ignored;
an empty table gives an empty result. Ids are those of the library without begin or end ids.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from projectpulse.llm import common

TABLE_WORDS = 250_000
MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*")


def words_stand_alone(processor) -> bool:
    """Whether no piece has a marker after another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", processor.id_to_piece(i)) for i in range(processor.get_piece_size()))


class WordTable:
    """Ids (32-bit, as bytes) of the marked words met so far."""

    def __init__(self, model_file: str, limit: int = TABLE_WORDS) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.alone = words_stand_alone(self.processor)
        self.limit = limit
        self.ids: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        """Marked words, each without its first marker, which the library puts before any text."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [word[1:] for word in WORDS.findall(MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.alone:
            return self._packed(texts)
        split = [self.words(text) for text in texts]
        words = set().union(*split)
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > self.limit:
            self.ids.clear()
            new = words
        filled = [word for word in new if word]
        self.ids.update(zip(filled, self._packed(filled), strict=True))
        # the library adds no marker to an empty text: there the word is the marker alone
        self.ids[""] = array("i", [self.processor.piece_to_id(MARK)]).tobytes()
        return [b"".join(map(self.ids.__getitem__, words)) for words in split]

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [array("i", ids).tobytes() for ids in self.processor.encode(texts, num_threads=1)]


_tables: dict[str, WordTable] = {}


def _table(model_file: str) -> WordTable:
    if model_file not in _tables:
        _tables[model_file] = WordTable(model_file)
    return _tables[model_file]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids array<int>."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model_file)
        for rows, _, _ in common.blocks(batches):
            found = table.encode([t or "" for t in rows["text"].to_pylist()])
            borders = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            values = np.frombuffer(b"".join(found), np.int32)
            yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.ListArray.from_arrays(pa.array(borders), pa.array(values))], names=["doc_id", "ids"])
        table.ids.clear()
        common.give_back()

    return common.with_row_key(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: doc_id, ids, decoded_text; null ids decode like none."""
    common.small_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _table(model_file).processor
        for batch in batches:
            texts = [processor.decode(ids) if ids else "" for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded_text"])

    picked = tokens.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids")
    return picked.mapInArrow(run, "doc_id bigint, ids array<int>, decoded_text string")
