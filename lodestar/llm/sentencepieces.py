"""SentencePiece encoding and decoding through a distinct-chunk table.

A BPE piece of a model whose pieces never hold a marker after another character cannot cross from one
marked word into the next, so a text's ids are those of its marked words in order. Each task keeps a table
of the distinct marked words it meets, has the library segment each of them once, and joins the ids back
by position. The table is bounded (``TABLE`` entries, then it starts anew), needs no shuffle, and loses
nothing with a lost executor. A model that breaks the rule is encoded text by text.

Defined results: a null text counts as empty and has no ids; extra columns are dropped unless named in
``keep``; repeated rows each give a row; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pieces

#: Most entries of a task's table of distinct marked words: about 100 MB.
TABLE = 200_000
MARK = "▁"
_RUN = re.compile(" +[^ ]+| +$")


class ChunkCodec:
    """Encodes whole texts exactly as the library does, one segmentation for each distinct marked word."""

    def __init__(self, model: bytes, table: int = TABLE):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.limit, self.table = table, {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = self.sp.encode("a  b", out_type=str)
        self.lone = self.sp.piece_to_id(MARK)
        self.apart = (
            not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
            and "".join(plain) == f"{MARK}a{MARK}{MARK}b"
            and self.lone != self.sp.unk_id()
            and self.sp.encode("ﬁ①", out_type=str)[-1:] != ["1"]  # no compatibility folding
        )

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text's marked words without their first marker."""
        text = text.replace(MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [x[1:] for x in _RUN.findall(" " + text)]
        return text.split(" ") if text else []

    def _learn(self, new: list[str]) -> None:
        """Segments words that the table lacks: their ids as text, count, and what they decode to."""
        ids = self.sp.encode(new, num_threads=1)
        ids = [[self.lone] if not x else y for x, y in zip(new, ids)]
        decoded = self.sp.decode(ids, num_threads=1) if new else []
        for x, y, z in zip(new, ids, decoded):
            self.table[x] = (",".join(map(str, y)), len(y), x if x == z else z)

    def run(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: its number of ids, the ids joined by commas, the decoded text."""
        for text in texts:
            if not self.apart:
                ids = self.sp.encode(text)
                yield len(ids), ",".join(map(str, ids)), self.sp.decode(ids)
                continue
            found = self.chunks(text)
            if new := set(found).difference(self.table):
                if len(self.table) + len(new) > self.limit:
                    self.table.clear()
                    new = set(found)
                self._learn(list(new))
            rows = [self.table[x] for x in found]
            yield sum(x[1] for x in rows), ",".join([x[0] for x in rows]), " ".join([x[2] for x in rows])


def encode_decode(df: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256"), table: int = TABLE) -> DataFrame:
    """Encodes and decodes every whole text.

    outputs: any of n_tokens, ids (array of int), decoded, ids_sha256 (of decimal ids joined by commas),
    decoded_sha256. The columns in keep come first, as they are.
    """
    kinds = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]] + [f"{x} {kinds[x][0]}" for x in outputs])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model, table)
        make = {
            "n_tokens": lambda n, ids, out: n,
            "ids": lambda n, ids, out: [int(x) for x in ids.split(",")] if ids else [],
            "decoded": lambda n, ids, out: out,
            "ids_sha256": lambda n, ids, out: hashlib.sha256(ids.encode()).hexdigest(),
            "decoded_sha256": lambda n, ids, out: hashlib.sha256(out.encode()).hexdigest(),
        }
        for batch in pieces(batches):
            found: list[list] = [[] for _ in outputs]
            for row in codec.run(batch.column(len(keep)).to_pylist()):
                for column, name in zip(found, outputs):
                    column.append(make[name](*row))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(x, kinds[n][1]) for x, n in zip(found, outputs)], names=[*keep, *outputs])

    return source.mapInArrow(work, schema)
