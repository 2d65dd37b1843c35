"""Token counts by a public SentencePiece model; huge texts are encoded in overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Columns, arrow_map, tune

#: Texts of more characters than this are encoded in chunks of this many, so that the encoder's working
#: memory for one text doesn't grow with its length.
CHUNK = 32_768
OVERLAP = 256
SPACE = "▁"


class ChunkedCounter:
    """Counts tokens of texts of any length as one call of the library on the whole text would.

    Why a splice is exact: where no piece of the vocabulary holds a space after another character
    (checked when the model is loaded), no merge ever joins the two sides of a position where a
    space follows a non-space. What is encoded on one side is then independent of the other. Such a
    position inside the overlap at which both chunks have a token boundary is a proven common boundary:
    the count up to it is taken from the left chunk, from it on from the right one. Where the overlap
    has none, it is doubled, at last to the whole rest of the text.
    """

    def __init__(self, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()))
        self.proven = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) and self._keeps_text()
        self.widened = 0  # times that an overlap was too small

    def _keeps_text(self) -> bool:
        """The model's normaliser changes nothing but the marks for spaces, so offsets are the text's own."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        n = proto.normalizer_spec
        return n.name == "identity" and not n.precompiled_charsmap and not n.remove_extra_whitespaces and n.escape_whitespaces

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.proven:
            return len(self.sp.encode(text))
        return self._spliced(text)

    def _starts(self, text: str, lo: int, hi: int) -> list[int]:
        """Where the tokens of text[lo:hi] begin, as positions in the whole text."""
        return [lo + a for a, _ in self.sp.encode(text[lo:hi], return_type="offset_mapping")["offsets"]]

    def _spliced(self, text: str) -> int:
        total, begin, lo = 0, 0, 0  # counted up to begin; the chunk at hand starts at lo <= begin
        while True:
            hi = min(len(text), lo + self.chunk)
            starts = self._starts(text, lo, hi)
            if hi == len(text):
                return total + sum(s >= begin for s in starts)
            overlap = self.overlap
            while True:
                # the next chunk begins within this one; a boundary common to both is looked for
                next_lo = max(begin + 1, hi - overlap)
                cut = self._common(text, starts, next_lo, hi)
                if cut is not None:
                    break
                self.widened += 1
                if next_lo == begin + 1:  # nowhere in this chunk: make the chunk itself larger
                    hi = min(len(text), hi + (hi - lo))
                    starts = self._starts(text, lo, hi)
                    if hi == len(text):
                        return total + sum(s >= begin for s in starts)
                overlap *= 2
            total += sum(begin <= s < cut for s in starts)
            begin, lo = cut, next_lo

    def _common(self, text: str, starts: list[int], lo: int, hi: int) -> int | None:
        """The first position in text[lo:hi], away from both ends, that is a proven boundary in both chunks."""
        right = None
        own = {s for s in starts if lo < s < hi}
        for m in re.finditer(r"(?<=[^ ▁])[ ▁]", text[lo:hi]):
            cut = lo + m.start()
            if cut in own:
                if right is None:
                    right = {*self._starts(text, lo, hi)}
                if cut in right:
                    return cut
        return None


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens without begin and end tokens, over_limit (n_tokens > limit).

    No shuffle; each text is encoded where it is read, a huge one chunk by chunk (ChunkedCounter). A null
    text counts as empty: no bytes, no tokens. Repeated rows and null ids are counted row by row; an empty
    table gives an empty result; other columns are not read. model_path is a file that the executors have.
    """
    tune(docs.sparkSession)

    def count(batches: Iterator[Columns]) -> Iterator[Columns]:
        counter = ChunkedCounter(model_path)
        for b in batches:
            short = [i for i, t in enumerate(b["text"]) if len(t) <= CHUNK]
            n = [0] * len(b["text"])
            for i, ids in zip(short, counter.sp.encode([b["text"][i] for i in short], num_threads=1), strict=True):
                n[i] = len(ids)
            for i, t in enumerate(b["text"]):
                if len(t) > CHUNK:
                    n[i] = counter.count(t)
            yield {id_col: b["id"], "n_bytes": b["n_bytes"], "n_tokens": n, "over_limit": [x > limit for x in n]}

    text = F.coalesce(docs[text_col], F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(docs[id_col].alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")), count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
