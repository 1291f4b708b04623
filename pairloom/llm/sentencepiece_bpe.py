"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose concatenation is a piece.
The pair with the highest score, on ties the leftmost, is merged next; its new
neighbours join the agenda. Unknown characters become byte pieces. No piece has
a space or line end behind other characters, so the work is done once for each
distinct chunk (``chunk_ids``), and each chunk is compared with the library, batch by batch;
a difference stops the job. Decoding uses the library.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from pairloom.llm.chunk_ids import ChunkPool, flat_ids
from pairloom.llm.spans import worker_cache
from pairloom.llm.tables import map_texts

SPACE = "▁"  # fixed value: stands for a space in pieces
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """Pieces and scores of a model file, and the library's processor for checks."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(sp.get_piece_size())
        self.ids = {
            sp.id_to_piece(i): i
            for i in size
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        self.scores = {piece: sp.get_score(i) for piece, i in self.ids.items()}
        self.bytes = {i: sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)}
        bad = [p for p in self.ids if SPACE in p.lstrip(SPACE) or " " in p or "\n" in p]
        if bad or sp.encode("é ﬁ") != self.encode_chunk(" é") + self.encode_chunk(" ﬁ"):
            raise ValueError(f"not a vocabulary of chunks without normalisation: {bad[:5]}")

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk; its spaces are written as ``SPACE``, no prefix is added."""
        symbols = list(chunk.replace(" ", SPACE))
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores, agenda = self.scores, []

        def consider(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                piece = symbols[left] + symbols[right]
                score = scores.get(piece)
                if score is not None:
                    heapq.heappush(agenda, (-score, left, right, piece))

        for i in range(1, n):
            consider(i - 1, i)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            # of an entry that is out of date one symbol has grown or gone
            if symbols[left] is None or symbols[right] is None or symbols[left] + symbols[right] != piece or after[left] != right:
                continue
            symbols[left], symbols[right] = piece, None
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            consider(before[left], left)
            consider(left, after[left])
        ids: list[int] = []
        for symbol in symbols:
            if symbol is None:
                continue
            known = self.ids.get(symbol)
            if known is not None:
                ids.append(known)
            else:
                ids.extend(self.bytes[b] for b in symbol.encode())
        return ids

    def encode_checked(self, chunks: list[str]) -> list[list[int]]:
        """Ids of distinct chunks, compared with the library's."""
        found = [self.encode_chunk(chunk) for chunk in chunks]
        spaced = [chunk.startswith(" ") for chunk in chunks]
        # the library puts a space before a text: it takes the place of the chunk's own
        expected = self.library.encode(
            [chunk[1:] if own else chunk for chunk, own in zip(chunks, spaced)], num_threads=1
        )
        prefix = self.ids[SPACE]
        for chunk, own, ours, theirs in zip(chunks, spaced, found, expected):
            if own and chunk == " ":
                theirs = [prefix]
            elif not own:
                theirs = theirs[1:] if theirs[:1] == [prefix] else self._without_prefix(chunk)
            if ours != theirs:
                raise ValueError(f"not as the library encodes it: {chunk[:80]!r}")
        return found

    def _without_prefix(self, chunk: str) -> list[int]:
        """Library ids of a chunk that has no space before it, behind a line end."""
        line_end = self.library.encode("\n")
        return self.library.encode("\n" + chunk)[len(line_end) :]


def piece_pool(path: str) -> tuple[PieceModel, ChunkPool]:
    def load():
        model = PieceModel(path)

        def encode(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            return flat_ids(model.encode_checked(chunks.cast(pa.large_string()).to_pylist()))

        return model, ChunkPool(encode, b" \n")

    return worker_cache("pieces:" + path, load)


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, bounds)`` of all texts of a slice; null and empty texts have no ids."""
    pool = piece_pool(path)[1]
    # the library writes a space as SPACE, so that both are one symbol
    texts = pa.compute.replace_substring(pa.compute.fill_null(texts, ""), SPACE, " ")
    empty = pa.compute.equal(pa.compute.binary_length(texts), 0)
    prefixed = pa.compute.binary_join_element_wise(" ", texts, "")
    return pool.encode_texts(pa.compute.if_else(empty, "", prefixed))


def decode_ids(ids: np.ndarray, bounds: np.ndarray, path: str) -> list[str]:
    flat = ids.tolist()
    at = bounds.tolist()
    return piece_pool(path)[0].library.decode(
        [flat[a:b] for a, b in zip(at, at[1:])], num_threads=1
    )


def round_trips(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text; digests of the ids and of the decoded text.

    Null and empty texts have no ids and decode to the empty text. Repeated rows
    give a row each; a null key is kept; other columns are not read.
    """

    def run(texts, others):
        ids, bounds = encode_texts(texts, path)
        decoded = decode_ids(ids, bounds, path)
        decimal = list(map(str, ids.tolist()))
        at = bounds.tolist()
        return {
            "doc_id": others[0],
            "n_tokens": np.diff(bounds),
            "ids_sha256": [
                hashlib.sha256(",".join(decimal[a:b]).encode()).hexdigest()
                for a, b in zip(at, at[1:])
            ],
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
        }

    return map_texts(docs, [text, doc_id], SCHEMA, run)
