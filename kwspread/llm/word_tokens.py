"""Token ids of whole documents by the tokenizers library, each distinct chunk once.

The vocabularies used here never build a token across white space and drop it, so the
ids of a text are the ids of its white-space-free chunks in order. A worker keeps the
ids of the chunks it has met (bounded by MAX_CHUNKS, then started anew) and gathers a
document's ids from that table. Chunks are cut at ASCII white space only; the library
sees whatever else a chunk holds, special-token strings included.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from kwspread.llm.common import Pool, Slots, segment_sums, split_words, worker_cache

#: Chunks a worker remembers at once (about 200 bytes each).
MAX_CHUNKS = 500_000
#: Characters below this are their own NFC form and lower-case one by one.
LATIN_END = "\u0250"
#: Ends of a chunk that the vocabulary's split always parts from letters before them.
STOPS = ".,"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others are numbered from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class ChunkEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.stops: dict[str, list[int]] = {}
        probe = "\u00c9coleAb.,"
        self.plain = self._plain(probe) == self._library([probe])[0]
        self._forget()

    def _forget(self) -> None:
        self.slots, self.pool = Slots(), Pool(np.int32)

    def _library(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _plain(self, chunk: str) -> list[int] | None:
        """Ids of Latin letters and trailing stops by the library's merge model alone:
        on such chunks its normalizer only lower-cases and its split only parts the
        stops. None: the whole library has to see the chunk."""
        core = chunk.rstrip(STOPS)
        if not core.isalpha() or not (core.isascii() or max(core) < LATIN_END):
            return None
        low, end = core.lower(), chunk[len(core) :]
        if len(low) != len(core):  # a letter that lower-cases to a letter and a mark
            return None
        if end not in self.stops:
            self.stops[end] = self._library([end])[0]
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(low)] + self.stops[end]

    def _describe(self, chunks: list[str]) -> None:
        ids = [self._plain(c) if self.plain else None for c in chunks]
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(rest, self._library([chunks[k] for k in rest]), strict=True):
            ids[k] = x
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        self.pool.extend(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        if len(self.slots) > MAX_CHUNKS:
            self._forget()
        chunks, counts = split_words(texts)
        rows, new = self.slots.numbered(chunks)
        if new:
            self._describe(new)
        flat, size = self.pool.gather(rows)
        return flat, segment_sums(size, counts)


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    return worker_cache(("encoder", path), lambda: ChunkEncoder(path))
