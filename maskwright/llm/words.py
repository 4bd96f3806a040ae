"""Token ids of whole texts by the tokenizers library, looked up piece by piece.

The vocabulary's pipeline composes and lower-cases letters, drops white space and splits runs of letters from runs of
marks, and no token spans such a border. So a text's ids are those of its pieces between blanks and line feeds, in
order; a run of plain marks that ends a word may be a piece of its own, and ASCII letters may be lower-cased first.
Texts are cut into pieces and the pieces of a batch numbered in Arrow; each distinct piece is encoded once by the
library and remembered. The tests hold the result against `encode` on whole texts.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ENCODERS: dict = {}
#: a letter, marks that end its word, and what follows; neither apostrophes (part of contractions) nor what special tokens are made of
_ENDS = r"([a-zß-öø-ÿ])([.,!?;:#$%&*]+)([ \n]|$)"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """`limit` bounds the remembered pieces; beyond it the memory starts anew, which changes no result."""

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self._clear()

    def _clear(self):
        self.at: dict[str, int] = {"": 0}
        self.flat, self.starts, self.lens = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.used = 0

    def _learn(self, new: list[str]):
        ids, lens = [np.zeros(0, np.uint32)], []
        for lo in range(0, len(new), 20_000):  # many pieces in one text, told apart by where each token begins
            some = new[lo : lo + 20_000]
            got = self.tok.encode(" ".join(some), add_special_tokens=False)
            sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
            owner = np.searchsorted(np.cumsum(sizes), np.fromiter((a for a, _ in got.offsets), np.int64, len(got)), "right")
            ids.append(np.array(got.ids, np.uint32))
            lens.append(np.bincount(owner, minlength=len(some)))
        ids, lens = np.concatenate(ids), np.concatenate(lens)
        n, need = len(self.at), self.used + len(ids)
        while len(self.flat) < need:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < n + len(new):
            self.starts, self.lens = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.lens, np.zeros_like(self.lens)])
        self.flat[self.used : need] = ids
        self.lens[n : n + len(new)] = lens
        self.starts[n : n + len(new)] = self.used + np.cumsum(lens) - lens
        self.used = need
        self.at.update(zip(new, range(n, n + len(new))))

    def encode(self, texts: list[str | None] | pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text (null: empty), each with end_id if given."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(col):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        col = pc.fill_null(col, "")
        # special tokens are matched as they are written
        col = pc.if_else(pc.match_substring(col, "<|"), col, pc.ascii_lower(col))
        col = pc.replace_substring(pc.replace_substring_regex(col, _ENDS, r"\1 \2\3"), "\n", " ")
        parts = pc.split_pattern(col, " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.at) > self.limit:
            self._clear()
        if new := list(set(words).difference(self.at)):
            self._learn(new)
        known = np.fromiter(map(self.at.__getitem__, words), np.int32, len(words))
        lens, starts = self.lens[known], self.starts[known]
        at = coded.indices.to_numpy()
        lens = lens[at]
        ends = np.cumsum(lens, dtype=np.int64)
        total = int(ends[-1])
        kind = np.int32 if max(total, self.used) < 1 << 31 else np.int64
        ids = self.flat[np.repeat((starts[at] - (ends - lens)).astype(kind), lens) + np.arange(total, dtype=kind)]
        upto = ends[np.cumsum(pc.list_value_length(parts).to_numpy()) - 1]
        counts = np.diff(upto, prepend=0)
        if end_id is not None:
            ids = np.insert(ids, upto, end_id)
            counts = counts + 1
        return ids, counts


def encoder(path: str, limit: int = 500_000) -> WordEncoder:
    """One encoder for each worker process."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = WordEncoder(path, limit)
    return _ENCODERS[path, limit]


def parts(batch: pa.RecordBatch, column: int = 1, most_bytes: int = 4_000_000):
    """The batch in parts of about most_bytes of the column's texts."""
    for a, b in slices(batch.column(column), most_bytes):
        yield batch.slice(a, b - a)


def slices(column: pa.Array, most_bytes: int = 8_000_000):
    """Index ranges of texts of about most_bytes together; a longer text stands alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most_bytes, "right")))
        yield a, b
        a = b
