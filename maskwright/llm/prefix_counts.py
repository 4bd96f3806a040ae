"""Exact token counts at every prefix of a text, by dynamic programming over the merges of a byte-fallback BPE model.

A piece sequence is what the model gives for its text exactly when each two neighbours are what it gives for the two
alone. So the last piece of the encoding of a prefix is the one piece t, ending there, that stands well after the last
piece of the shorter prefix: count[j] = count[j - len(t)] + 1. Pieces hold blanks only at their front and no line feed,
so a text falls into units (blanks and the word after them; a line feed) whose encodings do not touch; each distinct
unit is worked out once and its counts added up.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts
from .words import parts, tokenizer_path

LIMIT = 4096
BLANK = "▁"
_COUNTERS: dict = {}


class PrefixCounter:
    """`limit` bounds the remembered units; beyond it the memory starts anew, which changes no result."""

    def __init__(self, path: str, limit: int = 500_000):
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        pieces = {p.piece: p.score for p in proto.pieces if p.type == 1}
        fits = train.model_type == 2 and train.byte_fallback and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        if not fits or any(p.type in (4, 5) for p in proto.pieces) or any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
            raise ValueError("a BPE model with byte fallback and no normalization is needed, whose pieces hold blanks only in front")
        self.score, self.longest, self.limit = pieces, max(map(len, pieces)), limit
        self.units: dict[str, int] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.split = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n").findall

    def _merge(self, s: str) -> list[str]:
        """The model's pieces of a short string, by merging the best neighbours."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, a: str, b: str) -> bool:
        if (got := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            got = self.pairs[a, b] = self._merge(a + b) == ([a, b] if a else [b])
        return got

    def _extend(self, w: str, counts: list[int], last: list[int]) -> None:
        """Carry the state of the first len(counts) - 1 characters on to the whole unit."""
        score, longest, stands = self.score, self.longest, self._stands
        for j in range(len(counts), len(w) + 1):
            c = w[j - 1]
            if c not in score:  # falls back to bytes; nothing merges across
                counts.append(counts[j - 1] + len(c.encode("utf-8", "surrogatepass")))
                last.append(0)
                continue
            for n in range(min(j, longest), 0, -1):
                t = w[j - n : j]
                if t in score:
                    k = last[j - n]
                    if stands(w[j - n - k : j - n] if k else "", t):
                        counts.append(counts[j - n] + 1)
                        last.append(n)
                        break

    def unit_prefixes(self, w: str) -> list[int]:
        """Token count of w[:j] for each j from 0 to len(w)."""
        counts, last = [0], [0]
        self._extend(w, counts, last)
        return counts

    def _learn(self, new: list[str]) -> None:
        before, counts, last = "", [0], [0]
        for w in sorted(new):  # neighbours share prefixes, and so their states
            k = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                k += 1
            del counts[k + 1 :], last[k + 1 :]
            self._extend(w, counts, last)
            self.units[w] = counts[-1]
            before = w

    def units_of(self, text: str) -> list[str]:
        return self.split(BLANK + text.replace(" ", BLANK)) if text else []

    def unit_counts(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """The units of each text and the token count of each."""
        parts = [self.units_of(t) if t else [] for t in texts]
        flat = [u for p in parts for u in p]
        if len(self.units) > self.limit:
            self.units.clear()
        if new := set(flat).difference(self.units):
            self._learn(list(new))
        n = np.fromiter(map(self.units.__getitem__, flat), np.int64, len(flat))
        ends = np.cumsum([len(p) for p in parts]) if parts else []
        return [(p, n[e - len(p) : e]) for p, e in zip(parts, ends)]

    def prefixes(self, text: str) -> np.ndarray:
        """Token count of text[:j] for each j from 0 to len(text), as if each prefix were encoded alone."""
        out, base = [0], 0
        for u in self.units_of(text):
            c = self.unit_prefixes(u)
            out += [base + x for x in c[1:]]
            base += c[-1]
        return np.array([0] + out[2:] if text else [0], np.int64)  # the blank that the model puts in front is no character of the text

    def cut(self, units: list[str], counts: np.ndarray, budget: int) -> int:
        """The most code points of the text whose prefix takes at most `budget` tokens."""
        # A prefix can take fewer tokens than a shorter one only inside a unit, so units decide first.
        upto = np.cumsum(counts)
        k = int(np.searchsorted(upto, budget, "right"))
        done = sum(map(len, units[:k]))
        base = int(upto[k - 1]) if k else 0
        best = done
        while k < len(units) and base <= budget:
            c = self.unit_prefixes(units[k])
            inside = max((j for j, x in enumerate(c) if base + x <= budget), default=0)
            best = max(best, done + inside)
            done, base, k = done + len(units[k]), int(upto[k]), k + 1
        return max(0, best - 1)


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the longest prefix, in code points, of at most `limit` tokens.

    Null and empty texts have no bytes and no tokens. Rows are kept one for one, in no new order.
    """

    def run(it):
        c = counter(model_path)
        for b in it:
            for some in parts(b):
                part = some.column(1).to_pylist()
                got = c.unit_counts(part)
                n = [int(x.sum()) for _, x in got]
                fit = [len(t or "") if k <= limit else c.cut(*g, limit) for t, k, g in zip(part, n, got)]
                size = [len((t or "").encode("utf-8")) for t in part]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n]), pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `counts`: the token count of every prefix, by code points, for later budget questions by array lookup."""

    def run(it):
        c = counter(model_path)
        for b in it:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([c.prefixes(t or "").astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "counts"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, counts array<int>")


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
