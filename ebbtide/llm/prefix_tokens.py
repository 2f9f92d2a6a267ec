"""Token counts: exact byte-pair token count at prefixes of a text, by dynamic programming over prefixes.

The tokenizer first cuts a text into pieces, then merges inside each piece. For one piece, let `last[i]` be the last
token of the encoding of its first i bytes. Of the tokens that end at i, exactly one can follow the encoding of what
precedes it: the one that, encoded together with `last[i - its length]`, gives these two tokens again. So
`count[i] = count[i - length] + 1`, and every prefix of the piece has its count after one pass, without merging it.

Over a text the counts add up piece by piece. A count is stored at every piece end that is not inside white space (there
the tokenizer looks ahead); between two such ends a prefix needs only the few bytes since the last of them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.tables import ship, table

#: Fixed value: how byte-level BPE vocabularies cut a text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of each cache of a worker, and the longest piece (in bytes) that is cached.
CACHE, SHORT = 300_000, 48


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts tokens as the `tokenizers` file at `path` does, without adding special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = {t for t in vocabulary if len(t) == 1} | {a + b for a, b in self.rank if a + b in vocabulary}
        self.longest = max(map(len, self.tokens))
        self.reach: dict[bytes, int] = {}  # longest token that ends in these two bytes
        for t in self.tokens:
            self.reach[t[-2:]] = max(len(t), self.reach.get(t[-2:], 1))
        self.pattern = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.stable: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, int] = dict.fromkeys(self.special, 1)
        self.states: dict[bytes, tuple[int, bytes]] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """Plain merging, lowest rank first; used on two tokens at a time."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            parts[best : best + 2] = [pair[0] + pair[1]]
        return parts

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens, encoded together, stay as they are; with an empty `a`, whether `b` does alone."""
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) >= CACHE:
                self.stable.clear()
            found = self.stable[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def state(self, prefix: bytes) -> tuple[int, bytes]:
        """Token count and last token of a short prefix; prefixes that other pieces share are looked up."""
        found = self.states.get(prefix)
        if found is not None:
            return found
        tokens, n = self.tokens, len(prefix)
        for start in range(max(0, n - self.reach.get(prefix[-2:], 1)), n):
            token = prefix[start:]
            if token in tokens:
                count, last = self.state(prefix[:start]) if start else (0, b"")
                if self.follows(last, token):
                    found = (count + 1, token)
                    break
        self.states[prefix] = found
        return found

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token count of every prefix of a piece of any length, from 0 to its length."""
        count, last, tokens, follows = [0], [b""], self.tokens, self.follows
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = piece[start:end]
                if token in tokens and follows(last[start], token):
                    count.append(count[start] + 1)
                    last.append(token)
                    break
        return count

    def piece_count(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= 2 * CACHE:
                self.known = dict.fromkeys(self.special, 1)
            raw = piece.encode()
            if len(raw) > SHORT:
                return self.piece_counts(raw)[-1]
            if len(self.states) >= CACHE:
                self.states.clear()
            found = self.known[piece] = self.state(raw)[0]
        return found

    def pieces(self, text: str) -> list[str]:
        """A text's pieces; a special string is one of them."""
        if not any(s in text for s in self.special):
            return self.pattern.findall(text)
        parts = self.cut.split(text)
        return [p for x in parts for p in ([x] if x in self.special else self.pattern.findall(x))]

    def prefixes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Piece ends (in code points) at which the count is stored, and the token count of the text up to there.

        The end of the text is always the last entry, also where it is inside white space; an empty text has none.
        """
        pieces = self.pieces(text)
        counts = list(map(self.known.get, pieces))
        if None in counts:
            counts = [self.piece_count(p) if n is None else n for p, n in zip(pieces, counts)]
        keep = ~np.fromiter(map(str.isspace, pieces), bool, len(pieces))
        keep[-1:] = True
        return np.cumsum(np.fromiter(map(len, pieces), np.int32, len(pieces)), dtype=np.int32)[keep], np.cumsum(
            np.array(counts, np.int32), dtype=np.int32)[keep]

    def prefix_tokens(self, text: str, n_chars: int, ends: np.ndarray, counts: np.ndarray) -> int:
        """Exact token count of the first `n_chars` code points; only what follows the last stored end is looked at.

        A prefix that cuts a special string counts its part as ordinary text.
        """
        k = int(np.searchsorted(ends, n_chars, "right")) - 1
        if k == len(ends) - 1 and k >= 0 and text[ends[k] - 1].isspace() and ends[k] != n_chars:
            k -= 1
        begin, total = (int(ends[k]), int(counts[k])) if k >= 0 else (0, 0)
        return total + sum(map(self.piece_count, self.pattern.findall(text[begin:n_chars])))


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each Python worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def prefix_counts(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns `key`, `n_bytes`, `piece_ends` and `token_counts` (arrays of equal length), one row per input row.

    Rows are independent: no shuffle; a task holds one Arrow batch. NULL and empty texts give 0 bytes and empty arrays,
    repeated rows their own rows, other columns are not read. The vocabulary file is opened where the tasks run.
    """
    path = path or default_vocabulary()
    ship(docs.sparkSession)
    picked = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(path).prefixes
        step = 256
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                texts = part.column(1)
                found = [prefixes(t) for t in texts.to_pylist()]
                offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pc.cast(pc.binary_length(texts), pa.int64()), *(
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found])))
                        for k in (0, 1))],
                    names=["key", "n_bytes", "piece_ends", "token_counts"])

    kind = picked.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, piece_ends array<int>, token_counts array<int>"
    return picked.mapInArrow(count, schema).withColumnRenamed("key", key)


def token_count(counts: str = "token_counts") -> Column:
    """Tokens of the whole text: its last prefix."""
    return F.coalesce(F.try_element_at(F.col(counts), F.lit(-1)), F.lit(0)).cast("long")


def fitting_chars(budget: int, ends: str = "piece_ends", counts: str = "token_counts") -> Column:
    """Code points of the longest stored prefix within `budget` tokens: where to truncate, without encoding again."""
    n = F.size(F.filter(F.col(counts), lambda c: c <= budget))
    return F.when(n > 0, F.element_at(F.col(ends), n)).otherwise(0)


def op10_token_counts(spark, folder: str) -> DataFrame:
    counted = prefix_counts(table(spark, folder, "documents"))
    n = token_count()
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > 1024).alias("over_limit"),
                          fitting_chars(1024).alias("fitting_chars"))
