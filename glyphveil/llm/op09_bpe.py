"""Byte-pair encoding and decoding with exact merges in linear time.

A word's bytes go through an Aho-Corasick automaton of the vocabulary once, which gives the longest
token at every place. The encoder then walks from left to right with the longest token that is
compatible with the one before it, takes the next shorter prefix token where it isn't, and steps back
from dead ends, which are marked so that each place is left at most once. Two tokens are compatible
if merging their joined bytes by rank yields just these two; that is decided by undoing merges along
the seam, and kept in a table. Decoding copies bytes by an offset table of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphveil.llm.common import by_place, others, place_of, quoted, small_batches, with_fields

#: Letters that the quick word pattern knows; texts with other characters take the general pattern.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ˁ"
_OTHER = re.compile("[^\t-\r\x20-\x7e¡-©«-±´¶-¸»¿–—‘-„€" + _LETTERS + "]")
_QUICK = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r 0-9{_LETTERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_GENERAL = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(free)) for b in range(256)]


class Codec:
    """Encoder and decoder for one byte-level BPE vocabulary file of the tokenizers library.

    Words that were met are kept, up to `keep` of them, then forgotten together; so are pairs.
    Only vocabularies without normaliser, dropout or word marks are taken; others are refused.
    """

    def __init__(self, raw: bytes, keep: int = 100_000) -> None:
        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = not spec["normalizer"] and not model["dropout"] and not model["continuing_subword_prefix"] and not model["end_of_word_suffix"] and not model.get("ignore_merges")
        if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        self.keep = keep
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        size = 1 + max([*model["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        texts: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            texts[i] = token.encode() if token in self.special else bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.lengths = [len(x) for x in texts]
        # The offset table for decoding: all tokens' bytes end to end, and where each begins.
        self.blob = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.sizes = np.array(self.lengths, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.decimal = [str(i) for i in range(size)]
        # Ranks order the merges; single bytes come before any merge.
        self.rank = [-1] * size
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, ab = model["vocab"][left], model["vocab"][right], model["vocab"][left + right]
            self.merged[a, b] = rank
            if self.halves[ab] is None:
                self.halves[ab], self.rank[ab] = (a, b), rank
        words = [(t.decode("latin-1"), i) for i, t in enumerate(texts) if t and (self.halves[i] or len(t) == 1) and t.decode("latin-1", "replace") not in self.special]
        self.trie = ahocorasick.Automaton()
        for t, i in words:
            self.trie.add_word(t, i)
        self.trie.make_automaton()
        known = dict(words)
        # The longest proper prefix of each token that is a token itself.
        self.shorter = [-1] * size
        for t, i in words:
            self.shorter[i] = next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank ends in just a and b.

        Merges are undone from the last on either side of the seam. At each step the two tokens that
        meet at the seam existed until the rank of the merge undone last; a merge of them of a lower
        rank would have come first.
        """
        left, right, until, ok = a, b, (1 << 60, 0), True
        while True:
            rank = self.merged.get((left, right))
            # A merge of equal rank to the left comes first, so a right side that was merged at the same rank loses.
            if rank is not None and (rank, 0.5) < until:
                ok = False
                break
            if self.halves[left] is None and self.halves[right] is None:
                break
            if self.halves[right] is None or (self.halves[left] is not None and self.rank[left] > self.rank[right]):
                until, left = (self.rank[left], 0), self.halves[left][1]
            else:
                until, right = (self.rank[right], 1), self.halves[right][0]
        if len(self.pairs) >= self.keep:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The tokens of one word (a piece that the pattern split off)."""
        n, lengths, shorter, pairs = len(word), self.lengths, self.shorter, self.pairs
        longest = [-1] * (n + 1)
        for end, i in self.trie.iter(word.decode("latin-1")):
            longest[end - lengths[i]] = i  # ends rise, so the last token at a place is its longest; index -1 is place 0
        longest = [longest[-1], *longest[:-1]]
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if not dead[end] and (not out or (pairs[out[-1], token] if (out[-1], token) in pairs else self.compatible(out[-1], token))):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                if not out:
                    raise ValueError("the vocabulary can't spell this word")
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]

    def encode(self, text: str) -> list[int]:
        """All tokens of a text; special tokens' strings become their ids."""
        out: list[int] = []
        for piece in self.splitter.split(text) if self.splitter else [text]:
            if piece in self.special:
                out.append(self.special[piece])
                continue
            found = (_GENERAL if _OTHER.search(piece) else _QUICK).findall(piece)
            out.extend(chain.from_iterable(map(self.words.__getitem__, found)))
        return out

    def decode(self, ids: list[int], block: int = 1 << 17) -> bytes:
        """The bytes of the tokens, copied by the offset table in blocks."""
        parts = []
        for k in range(0, len(ids), block):
            part = np.array(ids[k : k + block], dtype=np.int64)
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            parts.append(self.blob[np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


class _Words(dict):
    """Words met so far and their tokens; a new one is encoded, a long one isn't kept."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.codec.encode_word(word.encode())
        if len(word) <= 64:
            if len(self) >= self.codec.keep:
                self.clear()
            self[word] = ids
        return ids


_codecs: dict[str, Codec] = {}


def codec(raw: bytes) -> Codec:
    """One Codec for each vocabulary and Python worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(raw)
    return _codecs[key]


def vocabulary(path: str, most: int = 64 << 20) -> bytes:
    """The bytes of a vocabulary file; refuses files too large to send to every executor."""
    with open(path, "rb") as f:
        raw = f.read(most + 1)
    if len(raw) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return raw


def default_vocabulary() -> str:
    """The path of the public byte-level vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the token ids of every whole text in column out (array of int).

    A null or empty text has no ids. Rows, repeated ones too, keep their other columns; a column
    named as out is replaced. No shuffle; each task holds one Arrow batch and the known words.
    """
    return _map(docs, path, text, {out: pa.list_(pa.int32())}, f"{out} array<int>", lambda c, t: (np.array(c.encode(t), dtype=np.int32),))


def bpe_decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of the token ids in column out; null or no ids give an empty text. Bytes that aren't UTF-8 become U+FFFD."""
    return _map(rows, path, ids, {out: pa.string()}, f"{out} string", lambda c, x: (c.decode(x).decode("utf-8", "replace"),), empty=[])


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 in place of columns so named, and with the ids in column ids if it is named.

    The texts are encoded and the ids decoded in one pass. Null counts as empty.
    """

    def digest(c: Codec, t: str) -> tuple:
        got = c.encode(t)
        joined = ",".join(map(c.decimal.__getitem__, got)).encode()
        decoded = c.decode(got).decode("utf-8", "replace").encode()
        out = len(got), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()
        return (*out, np.array(got, dtype=np.int32)) if ids else out

    kinds, ddl = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if ids:
        kinds, ddl = kinds | {ids: pa.list_(pa.int32())}, f"{ddl}, {ids} array<int>"
    return _map(docs, path, text, kinds, ddl, digest)


def _map(df: DataFrame, path: str, col: str, kinds: dict, ddl: str, make, empty="") -> DataFrame:
    small_batches(df.sparkSession)
    raw = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    keep = others(df, *kinds)
    left = df.select(*quoted(keep))
    # A column that is replaced goes to the workers at the end, under a name of its own, and isn't given back.
    carried = col.lower() in {c.lower() for c in keep}
    picked = left if carried else df.select(*quoted(keep), F.col(col).alias("__gv_in"))
    at = place_of(left, col) if carried else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(raw.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                made = [make(c, x.as_py() if x.is_valid else empty) for x in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array([m[i] for m in made], type=kind) for i, kind in enumerate(kinds.values()))], names=[*keep, *kinds])
        c.words.clear()  # idle workers hold little

    return by_place(picked).mapInArrow(run, with_fields(left, ddl))
