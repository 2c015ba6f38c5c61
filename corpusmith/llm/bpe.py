"""Problem 7: byte-level BPE as a lazily determinised transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly if each pair of neighbouring tokens is
the encoding of the pair's bytes. So every prefix of a word has one last token, and the encodings
of all prefixes form a tree. While bytes are read, only prefixes from which the bytes since then
may still become one token are alive. What all live prefixes share is settled and is put out;
the rest is the transducer's state. States and transitions are made when first needed and kept.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKENIZER = "byte_bpe_50k"
#: Words and states kept by a worker; when there are more, it starts afresh.
WORDS_KEPT, STATES_KEPT = 400_000, 200_000


def vocabulary(name: str = TOKENIZER, folder: str | None = None) -> tuple[dict[bytes, int], str]:
    """Tokens with their ids, and the pattern that cuts text into words.

    ``folder`` holds ``name``.tiktoken; by default it is the folder of the installed package.
    """
    import public_tokenizers

    path = os.path.join(folder, f"{name}.tiktoken") if folder else public_tokenizers.path(f"{name}.tiktoken")
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}, public_tokenizers.PATTERN


class Transducer:
    """Encodes single words. ``ids`` maps the tokens' bytes to ids, which are also the merge order."""

    def __init__(self, ids: dict[bytes, int]) -> None:
        self.ids = ids
        self.bytes = {i: b for b, i in ids.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, i in ids.items():
            node = 0
            for byte in word:
                after = self.children[node].get(byte)
                if after is None:
                    after = self.children[node][byte] = len(self.token)
                    self.children.append({})
                    self.token.append(-1)
                node = after
            self.token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self._fresh()

    def _fresh(self) -> None:
        # a live prefix is (trie node of the bytes since, tokens not yet put out, last token)
        start = ((0, (), -1),)
        self.states: dict[tuple, int] = {start: 0}
        self.forms: list[tuple] = [start]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the neighbouring parts whose union has the lowest id until none has one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ids.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ids:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ids[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``, which is -1 at the beginning of a word."""
        known = self.pairs.get((left, right))
        if known is None:
            pair = [right] if left < 0 else [left, right]
            known = self.pairs[(left, right)] = self.merged(b"".join(self.bytes[t] for t in pair)) == pair
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live, found = [], None
        for node, pending, last in self.forms[state]:
            after = self.children[node].get(byte)
            if after is None:
                continue
            token = self.token[after]
            if found is None and token >= 0 and self.fits(last, token):
                found = (0, (*pending, token), token)
            if self.children[after]:
                live.append((after, pending, last))
        if found is None:
            raise ValueError("the vocabulary lacks single bytes")
        live.append(found)
        shared = os.path.commonprefix([pending for _, pending, _ in live])
        form = tuple((node, pending[len(shared) :], last) for node, pending, last in live)
        target = self.states.get(form)
        if target is None:
            target = self.states[form] = len(self.forms)
            self.forms.append(form)
            self.moves.append({})
        move = self.moves[state][byte] = (target, tuple(shared))
        return move

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word's bytes."""
        whole = self.ids.get(word)
        if whole is not None and self.fits(-1, whole):
            return (whole,)
        if len(self.forms) > STATES_KEPT:
            self._fresh()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in word:
            move = moves[state].get(byte) or self._move(state, byte)
            if move[1]:
                out += move[1]
            state = move[0]
        out += self.forms[state][-1][1]
        return tuple(out)


class Encoder:
    """Encodes texts: cuts them into words, and remembers the words' ids."""

    def __init__(self, name: str = TOKENIZER, folder: str | None = None) -> None:
        import regex

        ids, pattern = vocabulary(name, folder)
        self.transducer = Transducer(ids)
        self.words = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; none for an empty or null text."""
        out: list[int] = []
        if not text:
            return out
        known, extend = self.known, out.extend
        for word in self.words(text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                ids = self.transducer.encode(word.encode("utf-8", "replace"))
                if len(word) <= 64:
                    known[word] = ids
            extend(ids)
        return out


class StreamingDecoder:
    """Text from tokens as they come: an incremental UTF-8 machine that holds back unfinished characters."""

    def __init__(self, name: str = TOKENIZER, folder: str | None = None, ids: dict[bytes, int] | None = None) -> None:
        self.bytes = {i: b for b, i in (ids or vocabulary(name, folder)[0]).items()}
        self._held = bytearray()
        self._missing = 0
        self._low, self._high = 0x80, 0xBF

    def _byte(self, byte: int, out: list[str]) -> None:
        if self._missing:
            if self._low <= byte <= self._high:
                self._held.append(byte)
                self._missing -= 1
                self._low, self._high = 0x80, 0xBF
                if not self._missing:
                    out.append(self._held.decode())
                    self._held.clear()
                return
            self._drop(out)
        if byte < 0x80:
            out.append(chr(byte))
        elif 0xC2 <= byte <= 0xF4:
            self._held.append(byte)
            self._missing = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
            self._low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
            self._high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
        else:
            out.append("�")

    def _drop(self, out: list[str]) -> None:
        out.append("�")
        self._held.clear()
        self._missing, self._low, self._high = 0, 0x80, 0xBF

    def feed(self, ids: Iterable[int]) -> str:
        """The characters that the tokens complete; broken sequences become U+FFFD."""
        out: list[str] = []
        for i in ids:
            for byte in self.bytes[int(i)]:
                self._byte(byte, out)
        return "".join(out)

    def close(self) -> str:
        """What is left at the end: U+FFFD if a character is unfinished."""
        out: list[str] = []
        if self._missing:
            self._drop(out)
        return "".join(out)


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(name: str = TOKENIZER, folder: str | None = None) -> Encoder:
    """The worker's encoder, made when first asked for."""
    if (name, folder) not in _encoders:
        _encoders[(name, folder)] = Encoder(name, folder)
    return _encoders[(name, folder)]


def encode_texts(rows: DataFrame, key: str, text: str, name: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """``key`` and ids (array of int) of every row; an empty array for null and empty texts.

    Special tokens aren't used: what looks like one in a text is text. Rows repeated in the input
    are repeated in the result; other columns are ignored.
    """
    source = rows.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    kind = source.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name, folder)
        for batch in batches:
            ids = [np.array(own.encode(t), dtype=np.int32) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return source.mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def count_tokens(rows: DataFrame, key: str, text: str, name: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """``key`` and n_tokens (int) of every row; 0 for null and empty texts."""
    source = rows.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    kind = source.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name, folder)
        for batch in batches:
            sizes = pa.array([len(own.encode(t)) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=[key, "n_tokens"])

    return source.mapInArrow(count, f"`{key}` {kind}, n_tokens int")


def decode_ids(rows: DataFrame, key: str, ids: str = "ids", name: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """``key`` and the text of every row's ids; an empty text for null and empty arrays, U+FFFD for bytes that aren't a character."""
    source = rows.select(F.col(key).alias(key), F.col(ids).cast("array<int>").alias("_ids"))
    kind = source.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = StreamingDecoder(name, folder)
        for batch in batches:
            texts = [own.feed(x or []) + own.close() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return source.mapInArrow(decode, f"`{key}` {kind}, text string")
